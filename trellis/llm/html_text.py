"""HTML to text as a page lays it out.

A tree builder with implied tags (open elements are closed by what cannot stand inside them, cells and
rows are opened where missing) feeds a layout pass: block elements begin lines and keep margins, lists
have markers and indentation, ``pre`` keeps its spaces, table cells are aligned in columns, and what a
browser would not show (head, scripts, hidden elements) is left out. Everything else is emitted.
Both passes are loops with explicit stacks, so depth of nesting is no limit. Output is linear in the
page: indentation ends at ``INDENT`` characters, and columns are narrowed, cells wider than theirs moving
the rest of their row, until a table is at most ``STRETCH`` times as long as what it shows; cells beyond
``COLUMNS`` columns stand in the last.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INVISIBLE = frozenset("head script style template title noscript noframes noembed iframe object audio video canvas datalist link meta base".split())
#: Parts of drawings and formulas that are not drawn themselves.
UNDRAWN = frozenset("defs symbol desc metadata clippath mask marker pattern annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li main menu nav ol optgroup option search section summary ul table caption tr td th thead tbody tfoot".split())
#: What a start tag closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}
CELL_SCOPE = frozenset(("table", "td", "th", "caption"))
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<!--(?:.*?-->|.*\Z)|<[!?/][^>]*+>", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_START = re.compile(r"(?i)(?:^|\s)start\s*=\s*[\"']?(-?\d{1,9})(?!\d)")
_SPAN = re.compile(r"(?i)(?:^|\s)colspan\s*=\s*[\"']?0*(\d{1,4})")
_ZEROS, _BEYOND = re.compile(r"&#0+(?=\d)"), re.compile(r"&#\d{8,}")
INDENT, STRETCH, COLUMNS = 64, 16, 10_000
OUT_CHARS = 16 << 20  # of text sent on at a time


def unescape(text: str) -> str:
    """Character references resolved; numbers beyond every character, however long, stand for none."""
    if "&#" in text:
        text = _BEYOND.sub("&#1114112", _ZEROS.sub("&#", text))
    return html.unescape(text)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []


def build(source: str) -> Node:
    """The tree of a page; its leaves are strings."""
    root = Node("#root")
    stack: list[Node] = [root]
    at: dict[str, list[int]] = {}  # where the open elements of each tag stand in the stack

    def push(tag: str, attributes: str = "") -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        at.setdefault(tag, []).append(len(stack))
        stack.append(node)

    def pop_to(k: int) -> None:
        while len(stack) > k:
            at[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((at[t][-1] for t in tags if at.get(t)), default=0)

    def close(tags, stop) -> None:
        """Closes the outermost of ``tags`` inside the innermost of ``stop``."""
        bound = innermost(stop)
        first = [own[k] for t in tags if (own := at.get(t)) and (k := bisect_right(own, bound)) < len(own)]
        if first:
            pop_to(min(first))

    pos, end = 0, source.rfind(">") + 1
    while True:
        m = _TAG.search(source, pos, end)
        text = source[pos: m.start()] if m else source[pos:]
        if not m:
            # a tag that never ends is no text
            cut = re.search(r"<(?:[a-zA-Z/!?])", source[max(pos, end):])
            text = source[pos: max(pos, end) + cut.start()] if cut else text
        if text:
            stack[-1].children.append(unescape(text))
        if not m:
            return root
        pos = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not at.get("p"):
                stack[-1].children.append(Node("p"))
            elif at.get(tag):
                stop = {"table"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else () if tag == "table" else CELL_SCOPE - {tag}
                if at[tag][-1] > innermost(stop):
                    pop_to(at[tag][-1])
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCKS and at.get("p") and tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup"):
            close({"p"}, CELL_SCOPE)
        if tag in ("td", "th", "tr") and not at.get("table"):
            continue  # table parts outside a table have no box
        if tag in ("td", "th") and stack[-1].tag != "tr":
            push("tr")
        if tag in VOID:
            stack[-1].children.append(Node(tag, attributes))
        elif tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, pos)
            node = Node(tag, attributes)
            inner = source[pos: over.start() if over else len(source)]
            node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
            stack[-1].children.append(node)
            pos = over.end() if over else len(source)
            end = max(end, pos)
        else:
            push(tag, attributes)
            if attributes.endswith("/") and (tag in ("svg", "math") or at.get("svg") or at.get("math")):
                pop_to(len(stack) - 1)


class Flow:
    """Lines of a block: collapsed text, margins that merge, indentation."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indents = [""]  # of the open elements, each with those around it
        self.marker = ""
        self.shown = 0  # characters and lines, without the padding of tables inside

    def indent(self, by: int) -> None:
        top = self.indents[-1]
        self.indents.append(top + " " * by if len(top) < INDENT else top)

    def edge(self, gap: int) -> None:
        """A block's edge: the line ends, and ``gap`` - 1 blank lines at least follow."""
        if self.line:
            self.end_line()
        self.space = False
        if self.lines:
            self.gap = max(self.gap, gap - 1)

    def end_line(self) -> None:
        self.lines.append("".join(self.line).rstrip(" "))
        self.line = []

    def _begin(self) -> None:
        if not self.line:
            self.lines += [""] * self.gap
            self.gap = 0
            self.shown += 1
            self.line.append(self.indents[-1])
            if self.marker:
                self.line[0] = self.line[0][: max(0, len(self.line[0]) - len(self.marker))] + self.marker
                self.marker = ""
            self.space = False

    def put(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        if flat.startswith(" "):
            flat, self.space = flat[1:], True
        if flat:
            was = bool(self.line)
            space = self.space and was
            self._begin()
            if space and not self.line[-1].endswith(" "):
                self.line.append(" ")
            tail = flat.endswith(" ")
            self.line.append(flat[:-1] if tail else flat)
            self.shown += len(flat)
            self.space = tail

    def put_lines(self, lines: list[str], shown: int | None = None) -> None:
        """Lines as they are; ``shown`` is what they count for, if not their length."""
        counted = self.shown + (sum(map(len, lines)) + len(lines) if shown is None else shown)
        for k, s in enumerate(lines):
            if k:
                self.end_line() if self.line else self.lines.append("")
            if s:
                self._begin()
                self.line.append(s)
        self.shown = counted

    def br(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.gap += 1
        self.space = False

    def text(self) -> str:
        self.edge(1)
        return "\n".join(self.lines)


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int]]] = []
        self.captions: list[str] = []
        self.shown = 0

    def lines(self) -> list[str]:
        """Rows with cells aligned by column, two spaces apart; a cell of several columns does not widen them."""
        widths: list[int] = []
        out: list[list[tuple[int, str]]] = []  # lines, as texts and the columns where they begin
        for row in self.rows:
            at, lines = 0, []
            for text, span in row:
                cell = text.split("\n")
                widths += [0] * (at + span - len(widths))
                if span == 1:
                    widths[at] = max(widths[at], *map(len, cell))
                lines += [[] for _ in range(len(cell) - len(lines))]
                for k, s in enumerate(cell):
                    if s:
                        lines[k].append((at, s))
                at = min(at + span, COLUMNS)
            out += lines
        most = STRETCH * (self.shown + sum(map(len, self.rows)) + len(out))
        widest = max(widths, default=0)
        while True:
            begin = [0]
            for w in widths:
                begin.append(begin[-1] + (min(w, widest) + 2 if widest else 0))
            # a line is as long as its last text's place or the texts before it ask for
            if not widest or sum(begin[line[-1][0]] + sum(len(s) + 2 for _, s in line) for line in out if line) <= most:
                break
            widest //= 2
        return [s for c in self.captions for s in c.split("\n")] + [_set(line, begin) for line in out]


def _set(line: list[tuple[int, str]], begin: list[int]) -> str:
    parts, size = [], 0
    for at, s in line:
        pad = max(begin[at] - size, 2 if parts else 0)
        parts += [" " * pad, s]
        size += pad + len(s)
    return "".join(parts).rstrip(" ")


def attributes_of(source: str) -> dict[str, str]:
    """Names, lower-cased, and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def hidden(node: Node) -> bool:
    if node.tag in INVISIBLE:
        return True
    low = node.attributes.lower()
    if "hidden" not in low and "style" not in low:
        return False
    has = attributes_of(node.attributes)
    if "hidden" in has or (node.tag == "input" and has.get("type", "").strip().lower() == "hidden"):
        return True
    said: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", has.get("style", "")).lower().split(";"):
        name, _, value = part.partition(":")
        value, strong, _ = value.partition("!")
        if bool(strong) >= said.get(name.strip(), (False, ""))[0]:
            said[name.strip()] = (bool(strong), value.strip())
    return said.get("display", (False, ""))[1] == "none" or said.get("visibility", (False, ""))[1] in ("hidden", "collapse")


def render(root: Node) -> str:
    flows, tables, lists = [Flow()], [], []
    pre = 0
    drawn: list[bool] = []  # inside drawings: whether text shows
    formulas = 0
    todo: list[tuple[object, bool]] = [(root, True)]
    while todo:
        node, enter = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if drawn and not drawn[-1]:
                continue
            if pre:
                flow.put_lines(node.expandtabs(8).replace("\r\n", "\n").split("\n"))
            elif not (tables and flow is tables[-1][1]) or node.strip(" \t\n\r\f"):
                flow.put(node)
            continue
        tag = node.tag
        if enter:
            if hidden(node) or ((drawn or formulas) and tag in UNDRAWN):
                continue
            if tag == "svg" or (drawn and tag in ("text", "foreignobject")):
                drawn.append(tag != "svg")
                flow.space = True
            formulas += tag == "math"
            if tag == "br":
                flow.br()
                continue
            if tag == "hr":
                flow.edge(1)
                flow.put_lines(["---"])
                flow.edge(1)
                continue
            if tag == "table":
                flow.edge(2)
                tables.append((Table(), flow))
            elif tag == "tr" and tables:
                tables[-1][0].rows.append([])
            elif tag in ("td", "th", "caption") and tables:
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.edge(1 if lists else 2)
                start = _START.search(node.attributes) if tag == "ol" else None
                lists.append([tag, int(start[1]) if start else 1])
            elif tag == "li":
                flow.edge(1)
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indent(len(marker))
                flow.marker = marker
            elif tag in ("dd", "blockquote"):
                flow.edge(1 if tag == "dd" else 2)
                flow.indent(4)
            elif tag in BLOCKS or tag in ("select", "textarea"):
                flow.edge(2 if tag in PARAGRAPHS else 1)
            pre += tag in ("pre", "listing", "textarea")
            todo.append((node, False))
            todo += [(c, True) for c in reversed(node.children)]
            if tag in ("pre", "textarea") and node.children and isinstance(node.children[0], str):
                todo[-1] = (node.children[0].removeprefix("\n"), True)
            continue
        if tag == "svg" or (drawn and tag in ("text", "foreignobject")):
            drawn.pop()
            flow.space = True
        formulas -= tag == "math"
        pre -= tag in ("pre", "listing", "textarea")
        if tag == "table":
            table, flow = tables.pop()
            flow.edge(1)
            if lines := table.lines():
                flow.put_lines(lines, table.shown)
            flow.edge(2)
        elif tag in ("td", "th", "caption") and tables:
            inner = flows.pop()
            text = inner.text()
            tables[-1][0].shown += inner.shown
            if tag == "caption":
                tables[-1][0].captions.append(text)
            elif tables[-1][0].rows:
                span = _SPAN.search(node.attributes)
                tables[-1][0].rows[-1].append((text, min(max(1, int(span[1])) if span else 1, 1000)))
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flow.edge(1 if lists else 2)
        elif tag == "li":
            if flow.marker:  # an empty item shows its marker
                flow.put_lines([""])
                flow._begin()
            flow.edge(1)
            flow.indents.pop()
        elif tag in ("dd", "blockquote"):
            flow.edge(1 if tag == "dd" else 2)
            flow.indents.pop()
        elif tag in BLOCKS or tag in ("select", "textarea"):
            flow.edge(2 if tag in PARAGRAPHS else 1)
    return flows[0].text()


def html_to_text(source: str | None) -> str:
    """Visible text of a page; '' for null and empty pages."""
    return render(build(source)) if source else ""


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``pages``: the ``carry`` columns, page_id, text.

    Null and empty html give ''. Repeated rows are rendered each; an empty table gives an empty result.
    Carried columns that are named like a result are left out.
    """
    carry = tuple(c for c in carry if c.lower() not in ("page_id", "text"))
    chosen = pages.select(F.col(page_id).alias("id"), F.col(html).cast("string").alias("html"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    kinds = "".join(f"`{c}` {k}, " for c, (_, k) in zip(carry, chosen.dtypes[2:], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, held, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(html_to_text(batch.column(1)[i].as_py()))
                held += len(texts[-1])
                if held >= OUT_CHARS or i == batch.num_rows - 1:
                    part = batch.slice(a, i + 1 - a)
                    yield pa.RecordBatch.from_arrays([*part.columns[2:], part.column(0), pa.array(texts, pa.string())], [*carry, "page_id", "text"])
                    a, held, texts = i + 1, 0, []

    return chosen.mapInArrow(run, f"{kinds}page_id {chosen.dtypes[0][1]}, text string")
