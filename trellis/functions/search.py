"""Text search by words: case-blind, without stemming. Queries are literal and planned as JVM conditions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid

_WORDS = r"[^\p{L}\p{N}]+"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Functions that make queries, by how they read a text: fixed values of the query language.
QUERIES = frozenset(("to_tsquery", "plainto_tsquery", "phraseto_tsquery", "websearch_to_tsquery"))


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def parse(kind: str, text: str):
    """("word", w, prefix), ("phrase", [w]), ("not", q), ("and", [q]) or ("or", [q])."""
    if kind == "phraseto_tsquery":
        return ("phrase", words(text))
    if kind == "websearch_to_tsquery":
        either = []
        for part in re.split(r"(?i)\s+or\s+", text):
            all_ = [(("not", ("phrase", words(q or w))) if minus else ("phrase", words(q or w))) for minus, q, w in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', part)]
            either.append(("and", [q for q in all_ if (q[1][1] if q[0] == "not" else q[1])]))
        return ("or", either) if len(either) > 1 else either[0]
    if kind == "to_tsquery":
        return _Query(text).whole()
    return ("and", [("word", w, False) for w in words(text)])


class _Query:
    """The operators & | ! <-> and parentheses, words with :* for prefixes."""

    def __init__(self, text: str):
        self.left = re.findall(r"<->|[&|!()]|'[^']*'(?::\*)?|[^\s&|!()<']+", text)

    def whole(self):
        out = self.any()
        if self.left:
            raise invalid(f"no text query: {self.left[0]}")
        return out

    def any(self):
        out = [self.all()]
        while self.left[:1] == ["|"]:
            self.left.pop(0)
            out.append(self.all())
        return out[0] if len(out) == 1 else ("or", out)

    def all(self):
        out = [self.row()]
        while self.left[:1] == ["&"]:
            self.left.pop(0)
            out.append(self.row())
        return out[0] if len(out) == 1 else ("and", out)

    def row(self):
        out = [self.one()]
        while self.left[:1] == ["<->"]:
            self.left.pop(0)
            out.append(self.one())
        if len(out) == 1:
            return out[0]
        if any(q[0] not in ("word", "phrase") or q[-1] is True for q in out):
            raise invalid("<-> joins words")
        return ("phrase", [w for q in out for w in (q[1] if q[0] == "phrase" else [q[1]])])

    def one(self):
        if not self.left:
            raise invalid("a text query ends early")
        t = self.left.pop(0)
        if t == "!":
            return ("not", self.one())
        if t == "(":
            out = self.any()
            if not self.left or self.left.pop(0) != ")":
                raise invalid("a text query lacks )")
            return out
        if t in ("&", "|", ")", "<->"):
            raise invalid(f"no text query: {t}")
        prefix = t.endswith(":*")
        own = words(t.removesuffix(":*").strip("'"))
        return ("word", own[0], prefix) if len(own) == 1 else ("phrase", own)


def _condition(q, low: Column) -> Column:
    if q[0] in ("and", "or"):
        out = None
        for x in q[1]:
            c = _condition(x, low)
            out = c if out is None else out & c if q[0] == "and" else out | c
        return F.lit(q[0] == "and") if out is None else out
    if q[0] == "not":
        return ~_condition(q[1], low)
    own = [q[1]] if q[0] == "word" else q[1]
    if not own:
        return F.lit(True)
    pattern = _BEFORE + _WORDS.join(map(re.escape, own)) + ("" if q[0] == "word" and q[2] else _AFTER)
    # the plain test is cheap and mostly settles it
    return F.contains(low, F.lit(own[0])) & F.regexp_like(low, F.lit(pattern))


def matches(text: Column, kind: str, query: str) -> Column:
    """Whether a text fulfils a literal query. The lower-cased text is made once a row."""
    q = parse(kind, query)
    return F.exists(F.array(F.lower(text)), lambda low: F.when(low.isNotNull(), _condition(q, low)))


def all_words(text: Column, query: Column) -> Column:
    """The same for a query that is a column: all of its words occur."""
    text, query = (F.filter(F.split(F.lower(c), _WORDS), lambda w: w != "") for c in (text, query))
    return F.size(F.array_except(query, text)) == 0
