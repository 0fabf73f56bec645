"""Edge cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import gzip
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from trellis.llm import ann, chat, exact_dedup, html_text, mixing, near_dedup, packing, tokens, toxicity, url_reputation, warc

#: Columns that operators use inside; none may clash with them.
CLASH = {"sha": "a", "id": 1, "n": 2, "host": "h", "size": 3, "row": 4, "part": 5, "key": "k", "text_sha256": "t", "rep": 6, "group": 7, "v": 8, "bad": 9}


def clash(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


# 1
URLS = [(1, "http://A.com/x?y"), (2, None), (3, "nothing"), (4, "x://example.com/en/1"), (5, "http://www.example.com/en/"), (6, "http://q.net/es/a#b"), (7, "http://q.net/other"), (8, "http://fresh.org/"), (1, "http://A.com/x?y"), (9, "http://b.com"), (10, "s://u@q.net:80/fr/?x")]


def test_url_rules(spark):
    df = clash(spark.createDataFrame(URLS, "page_id long, url string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(df).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow") and got[2][:3] == ("", "", None) and got[3][:3] == ("", "", None)
    assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("www.example.com/en/", "allow") and got[6][1:] == ("/es/a", "net/es/", "block")
    assert got[8][3] == "allow" and got[9][1:3] == ("", None) and got[10][:3] == ("u@q.net:80", "/fr/", None)
    assert url_reputation.judge(df).count() == len(URLS) and url_reputation.judge(df.limit(0)).count() == 0


def test_reputation_shrinks(spark):
    rows = [(f"h{i}.bad.net", 1) for i in range(30) for _ in range(5)] + [(f"h{i}.good.org", 0) for i in range(30) for _ in range(5)] + [("new.bad.net", None), ("new.good.org", None), ("h1.good.org", 1)]
    got = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["new.bad.net"]["mean"] > 0.5 > got["new.good.org"]["mean"] and got["new.bad.net"]["lower"] < got["h1.bad.net"]["lower"] and got["h1.good.org"]["lower"] < 0.5


def test_reputation_of_names_suffixes_and_labels(spark):
    rows = [(i, f"http://u@shop{i % 9}.bad.co.uk:{80 + i}/x") for i in range(90)] + [(100 + i, f"http://h{i % 9}.good.co.uk/" + "x" * 100_000 * (i == 0)) for i in range(90)] + [(500, "http://new.bad.co.uk/"), (501, "http://fresh.co.uk/"), (502, "co.uk"), (503, "http://co.uk"), (504, "http://co.uk:1/")]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string"))
    told = clash(spark.createDataFrame([(i, int(i < 90)) for i in range(190)] + [(0, 0), (0, 1), (None, 1), (999, 1)], "page_id long, bad int"))
    got = {r["page_id"]: r for r in url_reputation.judge(pages, (), told, suffixes=("co.uk",)).collect()}
    assert len(got) == len(rows) and got[0]["host"] == "u@shop0.bad.co.uk:80" and got[500]["verdict"] == "block" and got[501]["verdict"] == "allow" == got[100]["verdict"]
    assert got[0]["bad_rate"] == got[9]["bad_rate"] and got[503]["bad_rate"] == got[504]["bad_rate"]
    apart = {r["page_id"]: r for r in url_reputation.judge(pages, (), told).collect()}
    assert abs(apart[500]["bad_rate"] - apart[501]["bad_rate"]) < abs(got[500]["bad_rate"] - got[501]["bad_rate"])
    ties = url_reputation.judge(spark.createDataFrame([(1, "x://a.b/c/d")], "page_id long, url string"), (("a.b/", "block"), ("b/c/", "allow"), ("a.b/c/", "allow"))).first()
    assert (ties["rule"], ties["verdict"]) == ("a.b/c/", "allow")


# 2
def test_mixing_targets(spark):
    rows = [(1, "a b", "x"), (2, "c", "x"), (3, "d e f g h i", "y"), (4, None, "y"), (5, "", None), (6, "z z z", None)]
    got = {r["doc_id"]: r for r in mixing.mix(clash(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    total, weights, sizes = 12, {"x": 1, "y": 2, None: 3}, {"x": 3, "y": 6, None: 3}
    assert {r["source"]: r["target"] for r in got.values()} == {"x": 2.0, "y": 4.0, None: 6.0}
    assert all(got[i]["taken"] == 0 and got[i]["size"] == 0 for i in (4, 5)) and sum(r["taken"] for r in got.values()) <= total
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got.values()) and got[6]["taken"] == 6 and weights and sizes


def test_mixing_reshares_excess(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)] + [(1000 + i, "w " * 10, "b") for i in range(100)] + [(2000, "w w", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    target = {r["source"]: r["target"] for r in got}
    assert target["c"] == 6.0 and abs(target["a"] * 2 - target["b"]) < 1e-9 and abs(sum(target.values()) - 2002) < 1e-9
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in "abc"}
    assert all(abs(taken[s] - target[s]) <= 20 for s in "abc")
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_repeated_and_null_ids_rerun_alike(spark):
    """Budget cuts inside ties: the same rows in any order and partitioning give the same mix."""
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(50)]), "w " * rng.randint(0, 30), rng.choice(["a", "b", None])) for _ in range(400)]
    rows += rows[:100]
    seen = set()
    for k in range(4):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(k + 1)
        got = mixing.mix(df, budget=0.77).collect()
        seen.add(tuple(sorted(map(repr, got))))
        assert sum(r["taken"] for r in got) <= 0.77 * sum(r["size"] for r in got) and any(r["taken"] and r["doc_id"] is None for r in got)
    assert len(seen) == 1


def test_running_sums_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("k"), F.lit(2).alias("v"))
    got = mixing.running(df, ["k"], "v").collect()
    assert [(r["_at"], r["_upto_v"]) for r in sorted(got, key=lambda r: r["k"])] == [(i, 2 * i) for i in range(1, 5001)]


# 3
def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (1, [0.0, 2.0]), (None, [1.0, 1.0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id % 2 = 0"), 3, shard_rows=4, query_rows=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (2, 1, 1, 0.0), (2, 2, 0, 1.0)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


# 4
PAGES = {
    "<p>a<p>b": "a\n\nb", "<div>a</div><div>b</div>": "a\nb", "x <b>y</b>z": "x yz", "a<br>b<br><br>c": "a\nb\n\nc", "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c", "<ol start=9><li>a<li>b": "9. a\n10. b",
    "<table><tr><td>a<td>long<tr><td>more<td>b</table>": "a     long\nmore  b", "<pre>\n a\n  b</pre>": " a\n  b", "<p hidden>x</p>y": "y", "<p style='color:red; display :none'>x</p>y": "y", "<script>if (a<b) '</p>'</script>y": "y",
    "a &lt;b&gt; &amp c &#233; &copy": "a <b> & c é ©", "<!-- x > y -->z<!-- never": "z", "a < b": "a < b", "<a href='>'>t</a>": "t", "<title>t</title><body>b": "b", "a<unfinished": "a", "": "", "<p>": "", "</p>x</div>": "x", "<td>loose": "loose",
    "<dl><dt>t<dd>d</dl>": "t\n    d", "<p>a<table><tr><td>1</table><p>b": "a\n\n1\n\nb", "<details>é</details>": "é", "one\ntwo": "one two", "<li>x": "- x", "<table><caption>c</caption><tr><th colspan=2>wide one<tr><td>a<td>b</table>": "c\nwide one\na  b",
}


@pytest.mark.parametrize(("source", "text"), PAGES.items())
def test_html_layout(source, text):
    assert html_text.html_to_text(source) == text


def test_nearest_of_ids_with_many_vectors(spark):
    rows = [(0, [0.0, 1.0])] + [(7, [0.001 * i, 1.0]) for i in range(1, 60)] + [(i, [float(i), 1.0]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(7, 0.001), (1, 1.0), (2, 2.0)]


def test_nearest_ids_beyond_doubles(spark):
    rows = [(0, [0.0, 1.0])] + [(2**53 + i, [0.5, 1.0]) for i in range(3)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), 3)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [2**53, 2**53 + 1, 2**53 + 2]


def test_nearest_recall_over_shards_and_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 24)), np.repeat(rng.normal(size=(60, 24)), 10, axis=0) + 0.05 * rng.normal(size=(600, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 30 = 0"), 10, shard_rows=400, query_rows=20).collect()
    hits = 0
    for q in range(0, len(x), 30):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [int(i) for i in np.argsort(d, kind="stable") if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and all(r[2] == d[r[1]] for r in mine)
        hits += len(set(best) & {r[1] for r in mine})
    assert hits >= 0.95 * 10 * len(range(0, len(x), 30))


def test_toxicity_sample_is_of_documents_at_hand(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: sorted(toxic))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "long " * 50 if i % 3 else "short") for i in range(300, 400)], "doc_id long, text string")
    assert toxicity.fit(docs, labels, rows=5, chars=50) == [0] * 5 + [1] * 5


@pytest.mark.parametrize(("source", "text"), [
    ('<body title="show hidden files"><p aria-label="the hidden truth">a<p class="hidden md:block">b<p data-style="display:none">c<p data-type="hidden-x">d<p class=hidden>e', "a\n\nb\n\nc\n\nd\n\ne"),
    ('<p hidden>a<p HIDDEN="">b<p style="color:red; Display : none !important">c<p style=visibility:hidden>d<p style="display:none;display:block">e<p title="style=display:none">f', "e\n\nf"),
    ("x <math><mi>y</mi><mo>=</mo><semantics><mn>2</mn><annotation>tex</annotation></semantics></math> z", "x y=2 z"),
    ("a<svg><title>no</title><defs><text>no</text></defs><desc/><path d='' /><text>b</text>no<text>c</text></svg>d", "a b c d"),
    ("a<select><option>b<option>c</select>d<textarea>\ne  &lt;\n f</textarea>g", "a\nb\nc\nd\ne  <\n f\ng"),
])
def test_html_shows_what_browsers_show(source, text):
    assert html_text.html_to_text(source) == text


def _random_block(rng, depth=0):
    """Well-formed markup and the lines it stands for: (blank lines asked for around it, markup, lines)."""
    words = lambda: " ".join(rng.choice(["a", "bc", "déf", "x&y", "<q>"]) for _ in range(rng.randint(1, 5)))
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    kind = rng.choice(["p", "div", "h2", "pre", "table", "ul", "ol", "blockquote", "hidden", "hr"] if depth < 3 else ["p", "div"])
    if kind in ("p", "div", "h2"):
        t, u = words(), words()
        return (0 if kind == "div" else 1), f"<{kind}>\n {escape(t)}<br/><b> {escape(u)}</b> </{kind}>", [t, u]
    if kind == "pre":
        lines = ["  " * rng.randint(0, 2) + words() for _ in range(rng.randint(1, 3))]
        return 1, "<pre>" + escape("\n".join(lines)) + "</pre>", lines
    if kind == "hidden":
        return 0, f"<div hidden>{words().replace('<', '')}</div><script>'<p>'</script>", []
    if kind == "hr":
        return 0, "<hr>", ["---"]
    if kind == "table":
        cells = [[words() for _ in range(3)] for _ in range(rng.randint(1, 3))]
        wide = [max(len(r[k]) for r in cells) for k in range(3)]
        end = rng.choice(["", "</td>"])
        markup = "".join("<tr>" + "".join(f"<td>{escape(c)}{end}" for c in r) for r in cells)
        return 1, f"<table>{markup}</table>", ["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in cells]
    if kind == "blockquote":
        _, markup, lines = _random_blocks(rng, depth + 1)
        return 1, f"<blockquote>{markup}</blockquote>", ["    " + t if t else "" for t in lines]
    markup, lines = "", []
    for k in range(rng.randint(1, 3)):
        t = words()
        mark = "- " if kind == "ul" else f"{k + 1}. "
        markup += f"<li>{escape(t)}" + rng.choice(["", "</li>"])
        lines.append(mark + t)
    return 1, f"<{kind}>{markup}</{kind}>", lines


def _random_blocks(rng, depth=0):
    gap, markup, lines, seen = 0, "", [], False
    for _ in range(rng.randint(1, 4)):
        g, m, own = _random_block(rng, depth)
        markup += m
        if own:
            lines += [""] * (max(gap, g) if seen else 0) + own
            gap, seen = g, True
    return gap, markup, lines


def test_html_against_random_layouts():
    rng = random.Random(8)
    for _ in range(600):
        _, markup, lines = _random_blocks(rng)
        assert html_text.html_to_text(markup) == "\n".join(lines), markup


@pytest.mark.parametrize("page", [
    "<table><tr><td>" + "w" * 1000 + "".join(f"<tr><td><td>{i}" for i in range(4000)) + "</table>",
    "<table><tr>" + "".join(f"<td>{'w' * 40}" for _ in range(200)) + "<td>" + "x<br>" * 8000 + "</table>",
    "<table><tr>" + "<td colspan=1000>x" * 3000 + "<tr>" + "<td>y" * 3000 + "</table>",
    "<ul><li>x" * 5000, "<blockquote>x" * 4000, "<table><tr><td>" + "v" * 300 + "<td>" + "<table><tr><td>" * 300 + "z<br>" * 3000,
])
def test_html_output_is_linear(page):
    out = html_text.html_to_text(page)
    assert len(out) <= 40 * len(page)
    shown = html_text.html_to_text(page.replace("<td", " <p").replace("<li", " <p").replace("<blockquote", " <p"))
    assert out.replace("-", "").split() == shown.replace("-", "").split()


def test_html_trees_in_linear_time():
    import time

    began = time.process_time()
    for page in ("<b><table><tr><td>" + "<div>" * 40_000 + "</b>" * 40_000 + "x", "<ul><li>" + "<i>" * 40_000 + "<dd>x</dd>" * 10_000, "<p><table><td>" + "<span>" * 40_000 + "<div></div>" * 10_000):
        html_text.html_to_text(page)
    assert time.process_time() - began < 20


def test_html_numbers_without_end():
    nines = "9" * 5000
    assert html_text.html_to_text(f"a&#{nines};b&#0000000065;<ol start={nines}><li>c</ol><table><td colspan={nines}>d</table>") == "a\ufffdbA\n\n1. c\n\nd"


def test_html_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>a", "t", "h", 5, 6)], "page_id long, page string, text string, html string, id int, carry_0 int")
    got = html_text.extract(df, html="page", carry=("text", "html", "id", "carry_0")).first()
    assert got.asDict() == {"html": "h", "id": 5, "carry_0": 6, "page_id": 1, "text": "a"}


def test_html_table(spark):
    df = clash(spark.createDataFrame([(1, "<p>a"), (2, None), (2, ""), (3, "<div>" * 5000 + "deep"), (4, "<b <i " * 3000)], "page_id long, html string"))
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "a"), (2, ""), (2, ""), (3, "deep"), (4, "")]
    assert html_text.extract(df.limit(0)).count() == 0


# 5
def toxic_rows(n=300):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "elo", "iru", "oma")]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) + (" IDIOT " + rng.choice(words) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(n)]


def test_toxic_spans(spark):
    rows = toxic_rows()
    docs = clash(spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "... !!"), (1, rows[1][1]), (903, "bana " * 30000 + "idiot")], "doc_id long, text string"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 5
    score = {r["doc_id"]: r for r in got}
    assert all((score[i]["score"] >= 0.3) == bool(y) for i, _, y in rows)
    assert all(rows[i][1][s["start"]: s["end"]].lower() == "idiot" for i, _, y in rows if y for s in score[i]["spans"])
    assert all(score[i]["score"] == 0 and score[i]["spans"] == [] for i in (900, 901, 902)) and score[903]["score"] >= 0.3 and score[903]["spans"][0]["start"] == 150000
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())


def test_forward_backward_against_enumeration(monkeypatch):
    import itertools

    rng = np.random.default_rng(0)
    model = toxicity.Crf({}, 0.0, rng.normal(size=(2, 2)))
    for n in (1, 2, 5, 8):
        e = rng.normal(size=n) * 2
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(np.dot(e, y) + sum(model.transitions[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        assert np.allclose(model.marginals([e, np.zeros(0), e[:1]])[0], ones / total)
    long = rng.normal(size=10_000) * 5
    for transitions in (model.transitions, np.array([[9.0, -9.0], [-9.0, 9.0]]), np.array([[-9.0, 9.0], [9.0, -9.0]])):  # the last two hardly forget
        model.transitions = transitions
        monkeypatch.setattr(toxicity, "WINDOW", 20_000)
        exact = model.marginals([long])[0]
        monkeypatch.setattr(toxicity, "WINDOW", 97)
        assert all(np.abs(p - exact[: len(p)]).max() < 1e-9 for p in model.marginals([long, long]))


def test_toxic_clashing_columns(spark):
    model = toxicity.Crf({"=bad": 12.0}, -6.0)
    df = spark.createDataFrame([(1, "so bad", 7, 8, 9, 0), (2, "fine", 7, 8, 9, 0)], "doc_id long, text string, score int, spans int, _id int, carry_0 int")
    got = toxicity.score(df, model, carry=("score", "spans", "_id", "carry_0", "text"))
    assert got.columns == ["_id", "carry_0", "text", "doc_id", "score", "spans"]
    assert {(r["doc_id"], r["score"] > 0.9, len(r["spans"]), r["_id"], r["text"]) for r in got.collect()} == {(1, True, 1, 9, "so bad"), (2, False, 0, 9, "fine")}


# 6
def test_pairs_over_parts_and_partitions(spark, monkeypatch):
    """One region, worked off in many parts over many partitions; nothing is lost between them."""
    monkeypatch.setattr(near_dedup, "PART", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        template = " ".join(f"b{i}" for i in range(400))
        rows = [(2 * p + s, template + "".join(f" p{p}_{i}" for i in range(52)) + "".join(f" u{p}_{s}_{i}" for i in range(34))) for p in range(400) for s in range(2)]
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, d - d % 2) for d in range(800)}


def test_near_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a\tB"), (6, "a b c"), (7, "A B C"), (8, long), (9, long + " more"), (9, "other words here now"), (None, "a b c"), (10, "b a"), (11, "É b c"), (12, "é b c")]
    got = [tuple(r) for r in near_dedup.near_duplicates(clash(spark.createDataFrame(rows, "doc_id long, text string")), 3, 85).collect()]
    assert len(got) == len(rows)
    assert {r for r in got if r[0] in (1, 2, 3)} == {(i, 0, i, True) for i in (1, 2, 3)} and {r for r in got if r[0] in (4, 5)} == {(4, 1, 4, True), (5, 1, 4, False)}
    assert {r for r in got if r[0] in (6, 7)} == {(6, 1, 6, True), (7, 1, 6, False)} and (8, 29998, 8, True) in got and (9, 29999, 8, False) in got and (10, 1, 10, True) in got and (None, 1, None, True) in got
    assert (12, 1, 12, True) in got and near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7
def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(5)
    noise = "".join(chr(rng.randint(32, 0x2FF)) for _ in range(50_000))
    rows = [(1, "http://a/\r\nx: y", "<p>é"), (2, None, None), (3, "u", ""), (4, "u", "<p>é"), (5, "u", noise), (6, "u", noise + "\r\n\r\nWARC/1.1\r\n\r\n"), (4, "u", "<p>é"), (None, "u", "<p>é"), (None, None, "alone")]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path)
    for size in (1 << 20, 700, 97):
        got = warc.read_archives(spark, path, range_bytes=size).collect()
        seen = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got))
        want = [(i or 0, "revisit" if (i, h) in ((1, "<p>é"), (2, None), (None, "<p>é")) else "response", {1: 4, 2: 3}.get(i, 4 if h == "<p>é" and i is None else 0), len((h or "").encode()), warc.digest32((h or "").encode())) for i, _, h in rows]
        assert seen == sorted(want)
        assert {r["payload"].decode() for r in got if r["payload"] is not None} == {"<p>é", "", noise, noise + "\r\n\r\nWARC/1.1\r\n\r\n", "alone"}
    for f in tmp_path.glob("w/part-*"):
        assert gzip.GzipFile(fileobj=io.BytesIO(f.read_bytes())).read().startswith(b"WARC/1.1")
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_false_magic():
    member = warc.record(1, "u", b"x" * 1000, False, None, "d")
    other = gzip.compress(b"no record")
    data = warc.MAGIC + b"\x00" * 20 + other + member[:40] + member + b"\0"

    class File:
        def read_at(self, n, at):
            return data[at: at + n]

    assert [r["page_id"] for r in warc.records_in(File(), 0, len(data), len(data))] == [1]


# 8
def test_exact_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a "), (5, "a"), (5, "a"), (None, "a"), (6, "x" * 1_000_000), (7, "x" * 1_000_000), (8, "A"), (None, "n"), (9, "é"), (10, "e\u0301")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df, "max").collect()))
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 5, 4, False), (5, 5, 4, True), (5, 5, 4, False), (0, 5, 4, False), (4, 4, 1, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (0, 0, 1, True), (9, 9, 1, True), (10, 10, 1, True)])
    assert {r["keep_id"] for r in exact_dedup.exact_duplicates(df, "min").where("text_sha256 = sha2('a', 256)").collect()} == {3}
    assert exact_dedup.exact_duplicates(df, normalise=F.lower).where("doc_id = 8").first()["group_size"] == 5 and exact_dedup.exact_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_compares_texts_where_digests_collide(spark, keep):
    """A digest of three values, over more partitions than texts: runs of one text lie in many of them."""
    rng = random.Random(2)
    rows = [(i if i % 11 else None, rng.choice(["same lead, text " + "x" * n for n in range(5)] + ["b", "", f"own {i}"])) for i in range(900)]
    rows += rows[:20]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        got = exact_dedup.exact_duplicates(df, keep, digest=lambda c: (F.length(c) % 3).cast("string")).collect()
        carried = exact_dedup.exact_duplicates(df.withColumn("text", F.expr("if(text = '' AND doc_id % 2 = 0, null, text)")), keep, digest=lambda c: (F.length(c) % 3).cast("string"), carry=("text", "n", "kept"))
        assert carried.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "text", "n"]
        assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in carried.collect())) == sorted((i or 0, t) for i, t in rows)
        assert {r["text"] for r in carried.where("doc_id % 2 = 0").collect()} >= {None} and "" not in {r["text"] for r in carried.where("doc_id % 2 = 0").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    pick = min if keep == "min" else max
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((i or 0, best[t] or 0, len(groups[t])) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in got) == want
    assert sorted(r["doc_id"] or 0 for r in got if r["kept"]) == sorted(b or 0 for b in best.values())


# 9
TEXTS = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [ROLE] x [SEP] y [/ROLE]", "", " ", "\n", "[INST", "a [/INST", "<", "[OUT] ", "$1 \\ $", "é\u0301 😀", "x" * 200_000]


def test_chat_round_trips(spark):
    roles = ["user", "assistant", "system", None, "to]ol [SEP] ", ""]
    rows = [(c, t, random.Random(c * 31 + t).choice(roles), random.Random(c * 17 + t).choice([*TEXTS, None])) for c in range(60) for t in range(c % 5 + 1)]
    rows += [(100, 1, "user", "b"), (100, 1, "assistant", "a"), (100, None, "user", "first"), (None, 0, "user", "x"), (100, 1, "user", "b")]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.format_chats(clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(60):
        assert got[c] == [(r or "", t or "") for k, _, r, t in rows if k == c]
    assert got[100] == [("user", "first"), ("assistant", "a"), ("user", "b"), ("user", "b")] and got[None] == [("user", "x")]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 10
def test_scratch_deletes_what_is_written_inside(spark):
    import os

    from trellis.llm import common

    with common.scratch(spark):
        inside, kept = common.materialize(spark.range(3), "t"), common.materialize(spark.range(3), "t", keep=True)
        paths = [inside._written.removeprefix("file:"), kept._written.removeprefix("file:")]
        assert all(map(os.path.exists, paths))
    assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 3
    common.discard(kept, None, spark.range(1))
    assert not os.path.exists(paths[1])
    with common.scratch(spark):
        with common.scratch(spark):
            outer = common.materialize(spark.range(3), "t", keep=True)
        assert outer.count() == 3
    assert not os.path.exists(outer._written.removeprefix("file:"))


def test_best_fit_and_bounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(1, 21, rng.integers(1, 12))
        bins = packing.best_fit_decreasing(sizes, 20)
        assert np.bincount(bins, weights=sizes).max() <= 20
        assert packing.lower_bound(sizes, 20) <= _optimum(sorted(sizes.tolist(), reverse=True), 20) <= bins.max() + 1
    assert packing.lower_bound(np.array([11] * 7), 20) == 7 and packing.lower_bound(np.array([7] * 5), 20) == 3 and packing.lower_bound(np.array([], int), 20) == 0


def _optimum(sizes, capacity):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            k = bins.index(room)
            place(i + 1, [*bins[:k], room - sizes[i], *bins[k + 1:]])
        place(i + 1, [*bins, capacity - sizes[i]])
    place(0, [])
    return best[0]


def test_partitions_exchange(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 7), i, 0, int(n)) for i, n in enumerate(rng.integers(1, 100, 3000))]
    pieces = spark.createDataFrame(rows, "doc_id long, row long, piece int, length long")
    got = packing.pack(pieces, 100, partition=150).collect()
    assert sorted((r["row"], r["length"]) for r in got) == [(r[1], r[3]) for r in rows]
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 100 and len(fill) <= 1.04 * packing.lower_bound(np.array([r[3] for r in rows]), 100)
    assert packing.pack(pieces.limit(0)).count() == 0


def test_packing_rounds_are_few(spark, monkeypatch):
    """Sizes that never meet their bound: rounds go with the logarithm of the partitions."""
    written = []
    keep = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: written.append(name) or keep(df, name))
    lengths = np.random.default_rng(1).integers(1000, 2001, 14_200)
    pieces = spark.createDataFrame([(i // 3 if i % 5 else None, i, 0, int(n), "x", 1, 2, 3) for i, n in enumerate(lengths)],
                                   "doc_id long, row long, piece int, length long, `group` string, bin int, Open int, sequence_id int")
    got = packing.pack(pieces, 4096, partition=200).select("row", "length", "sequence_id", "offset", "group", "bin").collect()
    assert sorted((r["row"], r["length"]) for r in got) == list(enumerate(lengths.tolist())) and len(written) <= 7 and {(r["group"], r["bin"]) for r in got} == {("x", 1)}
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= 1.005 * (packing.best_fit_decreasing(lengths, 4096).max() + 1)


def test_token_memory_equals_library(spark):
    import public_tokenizers

    own = tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    alphabet = [chr(i) for i in (*range(9, 14), *range(0x20, 0x7F), *range(0xA0, 0x250), 0x301, 0x3A9, 0x4E2D, 0x1F600, 0x2028)]
    texts = ["", " ", "don't we'll 'S it''s", "<|endoftext|> x", "İ ſ ß Å é é", "a_b__c 1²½ ª"] + ["".join(rng.choice(alphabet[:110] if i % 2 else alphabet) for _ in range(rng.randint(1, 60))) for i in range(2000)]
    for t in texts:
        assert own.ids(t).tolist() == own.library.encode(t, add_special_tokens=False).ids
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word")]
    got = packing.tokenize(clash(spark.createDataFrame(rows, "doc_id long, text string")), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == [(1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 2), (3, 0, 0, 4096), (3, 1, 4096, 4096), (3, 2, 8192, 809)]
