"""The registered queries against DuckDB, or against brute force where SQL cannot express them."""
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from trellis.llm import near_dedup, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall())))


def test_nearest_recall(spark, con):
    got = collections.defaultdict(list)
    for r in queries.op3_collision_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    rows = con.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [int(ids[i]) for i in np.lexsort([ids, d]) if ids[i] != q][:10]
        mine = got[q]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        hits += len(set(best) & {r["vec_id"] for r in mine})
    assert hits >= 0.9 * 10 * len(got)


def test_html_text_against_plain_layout(spark, con):
    """The pages hold no tables: blocks, lists and breaks can be laid out from a parser's events alone."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.lines, self.line, self.gap, self.hidden, self.mark, self.inside = [], "", 0, 0, "", False
            self.feed(page)
            self.close()
            self.edge(0)

        def edge(self, blank):
            if self.line.strip():
                self.lines += [""] * (self.gap if self.lines else 0) + [self.mark + " ".join(self.line.split())]
                self.gap, self.mark = 0, "  " if self.mark else ""
            self.line, self.gap = "", max(self.gap, blank)

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("head", "script", "style", "title")
            if tag in ("p", "h1", "ul"):
                self.edge(1)
            elif tag in ("li", "div", "nav", "article", "footer", "body", "br"):
                self.edge(1 if self.inside and tag != "br" else 0)
            self.inside = tag == "p" or (self.inside and tag in ("a", "b", "br"))
            if tag == "li":
                self.mark = "- "

        def handle_endtag(self, tag):
            self.hidden -= tag in ("head", "script", "style", "title")
            if tag in ("p", "h1", "ul"):
                self.edge(1)
            elif tag in ("li", "div", "nav", "article", "footer", "body"):
                self.edge(1 if self.inside else 0)  # it ends an open paragraph
            self.inside = self.inside and tag in ("a", "b")
            if tag == "li":
                self.mark = ""

        def handle_data(self, data):
            if not self.hidden:
                self.line += data

    got = {r["page_id"]: r["text"] for r in queries.op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    pages = con.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for i, page in pages:
        assert got[i] == "\n".join(Plain(page or "").lines), i


def test_toxicity_held_out(spark, con):
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert all(0 <= r["score"] <= 1 and bool(r["spans"]) == (r["predicted"] == 1) and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    told = con.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall()
    held = [(got[d]["predicted"], y) for d, y in told if got[d]["held_out"]]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    false = sum(p for p, y in held if not y) / sum(1 - y for _, y in held)
    assert caught >= 0.85 and false <= 0.02


def test_packing_is_whole_and_tight(spark, con):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op10_best_fit_packing(spark, SF).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    for doc, text in con.sql("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 4096)
        for r in parts:
            own = ids[r["start"]: r["start"] + r["length"]]
            assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(by_bin) == packing.lower_bound(np.array([r["length"] for r in rows]), 4096)


def test_pipeline_against_brute_force(spark, con):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = p.remove_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    # copies: the smallest id of each text
    once = {r["doc_id"]: r["text"] for r in p.remove_copies(spark, docs, SF).collect()}
    first: dict[str, int] = {}
    for d in sorted(seen):
        first.setdefault(seen[d] or "", d)
    assert set(once) == set(first.values()) and set(texts) <= set(seen)
    # near copies by all pairs
    few = p.remove_near_copies(spark, docs, SF)
    assert {r["doc_id"] for r in few.collect()} == _kept_by_brute_force(seen, 5, 80)
    mixed = p.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and max(collections.Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    total = collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    packed = p.pack_sequences(spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == total


def _components_by_brute_force(texts, k, percent):
    import re

    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in sets}


def _kept_by_brute_force(texts, k, percent):
    return {d for d, c in _components_by_brute_force(texts, k, percent).items() if c == d}


def test_near_family_is_one_component(spark):
    """A star: variants that differ from each other more than from their base, over several leaves."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    texts = {0: base}
    for d in range(1, 400):
        own = list(base)
        for i in rng.choice(300, 5, replace=False):
            own[i] = f"x{d}_{i}"
        texts[d] = own
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 3, 85).collect()
    want = _kept_by_brute_force({d: " ".join(w) for d, w in texts.items()}, 3, 85)
    assert {r["doc_id"] for r in got if r["kept"]} == want


def test_pairs_under_a_shared_template(spark):
    """Most words are everybody's: one huge region, with pairs inside that leaves and hubs part."""
    template, texts = [f"t{i}" for i in range(258)], {}
    for pair in range(350):
        for side in range(2):
            texts[2 * pair + side] = " ".join(template + [f"o{pair}_{i}" for i in range(20)] + [f"x{pair}_{side}_{i}" for i in range(22)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 1, 85).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == _kept_by_brute_force(texts, 1, 85)


def test_pipeline_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    one, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(59))
    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    # 1: repeated rows; 2: its first text is a copy of 1's, its second is not; null: alone, a copy and a near copy
    texts = [(1, one), (1, one), (2, one), (2, words("b")), (None, words("c")), (None, one), (None, near), (3, words("d")), (3, words("e"))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    rows = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))
    exact = p.remove_copies(spark, docs, "")
    left = [(0, words("c")), (1, one), (2, words("b")), (3, words("d")), (3, words("e"))]
    assert rows(exact) == sorted([*left, (0, near)])
    assert rows(p.remove_near_copies(spark, exact, "")) == left
    # one source: each row is taken once, repeated rows too
    assert rows(p.mix_sources(spark, docs, "")) == sorted((i or 0, t) for i, t in texts)


def _messy(spark, n=240):
    """Documents with null and repeated ids, repeated rows, null, empty and long texts, and columns that clash."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "elo", "iru", "oma")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(12, 40))) for _ in range(n)]
    texts = [t + " IDIOT " + rng.choice(words) if i % 5 == 0 else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", rng.choice(["web", "books", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(i + n, t + " more", "en", "web", 0) for i, t in enumerate(texts[1:40:3])]  # near copies
    rows += [(7 if i % 2 else None, t, None, "books", None) for i, t in enumerate(texts[2:30:4])]  # copies under other ids
    rows += rows[3:9] + [(None, None, None, None, None), (5001, None, "", "", 0), (5002, "", "en", "web", 0), (5003, " \t", "en", "web", 0), (5004, "bana elo " * 40_000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = [(i, int(i % 5 == 0)) for i in range(n)] + [(None, 1), (3, None)]
    extra = {k: F.lit(1) for k in ("row", "sha", "run", "id", "size", "score", "spans", "keep_id", "group", "bin", "open", "offset", "taken", "rep", "carry_0", "pass")}
    return rows, docs.withColumns(extra), labels


def test_pipeline_stages_on_messy_documents(spark, tmp_path):
    import corpus_pipeline as p

    rows, docs, labels = _messy(spark)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, columns = str(tmp_path), ["doc_id", "text", "lang", "source", "n_chars"]
    plain = lambda df: sorted(map(repr, map(tuple, df.collect())))
    kept = p.remove_toxic(spark, docs, folder)
    assert kept.columns == columns and plain(kept) == sorted(repr(r) for r in rows if "IDIOT" not in (r[1] or ""))
    once = p.remove_copies(spark, docs, folder)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r)
    got = once.collect()
    assert once.columns == columns and len(got) == len(groups)
    for r in got:
        own = groups[r["text"] or ""]
        assert tuple(r) in own and r["doc_id"] == min((x[0] for x in own if x[0] is not None), default=None)
    few = p.remove_near_copies(spark, docs, folder).collect()
    numbered = dict(enumerate(r[1] for r in rows))
    component = _components_by_brute_force(numbered, 5, 80)
    members = collections.defaultdict(list)
    for k, c in component.items():
        members[c].append(rows[k])
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in few) == sorted(min((x[0] for x in m if x[0] is not None), default=-1) for m in members.values())
    assert all(tuple(r) in rows for r in few)
    mixed = p.mix_sources(spark, docs, folder)
    times, had = collections.Counter(map(tuple, mixed.collect())), collections.Counter(rows)
    assert mixed.columns == columns and set(times) <= set(rows) and all(times[r] <= 3 * had[r] for r in times)
    assert all(times[r] == had[r] for r in rows if not (r[1] or "").split())
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    taken = collections.Counter()
    for r, n in times.items():
        taken[r[3]] += n * len((r[1] or "").split())
    assert sum(taken.values()) <= sum(sizes.values())
    packed = p.pack_sequences(spark, docs, folder).collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(r[0] for r in rows)
    fill = collections.Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    _, docs, _ = _messy(spark, 3)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in p.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count() == 0
    assert p.run(spark, str(tmp_path)).count() == 0


def test_sha_of_texts(spark, con):
    rows = queries.op8_exact_dedup(spark, SF).collect()
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    assert all(r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in rows)
