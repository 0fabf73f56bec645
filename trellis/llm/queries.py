"""The registered queries of this package: (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dedup, html_text, mixing, near_dedup, packing, toxicity, url_reputation, warc
from .common import materialize, shared_dir, table


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


#: The conversation that the contract adds.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digest(chat.format_chats(turns))


def op3_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.SPAN).cast("int").alias("predicted"), "spans")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(packing.tokenize(table(spark, sf_dir, "documents"), vocabulary()), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_url_reputation, op2_source_mixing, op3_collision_ann, op4_html_text, op5_toxicity,
    op6_minhash_near_dedup, op7_warc, op8_exact_dedup, op9_chat_format, op10_best_fit_packing)}

_OP1 = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, suf, pre, said) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
r AS (
  SELECT p.*, (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = suf OR ends_with(host, '.' || suf)) AND starts_with(path, pre)) AS rule FROM p),
j AS (SELECT r.page_id, r.host, r.path, r.rule, rules.said FROM r LEFT JOIN rules ON r.rule = rules.rule),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
         count(said)::DOUBLE AS n, count(*) FILTER (WHERE said = 'block')::DOUBLE AS bad FROM j GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s AS (
  SELECT lvl, count(*) AS m, sum(n) AS t, sum(bad) AS b, sum(n * n) AS nn, sum(bad * bad / n) AS sp
  FROM (SELECT 'h' AS lvl, n, bad FROM hosts UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes) WHERE n > 0 GROUP BY lvl),
q AS (SELECT *, b / t AS p, (b / t) * (1 - b / t) AS noise, t - nn / t - (m - 1) AS room FROM s),
k AS (
  SELECT lvl, (b + 0.5::DOUBLE) / (t + 1) AS m0,
         CASE WHEN m < 2 OR noise <= 0 OR room <= 0 THEN 1.0::DOUBLE ELSE
           (1 - least(greatest((sp - t * p * p - noise * (m - 1)) / (noise * room), 1e-4::DOUBLE), 0.9::DOUBLE)) / least(greatest((sp - t * p * p - noise * (m - 1)) / (noise * room), 1e-4::DOUBLE), 0.9::DOUBLE) END AS k FROM q),
c AS (SELECT coalesce(max(m0) FILTER (WHERE lvl = 's'), 0.5) AS m0, coalesce(max(k) FILTER (WHERE lvl = 's'), 1) AS ks, coalesce(max(k) FILTER (WHERE lvl = 'd'), 1) AS kd, coalesce(max(k) FILTER (WHERE lvl = 'h'), 1) AS kh FROM k),
ps AS (SELECT suffix, (bad + ks * m0) / (n + ks) AS ms FROM suffixes, c),
pd AS (SELECT domain, (bad + kd * ms) / (n + kd) AS md FROM domains JOIN ps USING (suffix), c),
ph AS (SELECT host, (bad + kh * md) / (n + kh) AS mean, n + kh AS ab FROM hosts JOIN pd USING (domain), c)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN mean - 1.64::DOUBLE * sqrt(mean * (1 - mean) / (ab + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN ph ON j.host = ph.host
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
o AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS ord FROM d GROUP BY source),
w AS (SELECT *, (ord - 1) % 3 + 1 AS weight FROM o),
l AS (SELECT *, row_number() OVER q AS pos,
        ((SELECT sum(source_size) FROM w)::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
      FROM w WINDOW q AS (ORDER BY source_size::DOUBLE / weight, ord)),
t AS (SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, (SELECT min_by(level, pos) FROM l WHERE level * weight <= 3.0::DOUBLE * source_size) * weight), 3.0::DOUBLE * source_size) AS target FROM l),
u AS (SELECT d.doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, size, (source_size * e + upto)::DOUBLE / target AS finish FROM u, range(3) r(e) WHERE size > 0),
f AS (SELECT *, sum(size) OVER (ORDER BY finish, doc_id ROWS UNBOUNDED PRECEDING) AS served FROM p),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM f WHERE served <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT u.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM u LEFT JOIN k USING (doc_id)
"""

#: The layout of pages without tables, preformatted text and nested lists, as the given ones are.
_OP4 = r"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?(-->|$)|<(head|script|style)\b.*?(</(head|script|style)>|$)|<![^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '[ \t\n\r\f]+', ' ', 'g'), '<[a-zA-Z/!?][^>]*$', '') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '</?(p|h1|ul|article)\b[^>]*>', chr(2), 'gi'), '<li\b[^>]*>', chr(1) || '- ', 'gi'), '</?(li|div|nav|footer|body|html|br)\b[^>]*>', chr(1), 'gi') AS h FROM b),
d AS (SELECT page_id, regexp_replace(h, '<[a-zA-Z/][^>]*>', '', 'g') AS h FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(h, '[ \x01]*\x02[ \x01\x02]*', chr(10) || chr(10), 'g'), ' *\x01[ \x01]*', chr(10), 'g') AS h FROM d)
SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(trim(h, ' ' || chr(10)), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS text FROM e
"""

#: A query of quadratic cost, for small tables: all pairs of documents that share a shingle.
_OP6 = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT DISTINCT h, x FROM p),
b AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i) AS b32
      FROM d, range(32) r(i) GROUP BY h),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN b ON p.h = b.h JOIN m ON p.h = m.h
"""

_OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|OUT\]|SEP\])', '\1\\\2\3', 'g') AS x,
        regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|OUT\]|SEP\])', '\1\\\2\3', 'g') AS y FROM c),
g AS (SELECT conv_id, bool_or(x <> text OR (y <> role)) AS esc FROM e GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 10 ELSE 22 + length(CASE WHEN esc THEN y ELSE role END) END + length(CASE WHEN esc THEN x ELSE text END))::BIGINT AS formatted_chars
FROM e JOIN g USING (conv_id) GROUP BY conv_id
"""

SQL = {"op1_url_reputation": _OP1, "op2_source_mixing": _OP2, "op4_html_text": _OP4, "op6_minhash_near_dedup": _OP6, "op7_warc": _OP7, "op8_exact_dedup": _OP8, "op9_chat_format": _OP9}
