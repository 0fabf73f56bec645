"""The registered queries of the engine, one or more for each operator, with equal DuckDB SQL.

A query is a request in the engine's language (or a function of the session, for writes and other front
ends). Nested values are compared as JSON texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError
from .plans.session import Session
from .plans.wellknown import WellKnown
from .sources import cbor, querystring
from .sources.tables import catalog
from .streaming.rows import cbor_chunks, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.VariantType, T.MapType)
    return df.select(*(F.to_json(F.col(f"`{f.name}`"), {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))


def session(spark: SparkSession, sf_dir: str, wellknown: WellKnown | None = None) -> Session:
    return Session(spark, catalog(sf_dir), wellknown)


def add(name: str, request: Any, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(session(spark, sf_dir).frame(request))
    SQL[name] = sql


def add_function(name: str, build: Callable[[Session], DataFrame], sql: str, wellknown: WellKnown | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(build(session(spark, sf_dir, wellknown)))
    SQL[name] = sql


def dot(*names: str) -> list:
    return [".", *names]


# scans and projections
add("s1_scan_star", {"relation": "nation", "schema": "main"}, "SELECT * FROM nation")
add("s3_function_root", {"function": "orders_of", "arguments": [7]}, "SELECT * FROM orders WHERE o_custkey = 7")
add("s3_function_named_default", {"function": "orders_of", "arguments": {"custkey": 7, "least": 100000}, "select": {"k": dot("o_orderkey")}}, "SELECT o_orderkey AS k FROM orders WHERE o_custkey = 7 AND o_totalprice >= 100000")
add("s4_record_function", {"function": "order_counts", "arguments": ["F"], "where": [">", dot("n"), 3]}, "SELECT o_custkey AS custkey, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 3")
add("s5_scalar_function_root", {"function": "with_tax", "arguments": [10, 0.5]}, "SELECT 15.0::DOUBLE AS value")
add("s6_function_embed", {
    "relation": "customer", "join": {"o": {"function": "orders_of", "arguments": [dot("c_custkey"), 200000], "select": {"k": dot("o_orderkey")}, "limit": 3, "order_by": [dot("o_orderkey")]}},
    "select": {"c": dot("c_custkey"), "o": dot("o")}},
    "SELECT c_custkey AS c, coalesce((SELECT to_json(list(struct_pack(k := o_orderkey) ORDER BY o_orderkey)) FROM (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 200000 ORDER BY 1 LIMIT 3))::VARCHAR, '[]') AS o FROM customer")
add("p1_star_with_embeds", {"relation": "nation", "join": {"region": {"relation": "region", "on": {"r_regionkey": "n_regionkey"}}, "suppliers": {"relation": "supplier", "on": {"s_nationkey": "n_nationkey"}, "select": {"k": dot("s_suppkey")}}}},
    "SELECT n.*, to_json(struct_pack(r_regionkey := r.r_regionkey, r_name := r.r_name))::VARCHAR AS region, coalesce((SELECT to_json(list(struct_pack(k := s_suppkey) ORDER BY s_suppkey)) FROM supplier WHERE s_nationkey = n_nationkey)::VARCHAR, '[]') AS suppliers FROM nation n LEFT JOIN region r ON r_regionkey = n_regionkey")
add("p3_star_except_and_map", {"relation": "part", "select": ["*~", ["p_name", "p_type"], {"double_size": ["*", dot("p_size"), 2]}], "where": ["<", dot("p_size"), 10]},
    "SELECT p_partkey, p_brand, p_size, p_retailprice, p_size * 2 AS double_size FROM part WHERE p_size < 10")
add("p5_nested_object", {"relation": "customer", "select": {"id": dot("c_custkey"), "who": {"name": dot("c_name"), "seg": dot("c_mktsegment")}}},
    "SELECT c_custkey AS id, to_json(struct_pack(name := c_name, seg := c_mktsegment))::VARCHAR AS who FROM customer")
add("p7_scalar_select", {"relation": "region", "select": ["col", "r_name"]}, "SELECT r_name AS value FROM region")
add("p8_col_default", {"relation": "documents", "join": {"l": {"relation": "labels", "on": {"doc_id": "doc_id"}}}, "select": {"id": ["col", "doc_id", 0], "q": ["coalesce", dot("l", "quality"), -1], "set": ["::", ["set", "lang"], "text"]}},
    "SELECT d.doc_id AS id, coalesce(quality, -1) AS q, NULL::VARCHAR AS set FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
add("p12_scalar_hops", {"relation": "lineitem", "join": {"o": {"relation": "orders", "on": {"o_orderkey": "l_orderkey"}, "join": {"c": {"relation": "customer", "on": {"c_custkey": "o_custkey"}, "join": {"n": {"relation": "nation", "on": {"n_nationkey": "c_nationkey"}}}}}}},
    "where": ["=", dot("o", "c", "n", "n_name"), "NATION_3"], "select": {"k": dot("l_orderkey"), "line": dot("l_linenumber"), "qty": dot("l_quantity"), "who": dot("o", "c", "c_name")}},
    "SELECT l_orderkey AS k, l_linenumber AS line, l_quantity AS qty, c_name AS who FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3'")
add("p13_whole_row_value", {"relation": "documents", "join": {"l": {"relation": "labels", "on": {"doc_id": "doc_id"}}}, "where": ["is_not_null", dot("l")], "select": {"id": dot("doc_id"), "l": dot("l")}},
    "SELECT d.doc_id AS id, to_json(struct_pack(doc_id := l.doc_id, quality := quality, toxic := toxic))::VARCHAR AS l FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
add("p14_self_alias", {"relation": "region", "alias": "me", "select": {"row": dot("me"), "n": dot("me", "r_name")}}, "SELECT to_json(struct_pack(r_regionkey := r_regionkey, r_name := r_name))::VARCHAR AS row, r_name AS n FROM region")
add("p15_computed_fields", {"relation": "customer", "select": {"label": dot("c_label"), "n": ["agg", "count", [dot("c_orders", "o_orderkey")]]}},
    "SELECT c_name || ' (' || c_mktsegment || ')' AS label, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS n FROM customer")

# predicates
add("f1_where_and_or_not", {"relation": "orders", "where": ["and", [">=", dot("o_totalprice"), 200000], ["or", ["=", dot("o_orderstatus"), "F"], ["not", ["=", dot("o_orderpriority"), "1-URGENT"]]]], "select": {"k": dot("o_orderkey")}},
    "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 200000 AND (o_orderstatus = 'F' OR NOT o_orderpriority = '1-URGENT')")
add("f2_child_where", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "where": [">", dot("o_totalprice"), 300000], "select": ["col", "o_orderkey"]}}, "select": {"c": dot("c_custkey"), "o": dot("o")}},
    "SELECT c_custkey AS c, coalesce((SELECT to_json(list(o_orderkey ORDER BY o_orderkey)) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)::VARCHAR, '[]') AS o FROM customer")
add("f5_chained_comparison", {"relation": "part", "where": ["<", 5, dot("p_size"), 20], "select": {"k": dot("p_partkey")}}, "SELECT p_partkey AS k FROM part WHERE 5 < p_size AND p_size < 20")
add("f6_distinct_from", {"relation": "documents", "join": {"l": {"relation": "labels", "on": {"doc_id": "doc_id"}}}, "where": ["!==", dot("l", "toxic"), 1], "select": {"id": dot("doc_id")}},
    "SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE toxic IS DISTINCT FROM 1")
add("f7_between", {"relation": "part", "where": ["and", ["between", 10, dot("p_size"), 20], ["not_between", 1000, dot("p_retailprice"), 1500]], "select": {"k": dot("p_partkey")}},
    "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1500")
add("f8_in", {"relation": "orders", "where": ["and", ["in", dot("o_orderstatus"), "F", "P"], ["not_in", dot("o_orderpriority"), "1-URGENT", "2-HIGH"]], "select": {"k": dot("o_orderkey")}},
    "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
add("f9_any_all", {"relation": "embeddings", "where": ["and", ["any", ">", 0.3, dot("embedding")], ["all", "<", -0.6, dot("embedding")]], "select": {"k": dot("vec_id"), "low": ["any", ">", -0.2, dot("embedding")]}},
    "SELECT vec_id AS k, list_min(embedding) < -0.2 AS low FROM embeddings WHERE list_min(embedding) < 0.3 AND list_min(embedding) > -0.6")
add("f10_null_tests", {"relation": "documents", "join": {"l": {"relation": "labels", "on": {"doc_id": "doc_id"}}}, "select": {"id": dot("doc_id"), "none": ["is_null", dot("l", "quality")], "good": ["is_true", ["=", dot("l", "quality"), 1]], "bad": ["is_not_false", ["=", dot("l", "quality"), 0]]}},
    "SELECT d.doc_id AS id, quality IS NULL AS none, (quality = 1) IS TRUE AS good, (quality = 0) IS NOT FALSE AS bad FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
add("f11_like_regex", {"relation": "part", "where": ["or", ["like", dot("p_name"), "%1%"], ["ilike", dot("p_brand"), "brand#2%"], ["~", dot("p_type"), "^E"]], "select": {"k": dot("p_partkey"), "m": ["~*", dot("p_type"), "^e.*c"]}},
    "SELECT p_partkey AS k, regexp_matches(p_type, '^e.*c', 'i') AS m FROM part WHERE p_name LIKE '%1%' OR p_brand ILIKE 'brand#2%' OR regexp_matches(p_type, '^E')")
add("f13_full_text", {"relation": "documents", "where": ["@@", dot("text"), "the that"], "select": {"id": dot("doc_id")}},
    r"SELECT doc_id AS id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['the', 'that'])")
add("f14_array_operators", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}}},
    "select": {"c": dot("c_custkey"), "has": ["@>", ["agg", "array_agg", [dot("o", "o_orderstatus")]], ["array", "F", "O"]], "meets": ["&&", ["agg", "array_agg", [dot("o", "o_orderstatus")]], ["array", "P"]]}},
    "SELECT c_custkey AS c, list_has_all((SELECT list(o_orderstatus) FROM orders WHERE o_custkey = c_custkey), ['F', 'O']) AS has, list_has_any((SELECT list(o_orderstatus) FROM orders WHERE o_custkey = c_custkey), ['P']) AS meets FROM customer")
add("f16_json_operators", {"relation": "events", "select": {"id": dot("event_id"), "k": ["->>", dot("props"), "k"], "n": ["::", ["#>>", dot("props"), ["k"]], "int"], "has": ["?", dot("props"), "k"], "any": ["?|", dot("props"), ["array", "x", "k"]], "all": ["?&", dot("props"), ["array", "x", "k"]]}},
    "SELECT event_id AS id, props ->> '$.k' AS k, (props ->> '$.k')::INT AS n, list_contains(json_keys(props), 'k') AS has, list_contains(json_keys(props), 'k') AS any, false AS all FROM events")
add("f17_agg_in_where_and_order", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}}}, "where": [">=", ["agg", "count", [dot("o")]], 12], "order_by": [["desc", ["agg", "count", [dot("o")]]], dot("c_custkey")], "limit": 20, "select": {"c": dot("c_custkey"), "n": ["agg", "count", [dot("o")]]}},
    "SELECT c_custkey AS c, count(*)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 12 ORDER BY n DESC, c LIMIT 20")

# joins
add("j5_to_many", {"relation": "nation", "join": {"s": {"relation": "supplier", "on": {"s_nationkey": "n_nationkey"}, "order_by": [["desc", dot("s_name")]], "select": {"n": dot("s_name")}}}, "select": {"k": dot("n_nationkey"), "s": dot("s")}},
    "SELECT n_nationkey AS k, coalesce((SELECT to_json(list(struct_pack(n := s_name) ORDER BY s_name DESC)) FROM supplier WHERE s_nationkey = n_nationkey)::VARCHAR, '[]') AS s FROM nation")
add("j5_deep_nested", {"relation": "region", "join": {"n": {"relation": "nation", "on": {"n_regionkey": "r_regionkey"}, "join": {"c": {"relation": "customer", "on": {"c_nationkey": "n_nationkey"}, "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "where": [">", dot("o_totalprice"), 380000], "select": ["col", "o_orderkey"]}},
    "where": [">", dot("c_acctbal"), 9500], "select": {"c": dot("c_custkey"), "o": dot("o")}}}, "select": {"n": dot("n_name"), "c": dot("c")}}}, "select": {"r": dot("r_name"), "n": dot("n")}},
    """SELECT r_name AS r, coalesce((SELECT to_json(list(struct_pack(c := coalesce((SELECT list(struct_pack(c := c_custkey, o := coalesce((SELECT list(o_orderkey ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 380000), [])) ORDER BY c_custkey)
       FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500), []), n := n_name) ORDER BY n_nationkey)) FROM nation WHERE n_regionkey = r_regionkey)::VARCHAR, '[]') AS n FROM region""")
add("j1_composite_key", {"relation": "conversations", "join": {"same": {"relation": "conversations", "on": {"conv_id": "conv_id", "turn": "turn"}}}, "select": {"c": dot("conv_id"), "t": dot("turn"), "r": dot("same", "role")}},
    "SELECT conv_id AS c, turn AS t, role AS r FROM conversations")
add("o6_top_per_parent", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "order_by": [["desc", dot("o_totalprice")]], "limit": 3, "offset": 1, "select": ["col", "o_orderkey"]}}, "select": {"c": dot("c_custkey"), "o": dot("o")}},
    "SELECT c_custkey AS c, coalesce((SELECT to_json(list(o_orderkey ORDER BY rn)) FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE o_custkey = c_custkey AND rn BETWEEN 2 AND 4)::VARCHAR, '[]') AS o FROM customer")
add("o8_distinct_on_per_parent", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "distinct_on": [dot("o_orderpriority")], "order_by": [dot("o_orderpriority"), ["desc", dot("o_totalprice")]], "select": ["col", "o_orderkey"]}}, "select": {"c": dot("c_custkey"), "o": dot("o")}},
    "SELECT c_custkey AS c, coalesce((SELECT to_json(list(o_orderkey ORDER BY o_orderpriority)) FROM (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE o_custkey = c_custkey AND rn = 1)::VARCHAR, '[]') AS o FROM customer")
add("o7_distinct_child", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "distinct": True, "order_by": [dot("o_orderstatus")], "select": ["col", "o_orderstatus"]}}, "select": {"c": dot("c_custkey"), "o": dot("o")}},
    "SELECT c_custkey AS c, coalesce((SELECT to_json(list(DISTINCT o_orderstatus ORDER BY o_orderstatus)) FROM orders WHERE o_custkey = c_custkey)::VARCHAR, '[]') AS o FROM customer")

# aggregates
add("a1_aggregates_shared", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}}}, "select": {
    "c": dot("c_custkey"), "n": ["agg", "count", [dot("o")]], "open": ["agg", "count", [dot("o", "o_orderkey")], {"filter": ["=", dot("o", "o_orderstatus"), "O"]}],
    "total": ["call", "round", ["agg", "sum", [dot("o", "o_totalprice")]], 2], "most": ["agg", "max", [dot("o", "o_totalprice")]], "least": ["agg", "min", [dot("o", "o_orderdate")]],
    "kinds": ["agg", "count", [dot("o", "o_orderpriority")], {"distinct": True}], "late": ["agg", "bool_or", [[">", dot("o", "o_totalprice"), 390000]]]}},
    "SELECT c_custkey AS c, count(o_orderkey)::BIGINT AS n, (count(*) FILTER (WHERE o_orderstatus = 'O'))::BIGINT AS open, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most, min(o_orderdate) AS least, count(DISTINCT o_orderpriority)::BIGINT AS kinds, bool_or(o_totalprice > 390000) AS late FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("a5_ordered_aggregates", {"relation": "nation", "join": {"s": {"relation": "supplier", "on": {"s_nationkey": "n_nationkey"}}}, "select": {
    "k": dot("n_nationkey"), "names": ["agg", "string_agg", [dot("s", "s_name"), "; "], {"order_by": [["desc", dot("s", "s_name")]]}], "keys": ["agg", "array_agg", [dot("s", "s_suppkey")], {"order_by": [dot("s", "s_suppkey")]}]}},
    "SELECT n_nationkey AS k, string_agg(s_name, '; ' ORDER BY s_name DESC) AS names, to_json(list(s_suppkey ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL))::VARCHAR AS keys FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("a7_statistics", {"relation": "nation", "join": {"c": {"relation": "customer", "on": {"c_nationkey": "n_nationkey"}}}, "select": {
    "k": dot("n_nationkey"), "avg": ["call", "round", ["agg", "avg", [dot("c", "c_acctbal")]], 4], "dev": ["call", "round", ["agg", "stddev", [dot("c", "c_acctbal")]], 4], "sum_keys": ["::", ["agg", "sum", [dot("c", "c_custkey")]], "bigint"]}},
    "SELECT n_nationkey AS k, round(avg(c_acctbal), 4) AS avg, round(stddev_samp(c_acctbal), 4) AS dev, sum(c_custkey)::BIGINT AS sum_keys FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("a4_child_limit_before_agg", {"relation": "customer", "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "order_by": [["desc", dot("o_totalprice")]], "limit": 2}}, "select": {"c": dot("c_custkey"), "n": ["agg", "count", [dot("o")]], "low": ["agg", "min", [dot("o", "o_totalprice")]]}},
    "SELECT c_custkey AS c, count(o_orderkey)::BIGINT AS n, min(o_totalprice) AS low FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn <= 2 GROUP BY 1")
add_function("a8_count", lambda s: s.spark.createDataFrame([(s.count({"relation": "orders", "where": [">", dot("o_totalprice"), 100000], "limit": 5, "distinct": True}),)], "n long"), "SELECT count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 100000")

# sort, limit, distinct
add("o1_order_limit_offset", {"relation": "orders", "order_by": [["desc", dot("o_totalprice")], dot("o_orderkey")], "limit": 10, "offset": 5, "select": {"k": dot("o_orderkey"), "p": dot("o_totalprice")}},
    "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
add("o4_null_orders", {"relation": "documents", "join": {"l": {"relation": "labels", "on": {"doc_id": "doc_id"}}}, "order_by": [["asc-nulls-first", dot("l", "quality")], dot("doc_id")], "limit": 700, "select": {"id": dot("doc_id"), "q": dot("l", "quality")}},
    "SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY quality NULLS FIRST, d.doc_id LIMIT 700")
add("o7_distinct", {"relation": "orders", "distinct": True, "select": {"s": dot("o_orderstatus"), "p": dot("o_orderpriority")}}, "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
add("o8_distinct_on", {"relation": "orders", "distinct_on": [dot("o_custkey")], "order_by": [dot("o_custkey"), ["desc", dot("o_totalprice")]], "select": {"c": dot("o_custkey"), "k": dot("o_orderkey")}},
    "SELECT DISTINCT ON (o_custkey) o_custkey AS c, o_orderkey AS k FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
add("limited_parent_embed", {"relation": "customer", "order_by": [["desc", dot("c_acctbal")]], "limit": 10, "join": {"o": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "select": ["col", "o_orderkey"]}}, "select": {"c": dot("c_custkey"), "o": dot("o")}},
    "SELECT c_custkey AS c, coalesce((SELECT to_json(list(o_orderkey ORDER BY o_orderkey)) FROM orders WHERE o_custkey = c_custkey)::VARCHAR, '[]') AS o FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)")

# scalar operators and functions
add("e1_arithmetic", {"relation": "part", "select": {"k": dot("p_partkey"), "div": ["/", dot("p_size"), 4], "pow": ["^", dot("p_size"), 2], "mod": ["%", dot("p_size"), 7], "bits": ["|", ["&", dot("p_size"), 12], 1], "neg": ["-", dot("p_size")], "half": ["/", dot("p_retailprice"), 2], "inv": ["~", dot("p_size")], "root": ["call", "round", ["|/", dot("p_size")], 6], "left": ["<<", dot("p_size"), 2]}},
    "SELECT p_partkey AS k, p_size // 4 AS div, p_size::DOUBLE ^ 2 AS pow, p_size % 7 AS mod, (p_size & 12) | 1 AS bits, -p_size AS neg, p_retailprice / 2 AS half, ~p_size AS inv, round(sqrt(p_size), 6) AS root, p_size << 2 AS left FROM part")
add("e2_text", {"relation": "customer", "select": {"k": dot("c_custkey"), "cat": ["||", dot("c_name"), "/", dot("c_mktsegment")], "ws": ["concat_ws", "-", dot("c_name"), None, dot("c_mktsegment")], "fmt": ["format", "%s in %s (%2$s)", dot("c_custkey"), dot("c_mktsegment")], "up": ["call", "lower", dot("c_mktsegment")], "part": ["call", "split_part", dot("c_name"), "#", 2], "sub": ["call", "substring", dot("c_name"), 1, 4], "pad": ["call", "lpad", ["::", dot("c_nationkey"), "text"], 4, "0"], "some": ["||?", None, dot("c_mktsegment")], "first": ["??", None, dot("c_name")]}},
    "SELECT c_custkey AS k, c_name || '/' || c_mktsegment AS cat, concat_ws('-', c_name, c_mktsegment) AS ws, c_custkey || ' in ' || c_mktsegment || ' (' || c_mktsegment || ')' AS fmt, lower(c_mktsegment) AS up, split_part(c_name, '#', 2) AS part, substring(c_name, 1, 4) AS sub, lpad(c_nationkey::VARCHAR, 4, '0') AS pad, c_mktsegment AS some, c_name AS first FROM customer")
add("e3_arrays", {"relation": "embeddings", "select": {"k": dot("vec_id"), "first": ["index", dot("embedding"), 1], "none": ["index", dot("embedding"), 99], "zero": ["index", dot("embedding"), 0], "n": ["call", "cardinality", ["slice", dot("embedding"), 3, 5]], "third": ["index", ["slice", dot("embedding"), 3, 5], 1], "empty": ["call", "cardinality", ["slice", dot("embedding"), 5, 3]]}},
    "SELECT vec_id AS k, embedding[1] AS first, NULL::FLOAT AS none, NULL::FLOAT AS zero, 3 AS n, embedding[3] AS third, 0 AS empty FROM embeddings")
add("e4_casts_and_dates", {"relation": "orders", "select": {"k": dot("o_orderkey"), "d": ["::", ["::", dot("o_orderdate"), "date"], "text"], "y": ["::", ["call", "date_part", "year", dot("o_orderdate")], "int"], "m": ["call", "date_trunc", "month", dot("o_orderdate")], "i": ["::", ["call", "floor", dot("o_totalprice")], "int8"], "t": ["::", dot("o_orderkey"), "text"], "big": ["+", dot("o_orderkey"), ["bigint", "10000000000"]]}},
    "SELECT o_orderkey AS k, o_orderdate::DATE::VARCHAR AS d, year(o_orderdate)::INT AS y, date_trunc('month', o_orderdate)::TIMESTAMP AS m, floor(o_totalprice)::BIGINT AS i, o_orderkey::VARCHAR AS t, o_orderkey + 10000000000 AS big FROM orders")
add("e5_function_in_expression", {"relation": "part", "select": {"k": dot("p_partkey"), "tax": ["call", "round", ["call", "with_tax", dot("p_retailprice")], 3], "g": ["call", "greatest", dot("p_size"), 25], "n": ["call", "nullif", dot("p_size"), 1]}},
    "SELECT p_partkey AS k, round(p_retailprice * 1.2::DOUBLE, 3) AS tax, greatest(p_size, 25) AS g, nullif(p_size, 1) AS n FROM part")

def _span(low: Any, high: Any) -> dict:
    return {"lower": low, "upper": high, "lower_inc": True, "upper_inc": False}


_SIZE = _span(dot("p_size"), ["+", dot("p_size"), 10])
add("e6_ranges", {"relation": "part", "select": {
    "k": dot("p_partkey"), "holds": ["@>", _SIZE, 15], "inside": ["<@", _SIZE, _span(5, 30)], "meets": ["&&", _SIZE, _span(20, 25)], "before": ["<<", _SIZE, _span(30, 40)],
    "after": [">>", _SIZE, _span(0, 12)], "touches": ["-|-", _SIZE, _span(30, 40)], "not_right": ["&<", _SIZE, _span(0, 30)], "not_left": ["&>", _SIZE, _span(12, 13)]}},
    "SELECT p_partkey AS k, p_size <= 15 AND p_size + 10 > 15 AS holds, p_size >= 5 AND p_size + 10 <= 30 AS inside, p_size < 25 AND p_size + 10 > 20 AS meets, p_size + 10 <= 30 AS before, "
    "p_size >= 12 AS after, p_size + 10 = 30 OR p_size = 40 AS touches, p_size + 10 <= 30 AS not_right, p_size >= 12 AS not_left FROM part")
add("e7_distance", {"relation": "part", "select": {"k": dot("p_partkey"), "d": ["call", "round", ["<->", {"x": dot("p_size"), "y": 0}, {"x": 3, "y": 4}], 9]}}, "SELECT p_partkey AS k, round(sqrt((p_size - 3) ** 2 + 16), 9) AS d FROM part")
add("e9_text_functions", {"relation": "customer", "select": {
    "k": dot("c_custkey"), "len": ["call", "length", dot("c_name")], "left": ["call", "left", dot("c_name"), -3], "right": ["call", "right", dot("c_name"), 3], "rep": ["call", "repeat", "ab", 2], "repl": ["call", "replace", dot("c_name"), "Customer", "C"],
    "rev": ["call", "reverse", dot("c_mktsegment")], "pos": ["call", "strpos", dot("c_name"), "#"], "tr": ["call", "translate", dot("c_mktsegment"), "AEI", "aei"], "md5": ["call", "md5", dot("c_name")], "starts": ["call", "starts_with", dot("c_mktsegment"), "B"],
    "once": ["call", "regexp_replace", dot("c_name"), "0", "x"], "every": ["call", "regexp_replace", dot("c_name"), "0", "x", "g"], "arr": ["call", "array_to_string", ["call", "string_to_array", dot("c_name"), "#"], "|"], "quoted": ["call", "quote_literal", "it's"]}},
    "SELECT c_custkey AS k, length(c_name)::INT AS len, left(c_name, length(c_name) - 3) AS left, right(c_name, 3) AS right, 'abab' AS rep, replace(c_name, 'Customer', 'C') AS repl, reverse(c_mktsegment) AS rev, instr(c_name, '#')::INT AS pos, "
    "translate(c_mktsegment, 'AEI', 'aei') AS tr, md5(c_name) AS md5, starts_with(c_mktsegment, 'B') AS starts, regexp_replace(c_name, '0', 'x') AS once, regexp_replace(c_name, '0', 'x', 'g') AS every, replace(c_name, '#', '|') AS arr, '''it''''s''' AS quoted FROM customer")
add("s2_view_scan", {"relation": "customer", "join": {"big": {"relation": "big_orders", "on": {"o_custkey": "c_custkey"}}}, "select": {"c": dot("c_custkey"), "n": ["agg", "count", [dot("big")]]}},
    "SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 200000)::BIGINT AS n FROM customer")
add("s11_schema", {"relation": "region", "schema": "few"}, "SELECT * FROM region WHERE r_regionkey < 2")
add("s7_overloads", {"relation": "part", "select": {"k": dot("p_partkey"), "a": ["call", "round", ["call", "with_tax", dot("p_retailprice")], 4], "b": ["call", "round", ["call", "with_tax", dot("p_retailprice"), 0.5], 4]}},
    "SELECT p_partkey AS k, round(p_retailprice * 1.2::DOUBLE, 4) AS a, round(p_retailprice * 1.5::DOUBLE, 4) AS b FROM part")

# other front ends
_GET = "relation=orders&where=and(gte(o_totalprice,300000),in(o_orderstatus,'F','O'))&select=k:o_orderkey,cust.c_name&order_by=-o_totalprice,o_orderkey&limit=25&join.cust.relation=customer&join.cust.on.c_custkey=o_custkey"
add("e12_query_string", querystring.decode(_GET.replace("cust.c_name&", "who:cust.c_name&")),
    "SELECT o_orderkey AS k, c_name AS who FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 300000 AND o_orderstatus IN ('F', 'O') ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
KNOWN = WellKnown([{"name": "rich", "params": {"least": {"type": "float8", "default": 9000}, "segment": {"type": "text"}}, "query": {
    "relation": "customer", "where": ["and", [">=", dot("c_acctbal"), ["$param", "least", "float8"]], ["=", dot("c_mktsegment"), ["$param", "segment", "text"]]], "select": {"c": dot("c_custkey"), "b": dot("c_acctbal")}}}])
add_function("e10_well_known", lambda s: s.frame({"wellknown": "rich", "params": {"segment": "BUILDING"}}), "SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal >= 9000 AND c_mktsegment = 'BUILDING'", KNOWN)


# writes: the query runs the write and returns the table it leaves
def _after(relation: str, request: dict) -> Callable[[Session], DataFrame]:
    def run(s: Session) -> DataFrame:
        s.execute(request)
        return s.frame({"relation": relation, "select": ["*~"]})
    return run


ORDERS = {"relation": "orders", "on": {"o_custkey": "c_custkey"}}
_NATIONS = {"n_nationkey": dot("n_nationkey"), "n_name": dot("n_name"), "n_regionkey": dot("n_regionkey")}
_REGION = {"relation": "region", "write_mode": "upsert", "join": {"n": {"relation": "nation", "on": {"n_regionkey": "r_regionkey"}, "select": {"n_nationkey": dot("n_nationkey"), "n_name": dot("n_name")}}}, "select": {"r_regionkey": dot("r_regionkey"), "r_name": dot("r_name"), "n": dot("n")}}
_PAYLOAD = [{"r_regionkey": 1, "r_name": "NEW", "n": [{"n_nationkey": 1, "n_name": "ONE"}, {"n_nationkey": 90, "n_name": "NINETY"}]}, {"r_regionkey": 7, "r_name": "SEVEN", "n": []}, {"r_regionkey": 2, "r_name": "KEPT"}]
add_function("w3_insert", _after("nation", {"query": {"relation": "nation", "select": _NATIONS}, "data": [{"n_nationkey": 50, "n_name": "A", "n_regionkey": 1}, {"n_nationkey": 51, "n_name": "B"}]}),
             "SELECT * FROM nation UNION ALL VALUES (50, 'A', 1), (51, 'B', NULL)")
add_function("w4_upsert", _after("nation", {"query": {"relation": "nation", "write_mode": "upsert", "select": _NATIONS}, "data": [{"n_nationkey": 3, "n_name": "THREE"}, {"n_nationkey": 52, "n_name": "C", "n_regionkey": 0}]}),
             "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'THREE' ELSE n_name END AS n_name, CASE n_nationkey WHEN 3 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (52, 'C', 0)")
add_function("w5_nested_merge_parents", _after("region", {"query": _REGION, "data": _PAYLOAD}), "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'NEW' WHEN 2 THEN 'KEPT' ELSE r_name END AS r_name FROM region UNION ALL VALUES (7, 'SEVEN')")
add_function("w5_nested_merge_children", _after("nation", {"query": _REGION, "data": _PAYLOAD}), "SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'ONE' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 OR n_nationkey = 1 UNION ALL VALUES (90, 'NINETY', 1)")
add_function("w7_update_existing", _after("nation", {"query": {"relation": "nation", "write_mode": "update-existing", "select": _NATIONS}, "data": [{"n_nationkey": 4, "n_regionkey": 0}, {"n_nationkey": 99, "n_name": "NONE"}]}),
             "SELECT n_nationkey, n_name, CASE n_nationkey WHEN 4 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
add_function("w9_update_where", _after("customer", {"query": {"relation": "customer", "write_mode": "update", "where": ["<", dot("c_acctbal"), 0], "select": {"c_custkey": dot("c_custkey"), "c_mktsegment": dot("c_mktsegment")}}, "data": {"c_mktsegment": "OVERDRAWN"}}),
             "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS c_mktsegment FROM customer")
add_function("w10_delete_where", _after("orders", {"query": {"relation": "orders", "write_mode": "delete", "where": ["=", dot("o_orderstatus"), "F"]}, "returns": "none", "stats": True}), "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
_CHILDREN = {"n_nationkey": dot("n_nationkey"), "n_name": dot("n_name")}


def _nested(mode: str, **more: Any) -> dict:
    return {"relation": "region", "write_mode": "update-existing", "join": {"n": {"relation": "nation", "on": {"n_regionkey": "r_regionkey"}, "write_mode": mode, "select": _CHILDREN, **more}}, "select": {"r_regionkey": dot("r_regionkey"), "n": dot("n")}}


_TWO = [{"r_regionkey": 1, "n": [{"n_nationkey": 1, "n_name": "ONE"}, {"n_nationkey": 90, "n_name": "NINETY"}]}, {"r_regionkey": 2}]
add_function("w6_merge_new", _after("nation", {"query": _nested("merge-new"), "data": _TWO}), "SELECT * FROM nation WHERE n_regionkey <> 1 OR n_nationkey = 1 UNION ALL VALUES (90, 'NINETY', 1)")
add_function("w7_merge_update", _after("nation", {"query": _nested("merge-update"), "data": _TWO}), "SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'ONE' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 OR n_nationkey = 1")
add_function("w8_delete_only", _after("nation", {"query": _nested("deleteonly", where=["<", dot("n_nationkey"), 15]), "data": _TWO}), "SELECT * FROM nation WHERE n_regionkey <> 1 OR n_nationkey = 1 OR n_nationkey >= 15")
add_function("w11_readonly_child", _after("nation", {"query": _nested("readonly"), "data": _TWO}), "SELECT * FROM nation")
add_function("w17_on_conflict", _after("region", {"query": {"relation": "region", "write_mode": "update-existing", "on_conflict": "region_name", "select": {"r_name": dot("r_name")}}, "data": [{"r_name": "ASIA"}, {"r_name": "NOWHERE"}]}), "SELECT * FROM region")
add_function("w18_update_columns", _after("nation", {"query": {"relation": "nation", "write_mode": "upsert", "update_columns": ["n_name"], "select": _NATIONS}, "data": [{"n_nationkey": 3, "n_name": "THREE", "n_regionkey": 0}]}),
             "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'THREE' ELSE n_name END AS n_name, n_regionkey FROM nation")
add_function("w9_update_by_child", _after("customer", {"query": {"relation": "customer", "write_mode": "update", "join": {"o": ORDERS}, "where": [">=", ["agg", "count", [dot("o")]], 14], "select": {"c_custkey": dot("c_custkey"), "c_acctbal": dot("c_acctbal")}}, "data": {"c_acctbal": 0}}),
             "SELECT c_custkey, c_name, c_nationkey, CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 14 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")


def _sequence(s: Session) -> DataFrame:
    # a sequence is one transaction: its read sees its write
    got = s.execute([{"query": {"relation": "region", "select": {"r_regionkey": dot("r_regionkey"), "r_name": dot("r_name")}}, "data": [{"r_regionkey": 8, "r_name": "EIGHT"}]}, {"query": {"relation": "region", "limit": 1}, "count": True, "returns": "none"}])
    return s.spark.createDataFrame([(got[0][0]["r_name"], got[1]["count"], got[1]["offset"], got[1]["limit"])], "name string, n long, first long, most long")


add_function("e1_sequence", _sequence, "SELECT 'EIGHT' AS name, (count(*) + 1)::BIGINT AS n, 0::BIGINT AS first, 1::BIGINT AS most FROM region")
add_function("e8_rollback", _after("region", {"query": {"relation": "region", "write_mode": "delete", "where": True}, "rollback": True}), "SELECT * FROM region")
add_function("w25_stats", lambda s: s.spark.createDataFrame([(".".join(x["path"]), x["table"], x["submitted"], x["inserted"], x["updated"], x["deleted"]) for x in s.execute({"query": _REGION, "data": _PAYLOAD, "stats": True, "returns": "none"})["stats"]], "path string, tbl string, submitted long, inserted long, updated long, deleted long"),
             "SELECT '' AS path, 'main.region' AS tbl, 3::BIGINT AS submitted, 1::BIGINT AS inserted, 2::BIGINT AS updated, 0::BIGINT AS deleted UNION ALL SELECT 'n', 'main.nation', 2, 1, 1, count(*) - 1 FROM nation WHERE n_regionkey = 1")


# requests that are refused, with the codes that tell why
def add_codes(name: str, cases: dict[str, tuple[Any, str]], wellknown: WellKnown | None = None) -> None:
    def outcome(s: Session, request: Any) -> str:
        try:
            s.execute(request)
        except QueryError as e:
            return e.code
        return "ok"

    add_function(name, lambda s: s.spark.createDataFrame([(k, outcome(s, q)) for k, (q, _) in cases.items()], "what string, code string"),
                 "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{code}')" for k, (_, code) in cases.items()) + ") t(what, code)", wellknown)


def _write(request: dict, data: Any = None, **flags: Any) -> dict:
    return {"query": request, **({} if data is None else {"data": data}), **flags}


_CUSTOMER, _NATION = {"relation": "customer"}, {"relation": "nation"}
add_codes("s10_hidden_schemas_and_functions", {
    "schema": ({**_NATION, "schema": "pg_catalog"}, "UNKNOWN_IDENTIFIER"), "information": ({"relation": "tables", "schema": "information_schema"}, "UNKNOWN_IDENTIFIER"),
    "function": ({**_NATION, "select": ["call", "pg_sleep", 1]}, "UNKNOWN_IDENTIFIER"), "aggregate": ({**_CUSTOMER, "join": {"o": ORDERS}, "select": ["agg", "set_config", [dot("o", "o_orderkey")]]}, "UNKNOWN_IDENTIFIER"), "plain": ({**_NATION, "limit": 1}, "ok")})
add_codes("j2_join_eligibility", {
    "no_key": ({**_CUSTOMER, "join": {"x": {"relation": "supplier", "on": {"s_name": "c_name"}}}}, "JOIN_MISSING_INDEX"), "no_index": ({**_NATION, "join": {"x": {"relation": "profile", "on": {"nation": "n_nationkey"}}}}, "JOIN_MISSING_INDEX"),
    "no_on": ({**_CUSTOMER, "join": {"o": {"relation": "orders"}}}, "QUERY_INVALID_EXPRESSION"), "no_column": ({**_CUSTOMER, "join": {"o": {"relation": "orders", "on": {"o_nothing": "c_custkey"}}}}, "UNKNOWN_IDENTIFIER"),
    "root_on": ({**_CUSTOMER, "on": {"c_custkey": "x"}}, "QUERY_INVALID_EXPRESSION"), "record": ({**_CUSTOMER, "join": {"x": {"function": "order_counts", "arguments": ["F"]}}}, "JOIN_MISSING_INDEX"), "good": ({**_CUSTOMER, "limit": 1, "join": {"o": ORDERS}}, "ok")})


def _deep(n: int) -> dict:
    """Relations joined to themselves, n deep."""
    q: dict = {"relation": "region", "select": {"k": dot("r_regionkey")}}
    for _ in range(n - 1):
        q = {"relation": "region", "join": {"x": {**q, "on": {"r_regionkey": "r_regionkey"}}}, "select": {"x": dot("x")}}
    return q


add_codes("j9_depth_limit", {"six": (_deep(6), "ok"), "seven": (_deep(7), "QUERY_INVALID_EXPRESSION")})
add_codes("o5_literal_terms", {"number": ({**_NATION, "order_by": [1]}, "QUERY_INVALID_EXPRESSION"), "distinct_on": ({**_NATION, "distinct_on": ["x"]}, "QUERY_INVALID_EXPRESSION"), "column": ({**_NATION, "order_by": [dot("n_name")], "limit": 1}, "ok"),
                              "lead": ({**_NATION, "distinct_on": [dot("n_name")], "order_by": [dot("n_nationkey")]}, "QUERY_INVALID_EXPRESSION")})
add_codes("w2_placement", {
    "update_without_where": (_write({**_NATION, "write_mode": "update"}, {}), "WRITE_FORBIDDEN"), "delete_with_join": (_write({**_CUSTOMER, "write_mode": "delete", "where": True, "join": {"o": ORDERS}}), "WRITE_FORBIDDEN"),
    "merge_at_root": (_write({**_NATION, "write_mode": "merge"}, []), "WRITE_FORBIDDEN"), "nested_update": (_write({"relation": "region", "join": {"n": {**_NATION, "on": {"n_regionkey": "r_regionkey"}, "write_mode": "update", "where": True}}}, []), "WRITE_FORBIDDEN"),
    "merge_to_one": (_write({**_NATION, "join": {"r": {"relation": "region", "on": {"r_regionkey": "n_regionkey"}, "write_mode": "merge"}}}, []), "WRITE_FORBIDDEN"), "readonly_root": (_write({**_NATION, "write_mode": "readonly"}, []), "WRITE_FORBIDDEN"),
    "view": (_write({"relation": "big_orders"}, []), "WRITE_FORBIDDEN"), "function": (_write({"function": "orders_of", "arguments": [1]}, []), "WRITE_FORBIDDEN_FUNCTION_ROOT"), "unknown_mode": (_write({**_NATION, "write_mode": "replace"}, []), "QUERY_INVALID_EXPRESSION")})
add_codes("w19_writability", {
    "scalar_select": (_write({**_NATION, "select": dot("n_name")}, []), "WRITE_FORBIDDEN"), "identity_left_out": (_write({**_NATION, "write_mode": "upsert", "select": {"n": dot("n_name")}}, []), "WRITE_FORBIDDEN"),
    "identity_computed": (_write({**_NATION, "write_mode": "upsert", "select": {"k": ["+", dot("n_nationkey"), 1]}}, []), "WRITE_FORBIDDEN"), "identity_twice": (_write({**_NATION, "write_mode": "upsert", "select": {"a": dot("n_nationkey"), "b": dot("n_nationkey")}}, []), "WRITE_FORBIDDEN"),
    "no_constraint": (_write({**_NATION, "write_mode": "upsert", "on_conflict": ["n_regionkey"]}, []), "UNKNOWN_IDENTIFIER"), "coalesced": (_write({**_NATION, "write_mode": "upsert", "select": {"k": ["coalesce", dot("n_nationkey"), 0]}}, []), "ok")})
_ROW = {"n_nationkey": 77, "n_name": "X", "n_regionkey": 1}
add_codes("w23_value_validation", {what: (_write(_NATION, [_ROW | change], rollback=True), code) for what, (change, code) in {
    "text_number": ({"n_regionkey": "3"}, "ok"), "fraction": ({"n_regionkey": 1.5}, "PG_INVALID_TEXT_REPRESENTATION"), "boolean": ({"n_regionkey": True}, "PG_INVALID_TEXT_REPRESENTATION"), "word": ({"n_regionkey": "x"}, "PG_INVALID_TEXT_REPRESENTATION"),
    "range": ({"n_regionkey": 1 << 40}, "PG_NUMERIC_VALUE_OUT_OF_RANGE"), "number_for_text": ({"n_name": 5}, "PG_INVALID_TEXT_REPRESENTATION"), "null": ({"n_name": None}, "ok"), "null_key": ({"n_nationkey": None}, "PG_NOT_NULL_VIOLATION"), "taken": ({"n_nationkey": 3}, "PG_UNIQUE_VIOLATION")}.items()})
add_codes("e3_flags", {
    "count_of_write": (_write(_NATION, [_ROW], count=True), "QUERY_COUNT_IS_READ_ONLY"), "stats_of_read": (_write(_NATION, stats=True), "QUERY_STATS_IS_WRITE_ONLY"), "stats_and_plan": (_write(_NATION, [_ROW], stats=True, query_plan=True), "QUERY_STATS_QUERY_PLAN_CONFLICT"),
    "nothing_left": (_write(_NATION, returns="none"), "QUERY_UNSUPPORTED_RETURNS"), "returns": (_write(_NATION, returns="some"), "QUERY_INVALID_RETURNS"), "whole": (_write({**_NATION, "limit": 1}, count=True, sql=True, query_plan=True, returns="results"), "ok")})
add_codes("e15_error_codes", {
    "json": ("{", "QUERY_MALFORMED_JSON"), "operator": ({**_NATION, "select": ["nothing", 1]}, "QUERY_INVALID_EXPRESSION"), "relation": ({"relation": "nothing"}, "UNKNOWN_IDENTIFIER"), "column": ({**_NATION, "select": ["col", "x"]}, "UNKNOWN_IDENTIFIER"),
    "function": ({**_NATION, "select": ["call", "x"]}, "UNKNOWN_IDENTIFIER"), "types": ({**_NATION, "select": ["/", ["array", 1], 2]}, "QUERY_INVALID_EXPRESSION"), "division": ({**_NATION, "select": ["/", 1, ["-", dot("n_nationkey"), dot("n_nationkey")]]}, "TRANSACTION_ERROR"),
    "many_rows": ({**_CUSTOMER, "join": {"o": ORDERS}, "select": dot("o", "o_orderkey")}, "QUERY_INVALID_EXPRESSION"), "unknown_query": ({"wellknown": "nothing"}, "WELL_KNOWN_UNKNOWN_QUERY"), "lacking": ({"wellknown": "rich"}, "WELL_KNOWN_PARAM_REQUIRED"),
    "kind": ({"wellknown": "rich", "params": {"segment": 5}}, "WELL_KNOWN_PARAM_TYPE_MISMATCH")}, KNOWN)


def _granted(s: Session) -> DataFrame:
    """Flags that are not granted leave their part out, but a rollback must not be passed over."""
    poor = Session(s.spark, s.catalog, grants={"count": False, "sql": False, "query_plan": False, "rollback": False})
    got = poor.execute({"query": {"relation": "region", "limit": 2}, "count": True, "sql": True, "query_plan": True})
    try:
        poor.execute({"query": {"relation": "region", "write_mode": "delete", "where": True}, "rollback": True})
        code = "ok"
    except QueryError as e:
        code = e.code
    return s.spark.createDataFrame([(",".join(sorted(got)), len(got["result"]), code)], "members string, n long, code string")


add_function("e4_policy", _granted, "SELECT 'result' AS members, 2::BIGINT AS n, 'QUERY_ROLLBACK_NOT_GRANTED' AS code")


def _told(s: Session) -> DataFrame:
    got = s.execute({"query": {"relation": "orders", "where": [">", dot("o_totalprice"), 400000], "limit": 3}, "count": True, "sql": True, "query_plan": True, "returns": "none"})
    nodes, todo = [], [got["query_plan"][0]["plan"]]
    while todo:
        at = todo.pop()
        nodes.append(at["node"])
        todo += at.get("reads", [])
    return s.spark.createDataFrame([(got["count"], got["limit"], ",".join(sorted(got)), any("Scan" in n for n in nodes), "o_totalprice" in got["sql"][0]["select"])], "n long, most long, members string, scans boolean, filters boolean")


add_function("e7_sql_and_plan", _told, "SELECT count(*)::BIGINT AS n, 3::BIGINT AS most, 'count,limit,offset,query_plan,sql' AS members, true AS scans, true AS filters FROM orders WHERE o_totalprice > 400000")

# sinks: what a client reads back from the stream
_WHO = {**_NATION, "select": {"k": dot("n_nationkey"), "name": dot("n_name"), "none": None, "list": ["array", dot("n_regionkey"), 7]}}
add_function("k1_json_rows", lambda s: s.spark.createDataFrame([(x,) for x in s.stream(_WHO)], "line string"), "SELECT '{\"k\":' || n_nationkey || ',\"list\":[' || n_regionkey || ',7],\"name\":\"' || n_name || '\",\"none\":null}' AS line FROM nation")


def _cbor(structures: bool) -> Callable[[Session], DataFrame]:
    def run(s: Session) -> DataFrame:
        rows = cbor.loads(b"".join(cbor_chunks(values(s.frame(_WHO)), structures)))
        return s.spark.createDataFrame([(r["k"], r["name"], json.dumps(r["list"], separators=(",", ":"))) for r in rows], "k long, name string, list string")
    return run


_WHO_SQL = "SELECT n_nationkey::BIGINT AS k, n_name AS name, '[' || n_regionkey || ',7]' AS list FROM nation"
add_function("k2_cbor", _cbor(False), _WHO_SQL)
add_function("k3_cbor_structures", _cbor(True), _WHO_SQL)


def _pieces(s: Session) -> DataFrame:
    """A large answer comes in pieces that make one JSON text; a small one, and any error in it, whole."""
    large, small = list(s.respond({"relation": "customer", "select": {"k": dot("c_custkey"), "name": dot("c_name")}})), list(s.respond({"relation": "region"}))
    rows = json.loads("".join(large))
    return s.spark.createDataFrame([(len(rows), sum(r["k"] for r in rows), len(large) > 1, len(small), len(json.loads(small[0])))], "n long, total long, pieces boolean, small long, regions long")


add_function("k4_held_buffer", _pieces, "SELECT count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS total, count(*) > 5000 / 3 OR sum(length(c_name) + 13 + length(c_custkey::VARCHAR)) > 65536 AS pieces, 1::BIGINT AS small, (SELECT count(*) FROM region)::BIGINT AS regions FROM customer")

# more projections, predicates, orders and overloads
add("p9_get", {"relation": "region", "select": {"n": ["get", "r_name"], "k": ["get", "r_regionkey"]}}, "SELECT r_name AS n, r_regionkey AS k FROM region")
_LABELLED = {"relation": "documents", "join": {"l": {"relation": "labels", "on": {"doc_id": "doc_id"}}}}
add("f6_not_distinct_from", {**_LABELLED, "where": ["===", dot("l", "quality"), None], "select": {"id": dot("doc_id")}}, "SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL")
add("f10_boolean_tests", {**_LABELLED, "select": {"id": dot("doc_id"), "some": ["is_not_null", dot("l", "quality")], "not_good": ["is_not_true", ["=", dot("l", "quality"), 1]], "bad": ["is_false", ["=", dot("l", "quality"), 1]], "not": ["not", ["=", dot("l", "quality"), 1]]}},
    "SELECT d.doc_id AS id, quality IS NOT NULL AS some, (quality = 1) IS NOT TRUE AS not_good, (quality = 1) IS FALSE AS bad, NOT (quality = 1) AS not FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
add("f13_text_queries", {"relation": "documents", "where": ["@@", ["call", "to_tsvector", dot("text")], ["call", "to_tsquery", "the & (that | de:*) & !zebra"]], "select": {"id": dot("doc_id")}},
    r"SELECT doc_id AS id FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents) WHERE list_contains(w, 'the') AND (list_contains(w, 'that') OR len([x FOR x IN w IF starts_with(x, 'de')]) > 0) AND NOT list_contains(w, 'zebra')")
add("f14_json_containment", {"relation": "events", "where": ["@>", ["::", dot("props"), "jsonb"], '{"k": 7}'], "select": {"id": dot("event_id"), "in": ["<@", dot("props"), '{"k": 7, "more": [1]}']}}, "SELECT event_id AS id, true AS in FROM events WHERE props ->> '$.k' = '7'")
add("o2_nulls_last_ascending", {**_LABELLED, "order_by": [dot("l", "quality"), dot("doc_id")], "limit": 150, "offset": 20, "select": {"id": dot("doc_id"), "q": dot("l", "quality")}}, "SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY quality NULLS LAST, d.doc_id LIMIT 150 OFFSET 20")
add("o3_nulls_last_descending", {**_LABELLED, "order_by": [["desc", dot("l", "quality")], ["desc", dot("doc_id")]], "limit": 150, "select": {"id": dot("doc_id"), "q": dot("l", "quality")}}, "SELECT d.doc_id AS id, quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY quality DESC NULLS LAST, d.doc_id DESC LIMIT 150")
add("s7_two_bodies", {"relation": "part", "select": {"k": dot("p_partkey"), "one": ["call", "label", dot("p_type")], "two": ["call", "label", dot("p_type"), dot("p_brand")]}}, "SELECT p_partkey AS k, upper(p_type) AS one, p_type || '/' || p_brand AS two FROM part")
add("u1_variadic_function", {"relation": "part", "select": {"k": dot("p_partkey"), "all": ["call", "joined", "-", dot("p_type"), dot("p_brand"), "x"], "none": ["call", "joined", "-"]}}, "SELECT p_partkey AS k, p_type || '-' || p_brand || '-x' AS all, '' AS none FROM part")
_OF_NATION = {**_NATION, "join": {"c": {"relation": "customer", "on": {"c_nationkey": "n_nationkey"}}}}


def _each(functions: str, *args: Any, digits: int | None = None) -> dict:
    round_ = (lambda e: ["call", "round", e, digits]) if digits is not None else (lambda e: e)
    return {f: round_(["agg", f, list(args)]) for f in functions.split()}


add("u2_own_aggregate", {**_OF_NATION, "select": {"k": dot("n_nationkey"), "all": ["call", "round", ["agg", "spread", [dot("c", "c_acctbal")]], 6], "some": ["agg", "spread", [dot("c", "c_custkey")], {"filter": [">", dot("c", "c_acctbal"), 0]}]}},
    "SELECT n_nationkey AS k, round(max(c_acctbal) - min(c_acctbal), 6) AS all, max(c_custkey) FILTER (WHERE c_acctbal > 0) - min(c_custkey) FILTER (WHERE c_acctbal > 0) AS some FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("a7_bits_and_booleans", {**_OF_NATION, "select": {"k": dot("n_nationkey"), **_each("bit_and bit_or bit_xor any_value", dot("c", "c_nationkey")), "keys": ["agg", "bit_xor", [dot("c", "c_custkey")]], **_each("bool_and bool_or every", [">", dot("c", "c_acctbal"), -900])}},
    "SELECT n_nationkey AS k, bit_and(c_nationkey) AS bit_and, bit_or(c_nationkey) AS bit_or, bit_xor(c_nationkey) AS bit_xor, any_value(c_nationkey) AS any_value, bit_xor(c_custkey) AS keys, bool_and(c_acctbal > -900) AS bool_and, bool_or(c_acctbal > -900) AS bool_or, bool_and(c_acctbal > -900) AS every FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
_REGR = "regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy"
add("a7_two_argument_statistics", {**_OF_NATION, "select": {"k": dot("n_nationkey"), **_each("corr covar_pop covar_samp regr_avgx regr_avgy regr_intercept regr_r2 regr_slope", dot("c", "c_acctbal"), dot("c", "c_custkey"), digits=5), **_each("regr_count", dot("c", "c_acctbal"), dot("c", "c_custkey")),
                                                          **{f: ["call", "round", ["/", ["agg", f, [dot("c", "c_acctbal"), dot("c", "c_custkey")]], 1000000.5], 4] for f in ("regr_sxx", "regr_sxy", "regr_syy")}}},
    "SELECT n_nationkey AS k, " + ", ".join(f"{f}(c_acctbal, c_custkey)::BIGINT AS {f}" if f == "regr_count" else f"round({f}(c_acctbal, c_custkey){' / 1000000.5::DOUBLE, 4' if f in ('regr_sxx', 'regr_sxy', 'regr_syy') else ', 5'}) AS {f}" for f in f"corr covar_pop covar_samp {_REGR}".split())
    + " FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("a7_spread_and_percentiles", {**_OF_NATION, "select": {"k": dot("n_nationkey"), **_each("stddev_pop stddev_samp variance var_pop var_samp median", dot("c", "c_acctbal"), digits=3), "cont": ["call", "round", ["agg", "percentile_cont", [dot("c", "c_acctbal"), 0.3]], 6], "disc": ["agg", "percentile_disc", [dot("c", "c_acctbal"), 0.3]],
                                                         "most": ["agg", "mode", [dot("c", "c_nationkey")]]}},
    "SELECT n_nationkey AS k, " + ", ".join(f"round({f}(c_acctbal), 3) AS {f}" for f in "stddev_pop stddev_samp variance var_pop var_samp median".split()) + ", round(quantile_cont(c_acctbal, 0.3), 6) AS cont, quantile_disc(c_acctbal, 0.3) AS disc, mode(c_nationkey) AS most FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("a4_distinct_statistics", {**_OF_NATION, "select": {"k": dot("n_nationkey"), **{f: ["call", "round", ["agg", f, [["%", dot("c", "c_custkey"), 17]], {"distinct": True}], 6] for f in ("stddev", "var_pop", "avg", "sum")}}},
    "SELECT n_nationkey AS k, round(stddev_samp(DISTINCT c_custkey % 17), 6) AS stddev, round(var_pop(DISTINCT c_custkey % 17), 6) AS var_pop, round(avg(DISTINCT c_custkey % 17), 6) AS avg, sum(DISTINCT c_custkey % 17)::BIGINT AS sum FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("a7_object_agg", {**_NATION, "join": {"s": {"relation": "supplier", "on": {"s_nationkey": "n_nationkey"}}}, "select": {"k": dot("n_nationkey"), "o": ["agg", "jsonb_object_agg", [dot("s", "s_name"), dot("s", "s_suppkey")]], "a": ["agg", "json_agg", [dot("s", "s_suppkey")]]}},
    "SELECT n_nationkey AS k, CASE WHEN count(s_suppkey) > 0 THEN '{' || string_agg('\"' || s_name || '\":' || s_suppkey, ',' ORDER BY s_suppkey) || '}' END AS o, to_json(list(s_suppkey ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL))::VARCHAR AS a FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")


add("o4_null_orders_in_arrays", {**_OF_NATION, "select": {"k": dot("n_nationkey"), **{n: ["agg", "array_agg", [dot("c", "c_custkey")], {"order_by": [[o, ["call", "nullif", dot("c", "c_mktsegment"), "BUILDING"]], dot("c", "c_custkey")]}]
                                                                                      for n, o in (("first", "asc-nulls-first"), ("last", "asc"), ("down", "desc"), ("down_last", "desc-nulls-last"))}}},
    "SELECT n_nationkey AS k, " + ", ".join(f"to_json(list(c_custkey ORDER BY nullif(c_mktsegment, 'BUILDING') {o}, c_custkey) FILTER (WHERE c_custkey IS NOT NULL))::VARCHAR AS {n}" for n, o in (("first", "ASC NULLS FIRST"), ("last", "ASC NULLS LAST"), ("down", "DESC NULLS LAST"), ("down_last", "DESC NULLS LAST")))
    + " FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")


# the function library by groups
def call(name: str, *args: Any) -> list:
    return ["call", name, *args]


add("e9_strings", {**_CUSTOMER, "select": {
    "k": dot("c_custkey"), "lt": call("ltrim", dot("c_name"), "Cus"), "rt": call("rtrim", dot("c_name"), "0"), "bt": call("btrim", dot("c_mktsegment"), "BYHE"), "asc": call("ascii", dot("c_mktsegment")), "ch": call("chr", ["+", dot("c_nationkey"), 65]),
    "oct": call("octet_length", dot("c_name")), "rp": call("rpad", dot("c_mktsegment"), 12, ".-"), "cat": call("concat", dot("c_name"), None, dot("c_nationkey")), "hex": call("to_hex", dot("c_custkey")), "over": call("overlay", dot("c_name"), "X", 2, 3),
    "ident": call("quote_ident", dot("c_name")), "sha": call("encode", call("sha256", ["::", dot("c_name"), "bytea"]), "hex"), "cut": call("substring", dot("c_name"), -2, 5), "nulls": call("num_nulls", dot("c_name"), None)}},
    "SELECT c_custkey AS k, ltrim(c_name, 'Cus') AS lt, rtrim(c_name, '0') AS rt, trim(c_mktsegment, 'BYHE') AS bt, ascii(c_mktsegment) AS asc, chr(c_nationkey + 65) AS ch, strlen(c_name)::INT AS oct, rpad(c_mktsegment, 12, '.-') AS rp, concat(c_name, NULL, c_nationkey) AS cat, "
    "lower(to_hex(c_custkey)) AS hex, left(c_name, 1) || 'X' || substr(c_name, 5) AS over, '\"' || c_name || '\"' AS ident, sha256(c_name) AS sha, left(c_name, 2) AS cut, 1 AS nulls FROM customer")
add("e9_regex", {**_CUSTOMER, "select": {
    "k": dot("c_custkey"), "once": call("regexp_replace", dot("c_name"), "(0+)", "<\\1>"), "every": call("regexp_replace", dot("c_name"), "([a-z])(0|#)?", "\\2\\1$", "g"), "any_case": call("regexp_replace", dot("c_name"), "CUST", "c", "i"), "groups": call("regexp_match", dot("c_name"), "([a-z]+)#(0*)"),
    "whole": call("regexp_match", dot("c_name"), "0[1-9]"), "split": call("regexp_split_to_array", dot("c_name"), "[#0]+"), "like": call("regexp_like", dot("c_name"), "ER#0", "i"), "n": call("regexp_count", dot("c_name"), "0")}},
    "SELECT c_custkey AS k, regexp_replace(c_name, '(0+)', '<\\1>') AS once, regexp_replace(c_name, '([a-z])(0|#)?', '\\2\\1$', 'g') AS every, regexp_replace(c_name, 'CUST', 'c', 'i') AS any_case, '[\"' || regexp_extract(c_name, '([a-z]+)#(0*)', 1) || '\",\"' || regexp_extract(c_name, '([a-z]+)#(0*)', 2) || '\"]' AS groups, "
    "CASE WHEN regexp_matches(c_name, '0[1-9]') THEN '[\"' || regexp_extract(c_name, '0[1-9]') || '\"]' END AS whole, to_json(regexp_split_to_array(c_name, '[#0]+'))::VARCHAR AS split, regexp_matches(c_name, 'ER#0', 'i') AS like, len(regexp_extract_all(c_name, '0'))::INT AS n FROM customer")
add("e9_dates", {"relation": "orders", "select": {
    "k": dot("o_orderkey"), "iso": call("to_char", dot("o_orderdate"), "YYYY-MM-DD HH24:MI:SS"), "short": call("to_char", dot("o_orderdate"), "FMDD Mon YY"), "day": call("to_char", dot("o_orderdate"), "Day|DDD"), "back": ["::", call("to_date", call("to_char", dot("o_orderdate"), "DD/MM/YYYY"), "DD/MM/YYYY"), "text"],
    "age": call("age", dot("o_orderdate"), ["::", "1990-01-31", "timestamp"]), "quarter": call("date_trunc", "quarter", dot("o_orderdate")), "dow": ["::", call("extract", "dow", dot("o_orderdate")), "int"], "iso_day": ["::", call("date_part", "isodow", dot("o_orderdate")), "int"], "doy": ["::", call("date_part", "doy", dot("o_orderdate")), "int"],
    "week": ["::", call("date_part", "week", dot("o_orderdate")), "int"], "epoch": ["::", call("date_part", "epoch", dot("o_orderdate")), "bigint"], "century": ["::", call("date_part", "century", dot("o_orderdate")), "int"]}},
    "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso, strftime(o_orderdate, '%-d %b %y') AS short, rpad(strftime(o_orderdate, '%A'), 9, ' ') || '|' || strftime(o_orderdate, '%j') AS day, o_orderdate::DATE::VARCHAR AS back, replace(age(o_orderdate, TIMESTAMP '1990-01-31')::VARCHAR, 'month', 'mon') AS age, "
    "date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, dayofweek(o_orderdate)::INT AS dow, isodow(o_orderdate)::INT AS iso_day, dayofyear(o_orderdate)::INT AS doy, week(o_orderdate)::INT AS week, epoch(o_orderdate)::BIGINT AS epoch, century(o_orderdate)::INT AS century FROM orders")
add("e9_math", {"relation": "part", "select": {
    "k": dot("p_partkey"), "cut": call("trunc", ["neg", dot("p_retailprice")]), "cut1": ["::", call("trunc", ["::", dot("p_retailprice"), "numeric(12,3)"], 1), "float8"], "div": call("div", ["neg", dot("p_partkey")], 7), "mod": call("mod", ["neg", dot("p_partkey")], 7), "sign": call("sign", ["-", dot("p_size"), 25]),
    "gcd": call("gcd", dot("p_partkey"), 36), "lcm": call("lcm", dot("p_size"), 6), "ln": call("round", call("ln", dot("p_size")), 9), "log": call("round", call("log", 2, dot("p_size")), 9), "log10": call("round", call("log", dot("p_size")), 9), "deg": call("round", call("degrees", dot("p_size")), 7), "rad": call("round", call("radians", dot("p_size")), 9),
    "sin": call("round", call("sin", dot("p_size")), 9), "atan2": call("round", call("atan2", dot("p_size"), 7), 9), "cbrt": call("round", ["||/", dot("p_size")], 9), "exp": call("round", call("exp", ["/", dot("p_size"), 10.5]), 6), "up": call("ceil", dot("p_retailprice")), "down": call("floor", dot("p_retailprice")), "pi": call("round", call("pi"), 9),
    "text": call("to_char", ["::", dot("p_retailprice"), "numeric(12,2)"], "FM9,999,990.00"), "low": call("least", dot("p_size"), 25), "abs": call("abs", ["-", dot("p_size"), 25])}},
    "SELECT p_partkey AS k, trunc(-p_retailprice) AS cut, (trunc((p_retailprice::DECIMAL(12,3)) * 10) / 10)::DOUBLE AS cut1, -(p_partkey // 7) AS div, -p_partkey % 7 AS mod, sign(p_size - 25)::DOUBLE AS sign, gcd(p_partkey, 36)::BIGINT AS gcd, lcm(p_size, 6)::BIGINT AS lcm, round(ln(p_size), 9) AS ln, round(log(2, p_size), 9) AS log, round(log10(p_size), 9) AS log10, "
    "round(degrees(p_size), 7) AS deg, round(radians(p_size), 9) AS rad, round(sin(p_size), 9) AS sin, round(atan2(p_size, 7), 9) AS atan2, round(cbrt(p_size), 9) AS cbrt, round(exp(p_size / 10.5::DOUBLE), 6) AS exp, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS down, round(pi(), 9) AS pi, "
    "format('{:,.2f}', p_retailprice::DECIMAL(12,2)::DOUBLE) AS text, least(p_size, 25) AS low, abs(p_size - 25) AS abs FROM part")
_LIST = ["array", dot("c_nationkey"), 7, dot("c_nationkey")]
add("e9_arrays", {**_CUSTOMER, "select": {
    "k": dot("c_custkey"), "app": call("array_append", _LIST, 9), "pre": call("array_prepend", 9, _LIST), "cat": call("array_cat", _LIST, ["array", 1]), "pos": call("array_position", _LIST, 7), "all": call("array_positions", _LIST, 7), "rem": call("array_remove", _LIST, 7), "n": call("array_length", _LIST, 1),
    "text": call("array_to_string", _LIST, "+"), "rep": call("array_replace", _LIST, 7, 70), "cut": ["slice", _LIST, 2, 3], "less": call("trim_array", _LIST, 2), "words": call("string_to_array", dot("c_name"), "#")}},
    "SELECT c_custkey AS k, to_json(list_append(l, 9))::VARCHAR AS app, to_json(list_prepend(9, l))::VARCHAR AS pre, to_json(list_concat(l, [1]))::VARCHAR AS cat, list_position(l, 7)::BIGINT AS pos, to_json([i FOR i IN [1, 2, 3] IF l[i] = 7])::VARCHAR AS all, to_json([x FOR x IN l IF x <> 7])::VARCHAR AS rem, 3 AS n, array_to_string(l, '+') AS text, "
    "to_json([CASE WHEN x = 7 THEN 70 ELSE x END FOR x IN l])::VARCHAR AS rep, to_json(l[2:3])::VARCHAR AS cut, to_json(l[1:1])::VARCHAR AS less, to_json(string_split(c_name, '#'))::VARCHAR AS words FROM (SELECT *, [c_nationkey, 7, c_nationkey] AS l FROM customer)")
add("e9_json", {"relation": "events", "select": {
    "id": dot("event_id"), "obj": call("jsonb_build_object", "a", dot("event_id"), "b", dot("event_type"), "c", None, "d", True), "arr": call("jsonb_build_array", dot("event_id"), dot("event_type")), "path": call("jsonb_extract_path_text", dot("props"), "k"), "kind": call("jsonb_typeof", dot("props")), "keys": call("jsonb_object_keys", dot("props")),
    "set": call("jsonb_set", dot("props"), "{z}", call("to_jsonb", dot("event_type"))), "both": ["||", ["::", dot("props"), "jsonb"], call("jsonb_build_object", "y", 1)], "n": call("jsonb_array_length", call("jsonb_build_array", 1, dot("event_id")))}},
    "SELECT event_id AS id, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\",\"c\":null,\"d\":true}' AS obj, '[' || event_id || ',\"' || event_type || '\"]' AS arr, props ->> '$.k' AS path, 'object' AS kind, '[\"k\"]' AS keys, '{\"k\":' || (props ->> '$.k') || ',\"z\":\"' || event_type || '\"}' AS set, "
    "'{\"k\":' || (props ->> '$.k') || ',\"y\":1}' AS both, 2 AS n FROM events")


# more writes
def _answer(request: dict, schema: str) -> Callable[[Session], DataFrame]:
    """What a write answers, numbered in the order of its rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(s: Session) -> DataFrame:
        rows = s.execute(request)
        plain = lambda v: json.dumps(v, separators=(",", ":")) if isinstance(v, (list, dict)) else v
        return s.spark.createDataFrame([(i, *(plain(r[n]) for n in names)) for i, r in enumerate(rows)], f"row int, {schema}")
    return run


add_function("s8_read_back", _answer({"query": {**_REGION, "where": ["=", dot("r_name"), "none"], "limit": 0}, "data": [_PAYLOAD[1], _PAYLOAD[0]]}, "r_regionkey long, r_name string, n string"),
             "SELECT 0 AS row, 7::BIGINT AS r_regionkey, 'SEVEN' AS r_name, '[]' AS n UNION ALL SELECT 1, 1, 'NEW', '[{\"n_name\":\"ONE\",\"n_nationkey\":1},{\"n_name\":\"NINETY\",\"n_nationkey\":90}]'")
_COUNTED = {**_REGION, "select": {"r_regionkey": dot("r_regionkey"), "r_name": dot("r_name"), "n": ["agg", "count", [dot("n")]], "orders": ["agg", "count", [dot("n")], {"filter": [">", dot("n", "n_nationkey"), 10]}]}}
add_function("s9_written_row_scope", _answer({"query": _COUNTED, "data": [{"r_regionkey": 2, "r_name": "TWO"}, {"r_regionkey": 70, "r_name": "NEW"}]}, "r_regionkey long, r_name string, n long, orders long"),
             "SELECT 0 AS row, 2::BIGINT AS r_regionkey, 'TWO' AS r_name, count(*)::BIGINT AS n, (count(*) FILTER (WHERE n_nationkey > 10))::BIGINT AS orders FROM nation WHERE n_regionkey = 2 UNION ALL VALUES (1, 70, 'NEW', 0, 0)")
add_function("o9_payload_order", _answer({"query": {**_NATION, "write_mode": "upsert", "select": _NATIONS, "order_by": [dot("n_name")]}, "data": [{"n_nationkey": k, "n_name": f"N{k}"} for k in (9, 60, 3, 55, 4)]}, "n_nationkey long, n_name string"),
             "SELECT * FROM (VALUES (0, 9, 'N9'), (1, 60, 'N60'), (2, 3, 'N3'), (3, 55, 'N55'), (4, 4, 'N4')) t(row, n_nationkey, n_name)")


def _stats(request: dict) -> Callable[[Session], DataFrame]:
    return lambda s: s.spark.createDataFrame([(".".join(x["path"]), x["submitted"], x["inserted"], x["updated"], x["deleted"]) for x in s.execute({**request, "stats": True, "returns": "none"})["stats"]], "path string, submitted long, inserted long, updated long, deleted long")


_MODES = {"relation": "nation", "join": {"r": {"relation": "region", "on": {"r_regionkey": "n_regionkey"}}, "s": {"relation": "supplier", "on": {"s_nationkey": "n_nationkey"}, "select": {"s_suppkey": dot("s_suppkey"), "s_name": dot("s_name")}}}}
add_function("w1_default_modes", _stats({"query": {**_MODES, "select": {**_NATIONS, "r": dot("r"), "s": dot("s")}}, "data": [{"n_nationkey": 80, "n_name": "EIGHTY", "r": {"r_regionkey": 1, "r_name": "ONE"}, "s": [{"s_suppkey": 1, "s_name": "S1"}, {"s_suppkey": 1000000, "s_name": "S2"}]}, {"n_nationkey": 81, "r": {"r_regionkey": 50, "r_name": "FIFTY"}}]}),
             "SELECT * FROM (VALUES ('', 2, 2, 0, 0), ('r', 2, 1, 1, 0), ('s', 2, 1, 1, 0)) t(path, submitted, inserted, updated, deleted)")
_PROFILE = {"relation": "profile", "select": {"id": dot("id"), "segment": dot("who", "segment"), "nation": dot("nation")}}
_PROFILES = [{"id": 1, "segment": "A"}, {"id": 2, "segment": None, "nation": 3}, {"id": 3, "nation": None}, {"id": 100000000, "segment": "NEW"}, {"id": 100000001, "nation": None}]
add_function("w16_absent_null_and_default", _after("profile", {"query": {**_PROFILE, "write_mode": "upsert"}, "data": _PROFILES}),
             "SELECT c_custkey AS id, to_json(struct_pack(name := c_name, segment := CASE c_custkey WHEN 1 THEN 'A' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE c_mktsegment END))::VARCHAR AS who, CASE c_custkey WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN NULL ELSE c_nationkey END AS nation FROM customer "
             "UNION ALL VALUES (100000000, '{\"name\":null,\"segment\":\"NEW\"}', 0), (100000001, NULL, NULL)")
add_function("w20_sub_fields", _after("profile", {"query": {**_PROFILE, "write_mode": "update-existing"}, "data": _PROFILES}),
             "SELECT c_custkey AS id, to_json(struct_pack(name := c_name, segment := CASE c_custkey WHEN 1 THEN 'A' WHEN 2 THEN NULL ELSE c_mktsegment END))::VARCHAR AS who, CASE c_custkey WHEN 2 THEN 3 WHEN 3 THEN NULL ELSE c_nationkey END AS nation FROM customer")
add_function("w21_flat_write", _answer({"query": {**_NATION, "select": {"k": dot("n_nationkey"), "n": dot("n_name")}}, "data": [{"k": 90, "n": "A"}, {"k": 91, "n": "B"}]}, "k long, n string"), "SELECT * FROM (VALUES (0, 90, 'A'), (1, 91, 'B')) t(row, k, n)")
add_function("w22_many_rows", _after("nation", {"query": {**_NATION, "write_mode": "upsert", "select": _NATIONS}, "data": [{"n_nationkey": k, "n_name": f"N{k}", "n_regionkey": k % 5} for k in range(10, 3010)], "returns": "none", "stats": True}),
             "SELECT * FROM nation WHERE n_nationkey < 10 UNION ALL SELECT k::INT, 'N' || k, (k % 5)::INT FROM range(10, 3010) r(k)")


def _undone(s: Session) -> DataFrame:
    """A sequence that fails late leaves nothing of what went before."""
    try:
        s.execute([{"query": {"relation": "region"}, "data": [{"r_regionkey": 8, "r_name": "EIGHT"}]}, {"query": {"relation": "region", "write_mode": "delete", "where": ["=", dot("r_regionkey"), 1]}}, {"query": _NATION, "data": [{"n_nationkey": 3}]}])
    except QueryError:
        return s.frame({"relation": "region"})
    raise AssertionError("a taken key was inserted")


add_function("e9_atomicity", _undone, "SELECT * FROM region")


def _framed(mode: str, keys: str) -> Callable[[Session], DataFrame]:
    """Orders written from a frame, which never passes the driver."""
    def run(s: Session) -> DataFrame:
        rows = s.frame({"relation": "orders", "where": [">", dot("o_totalprice"), 300000], "select": {"o_orderkey": ["*", dot("o_orderkey"), 2], "o_orderstatus": "X", "o_custkey": 1}})
        s.execute({"query": {"relation": "orders", "write_mode": mode, "select": {k: dot(k) for k in keys.split()}}, "data": rows, "returns": "none", "stats": True})
        return s.frame({"relation": "orders", "select": ["*~"]})
    return run


add_function("w22_frame_upsert", _framed("upsert", "o_orderkey o_custkey o_orderstatus"),
             "WITH n AS (SELECT o_orderkey * 2 AS k FROM orders WHERE o_totalprice > 300000) SELECT o_orderkey, CASE WHEN k IS NULL THEN o_custkey ELSE 1 END AS o_custkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'X' END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders LEFT JOIN n ON k = o_orderkey "
             "UNION ALL SELECT k, 1, 'X', NULL, NULL, NULL FROM n WHERE k NOT IN (SELECT o_orderkey FROM orders)")
add_function("w22_frame_update", _framed("update-existing", "o_orderkey o_orderstatus"),
             "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT o_orderkey * 2 FROM orders WHERE o_totalprice > 300000) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their largest orders, the orders' lines summed, and their nation's name."""
    return session(spark, sf_dir).frame({
        "relation": "customer", "order_by": [["desc", dot("c_acctbal")]], "limit": 50,
        "join": {
            "nation": {"relation": "nation", "on": {"n_nationkey": "c_nationkey"}},
            "orders": {"relation": "orders", "on": {"o_custkey": "c_custkey"}, "order_by": [["desc", dot("o_totalprice")]], "limit": 3,
                       "join": {"lines": {"relation": "lineitem", "on": {"l_orderkey": "o_orderkey"}}},
                       "select": {"key": dot("o_orderkey"), "price": dot("o_totalprice"), "lines": ["agg", "count", [dot("lines")]], "quantity": ["agg", "sum", [dot("lines", "l_quantity")]]}}},
        "select": {"customer": dot("c_name"), "nation": dot("nation", "n_name"), "orders": dot("orders")},
    })
