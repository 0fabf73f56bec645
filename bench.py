"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

nested aggregates, text search, arrays, wide reads, and the writes. Each is run once cold and
``RUNS`` times warm over its whole result; the median of the warm runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from trellis.plans.session import Session
from trellis.queries import _NATIONS, _PAYLOAD, _REGION, dot
from trellis.sources.tables import catalog

RUNS = 3
ORDERS = {"relation": "orders", "on": {"o_custkey": "c_custkey"}}
READS = {
    "pk_lookup": {"relation": "orders", "where": ["=", dot("o_orderkey"), 777]},
    "filter_sort_paginate": {"relation": "orders", "where": [">=", dot("o_totalprice"), 100000], "order_by": [["desc", dot("o_totalprice")]], "limit": 20, "offset": 40},
    "boolean_filter_like": {"relation": "part", "where": ["and", ["like", dot("p_name"), "%1%"], ["or", ["<", dot("p_size"), 10], ["not", ["=", dot("p_brand"), "Brand#1"]]]]},
    "two_to_one_embeds": {"relation": "lineitem", "limit": 1000, "join": {"o": {"relation": "orders", "on": {"o_orderkey": "l_orderkey"}}, "p": {"relation": "part", "on": {"p_partkey": "l_partkey"}}}},
    "one_to_many_embed": {"relation": "customer", "join": {"orders": ORDERS}},
    "limited_parent_embed": {"relation": "customer", "order_by": [["desc", dot("c_acctbal")]], "limit": 20, "join": {"orders": ORDERS}},
    "deep_nested_embed": {"relation": "region", "join": {"n": {"relation": "nation", "on": {"n_regionkey": "r_regionkey"}, "join": {"c": {"relation": "customer", "on": {"c_nationkey": "n_nationkey"}, "join": {"o": {**ORDERS, "select": dot("o_orderkey")}}, "select": {"c": dot("c_custkey"), "o": dot("o")}}}}}},
    "aggregate_count": {"relation": "customer", "join": {"o": ORDERS}, "select": {"c": dot("c_custkey"), "n": ["agg", "count", [dot("o")]], "total": ["agg", "sum", [dot("o", "o_totalprice")]], "open": ["agg", "count", [dot("o", "o_orderkey")], {"filter": ["=", dot("o", "o_orderstatus"), "O"]}]}},
    "top_per_parent": {"relation": "customer", "join": {"o": {**ORDERS, "order_by": [["desc", dot("o_totalprice")]], "limit": 3}}},
    "full_text": {"relation": "documents", "where": ["@@", dot("text"), "the that"], "select": {"id": dot("doc_id"), "n": dot("n_chars")}},
    "array_filter": {"relation": "embeddings", "where": ["any", ">", 0.35, dot("embedding")], "select": {"k": dot("vec_id")}},
    "json_field": {"relation": "events", "select": {"id": dot("event_id"), "k": ["->>", dot("props"), "k"]}},
    "scalar_hops": {"relation": "lineitem", "join": {"o": {"relation": "orders", "on": {"o_orderkey": "l_orderkey"}, "join": {"c": {"relation": "customer", "on": {"c_custkey": "o_custkey"}}}}}, "where": [">", dot("o", "c", "c_acctbal"), 9000], "select": {"k": dot("l_orderkey"), "c": dot("o", "c", "c_name")}},
    "wide_unscoped": {"relation": "lineitem"},
}
WRITES = {
    "insert_one": {"query": {"relation": "nation", "select": _NATIONS}, "data": [{"n_nationkey": 50, "n_name": "A", "n_regionkey": 1}]},
    "update_by_pk": {"query": {"relation": "orders", "write_mode": "update", "where": ["=", dot("o_orderkey"), 5], "select": {"o_orderkey": dot("o_orderkey"), "o_orderstatus": dot("o_orderstatus")}}, "data": {"o_orderstatus": "X"}},
    "delete_by_pk": {"query": {"relation": "orders", "write_mode": "delete", "where": ["=", dot("o_orderkey"), 5]}},
    "bulk_insert_100": {"query": {"relation": "nation", "select": _NATIONS}, "data": [{"n_nationkey": 100 + i, "n_name": f"N{i}", "n_regionkey": i % 5} for i in range(100)]},
    "nested_write": {"query": _REGION, "data": _PAYLOAD},
    "upsert": {"query": {"relation": "nation", "write_mode": "upsert", "select": _NATIONS}, "data": [{"n_nationkey": i, "n_name": f"N{i}", "n_regionkey": i % 5} for i in range(50)]},
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    s = Session(spark, catalog(sf_dir))  # as a server holds it

    def read(q):
        s.frame(q).write.format("noop").mode("overwrite").save()

    def write(q):
        s.execute({**q, "rollback": True})

    times: dict[str, float] = {}
    for run, queries in ((read, READS), (write, WRITES)):
        for name, q in queries.items():
            each = []
            for _ in range(RUNS + 1):
                began = time.perf_counter()
                run(q)
                each.append(time.perf_counter() - began)
            times[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "spark": spark.version, "cpus": int(cpus), "runs": RUNS}))


if __name__ == "__main__":
    sys.exit(main())
