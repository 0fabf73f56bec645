"""The catalog of the analytical tables: keys, references, functions and computed fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import Aggregate, Catalog, Computed, Field, ForeignKey, Function, Parameter, Relation, parquet


def catalog(sf_dir: str) -> Catalog:
    def declared(name: str, key: tuple[str, ...] = (), refs: dict[str, tuple[str, str]] | None = None, **more) -> Relation:
        keys = tuple(ForeignKey((c,), t, (tc,)) for c, (t, tc) in (refs or {}).items())
        return Relation(name, parquet(f"{sf_dir}/{name}.parquet"), key, foreign_keys=keys, **more)

    relations = [
        declared("region", ("r_regionkey",), unique={"region_name": ("r_name",)}),
        declared("nation", ("n_nationkey",), {"n_regionkey": ("region", "r_regionkey")}, unique={"nation_name": ("n_name",)}),
        declared("customer", ("c_custkey",), {"c_nationkey": ("nation", "n_nationkey")}, computed={
            "c_label": Computed(lambda c: F.concat(c["c_name"], F.lit(" ("), c["c_mktsegment"], F.lit(")"))),
            "c_orders": Computed(relation="orders", on=(("o_custkey", "c_custkey"),)),
        }),
        declared("supplier", ("s_suppkey",), {"s_nationkey": ("nation", "n_nationkey")}),
        declared("part", ("p_partkey",)),
        declared("orders", ("o_orderkey",), {"o_custkey": ("customer", "c_custkey")}, computed={
            "o_large": Computed(lambda c: c["o_totalprice"] >= 300000)}),
        declared("lineitem", (), {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
        declared("events", ("event_id",), {"user_id": ("customer", "c_custkey")}, fields={"props": Field(json=True)}),
        declared("documents", ("doc_id",)),
        declared("labels", ("doc_id",), {"doc_id": ("documents", "doc_id")}),
        declared("embeddings", ("vec_id",)), declared("pages", ("page_id",)), declared("benchmark", ("item_id",)),
        declared("conversations", ("conv_id", "turn")),
        Relation("big_orders", lambda spark: spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice >= 200000"), view=True,
                 foreign_keys=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),)),
        Relation("profile", lambda spark: spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who"), F.col("c_nationkey").alias("nation")), ("id",),
                 fields={"who": Field(), "nation": Field(default=0, has_default=True)}, indexes=()),
        Relation("region", lambda spark: spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey < 2"), ("r_regionkey",), schema="few"),
    ]
    functions = [
        Function("orders_of", (Parameter("custkey", "bigint"), Parameter("least", "double", 0.0, True)),
                 "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                 "SELECT * FROM {orders} WHERE o_custkey = custkey AND o_totalprice >= least", table=True, relation="orders"),
        Function("order_counts", (Parameter("status", "string"),), "custkey bigint, n bigint",
                 "SELECT o_custkey, count(*) FROM {orders} WHERE o_orderstatus = status GROUP BY o_custkey", table=True),
        Function("label", (Parameter("a", "string"),), "string", "upper(a)"),
        Function("label", (Parameter("a", "string"), Parameter("b", "string")), "string", "concat(a, '/', b)"),
        Function("joined", (Parameter("by", "string"), Parameter("parts", "array<string>", variadic=True)), "string", "array_join(parts, by)"),
        Function("with_tax", (Parameter("price", "double"), Parameter("rate", "double", 0.2, True)), "double", "price * (1 + rate)"),
    ]
    return Catalog(relations, functions, aggregates=[Aggregate("spread", lambda x: F.max(x) - F.min(x))])
