"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to ``epochs`` times. A
document's virtual finish time is its queue's cumulative size divided by the source's target; one
merged order by finish time serves all queues in proportion, and it is cut at the total budget.

Orders are global range sorts, never one task: sampled splitters deal rows to partitions, each
partition sums its own rows one by one, and only the partitions' totals, one row each, are summed up
in one place. So neither a hot source, nor a hot or null id, nor many sources gather anywhere. The
merged order needs no more than its cut: a histogram of virtual time, of at most ``TIME_RANGES`` rows,
tells the range of time that holds it, and that range alone is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, n_words, scratch

TIME_RANGES = 8192  # ranges of virtual time below 2, where the cut can be


def running(df: DataFrame, order: list[Column | str], *sums: str) -> DataFrame:
    """Adds _at, the number of each row from 1 in the global order, and _upto_<c>, the sum of every column
    c of ``sums`` up to the row. The order should be total; equal rows follow each other in any order."""
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    # one row for every partition of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead")
    parts = parts.select("_part", ahead("_n"), *(ahead(f"_sum_{c}") for c in sums))
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(parts), "_part").select(
        *df.columns, (F.col("_n_ahead") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).alias("_at"),
        *((F.col(f"_sum_{c}_ahead") + F.sum(c).over(inside)).alias(f"_upto_{c}") for c in sums))


def targets(sources: DataFrame, cap: float = 3.0, budget: float = 1.0) -> DataFrame:
    """Adds ``target`` (double) to rows (source, source_size, weight, ord), one per source.

    Sources share ``budget`` times all sizes by weight; a target above ``cap`` times its source's
    size stops there and the excess is shared again by weight until none is above. In order of size
    by weight that is one pass: the first source that its fair share of what is left fits sets the
    level of all that follow.
    """
    total = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    most = cap * F.col("source_size")
    if not total["size"]:
        return sources.withColumn("target", most)
    order = running(sources.withColumn("_fair", F.col("source_size") / F.col("weight")), ["_fair", "ord"], "source_size", "weight")
    left = F.lit(total["weight"]) - F.col("_upto_weight") + F.col("weight")
    order = order.withColumn("_level", (F.lit(total["size"]) * F.lit(budget) - cap * (F.col("_upto_source_size") - F.col("source_size"))) / left)
    level = order.where(F.col("_level") * F.col("weight") <= most).agg(F.min_by("_level", "_at")).first()[0]
    return sources.withColumn("target", most if level is None else F.least(most, F.lit(level) * F.col("weight")))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, budget: float = 1.0,
        seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the ``carry`` columns, doc_id, source, size, source_size, target, taken.

    ``size`` is the number of words (0 for null and empty texts, of which nothing can be taken);
    ``taken`` is size times the passes of the document that the mix admits, 0 to ``epochs``. Sources
    in order of code points, null last and one source of its own, weigh ``weights``, repeating. The
    shuffle is keyed on the id (on the text where the id is null), then on the text, so reruns agree;
    rows that share both are documents of their own, which only ``carry`` tells apart. An empty table
    gives an empty result.
    """
    with scratch(documents.sparkSession):
        return _mixed(documents, weights, epochs, budget, seed, doc_id, text, source, carry)


def _mixed(documents: DataFrame, weights: tuple[int, ...], epochs: int, budget: float, seed: str, doc_id: str, text: str, source: str, carry: tuple[str, ...]) -> DataFrame:
    """The result reads the table that is kept, no others."""
    tie = F.xxhash64(F.col(text))
    base = materialize(documents.select(
        *(F.col(c).alias(f"_carry_{c}") for c in carry), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), tie.alias("tie"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), tie.cast("string"))))).alias("key"),
    ), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = materialize(running(sizes, [F.col("source").asc_nulls_last()], "source_size"), "placed")
    weight = F.element_at(F.lit(list(weights)), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    known = placed.select("source", "source_size", F.col("_at").alias("ord"), weight.alias("weight"), (F.col("_upto_source_size") - F.col("source_size")).alias("before"))
    sources = materialize(targets(known, float(epochs), budget), "sources").drop("weight")
    few = broadcast_if(sources.withColumnRenamed("source", "of"), sources.count(), 256)
    rows = base.join(few, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("row", F.monotonically_increasing_id())
    queue = running(rows, ["ord", "key", F.col("doc_id").asc_nulls_last(), "tie", "row"], "size")
    queued = materialize(queue.select(
        *(f"_carry_{c}" for c in carry), "doc_id", "source", "size", "source_size", "target", "ord", (F.col("_upto_size") - F.col("before")).alias("upto")), "queues", keep=True)

    finish = lambda p: (F.col("source_size") * F.lit(p) + F.col("upto")).cast("double") / F.col("target")
    slot = lambda f: F.least(F.floor(f * (TIME_RANGES // 2)), F.lit(TIME_RANGES)).cast("int")
    passes = queued.where("size > 0").select("doc_id", "size", "ord", "upto", F.explode(F.array(*[finish(p) for p in range(epochs)])).alias("finish")).withColumn("slot", slot(F.col("finish")))
    total = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"] * budget
    admitted, cut = 0, None
    for at, words in sorted(tuple(r) for r in passes.groupBy("slot").agg(F.sum("size")).collect()):
        if admitted + words > total:
            cut = at
            break
        admitted += words
    if cut is None:
        taken = F.lit(epochs) * F.col("size")
    else:
        # a total order: in one queue no two passes end at the same word
        order = [("finish", F.col("finish")), ("none", F.col("doc_id").isNull()), ("doc_id", F.col("doc_id")), ("ord", F.col("ord")), ("upto", F.col("upto"))]
        inside = running(passes.where(F.col("slot") == cut), [c for _, c in order], "size").where(F.col("_upto_size") + F.lit(admitted) <= F.lit(total))
        last = inside.agg(F.max(F.struct(*(c.alias(k) for k, c in order))).alias("last")).first()["last"]

        def served(f: Column) -> Column:
            if last is None:
                return F.lit(False)
            out = F.lit(True)
            for k, c in reversed(order):
                c = f if k == "finish" else c
                least = c < F.lit(last[k]) if last[k] is not None else F.lit(False)
                out = F.coalesce(least, F.lit(False)) | (c.eqNullSafe(F.lit(last[k])) & out)
            return out

        taken = F.lit(0)
        for p in range(epochs):
            f = finish(p)
            taken = taken + F.when((F.col("size") > 0) & ((slot(f) < cut) | ((slot(f) == cut) & served(f))), F.col("size")).otherwise(0)
    return queued.select(*(F.col(f"_carry_{c}").alias(c) for c in carry), "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
