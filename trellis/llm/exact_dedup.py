"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (leading characters, SHA-256, id) of the normalised
text and sorted outside memory by (leading characters, SHA-256, text, id), so that equal texts are
adjacent, the row to keep first. A pass over each sorted partition compares every text in full with its
neighbour; that alone tells runs of equal texts apart, and the first row of a run names what stays. The
splitters are of bounded size however long texts are, and the id in the range key lets thousands of
copies of one text spread over many partitions. So the runs at either end of a partition, and only they,
may go on in others: they send their text, once each, and meet by the text itself. The digest orders
rows and is part of the result; it decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize

LEAD = 16  # leading characters in the range key
RUNS = 1 << 32  # runs of one partition, at most
SENT = 16 << 20  # characters of repeated texts sent on at a time


def _starts(column: pa.Array, before) -> np.ndarray:
    """Whether each value differs from the one before it (``before``: of the last batch)."""
    shifted = pa.concat_arrays([pa.array([before], column.type), column.slice(0, len(column) - 1)])
    return pc.fill_null(pc.not_equal(column, shifted), True).to_numpy(zero_copy_only=False)


def _closed(rows: pa.RecordBatch, starts: np.ndarray, first_run: int, open_: bool, text: pa.Array) -> pa.RecordBatch:
    """Rows of whole runs; ``open_``: other partitions may go on with them."""
    first = np.flatnonzero(starts)
    run = np.cumsum(starts) - 1
    size = np.diff(np.append(first, len(starts)))
    own = [rows.column("doc_id").take(pa.array(first[run])), pa.array(size[run]), pa.array(first_run + run), pa.array(starts), pa.array(np.full(len(starts), open_)), text]
    return pa.RecordBatch.from_arrays([*rows.columns, *own], [*rows.schema.names, "keep_id", "size", "run", "first", "open", "text"])


def _runner(whole: bool):
    """Runs of equal neighbours among sorted rows (doc_id, text, sha, ...). ``whole``: every row gets its
    text back, else only those where an open run begins."""
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * RUNS
        last_text = last_sha = None
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []  # rows of the last digest, without their texts
        texts: list[str] = []  # of its runs
        at_start = True

        def hold(rows: pa.RecordBatch, starts: np.ndarray, text: pa.Array) -> None:
            held.append((rows, starts))
            texts.extend(text[i].as_py() for i in np.flatnonzero(starts).tolist())

        def close(open_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not held:
                return
            starts = np.concatenate([s for _, s in held])
            rows = pa.Table.from_batches([r for r, _ in held]).combine_chunks().to_batches()[0]
            done = _closed(rows, starts, number, open_, pa.nulls(len(starts), pa.string()))
            run = np.cumsum(starts) - 1
            step = len(starts) if not whole else max(1, SENT // max(1, *map(len, texts)))
            for a in range(0, len(starts), step):
                if whole:
                    text = pa.array(texts, pa.string()).take(pa.array(run[a: a + step]))
                else:
                    text = pa.array([texts[r] if open_ and s else None for r, s in zip(run.tolist(), starts.tolist(), strict=True)], pa.string())
                part = done.slice(a, step)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], part.schema.names)
            number += int(starts.sum())
            held.clear()
            texts.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text, sha = batch.column("text"), batch.column("sha")
            rows = batch.drop_columns(["text"])
            digest = _starts(sha, last_sha)
            run = digest | _starts(text, last_text)
            last_text, last_sha = text[n - 1].as_py(), sha[n - 1].as_py()
            at = np.flatnonzero(digest)
            # rows before a go on with the last digest, those from b begin the next
            a, b = (int(at[0]), int(at[-1])) if len(at) else (n, n)
            if a:
                hold(rows.slice(0, a), run[:a], text.slice(0, a))
            if not len(at):
                continue
            if held:
                yield from close(at_start)
                at_start = False
            elif at_start and b > a:
                # the partition's first digest ends inside this batch
                hold(rows.slice(0, int(at[1])), run[: at[1]], text.slice(0, int(at[1])))
                yield from close(True)
                a, at_start = int(at[1]), False
            if b > a:
                part = text.slice(a, b - a) if whole else pa.nulls(b - a, pa.string())
                yield _closed(rows.slice(a, b - a), run[a:b], number, False, part)
                number += int(run[a:b].sum())
            hold(rows.slice(b), run[b:], text.slice(b))
        yield from close(True)

    return run_


def exact_duplicates(documents: DataFrame, keep: str = "min", normalise=None, doc_id: str = "doc_id", text: str = "text",
                     digest=lambda c: F.sha2(c, 256), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256, then the ``carry``
    columns as they are (those named like a result are left out).

    Texts are equal when identical after ``normalise`` (a function of Columns; default: no change);
    null counts as empty. Of equal texts one row stays, of the smallest id (``keep="max"``: the largest);
    which of several rows of that id is not told. Repeated rows count in group_size; a row with a null id
    stays only in a group without other ids. Empty table: empty result.
    """
    raw: Column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    norm = normalise(raw) if normalise else raw
    carry = tuple(c for c in carry if c.lower() not in ("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    # a carried text that is the normalised one travels once; of it only whether it was null
    whole = text in carry and normalise is None and dict(documents.dtypes)[text] == "string"
    beside = [(F.col(text).isNull() if whole and c == text else F.col(c)).alias(f"carry_{i}") for i, c in enumerate(carry)]
    keyed = documents.select(F.col(doc_id).alias("doc_id"), norm.alias("text"), *beside).select(
        "doc_id", "text", digest(F.col("text")).alias("sha"), *(f"carry_{i}" for i in range(len(carry))), F.substring("text", 1, LEAD).alias("lead"))
    order = F.col("doc_id").asc_nulls_last() if keep == "min" else F.col("doc_id").desc_nulls_last()
    sorted_rows = keyed.repartitionByRange("lead", "sha", order).sortWithinPartitions("lead", "sha", "text", order).drop("lead")
    kinds = ", ".join(f"{n} {k}" for n, k in sorted_rows.dtypes if n != "text")
    rows = materialize(sorted_rows.mapInArrow(
        _runner(whole), f"{kinds}, keep_id {dict(keyed.dtypes)['doc_id']}, size long, run long, first boolean, open boolean, text string"), "runs")
    back = [(F.when(~F.col(f"carry_{i}"), F.col("text")) if whole and c == text else F.col(f"carry_{i}")).alias(c) for i, c in enumerate(carry)]
    out = lambda df, keep_id, size, kept: df.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), *back)
    closed = out(rows.where("NOT open"), F.col("keep_id"), F.col("size"), F.col("first"))
    # at most two runs a partition, and those of a colliding digest
    ends = rows.where("open AND first").select("text", "run", "size", "keep_id")
    known = F.col("keep_id").isNotNull()
    best = F.max(F.struct(known.alias("known"), "keep_id", (-F.col("run")).alias("run"))) if keep == "max" else F.min(F.struct((~known).alias("known"), "keep_id", "run"))
    met = ends.groupBy("text").agg(best.alias("best"), F.sum("size").alias("total")).select("text", F.col("best.keep_id").alias("of_all"), F.abs("best.run").alias("own"), "total")
    ends = materialize(ends.select("text", "run").join(met, "text").select("run", "of_all", "own", "total"), "ends")
    open_rows = rows.where("open").join(broadcast_if(ends, ends.count(), 40), "run")
    return closed.unionByName(out(open_rows, F.col("of_all"), F.col("total"), F.col("first") & (F.col("run") == F.col("own"))))
