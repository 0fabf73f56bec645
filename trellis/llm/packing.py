"""Packing documents into token sequences: bound-certified best-fit decreasing.

Documents become pieces of at most ``length`` tokens; only longer documents are cut. Pieces are dealt
to partitions of bounded size and packed there by best fit decreasing (the fullest sequence that
takes a piece, longest pieces first). Dual feasible functions give each partition a lower bound on
the sequences that any packing of its pieces needs. A partition that meets its bound is certified and
gives up only the remainder in its least full sequences; one with a gap gives up its least full
sequences, of up to half of its pieces. What is given up meets the same of other partitions, in half
as many partitions, and is packed again by best fit decreasing, until nothing is given up or all of
it meets in one partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .tokens import tokenizer

PARTITION = 20_000  # pieces packed by one task


def tokenize(documents: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, row, piece, start, length, ids_crc32.

    A document's ids are those of its text (null: empty), then ``end_id``. ``row`` tells rows of one
    id apart. Empty table: empty result.
    """
    kind = dict(documents.dtypes)[doc_id]
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            at, piece, start, size, crc = [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                ids = np.append(own.ids(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), length)):
                    part = ids[s: s + length]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item. Open bins are kept by room; equal rooms are taken last opened first."""
    bins = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # distinct rooms that open bins have, sorted
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, opened
            opened += 1
        bins[i] = b
        if left := room - size:
            if not with_room[left]:
                insort(rooms, left)
            with_room[left].append(b)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by two families of dual feasible functions.

    The first, for each threshold t up to half: sizes above capacity - t count as whole, below t as
    nothing, others as they are. The second, for each k: sizes times (k + 1) count their whole parts,
    of k, where they are not whole already. Both are superadditive up to the capacity, so that no
    sequence holds more than 1.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    below = np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    whole = number[-1] - number[capacity - t]
    best = int(np.max(whole * capacity + (total[capacity - t] - below) + capacity - 1) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        # k * capacity times the function's value
        value = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def _given_up(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins of a partition are packed again with others': the least full ones, never a full one,
    and never more than half of the pieces. With a gap to the bound as many as that allows; a certified
    partition gives those that hold half of its free room, a remainder that may fit another's."""
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < capacity]
    given = np.zeros(len(fill), bool)
    if not len(order):
        return given
    if len(fill) == lower_bound(lengths, capacity):
        room = np.cumsum(capacity - fill[order])
        order = order[: int(np.searchsorted(room, room[-1] / 2)) + 1]
    pieces = np.cumsum(np.bincount(bins)[order])
    given[order[: int(np.searchsorted(pieces, len(lengths) // 2, side="right"))]] = True
    return given


def _pack(capacity: int, last: bool, names: dict[str, str]):
    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("length", "descending"), *((c, "ascending") for c in ("doc_id", "row", "piece"))]))
        lengths = group["length"].to_numpy().astype(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        open_bins = np.zeros(int(bins.max()) + 1, bool) if last else _given_up(bins, lengths, capacity)
        start = np.zeros(len(lengths), np.int64)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[by_bin])
        first = np.concatenate([[True], bins[by_bin][1:] != bins[by_bin][:-1]])
        base = np.maximum.accumulate(np.where(first, ends - lengths[by_bin], 0))
        start[by_bin] = ends - lengths[by_bin] - base
        for name, values in (("bin", bins), ("offset", start), ("open", open_bins[bins])):
            group = group.append_column(names[name], pa.array(values))
        return group

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, partition: int = PARTITION) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, row, piece, length, and any other columns, which stay;
    those named sequence_id or offset are replaced).

    Lengths are 1 to ``capacity``. Pieces are dealt by a hash of (doc_id, row, piece), so neither a hot nor
    a null id gathers them. A round leaves at most half of the pieces and half of the partitions, so there
    are about log2 of the partitions rounds, each of partitions of bounded size. Sequence ids are any
    distinct numbers. Equal rows are packed each; empty table: empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    names = {n: fresh(columns, n) for n in ("group", "bin", "offset", "open")}
    group, number, is_open = (F.col(names[n]) for n in ("group", "bin", "open"))
    kinds = ", ".join(f"`{n}` {k}" for n, k in [*pieces.dtypes, *zip((names[n] for n in ("group", "bin", "offset", "open")), ("long", "long", "long", "boolean"), strict=True)])
    groups = max(1, -(-pieces.count() // partition))
    todo = pieces.withColumn(names["group"], F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)))
    done, level, base = None, 0, 0
    while True:
        packed = materialize(todo.groupBy(names["group"]).applyInArrow(_pack(capacity, groups == 1, names), kinds), f"packed-{level}")
        left, widest = packed.agg(F.count_if(is_open), F.max(number)).first()
        stride = (widest or 0) + 1
        final = packed.where(~is_open).select(*(F.col(f"`{c}`") for c in columns), (F.lit(base) + group * F.lit(stride) + number).alias("sequence_id"), F.col(names["offset"]).alias("offset"))
        done = final if done is None else done.unionByName(final)
        if not left:
            return done
        base += groups * stride
        # what is left meets in at most half as many partitions, of about as many pieces as before
        groups = max(1, min(groups // 2, -(-left // partition)))
        todo = packed.where(is_open).drop(names["bin"], names["offset"], names["open"]).withColumn(names["group"], F.pmod(group, F.lit(groups)))
        level += 1
