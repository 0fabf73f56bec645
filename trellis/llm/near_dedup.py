"""MinHash near-deduplication with an LSH forest.

1. A scan gives every document the fingerprint of its shingle set, its size and a MinHash signature.
   Documents with equal sets are one class, found by a partial aggregate.
2. Every class enters ``trees`` sorted orders: it is sorted in each by ``depth`` MinHash values of the
   tree, then by the rest of the signature, and the orders are range-partitioned and sorted together.
   Neighbours with a common prefix, of one value at least, are candidates. Where classes are dense the
   prefixes of neighbours are longer: classes with ``depth`` values in common are a region, and in a
   region of up to ``leaf`` classes each is a candidate for each. A larger region is cut at the
   shortest common prefixes of neighbours, which is the same as going deeper there and only there, until
   its parts are leaves; and the region also elects hubs, the classes most similar on average to a
   spread of its members, and every member is a candidate for each of them. So a region of n classes
   gives O(n) candidates at any size. Regions may run over several partitions; each part elects its own
   hubs. What is cut like this, at leaves, parts or partitions, may part a pair: its classes are noted as
   open, for step 4.
3. Candidates that the signatures cannot rule out are confirmed on full shingle sets in two rounds:
   first every class with the candidates most alike, then all candidates that the links found do not
   connect already. The second round can only add links between components, so no confirmation is lost
   by the order.
4. Open classes meet by an exact prefix join on their full sets: in one order of all shingles, rare ones
   first, two sets that link share a shingle among the first of each, at positions that leave room for
   the overlap. Pairs inside a component are left out, so a family that the hubs joined costs nothing.
5. Links become components by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, scratch
from .components import components
from .shingles import fingerprint, mix64, shingle_sets

POSITIONS, TREES, DEPTH, LEAF, HUBS, SPREAD = 96, 16, 4, 16, 4, 32
PART = 20_000  # classes of a region that are worked off together
SKETCH = 1 << 18  # counters that tell rare shingles from common ones
RULE_OUT = 5  # standard deviations of its estimate below the threshold from which a pair is ruled out
OPEN = 2.0  # est of the pairs (a, a) that note open classes
_rng = np.random.default_rng(7)
_MULT = (_rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets, held = [], [], 0
            for row, h in shingle_sets(batch.column("text"), k):
                rows.append(row)
                sets.append(h)
                held += len(h)
                if held > 1 << 20:
                    yield _signed(batch, rows, sets)
                    rows, sets, held = [], [], 0
            if rows:
                yield _signed(batch, rows, sets)
    return sign


def _signed(batch: pa.RecordBatch, rows: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    n = np.array([len(s) for s in sets])
    full = np.flatnonzero(n)
    signature = np.full((len(rows), POSITIONS), 0xFFFFFFFF, np.uint32)
    if len(full):
        h = np.concatenate([sets[i] for i in full])
        h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for p in range(POSITIONS):
            x = h * _MULT[p] + _ADD[p]
            x ^= x >> np.uint32(15)
            signature[full, p] = np.minimum.reduceat(x, at)
    ids = batch.column("doc_id").take(pa.array(rows))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary())],
        ["doc_id", "n_shingles", "fp", "sig"],
    )


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and tree: tree, the values that it is sorted by first, the sort key after them."""
    for batch in batches:
        for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
            n = part.num_rows
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(n, POSITIONS)
            low = (sig & np.uint32(0xFF)).astype(np.uint8)
            for t in range(TREES):
                lead = sig[:, t * DEPTH:(t + 1) * DEPTH].astype(">u4")
                turned = np.roll(low, -(t + 1) * DEPTH, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), _binary(lead), part.column("rep"), _binary(turned)],
                    ["tree", "region", "rep", "order"],
                )


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _leaves(order: np.ndarray) -> list[tuple[int, int]]:
    """Cuts sorted rows into runs of at most LEAF, at the shortest common prefixes of neighbours."""
    differ = order[1:] != order[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), order.shape[1])
    out, todo = [], [(0, len(order))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            out.append((a, b))
            continue
        inner = lcp[a: b - 1]
        least = np.flatnonzero(inner == inner.min())
        # among equally short prefixes the most central: identical orders are halved
        cut = a + 1 + int(least[np.abs(least - (b - a) / 2).argmin()])
        todo += [(a, cut), (cut, b)]
    return out


def _candidates(least: float):
    """Candidate pairs (a, b, est) of sorted (tree, region, order) rows; est is at least ``least``, and
    OPEN in a pair (a, a) for every class of a region not compared in full here."""
    part = PART

    def pairs_of(reps: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(reps)
        if n > LEAF:
            spread = order[np.unique(np.linspace(0, n - 1, SPREAD).astype(int))]
            score = np.zeros(n)
            for s in spread:
                score += (order == s).sum(1)
            for hub in np.argsort(-score, kind="stable")[:HUBS]:
                est = (order == order[hub]).mean(1)
                at = np.flatnonzero((est >= least) & (reps != reps[hub]))
                yield np.full(len(at), reps[hub]), reps[at], est[at]
        for a, b in _leaves(order):
            if b - a < 2:
                continue
            i, j = np.triu_indices(b - a, 1)
            est = (order[a + i] == order[a + j]).mean(1)
            at = np.flatnonzero((est >= least) & (reps[a + i] != reps[a + j]))
            yield reps[a + i[at]], reps[a + j[at]], est[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(reps, orders, cut):
            if cut or len(reps) > LEAF:
                own = pa.array(np.unique(reps), pa.int64())
                yield pa.RecordBatch.from_arrays([own, own, pa.array(np.full(len(own), OPEN))], ["a", "b", "est"])
            if len(reps) < 2:
                return
            order = np.frombuffer(b"".join(orders), np.uint8).reshape(len(orders), POSITIONS)
            for a, b, est in pairs_of(np.array(reps), order):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est)], ["a", "b", "est"])

        # the first and the last region may go on in other partitions
        last, reps, orders, cut_off = None, [], [], True
        end: tuple | None = None  # the last row of the batch before
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, rep, order = batch.column("tree").to_numpy(), batch.column("rep").to_numpy(), batch.column("order")
            lead = np.frombuffer(b"".join(batch.column("region").to_pylist()), ">u4").reshape(n, DEPTH)
            same = (tree[1:] == tree[:-1]) & (lead[1:] == lead[:-1]).all(1)
            # neighbours that share fewer leading values than a region: the order is as shallow as it need be there
            near = np.flatnonzero((tree[1:] == tree[:-1]) & (lead[1:, 0] == lead[:-1, 0]) & ~same)
            pairs = [(rep[near], rep[near + 1], order.take(pa.array(near)), order.take(pa.array(near + 1)))]
            if end is not None and end[0] == tree[0] and end[1][0] == lead[0, 0] and (end[1] != lead[0]).any():
                pairs.append((np.array([end[2]]), rep[:1], pa.array([end[3]], pa.binary()), order.slice(0, 1)))
            end = tree[-1], lead[-1], rep[-1], order[n - 1].as_py()
            for a, b, x, y in pairs:
                if len(a):
                    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(a), POSITIONS) for v in (x, y))
                    est = (x == y).mean(1)
                    good = (est >= least) & (a != b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[good]), pa.array(np.maximum(a, b)[good]), pa.array(est[good])], ["a", "b", "est"])
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), n]
            for a, b in zip(edges, edges[1:], strict=False):
                key = (tree[a], lead[a].tobytes())
                if key != last:
                    if len(reps) > 1 or (reps and cut_off):
                        yield from emit(reps, orders, cut_off)
                    cut_off = last is None
                    last, reps, orders = key, [], []
                # a region longer than this is worked off in parts, as one that runs over partitions
                if len(reps) >= part:
                    yield from emit(reps, orders, True)
                    reps, orders, cut_off = [], [], True
                reps += rep[a:b].tolist()
                if b - a > 1 or len(reps) > 1 or b == n:
                    orders += order.slice(a, b - a).to_pylist()
                else:
                    orders += [order[a].as_py()]
        if reps:
            yield from emit(reps, orders, True)
    return run


def _set_maker(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            out, size = [], 0
            for row, h in shingle_sets(batch.column("text"), k):
                out.append((ids[row].as_py(), h.tobytes()))
                size += 8 * len(h)
                if size > 16 << 20:
                    yield _as_sets(out, ids.type)
                    out, size = [], 0
            if out:
                yield _as_sets(out, ids.type)
    return make


def _as_sets(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.binary())], ["rep", "set"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
        shared = pa.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in both], pa.int64())
        total = pa.array([len(x) + len(y) for x, y in both], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), shared, total], ["a", "b", "shared", "total"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    less, more = (f(F.octet_length("set_a"), F.octet_length("set_b")) for f in (F.least, F.greatest))
    return (
        both.where(less * 100 >= more * percent).mapInArrow(_shared, "a long, b long, shared long, total long")
        .where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b").distinct()
    )


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix64(h) % np.uint64(SKETCH)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets have a shingle of each slot of the sketch."""
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for x in batch.column("set"):
            np.add.at(total, _slot(np.frombuffer(x.as_buffer(), np.uint64)), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _prefixes(sketch, percent: int):
    """(g, rep, component, n, pos) for the first shingles of every set, as many as a link needs to meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(sketch.value, np.int64)

        def post(rows: list[tuple]) -> pa.RecordBatch:
            size = [len(r[0]) for r in rows]
            whole = [pa.array(np.repeat(np.array([r[i] for r in rows], np.int64), size)) for i in (1, 2, 3)]
            pos = np.concatenate([np.arange(m) for m in size])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), *whole, pa.array(pos)], ["g", "rep", "component", "n", "pos"])

        for batch in batches:
            rows, held = [], 0
            for x, rep, component in zip(batch.column("set"), batch.column("rep").to_pylist(), batch.column("component").to_pylist(), strict=True):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(h)
                rows.append((h[np.lexsort([h, often[_slot(h)]])[: n - -(-n * percent // 100) + 1]], rep, component, n))
                held += len(rows[-1][0])
                if held > 1 << 18:
                    yield post(rows)
                    rows, held = [], 0
            if rows:
                yield post(rows)
    return run


def _met(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows (rep, component, set) in different components, among them all that link.

    A pair that links has at least percent * (n_a + n_b) / (100 + percent) shingles in common, none of
    which comes before its first common one: neither set may have fewer from there on. For the smaller
    set that means a shorter prefix than for the larger. Of a shingle's sets those in its most frequent
    component meet only the others.
    """
    spark = sets.sparkSession
    counted = np.zeros(SKETCH, np.int64)
    tally = sets.select("set").mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counted[tally["slot"].to_numpy()] = tally["n"].to_numpy()
    sketch = spark.sparkContext.broadcast(counted.tobytes())
    posted = materialize(sets.select("rep", "component", "set").mapInArrow(_prefixes(sketch, percent), "g long, rep long, component long, n long, pos long"), "prefixes")
    main = (
        posted.groupBy("g", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("g")
        .agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("m", "component")).alias("main")).where("components > 1").select("g", F.col("main.component").alias("main"))
    )
    # a second key, which the grouping does not have, lets AQE split a common shingle
    fold = F.xxhash64("g").alias("fold")
    lists = materialize(posted.select("*", fold).join(main.select("*", fold), ["g", "fold"]).select("g", "rep", "component", "n", "pos", (F.col("component") == F.col("main")).alias("main")), "lists")
    room = F.col("n") - F.col("pos")
    small = lists.where(room * (100 + percent) >= 2 * percent * F.col("n")).alias("x")
    large = lists.alias("y")
    need = percent * (F.col("x.n") + F.col("y.n"))
    fits = (
        (F.col("x.g") == F.col("y.g")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.n") <= F.col("y.n"))
        & ((F.col("x.n") - F.col("x.pos")) * (100 + percent) >= need) & ((F.col("y.n") - F.col("y.pos")) * (100 + percent) >= need)
    )
    some = small.where(~F.col("main")).join(large, fits).select("x.rep", F.col("y.rep").alias("other"))
    most = small.where("main").join(large.where(~F.col("main")), fits).select("x.rep", F.col("y.rep").alias("other"))
    return some.union(most).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked with 100 * intersection >= ``percent`` * union of their distinct
    ``shingle``-word shingles; component_id is the smallest id reachable, kept marks it. Fewer words
    than a shingle are one shingle; null texts and texts without words have no set and link with
    nothing. Ids must be integers; a null id, which no link can name, has a row of its own
    (component_id null, kept). Rows that repeat an id are each judged by
    their own text; an empty table gives an empty result.
    """
    with scratch(documents.sparkSession):
        return _components_of(documents, shingle, percent, doc_id, text)


def _components_of(documents: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The result reads the tables that are kept, no others."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signer(shingle), "doc_id long, n_shingles long, fp binary, sig binary"), "signed", keep=True)
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("members")), "classes")
    est_least = percent / 100 - RULE_OUT * (percent / 100 * (1 - percent / 100) / POSITIONS) ** 0.5
    entered = classes.select("rep", "sig").mapInArrow(_enter, "tree int, region binary, rep long, order binary")
    forest = entered.repartitionByRange("tree", "region", "order").sortWithinPartitions("tree", "region", "order", "rep")
    found = materialize(forest.mapInArrow(_candidates(est_least), "a long, b long, est double").groupBy("a", "b").agg(F.max("est").alias("est")), "candidates")
    pairs, opened = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("rep"))

    needed = found.select(F.col("a").alias("rep")).union(found.select(F.col("b").alias("rep"))).distinct()
    needed = materialize(needed, "needed")
    of = docs.join(broadcast_if(needed.withColumnRenamed("rep", "doc_id"), needed.count(), 16), "doc_id", "left_semi")
    sets = materialize(of.mapInArrow(_set_maker(shingle), "rep long, set binary"), "sets")

    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "est").union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "est"))
    best = both.groupBy("x").agg(F.max(F.struct("est", "y")).alias("best"))
    first = best.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct()
    links = materialize(_links(first, sets, percent), "links-1")
    label = materialize(components(links), "labels-1")
    rest = (
        pairs.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .where(~F.coalesce("ca", F.col("a")).eqNullSafe(F.coalesce("cb", F.col("b")))).select("a", "b")
        .join(first, ["a", "b"], "left_anti")
    )
    links = links.union(materialize(_links(rest, sets, percent), "links-2"))
    label = materialize(components(links).select(F.col("node").alias("rep"), "component"), "labels-2")
    opened = opened.join(label, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    met = materialize(_met(sets.join(opened, "rep"), percent), "met")
    links = links.union(materialize(_links(met, sets, percent), "links-3"))
    label = materialize(components(links).select(F.col("node").alias("rep"), "component"), "labels")
    of_class = classes.select("fp", "rep", "members").join(label, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    of_class = materialize(of_class, "classes-labelled", keep=True)
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
