"""Toxicity: a linear-chain conditional random field tags toxic spans.

Documents carry labels, tokens do not, so labelled tokens are derived first: over a bounded sample of
labelled documents, token features (the word, its prefixes and suffixes) far more frequent in toxic
documents than in others are candidates, and a greedy cover keeps those that explain toxic documents
which stronger ones do not, so that words which merely come along are left out. Tokens of toxic
documents with a kept feature are labelled 1, all others 0. A two-state field is trained on them by
maximum likelihood, with expectations from forward-backward. Scoring runs forward-backward over each
whole document; the score is its largest marginal, and runs of tokens with marginals above ``span``
are the offending spans.

With two states the recursions need only the ratio of the states' messages, one number a token. The
sequences of a batch are worked off in step, longest first, so that a step is a few vector operations
whatever their number. A document of more than ``WINDOW`` tokens is run in windows, which exchange
messages exactly: the product of a window's step matrices tells what it makes of any message.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORDS = re.compile(r"[^\W_]+")
PREFIXES, SUFFIXES = (3, 4, 5), (3, 4)
WINDOW = 512
#: Bounds of the classifier's sample: labelled rows of each label, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 20_000
SPAN = 0.3  # marginal from which a token is offending, and a document toxic


def features(word: str) -> list[str]:
    """The word itself and its affixes; case is folded."""
    w = word.lower()
    return [f"={w}", *(f"<{w[:n]}" for n in PREFIXES if len(w) > n), *(f">{w[-n:]}" for n in SUFFIXES if len(w) > n)]


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences in order of falling length: where each starts, and how many are longer than each step."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return starts, np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")


def _messages(odds: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of the forward and backward messages; ``lengths`` fall and are positive. ``before`` and
    ``after`` are the ratios that sequences get from what precedes and follows them; nan: nothing does."""
    (t00, t01), (t10, t11) = np.exp(transitions)
    starts, active = _steps(lengths)
    forward, backward = odds.copy(), np.ones_like(odds)
    if before is not None:
        got = ~np.isnan(before)
        r = before[got]
        forward[starts[got]] *= (r * t11 + t01) / (r * t10 + t00)
    if after is not None:
        got = ~np.isnan(after)
        backward[(starts + lengths - 1)[got]] = after[got]
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        r = forward[at - 1]
        forward[at] *= (r * t11 + t01) / (r * t10 + t00)
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        g = odds[at + 1] * backward[at + 1]
        backward[at] = (t10 + t11 * g) / (t00 + t01 * g)
    return forward, backward


def _products(odds: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Of every sequence the product (a, b, c, d by row) of the step matrices of its tokens but the first, up
    to a factor; ``lengths`` fall."""
    (t00, t01), (t10, t11) = np.exp(transitions)
    starts, active = _steps(lengths)
    out = np.zeros((4, len(lengths)))
    out[[0, 3]] = 1
    for k in range(1, len(active)):
        n = active[k]
        a, b, c, d = out[:, :n]
        o = odds[starts[:n] + k]
        out[:, :n] = a * t00 + b * t10, (a * t01 + b * t11) * o, c * t00 + d * t10, (c * t01 + d * t11) * o
        if k % 4 == 0:  # far from the ends of a double's range
            out[:, :n] /= out[:, :n].max(0)
    return (out / out.max(0)).T


def _exchanged(first: list[float], inner: list[list[float]], transitions: np.ndarray) -> tuple[list[float], list[float]]:
    """The ratios that the windows of one document get from before and from after them, by the odds of
    their first tokens and the products of the others."""
    (t00, t01), (t10, t11) = np.exp(transitions).tolist()
    before, after = [math.nan], [math.nan]
    (a, b, c, d), o = inner[0], first[0]
    r = (b + o * d) / (a + o * c)
    for (a, b, c, d), o in zip(inner[1:], first[1:], strict=True):
        before.append(r)
        r = o * (t01 + r * t11) / (t00 + r * t10)
        r = (b + r * d) / (a + r * c)
    r = 1.0
    for (a, b, c, d), o in zip(inner[:0:-1], first[:0:-1], strict=True):
        g = o * (c + d * r) / (a + b * r)
        r = (t10 + t11 * g) / (t00 + t01 * g)
        after.append(r)
    return before, after[::-1]


@dataclass
class Crf:
    """weights: log-odds of state 1 by feature; transitions[i][j]: score of state j after i."""

    weights: dict[str, float]
    constant: float
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        get = self.known.get
        out = [get(w) for w in words]
        if None in out:
            for i, e in enumerate(out):
                if e is None:
                    out[i] = self._emission(words[i])
        return np.array(out, float)

    def _emission(self, word: str) -> float:
        if len(self.known) > 200_000:
            self.known.clear()
        get = self.weights.get
        e = self.known[word] = self.constant + sum(get(f, 0.0) for f in features(word))
        return e

    def marginals(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of state 1 at every token of each sequence of emissions."""
        parts, owner = [], []
        for i, e in enumerate(sequences):
            odds = np.exp(np.clip(e, -30, 30))
            parts += [odds[s: s + WINDOW] for s in range(0, len(e), WINDOW)]
            owner += [(i, s) for s in range(0, len(e), WINDOW)]
        before, after = self._between([-(-len(e) // WINDOW) for e in sequences], parts)
        out = [np.zeros(len(e)) for e in sequences]
        if not parts:
            return out
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        lengths = np.array([len(parts[k]) for k in order])
        forward, backward = _messages(np.concatenate([parts[k] for k in order]), lengths, self.transitions, np.array(before)[order], np.array(after)[order])
        both = forward * backward
        p = both / (1 + both)
        for k, at in zip(order, np.concatenate([[0], np.cumsum(lengths)[:-1]]), strict=True):
            i, s = owner[k]
            out[i][s: s + len(parts[k])] = p[at: at + len(parts[k])]
        return out

    def _between(self, windows: list[int], parts: list[np.ndarray]) -> tuple[list[float], list[float]]:
        """What every part gets from before and from after it; a sequence is so many parts in a row."""
        before, after = [math.nan] * len(parts), [math.nan] * len(parts)
        ends = np.cumsum(windows).tolist()
        several = [(end - n, end) for n, end in zip(windows, ends, strict=True) if n > 1]
        if several:
            order = sorted((k for a, b in several for k in range(a, b)), key=lambda k: -len(parts[k]))
            inner = dict(zip(order, _products(np.concatenate([parts[k] for k in order]), np.array([len(parts[k]) for k in order]), self.transitions).tolist(), strict=True))
            for a, b in several:
                before[a:b], after[a:b] = _exchanged([float(parts[k][0]) for k in range(a, b)], [inner[k] for k in range(a, b)], self.transitions)
        return before, after


def derive_token_features(bags: list[list[str]], toxic: list[int], ratio: float = math.log(20), least: int = 3) -> set[str]:
    """Features whose tokens count as toxic in documents labelled so."""
    n = Counter(toxic)
    seen = (Counter(), Counter())
    for words, y in zip(bags, toxic, strict=True):
        seen[y].update({f for w in set(words) for f in features(w)})
    evidence = {f: e for f, a in seen[1].items() if a >= least and (e := math.log((a + 0.1) / (n[1] + 0.2)) - math.log((seen[0][f] + 0.1) / (n[0] + 0.2))) >= ratio}
    holders: dict[str, set[int]] = {f: set() for f in evidence}
    for i, (words, y) in enumerate(zip(bags, toxic, strict=True)):
        if y:
            for f in {f for w in set(words) for f in features(w)} & holders.keys():
                holders[f].add(i)
    kept: set[str] = set()
    open_ = {i for i, y in enumerate(toxic) if y}
    while open_ and holders:
        best = max(holders, key=lambda f: (len(holders[f] & open_) - 10 * seen[0][f] * n[1] / max(1, n[0]), evidence[f], f))
        if len(holders[best] & open_) < least:
            break
        kept.add(best)
        open_ -= holders.pop(best)
    return kept | {f for f in holders if len(holders[f]) >= max(least, 0.02 * n[1]) and seen[0][f] == 0}


def train(texts: list[str | None], toxic: list[int], around: int = 10) -> Crf:
    """Fits the field twice: the second time with stretches of clean texts that the first takes for
    toxic. Texts that repeat count once. Without labels of both kinds all scores are near 0."""
    told = {t: int(y) for t, y in zip(texts, toxic, strict=True) if t}
    bags, toxic = [WORDS.findall(t) for t in told], list(told.values())
    if len(set(toxic)) < 2:
        return Crf({}, -12.0)
    marks = derive_token_features(bags, toxic)
    rng = np.random.default_rng(0)
    marked = {w for words, y in zip(bags, toxic, strict=True) if y for w in set(words) if not marks.isdisjoint(features(w))}
    tags = [np.array([y and w in marked for w in words], np.int64) for words, y in zip(bags, toxic, strict=True)]

    def stretches(k: int, middles: list[int]) -> list[tuple[list[str], np.ndarray]]:
        cuts = [(max(0, m - around), m + around + 1) for m in middles]
        return [(bags[k][a:b], tags[k][a:b]) for a, b in cuts if bags[k][a:b]]

    taken = []
    for k, y in enumerate(toxic):
        taken += stretches(k, np.flatnonzero(tags[k])[:8].tolist() if y else rng.integers(0, max(1, len(bags[k])), 4).tolist())
    model = _fit(taken)
    clean = [k for k, y in enumerate(toxic) if not y]
    for k, p in zip(clean, model.marginals([model.emissions(bags[k]) for k in clean]), strict=True):
        taken += stretches(k, [m for m in np.argsort(-p)[:4].tolist() if p[m] >= 0.02])
    return _fit(taken)


def _fit(sequences: list[tuple[list[str], np.ndarray]], rounds: int = 120, rate: float = 1.0, ridge: float = 1e-4) -> Crf:
    """Maximum likelihood by AdaGrad; expected counts come from forward-backward."""
    sequences = sorted(sequences, key=lambda x: -len(x[0]))
    lengths = np.array([len(x[0]) for x in sequences])
    tag = np.concatenate([x[1] for x in sequences])
    words = [w for x in sequences for w in x[0]]
    own = {w: features(w) for w in set(words)}
    count = Counter(f for w in words for f in own[w])
    index = {f: i for i, f in enumerate(f for f, c in count.items() if c >= 3)}
    of_word = {w: [index[f] for f in fs if f in index] for w, fs in own.items()}
    rows = [of_word[w] for w in words]
    token = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([i for r in rows for i in r], np.int64)
    starts, _ = _steps(lengths)
    inner = np.ones(len(tag), bool)
    inner[starts] = False
    second = np.flatnonzero(inner)
    told_pairs = np.bincount(2 * tag[second - 1] + tag[second], minlength=4).reshape(2, 2).astype(float)
    w, constant, transitions = np.zeros(len(index)), -3.0, np.zeros((2, 2))
    grown_w, grown_c, grown_t = np.full(len(index), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    size = len(tag)
    for _ in range(rounds):
        emission = constant + np.bincount(token, weights=w[feature], minlength=size)
        odds = np.exp(np.clip(emission, -30, 30))
        forward, backward = _messages(odds, lengths, transitions)
        both = forward * backward
        p = both / (1 + both)
        r, g, t = forward[second - 1], odds[second] * backward[second], np.exp(transitions)
        joint = np.stack([np.full_like(r, t[0, 0]), t[0, 1] * g, t[1, 0] * r, t[1, 1] * r * g])
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        # mean log-likelihood would drown the few toxic tokens; sums per toxic token keep the scale
        scale = max(1, int(tag.sum()))
        step_w = np.bincount(feature, weights=(tag - p)[token], minlength=len(index)) / scale - ridge * w
        step_c = float((tag - p).sum()) / scale
        step_t = (told_pairs - expected) / scale - ridge * transitions
        grown_w += step_w**2
        grown_c += step_c**2
        grown_t += step_t**2
        w += rate * step_w / np.sqrt(grown_w)
        constant += rate * step_c / math.sqrt(grown_c)
        transitions += rate * step_t / np.sqrt(grown_t)
    return Crf({f: float(w[i]) for f, i in index.items() if abs(w[i]) >= 0.05}, float(constant), transitions)


def spans_of(text: str, p: np.ndarray, least: float = SPAN) -> list[dict[str, int]]:
    """Runs of tokens with marginals of at least ``least``, as offsets in code points."""
    out, end = [], -2
    for i, m in enumerate(WORDS.finditer(text)):
        if p[i] >= least:
            if i == end + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            end = i
    return out


_KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def score(documents: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), most_chars: int = 3_000_000) -> DataFrame:
    """One row per row of ``documents``: the ``carry`` columns, doc_id, score, spans (start, end).

    A document has spans if and only if its score is ``SPAN`` or more. Null and empty texts, and texts
    without words, score 0 and have no spans. Nothing but the text is an input. Repeated rows are scored
    each; an empty table gives an empty result. Carried columns that are named like a result are left out.
    """
    carry = tuple(c for c in carry if c.lower() not in ("doc_id", "score", "spans"))
    chosen = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    kinds = "".join(f"`{c}` {k}, " for c, (_, k) in zip(carry, chosen.dtypes[2:], strict=True))
    schema = f"{kinds}doc_id {chosen.dtypes[0][1]}, score double, spans array<struct<start: bigint, end: bigint>>"
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.constant, model.transitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*sent.value)
        for batch in batches:
            a, size, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py() or "")
                size += len(texts[-1])
                if size >= most_chars or i == batch.num_rows - 1:
                    marginals = own.marginals([own.emissions(WORDS.findall(t)) for t in texts])
                    scores = [float(p.max()) if len(p) else 0.0 for p in marginals]
                    spans = [spans_of(t, p) if s >= SPAN else [] for t, p, s in zip(texts, marginals, scores, strict=True)]
                    part = batch.slice(a, i + 1 - a)
                    yield pa.RecordBatch.from_arrays([*part.columns[2:], part.column(0), pa.array(scores, pa.float64()), pa.array(spans, _KIND)], [*carry, "doc_id", "score", "spans"])
                    a, size, texts = i + 1, 0, []

    return chosen.mapInArrow(run, schema)


def held_out(doc_id) -> "F.Column":
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Crf:
    """Trains on a bounded sample: of the labelled ids that ``documents`` hold with texts of 1 to ``chars``
    characters, the first ``rows`` of each label in order of a hash; of an id with several texts the least.
    Held-out ids and null labels are left out; an id labelled twice is toxic if either label is. Missing labels give a field that scores all near 0."""
    known = (
        labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
        .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    )
    short = documents.where(F.length(text).between(1, chars)).select(F.col(doc_id).alias("id"))
    known = materialize(known.join(short, "id", "left_semi"), "labelled")
    order = (F.xxhash64("id"), F.col("id"))
    ids = known.where("y = 1").orderBy(*order).limit(rows).unionByName(known.where("y = 0").orderBy(*order).limit(rows))
    sample = (
        documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(ids), "id")  # 2 * rows ids at most
        .where(F.length("t").between(1, chars)).groupBy("id", "y").agg(F.min("t").alias("t")).collect()
    )
    sample.sort(key=lambda r: r["id"])
    return train([r["t"] for r in sample], [r["y"] for r in sample])
