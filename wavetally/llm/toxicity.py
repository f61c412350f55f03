"""Toxic passages by maximum-scoring segment search.

Every token scores by its log-odds of appearing in toxic against clean documents. The
rates are shrunk by Dirichlet priors in a hierarchy: a token's prior is the posterior of
its first six letters, theirs that of the first five, four and three, and at last the
rate of all documents, so that a rare or unseen word scores as its stem, and a word of
no stem 0. Every token also pays a small drift. A token that stands among the last
NEARBY ones already is damped: what it gains is divided by how often it stands there, so
that a line which a text repeats is no passage, while every passage counts wherever it
lies. A linear scan finds all maximal scoring segments (Ruzzo and Tompa). By
extreme-value theory the best segment of a clean document of n tokens has a Gumbel
distribution with location ln(K n) / lambda; K and lambda are fitted on clean documents
that the log-odds did not see, and a segment's excess over that location says how
significant it is. The excesses of a document's segments are combined by a logistic
fit on the same held-back documents.

The fit uses at most MAX_TOXIC and MAX_CLEAN labelled documents, the first by a hash of
their ids; that bounds the model too. Only the text is an input of a score. A word in
fewer than LEAST of these documents has no rate of its own.

Defined cases: a null or empty text has no segment and gets the score of an empty
document; labels that contradict each other count as toxic; without labels of both
kinds every score is 0; repeated rows give repeated results; an empty table gives an
empty result; other columns are not read, and kept as they are by drop_toxic. A text of
any length is scanned whole, in linear time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import stash

MAX_TOXIC, MAX_CLEAN = 15_000, 30_000
#: Least documents that a feature must appear in, and pseudo-documents of a prior.
LEAST, STRENGTH = 5, 30.0
#: Log-odds that differ less from those of the feature above are the same.
SAME = 0.02
DRIFT = 0.15
PREFIXES = (3, 4, 5, 6)
#: Tokens within which repeats are damped.
NEARBY = 64
#: A third of the labelled documents fits the calibration, the others the log-odds.
PARTS = 3
#: Most tokens whose scores a worker remembers.
REMEMBERED = 400_000
#: Segments with at least this excess are significant.
SIGNIFICANT = 3.0

SCORED = "doc_id bigint, score double, n_segments int"
MEASURED = "label int, n bigint, best double, total double"
PASSAGES = "doc_id bigint, first_token int, last_token int, score double, p_value double"


def clean(token: str) -> str:
    """A lower-case token without what is not a letter or digit at its ends."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def features(word: str) -> list[str]:
    """From the shortest prefix to the word itself."""
    return [f"{word[:n]}*" for n in PREFIXES if len(word) > n] + ([word] if word else [])


@dataclass
class Model:
    log_odds: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-math.inf, 0.0, 0.0)


class _Scores(dict):
    def __init__(self, log_odds: dict[str, float]):
        super().__init__()
        self.log_odds = log_odds

    def __missing__(self, token: str) -> float:
        known = self.log_odds
        found = 0.0
        for f in reversed(features(clean(token))):
            if f in known:
                found = known[f]
                break
        if len(self) < REMEMBERED:
            self[token] = found
        return found


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token) of a text's token scores."""
    at = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[list] = []  # sum before, sum behind, first, last
    for i, left, right in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        first = i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= left:
                j -= 1
            if j < 0 or out[j][1] >= right:
                out.append([left, right, first, i])
                break
            left, first = out[j][0], out[j][2]
            del out[j:]
    return [(right - left, first, last) for left, right, first, last in out]


def token_scores(tokens: list[str], log_odds: dict) -> np.ndarray:
    """Log-odds less the drift of every token; what a token gains is divided by how often it stands among the last NEARBY."""
    scores = np.fromiter(map(log_odds.__getitem__, tokens), np.float64, len(tokens))
    places: dict[str, list[int]] = {}
    for i in np.flatnonzero(scores > DRIFT).tolist():
        own = places.get(tokens[i])
        if own is None:
            places[tokens[i]] = [i]
            continue
        while own and own[0] <= i - NEARBY:
            own.pop(0)
        own.append(i)
        scores[i] /= len(own)
    return scores - DRIFT


def found(text: str | None, log_odds: dict) -> tuple[int, list[tuple[float, int, int]]]:
    """The number of tokens and the maximal segments of a text."""
    tokens = (text or "").lower().split()
    return len(tokens), segments(token_scores(tokens, log_odds))


def _inputs(n: int, own: list, rate: float, log_k: float) -> tuple[float, float]:
    """The best segment's excess, and the sum of all positive ones."""
    location = log_k + math.log(max(n, 1))
    excess = [rate * s - location for s, _, _ in own]
    best = max(excess, default=-location)
    return max(-20.0, min(60.0, best)), math.log1p(sum(max(0.0, x) for x in excess))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's 5-word shingles, which near copies mostly share."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        least = []
        for text in batch.column("text"):
            words = text.as_py().encode().split()
            least.append(min(digest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) >> 1)
        yield batch.append_column("sketch", pa.array(least, pa.int64()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that have a feature: partial counts, given out when many."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        n = [pa.array([c[f] for f in names], pa.int64()) for c in counts]
        return pa.record_batch([pa.array(names, pa.string()), n[1], n[0]], names=["feature", "toxic", "clean"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = {clean(t) for t in set((text.as_py() or "").lower().split())}
            counts[label].update(f for w in words for f in features(w))
        if len(counts[0]) + len(counts[1]) > 300_000:
            yield out()
            counts[0].clear()
            counts[1].clear()
    yield out()


def _measured(batches: Iterator[pa.RecordBatch], log_odds, rate: float | None = None, log_k: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Of each document the label, its tokens and its best segment; with a rate, the inputs of the last fit instead."""
    scores = _Scores(log_odds.value)
    for batch in batches:
        rows = []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, own = found(text.as_py(), scores)
            rows.append((label, n, max((s for s, _, _ in own), default=0.0), 0.0) if rate is None else (label, n, *_inputs(n, own, rate, log_k)))
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "n", "best", "total"])


def hierarchy(counts: dict[str, tuple[int, int]], toxic: int, clean_: int, strength: float = STRENGTH) -> dict[str, float]:
    """Log-odds of each feature against the overall rate, but those of the feature above it; counts: documents (toxic, clean)."""
    base = toxic / (toxic + clean_)
    share: dict[str, float] = {}
    logit = lambda p: math.log(p / (1 - p))
    odds: dict[str, float] = {}
    for f in sorted(counts, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"))):
        above = next((p for p in reversed(above_of(f)) if p in share), None)
        prior = share[above] if above else base
        t, c = counts[f]
        share[f] = (t + strength * prior) / (t + c + strength)
        odds[f] = logit(share[f]) - logit(base)
    return odds


def above_of(feature: str) -> list[str]:
    """The stems over a feature, the shortest first."""
    stem = feature[:-1] if feature.endswith("*") else feature
    return [f"{stem[:p]}*" for p in PREFIXES if p < len(stem)]


def pruned(odds: dict[str, float], same: float = SAME) -> dict[str, float]:
    """Without the features that score as the one over them that stays does."""
    kept: dict[str, float] = {}
    for f in sorted(odds, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"))):
        above = next((kept[p] for p in reversed(above_of(f)) if p in kept), 0.0)
        if abs(odds[f] - above) >= same:
            kept[f] = odds[f]
    return kept


def _gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and ln K by moments of the best scores, each less its length's share."""
    rate, log_n = 1.0, np.log(np.maximum(n, 1))
    for _ in range(50):
        rest = best - log_n / rate
        rate = float(np.clip(math.pi / math.sqrt(6) / max(rest.std(), 1e-3), 0.05, 20.0))
    return rate, float(rate * (best - log_n / rate).mean() - 0.5772156649)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fits on documents whose id has a label. labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    sample = chosen[0].union(chosen[1])  # at most max_toxic + max_clean ids
    held = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    # Copies and most near copies of a text count once, and lie on one side of the split.
    held = held.mapInArrow(_sketched, "toxic int, text string, sketch bigint").dropDuplicates(["sketch", "toxic"])
    held = stash(held.withColumn("part", F.pmod("sketch", F.lit(PARTS)).cast("int")))
    totals = {r["toxic"]: r["count"] for r in held.where("part > 0").groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Model()
    fit = held.where("part > 0").select("toxic", "text").mapInArrow(_counted, "feature string, toxic bigint, clean bigint")
    kept = fit.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") + F.col("c") >= LEAST)
    # The sample's size bounds how many features that many of its documents share.
    log_odds = pruned(hierarchy({r["feature"]: (r["t"], r["c"]) for r in kept.collect()}, totals[1], totals[0]))
    shared = spark.sparkContext.broadcast(log_odds)
    measure = lambda **how: held.where("part = 0").select("toxic", "text").mapInArrow(partial(_measured, log_odds=shared, **how), MEASURED).collect()
    seen = measure()  # a row of numbers for each document of a third of the sample
    quiet = [r for r in seen if r["label"] == 0]
    if not quiet or len(quiet) == len(seen):
        return Model(log_odds)
    rate, log_k = _gumbel(np.array([r["best"] for r in quiet]), np.array([r["n"] for r in quiet]))
    seen = measure(rate=rate, log_k=log_k)
    w = _logistic(np.array([(1.0, r["best"], r["total"]) for r in seen]), np.array([float(r["label"]) for r in seen]))
    # The sample may hold another share of toxic documents than the labels do.
    all_of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = {1: min(max_toxic, all_of.get(1, 0)), 0: min(max_clean, all_of.get(0, 0))}
    w[0] += math.log(all_of[1] / all_of[0]) - math.log(taken[1] / taken[0])
    return Model(log_odds, rate, log_k, tuple(map(float, w)))


def probability(n: int, own: list, model: Model) -> float:
    if model.weights[0] == -math.inf:
        return 0.0
    best, total = _inputs(n, own, model.rate, model.log_k)
    a, b, c = model.weights
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * total))))


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    scores = _Scores(model.log_odds)
    for batch in batches:
        own = [found(text.as_py(), scores) for text in batch.column(1)]
        many = [sum(model.rate * s - model.log_k - math.log(max(n, 1)) >= SIGNIFICANT for s, _, _ in parts) for n, parts in own]
        yield pa.record_batch(
            [batch.column(0), pa.array([probability(n, parts, model) for n, parts in own], pa.float64()), pa.array(many, pa.int32())],
            names=["doc_id", "score", "n_segments"],
        )


def _passages(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    scores = _Scores(model.log_odds)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, own = found(text.as_py(), scores)
            for s, a, b in own:
                excess = model.rate * s - model.log_k - math.log(max(n, 1))
                if excess >= SIGNIFICANT:
                    rows.append((doc_id, a, b, s, -math.expm1(-math.exp(-excess))))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "first_token", "last_token", "score", "p_value"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_segments (significant ones) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(partial(_scored, model=shared), SCORED)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant toxic passage: its tokens (white-space words, from 0), score and p-value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(partial(_passages, model=shared), PASSAGES)


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without the documents that score at or over the limit; rows are judged one by one."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value.log_odds)
        for batch in batches:
            fine = [probability(*found(text.as_py(), scores), shared.value) < limit for text in batch.column("text")]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)

