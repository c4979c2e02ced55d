"""Toxic passages by maximal scoring segments.

Words get log-odds of toxic against clean documents under Dirichlet priors: a word's prior
follows its first letters, the letters' prior the classes as a whole, and two standard
deviations are taken off; a word counts at all if its log-odds are beyond what chance reaches. All other words
cost ``drift``. The algorithm of Ruzzo and Tompa finds all maximal segments of a text in one pass. Scores of
clean texts follow an extreme-value distribution (Karlin and Altschul): lambda solves
sum p e^(lambda s) = 1 over clean words, K is fitted to clean texts. The best segments of a text
together give a p-value, and a logistic curve turns that into a probability; it is fitted where
a text's own words did not help to learn the weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from loofold.llm.balltree import TERM_BYTES, terms_of
from loofold.llm.words import coded, parts, release

CHUNK_BYTES = 4 << 20

#: Evidence beyond e^-50 makes no text more toxic.
MOST = 50.0

#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    letters: int = 6
    """First letters of a word that its prior follows."""
    prior: float = 4.0
    """Documents that the prior of a word, and of first letters, is worth."""
    deviations: float = 2.0
    drift: float = 0.2
    words: int = 200_000
    """Words, and first letters, of the model: the most telling ones."""
    documents: int = 10_000
    """Labelled documents of each label that the probabilities are fitted to."""
    segments: int = 16
    """Best segments that a text's p-value looks at."""
    passage: float = 0.05
    """Expected number of such segments in a clean text of the length, up to which one is reported."""
    threshold: float = 0.3


@dataclass
class Weights:
    """Positive scores of words; of others by first letters, but for the words listed with 0."""

    words: dict[bytes, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    """Lambda of the extreme-value distribution."""


@dataclass
class Model:
    settings: Settings
    weights: Weights
    k: float
    intercept: float
    slope: float

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + self.slope * np.minimum(evidence, MOST))))


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text.

    ``at`` and ``score`` are its words with a positive score; every other word costs ``drift``.
    Each candidate keeps the sums before and after it and a link to the last candidate that
    begins lower, so the scan is linear.
    """
    found: list[list] = []  # first, last, sum before, sum after, link
    total, last = 0.0, -1
    for i, s in zip(at, score, strict=True):
        total -= drift * (i - last - 1)
        first, before, after = i, total, total + s
        total, last = after, i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append([first, i, before, after, j])
                break
            first, before, j_next = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = j_next
    return [(a, b, after - before) for a, b, before, after, _ in found]


def evidence(scores: list[float], n: int, decay: float, k: float, most: int) -> float:
    """-ln of the p-value of the best r segments together, for the most telling r, doubled per r."""
    best, total = 0.0, 0.0
    room = math.log(max(k * n, 1e-300))
    for r, s in enumerate(sorted(scores, reverse=True)[:most], 1):
        total += decay * s - room
        if r == 1:
            found = total if total > 30 else -math.log(-math.expm1(-math.exp(-total))) if total > -5 else 0.0
        elif total > r:
            found = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
        else:
            continue
        best = max(best, found)
    return best


def decay_of(rates: np.ndarray, scores: np.ndarray, drift: float) -> float:
    """The positive root of rest * e^(-lambda drift) + sum rate * e^(lambda score) = 1."""
    rest = max(1.0 - rates.sum(), 1e-9)

    def above(x: float) -> bool:
        return rest * math.exp(-x * drift) + float(rates @ np.exp(np.minimum(x * scores, 700.0))) > 1.0

    if not len(scores) or above(1e-6):
        return 1e-6 if len(scores) else 1.0
    low, high = 1e-6, 1.0
    while not above(high) and high < 1e6:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if not above((low + high) / 2) else (low, (low + high) / 2)
    return low


def scored_words(weights: Weights, how: Settings, texts: list[bytes]) -> Iterator[tuple[int, list[int], list[float]]]:
    """Number of terms of each text, and which of them score how much."""
    codes, distinct, bounds = coded([t.translate(TERM_BYTES) for t in texts])
    value = np.zeros(len(distinct))
    for i, word in enumerate(distinct):
        own = weights.words.get(word)
        if own is None:
            own = weights.starts.get(word.decode("utf-8", "replace")[: how.letters], 0.0) if weights.starts else 0.0
        value[i] = own
    scores = value[codes] if len(codes) else np.zeros(0)
    places = np.flatnonzero(scores > 0)
    cuts = np.searchsorted(places, bounds)
    for i in range(len(texts)):
        here = places[cuts[i] : cuts[i + 1]]
        yield int(bounds[i + 1] - bounds[i]), (here - bounds[i]).tolist(), scores[here].tolist()


def word_counts(labelled: DataFrame) -> DataFrame:
    """word and documents that hold it: toxic and clean ones of half 0 (t0, c0) and 1 (t1, c1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [Counter() for _ in range(4)]

        def handed() -> pa.RecordBatch:
            words = list(set().union(*groups))
            columns = [pa.array(words, pa.binary()).cast(pa.string())]
            columns += [pa.array([g[w] for w in words], pa.int64()) for g in groups]
            for g in groups:
                g.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "t0", "t1", "c0", "c1"])

        for batch in batches:
            toxic, half = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part, texts in parts(batch.column(0), CHUNK_BYTES):
                sets = [set(terms_of(t)) for t in texts]
                for g in range(4):
                    groups[g].update(chain.from_iterable(
                        s for i, s in enumerate(sets, part.start) if 2 * (1 - toxic[i]) + half[i] == g
                    ))
                if sum(map(len, groups)) > HELD_WORDS:
                    yield handed()
        yield handed()
        release()

    counts = labelled.select("text", "toxic", "half").mapInArrow(run, "word string, t0 long, t1 long, c0 long, c1 long")
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "c0", "c1")])


#: Counts of toxic and clean documents for the three models: learned from half 0, half 1 and all.
PAIRS = (("t0", "c0"), ("t1", "c1"), ("t0 + t1", "c0 + c1"))


def log_odds(pair: tuple[str, str], mass: tuple[int, int], prior: float, lean: Column | float) -> tuple[Column, Column]:
    """Log-odds of a count pair under a Dirichlet prior that leans by ``lean``, and their deviation."""
    toxic, clean = (F.expr(x) for x in pair)
    n1, n0 = (max(float(m), 1.0) for m in mass)
    tilt = F.exp(lean if isinstance(lean, Column) else F.lit(lean)) * n1
    one, zero = toxic + prior * tilt / (tilt + n0), clean + prior * n0 / (tilt + n0)
    return F.log(one / n1) - F.log(zero / n0), F.sqrt(1.0 / one + 1.0 / zero)


def learned_weights(labelled: DataFrame, toxic: int, how: Settings) -> list[Weights]:
    """The weights from half 0, from half 1 and from all labelled rows (text, toxic, half), ``toxic`` of them toxic.

    Every word of every row is counted; the driver sees the words with a positive score, the
    ``words`` most telling ones.
    """
    counts = word_counts(labelled).persist()
    try:
        names = ("t0", "t1", "c0", "c1")
        t0, t1, c0, c1 = (x or 0 for x in counts.agg(*map(F.sum, names)).first())
        masses = ((t0, c0), (t1, c1), (t0 + t1, c0 + c1))
        if 0 in masses[2]:
            return [Weights(), Weights(), Weights()]

        def lower(pair, mass, lean):
            odds, deviation = log_odds(pair, mass, how.prior, lean)
            telling = odds > math.sqrt(2 * math.log(1 + toxic)) * deviation  # beyond what chance reaches among many words
            return F.when(telling, odds - how.deviations * deviation).otherwise(0.0)

        first = F.substring("word", 1, how.letters).alias("start")
        starts = counts.groupBy(first).agg(*[F.sum(c).alias(c) for c in names], F.count("*").alias("n"))
        starts = starts.where("n > 1").select(
            "start", *[F.greatest(lower(p, m, 0.0), F.lit(0.0)).alias(f"s{i}") for i, (p, m) in enumerate(zip(PAIRS, masses, strict=True))]
        )
        rank = F.greatest("s0", "s1", "s2")
        leaning = starts.where(rank > 0).orderBy(rank.desc(), "start").limit(how.words)
        kept = leaning.toArrow().to_pylist()  # at most ``words`` short strings
        leans = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(3)]
        rates = [
            F.least((F.expr(p[1]) + 0.5) / max(float(m[1]), 1.0), F.lit(1.0)).alias(f"r{i}") for i, (p, m) in enumerate(zip(PAIRS, masses, strict=True))
        ]
        words = (
            counts.withColumn("start", first)
            .join(F.broadcast(counts.sparkSession.createDataFrame(kept, "start string, s0 double, s1 double, s2 double")), "start", "left")
            .select("word", "s0", *[F.greatest(lower(p, m, x), F.lit(0.0)).alias(f"w{i}")
                                    for i, (p, m, x) in enumerate(zip(PAIRS, masses, leans, strict=True))], *rates)
        )
        telling = F.greatest("w0", "w1", "w2")
        rows = words.where((telling > 0) | F.col("s0").isNotNull()).orderBy(telling.desc(), "word").limit(how.words).collect()
    finally:
        counts.unpersist()
    out = []
    for i in range(3):
        own = {r["word"].encode(): r[f"w{i}"] for r in rows}
        use = [r for r in rows if r[f"w{i}"] > 0]
        rates, scores = np.array([r[f"r{i}"] for r in use]), np.array([r[f"w{i}"] for r in use])
        out.append(Weights(own, {r["start"]: r[f"s{i}"] for r in kept}, decay_of(rates, scores, how.drift)))
    return out


def sampled(docs: DataFrame, labels: DataFrame, weights: list[Weights], how: Settings) -> list[tuple[int, int, int, list[float]]]:
    """toxic, half, terms and best segment scores, by the other half's weights, of a bounded sample."""
    totals = dict(labels.groupBy("toxic").count().collect())  # a number per label
    if not totals:
        return []
    rate = F.element_at(F.create_map(*[F.lit(x) for t, n in totals.items() for x in (t, how.documents / n)]), F.col("toxic"))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = F.broadcast(labels.where(chance < rate))  # about ``documents`` ids of each label
    shared = docs.sparkSession.sparkContext.broadcast(weights[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_pylist()
            for part, texts in parts(batch.column(0), CHUNK_BYTES):
                n, best = [], []
                for i in range(2):
                    mine = [j for j in range(len(texts)) if half[part.start + j] == i]
                    for j, (size, at, score) in zip(mine, scored_words(shared.value[1 - i], how, [texts[j] for j in mine]), strict=True):
                        n.append((j, size))
                        best.append((j, sorted((s for *_, s in segments(at, score, how.drift)), reverse=True)[: how.segments]))
                n, best = [x for _, x in sorted(n)], [x for _, x in sorted(best)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(part.start, len(texts)), batch.column(2).slice(part.start, len(texts)),
                     pa.array(n, pa.int64()), pa.array(best, pa.list_(pa.float64()))],
                    names=["toxic", "half", "n", "best"],
                )

    rows = docs.join(some, "doc_id").select("text", "toxic", "half")
    found = rows.mapInArrow(run, "toxic int, half int, n long, best array<double>").collect()
    return sorted((r["toxic"], r["half"], r["n"], sorted(r["best"], reverse=True)) for r in found)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve; a weak prior keeps both finite."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    w, ridge = np.zeros(2), np.array([0.01, 0.01])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a @ w)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def trained(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Weights from all labelled documents (labels: doc_id, toxic 0 or 1) and the curve from a sample.

    Rows without an id, a text or a label teach nothing; a document labelled both ways is toxic. Without
    documents of both labels no word scores, and every text gets the share of toxic ones (0 of none).
    """
    how = settings or Settings()
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
    labels = labels.agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic"))
    labels = labels.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    number = labels.where("toxic = 1").count()
    # Sorted merge at every size: labels grow with the documents, and a text is shuffled at most once.
    weights = learned_weights(texts.join(labels.hint("merge"), "doc_id"), number, how)
    rows = sampled(texts, labels, weights, how)
    clean = [r for r in rows if not r[0]]
    hit = sum(bool(r[3]) for r in clean)
    spread = sum(n * math.exp(-weights[1 - half].decay * (best[0] if best else 0.0)) for _, half, n, best in clean)
    k = (hit + 0.5) / max(spread, 1.0)
    x = np.array([evidence(best, n, weights[1 - half].decay, k, how.segments) for _, half, n, best in rows])
    toxic = np.array([r[0] for r in rows], float)
    share = labels.agg(F.avg("toxic")).first()[0]
    intercept, slope = (curve(np.minimum(x, MOST), toxic) if 0 < toxic.sum() < len(toxic) else (0.0, 0.0))
    if len(toxic) and slope:  # the sample holds labels in other shares than the table
        drawn = toxic.mean()
        intercept += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    else:
        share = share or 0.0
        intercept = math.log((share * 1e6 + 1) / ((1 - share) * 1e6 + 1))
    return Model(how, weights[2], k, intercept, slope)


PASSAGE = StructType(
    [StructField("start", LongType()), StructField("length", LongType()), StructField("score", DoubleType()), StructField("expected", DoubleType())]
)


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, score (probability), n_terms and passages (first term, terms, score, expected number).

    ``passages`` are all maximal segments of which a clean text of the length holds at most
    ``passage`` on average, in their order. A null or empty text has no terms, no passages and the
    probability of a text without evidence. Rows are scored apart, so repeated rows and ids
    repeat as given; an empty table gives no rows. One pass without a shuffle. With ``keep_row`` all
    columns follow inside ``row``, so names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        how, decay = held.settings, held.weights.decay
        for batch in batches:
            for part, texts in parts(batch.column(1), CHUNK_BYTES):
                n, proof, passages = [], [], []
                for size, at, score in scored_words(held.weights, how, texts):
                    found = segments(at, score, how.drift)
                    expected = [held.k * size * math.exp(-decay * s) for *_, s in found]
                    n.append(size)
                    proof.append(evidence([s for *_, s in found], size, decay, held.k, how.segments))
                    passages.append([
                        {"start": a, "length": b - a + 1, "score": s, "expected": e}
                        for (a, b, s), e in zip(found, expected, strict=True) if e <= how.passage
                    ])
                rows = pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(texts)), pa.array(held.probability(np.array(proof))), pa.array(n, pa.int64()), rows]
                    + [c.slice(part.start, len(texts)) for c in batch.columns[2:]],
                    names=["doc_id", "score", "n_terms", "passages", *["row"] * keep_row],
                )
        release()

    row = [F.struct("*").alias("row")] if keep_row else []
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    result = [StructField("score", DoubleType()), StructField("n_terms", LongType()), StructField("passages", ArrayType(PASSAGE))]
    return narrow.mapInArrow(run, StructType([narrow.schema["doc_id"], *result, *narrow.schema.fields[2:]]))
