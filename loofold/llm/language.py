"""Language of words and documents by a linear-chain conditional random field.

The languages of a text's words form a chain. A word's potential is a sum of learned weights
of its letter n-grams, affixes, itself, and its entries in lexicons; a change of language costs
a learned transition. Forward-backward gives the probability of each language at each word of
text that mixes languages, and their mean over the words with letters is the document's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from loofold.llm.words import coded, release, slices, spread, starts, texts_of

CHUNK_BYTES = 2 << 20
BUCKETS = 1 << 16
#: Words of the fit whose features are found at once; bounds the driver's memory only.
FITTED_WORDS = 1 << 13
UNKNOWN = "und"

EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_=+/\\0123456789@~^`"


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample and settings of the fit.

    About ``documents`` rows of each language are taken by a hash of their id, and of each at
    most ``segments`` runs of ``words`` words spread over the whole text.
    """

    documents: int = 500
    segments: int = 8
    words: int = 24
    lexicon: int = 300  # words per language
    steps: int = 500
    batch: int = 96
    rate: float = 0.3
    seed: int = 7


@dataclass
class Field:
    """A fitted model: languages, weights by feature, transitions and start, lexicon entries."""

    langs: list[str]
    weights: np.ndarray
    change: np.ndarray
    start: np.ndarray
    lexicon: dict[bytes, list[int]] = field(default_factory=dict)


def cleaned(words: list[bytes]) -> list[bytes]:
    """Words in lower case without signs at their edges; empty if no letter is left."""
    out = []
    for w in words:
        text = w.decode("utf-8", "replace").strip(EDGES).lower()
        out.append(text.encode() if text.isalpha() or any(map(str.isalpha, text)) else b"")
    return out


def word_features(words: list[bytes], lexicon: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of cleaned words, one word after another, and how many each has.

    Letter n-grams of two and three bytes with marks at both ends (so affixes of one and two),
    prefixes and suffixes of four, the word itself, and one feature per lexicon.
    """
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n) + 2
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    begin = starts(sizes)[:-1]
    known = sizes > 2

    def hashed(kind: int, values: np.ndarray) -> np.ndarray:
        mixed = (values + np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)

    def gram(at: np.ndarray, size: int) -> np.ndarray:
        value = np.zeros(len(at), np.uint64)
        for j in range(size):
            value = (value << np.uint64(8)) | data[at + j]
        return value

    owners, ids = [], []
    for size in (2, 3):
        counts = np.where(known, np.maximum(sizes - size + 1, 0), 0)
        owners.append(np.repeat(np.arange(n), counts))
        ids.append(hashed(size, gram(spread(begin, counts), size)))
    long = np.flatnonzero(sizes >= 6)
    owners += [long, long]
    ids += [hashed(4, gram(begin[long], 5)), hashed(5, gram(begin[long] + sizes[long] - 5, 5))]
    some = np.flatnonzero(known)
    owners.append(some)
    ids.append(hashed(6, np.fromiter((xxhash.xxh3_64_intdigest(words[i]) >> 8 for i in some.tolist()), np.uint64, len(some))))
    listed = [(i, BUCKETS + k) for i in some.tolist() for k in lexicon.get(words[i], ())]
    owners.append(np.array([i for i, _ in listed], np.int64))
    ids.append(np.array([k for _, k in listed], np.int64))
    owner, feature = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.bincount(owner, minlength=n)


def potentials(model: Field, words: list[bytes]) -> np.ndarray:
    """Score of each language for each cleaned word; zeros for a word without letters."""
    feature, counts = word_features(words, model.lexicon)
    sums = np.zeros((len(feature) + 1, len(model.langs)))
    np.cumsum(model.weights[feature], axis=0, out=sums[1:])
    bounds = starts(counts)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def passes(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Factors of the positions and moves, and what lies before (with the position) and after it, scaled.

    All chains take a step together, longest first, so a step works on those not yet ended.
    """
    bounds = starts(lengths)[:-1]
    order = np.argsort(-lengths, kind="stable")
    begin, size = bounds[order], lengths[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # chains longer than t
    fact = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    moves = np.exp(change - change.max())
    forward, backward = np.empty_like(fact), np.empty_like(fact)
    state = np.zeros((0, fact.shape[1]))
    for t in range(longest):
        at = begin[: active[t]] + t
        state = fact[at] * (np.exp(start - start.max()) if t == 0 else state[: active[t]] @ moves)
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        ahead = np.ones((active[t], fact.shape[1]))
        if t + 1 < longest and active[t + 1]:
            ahead[: active[t + 1]] = state @ moves.T
        ahead /= ahead.sum(axis=1, keepdims=True)
        backward[at] = ahead
        state = ahead * fact[at]
    return fact, moves, forward, backward


def marginals(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of each language at each position, chains one after another."""
    _, _, forward, backward = passes(scores, lengths, change, start)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def gradient(scores: np.ndarray, lengths: np.ndarray, label: np.ndarray, change: np.ndarray, start: np.ndarray):
    """Of minus the log-likelihood of the labels: by position, by move and by language at the start."""
    fact, moves, forward, backward = passes(scores, lengths, change, start)
    both = forward * backward
    seen = np.eye(len(start))[label]
    gap = both / both.sum(axis=1, keepdims=True) - seen
    first = starts(lengths)[:-1][lengths > 0]
    inner = np.setdiff1d(np.arange(len(label)), first)
    pair = forward[inner - 1][:, :, None] * moves * (fact[inner] * backward[inner])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return gap, pair.sum(axis=0) - seen[inner - 1].T @ seen[inner], gap[first].sum(axis=0)


def fit(langs: list[str], samples: list[tuple[int, bytes]], how: Training) -> Field:
    """Learns weights and transitions from runs of words of known language.

    Each training chain joins one to four runs of languages drawn at random, so that changes
    within a text are seen. Gradient: expected minus seen features, with forward-backward.
    """
    rng = np.random.default_rng(how.seed)
    k = len(langs)
    codes, distinct, bounds = coded([text for _, text in samples])
    names = np.array([lang for lang, _ in samples], np.int64)
    words = cleaned(distinct)
    lexicon: dict[bytes, list[int]] = {}
    for lang in range(k):
        used = Counter()
        for i in np.flatnonzero(names == lang).tolist():
            used.update(codes[bounds[i] : bounds[i + 1]].tolist())
        merged = Counter()
        for c, n in used.items():
            merged[words[c]] += n
        for w in [w for w, _ in merged.most_common(how.lexicon + 1) if w][: how.lexicon]:
            lexicon.setdefault(w, []).append(lang)
    model = Field(langs, np.zeros((BUCKETS + k, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    some = [word_features(words[i : i + FITTED_WORDS], lexicon) for i in range(0, max(len(words), 1), FITTED_WORDS)]
    feature, counts = (np.concatenate(x) for x in zip(*some, strict=True))
    places = starts(counts)
    by_lang = [np.flatnonzero((names == lang) & (np.diff(bounds) > 0)) for lang in range(k)]
    usable = [lang for lang in range(k) if len(by_lang[lang])]
    if len(usable) < 2:
        return model
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.change, model.start)]
    for _ in range(how.steps):
        chain, label, lengths = [], [], []
        for _ in range(how.batch):
            begun = len(chain)
            for _ in range(int(rng.integers(1, 5))):
                lang = usable[int(rng.integers(len(usable)))]
                i = by_lang[lang][int(rng.integers(len(by_lang[lang])))]
                a = int(rng.integers(bounds[i], bounds[i + 1]))
                part = codes[a : min(bounds[i + 1], a + int(rng.integers(2, 13)))].tolist()
                chain += part
                label += [lang] * len(part)
            lengths.append(len(chain) - begun)
        chain, label, lengths = np.array(chain), np.array(label), np.array(lengths)
        own, where = np.unique(chain, return_inverse=True)
        ids = feature[spread(places[own], counts[own])]
        sums = np.zeros((len(ids) + 1, k))
        np.cumsum(model.weights[ids], axis=0, out=sums[1:])
        cut = starts(counts[own])
        scores = (sums[cut[1:]] - sums[cut[:-1]])[where]
        gap, moved, begun = gradient(scores, lengths, label, model.change, model.start)
        by_word = np.zeros((len(own), k))
        np.add.at(by_word, where, gap)
        steps = (
            (ids, np.repeat(by_word, counts[own], axis=0) / how.batch),
            (None, moved / how.batch),
            (None, begun / how.batch),
        )
        for value, square, (rows, grad) in zip((model.weights, model.change, model.start), squares, steps, strict=True):
            if rows is not None:
                touched, back = np.unique(rows, return_inverse=True)
                total = np.zeros((len(touched), k))
                np.add.at(total, back, grad)
                total += 1e-4 * value[touched]
                square[touched] += total**2
                value[touched] -= how.rate * total / np.sqrt(square[touched])
            else:
                square += grad**2
                value -= how.rate * grad / np.sqrt(square)
    model.weights = model.weights.astype(np.float32)
    return model


def runs_of_words(text: bytes, how: Training) -> list[bytes]:
    words = text.split()
    step = max(how.words, len(words) // how.segments)
    return [b" ".join(words[i : i + how.words]) for i in range(0, len(words), step)][: how.segments]


def learned(docs: DataFrame, lang: str, how: Training = Training()) -> Field | None:
    """A model from labelled rows (text and ``lang``); None if no row has both.

    Rates per language come from counts of all rows; only the bounded sample of runs reaches
    the driver, where the fit takes a few seconds whatever the size of the table.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    totals = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one number per language
    if not totals:
        return None
    langs = sorted(totals)
    rate = F.element_at(F.create_map(*[F.lit(x) for name in langs for x in (name, how.documents / totals[name])]), F.col(lang))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (name, run)
                for name, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)
                for run in runs_of_words(text, how)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.binary())], names=["lang", "run"]
            )

    sample = rows.where(chance < rate).select(F.col(lang).alias("lang"), "text").mapInArrow(cut, "lang string, run binary")
    pairs = sorted((langs.index(r["lang"]), bytes(r["run"])) for r in sample.collect())
    model = fit(langs, pairs, how)
    del pairs
    release()
    return model


def chunk_marginals(model: Field, texts: list[bytes]):
    """Codes, cleaned distinct words, bounds, and marginals of all words of some texts."""
    codes, distinct, bounds = coded(texts)
    words = cleaned(distinct)
    scores = potentials(model, words)[codes] if len(codes) else np.zeros((0, len(model.langs)))
    return codes, words, bounds, marginals(scores, np.diff(bounds), model.change, model.start) if len(codes) else scores


def predicted() -> list[StructField]:
    kinds = {"doc_id": LongType(), "lang_pred": StringType(), "score": DoubleType(), "n_switches": LongType(), "certainty": DoubleType()}
    return [StructField(name, kind) for name, kind in kinds.items()]


def identify(docs: DataFrame, model: Field | None, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (mean probability over words with letters), n_switches and certainty.

    A null text, one without a letter, or any text when there is no model is ``und`` with score
    0. Equal means go to the first language by code point. n_switches counts neighbouring words
    whose likeliest languages differ, certainty is the mean of each word's own best probability: high in
    code-switched text as well. An empty table gives no rows. One pass without a shuffle; rows repeat as given. With
    ``keep_row`` all columns of ``docs`` follow inside ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            for part in slices([len(t) for t in texts], CHUNK_BYTES):
                n = part.stop - part.start
                names, scores, switches, sure = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
                if held is not None:
                    codes, words, bounds, found = chunk_marginals(held, texts[part])
                    lettered = np.fromiter(map(bool, words), bool, len(words))[codes]
                    owner = np.repeat(np.arange(n), np.diff(bounds))
                    total = np.bincount(owner[lettered], minlength=n)
                    means = np.stack(
                        [np.bincount(owner[lettered], found[lettered, j], minlength=n) for j in range(len(held.langs))], axis=1
                    ) / np.maximum(total, 1)[:, None]
                    best = means.argmax(axis=1)
                    scores = np.where(total > 0, np.clip(means.max(axis=1), 0, 1), 0.0)
                    names = [held.langs[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)]
                    sure = np.bincount(owner[lettered], found[lettered].max(axis=1), minlength=n) / np.maximum(total, 1) if len(found) else sure
                    likely = found.argmax(axis=1)
                    differ = np.flatnonzero((np.diff(likely) != 0) & (np.diff(owner) == 0))
                    switches = np.bincount(owner[differ], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, n), pa.array(names), pa.array(scores), pa.array(switches, pa.int64()), pa.array(np.clip(sure, 0, 1))]
                    + [c.slice(part.start, n) for c in batch.columns[2:]],
                    names=["doc_id", "lang_pred", "score", "n_switches", "certainty", *["row"] * keep_row],
                )

    row = [F.struct("*").alias("row")] if keep_row else []
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    schema = StructType(predicted() + narrow.schema.fields[2:])
    return narrow.mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position, word, lang and p of every word: its likeliest language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for part in slices([len(t) for t in texts], CHUNK_BYTES):
                _, _, bounds, found = chunk_marginals(shared.value, texts[part])
                owner = np.repeat(np.arange(part.start, part.stop), np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner)),
                        pa.array(spread(np.zeros(part.stop - part.start, np.int64), np.diff(bounds))),
                        pa.array([w for t in texts[part] for w in t.split()], pa.binary()).cast(pa.string()),
                        pa.array([shared.value.langs[i] for i in found.argmax(axis=1).tolist()], pa.string()),
                        pa.array(found.max(axis=1) if len(found) else np.zeros(0)),
                    ],
                    names=["doc_id", "position", "word", "lang", "p"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, position long, word string, lang string, p double")


def fold(key: str | Column = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string")) % folds


def trained_on_folds(docs: DataFrame) -> Field | None:
    """The model of rows whose fold is not 0; a null id is in no fold."""
    return learned(docs.select("doc_id", "text", "lang").where(fold() != 0), "lang")
