"""Context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text and ends a chunk wherever it is one below a
multiple of the block size, 3 * 2^k. Each chunk gives one of 64 letters, so an edit changes the
letters of the chunks it touches and no others. The block size follows the length of the text;
letters are kept for it and for twice it, and fingerprints compare where block sizes meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loofold.llm.words import slices, starts, texts_of

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LONGEST = len(LETTERS)  # letters of a signature; the last one covers all the rest of the text
WINDOW, RUN = 7, 4
CHUNK_BYTES = 4 << 20
BLOCK = 1 << 18

ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(ODD, BLOCK), _powers(BACK, BLOCK)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> x.dtype.type(15))) * x.dtype.type(0x2C1B3C6D)
    return x ^ (x >> x.dtype.type(13))


def _boundaries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a chunk of the smallest block may end, and the power of two in each."""
    places, powers = [], []
    for begin in range(0, len(data), BLOCK):
        ahead = min(begin, WINDOW - 1)
        part = data[begin - ahead : begin + BLOCK].astype(np.uint32) + np.uint32(1)
        rolled = np.zeros(len(part) - ahead, np.uint32)
        for j in range(min(WINDOW, len(part))):
            shifted = part[max(0, ahead - j) : len(part) - j]
            rolled[len(rolled) - len(shifted) :] += shifted * np.uint32(pow(0x01000193, j + 1, 1 << 32))
        rolled = _mixed(rolled)
        at = np.flatnonzero(rolled % np.uint32(3) == 2)
        above = (rolled[at].astype(np.int64) + 1) | (1 << 31)
        places.append(at + begin)
        powers.append(np.log2(above & -above).astype(np.int64))
    return np.concatenate(places), np.concatenate(powers)


def _prefix_sums(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of (byte + 1) * ODD^place before each place in ``at`` (ascending), and BACK^place."""
    sums, backs = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    before = 0
    cuts = np.searchsorted(at, np.arange(0, len(data) + BLOCK + 1, BLOCK))
    for b, begin in enumerate(range(0, len(data) + 1, BLOCK)):
        here = slice(cuts[b], cuts[b + 1])
        part = data[begin : begin + BLOCK].astype(np.uint64) + np.uint64(1)
        local = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _UP[: len(part)], out=local[1:])
        up, down = np.uint64(pow(ODD, begin, 1 << 64)), np.uint64(pow(BACK, begin, 1 << 64))
        sums[here] = local[at[here] - begin] * up + np.uint64(before)
        backs[here] = _DOWN[at[here] - begin] * down
        before = (before + int(local[-1]) * int(up)) % (1 << 64)
    return sums, backs


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: k of the block size, and letters at k and k + 1 as rows ended by zeros."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer((b"\0" * WINDOW).join([b"", *texts]), np.uint8)
    begin = starts(sizes + WINDOW)[:-1] + WINDOW
    end = begin + sizes
    at, power = _boundaries(data) if len(data) else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(begin, at, "right") - 1
    inside = (doc >= 0) & (at < end[np.maximum(doc, 0)]) if n else np.zeros(0, bool)
    at, power, doc = at[inside] + 1, power[inside], doc[inside]  # a chunk ends behind its last byte

    counts = np.bincount(doc * 33 + np.minimum(power, 31), minlength=33 * n).reshape(n, 33)
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # boundaries at each k
    most = np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / (3 * LONGEST)))).astype(np.int64)
    enough = (counts >= LONGEST // 2) & (np.arange(33) <= most[:, None])
    k = np.where(enough.any(axis=1), 32 - enough[:, ::-1].argmax(axis=1), 0)

    out = []
    for step in (0, 1):
        use = power >= k[doc] + step
        own, place = doc[use], at[use]
        first = starts(np.bincount(own, minlength=n))[:-1]
        nth = np.arange(len(own)) - first[own]
        own, place, nth = own[nth < LONGEST - 1], place[nth < LONGEST - 1], nth[nth < LONGEST - 1]
        cuts = np.bincount(own, minlength=n)
        last = begin.copy()
        last[own] = place  # of repeated places the last stays
        rest = np.flatnonzero(last < end)
        own, place, nth = np.append(own, rest), np.append(place, end[rest]), np.append(nth, cuts[rest])
        order = np.lexsort((nth, own))
        own, place, nth = own[order], place[order], nth[order]
        before = np.where(nth == 0, begin[own], np.append(0, place[:-1])) if len(own) else place
        where, index = np.unique(np.concatenate((before, place)), return_inverse=True)
        sums, backs = _prefix_sums(data, where)
        a, b = index[: len(own)], index[len(own) :]
        hashed = (sums[b] - sums[a]) * backs[a]
        hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        letters = np.zeros((n, LONGEST), np.uint8)
        letters[own, nth] = LETTERS[(hashed >> np.uint64(58)).astype(np.int64)]
        out.append(letters)
    return k, *out


def fingerprint_strings(k: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[str]:
    """block size : letters : letters at twice the block size."""
    a, b = (x.view(f"S{LONGEST}").ravel().tolist() for x in (one, two))
    return [f"{3 << i}:{x.decode()}:{y.decode()}" for i, x, y in zip(k.tolist(), a, b, strict=True)]


def parsed(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [f.split(":") for f in fingerprints]
    k = np.array([(int(p[0]) // 3).bit_length() - 1 for p in parts], np.int64)
    rows = (np.array([p[i].encode() for p in parts] or [b""], f"S{LONGEST}") for i in (1, 2))
    return k, *(np.ascontiguousarray(r).view(np.uint8).reshape(-1, LONGEST)[: len(parts)] for r in rows)


def letter_likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - distance / letters of both, for the edit distance of insertions and deletions.

    Rows of letters ended by zeros. 0 where they share no run of four letters (or of all the
    shorter has), as chance alone gives some likeness. The distance comes from the longest
    common subsequence, one bit per letter.
    """
    size_a, size_b = (a != 0).sum(axis=1), (b != 0).sum(axis=1)
    run = np.minimum(np.minimum(size_a, size_b), RUN)
    rest = np.full(len(a), ~np.uint64(0))
    runs = [np.zeros(len(a), np.uint64) for _ in range(RUN)]
    longest = np.zeros(len(a), np.int64)
    for j in range(b.shape[1]):
        equal = (a == b[:, j, None]) & (b[:, j, None] != 0)
        match = np.packbits(equal, axis=1, bitorder="little").view(np.uint64).ravel()
        both = rest & match
        rest = (rest + both) | (rest - both)
        for r in range(RUN - 1, 0, -1):
            runs[r] = (runs[r - 1] << np.uint64(1)) & match
        runs[0] = match
        for r in range(RUN):
            longest = np.where(runs[r] != 0, np.maximum(longest, r + 1), longest)
    common = np.bitwise_count(~rest).astype(np.int64)
    total = size_a + size_b
    like = np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)
    return np.where(longest >= run, like, 0.0)


def likeness_of(x: tuple, y: tuple) -> np.ndarray:
    """Likeness of signatures pair by pair: 0 where block sizes are more than a factor 2 apart."""
    (k, a, aa), (m, b, bb) = x, y
    out = np.zeros(len(k))
    for where, left, right in (
        (k == m, a, b),
        (k == m, aa, bb),
        (k == m + 1, a, bb),
        (m == k + 1, aa, b),
    ):
        at = np.flatnonzero(where & (left != 0).any(axis=1) & (right != 0).any(axis=1))
        out[at] = np.maximum(out[at], letter_likeness(left[at], right[at]))
    same = (k == m) & (a == b).all(axis=1) & (aa == bb).all(axis=1)
    return np.where(same, 1.0, out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of each row, without a shuffle.

    A null text counts as empty, whose fingerprint has no letters. Equal texts have equal
    fingerprints. Repeated rows are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for part in slices([len(t) for t in texts], CHUNK_BYTES):
                here = texts[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(here)),
                        pa.array([len(t.decode("utf-8", "replace")) for t in here], pa.int64()),
                        pa.array(fingerprint_strings(*signatures(here))),
                    ],
                    names=["doc_id", "n_chars", "fingerprint"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two columns of fingerprints; a null is like nothing (0)."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.zeros(len(a))
    out[known] = likeness_of(parsed(a[known].tolist()), parsed(b[known].tolist()))
    return pd.Series(out)


def dealt_by_range(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt into ranges of ids, each followed by the first of the next.

    Adds ``range`` and ``ahead`` (1 for the copy that follows a range; after the last range
    comes the first row of all). Rows are ordered by range, ahead, doc_id (null last), text.
    Range ends are ids of the table, taken from a bounded sample of 20 ids a range; they move
    rows between tasks and change no result.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").where("doc_id is not null")
    some = sorted({r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(20 * n).collect()})
    least = ids.agg(F.min("doc_id")).first()[0]
    first = sorted({least, *some[:: max(1, len(some) // n)]}) if some else []
    ends, end_ids = np.array(first, np.int64), set(first)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            keys = np.array([ends[-1] if x is None else x for x in own.to_pylist()], np.int64) if len(ends) else np.zeros(len(own), np.int64)
            at = np.maximum(np.searchsorted(ends, keys, "right") - 1, 0)
            copied = np.array([x in end_ids or not end_ids for x in own.to_pylist()], bool)
            more = np.flatnonzero(copied)
            if not len(ends):
                at, to = np.zeros(len(own), np.int64), np.zeros(len(more), np.int64)
            else:
                to = (at[more] - 1) % len(ends)
            rows = pa.array(np.concatenate((np.arange(len(own)), more)))
            yield pa.RecordBatch.from_arrays(
                [
                    own.take(rows),
                    batch.column(1).take(rows),
                    pa.array(np.concatenate((at, to)), pa.int64()),
                    pa.array(np.repeat([0, 1], [len(own), len(more)]), pa.int32()),
                ],
                names=["doc_id", "text", "range", "ahead"],
            )

    dealt = docs.mapInArrow(deal, "doc_id long, text string, range long, ahead int")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_last(), "text")


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, with their likeness and that to the next text.

    The edit puts the first floor(n_chars / 2) code points of the next text (or all it has) in
    the place of the last floor(n_chars / 2). Next is by doc_id ascending, nulls last, equal ids
    by text; after the last comes the first, and a single row is its own next. Null texts count
    as empty; repeated rows are kept. The texts move once, by ranges of ids; a task holds a few
    megabytes of them, or one text if that is longer.
    """

    def judged(group: list[tuple]) -> pa.RecordBatch:
        texts = [g[1] for g in group]
        strings = [t.decode("utf-8", "replace") for t in texts]
        edits = [
            (s[: len(s) - len(s) // 2] + nxt[: len(s) // 2]).encode("utf-8", "replace")
            for s, nxt in zip(strings, strings[1:], strict=False)
        ]
        own, edit = signatures(texts), signatures(edits)
        this, nxt = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
        keep = pa.array([g[2] == 0 for g in group[:-1]])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in group[:-1]], pa.int64()),
                pa.array([len(s) for s in strings[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits]),
                pa.array(fingerprint_strings(*this)),
                pa.array(fingerprint_strings(*edit)),
                pa.array(likeness_of(this, edit)),
                pa.array(likeness_of(this, nxt)),
            ],
            names=NAMES,
        ).filter(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                group.append(row)
                size += len(row[1])
                if size > CHUNK_BYTES and len(group) > 1:
                    yield judged(group)
                    group, size = [row], len(row[1])
        if len(group) > 1:
            yield judged(group)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return dealt_by_range(narrow).mapInArrow(run, EDITED)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
