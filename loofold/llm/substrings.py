"""Removal of repeated passages by super-k-mers.

A window is k consecutive words. Its minimiser is the least hash among the shorter runs of m
words inside it. Consecutive windows with one minimiser travel as one packed string to the
minimiser's bucket, so equal windows meet and each word travels about three times instead of k
times. There windows are sorted by hash and their words compared, and every window but those
of the smallest document is a repeat.

The same fold runs before the shuffle over a few megabytes of documents and again in the
bucket over a few megabytes of strings: of equal windows only those of the smallest document
go on, the others are repeats at once. A passage that a third of all documents share thus
reaches its bucket once per few megabytes, and a bucket holds its distinct windows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loofold.llm.words import parts, release, spread, texts_of

#: Text that is folded at once, and average text per bucket. Neither changes a result.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20

LAST = np.iinfo(np.int64).max  # stands for a null doc_id, which is smaller than none

ODD = 0x9E3779B97F4A7C15
BACK = pow(ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grown(base: int):
    """Powers of a base, computed once for the longest array asked for."""
    held = _powers(base, 1 << 10)

    def of(n: int) -> np.ndarray:
        nonlocal held
        if len(held) < n:
            held = _powers(base, max(n, 2 * len(held)))
        return held[:n]

    return of


_up, _down = _grown(ODD), _grown(BACK)
#: Masks that keep the lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
LONG_WORD = 64


def _word_hashes(line: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words together."""
    padded = line + b"\0" * 8
    eights = np.ndarray((len(line),), "<u8", padded, strides=(1,))
    out = size.astype(np.uint64)
    at, rest = np.arange(len(begin)), size
    for t in range(0, LONG_WORD, 8):
        value = eights[begin[at] + t] & _LOW[np.minimum(rest - t, 8)]
        out[at] = _mixed(out[at] * np.uint64(ODD) ^ value)
        more = rest > t + 8
        at, rest = at[more], rest[more]
        if not len(at):
            return out
    for i in at.tolist():
        out[i] = xxhash.xxh3_64_intdigest(line[begin[i] : begin[i] + size[i]])
    return out


class Segments:
    """Strings of words joined by one space, ordered by document, with all their windows of k words."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, rows: np.ndarray, first: np.ndarray, k: int):
        order = [i for i in np.argsort(docs, kind="stable").tolist() if texts[i]]
        self.k, self.docs, self.rows, self.first = k, docs[order], rows[order], first[order]
        self.line = b"\n".join([*map(texts.__getitem__, order), b""])
        data = np.frombuffer(self.line, np.uint8)
        self.ends = np.flatnonzero((data == 32) | (data == 10))
        self.begins = np.append(0, self.ends + 1)[:-1]
        self.bounds = np.append(0, np.flatnonzero(data[self.ends] == 10) + 1)
        self.hashes = _word_hashes(self.line, self.begins, self.ends - self.begins)
        counts = np.maximum(np.diff(self.bounds) - k + 1, 0)
        self.at = spread(self.bounds[:-1], counts)  # where each window begins
        self.segment = np.repeat(np.arange(len(counts)), counts)

    def window_hashes(self) -> np.ndarray:
        n = len(self.hashes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * _up(n), out=sums[1:])
        return _mixed((sums[self.at + self.k] - sums[self.at]) * _down(n)[self.at])

    def least_runs(self, m: int) -> np.ndarray:
        """Minimiser of each window: the least hash of its runs of m words."""
        n, width = len(self.hashes), self.k - m + 1
        runs = np.zeros(n, np.uint64)
        for j in range(m):
            runs[: n - j] += self.hashes[j:] * np.uint64(pow(ODD, 2 * j + 1, 1 << 64))
        least, span = _mixed(runs), 1
        while 2 * span <= width:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        return np.minimum(least[self.at], least[self.at + width - span])

    def string(self, window: int, count: int = 1) -> bytes:
        """The words of some windows that follow each other."""
        return self.line[self.begins[self.at[window]] : self.ends[self.at[window] + count + self.k - 2]]

    def firsts(self) -> np.ndarray:
        """For each window the first equal one; windows are in document order.

        Hashes are sorted with the window's number in their low bits. Windows that follow each
        other, as their firsts do, are then compared with them as one string.
        """
        n = len(self.at)
        low = max(1, (n - 1).bit_length())
        keys = (self.window_hashes() >> np.uint64(low) << np.uint64(low)) | np.arange(n, dtype=np.uint64)
        keys.sort()
        order = (keys & np.uint64((1 << low) - 1)).astype(np.int64)
        keys >>= np.uint64(low)
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        first = np.empty(n, np.int64)
        first[order] = np.repeat(order[head], np.diff(np.append(head, n)))
        later = np.flatnonzero(first != np.arange(n))
        if not len(later):
            return first
        to = first[later]
        new = (np.diff(later) != 1) | (np.diff(to) != 1) | (np.diff(self.segment[later]) != 0) | (np.diff(self.segment[to]) != 0)
        begin = np.flatnonzero(np.append(True, new))
        counts = np.diff(np.append(begin, len(later)))
        wrong: set[int] = set()
        for a, b, c in zip(later[begin].tolist(), to[begin].tolist(), counts.tolist(), strict=True):
            if self.string(a, c) != self.string(b, c):
                wrong.update(first[a : a + c].tolist())
        for head_ in wrong:  # equal hashes of different words: told apart by the words
            seen: dict[bytes, int] = {}
            for w in np.flatnonzero(first == head_).tolist():
                first[w] = seen.setdefault(self.string(w), w)
        return first

    def repeats(self) -> np.ndarray:
        """Whether each window also begins in a smaller document here."""
        if not len(self.at):
            return np.zeros(0, bool)
        own = self.docs[self.segment]
        return own > own[self.firsts()]

    def runs(self, windows: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run of neighbours with one segment and key."""
        if not len(windows):
            return windows, windows
        new = (np.diff(windows) != 1) | (np.diff(self.segment[windows]) != 0)
        if key is not None:
            new |= key[windows[1:]] != key[windows[:-1]]
        begin = np.flatnonzero(np.append(True, new))
        return windows[begin], np.diff(np.append(begin, len(windows)))

    def spans(self, windows: np.ndarray) -> list[np.ndarray]:
        """docs, rows, and from and to (words of the document) of runs of windows."""
        begin, counts = self.runs(windows)
        seg = self.segment[begin]
        start = self.first[seg] + self.at[begin] - self.bounds[seg]
        return [self.docs[seg], self.rows[seg], start, start + counts + self.k - 1]

    def packed(self, begin: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        """Strings of runs of windows, and their docs, rows and first words."""
        a, b = self.begins[self.at[begin]], self.ends[self.at[begin] + counts + self.k - 2]
        seg = self.segment[begin]
        first = self.first[seg] + self.at[begin] - self.bounds[seg]
        return [self.line[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], [self.docs[seg], self.rows[seg], first]


PARCELS = "bucket int, kind int, size long, strings binary, meta binary"


def _parcel(strings: list[bytes], meta: list[np.ndarray]) -> tuple[int, bytes, bytes]:
    raw = b"\n".join(strings)
    packed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    return len(raw), packed, np.concatenate([m.astype("<i8") for m in meta]).tobytes()


def super_kmers(docs: DataFrame, k: int, m: int, buckets: int) -> DataFrame:
    """Parcels for buckets from documents (doc_id, row, text).

    Kind 1 holds packed strings with document, row and first word of each; kind 0 holds spans
    that are repeats of a smaller document among those folded with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([LAST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            rows = batch.column(1).to_numpy()
            for part, texts in parts(batch.column(2), CHUNK_BYTES):
                here = Segments([b" ".join(t.split()) for t in texts], ids[part], rows[part], np.zeros(part.stop - part.start, np.int64), k)
                repeat = here.repeats()
                if not len(repeat):
                    continue
                least = here.least_runs(m)
                out = []
                spans = here.spans(np.flatnonzero(repeat))
                if len(spans[0]):
                    out.append((int(rows[part][0] % buckets), 0, *_parcel([], spans)))
                begin, counts = here.runs(np.flatnonzero(~repeat), least)
                to = (least[begin] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                strings, meta = here.packed(begin[order], counts[order])
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out.append((int(to[order[a]]), 1, *_parcel(strings[a:b], [x[a:b] for x in meta])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)],
                    names=["bucket", "kind", "size", "strings", "meta"],
                )

        release()

    return docs.mapInArrow(run, PARCELS)


TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
SPANS = "doc_id long, row long, begin long, end long"


def counted(parcels: DataFrame, k: int) -> DataFrame:
    """Spans of words that repeat a smaller document, from parcels sorted by bucket.

    One bucket after another is folded a few megabytes at a time; what goes on is one string
    per run of windows not seen in a smaller document.
    """

    def fold(strings: list[bytes], meta: list[np.ndarray]):
        here = Segments(strings, *meta, k)
        repeat = here.repeats()
        return here, here.spans(np.flatnonzero(repeat)), np.flatnonzero(~repeat)

    def batch_of(spans: list[np.ndarray]) -> pa.RecordBatch:
        docs = pa.array(spans[0], mask=spans[0] == LAST)
        return pa.RecordBatch.from_arrays([docs, *map(pa.array, spans[1:])], names=["doc_id", "row", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, strings, meta, held = None, [], [], 0
        none = [np.zeros(0, np.int64)] * 3

        def folded(last: bool):
            nonlocal strings, meta, held
            here, spans, rest = fold(strings, [np.concatenate(x) for x in zip(none, *meta, strict=True)])
            strings, meta, held = [], [], 0
            if not last and len(rest):
                packed, own = here.packed(*here.runs(rest))
                strings, meta = packed, [own]
            if len(spans[0]):
                yield batch_of(spans)

        for batch in batches:
            for bucket, kind, size, packed, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(more, "<i8")
                if kind == 0:
                    yield batch_of(list(values.reshape(4, -1)))
                    continue
                if bucket != current or held + size > CHUNK_BYTES:
                    if strings and held:
                        yield from folded(bucket != current)
                    if bucket != current:
                        strings, meta, held = [], [], 0
                    current = bucket
                strings.extend(pa.decompress(packed, size, codec="zstd", asbytes=True).split(b"\n"))
                meta.append(list(values.reshape(3, -1)))
                held += size
        if strings and held:
            yield from folded(True)
        release()

    return parcels.mapInArrow(run, SPANS)


def repeated_spans(docs: DataFrame, k: int = 50, m: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), begin and end of spans of words to remove; they may overlap."""
    if not 0 < m <= k:
        raise ValueError("m must lie between 1 and k")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parcels = super_kmers(rows, k, m, max(1, size // BUCKET_BYTES))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted(parcels.repartition(n, "bucket").sortWithinPartitions("bucket"), k)


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, k: int = 50, m: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of each row.

    A word goes if a window of k words covers it whose words also begin in a document with a
    smaller doc_id; windows are judged on the texts as given. A null text has no words and a
    text of fewer than k words loses none. Rows with equal ids aren't smaller than each other:
    they are judged apart. A null doc_id counts as larger than any other. Other columns are not
    read; an empty table gives no rows.
    """
    spans = (
        repeated_spans(docs, k, m, id_col, text_col)
        .groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"))
        .agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    joined = rows.join(spans, rows["row"].eqNullSafe(spans["__row"]) & rows["doc_id"].eqNullSafe(spans["__doc"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed, kept = texts_of(batch.column(1)), [], [], []
            for text, begins, ends in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                totals.append(len(words))
                if begins:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, begins, 1)
                    np.add.at(change, ends, -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    words = [words[i] for i in stay]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.select("doc_id", "text", "begins", "ends").mapInArrow(run, KEPT)
