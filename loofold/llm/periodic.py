"""Maximal periodic runs of words, from Lyndon arrays by Baier's grouping.

Phase one of Baier's suffix sorter groups suffixes by a common prefix, largest group first. Each
finished group lengthens the prefixes of the nearest unfinished places before its members; when
all groups are done, the prefix of a place is the longest Lyndon word that starts there. No
suffix array is built. By the runs theorem the root of every run is such a word under the order of
words or under its reverse, so both Lyndon arrays give all candidates, and the longest common
extensions of a root to both sides give its run.

A run of at least ``least`` words holds nothing but windows of least / 2 words that occur twice
in the document; stretches of such windows hold all runs whole and are all that is grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from loofold.llm.words import coded, parts, release, spread, starts

#: Text that is worked on at a time.
CHUNK_BYTES = 4 << 20

ODD = 0x9E3779B97F4A7C15


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place of a text of ranks.

    Groups form a list from the least to the greatest; a place that precedes members of the group
    in hand moves to a new group just above its own, the higher the more members follow it.
    Linear but for the path compression of ``skip``.
    """
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int64)
    distinct, group = np.unique(ranks, return_inverse=True)
    order = np.argsort(group, kind="stable").tolist()
    cuts = starts(np.bincount(group)).tolist()
    of = group.tolist()
    members = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    live = list(map(len, members))
    size = [1] * len(distinct)
    lower, upper = list(range(-1, len(distinct) - 1)), [*range(1, len(distinct)), -1]
    skip = list(range(n))  # an unfinished place leads to itself, a finished one to the left
    length = [0] * n
    g = len(distinct) - 1
    while g >= 0:
        here = [i for i in members[g] if of[i] == g] if live[g] else []
        members[g] = None
        own = size[g]
        for i in here:
            skip[i] = i - 1
            length[i] = own
        followed: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and skip[j] != j:
                up = skip[j]
                if up >= 0:
                    skip[j] = skip[up]  # halves the path
                j = up
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in followed.items():
            moved.setdefault((times, of[j]), []).append(j)
        for times, p in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            places = moved[times, p]
            if len(places) == live[p]:  # all that is left of the group
                size[p] += times * own
                continue
            new = len(size)
            size.append(size[p] + times * own)
            live.append(len(places))
            live[p] -= len(places)
            members.append(places)
            for j in places:
                of[j] = new
            above = upper[p]
            lower.append(p)
            upper.append(above)
            upper[p] = new
            lower[above] = new  # the group in hand is above p, so there is one
        g = lower[g]
    return np.array(length, np.int64)


class Extensions:
    """Longest common extensions of places of a text, by hashes of its prefixes and halving."""

    def __init__(self, codes: np.ndarray):
        x = codes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.power = np.full(len(x) + 1, ODD, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x ^ (x >> np.uint64(32))) * self.power[:-1], out=self.sums[1:])
        self.steps = [1 << k for k in range(max(len(x), 1).bit_length(), -1, -1)]

    def right(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Words from i on that equal those from i + q on."""
        room = len(self.sums) - 1 - i - q
        by, a, b = self.power[q], self.sums[i], self.sums[i + q]
        found = np.zeros(len(i), np.int64)
        for step in self.steps:
            ahead = np.minimum(found + step, room)
            same = (self.sums[i + ahead] - a) * by == self.sums[i + q + ahead] - b
            found = np.where(same, ahead, found)
        return found

    def left(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Words before i that equal those before i + q."""
        by, a, b = self.power[q], self.sums[i], self.sums[i + q]
        found = np.zeros(len(i), np.int64)
        for step in self.steps:
            back = np.minimum(found + step, i)
            same = (a - self.sums[i - back]) * by == b - self.sums[i + q - back]
            found = np.where(same, back, found)
        return found


def scanned(codes: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extensions word by word, for texts made to deceive the hashes."""
    text, right, left = codes.tolist(), [], []
    for a, p in zip(i.tolist(), q.tolist(), strict=True):
        x = a
        while x + p < len(text) and text[x] == text[x + p]:
            x += 1
        right.append(x - a)
        x = a
        while x > 0 and text[x - 1] == text[x + p - 1]:
            x -= 1
        left.append(a - x)
    return np.array(right, np.int64), np.array(left, np.int64)


def runs_of(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of each run of max(least, 2 * period) words or more.

    Negative codes are marks between texts: each occurs once, and below all words in both orders.
    """
    marks = codes < 0
    top = int(codes.max(initial=0)) + 1
    places, periods = [], []
    for ranks in (codes, np.where(marks, codes, top - codes)):
        q = lyndon_lengths(ranks)
        i = np.flatnonzero(~marks)
        q = q[i]
        ends = i + q < len(codes)
        equal = np.zeros(len(i), bool)  # the root is followed by its first word, or its last one precedes it
        equal[ends] = codes[i[ends]] == codes[(i + q)[ends]]
        inner = i > 0
        equal[inner] |= codes[i[inner] - 1] == codes[(i + q)[inner] - 1]
        places.append(i[equal])
        periods.append(q[equal])
    i, q = np.concatenate(places), np.concatenate(periods)
    lce = Extensions(codes)
    for right, left in ((lce.right(i, q), lce.left(i, q)), (None, None)):
        if right is None:
            right, left = scanned(codes, i, q)
        long = left + right >= np.maximum(q, least - q)
        found = np.unique(np.stack([i - left, i + q + right, q], axis=1)[long], axis=0)
        start, end, period = found[:, 0], found[:, 1], found[:, 2]
        checked = spread(start, end - start - period)
        if np.array_equal(codes[checked], codes[checked + np.repeat(period, end - start - period)]):
            break
    return start, end, period


def repeated_stretches(codes: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Whether each word is covered by a window of ``width`` words that occurs twice in its text."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n < width:
        return covered
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = owner[: n - width + 1].astype(np.uint64) * np.uint64(ODD)
    for k in range(width):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + codes[k : n - width + 1 + k].astype(np.uint64)
    key *= np.uint64(ODD)
    at = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n + 1, np.int64)
    again = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    np.add.at(twice, again, 1)
    np.add.at(twice, again + width, -1)
    return np.cumsum(twice[:-1]) > 0


def runs_of_texts(codes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """text, start in the text, length and period of all runs of some texts, in this order."""
    covered = np.flatnonzero(repeated_stretches(codes, bounds, max(1, least // 2)))
    empty = (np.zeros(0, np.int64),) * 4
    if not len(covered):
        return empty
    owner = np.searchsorted(bounds, covered, "right") - 1
    breaks = np.flatnonzero((np.diff(covered) != 1) | (np.diff(owner) != 0)) + 1
    joined = np.insert(codes[covered], breaks, -1 - np.arange(len(breaks)))
    where = np.insert(covered, breaks, -1)
    start, end, period = runs_of(joined, least)
    text = np.searchsorted(bounds, where[start], "right") - 1
    begin, length = where[start] - bounds[text], end - start
    order = np.lexsort((period, begin, text))
    return text[order], begin[order], length[order], period[order]


RUN = ("start", "length", "period")
RESULT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("runs", ArrayType(StructType([StructField(name, LongType()) for name in RUN]))),
        StructField("collapsed", StringType()),
    ]
)


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text.

    A run is a longest stretch of words with smallest period q and at least max(least, 2 * q)
    words; ``collapsed`` leaves out each word that a run covers after the run's first q words.
    ``least`` is 2 or more. A null or empty text has no words, no runs and an empty collapsed
    text. Rows are worked on apart, so repeated rows and equal or null ids repeat as given, and
    an empty table gives no rows. One pass without a shuffle, some megabytes of text at a time;
    a text's stretches of repeated words take about 400 bytes a word. With ``keep_row`` all columns
    follow inside ``row``, so names can't clash.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch.column(1), CHUNK_BYTES):
                n = len(texts)
                codes, distinct, bounds = coded(texts)
                text, begin, length, period = runs_of_texts(codes, bounds, least)
                gone = np.zeros(len(codes) + 1, np.int64)
                np.add.at(gone, bounds[text] + begin + period, 1)
                np.add.at(gone, bounds[text] + begin + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                left = starts(np.bincount(np.repeat(np.arange(n), np.diff(bounds))[kept], minlength=n)).tolist()
                words = list(map(distinct.__getitem__, codes[kept].tolist()))
                rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begin, length, period)], names=list(RUN))
                offsets = pa.array(starts(np.bincount(text, minlength=n)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, n),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(offsets, rows),
                        pa.array([b" ".join(words[a:b]) for a, b in zip(left, left[1:], strict=False)], pa.binary()).cast(pa.string()),
                        *(c.slice(part.start, n) for c in batch.columns[2:]),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed", *["row"] * keep_row],
                )
        release()

    row = [F.struct("*").alias("row")] if keep_row else []
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    schema = StructType([narrow.schema["doc_id"], *RESULT.fields, *narrow.schema.fields[2:]])
    return narrow.mapInArrow(run, schema)
