"""Ranked lexical search by inner products over sparse ball trees.

A document is the sparse vector of what each term adds to a score, a query the set of its terms;
their inner product is the score, a whole number. Blocks of documents are split into balls by the
distance to two far members. A ball holds its centroid and, for bands of terms of like weight, the
largest distance of a member from it; by the Cauchy-Schwarz inequality per band no member scores
more than centroid . query + sum of radius * sqrt(terms of the query in the band). Balls are taken
best bound first until no bound reaches the k-th score; leaves add up whole numbers.
Bounds are rounded up by more than all their floating-point errors, so nothing is lost.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from loofold.llm.words import parts, release, spread, starts, texts_of
from loofold.session import written_table

CHUNK_BYTES = 4 << 20

#: Bytes of query texts that share one pass over the documents; a longer text is alone in its pass.
QUERY_BYTES = 256 << 10

#: Documents of a leaf and of a tree at most, numbers of a tree's centroids, and bands of terms.
LEAF, BLOCK, CENTROID_CELLS, BANDS = 64, 16_384, 4 << 20, 1024

#: Bytes that are part of terms stay, capitals A to Z in lower case; all others become spaces.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, their terms with repeats, and the weight of each query term."""

    documents: int
    length: int
    weights: np.ndarray

    def parts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each term adds to the score of its document of ``n`` terms."""
        m = 50 + 50 * n * self.documents // max(self.length, 1)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class BallTree:
    """Balls of documents given as sparse rows (bounds, term, value); a row's terms ascend.

    ``bands`` gives the band of each term and ascends too. ``order`` lists the rows so that each
    ball is a range of it.
    """

    def __init__(self, bounds: np.ndarray, term: np.ndarray, value: np.ndarray, bands: np.ndarray, leaf: int = LEAF):
        self.width, self.bands = len(bands), bands
        self.n_bands = int(bands.max(initial=0)) + 1
        self.ranges: list[tuple[int, int]] = []
        self.children: list[list[int] | None] = []
        centers, radii = [], []
        order = np.arange(len(bounds) - 1)
        todo = [(0, len(order), None, 0)] if len(order) else []
        while todo:
            begin, end, parent, side = todo.pop()
            node, rows = len(centers), order[begin:end]
            if parent is not None:
                self.children[parent][side] = node
            counts = bounds[rows + 1] - bounds[rows]
            at, cuts = spread(bounds[rows], counts), starts(counts)
            t, x = term[at], value[at].astype(float)
            center = np.bincount(t, x, minlength=self.width) / len(rows)
            centers.append(center)
            radii.append(self._radius(t, x, cuts, center))
            self.ranges.append((begin, end))
            self.children.append([-1, -1] if len(rows) > leaf else None)
            if len(rows) > leaf:
                nearness = self._nearness(t, x, cuts, center)
                by = np.argsort(nearness, kind="stable")
                cut, least = int(np.count_nonzero(nearness <= 0)), max(1, len(rows) // 16)  # depth grows with the logarithm
                cut = min(max(cut, least), len(rows) - least) if 0 < cut < len(rows) else len(rows) // 2
                order[begin:end] = np.concatenate((np.sort(rows[by[:cut]]), np.sort(rows[by[cut:]])))
                todo += [(begin, begin + cut, node, 0), (begin + cut, end, node, 1)]
        self.order = order
        counts = np.diff(bounds)[order]
        at = spread(bounds[order], counts)
        self.term, self.value, self.bounds = term[at], value[at], starts(counts)
        self.centers = np.stack(centers) if centers else np.zeros((0, self.width))
        self.radii = np.stack(radii) if radii else np.zeros((0, self.n_bands))

    def _radius(self, t, x, cuts, center) -> np.ndarray:
        """Largest distance of a row from the center in each band, never less than it is."""
        c, band = center[t], self.bands[t]
        own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        outer = np.bincount(self.bands, center * center, minlength=self.n_bands)  # of a row without the band
        most, size = np.zeros(self.n_bands), outer.copy()
        if len(t):
            first = np.flatnonzero(np.append(True, (np.diff(band) != 0) | (np.diff(own) != 0)))
            moved, kept = (x - c) ** 2, c * c
            np.maximum.at(most, band[first], np.add.reduceat(moved - kept, first))
            np.maximum.at(size, band[first], np.add.reduceat(moved + kept, first))
        slack = (size + outer) * (self.width + 64) * 2.0**-51
        return np.sqrt(most + outer + slack)

    def _nearness(self, t, x, cuts, center) -> np.ndarray:
        """Below zero for rows nearer to the first of two far members."""
        own = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))

        def away(point):  # squared distance but for the point's own square
            return np.bincount(own, x * x - 2 * x * point[t], minlength=len(cuts) - 1)

        def dense(i):
            out = np.zeros(self.width)
            out[t[cuts[i] : cuts[i + 1]]] = x[cuts[i] : cuts[i + 1]]
            return out

        one = dense(int(away(center).argmax()))
        first = away(one)
        two = dense(int(first.argmax()))
        return (first + one @ one) - (away(two) + two @ two)

    def upper_bounds(self, queries: np.ndarray) -> np.ndarray:
        """No member of a ball scores more; queries are rows of 0 and 1 over terms."""
        root = np.sqrt(np.stack([np.bincount(self.bands, q, minlength=self.n_bands) for q in queries], axis=1))
        exact = self.centers @ queries.T + self.radii @ root
        return np.ceil(exact * (1 + (self.width + 64) * 2.0**-50)) + 1

    def best(self, query: np.ndarray, bound: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Rows and scores of the k best (ties: lower row) that are positive and reach ``floor``.

        ``query`` is 0 or 1 per term. Also the k-th score, at least ``floor``, and how many leaves were looked into.
        """
        rows, scores, looked = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        floor = max(floor, 1)
        heap = [(-bound[0], 0)] if len(bound) else []
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            looked += 1
            begin, end = self.ranges[node]
            cuts = self.bounds[begin : end + 1]
            here = slice(cuts[0], cuts[-1])
            sums = starts(self.value[here] * query[self.term[here]])[cuts - cuts[0]]
            total = sums[1:] - sums[:-1]
            if total.max() < floor:
                continue
            good = total >= floor
            rows, scores = np.append(rows, self.order[begin:end][good]), np.append(scores, total[good])
            by = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[by], scores[by]
            if len(rows) == k:
                floor = max(floor, int(scores[-1]))
        return rows, scores, floor, looked


def measured(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the query terms of each document with a term: their numbers and frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most QUERY_BYTES of distinct terms, or one text's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part, texts in parts(batch.column(1), CHUNK_BYTES):
                lists = list(map(terms_of, texts))
                n = np.fromiter(map(len, lists), np.int64, len(lists))
                found = np.fromiter(map(known.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(n.sum()))
                owner = np.repeat(np.arange(len(lists)), n)[found >= 0]
                pairs, tf = np.unique(owner * len(known) + found[found >= 0], return_counts=True)
                own, term = np.divmod(pairs, max(len(known), 1))
                offsets = pa.array(starts(np.bincount(own, minlength=len(lists))), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(lists)),
                        pa.array(n),
                        pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "tf"],
                )
                yield out.filter(pa.array(n > 0))
        release()

    kinds = [docs.schema["doc_id"], StructField("n", LongType())]
    kinds += [StructField("terms", ArrayType(IntegerType())), StructField("tf", ArrayType(LongType()))]
    return docs.select("doc_id", "text").mapInArrow(run, StructType(kinds))


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in blocks of at most ``most``, small batches put together."""
    held, n = [], 0
    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            piece = batch.slice(begin, most)
            if n + piece.num_rows > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def searched(vectors: DataFrame, corpus: Corpus, ids: pa.Array, queries: list[np.ndarray], k: int, item: StructField) -> DataFrame:
    """item_id, doc_id and score of the k best of each block of documents, as far as they can be of all.

    Terms are numbered anew by weight in the trees, so that bands hold terms of like weight.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((corpus, ids, queries))
    width = len(corpus.weights)
    most = int(min(BLOCK, max(LEAF, CENTROID_CELLS // max(width, 1) * LEAF // 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, ids, queries = shared.value
        rank = np.empty(width, np.int64)
        rank[np.argsort(corpus.weights, kind="stable")] = np.arange(width)
        bands = np.arange(width) * min(BANDS, width) // max(width, 1)
        floors = [1] * len(queries)
        for batch in blocks_of(batches, most):
            batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_end"))  # ties by row are ties by id
            term = batch.column("terms").flatten().to_numpy().astype(np.int64)
            tf = batch.column("tf").flatten().to_numpy()
            bounds = starts(pc.list_value_length(batch.column("terms")).to_numpy())
            n = np.repeat(batch.column("n").to_numpy(), np.diff(bounds))
            value = corpus.parts(n, term, tf)
            order = np.lexsort((rank[term], np.repeat(np.arange(batch.num_rows), np.diff(bounds))))
            tree = BallTree(bounds, rank[term][order], value[order], bands)
            rows, own, scores = [], [], []
            for begin in range(0, len(queries), 256):
                some = queries[begin : begin + 256]
                sets = np.zeros((len(some), width), np.int64)
                for q, held in enumerate(some):
                    sets[q, rank[held]] = 1
                upper = tree.upper_bounds(sets.astype(float))
                for q in range(len(some)):
                    found, score, floors[begin + q], _ = tree.best(sets[q], upper[:, q], k, floors[begin + q])
                    rows.append(found)
                    scores.append(score)
                    own.append(np.full(len(found), begin + q))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(own))), batch.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))],
                    names=["item_id", "doc_id", "score"],
                )
        release()

    schema = StructType([item, vectors.schema["doc_id"], StructField("score", LongType())])
    return vectors.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item with a score above 0.

    Equal scores rank by ascending id, null last; rows of equal ids and scores may swap. Rows of
    ``items`` with one id (null is one too) are one query of all their terms, each counted once. A
    null or empty text has no terms: such a document is in no result and no count, such an item
    has no rows. An empty table gives no rows. Other columns are ignored, so names can't clash.

    Items go through in passes of ``QUERY_BYTES`` of text, the driver holds one pass at a time. A pass
    reads the documents once, writes their query terms as a narrow table, counts, and
    searches trees of at most ``BLOCK`` documents apart; each task lists k rows an item and block at
    most, and fewer as its k-th scores rise. Every document is in a tree: nothing is sampled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-held // QUERY_BYTES)
    found = None
    for p in range(passes):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow().combine_chunks()
        by_id: dict[object, set[bytes]] = {}
        for i, text in zip(some.column("item_id").to_pylist(), texts_of(some.column("text")), strict=True):
            by_id.setdefault(i, set()).update(terms_of(text))
        terms = {t: i for i, t in enumerate(sorted(set().union(*by_id.values())))}
        if not terms:
            continue
        ids = pa.array(list(by_id), some.schema.field("item_id").type)
        queries = [np.array(sorted(map(terms.__getitem__, held)), np.int64) for held in by_id.values()]
        vectors = written_table(measured(docs, terms), "vectors")
        total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a number per query term
        weights = np.array([weight(total[0], df.get(t, 0)) for t in range(len(terms))], np.int64)
        rows = searched(vectors, Corpus(*total, weights), ids, queries, k, items.schema["item_id"])
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        schema = StructType([items.schema["item_id"], StructField("rank", IntegerType()), docs.schema["doc_id"], StructField("score", LongType())])
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
