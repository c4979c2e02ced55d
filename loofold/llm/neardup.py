"""Near duplicates by improved consistent weighted sampling.

A text is the multiset of its runs of five words, weighted by how often a run occurs in the
text and by how rare it is in the corpus. Improved consistent weighted sampling draws a run per
hash so that two texts agree with probability equal to their weighted Jaccard similarity. Bands
of draws are bucket keys. In each bucket the texts are linked to the one that shares most
buckets with others, and a link counts if the weighted Jaccard of the whole texts reaches the
threshold. Texts that are then not connected to a bucket's centre are compared with every member
they are not connected to: in a join in small buckets, block by block in larger ones, where the
blocks verify what they compare and give the links of a spanning forest only. No bucket has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loofold.llm.components import components
from loofold.llm.words import coded, slices, spread, starts, texts_of
from loofold.session import written_table

CHUNK_BYTES = 1 << 20
#: Runs share a document frequency by the low bits of their hash, so the table is bounded.
FREQUENCY_BITS = 18
FREQUENCY_PARTS = 64
#: Rows of an id and a digest that may be broadcast: at most 64 MB.
BROADCAST_ROWS = 500_000
#: Texts of a large bucket that meet as many others in one group, and runs compared at a time there.
BLOCK = 512
COLUMNS = 4096


@dataclass(frozen=True)
class Settings:
    """``rarity`` is how much more the rarest run weighs than one in every text.

    It is small so that the edits of a copy, whose runs are rare, do not outweigh the rest,
    which is frequent for the very reason that it was copied. Pairs of similarity s share a
    bucket with probability 1 - (1 - s^rows)^bands: 0.9998 at 0.8 and more above.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 3
    rarity: float = 0.25
    small: int = 8  # members up to which a bucket is compared in a join, else block by block


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of each text's distinct runs of words, ascending, their counts, and bounds.

    A text shorter than a run is one run of all its words; one without words has none.
    """
    codes, distinct, bounds = coded(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]
    counts = np.diff(bounds)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at, owner = spread(bounds[:-1], runs), np.repeat(np.arange(len(texts)), runs)
    length = np.minimum(counts, size)[owner]
    value = np.zeros(len(at), np.uint64)
    for j in range(size):
        use = length > j
        value[use] = value[use] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[use] + j] + np.uint64(j + 1)
    key = (owner.astype(np.uint64) << np.uint64(48)) | (_mixed(value) >> np.uint64(16))
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    own = (key[new] >> np.uint64(48)).astype(np.int64)
    return key[new] & np.uint64((1 << 48) - 1), times, starts(np.bincount(own, minlength=len(texts)))


def frequencies(docs: DataFrame, how: Settings) -> tuple[np.ndarray, int]:
    """Texts per hashed run, over all rows of (text), and the number of texts with words."""
    size = 1 << FREQUENCY_BITS
    width = size // FREQUENCY_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            for part in slices([len(t) for t in texts], CHUNK_BYTES):
                found, _, bounds = shingles(texts[part], how.shingle)
                total += np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)
                n += int((np.diff(bounds) > 0).sum())
        parts = [*range(FREQUENCY_PARTS), FREQUENCY_PARTS]
        sums = [total[i * width : (i + 1) * width].tobytes() for i in range(FREQUENCY_PARTS)] + [np.int64(n).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(sums, pa.binary())], names=["part", "sums"])

    def add(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                here = np.frombuffer(raw, np.int64)
                total = here.copy() if total is None else total + here
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def summed(table: pa.Table) -> pa.Table:
        key = (table.column("part")[0],)
        return pa.Table.from_batches(add(key, iter(table.to_batches())))

    schema = "part int, sums binary"
    rows = docs.mapInArrow(count, schema).groupBy("part").applyInArrow(summed, schema).collect()
    found = {r["part"]: np.frombuffer(bytes(r["sums"]), np.int64) for r in rows}
    if not found:
        return np.zeros(size, np.int64), 0
    return np.concatenate([found[i] for i in range(FREQUENCY_PARTS)]), int(found[FREQUENCY_PARTS][0])


def rarity_weights(counts: np.ndarray, n: int, how: Settings) -> np.ndarray:
    """1 + rarity * idf / largest idf, by hashed run."""
    idf = np.log1p(n / np.maximum(counts, 1)) / np.log1p(max(n, 1))
    return (1 + how.rarity * np.clip(idf, 0, 1)).astype(np.float32)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of n equal parts."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - np.exp(-middle) * (1 + middle) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


GAMMA = _gamma_quantiles(1 << 16).astype(np.float32)
INVERSE, LOG_GAMMA = (1 / GAMMA).astype(np.float32), np.log(GAMMA).astype(np.float32)


def samples(found: np.ndarray, weights: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n draws (rows) for each text with runs (columns): hashes of the run and its level."""
    begin = bounds[:-1][np.diff(bounds) > 0]
    sizes = np.diff(np.append(begin, len(found)))
    log_weight = np.log(weights).astype(np.float32)
    out = np.zeros((n, len(begin)), np.uint64)
    low = np.uint64(0xFFFF)
    for i in range(n):
        x = _mixed(found + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64)))
        r = (x & low).astype(np.int64)
        b = ((x >> np.uint64(32)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        level = np.floor(log_weight * INVERSE[r] + b)
        a = LOG_GAMMA[((x >> np.uint64(16)) & low).astype(np.int64)] - GAMMA[r] * (level - b + np.float32(1))
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        where = np.searchsorted(hit, begin)  # the first of each text
        at = hit[where]
        out[i] = _mixed(found[at] ^ (level[at].astype(np.int64).astype(np.uint64) << np.uint64(48)))
    return out


SKETCHES = "doc_id long, node string, draws binary, keys array<long>"


def sketches(docs: DataFrame, weights: np.ndarray, how: Settings) -> DataFrame:
    """Draws (32 bits each) and band keys of rows (doc_id, node, text); none without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    mask = np.uint64((1 << FREQUENCY_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            texts = texts_of(batch.column(2))
            for part in slices([len(t) for t in texts], CHUNK_BYTES):
                found, times, bounds = shingles(texts[part], how.shingle)
                n = part.stop - part.start
                draws, keys = [None] * n, [None] * n
                if len(found):
                    drawn = samples(found, times * rarity[(found & mask).astype(np.int64)], bounds, how.bands * how.rows)
                    band = np.zeros((how.bands, drawn.shape[1]), np.uint64)
                    for r in range(how.rows):
                        band = _mixed(band + drawn[r :: how.rows] + np.arange(1, how.bands + 1, dtype=np.uint64)[:, None])
                    raw = np.ascontiguousarray(drawn.T).astype("<u4")
                    lists = band.T.astype(np.int64).tolist()
                    for j, i in enumerate(np.flatnonzero(np.diff(bounds)).tolist()):
                        draws[i], keys[i] = raw[j].tobytes(), lists[j]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, n),
                        batch.column(1).slice(part.start, n),
                        pa.array(draws, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "node", "draws", "keys"],
                )

    return docs.mapInArrow(run, SKETCHES)


def vectors(texts: DataFrame, how: Settings) -> DataFrame:
    """node and its runs: their number, 32-bit hashes ascending, then counts where not 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = texts_of(batch.column(1))
            for part in slices([len(t) for t in held], CHUNK_BYTES):
                found, times, bounds = shingles(held[part], how.shingle)
                out = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    runs, where = np.unique(found[a:b].astype(np.uint32), return_inverse=True)
                    counts = np.bincount(where, times[a:b]).astype(np.uint32) if b > a else np.zeros(0, np.uint32)
                    more = np.flatnonzero(counts != 1).astype(np.uint32)
                    out.append(np.concatenate((np.array([len(runs)], np.uint32), runs, more, counts[more])).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(out)), pa.array(out, pa.binary())], names=["node", "runs"]
                )

    return texts.mapInArrow(run, "node string, runs binary")


def _vector(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(raw, np.uint32)
    n = int(values[0])
    counts, more = np.ones(n, np.float32), values[n + 1 :]
    half = len(more) // 2
    counts[more[:half]] = more[half:]
    return values[1 : n + 1], counts


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], rarity: np.ndarray) -> float:
    """Weighted Jaccard: sum of the lesser weights over sum of the greater."""
    mask = np.uint32((1 << FREQUENCY_BITS) - 1)
    (a, m), (b, n) = x, y
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, np.int64)
    least = float((np.minimum(m[both], n[at[both]]) * rarity[a[both] & mask]).sum())
    total = float((m * rarity[a & mask]).sum()) + float((n * rarity[b & mask]).sum())
    return least / (total - least) if total > least else 1.0


def agreed(x: Column, y: Column, n: int) -> Column:
    """Draws on which two sketches agree, as a share."""
    hexes = F.hex(x), F.hex(y)
    same = [(F.substring(hexes[0], 8 * i + 1, 8) == F.substring(hexes[1], 8 * i + 1, 8)).cast("int") for i in range(n)]
    return sum(same[1:], same[0]) / n


def verified(pairs: DataFrame, nodes: DataFrame, held: DataFrame, weights: np.ndarray, how: Settings) -> DataFrame:
    """The pairs (node, hub) whose whole texts are similar.

    Pairs whose draws agree on less than 0.3 below the threshold (3e-5 of true ones) are left
    out first. A hub's runs go to one task per 200 of its pairs, and each pair's node there.
    """
    n = how.bands * how.rows
    one = nodes.select("node", F.col("draws").alias("x"))
    two = nodes.select(F.col("node").alias("hub"), F.col("draws").alias("y"))
    likely = pairs.join(one, "node").join(two, "hub").where(agreed(F.col("x"), F.col("y"), n) >= how.similarity - 0.3)
    likely = written_table(likely.select("node", "hub"), "pairs")
    sizes = likely.groupBy("hub").agg(F.ceil(F.count("*") / 200).alias("parts"))
    dealt = likely.join(sizes, "hub").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    centres = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
    rows = dealt.select("hub", "part", "node", F.lit(1).alias("other")).unionByName(
        centres.select("hub", "part", "node", F.lit(0).alias("other"))
    )
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    k = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            found = []
            for hub, node, other, raw in zip(*(batch.column(c).to_pylist() for c in ("hub", "node", "other", "runs")), strict=True):
                if not other:
                    centre = _vector(raw)
                elif similarity(centre, _vector(raw), shared.value) >= how.similarity:
                    found.append((node, hub))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["node", "hub"]
            )

    return (
        rows.join(held, "node")
        .repartition(k, "hub", "part")
        .sortWithinPartitions("hub", "part", "other")
        .mapInArrow(run, "node string, hub string")
    )


def links(nodes: DataFrame, texts: DataFrame, weights: np.ndarray, how: Settings) -> DataFrame:
    """Verified links (node, hub) between different texts, enough to connect each class."""
    entries = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written_table(entries.join(sizes, "key"), "buckets")
    drawn = shared.groupBy("node").agg(F.sum("n").alias("drawn"))
    table = written_table(shared.join(drawn, "node"), "buckets")
    held = written_table(vectors(drawn.select("node").join(texts, "node").dropDuplicates(["node"]).select("node", "text"), how), "runs")

    hubs = table.groupBy("key").agg(F.max(F.struct("drawn", "node"))["node"].alias("hub"))
    spokes = written_table(table.join(hubs, "key").where("node != hub").select("key", "band", "node", "n", "hub"), "spokes")
    first = written_table(verified(spokes.select("node", "hub").distinct(), nodes, held, weights, how), "links")
    if spokes.join(first, ["node", "hub"], "left_anti").isEmpty():
        return first
    found = [first]
    for whole in (False, True):  # within blocks first, so that few are left to meet the other blocks
        members = written_table(_unlike(table.join(hubs, "key"), components(_union(found), "node", "hub")), "unlike")
        found.append(written_table(_across(members.where(F.col("n") > how.small), nodes, held, weights, how, whole), "links"))
        if not whole:
            few = members.where(F.col("n") <= how.small)
            mates = few.select("key", F.col("node").alias("mate"), F.col("root").alias("other"), F.col("left").alias("mate_left"))
            few = few.where("left").join(mates, "key").where("root != other and (not mate_left or node < mate)")
            pairs = few.select(F.greatest("node", "mate").alias("node"), F.least("node", "mate").alias("hub")).distinct()
            found.append(written_table(verified(pairs, nodes, held, weights, how), "links"))
    return _union(found)


def _unlike(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets whose texts are not all connected, without the hubs.

    root names what a text is connected to, left whether that is something else than the hub.
    """
    roots = roots.select("node", "root")
    named = members.join(roots, "node", "left").join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    marked = named.withColumn("left", F.col("root") != F.coalesce("hub_root", "hub"))
    marked = marked.select("key", "band", "node", "n", "root", "left").where("node != hub")
    return marked.join(marked.where("left").select("key").distinct(), "key")


def similarities(one: list[bytes], two: list[bytes], rarity: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of all pairs of packed texts, to the last digits of single precision.

    The k-th repeat of a run is a column of its own, so the lesser counts become a product of two
    matrices of 0 and 1 with the weights between; only columns of both sides enter, some at a time.
    """
    mask = np.uint32((1 << FREQUENCY_BITS) - 1)

    def columns(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows, total = [], [], np.zeros(len(packed))
        for i, raw in enumerate(packed):
            runs, counts = _vector(raw)
            times = counts.astype(np.int64)
            nth = spread(np.zeros(len(runs), np.int64), times)
            keys.append(np.repeat(runs.astype(np.uint64), times) | (nth.astype(np.uint64) << np.uint64(32)))
            rows.append(np.full(len(nth), i))
            total[i] = float((counts * rarity[runs & mask]).sum())
        return np.concatenate(keys), np.concatenate(rows), total

    (a, i, m), (b, j, n) = columns(one), columns(two)
    both = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    least = np.zeros((len(one), len(two)))
    sides = []
    for keys, rows in ((a, i), (b, j)):
        at = np.minimum(np.searchsorted(both, keys), max(len(both) - 1, 0))
        use = both[at] == keys if len(both) else np.zeros(len(keys), bool)
        order = np.argsort(at[use], kind="stable")
        sides.append((at[use][order], rows[use][order]))
    weight = rarity[(both & np.uint64(mask)).astype(np.int64)]
    for begin in range(0, len(both), COLUMNS):
        part = weight[begin : begin + COLUMNS]
        full = []
        for (at, rows), height in zip(sides, least.shape, strict=True):
            here = slice(*np.searchsorted(at, (begin, begin + len(part))))
            matrix = np.zeros((height, len(part)), np.float32)
            matrix[rows[here], at[here] - begin] = 1
            full.append(matrix)
        least += (full[0] * part) @ full[1].T
    total = m[:, None] + n
    return np.where(total > least, least / np.maximum(total - least, 1e-30), 1.0)


def forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links between numbered parts connect what those before do not."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up.get(i, i) != i:
            up[i] = up.get(up[i], up[i])
            i = up[i]
        return i

    used = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[a] = b
            used[k] = True
    return used


def _across(members: DataFrame, nodes: DataFrame, held: DataFrame, weights: np.ndarray, how: Settings, whole: bool) -> DataFrame:
    """Links (node, hub) of similar texts of one bucket that are not connected, enough to connect them.

    Members meet within their block of about BLOCK; if ``whole``, each text left over meets every
    block of its bucket. Pairs with alike draws are verified by their whole texts in the group itself, which gives
    a spanning forest: rows grow with the texts of a block and not with its pairs. A pair is looked at
    in the first band that it shares.
    """
    sizes = members.groupBy("key").agg(
        F.ceil(F.count_if("left") / BLOCK).cast("int").alias("across"), F.ceil(F.count("*") / BLOCK).cast("int").alias("down")
    )
    rows = members.join(sizes, "key").join(nodes, "node").join(held, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "band", "node", "root", "left", "draws", "keys", "runs"]
    if whole:
        sides = rows.where("left").select(*kept, F.lit(True).alias("first"), block("across").alias("x"), every("down").alias("y"))
        sides = sides.unionByName(rows.select(*kept, F.lit(False).alias("first"), every("across").alias("x"), block("down").alias("y")))
    else:
        sides = rows.select(*kept, F.col("left").alias("first"), block("down").alias("x"), F.lit(0).alias("y"))
    least = (how.similarity - 0.3) * how.bands * how.rows - 1e-9
    shared = members.sparkSession.sparkContext.broadcast(weights)

    def run(table: pa.Table) -> pa.Table:
        none = pa.table({"node": pa.array([], pa.string()), "hub": pa.array([], pa.string())})
        first = table.column("first").to_numpy(zero_copy_only=False)
        at, to = np.flatnonzero(first), np.flatnonzero(~first) if whole else np.arange(len(first))
        if not len(at) or len(to) < 1 + (not whole):
            return none
        names = np.array(table.column("node").to_pylist(), object)
        _, roots = np.unique(np.array(table.column("root").to_pylist()), return_inverse=True)
        left = table.column("left").to_numpy(zero_copy_only=False)
        draws = np.frombuffer(b"".join(table.column("draws").to_pylist()), "<u4").reshape(len(names), -1)
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        alike = np.zeros((len(at), len(to)), np.int16)
        for i in range(draws.shape[1]):
            alike += draws[at, i][:, None] == draws[to, i]
        use = (alike >= least) & (roots[at][:, None] != roots[to])
        for i in range(table.column("band")[0].as_py()):
            use &= keys[at, i][:, None] != keys[to, i]
        use &= ~left[to] | (names[at][:, None] < names[to]).astype(bool)
        rows, cols = np.flatnonzero(use.any(axis=1)), np.flatnonzero(use.any(axis=0))
        if not len(rows):
            return none
        packed = table.column("runs")
        texts = [[packed[int(i)].as_py() for i in side] for side in (at[rows], to[cols])]
        found = similarities(*texts, shared.value)
        near = np.argwhere(use[np.ix_(rows, cols)] & (np.abs(found - how.similarity) < 1e-5))
        for i, j in near.tolist():  # too near the threshold for single precision
            found[i, j] = similarity(_vector(texts[0][i]), _vector(texts[1][j]), shared.value)
        x, y = np.nonzero(use[np.ix_(rows, cols)] & (found >= how.similarity))
        x, y = at[rows][x], to[cols][y]
        linked = forest(roots[x], roots[y])
        return pa.table({"node": pa.array(names[x[linked]], pa.string()), "hub": pa.array(names[y[linked]], pa.string())})

    found = sides.groupBy("key", "x", "y").applyInArrow(run, "node string, hub string")
    return found.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def node_of(text_col: str, id_col: str) -> Column:
    """Equal texts are one node; every null text is one of its own."""
    return F.coalesce(F.md5(text_col), F.concat(F.lit("null:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def near_duplicates(docs: DataFrame, how: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (of its text), root (a node that names the class), class_id and class_size of each row.

    A class is connected by links of weighted Jaccard ``similarity`` or more; class_id is its
    smallest doc_id. Equal texts share a class whatever their length, texts without words are
    only like their equals, and a null text is a class of its own id. Repeated rows repeat. A
    null doc_id is no class_id unless the class has no other. Other columns are not read; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(text_col, id_col).alias("node"), F.col(text_col).alias("text"))
    weights = rarity_weights(*frequencies(rows.select("text"), how), how)
    table = written_table(sketches(rows, weights, how), "sketches")
    nodes = written_table(
        table.where("keys is not null").groupBy("node").agg(F.first("draws").alias("draws"), F.first("keys").alias("keys")), "nodes"
    )
    roots = components(links(nodes, rows.select("node", "text"), weights, how), "node", "hub")
    members = table.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = written_table(members, "members")
    classes = members.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return members.join(classes, "root").select("doc_id", "node", "root", "class_id", "class_size")


def one_of_each(docs: DataFrame, how: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row of the smallest id.

    Of equal ids the text with the least digest stays, and of equal rows one. The rows to leave
    out are broadcast if there are few, by count; else they meet the texts in a join.
    """
    members = written_table(near_duplicates(docs, how, id_col, text_col), "classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    named = members.withColumnRenamed("root", "class")  # not class_id, which unlike texts of one id share
    best = named.groupBy("class").agg(F.min(order).alias("best"))
    judged = named.join(best, "class").withColumn("stays", order == F.col("best"))
    out = written_table(judged.where(~F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct(), "dropped")
    many = judged.where("stays").groupBy("class").count().where("count > 1")
    repeated = not many.isEmpty()
    if out.count() <= BROADCAST_ROWS:
        out = F.broadcast(out)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("__key"), node_of(text_col, id_col).alias("__text"))
    kept = rows.join(out, rows["__key"].eqNullSafe(out["__id"]) & (rows["__text"] == out["__node"]), "left_anti")
    if repeated:
        kept = kept.dropDuplicates(["__key", "__text"])
    return kept.select("row.*")
