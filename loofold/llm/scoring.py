"""Log probability of texts under a causal self-attention model, beside a unigram baseline.

Texts are cut into chunks of a few megabytes, each a row with its distinct words, their subword
ids and their places. A chunk's words meet those of others in buckets by hash, packed, and their
counts go back to the chunks, so neither the vocabulary nor the texts pass through one task. Frequencies of
subword ids and of their pairs cover all training texts. The attention weights start from a
bounded sample; then each part of each chunk trains them on all its training texts, and the
changes are averaged by tokens. A word's probability mixes what attention says of its subwords with
its own discounted frequency, whose discount also goes to attention.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loofold.llm.attention import Model, Shape, fitted, log_probabilities, pair_counts, passed, prepared, with_pairs
from loofold.llm.packing import public_tokenizer
from loofold.llm.words import coded, coded_column, release, slices, spread, starts
from loofold.session import written_table

CHUNK_BYTES = 6 << 20
#: Bytes of words, about, that are counted together, and chunks that a task scores.
BUCKET_BYTES, CHUNKS_A_TASK = 16 << 20, 4
#: Bytes of the texts that the weights start from, about; of a long text a run of an eighth.
SAMPLE_BYTES = 3 << 20

#: What is taken off the count of each known word, and the share that attention has anyway.
DISCOUNT, ATTENTION = 0.75, 0.5

TOKENIZER = "byte_bpe_50k.json"
#: Ids of words that a worker keeps from chunk to chunk, up to so many and of up to so many bytes; bounds memory only.
KEPT_WORDS, KEPT_LETTERS = 200_000, 64

#: What may stand behind the letters of a word and is then a run of its own: ASCII signs.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Subwords:
    """Ids of words as they stand behind a space, and the id that ends a text.

    The tokenizer cuts a word into runs of letters, digits and signs. So letters with signs behind
    them have the ids of the letters and then those of the signs, and words of ASCII or Latin-1 letters
    go to the model itself, without the tokenizer's book-keeping. All others, and all if a probe differs,
    go through the tokenizer. Words that came in two chunks running are kept, and so are the last chunk's.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.full = Tokenizer.from_file(tokenizer if tokenizer.startswith("/") else public_tokenizer(tokenizer))
        self.full.encode_special_tokens = True
        self.model, names = self.full.model, self.full.get_vocab(with_added_tokens=True)
        self.size, self.end = max(names.values()) + 1, names["<|endoftext|>"]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(128, 256)) if c.isalpha()}
        self.latin = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
        self.kept, self.last, self.tails = {}, {}, {}
        self.direct = True
        self.direct = [self.of_letters(w) or b"" for w in PROBES] == self.encoded(PROBES) and self.found(PROBED) == self.encoded(PROBED)
        self.kept, self.last = {}, {}

    def encoded(self, words: list[bytes]) -> list[bytes]:
        found = []
        for begin in range(0, len(words), 2000):
            texts = [" " + w.decode("utf-8", "replace") for w in words[begin : begin + 2000]]
            found += [_raw(e.ids) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        return found

    def of_letters(self, word: bytes) -> bytes | None:
        """Ids of a word of letters; None if it is none, or may be none to the tokenizer."""
        if not self.direct:
            return None
        if word.isalpha():
            return _raw([t.id for t in self.model.tokenize("\u0120" + word.decode())])
        if word.isascii():
            return None
        text = word.decode("utf-8", "replace")
        return _raw([t.id for t in self.model.tokenize("\u0120" + text.translate(self.letters))]) if self.latin(text) else None

    def tail(self, signs: bytes) -> bytes:
        if signs not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[signs] = _raw([t.id for t in self.model.tokenize(signs.decode())])
        return self.tails[signs]

    def found(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, four bytes each."""
        kept, last, fresh, other = self.kept, self.last, {}, []
        found = list(map(kept.get, words))
        for i in [i for i, x in enumerate(found) if x is None]:
            word = words[i]
            base = (word.rstrip(SIGNS) if self.direct else b"") or word
            ids = kept.get(base) or fresh.get(base)
            if ids is None and base in last:
                ids = kept[base] = last[base]
            if ids is None and (ids := self.of_letters(base)):
                fresh[base] = ids
            if ids is None or base is not word and not (base.isalpha() or self.latin(base.decode("utf-8", "replace"))):
                if word not in last:
                    other.append(i)
                    continue
                base, ids = word, last[word]
                kept[word] = ids
            found[i] = ids if len(base) == len(word) else ids + self.tail(word[len(base) :])
        for i, ids in zip(other, self.encoded([words[i] for i in other]), strict=True):
            found[i] = fresh[words[i]] = ids
        self.last = {w: x for w, x in fresh.items() if len(w) <= KEPT_LETTERS}
        if len(kept) > KEPT_WORDS:
            self.kept = {w: kept[w] for w in words if w in kept}
        return found


def _raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


#: Words on which the short ways are compared with the tokenizer.
PROBES = [w.encode() for w in ("the", "paper", "nation", "\u00e9tude", "stra\u00dfe", "\u00c9tion", "ni\u00f1o", "\u00ea", "threshold")]
PROBED = [w + s for w in PROBES for s in (b".", b",", b"'", b"...", b'."', b"-", b"?!", b"_")]
_subwords: dict[str, Subwords] = {}


def subwords(tokenizer: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sizes and ids of words, each as it stands behind a space, and the id that ends a text."""
    if tokenizer not in _subwords:
        _subwords[tokenizer] = Subwords(tokenizer)
    found = _subwords[tokenizer].found(words)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return sizes, np.frombuffer(b"".join(found), np.uint32).astype(np.int64), _subwords[tokenizer].end


def vocabulary_size(tokenizer: str) -> tuple[int, int]:
    end = subwords(tokenizer, [])[2]
    return _subwords[tokenizer].size, end


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _opened(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


CHUNKS = "words binary, codes binary, bounds binary, docs binary, flags binary, sizes binary, ids binary"
FIELDS = tuple(f.split()[0] for f in CHUNKS.split(", "))
LETTERS = "letters long"  # bytes of a chunk's distinct words, with eight for each


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, first all their lowest bytes and so on, which pack better."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def chunked(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, train, text) as chunks: distinct words and their subword ids, codes of all
    words, where texts begin, and the ids and flags of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), CHUNK_BYTES):
                n = part.stop - part.start
                codes, words, bounds = coded_column(batch.column(2).slice(part.start, n))
                keys = batch.column(0).slice(part.start, n)
                docs_ = np.array([0 if x is None else x for x in keys.to_pylist()], np.int64)
                flags = np.array(batch.column(1).slice(part.start, n).to_pylist(), np.uint8)
                flags |= np.array(keys.is_null().to_pylist(), np.uint8) << 1
                sizes, ids, _ = subwords(tokenizer, words)
                columns = (
                    b"\n".join(words), _planes(codes), bounds.astype("<i8").tobytes(), docs_.tobytes(), flags.tobytes(),
                    _planes(sizes), _planes(ids),
                )
                letters = pa.array([len(columns[0]) + 8 * len(words)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array([_squeezed(c)], pa.binary()) for c in columns), letters], names=[*FIELDS, "letters"])
        release()

    return docs.mapInArrow(run, f"{CHUNKS}, {LETTERS}")


class Chunk:
    def __init__(self, codes, bounds, docs, flags, sizes, ids, words=b""):
        self.packed_words = words
        self.codes, self.sizes, self.ids = (_numbers(_opened(x)) for x in (codes, sizes, ids))
        self.bounds = np.frombuffer(_opened(bounds), "<i8")
        self.docs = np.frombuffer(_opened(docs), np.int64)
        flags = np.frombuffer(_opened(flags), np.uint8)
        self.train, self.null = (flags & 1).astype(bool), (flags & 2) > 0
        self.owner = np.repeat(np.arange(len(self.docs)), np.diff(self.bounds))

    def words(self) -> list[bytes]:
        raw = _opened(self.packed_words)
        return raw.split(b"\n") if raw else []

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.train[self.owner]], minlength=len(self.sizes))

    def tokens(self, end: int, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids of some texts, each with its end; how many each word has; and each text."""
        ids, sizes = np.append(self.ids, end), np.append(self.sizes, 1)
        bounds = self.bounds[rows.start : rows.stop + 1]
        every = np.insert(self.codes[bounds[0] : bounds[-1]], bounds[1:] - bounds[0], len(self.sizes))
        per_word = sizes[every]
        lengths = np.diff(starts(per_word)[bounds - bounds[0] + np.arange(len(bounds))])
        return ids[spread(starts(sizes)[every], per_word)], per_word, lengths

    def row_parts(self, tokens: int) -> Iterator[slice]:
        """Runs of texts of about so many subword ids."""
        per_text = np.bincount(self.owner, self.sizes[self.codes], minlength=len(self.docs)) + 1
        cuts, begin = starts(per_text.astype(np.int64)), 0
        while begin < len(per_text):
            stop = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + tokens, "right")) - 1)
            yield slice(begin, stop)
            begin = stop


def chunk_columns(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    for i in range(batch.num_rows):
        yield batch.column("chunk")[i].as_py(), Chunk(**{c: batch.column(c)[i].as_py() for c in FIELDS if c in batch.schema.names})


def word_entries(chunks: DataFrame, buckets: int) -> DataFrame:
    """Rows of words whose hash falls into a bucket: which, chunk, the words, their codes and numbers of training tokens there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk in chunk_columns(batch):
                words, n = chunk.words(), chunk.train_counts()
                bucket = np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = [*np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist(), len(order)]
                groups = [order[i:j] for i, j in pairwise(cuts)]
                columns = [[b"".join([words[k] + b"\n" for k in g.tolist()]) for g in groups], [_planes(g) for g in groups], [_planes(n[g]) for g in groups]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order[cuts[:-1]]], pa.int64()), pa.array([name] * len(groups), pa.int64()), *(pa.array([_squeezed(x) for x in c], pa.binary()) for c in columns)],
                    names=["bucket", "chunk", "words", "codes", "n"],
                )
        release()

    return chunks.mapInArrow(run, "bucket long, chunk long, words binary, codes binary, n binary")


def bucket_counts(table: pa.Table) -> pa.Table:
    """Of a bucket: chunk, codes and corpus counts of its words there, its training tokens; the bucket's learnt words stand in one row."""
    raw = b"".join(_opened(x) for x in table.column("words").to_pylist())
    parts = [_numbers(_opened(x)) for x in table.column("n").to_pylist()]
    n, cuts = np.concatenate(parts), starts(np.array(list(map(len, parts)), np.int64)).tolist()
    ends = np.append(0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    word = words.dictionary_encode().indices.to_numpy()
    total = np.bincount(word, n).astype(np.int64)
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "codes": table.column("codes"),
            "counts": pa.array([_squeezed(total[word[i:j]].tobytes()) for i, j in pairwise(cuts)], pa.binary()),
            "tokens": pa.array([int(x.sum()) for x in parts], pa.int64()),
            "kinds": pa.array([int((total > 0).sum())] + [0] * (len(parts) - 1), pa.int64()),
        }
    )


def word_counts(chunks: DataFrame) -> DataFrame:
    """chunk, counts (codes and corpus counts of its words, packed by bucket) and the chunk's share of totals."""
    size = chunks.agg(F.sum("letters")).first()[0] or 0
    schema = "chunk long, codes binary, counts binary, tokens long, kinds long"
    counted = word_entries(chunks, size // BUCKET_BYTES + 1).groupBy("bucket").applyInArrow(bucket_counts, schema)
    return counted.groupBy("chunk").agg(
        F.collect_list(F.struct("codes", "counts")).alias("counts"), F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")
    )


def summed(chunks: DataFrame, size: int, count) -> np.ndarray:
    """A vector of ``size`` sums over all chunks; each task sends one, and vectors add up in parts."""
    width = 1 << 13

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, chunk in chunk_columns(batch):
                count(total, chunk)
        pieces = [total[i : i + width] for i in range(0, size, width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(pieces)), pa.int32()), pa.array([_squeezed(p.tobytes()) for p in pieces], pa.binary())], names=["part", "sums"]
        )
        release()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(_opened(x), np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([_squeezed(total.tobytes())], pa.binary())})

    schema = "part int, sums binary"
    rows = {r["part"]: _opened(bytes(r["sums"])) for r in chunks.drop("words").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect()}
    return np.frombuffer(b"".join(rows[i] for i in sorted(rows)), np.int64) if rows else np.zeros(size, np.int64)


def subword_counts(chunks: DataFrame, size: int, end: int) -> np.ndarray:
    """Training tokens of each subword id over the whole corpus."""

    def count(total: np.ndarray, chunk: Chunk) -> None:
        total += np.bincount(chunk.ids, np.repeat(chunk.train_counts(), chunk.sizes), minlength=size).astype(np.int64)
        total[end] += int(chunk.train.sum())

    return summed(chunks, size, count)


def subword_pairs(chunks: DataFrame, model: Model, end: int) -> np.ndarray:
    """Training pairs of neighbouring subword ids over the whole corpus, by input row and class."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def count(total: np.ndarray, chunk: Chunk) -> None:
        for part in chunk.row_parts(200_000):
            tokens, _, lengths = chunk.tokens(end, part)
            learn = np.repeat(chunk.train[part], lengths)
            total += pair_counts(shared.value, tokens[learn], lengths[chunk.train[part]], end)

    return summed(chunks, model.shape.inputs * model.shape.classes, count)


def learned(chunks: DataFrame, model: Model, end: int) -> tuple[Model, int]:
    """The model after a pass over all training texts, and the number of their subword ids.

    Parts of chunks start from the same weights; their changes, as whole numbers, are summed
    with the number of ids as weight, so no order of tasks alters the sum.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    names, unit = sorted(model.weights), float(1 << 20)
    size = sum(model.weights[k].size for k in names)

    def count(total: np.ndarray, chunk: Chunk) -> None:
        for part in chunk.row_parts(200_000):
            tokens, _, lengths = chunk.tokens(end, part)
            learn = chunk.train[part]
            tokens = tokens[np.repeat(learn, lengths)]
            if len(tokens):
                change = passed(shared.value, tokens, lengths[learn], end)
                flat = np.concatenate([change[k].ravel() for k in names]).astype(np.float64)
                total[:size] += np.rint(flat * (len(tokens) * unit)).astype(np.int64)
                total[size] += len(tokens)

    total = summed(chunks, size + 1, count)
    n, at = int(total[size]), 0
    for k in names if n else ():
        x = model.weights[k]
        model.weights[k] = (x + (total[at : at + x.size] / (n * unit)).reshape(x.shape)).astype(np.float32)
        at += x.size
    return model, n


def sample_sequences(docs: DataFrame, tokenizer: str) -> list[np.ndarray]:
    """Subword ids of about SAMPLE_BYTES of training texts, picked by a hash of their ids."""
    train = docs.where("train and text is not null")
    longest = SAMPLE_BYTES // 8
    size = train.agg(F.sum(F.least(F.octet_length("text"), F.lit(longest)))).first()[0] or 0
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    begin = F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - longest, F.lit(0)) + 1) + 1
    run = F.substring("text", begin.cast("int"), F.lit(longest)).alias("text")
    some = train.where(chance < SAMPLE_BYTES / max(size, 1)).select(run).collect()
    texts = sorted(r["text"].encode().lower() for r in some)
    codes, words, bounds = coded(texts)
    sizes, ids, _ = subwords(tokenizer, words)
    every = ids[spread(starts(sizes)[codes], sizes[codes])]
    cuts = starts(sizes[codes])[bounds]
    return [every[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, shape: Shape = Shape()) -> DataFrame:
    """Scores of every text; ``train`` says which rows are learned from (null: not).

    Returns doc_id, held_out (not learned from), n_tokens (words and one end), n_known (tokens
    that training texts hold), train_tokens, base_score (add-half unigram, log10) and score (the
    model's log10 probability of the text in lower case A-Z, end included). A null text counts
    as empty: one end. Repeated rows are scored, and learned from, once each. Without training
    rows the model keeps its random weights. Other columns are not read; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    chunks = written_table(chunked(rows, tokenizer).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    counts = written_table(word_counts(chunks), "counts")
    n_words, distinct = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    size, end = vocabulary_size(tokenizer)
    subword = subword_counts(chunks, size, end)
    n_docs = int(subword[end])
    total, kinds = n_words + n_docs, distinct + (n_docs > 0)
    model = prepared(subword, end, shape)
    model = with_pairs(model, subword_pairs(chunks, model, end))
    model, _ = learned(chunks, fitted(model, sample_sequences(rows, tokenizer), end), end)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its shape and the vocabulary
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks.count() // CHUNKS_A_TASK)
    joined = chunks.drop("words").repartition(tasks, "chunk").join(counts.select("chunk", "counts").repartition(tasks, "chunk"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Model = shared.value
        unit = total + 0.5 * (kinds + 1)
        spare = DISCOUNT * kinds / max(total, 1)
        for batch in batches:
            for i, (_, chunk) in enumerate(chunk_columns(batch)):
                pairs = batch.column("counts")[i]
                c = np.zeros(len(chunk.sizes) + 1, np.int64)
                c[-1] = n_docs
                if pairs.is_valid:
                    for at, count in zip(*(pairs.values.field(k).to_pylist() for k in ("codes", "counts")), strict=True):
                        c[_numbers(_opened(at))] = np.frombuffer(_opened(count), np.int64)
                n = len(chunk.docs)
                per_word, own = np.log10((c + 0.5) / unit), np.maximum(c - DISCOUNT, 0) / max(total, 1)
                base = np.bincount(chunk.owner, per_word[chunk.codes], minlength=n) + per_word[-1]
                known = np.bincount(chunk.owner, c[chunk.codes] > 0, minlength=n).astype(np.int64) + (n_docs > 0)
                score = np.zeros(n)
                for part in chunk.row_parts(200_000):
                    tokens, per, lengths = chunk.tokens(end, part)
                    bounds = chunk.bounds[part.start : part.stop + 1]
                    logs = np.add.reduceat(log_probabilities(held, tokens, lengths, end), starts(per)[:-1])
                    every = np.insert(chunk.codes[bounds[0] : bounds[-1]], bounds[1:] - bounds[0], len(chunk.sizes))
                    words = np.logaddexp(
                        np.log(ATTENTION + (1 - ATTENTION) * spare) + logs, np.log((1 - ATTENTION) * own[every] + 1e-300)
                    )
                    texts = np.repeat(np.arange(part.start, part.stop), np.diff(bounds) + 1)
                    score += np.bincount(texts, words, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk.docs, mask=chunk.null),
                        pa.array(~chunk.train),
                        pa.array(np.diff(chunk.bounds) + 1, pa.int64()),
                        pa.array(known),
                        pa.array(np.full(n, total, np.int64)),
                        pa.array(base),
                        pa.array(score / np.log(10)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
        release()

    return joined.mapInArrow(run, SCORES)
