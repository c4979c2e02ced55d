"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two that add up to
n, the longest being the sequence length. Each piece is a sequence of its own and belongs to
the bucket of its length: a batch takes sequences of one bucket, so nothing is padded and no
sequence holds tokens of two documents.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loofold.llm.words import release, slices, spread, starts, texts_of

#: Text taken at once in a task, and bytes of words and ids that a worker keeps. Both bound memory only.
CHUNK_BYTES = 1 << 20
KEPT_BYTES = 32 << 20
#: About what an entry takes besides the letters of its word: objects, dictionary, numbers and ids.
ENTRY_BYTES = 200

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, offset long"


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; asked on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII signs but the apostrophe that end a word behind a Latin-1 letter: a token run of its own.
SIGNS = r"([a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)([ \t-\r]|$)"


class Vocabulary:
    """Ids of words seen so far in this worker, word after word in one array.

    The tokenizer drops white space before it cuts and lower-cases, so a text's ids are those of its
    words in lower case, and signs that are a token run of their own count as a word.
    Words of Latin-1 letters go to the model itself, which spares the tokenizer's book-keeping; the first are compared
    with the tokenizer, and if any differs, all words go through the tokenizer. Added tokens are matched
    before anything is lower-cased, so a word that holds one in any case goes there as it is.

    Words take at most about ``KEPT_BYTES``. Above that the words used most stay, up to half of it, and
    the others are looked up anew when they come again.
    """

    def __init__(self, tokenizer: str, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.full = Tokenizer.from_file(tokenizer if tokenizer.startswith("/") else public_tokenizer(tokenizer))
        self.model, self.end_id = self.full.model, end_id
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(128, 256)) if c.isalpha()}
        self.latin = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
        self.added = tuple(str(t.content).lower() for t in self.full.get_added_tokens_decoder().values())
        self.direct = True
        self.direct = all(self.encoded(w.encode()) == self.full.encode(w, add_special_tokens=False).ids for w in PROBES)
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self.code: dict[bytes | None, int] = {None: 0}  # the end
        self.begin, self.sizes, self.flat = array("q", [0]), array("q", [1]), array("I", [self.end_id])
        self.uses = np.zeros(1, np.int64)

    def prune(self) -> None:
        """Drops words used once, then the least used; uses count half from then on."""
        words = list(self.code)  # in order of their codes
        taken = np.fromiter((len(w or b"") + ENTRY_BYTES for w in words), np.int64, len(words))
        self.uses[0] = np.iinfo(np.int64).max  # the end stays, and stays first
        order = np.argsort(-self.uses, kind="stable")
        keep = np.sort(order[(np.cumsum(taken[order]) <= KEPT_BYTES // 2) & (self.uses[order] > 1) | (order == 0)])
        sizes = np.frombuffer(self.sizes, np.int64)[keep]
        flat = np.frombuffer(self.flat, np.uint32)[spread(np.frombuffer(self.begin, np.int64)[keep], sizes)]
        self.code = {words[i]: at for at, i in enumerate(keep.tolist())}
        self.begin, self.sizes = array("q", starts(sizes)[:-1].tobytes()), array("q", sizes.tobytes())
        self.flat, self.uses = array("I", flat.tobytes()), self.uses[keep] // 2
        self.held = int(taken[keep[1:]].sum())

    def words(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Which of the distinct words each word is, these words, and where each text begins. An empty word has no ids."""
        lower = pc.ascii_lower(texts)
        apart = pc.replace_substring_regex(lower, SIGNS, r"\1 \2\3")
        for added in self.added:
            has = pc.match_substring(lower, added)
            if pc.any(has).as_py():
                apart = pc.replace_with_mask(apart, has, as_strings(list(map(self.as_given, texts_of(texts.filter(has))))))
        split = pc.ascii_split_whitespace(apart)
        found = split.flatten().dictionary_encode()
        raw, words = found.dictionary.cast(pa.binary()), []
        if len(raw):
            data = raw.buffers()[2].to_pybytes() if raw.buffers()[2] else b""
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].tolist()
            words = [data[i:j] for i, j in pairwise(at)]
        return found.indices.to_numpy(), words, starts(split.value_lengths().to_numpy())

    def as_given(self, text: bytes) -> bytes:
        """In lower case but for the words that hold an added token."""
        return b" ".join(w if any(t.encode() in w.lower() for t in self.added) else w.lower() for w in text.split())

    def encoded(self, word: bytes) -> list[int]:
        if self.direct and word.isalpha():
            return [t.id for t in self.model.tokenize(word.decode().lower())]
        text = word.decode("utf-8", "replace")
        if self.direct and self.latin(text):
            return [t.id for t in self.model.tokenize(text.lower().translate(self.letters))]
        return self.full.encode(text, add_special_tokens=False).ids

    def learn(self, words: list[bytes]) -> None:
        code, begin, sizes, flat, encoded = self.code, self.begin, self.sizes, self.flat, self.encoded
        for at, word in enumerate(words, len(sizes)):
            ids = encoded(word)
            code[word] = at
            begin.append(len(flat))
            sizes.append(len(ids))
            flat.extend(ids)
        self.held += sum(map(len, words)) + ENTRY_BYTES * len(words)

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Codes of distinct words, which are learnt where they are new."""
        if self.held > KEPT_BYTES:
            self.prune()
        found = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        missing, first = np.flatnonzero(found < 0), len(self.sizes)
        self.learn([words[i] for i in missing.tolist()])
        found[missing] = np.arange(first, first + len(missing))
        return found

    def used(self, codes: np.ndarray) -> None:
        uses = np.bincount(codes, minlength=len(self.sizes))
        uses[: len(self.uses)] += self.uses
        self.uses = uses


#: Words on which the short way is compared with the tokenizer.
PROBES = ("the", "Paper", "nation", "\u00e9tude", "Stra\u00dfe", "\u00c9tion", "ni\u00f1o", "\u00ea", "THRESHOLD")

_vocabularies: dict[tuple[str, int], Vocabulary] = {}


def as_strings(texts: list[bytes]) -> pa.Array:
    """Texts as they are, which need not be valid UTF-8."""
    held = pa.array(texts, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(held), held.buffers())


def token_ids(tokenizer: str, texts: pa.Array | list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end_id``, and where each text begins."""
    if (tokenizer, end_id) not in _vocabularies:
        _vocabularies[tokenizer, end_id] = Vocabulary(tokenizer, end_id)
        release()  # what reading the tokenizer's file took
    vocabulary = _vocabularies[tokenizer, end_id]
    word, words, bounds = vocabulary.words(as_strings(texts) if isinstance(texts, list) else pc.fill_null(texts, ""))
    codes = vocabulary.codes(words)[word]
    vocabulary.used(codes)
    every = np.insert(codes, bounds[1:], 0)  # the end stands behind each text's words
    # Views of growing arrays, which must be gone before these grow again.
    begin, sizes, flat = np.frombuffer(vocabulary.begin, np.int64), np.frombuffer(vocabulary.sizes, np.int64), np.frombuffer(vocabulary.flat, np.uint32)
    counts = sizes[every]
    return flat[spread(begin[every], counts)], starts(counts)[bounds + np.arange(len(bounds))]


def pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each piece, longest first within a document."""
    rows, begin, length = [np.repeat(np.arange(len(sizes)), sizes // longest)], [], [np.full(int((sizes // longest).sum()), longest)]
    begin.append(spread(np.zeros(len(sizes), np.int64), sizes // longest) * longest)
    power = longest // 2
    while power:
        has = np.flatnonzero(sizes & power)
        rows.append(has)
        begin.append(sizes[has] // (2 * power) * (2 * power))
        length.append(np.full(len(has), power))
        power //= 2
    rows, begin, length = map(np.concatenate, (rows, begin, length))
    order = np.lexsort((begin, rows))
    return rows[order], begin[order], length[order]


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    longest: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Sequences of one piece each: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, bucket (log2 of the length), offset (0) and sequence_id, whose last four bits
    are the bucket.

    ``tokenizer`` is a file of the public tokenizers by name, or any path that begins with
    ``/``; it must drop white space and cut at it. ``longest`` is a power of two up to 32768.

    One pass without a shuffle. A null or empty text is the end token alone. Repeated rows are
    packed once each and a null doc_id stays null; sequences differ, since their ids follow the
    place of the row. No rows give no sequences. Other columns are not read.
    """
    if longest < 1 or longest & (longest - 1) or longest > 32768:
        raise ValueError("longest must be a power of two up to 32768")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            for n, part in enumerate(slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHUNK_BYTES), 1):
                ids, bounds = token_ids(tokenizer, texts.slice(part.start, part.stop - part.start), end_id)
                sizes = np.diff(bounds)
                rows, begin, length = pieces(sizes, longest)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (bounds[rows] + begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(part.start, part.stop - part.start).take(pa.array(rows)),
                        pa.array(begin),
                        pa.array(length),
                        pa.array([raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)], pa.binary()),
                        pa.array(sizes[rows]),
                        pa.array(np.log2(length).astype(np.int32)),
                        pa.array(np.zeros(len(rows), np.int64)),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "offset"],
                )
                del ids, raw
                if n % 8 == 0:
                    release()
            del batch, keys, texts  # gone before the next batch comes
            release()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = narrow.mapInArrow(cut, PIECES)
    return cuts.withColumn("sequence_id", F.shiftleft(F.monotonically_increasing_id(), 4).bitwiseOR(F.col("bucket")))


def packed_pieces(docs: DataFrame, **options) -> DataFrame:
    """The sequences with their ids as a checksum."""
    return pack(docs, **options).withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
