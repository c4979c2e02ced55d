"""The short ways of the language model against the long ones, and what a gradient costs."""

import collections
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from loofold.llm import attention, scoring
from loofold.llm.words import coded, coded_column

WORDS = [
    "the", "the.", "the,", "étude", "étude.", "ÉTUDE", "straße?!", "don't", "can'", "'s", "x2", "x2.", "12", "12.", "...", "привет", "привет.",
    "你好", "你好!", "a.b", "µm", "µm.", "<|endoftext|>", "a<|endoftext|>", "a<|", "naïve_", "ﬁn.", "é.", "\x00", "a\x00.", "​", "½.", "a" * 300 + ".",
]

COST = """
import sys, time
import numpy as np
from loofold.llm import attention

shape, rng = attention.Shape(), np.random.default_rng(0)
model = attention.prepared(rng.integers(1, 9, 5000), 11, shape)
inputs, targets = rng.integers(0, shape.inputs, (shape.batch, shape.window)), rng.integers(0, shape.classes, (shape.batch, shape.stride))
g, top, mask = rng.normal(size=(targets.size, shape.width)).astype(np.float32), model.weights["top"], attention._mask(shape)

def output_layer():
    e = np.exp(g @ top)
    return e @ top.T, g.T @ e

def least(work):
    took = []
    for _ in range(15):
        begin = time.process_time()
        work()
        took.append(time.process_time() - begin)
    return min(took)

print(least(lambda: attention.gradient(model.weights, model.prior, inputs, targets, shape, mask)) / least(output_layer))
"""


def test_gradient_costs_little_more_than_its_output_layer():
    """About 2.2 times the products and the exp of the output layer; 3.6 when whole rows were added one by one."""
    one = {k: "1" for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS")}
    done = subprocess.run([sys.executable, "-c", COST], env=os.environ | one, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), capture_output=True, text=True, check=True)
    assert float(done.stdout) < 2.9


@pytest.mark.parametrize("size", [0.3, 50])
def test_output_gradient(monkeypatch, size):
    monkeypatch.setattr(attention, "LOGITS", 7)
    rng = np.random.default_rng(1)
    top, g = rng.normal(size=(4, 9)) * size, rng.normal(size=(20, 4))
    prior, rows, targets = np.log(rng.dirichlet(np.ones(9), 6)), rng.integers(0, 6, 20), rng.integers(-1, 9, 20)
    loss, dg, dtop = attention.output_gradient(top, prior, g, rows, targets)
    logits = g @ top + prior[rows]
    p = np.exp(logits - np.logaddexp.reduce(logits, axis=1, keepdims=True))
    use = targets >= 0
    error = np.where(use[:, None], p - (np.arange(9) == targets[:, None]), 0) / use.sum()
    assert loss == pytest.approx(-np.log(p[use, targets[use]] + 1e-30).mean())
    assert np.allclose(dg, error @ top.T) and np.allclose(dtop, g.T @ error)


def test_row_sums():
    rows, values = np.array([2, 0, 2, 2, 1]), np.arange(15.0).reshape(5, 3)
    wanted = np.zeros((4, 3))
    np.add.at(wanted, rows, values)
    assert (attention.row_sums(values, rows, 4) == wanted).all()


def test_probabilities_in_blocks(monkeypatch):
    rng, shape, end = np.random.default_rng(3), attention.Shape(classes=6, inputs=12, width=8, hidden=8), 9
    model = attention.prepared(rng.integers(1, 9, 10), end, shape)
    ids, lengths = rng.integers(0, 9, 400), np.array([1, 150, 0, 249])
    ids[np.cumsum(lengths) - 1] = end
    whole = attention.log_probabilities(model, ids, lengths, end)
    monkeypatch.setattr(attention, "LOGITS", 5)
    monkeypatch.setattr(attention, "SORTED", 3)
    assert np.allclose(attention.log_probabilities(model, ids, lengths, end, at_once=2), whole, atol=1e-5)


def test_subwords_are_those_of_the_tokenizer():
    words = list(dict.fromkeys(w.encode() for w in WORDS)) + [b"\xff.", b"a\xff"]
    vocabulary = scoring.Subwords(scoring.TOKENIZER)
    wanted = vocabulary.encoded(words)
    assert vocabulary.direct
    for order in (words, words[::-1], words):  # new, of the last chunk, kept
        assert dict(zip(order, vocabulary.found(order), strict=True)) == dict(zip(words, wanted, strict=True))
    vocabulary.direct = False
    vocabulary.kept, vocabulary.last = {}, {}
    assert vocabulary.found(words) == wanted


def test_words_that_come_again_are_not_cut_again(monkeypatch):
    monkeypatch.setattr(scoring, "KEPT_WORDS", 500)
    vocabulary, cut = scoring.Subwords(scoring.TOKENIZER), []
    long_way, short_way = vocabulary.encoded, vocabulary.of_letters
    monkeypatch.setattr(vocabulary, "encoded", lambda words: cut.extend(words) or long_way(words))
    monkeypatch.setattr(vocabulary, "of_letters", lambda word: cut.append(word) or short_way(word))
    often = [f"{a}{b}".encode() for a in "abcdefghij" for b in "klmnopqrst"] + [str(i).encode() for i in range(100)]
    for chunk in range(6):
        cut.clear()
        vocabulary.found([*often, *(f"{chunk}q{i}z".encode() for i in range(1000))])
        assert not chunk or not set(often) & set(cut)
        assert len(vocabulary.kept) + len(vocabulary.last) < 2000


def test_words_of_a_column(odd):
    texts = [r.text for r in odd.select("text").collect()] + ["", " a", "a ", "\x1ca\x1cb C", "é\x85x y Z", " \n"]
    for some in (texts, [None, ""], [], [" x"]):
        codes, words, bounds = coded([(t or "").encode().lower() for t in some])
        found = coded_column(pa.array(["gone", *some], pa.string()).slice(1))
        assert found[0].tolist() == codes.tolist() and found[1] == words and found[2].tolist() == bounds.tolist()


def test_word_counts_of_many_buckets(make, monkeypatch):
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 40)
    texts = ["a b c a", "b  \n d", "x", "", None, "a d é 你好 " + " ".join(map(str, range(50)))]
    rows = make([(i, t) for i, t in enumerate(texts)]).selectExpr("doc_id", "doc_id != 2 as train", "text").repartition(3, "doc_id")
    chunks = scoring.chunked(rows, scoring.TOKENIZER).selectExpr("*", "monotonically_increasing_id() as chunk").cache()
    wanted = collections.Counter(w for i, t in enumerate(texts) if i != 2 for w in (t or "").encode().split())
    counts = {r.chunk: r for r in scoring.word_counts(chunks).collect()}
    assert sum(len(r.counts) for r in counts.values()) > 2 * len(counts) > 2
    assert sum(r.tokens for r in counts.values()) == sum(wanted.values())
    assert sum(r.kinds for r in counts.values()) == len(wanted)
    for r in chunks.collect():
        words = scoring.Chunk(**{f: r[f] for f in scoring.FIELDS}).words()
        found = {}
        for part in counts[r.chunk].counts if words else ():
            found |= dict(zip(scoring._numbers(scoring._opened(part.codes)).tolist(), np.frombuffer(scoring._opened(part.counts), np.int64).tolist(), strict=True))
        assert found == {i: wanted[w] for i, w in enumerate(words)}
