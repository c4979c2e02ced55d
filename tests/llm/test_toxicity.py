"""Segments against their definition, the distribution by simulation, labels on held-out rows."""

import math
import random

import numpy as np
import pytest

from loofold.llm.queries import op11_toxicity
from loofold.llm.toxicity import Settings, decay_of, evidence, segments, toxic_passages, trained, word_counts

from .conftest import prose

INSULTS = ["grolk", "snivbag", "dwerpish", "zlurm", "krodface"]


def maximal(scores, offset=0):
    """The best segment, then what is left and right of it, by definition."""
    best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    s, a, b = best
    return [*maximal(scores[:a], offset), (offset + a, offset + b - 1, s), *maximal(scores[b:], offset + b)]


def test_segments():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.uniform(0.1, 3) if rng.random() < 0.4 else -0.7 for _ in range(rng.randint(0, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        found = segments(at, [scores[i] for i in at], 0.7)
        wanted = maximal(scores)
        assert [x[:2] for x in found] == [x[:2] for x in wanted]
        assert np.allclose([x[2] for x in found], [x[2] for x in wanted])


def test_segments_are_found_in_linear_time():
    n = 200_000
    assert len(segments(list(range(0, 3 * n, 3)), [0.3] * n, 0.2)) == n  # none reaches the next one
    assert segments(list(range(n)), [1.0] * n, 0.2) == [(0, n - 1, pytest.approx(n))]
    falling = [2.0 - i / n for i in range(n)]
    assert sum(b - a + 1 for a, b, _ in segments(list(range(0, 2 * n, 2)), falling, 1.5)) >= n


def test_extreme_values():
    rates, scores, drift = np.array([0.05, 0.01]), np.array([1.0, 3.0]), 0.4
    decay = decay_of(rates, scores, drift)
    assert (1 - rates.sum()) * math.exp(-decay * drift) + rates @ np.exp(decay * scores) == pytest.approx(1)
    rng = np.random.default_rng(1)
    n, most = 400, []
    for _ in range(1500):
        drawn = rng.choice([0.0, 1.0, 3.0], n, p=[0.94, 0.05, 0.01])
        at = np.flatnonzero(drawn)
        most.append([s for *_, s in segments(at.tolist(), drawn[at].tolist(), drift)])
    k = sum(map(bool, most)) / sum(n * math.exp(-decay * max(m, default=0.0)) for m in most)
    p = np.exp([-evidence(m, n, decay, k, 1) for m in most])
    for level in (0.3, 0.1, 0.03):
        assert np.mean(p <= level) == pytest.approx(level, rel=0.5)  # p-values of clean texts are even
    assert evidence([9.0, 9.0], n, decay, k, 16) > evidence([9.0], n, decay, k, 16)
    assert evidence([], n, decay, k, 16) == evidence([5.0], 0, decay, k, 0) == 0


@pytest.fixture(scope="module")
def planted(spark, make):
    rng, rows, labels = random.Random(4), [], []
    for i in range(900):
        words = prose(rng.randint(20, 150), i).split()
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words).upper() if i % 12 == 0 else " ".join(words), "en", "a"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(toxic)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_labels(spark, planted, tmp_path):
    docs, labels = planted
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = op11_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 900 and {r["held_out"] for r in rows} == {True, False}
    for held_out in (True, False):
        some = [r for r in rows if r["held_out"] == held_out]
        wrong = sum(r["predicted"] != (r["doc_id"] % 6 == 0) for r in some)
        assert wrong <= 0.02 * len(some)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert op11_toxicity(spark, str(tmp_path)).sort("doc_id").collect() == sorted(rows, key=lambda r: r["doc_id"])


def test_passages_cover_what_was_planted(planted):
    docs, labels = planted
    rows = toxic_passages(docs, trained(docs, labels), keep_row=True).collect()
    seen = hit = 0
    for r in rows:
        words = r["row"]["text"].lower().split()
        inside = {i for p in r["passages"] for i in range(p["start"], p["start"] + p["length"])}
        bad = {i for i, w in enumerate(words) if w.strip(",!") in INSULTS}
        seen, hit = seen + len(bad), hit + len(bad & inside)
        assert r["n_terms"] == len(words) and all(p["expected"] <= Settings().passage for p in r["passages"])
    assert hit >= 0.9 * seen


def test_counts(spark):
    rows = [("a b a", 1, 0), ("b", 1, 1), ("A c", 0, 1), ("", 0, 0)]
    counts = word_counts(spark.createDataFrame(rows, "text string, toxic int, half int"))
    assert {r["word"]: (r["t0"], r["t1"], r["c0"], r["c1"]) for r in counts.collect()} == {
        "a": (1, 0, 0, 1), "b": (1, 1, 0, 0), "c": (0, 0, 0, 1)
    }


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 0, 1), (4, 1, 0), (5, None, None), (6, 1, 0), (7, 1, 0), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.where("toxic = 1"), labels.limit(0)):
        rows = toxic_passages(odd, trained(odd, given), keep_row=True)
        got = rows.collect()
        assert len(got) == odd.count() and rows.select("row.*").columns == odd.columns
        assert all(0 <= r["score"] <= 1 for r in got)
        if not given.count():
            assert all(r["score"] < 0.01 for r in got)
    assert toxic_passages(nothing, trained(odd, labels)).collect() == []
    assert toxic_passages(odd, trained(nothing, labels.limit(0))).count() == odd.count()
