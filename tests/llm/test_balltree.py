"""Search by ball trees against scores of all documents."""

import math
import random
import re

import numpy as np
import pytest

from loofold.llm import balltree
from loofold.llm.balltree import BallTree, Corpus, search, weight
from loofold.llm.queries import op12_lexical_search
from loofold.llm.words import starts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    """docs: (id, text), items: (id, text); rows (item, rank, doc, score)."""
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    n, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in queries.items():
        scores = []
        for i, t in held:
            m = 100 - 50 + 50 * len(t) * n // length
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 20 * m))
                for x in query & set(t)
            )
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in "aböñ你" for i in range(words)]
    odds = [1 / (1 + i) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        text = rng.choices(vocabulary, odds, k=rng.randint(0, 40))
        rows.append((i, rng.choice([" ", ", ", "-", "\n_"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    return rows


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_tree_finds_the_best_and_prunes():
    rng = np.random.default_rng(1)
    groups, width = 40, 400
    rows = []
    for g in range(groups):  # documents of a group share most terms
        base = rng.choice(width, 12, replace=False)
        rows += [np.unique(np.append(base[: rng.integers(8, 12)], rng.integers(0, width, 2))) for _ in range(50)]
    bounds, term = starts(np.array([len(r) for r in rows])), np.concatenate(rows)
    value = rng.integers(1, 10**10, len(term))
    tree = BallTree(bounds, term, value, np.arange(width) // 2, leaf=16)
    full = np.zeros((len(rows), width), np.int64)
    full[np.repeat(np.arange(len(rows)), np.diff(bounds)), term] = value
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    queries = np.zeros((60, width), np.int64)
    for q in range(60):
        queries[q, rows[rng.integers(len(rows))] if q % 2 else rng.choice(width, 10)] = 1
    upper = tree.upper_bounds(queries.astype(float))
    totals = full @ queries.T
    looked = 0
    for node, (begin, end) in enumerate(tree.ranges):  # bounds hold in every ball
        assert (totals[tree.order[begin:end]].max(axis=0) <= upper[node]).all()
    for q in range(60):
        found, scores, floor, n = tree.best(queries[q], upper[:, q], 5, 1)
        wanted = np.lexsort((np.arange(len(rows)), -totals[:, q]))[:5]
        wanted = wanted[totals[wanted, q] > 0]
        assert found.tolist() == wanted.tolist() and scores.tolist() == totals[wanted, q].tolist()
        assert floor == (scores[-1] if len(scores) == 5 else 1)
        looked += n
    leaves = sum(c is None for c in tree.children)
    assert looked < 0.5 * 60 * leaves


def test_equal_documents_split_by_place():
    n = 1000
    tree = BallTree(np.arange(0, 3 * n + 1, 3), np.tile([0, 2, 5], n), np.tile([7, 8, 9], n), np.arange(6), leaf=8)
    query = np.array([1, 0, 0, 0, 0, 1])
    found, scores, *_ = tree.best(query, tree.upper_bounds(query[None].astype(float))[:, 0], 20, 1)
    assert found.tolist() == list(range(20)) and set(scores.tolist()) == {16}


def test_query_against_all_scores(spark, tmp_path):
    docs = [*corpus(400, 3), (5, "a1 a2 b7"), (None, "a1 a2 b7 b8"), (900, None), (901, " .,_ "), (902, "zzz")]
    items = [*corpus(30, 4), (3, "a1 ä zzz"), (None, "b1 b2"), (77, None), (78, "--"), (79, "unseen")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS terms").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = op12_lexical_search(spark, str(tmp_path)).collect()
    assert as_set(found) == as_set(brute(docs, items))


@pytest.mark.parametrize("limit", [60, 400])
def test_items_in_passes_and_small_trees(spark, monkeypatch, limit):
    monkeypatch.setattr(balltree, "QUERY_BYTES", limit)
    docs, items = corpus(300, 8), corpus(12, 9)
    a, b = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (items, "item_id long, text string")))
    assert as_set(search(a.repartition(5), b, k=7).collect()) == as_set(brute(docs, items, 7))


def test_many_copies_and_equal_scores(spark):
    docs = [(i, "red fox" if i % 3 else "red fox jumps") for i in range(600, 0, -1)] + [(7, "red fox")] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "Fox"), (2, "red jumps")], "item_id long, text string")
    assert as_set(search(frame, items, k=20).collect()) == as_set(brute(docs, [(1, "Fox"), (2, "red jumps")], 20))


def test_odd_rows(odd, nothing):
    items = odd.selectExpr("doc_id AS item_id", "text", "size")
    found = search(odd, items).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert as_set(found) == as_set(brute(rows, rows))
    assert search(nothing, items).collect() == []
    assert search(odd, nothing.selectExpr("doc_id AS item_id", "text")).collect() == []


def test_scores_are_whole_numbers():
    assert weight(10, 10) == math.floor(1000 * math.log(22 / 21))
    parts = Corpus(10, 1000, np.array([5])).parts(np.array([100]), np.array([0]), np.array([3]))
    assert parts.tolist() == [5 * (3_000_000_000 // (3000 + 20 * 100))]
