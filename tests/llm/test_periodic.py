"""Runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loofold.llm import periodic
from loofold.llm.periodic import lyndon_lengths, periodic_runs, runs_of_texts
from loofold.llm.queries import op13_periodic_runs


def lyndon(w):
    """Each place up to the next smaller suffix."""
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, 2 * q):
                found.setdefault((start, length), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.randint(0, 60), rng.randint(1, 5)
        w = [rng.randrange(letters) for _ in range(size)]
        if rng.random() < 0.6 and w:
            a, p = rng.randrange(size), rng.randint(1, 9)
            w = [w[i] if i < a else w[min(a + (i - a) % p, size - 1)] for i in range(size)]
        yield w


def test_lyndon_array():
    for w in texts(500, 1):
        assert lyndon_lengths(np.array(w, np.int64)).tolist() == lyndon(w)
    n = 3000  # deep chains of groups
    assert lyndon_lengths(np.arange(n)).tolist() == list(range(n, 0, -1))
    assert lyndon_lengths(np.arange(n)[::-1]).tolist() == [1] * n


@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs_of_many_texts_at_once(least):
    words = list(texts(400, least))
    bounds = np.cumsum([0, *map(len, words)])
    found = runs_of_texts(np.array(sum(words, []), np.int64), bounds, least)
    wanted = [(t, *r) for t, w in enumerate(words) for r in runs(w, least)]
    assert list(zip(*(x.tolist() for x in found), strict=True)) == wanted


def test_hashes_that_deceive(monkeypatch):
    """With a hash of nothing all extensions are wrong, and the words themselves are compared."""

    class Blind(periodic.Extensions):
        def __init__(self, codes):
            super().__init__(codes)
            self.sums[:] = 0

    monkeypatch.setattr(periodic, "Extensions", Blind)
    for w in texts(100, 5):
        found = runs_of_texts(np.array(w, np.int64), np.array([0, len(w)]), 3)
        assert list(zip(*(x.tolist() for x in found[1:]), strict=True)) == runs(w, 3)


def described(words):
    found = runs(words, 12)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_on_a_small_table(spark, tmp_path, make):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))), "en", "s") for i in range(150)]
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "a b " * 20, None, None), (7, rows[7][1], "en", "s")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = op13_periodic_runs(spark, str(tmp_path)).collect()

    def turned(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not words:
            return words
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]

    wanted = [(i, *described(turned(i, text))) for i, text, *_ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert sum(r[1] > 0 for r in wanted) > 10


def test_odd_rows(odd, nothing):
    rows = periodic_runs(odd, keep_row=True)
    got = rows.collect()
    assert len(got) == odd.count() and rows.select("row.*").columns == odd.columns
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["row"]["text"] or "")
        assert r["n_words"] == len(words)
        assert [tuple(x) for x in r["runs"]] == runs(words, 12) if len(words) < 1000 else True
    assert periodic_runs(nothing).collect() == []


def test_a_long_text_of_one_word(make):
    n = 200_000
    rows = periodic_runs(make([(1, "x " * n), (2, "a b c " * (n // 3))])).collect()
    assert [[tuple(x) for x in r["runs"]] for r in rows] == [[(0, n, 1)], [(0, n // 3 * 3, 3)]]
    assert [r["collapsed"] for r in rows] == ["x", "a b c"]


def test_least(odd):
    with pytest.raises(ValueError):
        periodic_runs(odd, least=1)
