"""Operators on documents against brute force, and on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from loofold.llm import fuzzyhash, language, mixing, neardup, packing, rules, scoring, secrets, substrings
from loofold.llm.attention import Shape
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- substrings


def brute_kept(rows, k):
    """rows: (doc_id, text)"""
    least = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - k + 1):
            first = least.get(tuple(w[p : p + k]))
            if first is not None and (i is None or first < i):
                gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,m", [(50, 8), (5, 2), (3, 3), (1, 1)])
def test_substrings(odd, k, m):
    found = substrings.without_repeats(odd, k, m).collect()
    assert sorted(map(tuple, found), key=repr) == brute_kept([(r.doc_id, r.text) for r in odd.collect()], k)


def test_substrings_shared_passages(make, monkeypatch):
    passage = prose(80, 99)
    rows = [(i, " ".join([prose(i % 7 * 9, i), passage, prose(i % 5 * 11, i + 50)])) for i in range(40)]
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 1500)  # folds of a few documents
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    found = substrings.without_repeats(make(rows).repartition(5)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_kept(rows, 50)


def test_equal_hashes_are_compared_by_words(monkeypatch):
    monkeypatch.setattr(substrings.Segments, "window_hashes", lambda self: np.zeros(len(self.at), np.uint64))
    docs = np.array([1, 2, 3])
    here = substrings.Segments([b"a b c d", b"x b c d", b"b c d a"], docs, docs, np.zeros(3, np.int64), 3)
    repeat = {(int(here.docs[s]), int(p - here.bounds[s])) for s, p in zip(here.segment[here.repeats()], here.at[here.repeats()])}
    assert repeat == {(2, 1), (3, 0)}


# ---- fingerprints


def brute_signature(text):
    data, n = text, len(text)
    padded = b"\0" * 7 + data

    def mixed(x):
        x = (x ^ (x >> 15)) * 0x2C1B3C6D % (1 << 32)
        return x ^ (x >> 13)

    ends = []
    for i in range(n):
        h = sum((padded[i + 7 - j] + 1) * pow(0x01000193, j + 1, 1 << 32) for j in range(7)) % (1 << 32)
        h = mixed(h) + 1
        if h % 3 == 0:
            ends.append((i + 1, (h & -h).bit_length() - 1))
    most = max(0, int(np.ceil(np.log2(max(n, 1) / 192))))
    k = next((k for k in range(most, 0, -1) if sum(p >= k for _, p in ends) >= 32), 0)
    out = []
    for level in (k, k + 1):
        cuts = [e for e, p in ends if p >= level][:63]
        if (cuts[-1] if cuts else 0) < n:
            cuts.append(n)
        letters, begin = "", 0
        for end in cuts:
            h = sum((b + 1) * pow(fuzzyhash.ODD, j, 1 << 64) for j, b in enumerate(data[begin:end])) % (1 << 64)
            h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            letters += chr(fuzzyhash.LETTERS[h >> 58])
            begin = end
        out.append(letters)
    return f"{3 << k}:{out[0]}:{out[1]}"


def brute_like(a, b):
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")

    def like(s, t):
        if not s or not t:
            return 0.0
        run = min(4, len(s), len(t))
        if not any(s[i : i + run] in t for i in range(len(s) - run + 1)):
            return 0.0
        row = [0] * (len(t) + 1)
        for c in s:
            new = [0]
            for j, d in enumerate(t):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return 2 * row[-1] / (len(s) + len(t))

    if a == b:
        return 1.0
    x, y = int(x), int(y)
    if x == y:
        return max(like(a1, b1), like(a2, b2))
    return like(a1, b2) if x == 2 * y else like(a2, b1) if y == 2 * x else 0.0


def test_fingerprints(odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    found = fuzzyhash.edited_and_next(odd).collect()
    wanted = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        a, b, c = (brute_signature(x.encode()) for x in (t, edit, nxt))
        wanted.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), a, b, brute_like(a, b), brute_like(a, c)))
    key = lambda r: repr(r[:4])
    for x, y in zip(sorted(map(tuple, found), key=key), sorted(wanted, key=key), strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:])


def test_fingerprints_by_block(monkeypatch):
    texts = [prose(500, 1).encode(), b"", b"a" * 3000, prose(700, 2).encode()]
    whole = fuzzyhash.fingerprint_strings(*fuzzyhash.signatures(texts))
    monkeypatch.setattr(fuzzyhash, "BLOCK", 97)
    assert fuzzyhash.fingerprint_strings(*fuzzyhash.signatures(texts)) == whole == [brute_signature(t) for t in texts]


def test_likeness_of_columns(spark):
    a, b = (brute_signature(prose(400, s).encode()) for s in (1, 2))
    df = spark.createDataFrame([(a, a), (a, b), (a, None)], "x string, y string")
    found = [r[0] for r in df.select(fuzzyhash.likeness("x", "y")).collect()]
    assert found == pytest.approx([1.0, brute_like(a, b), 0.0])


# ---- rules


def test_rules(odd, nothing):
    wanted = []
    for r in odd.collect():
        text, w = r.text or "", words(r.text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {p + j for p, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        wanted.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)))
    found = rules.ledger(odd)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(wanted, key=repr)
    assert rules.ledger(nothing).count() == 0
    policy = rules.POLICIES[-1]
    rows = found.collect()
    for r in rules.ablation(found, policy).collect():
        bit = 1 << list(rules.RULES).index(r.rule)
        assert r.n_failed == sum(bool(x.failed & bit) for x in rows)
        assert r.n_kept == sum(not x.failed & policy.mask for x in rows)
        assert r.n_kept_without == sum(not x.failed & policy.mask & ~bit for x in rows)
        assert r.n_alone == r.n_kept_without - r.n_kept


# ---- near duplicates


def brute_classes(rows, how, counts):
    rarity = neardup.rarity_weights(*counts, how)
    keys = [f"{t}" if t is not None else f"null:{i}" for i, t in rows]
    vectors = {}
    for key, (_, t) in zip(keys, rows):
        if words(t):
            found, times, _ = neardup.shingles([t.encode()], how.shingle)
            vectors[key] = dict(zip(found.tolist(), (times * rarity[(found & np.uint64((1 << 18) - 1)).astype(int)]).tolist()))
    names = list(dict.fromkeys(keys))
    root = {k: k for k in names}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(names)):
        for b in range(a):
            x, y = vectors.get(names[a]), vectors.get(names[b])
            if x and y:
                least = sum(min(v, y[k]) for k, v in x.items() if k in y)
                if least / (sum(x.values()) + sum(y.values()) - least) >= how.similarity:
                    root[top(names[a])] = top(names[b])
    members = collections.defaultdict(list)
    for key, (i, _) in zip(keys, rows):
        members[top(key)].append(i)
    return sorted(
        ((i, min((x for x in members[top(key)] if x is not None), default=None), len(members[top(key)])) for key, (i, _) in zip(keys, rows)),
        key=repr,
    )


def edited(text, at, word="changed"):
    w = text.split()
    for p in at:
        w[p % len(w)] = word
    return " ".join(w)


def test_near_duplicates(make, odd):
    how = neardup.Settings()
    base, other = prose(300, 5), prose(260, 6)
    rows = [(100 + i, edited(base, [i * 7, i * 13 + 3], f"w{i}")) for i in range(25)]
    rows += [(200 + i, edited(other, range(0, 260, 9), f"v{i}")) for i in range(6)] + [(300, base), (301, other), (302, other)]
    rows += [(400 + i, prose(100, 20) + " " + prose(120, 30 + i)) for i in range(12)]  # a shared passage is no copy
    docs = make(rows).unionByName(odd)
    classes = neardup.near_duplicates(docs, how)
    found = classes.select("doc_id", "class_id", "class_size").collect()
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, found), key=repr) == brute_classes(pairs, how, neardup.frequencies(docs.select("text"), how))
    kept = neardup.one_of_each(docs, how)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == classes.select("root").distinct().count()
    assert len(left) == len(set(left))
    assert {t for i, t in left if i == 4} == {prose(120, 1), prose(90, 2)}  # unlike texts of one id are no copies


@pytest.mark.parametrize("block", [3, 512])
def test_large_mixed_bucket(make, monkeypatch, block):
    """Buckets beyond the small size whose centre does not explain all members."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    how = neardup.Settings(bands=14, rows=1, small=2)
    shared = prose(60, 7)
    rows = []
    for g in range(4):
        own = shared + " " + prose(90, 50 + g)
        rows += [(10 * g + i, edited(own, [70 + 11 * i], f"e{i}")) for i in range(4)]
    docs = make(rows)
    found = neardup.near_duplicates(docs, how).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, found), key=repr) == brute_classes(rows, how, neardup.frequencies(docs.select("text"), how))


def test_twins_over_one_template(make):
    """Pairs of near copies in buckets of hundreds that share a template and are unlike each other."""
    how = neardup.Settings()
    rows = []
    for g in range(250):
        own = prose(150, 7) + " " + " ".join(f"g{g}w{j}" for j in range(46))
        rows += [(2 * g, own), (2 * g + 1, edited(own, [10 + g % 30, 60 + g % 50, 120], f"e{g}"))]
    docs = make(rows)
    found = neardup.near_duplicates(docs, how).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, found), key=repr) == brute_classes(rows, how, neardup.frequencies(docs.select("text"), how))


def test_similarities_of_a_block():
    rng = np.random.default_rng(6)
    rarity = (1 + 0.25 * rng.random(1 << neardup.FREQUENCY_BITS)).astype(np.float32)
    pool, texts = rng.integers(0, 1 << 32, 60, dtype=np.uint32), [np.zeros(1, np.uint32).tobytes()]
    for _ in range(20):
        runs = np.unique(rng.choice(pool, rng.integers(1, 50)))
        counts = rng.integers(1, 4, len(runs)).astype(np.uint32)
        more = np.flatnonzero(counts != 1).astype(np.uint32)
        texts.append(np.concatenate((np.array([len(runs)], np.uint32), runs, more, counts[more])).tobytes())
    found = neardup.similarities(texts, texts[:7], rarity)
    wanted = [[neardup.similarity(neardup._vector(a), neardup._vector(b), rarity) for b in texts[:7]] for a in texts]
    assert np.allclose(found, wanted, atol=1e-6)
    x, y = np.array([1, 2, 1, 5, 6, 7, 5]), np.array([2, 3, 3, 6, 7, 5, 1])
    assert neardup.forest(x, y).tolist() == [True, True, False, True, True, False, True]


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    runs = rng.integers(1 << 48, size=400).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 400).astype(np.float32), rng.uniform(0.5, 3, 400).astype(np.float32)
    drawn = neardup.samples(np.concatenate((runs, runs)), np.concatenate((a, b)), np.array([0, 400, 800]), 3000)
    assert abs((drawn[:, 0] == drawn[:, 1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


# ---- packing


def test_packing(odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    texts = collections.Counter((r.doc_id, tuple([*model.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in odd.collect())
    got = collections.defaultdict(dict)
    found = packing.pack(odd, longest=64).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    for r in found:
        assert r.length == 1 << r.bucket <= 64 and r.offset == 0 and r.sequence_id & 15 == r.bucket
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        got[r.doc_id].setdefault((r.start, tuple(ids)), 0)
        got[r.doc_id][r.start, tuple(ids)] += 1
    for (i, ids), times in texts.items():
        at, left = 0, len(ids)
        while left:
            size = min(64, 1 << (left.bit_length() - 1))
            assert got[i][at, ids[at : at + size]] >= times
            at, left = at + size, left - size
    assert sum(sum(x.values()) * 1 for x in got.values()) == len(found)


def test_words_are_tokenized_as_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "KEPT_BYTES", 30 * packing.ENTRY_BYTES)  # the table begins anew between texts
    model = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    texts = ["It's, don't. A,b c., d.. É, Straße. İstanbul 3,5 <|endoftext|>x x<|startoftext|> ǅ", "été,  a b Σίσυφος 你好. \x85", "", "naïve, naïve. NAÏVE NaÏve,", prose(60, 1)]
    for part in (texts, texts[::-1]):
        ids, bounds = packing.token_ids("word_bpe_49k.json", [t.encode() for t in part], 1)
        for t, a, b in zip(part, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == [*model.encode(t, add_special_tokens=False).ids, 1]


def encodings(monkeypatch, vocabulary):
    seen, encoded = collections.Counter(), vocabulary.encoded
    monkeypatch.setattr(vocabulary, "encoded", lambda word: seen.update([word]) or encoded(word))
    return seen


def test_signs_behind_letters_are_learnt_once(monkeypatch):
    vocabulary = packing.Vocabulary("word_bpe_49k.json", 1)
    seen = encodings(monkeypatch, vocabulary)
    texts = ["plain$$$ für!! Öl%%% plain für,", "\tplain!! für$$$ öl, Öl x.y*** don't$$$ e\u0301!! 5.", "", None]
    _, words, bounds = vocabulary.words(pa.array(texts).fill_null(""))
    vocabulary.codes(words)
    assert {"plain", "für", "$$$", "!!", "%%%", ","} <= {w.decode() for w in seen} and max(seen.values()) == 1
    assert not any(w.startswith((b"plain", "für".encode())) and len(w) > 5 for w in seen)
    assert bounds.tolist()[-1] == bounds.tolist()[-2] + 1  # an empty text is one empty word, which has no ids
    monkeypatch.setitem(packing._vocabularies, ("word_bpe_49k.json", 1), vocabulary)
    ids, at = packing.token_ids("word_bpe_49k.json", pa.array(texts), 1)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == [*vocabulary.full.encode(t or "", add_special_tokens=False).ids, 1]


def test_words_used_most_stay(monkeypatch):
    """A full table drops rare words and not those that come in every text."""
    monkeypatch.setattr(packing, "KEPT_BYTES", 40 * packing.ENTRY_BYTES)
    vocabulary = packing.Vocabulary("word_bpe_49k.json", 1)
    seen = encodings(monkeypatch, vocabulary)
    monkeypatch.setitem(packing._vocabularies, ("word_bpe_49k.json", 1), vocabulary)
    for i in range(20):
        texts = [f"often and {'abcdefghij'[j]}{'abcdefghijklmnopqrst'[i]}q often" for j in range(10)]
        ids, at = packing.token_ids("word_bpe_49k.json", [t.encode() for t in texts], 1)
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == [*vocabulary.full.encode(t, add_special_tokens=False).ids, 1]
    assert seen[b"often"] == seen[b"and"] == 1 and len(vocabulary.code) < 60


# ---- mixing


def test_mixing(odd, nothing):
    found = mixing.mix(odd).collect()
    sizes = collections.defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += len(words(r.text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    total = 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target[s] for s in order if s not in open_)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
        if not over:
            break
    target |= {s: level * weight[s] for s in open_}
    assert sorted({(r.source_size, round(r.target, 6)) for r in found}) == sorted({(sizes[s], round(target[s], 6)) for s in order})
    for r in found:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 2
    assert sorted(map(tuple, mixing.mix(odd).collect()), key=repr) == sorted(map(tuple, found), key=repr)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in found)
    assert mixing.mix(nothing).count() == 0


def test_mix_comes_near_targets(make):
    docs = make([(i, prose(20 + i % 30, i), None, f"s{i % 4}") for i in range(1500)])
    taken = collections.defaultdict(int)
    target = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id % 4] += r.copies * r.size
        target[r.doc_id % 4] = r.target
    assert all(abs(taken[s] - t) < 0.06 * t for s, t in target.items())


def test_hot_sources_are_salted(odd, monkeypatch):
    whole = sorted(map(tuple, mixing.mix(odd).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mixing.mix(odd).collect()), key=repr) == whole


# ---- language


@pytest.fixture(scope="module")
def languages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    return docs, language.trained_on_folds(docs)


def test_language_held_out(languages):
    docs, model = languages
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(found) == docs.count()
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_changes_within_a_text(spark, languages):
    docs, model = languages
    some = {r.lang: r.text.split()[:40] for r in docs.where("n_chars between 400 and 3000").collect()}
    a, b = sorted(some)[:2]
    text = " ".join(some[a] + some[b])
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = [r.lang for r in language.label_words(frame, model).orderBy("position").collect()]
    right = sum(x == a for x in labels[:40]) + sum(x == b for x in labels[40:])
    assert right >= 68


def test_language_odd_rows(odd, nothing, languages):
    _, model = languages
    found = rows_of(language.identify(odd, model))
    assert len(found) == odd.count()
    texts = collections.Counter(any(map(str.isalpha, r.text or "")) for r in odd.collect())
    assert sum(r["lang_pred"] != "und" for r in found) == texts[True]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert language.identify(nothing, model).count() == 0
    assert language.trained_on_folds(nothing) is None
    assert {r["lang_pred"] for r in rows_of(language.identify(odd, None))} == {"und"}
    assert language.identify(odd, model, keep_row=True).select("row.*").columns == odd.columns


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    scores, change, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 0, 3])
    found = language.marginals(scores, lengths, change, start)
    for begin, n in ((0, 4), (4, 3)):
        total = np.zeros((n, 3))
        for path in np.ndindex(*(3,) * n):
            value = start[path[0]] + sum(scores[begin + t, s] for t, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:]))
            for t, s in enumerate(path):
                total[t, s] += np.exp(value)
        assert np.allclose(found[begin : begin + n], total / total.sum(axis=1, keepdims=True))


def test_gradient_of_the_chains():
    """Against differences of minus the log-likelihood, with the normaliser by enumeration."""
    rng = np.random.default_rng(4)
    scores, change, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths, label = np.array([4, 0, 3]), rng.integers(0, 3, 7)

    def loss(scores, change, start):
        out = 0.0
        for begin, n in ((0, 4), (4, 3)):
            value = lambda path: start[path[0]] + sum(scores[begin + t, s] for t, s in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            out += np.log(sum(np.exp(value(p)) for p in np.ndindex(*(3,) * n))) - value(label[begin : begin + n])
        return out

    given = [scores, change, start]
    for found, x in zip(language.gradient(scores, lengths, label, change, start), given, strict=True):
        for at in np.ndindex(*x.shape):
            sides = []
            for step in (1e-5, -1e-5):
                x[at] += step
                sides.append(loss(*given))
                x[at] -= step
            assert found[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_pipeline_keeps_switched_and_unlabelled_texts(spark, make, languages):
    import corpus_pipeline

    docs, _ = languages
    some = [r.text.split()[:30] for r in docs.where("n_chars between 400 and 3000").orderBy("lang").dropDuplicates(["lang"]).collect()]
    mixed = docs.limit(0).unionByName(docs).select("doc_id", "text", "lang")
    mixed = mixed.unionByName(spark.createDataFrame([(999_999, " ".join(sum(some, [])), None)], mixed.schema))
    kept = corpus_pipeline.language_id(spark, mixed, "")
    assert kept.where("doc_id = 999999").count() == 1
    bare = make([(1, "words of no label", None, "a"), (2, "123 --", None, "a"), (3, None, None, "a")])
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, bare, "").collect()] == [1]


# ---- language model


def test_scoring(odd, nothing, monkeypatch):
    small = Shape(steps=3, batch=8)
    train = language.fold() != 1
    rows = [(r.doc_id, [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(r.text)]) for r in odd.collect()]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    counts = collections.Counter()
    for i, w in rows:
        if learn(i):
            counts.update([*w, "\n"])
    total, kinds = sum(counts.values()), len(counts)
    wanted = sorted(
        (
            (i, not learn(i), len(w) + 1, sum(counts[x] > 0 for x in [*w, "\n"]), total,
             round(sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in [*w, "\n"]), 6))
            for i, w in rows
        ),
        key=repr,
    )
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 2000)
    found = scoring.scored(odd, train, shape=small).collect()
    assert sorted(((*r[:5], round(r[5], 6)) for r in found), key=repr) == wanted
    assert all(r.score < 0 for r in found)
    assert scoring.scored(nothing, train, shape=small).count() == 0


def test_all_training_texts_are_learned_from(make, monkeypatch):
    monkeypatch.setattr(scoring, "SAMPLE_BYTES", 4000)
    rows = make([(i, prose(300, i)) for i in range(12)]).selectExpr("doc_id", "doc_id % 4 > 0 as train", "text")
    some = scoring.sample_sequences(rows, scoring.TOKENIZER)  # each text is longer than an eighth
    assert some and all(len(s) for s in some)
    chunks = scoring.chunked(rows, scoring.TOKENIZER).selectExpr("*", "monotonically_increasing_id() as chunk")
    size, end = scoring.vocabulary_size(scoring.TOKENIZER)
    counts = scoring.subword_counts(chunks, size, end)
    model = scoring.prepared(counts, end, Shape())
    before = {k: x.copy() for k, x in model.weights.items()}
    model, n = scoring.learned(chunks, model, end)
    assert n == counts.sum()
    assert all((model.weights[k] != x).any() for k, x in before.items())


def test_model_is_a_distribution_and_learns():
    from loofold.llm import attention

    rng, end, shape = np.random.default_rng(0), 9, Shape(steps=150, batch=32, classes=6, inputs=12, width=8, hidden=8)
    ids = [np.array([t % 8 for t in range(rng.integers(8), 60)]) for _ in range(40)]
    model = attention.prepared(np.bincount(np.concatenate(ids), minlength=10), end, shape)
    every = np.concatenate([np.append(s, end) for s in ids])
    lengths = np.array([len(s) + 1 for s in ids])
    before = attention.log_probabilities(model, every, lengths, end).sum()
    model = attention.fitted(model, ids, end)
    after = attention.log_probabilities(model, every, lengths, end)
    assert after.sum() > before + 100
    # all continuations of one context add up to one
    context = [3, 4, 5]
    options = [attention.log_probabilities(model, np.array([*context, x]), np.array([4]), end)[-1] for x in range(10)]
    assert np.exp(options).sum() == pytest.approx(1, abs=1e-4)
    # nothing ahead is seen, and windows agree with one pass where context fits
    a = attention.log_probabilities(model, every[:20], np.array([20]), end)
    b = attention.log_probabilities(model, every[:12], np.array([12]), end)
    assert np.allclose(a[:12], b, atol=1e-5)


def test_gradient():
    from loofold.llm import attention

    shape = Shape(window=6, stride=4, width=4, hidden=5, classes=5, inputs=8)
    rng = np.random.default_rng(2)
    model = attention.prepared(rng.integers(1, 9, 12), 11, shape)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    inputs, targets = rng.integers(0, 8, (3, 6)), rng.integers(0, 5, (3, 4))
    inputs[0, :2] = -1
    mask = attention._mask(shape).astype(np.float64)
    _, d = attention.gradient(w, model.prior, inputs, targets, shape, mask)
    for name in w:
        at = tuple(rng.integers(s) for s in w[name].shape)
        if name == "embed":
            at = (int(inputs[1, 3]), 1)
        sides = []
        for step in (1e-5, -1e-5):
            w[name][at] += step
            sides.append(attention.gradient(w, model.prior, inputs, targets, shape, mask)[0])
            w[name][at] -= step
        assert d[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-6), name


# ---- secrets


def planted(i):
    value = hashlib.sha256(str(i).encode()).hexdigest()
    key = "AKIA" + value.upper()[:16]
    lines = [f"password={value[:18]}", f'token = "{value[:40]}"', f"seen {key} here"]
    plain = [f"call 47{i:014d} now", f"mail first.last{i}@example-host{i}.com", f"at 192.168.{i % 250}.{i * 7 % 250}", "SHOUTINGWORDSHERE again", f"see https://site.example.com/Path{i}/page"]
    return lines[i % 3], plain[i % 5]


def test_secrets(make, odd, nothing):
    rows = [(i, prose(30, i) + "\n" + "\n".join(planted(i)) + "\n" + prose(20, i + 7)) for i in range(240)]
    docs = make(rows)
    scanner = secrets.trained(docs)
    found = [r.value for r in secrets.findings(docs, scanner).where("is_secret").collect()]
    wanted = [re.search(r"[0-9a-f]{18,}|AKIA\w+", planted(i)[0])[0] for i in range(240)]
    assert sorted(found) == sorted(wanted)
    clean = {r.doc_id: r.text for r in secrets.redacted(docs, scanner).collect()}
    assert all(clean[i] == t.replace(wanted[i], secrets.MASK) for i, t in rows)
    same = secrets.redacted(odd, scanner)
    assert same.columns == odd.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    empty = secrets.trained(nothing)
    assert secrets.findings(nothing, empty).count() == 0


def test_secrets_of_known_formats_are_kept(make):
    value = hashlib.sha256(b"x").hexdigest()
    hidden = [
        f"xoxb-{value[:12]}-{value[12:36]}", f"sk_live_{value[:24]}", f"eyJ{value[:20]}.eyJ{value[20:50]}.{value[:30]}", f"glpat-{value[:20]}",
    ]
    short = ["hunter7", "correcthorse"]
    rows = [(i, prose(20, i) + "\n" + planted(i)[1] + "\n" + prose(9, i)) for i in range(40)]
    rows += [(100 + i, f"{prose(9, i)} uses {v} here") for i, v in enumerate(hidden)]
    rows += [(200 + i, f"{prose(9, i)} password={v}\n") for i, v in enumerate(short)]
    docs = make(rows)
    found = {r.value for r in secrets.findings(docs, secrets.trained(docs)).where("is_secret").collect()}
    assert found == {*hidden, *short}
    none = make(rows[:40])  # no known format to learn from
    found = {r.value for r in secrets.findings(docs, secrets.trained(none)).where("is_secret").collect()}
    assert found == {*hidden, *short}


def test_forest_as_expression(spark):
    text = "title\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     Predict: 0.0\n    Else (feature 0 > 0.5)\n     If (feature 1 <= 2.0)\n      Predict: 1.0\n     Else (feature 1 > 2.0)\n      Predict: 0.0\n  Tree 1 (weight 1.0):\n    Predict: 1.0\n"
    trees = secrets.parsed(text)
    assert trees == [(0, 0.5, 0.0, (1, 2.0, 1.0, 0.0)), 1.0]
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 2.0],), ([1.0, 3.0],)], "f array<double>")
    assert [r[0] for r in df.select(secrets.vote(trees, df["f"])).collect()] == [0.5, 1.0, 0.5]


def test_labelled_findings_are_learned(spark, make):
    rows = [("k" + hashlib.md5(str(i).encode()).hexdigest()[:15].upper(), "x ", "", 1) for i in range(80)]
    rows += [(f"host{i:08d}.net", "x ", "", 0) for i in range(80)]
    labelled = spark.createDataFrame(rows, "value string, before string, after string, label int")
    docs = make([(1, "x kABCDEF0123456789 then host00001234.net")])
    found = {r.value: r.is_secret for r in secrets.findings(docs, secrets.trained(docs, labelled=labelled)).collect()}
    assert found == {"kABCDEF0123456789": True, "host00001234.net": False}


def test_forest_on_held_out_findings(spark, make):
    """Findings of another seed, and some written by hand; the forest alone, without known formats."""
    words = "house garden walked morning letter teacher against between another station".split()
    docs = make([(i, " ".join(words[(i + k) % 10] for k in range(60)), "en", "a") for i in range(30)])
    scanner = secrets.trained(docs)
    rows = secrets.generated(spark, scanner.words, 1500, 99).withColumn("find", F.struct("value", "before", "after"))
    rows = rows.withColumn("score", secrets.vote(scanner.trees, secrets.features(F.col("find"), scanner.words)))
    found = [(r.label, r.score >= scanner.how.threshold) for r in rows.collect()]
    hits, named, all_secrets = sum(a and b for a, b in found), sum(b for _, b in found), sum(a for a, _ in found)
    assert 600 < all_secrets < 900 and hits >= 0.95 * all_secrets and hits >= 0.95 * named
    by_hand = {
        "The password: remember to change it": set(),
        "our token: yesterday": set(),
        "fixed in commit 9fceb02d0ae598e95dc970b74767f19372d61af8 and later": set(),
        "see /usr/share/doc/libfoo2/README or LinkedHashMap2": set(),
        'use token = "8f14e45fceea167a5a36dedd4bea2543f1e2d3c4" there': {"8f14e45fceea167a5a36dedd4bea2543f1e2d3c4"},
        "the api key: Zx81LmQ09bTr7YwKp3Vd today": {"Zx81LmQ09bTr7YwKp3Vd"},
        "password=hunter7": {"hunter7"},
    }
    frame = make([(i, t, "en", "a") for i, t in enumerate(by_hand)])
    got = {t: set() for t in by_hand}
    for r in secrets.findings(frame, scanner).where("is_secret").collect():
        got[list(by_hand)[r.doc_id]].add(r.value)
    assert got == by_hand


def test_very_long_keys_take_no_stack(make):
    long = ["/" + "segment/" * 40_000, "Word-" * 60_000, "a" * 300_000 + "1", "A" * 200_000]
    docs = make([(i, f"see {x} password=hunter7", "en", "a") for i, x in enumerate(long)])
    assert secrets.findings(docs, secrets.trained(docs)).where("is_secret and value = 'hunter7'").count() == 4


def test_added_tokens_inside_texts():
    """Texts can't inject the end token in another case; ids are those of the tokenizer."""
    texts = ["a <|ENDOFTEXT|> b", "<|endoftext|>", "x<|EndOfText|>.", "B, <|startoftext|>C. d.", "<|", "É, A.b. İ.", ""]
    ids, bounds = packing.token_ids("word_bpe_49k.json", [t.encode() for t in texts], 1)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]
