"""Near-duplicate components against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from marlstone.llm import minhash, shared

SCHEMA = "doc_id long, text string, doc_id_ string, component_id string, n_shingles string"


def brute(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
        sets.setdefault(doc_id, []).append(s)
    flat = [(d, s) for d, found in sets.items() for s in found]
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            n = len(s & t)
            if s and t and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in flat)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)


def found(spark, rows, words, percent):
    got = minhash.near_duplicates(table(spark, rows), words=words, percent=percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def corpus(seed: int) -> list[tuple[int, str | None]]:
    """Chains and stars of near copies around several edit rates, copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts: list[str | None] = [None, "", " \t\n", "one", "One", "one two", "a" * 50_000, "é ü ß", "é ü ß"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 4, 9])):
            edited = base[:]
            for i in range(len(edited)):
                if rng.random() < rng.choice([0.002, 0.01, 0.03, 0.06]):
                    edited[i] = word()
            texts += [" ".join(edited)] * rng.choice([1, 1, 3])
            if rng.random() < 0.5:
                base = edited
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, words, percent, seed):
    rows = corpus(seed)
    assert found(spark, rows, words, percent) == brute(rows, words, percent)


def test_large_groups_of_copies_and_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(400):
        e = base[:]
        e[rng.randrange(200)] = f"x{i}"
        e[rng.randrange(200)] = f"y{i}"
        rows.append((1000 + i, " ".join(e)))
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


def test_the_exact_threshold(spark):
    a = [f"w{i}" for i in range(37)]  # 35 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:32])), (3, " ".join(a[:31]))]  # 30 of 35 and 29 of 35, both against 85 %
    assert found(spark, rows, 3, 85) == [(1, 35, 1), (2, 30, 1), (3, 29, 1)]  # 3 reaches 1 by 2
    assert found(spark, [rows[0], rows[2]], 3, 85) == [(1, 35, 1), (3, 29, 3)]


def test_repeated_and_null_ids(spark):
    text = "a b c d e f"
    rows = [(5, text), (5, text), (4, text), (None, text), (None, None), (7, "q w e r t y"), (7, "other words in here")]
    got = minhash.near_duplicates(table(spark, rows), words=3, percent=85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True)] * 2 + [(4, 4, True), (5, 4, False), (5, 4, False), (7, 7, True), (7, 7, True)]


def test_repeated_rows_in_buckets_of_several_components(spark):
    """Pairs that meet neither the smallest nor the largest member of their buckets, every row twice."""
    rng = random.Random(4)
    rows = []
    for i in range(8):
        base = [f"w{i}_{j}" for j in range(200)]
        for k in range(24):
            e = base[:]
            for j in rng.sample(range(10, 190), 5):
                e[j] = f"x{i}_{k}_{j}"
            rows.append((100 * i + k + (2000 if k % 2 else 0), " ".join(e)))
        rows += [(1000 + 2 * i, " ".join(base)), (1001 + 2 * i, " ".join([*base[:-1], f"y{i}"]))]
    want = brute(rows, 3, 95)
    assert sum(d != c for d, _, c in want) == 8
    assert found(spark, rows, 3, 95) == want
    assert found(spark, rows * 2, 3, 95) == sorted(want * 2)


def test_an_empty_table(spark):
    assert found(spark, [], 3, 85) == []


def test_deduplicated_keeps_one_of_each_and_all_columns(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j"), (None, "a b c d e f g"), (4, None)]
    out = minhash.deduplicated(table(spark, rows))
    assert out.columns == ["doc_id", "text", "doc_id_", "component_id", "n_shingles"]
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 2, 4]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    sig = minhash.signatures([a, b, a[:0]])
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.15 and not sig[2].any()
    many = [abs((lambda s: (s[0] == s[1]).mean())(minhash.signatures([rng.permutation(a[:40]), a[10:50]])) - 0.6) for _ in range(3)]
    assert max(many) < 0.2


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits)


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_words_of_polynomial_hash_collisions_stay_apart(spark, n):
    rows = [(1, thue_morse(n, "a", "b")), (2, thue_morse(n, "b", "a")), (3, f"{thue_morse(n, 'a', 'b')} x y"), (4, f"{thue_morse(n, 'b', 'a')} x y")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i in (1, 2, 3, 4)}


def test_segments_with_one_hash_are_told_apart_by_bytes(monkeypatch):
    data = np.frombuffer(b"ab cd ab cde cd", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 13]), np.array([2, 5, 8, 12, 15])
    want = [0, 1, 0, 3, 1]
    first, inverse = shared.distinct_segments(data, starts, ends)
    assert [int(first[i]) for i in inverse] == want
    monkeypatch.setattr(shared, "segment_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    first, inverse = shared.distinct_segments(data, starts, ends)
    assert [int(first[i]) for i in inverse] == want


def test_many_long_texts_in_one_bucket(spark, monkeypatch):
    """Blocks are bounded by shingles, too."""
    monkeypatch.setattr(minhash, "SHINGLES", 2000)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**6, 900)
    rows = []
    for i in range(24):
        words = base.copy()
        at = rng.choice(900, 12 + 12 * (i % 3), replace=False)
        words[at] = rng.integers(0, 10**6, len(at))
        rows.append((i, " ".join(map(str, words))))
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)


@pytest.mark.parametrize("seed", [0, 1])
def test_a_words_hash_is_that_of_its_bytes_alone(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(n)).encode() for n in (1, 5, 63, 64, 65, 128, 129, 5000, 5)]
    alone = [int(shared.segment_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), seed)[0]) for w in words]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, counts = shared.words_at(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == words and counts.tolist() == [len(words)]
    assert shared.segment_hashes(data, starts, ends, seed).tolist() == alone and len(set(alone)) == len(set(words))


def test_hot_groups_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    rows = [(1, "x")] * 5 + [(2, "y")] * 2 + [(None, "z")] * 4 + [(3, "w")]
    df = spark.createDataFrame(rows, "k long, v string")
    groups = df.where("k < 3").groupBy("k").count().withColumnRenamed("count", "n")
    left = sorted(map(repr, shared.with_groups(df, groups, ["k"], "n").collect()))
    inner = sorted(map(repr, shared.with_groups(df, groups, ["k"], "n", "inner").collect()))
    assert left == sorted(map(repr, df.join(groups, "k", "left").select("k", "v", "n").collect()))
    assert inner == sorted(map(repr, df.join(groups, "k").select("k", "v", "n").collect()))


def test_components_with_hot_hubs(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    rows = corpus(5)
    assert found(spark, rows, 3, 85) == brute(rows, 3, 85)
    edges = [(0, i) for i in range(1, 40)] + [(i, 100 + i) for i in range(40)] + [(200, 201), (201, 202)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {v for n, v in got.items() if n < 200} == {0} and {v for n, v in got.items() if n >= 200} == {200}
