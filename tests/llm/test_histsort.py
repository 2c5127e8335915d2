import random
import zlib

from marlstone.llm import histsort


def check(spark, rows, n=8, tolerance=0.02):
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, shard int")
    got = histsort.sharded(df, n).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n for r in got)
    size = [sum(r["size"] for r in got if r["shard"] == k) for k in range(n)]
    for k in range(n):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    longest = max((r["size"] for r in got), default=0)
    mean = sum(size) / n
    assert all(abs(s - mean) <= tolerance * mean + longest for s in size), size
    return {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_shards_are_near_equal_in_bytes(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 1, 50, 300]) + str(rng.random())) for i in range(4000)]
    first = check(spark, rows)
    rng.shuffle(rows)
    assert check(spark, rows) == first


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "the same text") for i in range(1500)] + [(10_000 + i, f"text {i}" * 3) for i in range(3000)]
    check(spark, rows)
    shards = check(spark, [(i, "same") for i in range(2000)])
    assert len({s for s, _ in shards.values()}) == 8


def test_a_boundary_cuts_at_most_one_group_of_copies(spark):
    rows = [(i * 5 + j, f"group {i} " * 5) for i in range(500) for j in range(5)]
    shards = check(spark, rows)
    cut = sum(len({shards[i * 5 + j][0] for j in range(5)}) > 1 for i in range(500))
    assert cut <= 7


def test_odd_rows(spark):
    check(spark, [])
    check(spark, [(1, None)])
    check(spark, [(1, None), (1, None), (None, ""), (None, None), (2, "é" * 3000), (3, "\x00")])
    got = histsort.sharded(spark.createDataFrame([(1, "a")] * 50, "doc_id long, text string")).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(50))


def test_few_shards_and_native_plan(spark):
    check(spark, [(i, str(i)) for i in range(100)], 1)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = histsort.sharded(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
