import random
import re
from collections import Counter

from marlstone.llm import mixing

SCHEMA = "doc_id long, text string, source string, copies string, _copies int, size string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, "c", 1, "s") for d, t, s in rows], SCHEMA)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def plain_targets(rows):
    """Water filling, step by step."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + size_of(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, fixed = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            return size, fixed | {s: level * weight[s] for s in free}
        for s in over:
            fixed[s] = 2.0 * size[s]
            left -= fixed[s]


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["a"] * 8 + ["b", "B", "c", "é", None])
        rows.append((i, " ".join("w" * rng.choice([1, 3, 40, 200] if s != "b" else [900])) if rng.random() > 0.03 else rng.choice([None, "", " \n"]), s))
    return rows


def test_targets_and_sums(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        size, target = plain_targets(rows)
        got = mixing.assigned(table(spark, rows)).collect()
        assert len(got) == len(rows)
        taken = {}
        for r in got:
            assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) and r["source_size"] == size[r["source"]]
            assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
            taken.setdefault(r["source"], []).append((r["taken"], r["size"]))
        for s, found in taken.items():
            assert abs(sum(t for t, _ in found) - target[s]) <= max(n for _, n in found), s


def test_reruns_agree_whatever_the_partitions(spark):
    df = table(spark, corpus(3))
    key = lambda r: (r["doc_id"], r["copies"])
    first, second = (sorted(map(key, mixing.assigned(d).collect())) for d in (df.repartition(1), df.repartition(7, "source")))
    assert first == second


def test_expectations(spark):
    """A document is taken as often, on average, as its source's target says."""
    rows = [(i, "a b c", "x") for i in range(3000)] + [(3000 + i, "a b c", "y") for i in range(1000)]
    got = mixing.assigned(table(spark, rows)).collect()
    assert sum(r["copies"] == 2 for r in got if r["source"] == "y") in range(0, 1001)
    x = [r["copies"] for r in got if r["source"] == "x"]
    assert abs(sum(x) * 3 - got[0]["target"]) <= 3 or got[0]["source"] == "y"


def test_mixed_repeats_rows_and_keeps_columns(spark):
    rows = corpus(4, 200) + [(None, "a b", "a"), (None, None, None), (5, "again", "a")]
    df = table(spark, rows)
    out = mixing.mixed(df)
    assert out.schema == df.schema
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    copies = Counter()
    for r in mixing.assigned(df).collect():
        copies[r["doc_id"]] += r["copies"]
    assert n == +copies


def test_equal_rows_are_many(spark):
    """Rows without an id, and rows that repeat, neither meet in one block nor miss the target."""
    rows = [(None, "a b c", "x")] * 900 + [(1, "a b", "x")] * 300 + [(10 + i, "a b c d", "x") for i in range(300)] + [(5, "q " * 4000, "y")] * 3
    got = mixing.assigned(table(spark, rows)).collect()
    _, target = plain_targets(rows)
    assert len(got) == len(rows) and abs(sum(r["taken"] for r in got if r["source"] == "x") - target["x"]) <= 4
    assert {r["copies"] for r in got} <= {0, 1, 2} and len({r["copies"] for r in got if r["doc_id"] is None}) <= 2


def test_empty_and_wordless_tables(spark):
    assert mixing.assigned(table(spark, [])).count() == 0 and mixing.mixed(table(spark, [])).count() == 0
    got = mixing.assigned(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_the_main_path_is_native(spark):
    plan = mixing.assigned(table(spark, corpus(5, 50)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mixed_takes_the_words_that_are_assigned_with_repeated_ids(spark):
    rows = [(1, f"w{i} " * 10, "a") for i in range(9)] + [(2, "same " * 10, "a")] * 7 + [(i, "x " * i, "b") for i in range(3, 30)] + [(None, "n " * 5, "b")] * 5 + [(3, None, None)]
    df = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id long, text string, source string, copies long, _n string")
    want, got = Counter(), Counter()
    for r in mixing.assigned(df).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["taken"]
    out = mixing.mixed(df)
    assert out.columns == df.columns
    seen = Counter(r["copies"] for r in out.collect())
    for i, (doc_id, text, source) in enumerate(rows):
        n = len((text or "").split())
        got[doc_id, source, n] += n * seen[i]
    assert +got == +want and max(seen.values()) <= 2
