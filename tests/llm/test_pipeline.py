"""The stages one by one against brute force on the smallest tables, and the whole of run()."""

import corpus_pipeline as cp
from marlstone.llm import langid, mixing, surrogate
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import plain_targets, size_of


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    steps = {}
    now = docs
    for name, stage in cp.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stages/{name.replace(' ', '-')}"
        stage(spark, now, data).write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        steps[name] = now
        assert now.columns == docs.columns
    rows = lambda df: [tuple(r) for r in df.collect()]
    spoken, single, private, mix = steps.values()

    scores = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identified(docs).collect()}
    keep = {d for d, (lang, s) in scores.items() if lang != "und" and s >= 0.5}
    assert sorted(rows(spoken)) == sorted(r for r in rows(docs) if r[0] in keep) and len(keep) >= 0.95 * docs.count()

    parts = brute([(r[0], r[1]) for r in rows(spoken)], 5, 80)
    assert sorted(rows(single)) == sorted(r for r in rows(spoken) if r[0] in {d for d, _, c in parts if d == c})

    made = surrogate.Surrogates()
    assert {r[0]: r[1] for r in rows(private)} == {r[0]: surrogate.replaced(r[1], made)[0] for r in rows(single)}
    assert all(r[4] == len(r[1]) for r in rows(private))

    _, target = plain_targets([(r[0], r[1], r[3]) for r in rows(private)])
    longest, taken = {}, {}
    for r in rows(private):
        longest[r[3]] = max(longest.get(r[3], 0), size_of(r[1]))
    for r in rows(mix):
        taken[r[3]] = taken.get(r[3], 0) + size_of(r[1])
    assert all(abs(taken.get(s, 0) - target[s]) <= longest[s] for s in target)
    copies = {r["doc_id"]: r["copies"] for r in mixing.assigned(private).collect()}
    assert sorted(rows(mix)) == sorted(r for r in rows(private) for _ in range(copies[r[0]]))

    out = cp.STAGES[-1][1](spark, mix, data).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows(mix)) and all(r["round_trip"] for r in out)
    whole = cp.run(spark, data).collect()
    assert sorted(whole) == sorted(out)


def test_an_empty_table_passes_all_stages(spark, data):
    now = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, data)
    assert now.count() == 0
