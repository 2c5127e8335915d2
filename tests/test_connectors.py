import base64
import hashlib
import json
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.errors import InvalidValueError
from marlstone.sources import connectors
from marlstone.sources.store import Store, latest, upserted


def test_json_files_and_lines(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name, body in (("a/1.json", '{"x": 1}'), ("a/b/2.json", "{bad"), ("3.json", "  ")):
        (tmp_path / name).write_text(body)
    rows = connectors.json_files(spark, str(tmp_path)).collect()
    assert {(r["body"], r["problem"]) for r in rows} == {("{bad", "not JSON"), ('{"x": 1}', None)}
    (tmp_path / "l.txt").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert connectors.json_lines(spark, str(tmp_path / "l.txt")).count() == 2


def test_training_samples(spark, tmp_path):
    (tmp_path / "text_en").write_text("hello")
    (tmp_path / "text_fr").write_text("bonjour")
    (tmp_path / "other").write_text("x")
    assert {(r["label"], r["text"]) for r in connectors.samples(spark, str(tmp_path), 4).collect()} == {("en", "hell"), ("fr", "bonj")}


def test_store_values():
    packed = base64.b64encode(zlib.compress(b"hello")).decode()
    doc = {
        "_id": {"$oid": "4f"}, "n": {"$numberLong": "5"}, "f": {"$numberDouble": "1.5"}, "d": {"$date": {"$numberLong": "1000"}}, "iso": {"$date": "1970-01-01T00:00:02Z"},
        "t": {"$timestamp": {"t": 7, "i": 1}}, "b": {"$binary": {"base64": packed, "subType": "00"}}, "l": [{"$numberInt": "1"}, None, True], "o": {"a": "x"},
    }
    assert connectors.plain(doc) == {"_id": "4f", "n": 5, "f": 1.5, "d": 1000, "iso": 2000, "t": [7, 1], "b": "hello", "l": [1, None, True], "o": {"a": "x"}}
    with pytest.raises(InvalidValueError):
        connectors.plain({"r": {"$regularExpression": {"pattern": "a"}}})
    assert connectors.extended({"a": 1 << 40, "b": [1, "x"]}) == {"a": {"$numberLong": str(1 << 40)}, "b": [1, "x"]}


def test_store_export(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"n": {"$numberLong": "5"}}\n{"r": {"$code": "x"}}\n')
    rows = connectors.store_export(spark, str(tmp_path / "e.jsonl")).collect()
    assert [json.loads(r["body"]) if r["body"] else None for r in rows] == [{"n": 5}, None] and rows[1]["problem"]


def test_inflated(spark):
    df = spark.createDataFrame([(bytearray(zlib.compress(b"x" * 50)),), (None,)], "b binary")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(connectors.inflated(F.col("b"))).collect()] == [b"x" * 50, None]


def test_what_a_batch_unpacks_to_is_given_back_in_pieces(spark):
    values = [b"", None, *[bytes([i]) * (1 << 20) for i in range(20)], b"z"]
    packed = pd.Series([None if v is None else zlib.compress(v) for v in values])
    pieces = list(connectors.inflated.func(iter([packed])))
    assert [v for p in pieces for v in p] == values
    assert max(sum(len(v or b"") for v in p) for p in pieces) <= connectors.BATCH_BYTES + (1 << 20)
    rows = [(i, None if v is None else bytearray(zlib.compress(v))) for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, "i int, b binary").coalesce(1).select("i", F.md5(connectors.inflated(F.col("b"))).alias("d"))
    assert {r["i"]: r["d"] for r in found.collect()} == {i: None if v is None else hashlib.md5(v).hexdigest() for i, v in enumerate(values)}


def test_workers_get_batches_of_bounded_bytes(spark, data):
    from marlstone.plans import catalogue

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = F.pandas_udf(lambda part: pd.Series([len(part)] * len(part)), "int", F.PandasUDFType.SCALAR)
    try:
        spark.conf.set(name, str(1 << 30))
        catalogue.queries()["connector_inflate"](spark, data)
        most = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("x")).select(rows("x").alias("n")).agg(F.max("n")).first()[0]
        assert most * 1000 <= connectors.BATCH_BYTES + 1000
        spark.conf.set(name, "1000")
        connectors.small_batches(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.unset(name)


def test_upserts(spark):
    schema = "seq long, doc_type string, doc_id string, v int"
    df = spark.createDataFrame([(0, "t", "a", 1), (2, "t", "a", 3), (1, "u", "a", 2), (3, "t", None, 4), (4, "t", None, 5)], schema)
    last = latest(df)
    assert sorted(r["v"] for r in last.collect()) == [2, 3, 4, 5]
    new = spark.createDataFrame([(5, "t", "a", 9)], schema)
    gone = spark.createDataFrame([("u", "a")], "doc_type string, doc_id string")
    assert sorted(r["v"] for r in upserted(last, new, gone).collect()) == [4, 5, 9]


def test_versions_of_a_store(spark, tmp_path):
    from marlstone.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_type string, doc_id string, v int")
    seen = lambda: sorted((r["doc_type"], r["doc_id"] or "", r["v"]) for r in store.table().collect())
    assert store.table() is None
    store.commit(rows(*[("1", str(i), i) for i in range(40)], ("2", None, 7)))
    assert store.state()["base"]["rows"] == 41 and seen() == sorted([*(("1", str(i), i) for i in range(40)), ("2", "", 7)])
    before = store.table()
    store.commit(rows(("1", "3", 33), ("2", None, 8)).withColumn("extra", F.lit("x")), rows(("1", "4", 0), ("9", "none", 0)), batch=0, seq=5)
    want = sorted([*(("1", str(i), 33 if i == 3 else i) for i in range(40) if i != 4), ("2", "", 7), ("2", "", 8)])
    assert seen() == want and store.state()["delta"]["rows"] == 4 and store.state()["base"]["name"] == "base-1" and before.count() == 41
    store.commit(rows(("1", "4", 44)))
    assert seen() == sorted([*want, ("1", "4", 44)]) and store.state()["delta"]["name"] == "delta-3"
    store.commit(rows(*[("1", str(i), -i) for i in range(5)]))
    assert store.state()["delta"] is None and store.state()["base"]["name"] == "base-4" and len(seen()) == 42
    assert (store.state()["batch"], store.state()["seq"]) == (0, 5)
    store.commit(rows())
    assert len(seen()) == 42 and sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["base-4", "delta-5"]


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_type string, doc_id string, v long")
    seen = lambda: sorted((r["doc_id"], r["v"]) for r in store.table().collect())
    store.commit(rows(("1", "a", 1), ("1", "b", 2)))
    before, state = seen(), store.state()

    class Died(Exception):
        pass

    def die(*args, **kwargs):
        raise Died

    for step in ("write_text", "_write"):
        with monkeypatch.context() as m:
            m.setattr(store, step, die)
            with pytest.raises(Died):
                store.commit(rows(("1", "a", 9)))
        assert seen() == before and store.state() == state
    side = store._file
    fs, _ = side("")
    stream = fs.create(side("_pointer.json.2-abc")[1], False)  # a file that was never renamed into place
    stream.write(bytearray(b"half"))
    stream.close()
    assert seen() == before and store.state() == state
    store.commit(rows(("1", "a", 3)))
    assert seen() == [("a", 3), ("b", 2)] and store.state()["version"] == 2


def test_deltas_are_appended_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("marlstone.sources.store.DELTAS", 3)
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_type string, doc_id string, v long")
    store.commit(rows(*[("1", str(i), i) for i in range(200)]))
    want = {str(i): i for i in range(200)}
    for k in range(5):
        store.commit(rows(("1", str(k), -k), ("1", "7", 100 + k)), rows(("1", str(50 + k), 0)))
        want |= {str(k): -k, "7": 100 + k}
        del want[str(50 + k)]
        assert {r["doc_id"]: r["v"] for r in store.table().collect()} == want
        assert all(p["rows"] <= 3 for p in [*store.state()["older"], store.state()["delta"]] if p)
    assert store.state()["base"]["name"] == "base-5"


def test_older_commands_never_win(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_type string, doc_id string, v long, seq long")
    store.commit(rows(("1", "a", 1, 10), ("1", "b", 2, 11), *[("1", f"x{i}", 0, 1) for i in range(60)]), seq=11)
    store.commit(rows(), rows(("1", "b", 0, 20)), seq=20)
    store.commit(rows(("1", "a", 3, 5), ("1", "b", 4, 15), ("1", "c", 5, 6)), rows(("1", "x1", 0, 0)), seq=15, late=True)
    found = {r["doc_id"]: r["v"] for r in store.table().collect() if r["v"]}
    assert found == {"a": 1, "c": 5} and store.table().count() == 62 and store.state()["seq"] == 20 and "_seq" not in store.table().columns
