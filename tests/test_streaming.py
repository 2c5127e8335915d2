from marlstone.collection import Collection
from marlstone.streaming.commands import CommandLog

SCHEMA = "seq long, op string, doc_type string, doc_id string, body string"


def _log(spark, tmp_path):
    return CommandLog(spark, Collection(spark, "c", f"file://{tmp_path}/c"), f"file://{tmp_path}/log", per_trigger=1)


def test_the_last_command_of_a_key_wins(spark, tmp_path):
    log = _log(spark, tmp_path)
    put = lambda seq, key, n: (seq, "put", "t", key, f'{{"n_num": {n}}}')
    log.append(spark.createDataFrame([put(0, "a", 1), put(1, "b", 2), put(2, "a", 3)], SCHEMA).coalesce(1))
    log.append(spark.createDataFrame([(3, "delete", "t", "b", "{}"), put(4, "c", 4), (5, "put", "t", "d", "bad")], SCHEMA).coalesce(1))
    assert log.reached(5) == {"reached": False}
    log.start().awaitTermination()
    state = log.reached(5)
    assert state["reached"] and state["total_errors"] == 1
    rows = {r["doc_id"]: r["f_nn"] for r in log.collection.source().table.collect()}
    assert rows == {"a": [3.0], "c": [4.0]}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    log = _log(spark, tmp_path)
    commands = spark.createDataFrame([(0, "put", "t", "a", '{"n_num": 1}')], SCHEMA)
    log.collection.apply(commands, 0)
    before = log.collection.store.state()
    log.collection.apply(commands, 0)
    assert log.collection.store.state() == before


def test_a_restarted_stream_goes_on(spark, tmp_path):
    log = _log(spark, tmp_path)
    for seq in (0, 1):
        log.append(spark.createDataFrame([(seq, "put", "t", str(seq), "{}")], SCHEMA))
        log.start().awaitTermination()
    assert log.collection.info()["doc_count"] == 2 and log.reached(1)["reached"]


def test_late_commands_of_later_batches_do_not_win(spark, tmp_path):
    log = _log(spark, tmp_path)
    put = lambda seq, key, n: (seq, "put", "t", key, f'{{"n_num": {n}}}')
    log.append(spark.createDataFrame([put(10, "a", 10), (11, "delete", "t", "b", "{}"), put(12, "z", 0)], SCHEMA).coalesce(1))
    log.start().awaitTermination()
    log.append(spark.createDataFrame([put(3, "a", 3), put(4, "b", 4), put(5, "c", 5)], SCHEMA).coalesce(1))
    log.start().awaitTermination()
    assert {r["doc_id"]: r["f_nn"] for r in log.collection.source().table.collect()} == {"a": [10.0], "z": [0.0], "c": [5.0]}
    assert log.collection.store.state()["seq"] == 12


def test_a_batch_of_one_file_is_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    log = _log(spark, tmp_path)
    log.append(spark.createDataFrame([(i, "put", "t", str(i % 50), f'{{"n_num": {i}}}') for i in range(400)], SCHEMA).coalesce(1))
    apply, parts = log.collection.apply, []

    def seen(commands, number=-1):
        parts.append(sum(n > 0 for n in commands.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()))
        apply(commands, number)

    monkeypatch.setattr(log.collection, "apply", seen)
    log.start().awaitTermination()
    assert len(parts) == 1 and parts[0] >= spark.sparkContext.defaultParallelism
    assert {r["doc_id"]: r["f_nn"] for r in log.collection.source().table.collect()} == {str(k): [350.0 + k] for k in range(50)}


def test_barriers_stand_in_the_log(spark, tmp_path):
    log = _log(spark, tmp_path)
    rows = [
        (0, "put", "t", "a", '{"w": "1"}'),
        (1, "schema", "t", None, '{"fields": {"v": {"type": "double", "slot": "v"}}}'),
        (2, "put", "t", "b", '{"v": 2}'),
        (3, "taxonomy", None, "tax", '{"child": ["parent"]}'),
        (4, "checkpoint", None, "here", None),
        (5, "pipe", None, "bad", "[]"),
        (6, "put", "t", "c", '{"v": "no number"}'),
        (7, "nonsense", None, None, None),
        (8, "checkpoint", None, "there", None),
    ]
    log.append(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    log.start().awaitTermination()
    c = log.collection
    assert c.info()["doc_count"] == 3 and c.taxonomy("tax").parents["child"] == {"parent"}
    assert c.schema("t").fields["v"].type == "double" and c.store.state()["seq"] == 8
    here, there = c.checkpoints.state("here"), c.checkpoints.state("there")
    assert here["reached"] and there["reached"] and there["total_errors"] >= 2
    assert log.status() == {"waiting": 0, "space": "HAS_SPACE"}


def test_a_full_log_refuses_more(spark, tmp_path):
    import pytest

    from marlstone.errors import QueueFullError

    log = CommandLog(spark, Collection(spark, "c", f"file://{tmp_path}/c"), f"file://{tmp_path}/log", low=2, full=3)
    one = lambda seq: spark.createDataFrame([(seq, "put", "t", str(seq), "{}")], SCHEMA)
    spaces = [log.status()["space"]]
    for seq in range(3):
        log.append(one(seq), unless_full=True)
        spaces.append(log.status()["space"])
    assert spaces == ["HAS_SPACE", "HAS_SPACE", "LOW_SPACE", "FULL"]
    with pytest.raises(QueueFullError):
        log.append(one(4), unless_full=True)
    log.start().awaitTermination()
    assert log.status() == {"waiting": 0, "space": "HAS_SPACE"}
