import pytest

from marlstone.collection import Collection, Engine
from marlstone.errors import InvalidValueError, UnknownNameError
from marlstone.operators.categorise import Categoriser


@pytest.fixture
def coll(spark, tmp_path):
    return Collection(spark, "test", f"file://{tmp_path}/c")


BIG = 2**64 - 1


def test_ids_and_counts(coll):
    coll.put_schema("testtype", {"fields": {"id": {"type": "id"}, "type": {"type": "exact", "group": "type", "max_length": 30, "slot": "type"}, "intid": {"type": "exact", "group": "intid", "max_length": 30, "store_field": "intid"}}})
    coll.put({"id": 32, "intid": BIG, "type": "testtype"})
    coll.put({"id": BIG, "intid": 31, "type": "testtype"})
    assert coll.info() == {"doc_count": 0}
    coll.commit()
    ask = lambda name, value, t="testtype": [i["intid"] for i in coll.search({"query": {"field": [name, "is", value]}, "display": ["intid"]}, t).to_dict()["items"]]
    assert ask("id", ["31"]) == [] and ask("id", ["32"]) == [[BIG]] and ask("id", [32]) == [[BIG]] and ask("id", [BIG]) == [[31]]
    assert len(ask("intid", [str(BIG)])) == 1 and ask("intid", [str(BIG - 1)]) == []
    out = coll.search({"query": {"field": ["text", "text", "x"]}, "info": [{"facet_count": {"field": "type"}}]}, "type").to_dict()
    assert out["matches_estimated"] == 0 and out["total_docs"] == 0
    assert out["info"] == [{"type": "facet_count", "fieldname": "type", "docs_seen": 0, "values_seen": 0, "counts": []}]
    assert set(out) == {"check_at_least", "from", "info", "items", "matches_estimated", "matches_lower_bound", "matches_upper_bound", "size_requested", "total_docs"}


def test_upserts_deletes_and_versions(coll, spark):
    for i in range(3):
        coll.put({"id": str(i), "a_tag": f"v{i}", "n_num": i})
    coll.put({"id": "1", "a_tag": "newer", "n_num": 5})
    coll.put({"a_tag": "no id"})
    coll.commit()
    assert coll.info()["doc_count"] == 4 and coll.get("default", 1)["data"] == {"a_tag": ["newer"], "id": ["1"], "n_num": [5]}
    coll.delete("default", "0")
    coll.delete("default", "none")
    coll.put({"id": "2", "b_text": "now with words"})
    coll.commit()
    assert coll.get("default", "0") is None and coll.info()["doc_count"] == 3
    assert coll.get("default", "2")["terms"]["tb\twords"] == {"wdf": 1, "positions": [3]}
    again = Collection(spark, "test", coll.store.path)
    assert again.config() == coll.config() and again.info() == coll.info()
    assert again.search({"query": {"field": ["b_text", "text", {"text": "word", "op": "and"}]}}).count() == 1
    assert again.search({"query": {"field": ["b_text", "text", "with words"]}}).count() == 1
    assert again.search({"query": {"field": ["n_num", "range", [4, 6]]}}).count() == 1
    again.drop()
    assert Collection(spark, "test", coll.store.path).info()["doc_count"] == 0


def test_configuration(coll):
    with pytest.raises(InvalidValueError):
        coll.load_config({})
    before = coll.default_type
    coll.load_config({"format": 3})
    assert coll.default_type == before
    coll.put_schema("t", {"fields": {"a": {"type": "double", "slot": "a"}}})
    coll.put_schema("t", {"fields": {"a": {"type": "double", "slot": "a"}, "b": {"type": "double", "slot": "b"}}})
    with pytest.raises(InvalidValueError):
        coll.put_schema("t", {"fields": {"a": {"type": "date", "slot": "a"}}})
    for get in (coll.schema, coll.pipe, coll.categoriser, coll.taxonomy):
        with pytest.raises(UnknownNameError):
            get("none")


def test_pipes_and_categorisers(coll, spark):
    coll.put_pipe("default", {"mappings": [{"map": [{"from": ["foo"], "to": "bar"}]}]})
    coll.pipe_all(spark.createDataFrame([('{"id": "1", "foo": "Hello world"}',)], "body string"), "default")
    assert coll.info()["doc_count"] == 0
    coll.commit()
    assert coll.info()["doc_count"] == 1 and coll.get("default", "1")["data"] == {"bar": ["Hello world"], "id": ["1"]}
    model = Categoriser({}, 1.03, 4, 10, 1)
    model.add("english", "hello world")
    model.add("russian", "Привет Добро")
    coll.put_categoriser("lang", model)
    coll.put_pipe("cat", {"mappings": [{"map": [{"categoriser": "lang", "from": ["text"], "to": "lang"}, {"from": ["text"], "to": "text"}]}]})
    coll.pipe_all(spark.createDataFrame([('{"id": "2", "text": "Hello world"}',)], "body string"), "cat")
    coll.commit()
    assert coll.get("default", "2")["data"] == {"id": ["2"], "lang": ["english"], "text": ["Hello world"]} and coll.categorise("lang", "Hello") == ["english"]


def test_imports_of_a_document_store(coll, spark, tmp_path):
    from marlstone.sources import connectors

    (tmp_path / "e.jsonl").write_text('{"_id": {"$oid": "4f"}, "n": {"$numberLong": "5"}}\n{"r": {"$code": "x"}}\nnonsense\n')
    coll.put_pipe("default", {"mappings": [{"map": [{"from": "_id", "to": "id"}, {"from": "n", "to": "n_num"}]}]})
    name = coll.import_all(connectors.store_export(spark, str(tmp_path / "e.jsonl")))
    assert coll.checkpoints.state(name)["total_errors"] == 2 and coll.get("default", "4f")["data"] == {"id": ["4f"], "n_num": [5]}


def test_taxonomy_edits_show_in_queries(coll):
    coll.put_schema("default", {"fields": {"id": {"type": "id"}, "cat": {"type": "cat", "group": "cat", "taxonomy": "Foo"}}})
    t = coll.put_taxonomy("Foo", {"child": ["parent"]})
    coll.put({"id": "1", "cat": ["world", "child"]})
    coll.commit()
    below = lambda c: coll.search({"query": {"field": ["cat", "is_descendant", c]}}).count()
    either = lambda c: coll.search({"query": {"field": ["cat", "is_or_is_descendant", c]}}).count()
    assert (below("parent"), below("child"), either("child"), below("grand")) == (1, 0, 1, 0)
    t.add_parent("parent", "grand")
    assert below("grand") == 1
    t.remove("child")
    assert (below("grand"), below("parent"), either("child")) == (0, 0, 1)
    t.add_parent("child", "parent")
    assert (below("grand"), below("parent")) == (1, 1) and coll.taxonomy_groups("Foo") == ["cat"]
    coll.delete_taxonomy("Foo")
    assert below("parent") == 0


def test_presence_queries(coll):
    coll.put({"id": "1", "foo": "hello"})
    coll.put({"id": "2", "foo_text": None, "foo_num": "x"})
    coll.commit()
    ask = lambda *m: sorted(r["doc_id"] for r in coll.search({"query": {"meta": list(m)}}).matches.collect())
    assert ask("exists", "foo") == ["1"] and ask("empty", "foo_text") == ["2"] and ask("error", None) == ["2"] and ask("nonempty", ["foo", "foo_num"]) == ["1", "2"]
    assert ask("exists", None) == ["1", "2"]


def test_checkpoints(coll):
    coll.put('{"id": [1, 2]}')
    coll.put("nonsense")
    coll.put({"id": "1", "a_num": "x"})
    first = coll.checkpoint(commit=False)
    assert coll.checkpoints.state(first) == {"reached": False} and coll.checkpoints.state("none") is None
    coll.put({"id": "2"})
    second = coll.checkpoint()
    state = coll.checkpoints.state(first)
    assert state["reached"] and state["total_errors"] == 3 and {e["msg"] for e in state["errors"]} == {"several ids", "not a JSON object", "a_num: not a number"}
    assert coll.checkpoints.state(second) == {"reached": True, "total_errors": 0, "errors": []} and coll.checkpoints.ids() == sorted([first, second])
    coll.checkpoints.expire()
    assert len(coll.checkpoints.ids()) == 2
    coll.checkpoints.expire(0)
    assert coll.checkpoints.ids() == []


def test_error_logs_are_capped():
    from marlstone.streaming.checkpoints import ErrorLog

    log = ErrorLog(2)
    for i in range(3):
        log.append(f"m{i}", "t", "d")
    assert log.to_json() == {"total_errors": 3, "errors": [{"msg": "m0", "doc_type": "t", "doc_id": "d"}, {"msg": "m1", "doc_type": "t", "doc_id": "d"}]}


def test_direct_puts_raise_at_once(coll):
    for bad in ({"id": [1, 2]}, {"id": 1, "a_num": "x"}, "nonsense"):
        with pytest.raises(InvalidValueError):
            coll.put(bad, raise_on_error=True)
    coll.put({"id": 1, "a_num": 2}, raise_on_error=True)
    coll.commit()
    assert coll.get_fields("default", 1) == {"a_num": [2], "id": [1]} and coll.get_fields("default", 1, ["a_num", "none"]) == {"a_num": [2]}
    assert coll.get_fields("default", 2) is None and coll.schema("default").field_list({}) == ["_meta", "a_num", "id"] and coll.schema("default").field_list({"display": ["x"]}) == ["x"]


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    assert engine.collections() == []
    a = engine.collection("a")
    a.put({"id": 1})
    a.commit()
    assert engine.collections() == ["a"] and engine.status()["collections"] == 1
    with pytest.raises(InvalidValueError):
        engine.collection("a/b")
