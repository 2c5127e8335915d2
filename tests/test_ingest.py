import json

import pytest

from marlstone.plans.schema import Schema
from marlstone.sources import ingest


def index(spark, fields: dict, *docs, doc_type: str = "default"):
    df = spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "body string")
    found = ingest.resolved(df)
    names = ingest.field_names(found).get(doc_type, [])
    rows = ingest.indexed(found, doc_type, Schema.of({"fields": fields}), names).collect()
    return [r.asDict(recursive=True) for r in rows]


def terms(row, group):
    return {t["term"]: (t["wdf"], t["positions"]) for t in row[f"t_{group}"]}


URL = {"type": "exact", "group": "url", "max_length": 120, "too_long_action": "hash", "store_field": "url"}


def test_exact_and_id(spark):
    (row,) = index(spark, {"id": {"type": "id"}, "url": URL}, {"id": "abcd", "url": "http://example.com/"})
    assert row["doc_id"] == "abcd" and list(terms(row, "url")) == ["http://example.com/"] and row["data"] == {"url": '["http://example.com/"]'}
    (row,) = index(spark, {"nostore": {"type": "exact", "group": "ns"}}, {"nostore": "abcd"})
    assert list(terms(row, "ns")) == ["abcd"] and row["data"] == {} and row["doc_id"] is None


LONG = "0123456789012345678901234567890"


@pytest.mark.parametrize(("action", "expected", "errors"), [("hash", ["012345678901234567890123Y]^J/ "], 0), ("truncate", [LONG[:30]], 0), ("error", [], 1)])
def test_too_long(spark, action, expected, errors):
    config = {"type": "exact", "group": "g", "max_length": 30, "too_long_action": action, "store_field": "v"}
    row, short = index(spark, {"v": config}, {"v": LONG}, {"v": LONG[:30]})
    assert list(terms(row, "g")) == expected and len(row["errors"]) == errors and json.loads(row["data"]["v"]) == [LONG]
    assert list(terms(short, "g")) == [LONG[:30]] and not short["errors"]


def test_whole_numbers(spark):
    config = {"n": {"type": "exact", "group": "n"}}
    for value, term in ((0, "0"), (1, "1"), (2**32 - 1, "4294967295"), (2**63 - 1, str(2**63 - 1)), (2**63, str(2**63)), (2**64 - 1, str(2**64 - 1)), (-1, None), (2**64, None), (1.5, None), (True, "1")):
        (row,) = index(spark, config, {"n": value})
        assert list(terms(row, "n")) == ([] if term is None else [term]), value
        assert len(row["errors"]) == (term is None), value


def test_numbers_times_and_dates(spark):
    fields = {"n": {"type": "double", "slot": 7, "store_field": "n"}, "t": {"type": "timestamp", "slot": 0, "store_field": "t"}, "d": {"type": "date", "slot": 1, "store_field": "date2"}}
    row, bad = index(spark, fields, {"n": 0, "t": 1283400000, "d": "2010-06-08"}, {"n": "x", "t": [], "d": ["2010-13-01", "-5-2-31"]})
    assert row["f_7"] == [0.0] and row["f_0"] == [1283400000.0] and row["f_1"] == [{"year": 2010.0, "month": 6, "day": 8}]
    assert row["data"] == {"n": "[0]", "t": "[1283400000]", "date2": '["2010-06-08"]'} and not row["errors"]
    assert {e["field"] for e in bad["errors"]} == {"n", "d"} and bad["f_1"] == [{"year": -5.0, "month": 2, "day": 31}]


def test_slots_are_sorted_sets(spark):
    (row,) = index(spark, {"n": {"type": "double", "slot": "s"}, "m": {"type": "double", "slot": "s"}}, {"n": [3, 1, 3], "m": 2})
    assert row["f_s"] == [1.0, 2.0, 3.0]


def test_text_with_stems(spark):
    (row,) = index(spark, {"text": {"type": "text", "group": "t", "processor": "stem_en"}}, {"text": "Some english words"})
    assert terms(row, "t") == {"some": (1, [1]), "english": (1, [2]), "words": (1, [3])} and row["z_t"] == ["english", "some", "word"]


def test_text_values_share_positions_and_errors_pass_by(spark):
    (row,) = index(spark, {"text": {"type": "text", "group": "t", "slot": "s"}}, {"text": ["a b", 5, "c a"]})
    assert terms(row, "t") == {"a": (2, [1, 2]), "b": (1, [2]), "c": (1, [1])} and len(row["errors"]) == 1 and row["f_s"] == ["a b"]


def test_cjk(spark):
    (row,) = index(spark, {"text": {"type": "text", "group": "t", "processor": "cjk"}}, {"text": "Some english text"})
    assert terms(row, "t") == {"some": (1, [1]), "english": (1, [2]), "text": (1, [3])}


def test_places(spark):
    rows = index(spark, {"p": {"type": "lonlat", "slot": "p"}}, {"p": [10, 20]}, {"p": {"lon": -10, "lat": 5}}, {"p": [[1, 2], {"lon": 3, "lat": 4}]}, {"p": {"lon": 1}}, {"p": [5, 91]})
    assert [[(p["lon"], p["lat"]) for p in r["f_p"] or []] for r in rows] == [[(10, 20)], [(350, 5)], [(1, 2), (3, 4)], [], []]
    assert [len(r["errors"]) for r in rows] == [0, 0, 0, 1, 1]


def test_presence(spark):
    fields = {"_meta": {"type": "meta", "group": "#"}, "foo": {"type": "text", "group": "t"}, "bar": {"type": "double", "slot": "b"}, "no": {"type": "ignore"}, "keep": {"type": "stored", "store_field": "keep"}}
    rows = index(spark, fields, {"foo": "hello", "no": 1}, {"foo": None, "bar": "x"}, {"foo": ["", "a"], "keep": {"a": [1]}}, {"foo": []})
    assert [r["meta"] for r in rows] == [
        {"F": ["foo"], "N": ["foo"], "M": [], "E": []},
        {"F": ["bar", "foo"], "N": ["bar"], "M": ["foo"], "E": ["bar"]},
        {"F": ["foo", "keep"], "N": ["foo", "keep"], "M": ["foo"], "E": []},
        {"F": ["foo"], "N": [], "M": [], "E": []},
    ]
    assert rows[2]["data"] == {"keep": '[{"a":[1]}]'}


def test_type_and_id_problems(spark):
    docs = [
        ('{"id": 1, "type": "t"}', None, None), ('{"id": "a", "type": "t"}', "t", "a"), ('{"type": ["t", "u"]}', None, None), ('{"id": [1, 2]}', None, None), ('{"type": "t"}', "u", None),
        ('{"id": "a"}', "t", "b"), ("[1]", None, None), ("nonsense", None, None), ('{"id": -1}', None, None), ('{"type": "a/b"}', None, None), ('{"a": 1}', None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "i int, body string, doc_type string, doc_id string")
    rows = ingest.resolved(df).orderBy("i").collect()
    good = {r["i"]: (r["doc_type"], r["doc_id"]) for r in rows if r["_problem"] is None}
    assert good == {0: ("t", "1"), 1: ("t", "a"), 10: ("default", None)}
    assert ingest.problems(ingest.resolved(df)).count() == len(docs) - 3


def test_no_documents(spark):
    empty = ingest.resolved(spark.createDataFrame([], "body string"))
    assert ingest.field_names(empty) == {} and empty.count() == 0
