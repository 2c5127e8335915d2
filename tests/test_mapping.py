import json

import pytest
from pyspark.sql import functions as F

from marlstone.errors import InvalidValueError, UnknownNameError
from marlstone.operators.categorise import Categoriser
from marlstone.operators.mapping import Mapping, Pipe, condition_column, evaluate, loads, send, walk

DOCS = [[], {}, ["aunt"], ["aunt", "uncle"], {"name": "fred"}, {"names": ["fred", "bloggs"]}, {"names": {"first": "fred", "second": "bloggs"}}]
CONDITIONS = [
    ({"exists": []}, "TTTTTTT"), ({"exists": [0]}, "FFTTFFF"), ({"exists": [1]}, "FFFTFFF"), ({"exists": ["name"]}, "FFFFTFF"), ({"exists": ["names", 1]}, "FFFFFTF"),
    ({"exists": ["names", "first"]}, "FFFFFFT"), ({"equals": []}, "TTTTTTT"), ({"equals": [{"literal": 1}]}, "TTTTTTT"), ({"equals": [{"literal": 1}, {"literal": 1}]}, "TTTTTTT"),
    ({"equals": [{"literal": False}, {"literal": True}]}, "FFFFFFF"), ({"equals": [{"get": ["name"]}, {"literal": "fred"}]}, "FFFFTFF"),
]


@pytest.mark.parametrize(("clause", "expected"), CONDITIONS)
def test_conditions(spark, clause, expected):
    assert "".join("TF"[not evaluate(clause, d)] for d in DOCS) == expected
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "i int, b string")
    rows = df.select("i", condition_column(clause, F.parse_json("b")).alias("c")).orderBy("i").collect()
    assert "".join("TF"[not r["c"]] for r in rows) == expected


NAMES = [{}, {"name": "arthur"}, {"name": ["arthur", "dent"]}, {"name": {"first": "arthur", "second": "dent"}}]
BOTH = {"first": "arthur", "second": "dent"}


@pytest.mark.parametrize(
    ("config", "expected"),
    [
        ({"when": {"exists": ["name"]}}, [None, {"name": ["arthur"]}, {"name": ["arthur", "dent"]}, {"name": [BOTH]}]),
        ({"when": {"exists": ["name"]}, "map": [{"from": "name", "to": "nom"}]}, [None, {"nom": ["arthur"]}, {"nom": ["arthur", "dent"]}, {"nom": [BOTH]}]),
        (
            {"map": [{"from": "name", "to": "name1"}, {"from": ["name"], "to": "name2"}, {"from": ["name", "first"], "to": "name3"}]},
            [{}, {"name1": ["arthur"], "name2": ["arthur"]}, {"name1": ["arthur", "dent"], "name2": ["arthur", "dent"]}, {"name1": [BOTH], "name2": [BOTH], "name3": ["arthur"]}],
        ),
        ({"map": [{"from": ["name", 0], "to": "name1"}]}, [{}, {"name": ["arthur"]}, {"name1": ["arthur"]}, {"name": [BOTH]}]),
    ],
)
def test_mappings(config, expected):
    m = Mapping.of(config)
    assert [m.apply(d) for d in NAMES] == expected
    assert Mapping.of(m.to_json()) == m


def test_walker():
    assert [(e, p) for e, p, _ in walk({"a": [1, {}], "b": 2})] == [
        ("start", ()), ("start", ("a",)), ("leaf", ("a", 0)), ("leaf", ("a", 1)), ("end", ("a",)), ("leaf", ("b",)), ("end", ()),
    ]


def test_pipes_chain_and_fan_out(spark):
    config = loads("""{ // two mappings
      "mappings": [{"when": {"exists": ["a"]}, "map": [{"from": ["a"], "to": "x"}]}, {"map": [{"from": "b", "to": "y"}]}],
      "apply_all": true, "target": "next" /* then */ }""")
    pipes = {"first": Pipe.of(config), "next": Pipe.of({"mappings": [{"map": [{"from": "x", "to": "z"}]}]})}
    assert Pipe.of(pipes["first"].to_json()) == pipes["first"]
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"b": 3}',)], "body string")
    got = sorted(json.dumps(json.loads(r["body"]), sort_keys=True) for r in send(df, "first", pipes).collect())
    assert got == ['{"a": [1], "y": [2]}', '{"b": [2], "z": [1]}', '{"y": [3]}']
    with pytest.raises(UnknownNameError):
        send(df, "none", pipes)
    with pytest.raises(InvalidValueError):
        send(df, "loop", {"loop": Pipe.of({"mappings": [], "target": "loop"})})


def test_mapped_categoriser():
    c = Categoriser({}, 1.05, 4, 10, 2)
    c.add("english", "hello world")
    c.add("russian", "Привет Добро")
    rule = {"categoriser": "lang", "from": ["text"], "to": "lang"}
    both = Mapping.of({"map": [rule, {"from": ["text"], "to": "text"}]})
    assert both.apply({"id": "2", "text": "Hello world"}, {"lang": c}) == {"lang": ["english"], "id": ["2"], "text": ["Hello world"]}
    m = Mapping.of({"map": [rule]})
    assert m.apply({"text": ["Hello", 1, "world"]}, {"lang": c}) == {"lang": ["english"]}
    assert m.apply({"text": 5}, {"lang": c}) == {"lang": [""]} and m.apply({"text": []}, {"lang": c}) == {"lang": [""]}
    with pytest.raises(UnknownNameError):
        m.apply({"text": "x"}, {})


def test_values_come_in_the_order_of_the_document():
    m = Mapping.of({"map": [{"from": ["z"], "to": "a"}, {"from": ["b", 1], "to": "a"}, {"from": ["b", 0], "to": "a"}, {"from": [], "to": "all"}]})
    assert m.apply({"z": [5, 6], "b": [1, 2], "a": 0}) == {"a": [0, 1, 2, 5, 6]}
    assert m.apply({"z": [], "a": 0}) == {"a": []}
    with pytest.raises(InvalidValueError):
        m.apply([1])


def test_a_body_that_is_no_object_passes_a_pipe_unchanged(spark):
    df = spark.createDataFrame([("[1]",), ("nonsense",), (None,)], "body string")
    assert sorted(r["body"] for r in send(df, "p", {"p": Pipe.of({"mappings": [{}]})}).collect()) == ["[1]", "nonsense"]
