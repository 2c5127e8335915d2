import pytest
from pyspark.sql import functions as F

from marlstone.errors import InvalidValueError
from marlstone.operators.categorise import Categoriser, distance, profile, trained


def test_profiles():
    assert profile("hi", 5, 9) == ["|", "h", "hi", "hi|", "i", "i|", "|h", "|hi", "|hi|"]
    assert profile("abbbaa", 2, 100) == ["a", "b", "bb", "|", "aa", "ab", "a|", "ba", "|a"]


def test_distances():
    p = lambda s: profile(s, 5, 10)
    assert [distance(p("Hello world"), p(x), 10, 10) for x in ("Hello everyone", "Goodbye", "hello world")] == [36, 76, 0]


def _model(english, russian, *options):
    m = Categoriser({}, *options)
    m.add("english", english)
    m.add("russian", russian)
    return m


def test_answers_and_ambiguity():
    m = _model("hello welcome", "Привет Добро", 1.05, 4, 10, 2)
    assert m.categorise("hello") == ["english"] and m.categorise("Привет") == ["russian"]
    m.add("english2", "hello welcome")
    m.add("english3", "hello welcome")
    assert m.categorise("hello") == []
    m = _model("hello world", "Привет Добро", 1.03, 4, 10, 1)
    assert m.categorise("Hello") == ["english"] and m.categorise("café") == []
    assert Categoriser().categorise("hello") == []


def test_json_and_limits():
    m = _model("hello", "Привет")
    assert Categoriser.of(m.to_json()) == m
    for bad in ({"max_ngram_length": 101}, {"max_ngrams": 65537}):
        with pytest.raises(InvalidValueError):
            Categoriser(**bad)


def test_trained_on_tables(spark):
    df = spark.createDataFrame([("english", "hello world"), ("english", "welcome home"), ("russian", "Привет мир")], "label string, t string")
    m = trained(df, "label", "t")
    assert m.profiles["english"] == profile("hello world welcome home")
    rows = spark.createDataFrame([("hello",), ("мир",), (None,)], "t string").select(m.column(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [["english"], ["russian"], None]
