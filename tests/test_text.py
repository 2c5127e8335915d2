from pyspark.sql import functions as F

from marlstone.functions import text


def test_english_stems():
    pairs = {
        "words": "word", "english": "english", "consistency": "consist", "consigned": "consign", "knightly": "knight", "happy": "happi", "generously": "generous",
        "skies": "sky", "hopping": "hop", "hoping": "hope", "relational": "relat", "national": "nation", "dying": "die", "ties": "tie", "cries": "cri", "by": "by", "say": "say",
        "luxuriated": "luxuri", "kneeling": "kneel", "inning": "inning", "flies": "fli",
    }
    assert {w: text.stem_english(w) for w in pairs} == pairs


def test_words_and_suffixes():
    assert text.words_of("Don't AT&T C++ 3.14 x-ray") == ["don't", "at&t", "c++", "3.14", "x", "ray"]
    assert text.words_of("") == []


def test_words_column_agrees_with_driver(spark):
    samples = ["Some english words", "Don't AT&T C++ 3.14", "Привет, Добро!", "", None, "naïve café x"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select(text.words(F.col("t")).alias("w"))
    assert [r["w"] for r in df.collect()] == [text.words_of(s) if s else [] for s in samples]


def test_cjk_terms():
    assert text.cjk_words("Some english text") == [("some", 1), ("english", 2), ("text", 3)]
    assert text.cjk_words("中文") == [("中", 1), ("中文", 1), ("文", 2)]
    assert text.cjk_words("") == []


def test_phrase_and_near(spark):
    rows = [("a b c d e",), ("b a c",), ("a x b",), ("",)]
    df = spark.createDataFrame(rows, "t string").withColumn("w", text.words(F.col("t")))
    got = df.select(
        text.has_phrase(F.col("w"), ["a", "b"]).alias("p"), text.has_near(F.col("w"), ["a", "b"], 2).alias("n2"), text.has_near(F.col("w"), ["a", "b"], 3).alias("n3"),
        text.has_phrase(F.col("w"), []).alias("none"),
    ).collect()
    assert [(r["p"], r["n2"], r["n3"]) for r in got] == [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]
    assert not any(r["none"] for r in got)


def test_slot_numbers():
    assert [text.slot_number(x) for x in ("1", "alternate string", "string alternate", "hello world")] == [268435538, 2470924216, 3524491384, 2061196861]
    assert text.slot_number("") is None


def test_hashed_terms(spark):
    from marlstone.operators.query import hashed

    long_ = "0123456789012345678901234567890"
    assert hashed(long_, 30) == "012345678901234567890123Y]^J/ "
    values = [long_, "short", "é" * 40, None]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in df.select(text.hashed_term(F.col("t"), 30)).collect()]
    assert got == [None if v is None else hashed(v, 30) for v in values]
    assert [r[0] for r in df.select(text.cut_term(F.col("t"), 30)).collect()][0] == long_[:30]


def test_hexed_and_truth():
    assert text.hexed("a\tb\\") == "a\\x09b\\x5c"
    assert [text.truth(x) for x in ("1", "True", "yes", "on", "0", "", None)] == [True] * 4 + [False] * 3


def test_word_rules(spark):
    """Separators of words and of numbers, characters that count as none, suffixes."""
    cases = {
        "l\u2019eau Q\u201bx": ["l'eau", "q'x"], "a\u200bb c\ufeffd e\u2060f": ["ab", "cd", "ef"], "1\u20442 3\u05894 5\ufe106 7;8 9\u037e1": ["1\u20442", "3\u05894", "5\ufe106", "7;8", "9\u037e1"],
        "1'000 a1.5b 2.b": ["1", "000", "a1.5b", "2", "b"], "c++ c++++ fish+chips fish++chips f# x#": ["c++", "c", "fish", "chips", "fish", "chips", "f#", "x#"], "wait\u2026 3\u20264": ["wait", "3", "4"], "a\u00b7b a.b": ["a\u00b7b", "a", "b"],
    }
    assert {s: text.words_of(s) for s in cases} == cases
    df = spark.createDataFrame([(s,) for s in cases], "t string").select("t", text.words(F.col("t")).alias("w"))
    assert {r["t"]: r["w"] for r in df.collect()} == cases
