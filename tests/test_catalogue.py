import pytest

from marlstone.plans import catalogue
from tests.tables import duck_rows, rows_of, same_types

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    assert rows_of(df) == duck_rows(duck, SQL[name])
    assert same_types(df, duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_flagship(spark, data):
    rows = catalogue.flagship(spark, data).collect()
    assert 0 < len(rows) <= 10
    assert [r["o_totalprice"] for r in rows] == sorted((r["o_totalprice"] for r in rows), reverse=True)


def test_filters_and_columns_reach_the_scan(spark, data):
    from marlstone.operators.search import Search

    request = {"query": {"and": [catalogue._URGENT, catalogue._MIDDLE]}, "display": ["o_orderkey"]}
    plan = Search(catalogue._orders(spark, data), request).items()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan
    assert "TakeOrderedAndProject" in plan
    schema = plan[plan.index("ReadSchema") :]
    assert "o_custkey" not in schema and "o_orderdate" not in schema


def test_stemmed_query_is_by_stems(spark, data):
    from marlstone.functions import text

    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'").select("doc_id", "text").collect()
    want = {text.stem_english("ands"), text.stem_english("others")}
    expected = {r["doc_id"] for r in docs if want & {text.stem_english(w) for w in text.words_of(r["text"], text.ASCII_WORD)}}
    assert {r["doc_id"] for r in QUERIES["text_stemmed"](spark, data).collect()} == expected


def test_cooccurrences_take_items_of_any_id(spark, tmp_path):
    import duckdb

    rows = [(i, f"alpha w{i % 7} w{i % 5} beta") for i in range(380, 460)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    assert rows_of(QUERIES["info_cooccur_termfreq"](spark, str(tmp_path))) == duck_rows(con, SQL["info_cooccur_termfreq"])
