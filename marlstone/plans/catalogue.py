"""The engine's queries over the standard tables, each with the SQL that DuckDB runs for comparison.

Every query is a search, a statistic or a transformation as a user would write it; results are whole
tables except where a page or a top list is what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection, together, typed
from ..functions import geo, text
from ..operators import categorise
from ..operators.mapping import Pipe, condition_column, send
from ..operators.query import normal_column
from ..operators.search import Search, Source
from ..operators.taxonomy import Taxonomy, closure
from ..sources import connectors, ingest
from ..sources.store import latest, scratch, upserted
from ..streaming.commands import CommandLog
from .schema import Field, default_schema

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import surface  # noqa: F401  registers its own

    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from . import surface  # noqa: F401

    return {name: sql for name, (_, sql) in _FOUND.items() if sql}


# ---------------------------------------------------------------- tables as sources


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exact(group: str, **more) -> dict:
    return {"type": "exact", "group": group, **more}


def _orders(spark, sf_dir, **changes) -> Source:
    fields = {
        "o_orderkey": {"type": "id"},
        "o_orderstatus": _exact("status"),
        "o_orderpriority": _exact("priority"),
        "o_totalprice": {"type": "double"},
        "o_orderdate": {"type": "date"},
    }
    return typed(_table(spark, sf_dir, "orders"), fields | changes, id_column="o_orderkey")


def _lines(spark, sf_dir) -> Source:
    fields = {"l_returnflag": _exact("flag"), "l_quantity": {"type": "double"}, "l_discount": {"type": "double"}, "l_extendedprice": {"type": "double"}, "l_shipdate": {"type": "date"}}
    source = typed(_table(spark, sf_dir, "lineitem"), fields)
    return replace(source, keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


def _events(spark, sf_dir) -> Source:
    fields = {"event_id": {"type": "id"}, "event_type": _exact("kind"), "ts": {"type": "timestamp"}, "value": {"type": "double"}}
    return typed(_table(spark, sf_dir, "events"), fields, id_column="event_id")


def _customers(spark, sf_dir) -> Source:
    fields = {"c_custkey": {"type": "id"}, "c_mktsegment": _exact("segment"), "c_acctbal": {"type": "double"}}
    return typed(_table(spark, sf_dir, "customer"), fields, id_column="c_custkey")


def _parts(spark, sf_dir) -> Source:
    fields = {"p_partkey": {"type": "id"}, "p_brand": _exact("brand"), "p_type": _exact("type"), "p_size": {"type": "double"}, "p_name": {"type": "text", "group": "name"}}
    return typed(_table(spark, sf_dir, "part"), fields, id_column="p_partkey", pattern=text.ASCII_WORD)


def _documents(spark, sf_dir, processor: str = "") -> Source:
    fields = {"doc_id": {"type": "id"}, "lang": _exact("lang"), "source": _exact("source"), "text": {"type": "text", "group": "t", "processor": processor}}
    return typed(_table(spark, sf_dir, "documents"), fields, id_column="doc_id", pattern=text.ASCII_WORD)


def _rows(source: Source, query: dict, *columns: str, score: bool = False) -> DataFrame:
    """All matches of a query."""
    found = Search(source, {"query": query}).matches
    return found.select(*columns, *([F.round("_score", 6).alias("score")] if score else []))


def _page(source: Source, request: dict, *columns: str, score: bool = False) -> DataFrame:
    found = Search(source, request).page()
    return found.select(*columns, *([F.round("_score", 6).alias("score")] if score else []))


_URGENT = {"field": ["o_orderpriority", "is", ["1-URGENT"]]}
_MIDDLE = {"field": ["o_totalprice", "range", [100000.0, 200000.0]]}
_UPPER_RANGE = {"field": ["o_totalprice", "range", [150000.0, 300000.0]]}
_DONE = {"field": ["o_orderstatus", "is", ["F"]]}
_M, _R, _U, _D = "o_totalprice BETWEEN 100000 AND 200000", "o_totalprice BETWEEN 150000 AND 300000", "o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders of a middling price, the dearest first."""
    request = {"query": {"and": [_URGENT, _MIDDLE]}, "order_by": [{"field": "o_totalprice", "ascending": False}], "size": 10}
    return Search(_orders(spark, sf_dir), request).items().drop("_score")


# ---------------------------------------------------------------- predicates


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def leaf_is_exact(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"field": ["o_orderpriority", "is", ["1-URGENT", "5-LOW"]]}, "o_orderkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 400)")
def leaf_is_id(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"field": ["o_orderkey", "is", [1, "7", 32, 400, "none"]]}, "o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent'")
def leaf_is_lowercase(spark, sf_dir):
    source = _orders(spark, sf_dir, o_orderpriority=_exact("priority", lowercase=True))
    return _rows(source, {"field": ["o_orderpriority", "is", "1-Urgent"]}, "o_orderkey")


@_query("SELECT r_regionkey, r_name FROM region")
def leaf_matchall(spark, sf_dir):
    return _rows(typed(_table(spark, sf_dir, "region"), {"r_name": _exact("name")}), {"matchall": True}, "r_regionkey", "r_name")


@_query("SELECT r_regionkey, r_name FROM region WHERE false")
def leaf_matchnothing(spark, sf_dir):
    return _rows(typed(_table(spark, sf_dir, "region"), {"r_name": _exact("name")}), {"matchnothing": True}, "r_regionkey", "r_name")


@_query(f"SELECT o_orderkey, CAST(1 AS DOUBLE) AS score FROM orders WHERE {_M}")
def leaf_range_double(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), _MIDDLE, "o_orderkey", score=True)


@_query("SELECT event_id FROM events WHERE epoch(ts) BETWEEN 1704412800 AND 1705017600")
def leaf_range_timestamp(spark, sf_dir):
    return _rows(_events(spark, sf_dir), {"field": ["ts", "range", [1704412800, 1705017600]]}, "event_id")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@_query(f"SELECT {', '.join(_LINE)} FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-03-15'")
def leaf_range_date(spark, sf_dir):
    return _rows(_lines(spark, sf_dir), {"field": ["l_shipdate", "range", ["1996-02-01", "1996-03-15"]]}, *_LINE)


@_query(f"SELECT {', '.join(_LINE)} FROM lineitem WHERE year(l_shipdate) = 1996 AND month(l_shipdate) = 2")
def leaf_range_date_lenient(spark, sf_dir):
    """Any day up to 31 is legal in any month."""
    return _rows(_lines(spark, sf_dir), {"field": ["l_shipdate", "range", ["1996-2-1", "1996-2-31"]]}, *_LINE)


# ---------------------------------------------------------------- combinators


@_query(f"SELECT o_orderkey, CAST(2 AS DOUBLE) AS score FROM orders WHERE {_M} AND {_R}")
def bool_and(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"and": [_MIDDLE, _UPPER_RANGE]}, "o_orderkey", score=True)


@_query(f"SELECT o_orderkey, CAST(({_M})::INT + ({_R})::INT AS DOUBLE) AS score FROM orders WHERE {_M} OR {_R} OR {_U}")
def bool_or(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"or": [_MIDDLE, _UPPER_RANGE, _URGENT]}, "o_orderkey", score=True)


@_query(f"SELECT o_orderkey, CAST(({_M})::INT + ({_R})::INT AS DOUBLE) AS score FROM orders WHERE (({_M})::INT + ({_R})::INT + ({_U})::INT) % 2 = 1")
def bool_xor(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"xor": [_MIDDLE, _UPPER_RANGE, _URGENT]}, "o_orderkey", score=True)


@_query(f"SELECT o_orderkey, CAST(1 AS DOUBLE) AS score FROM orders WHERE {_M} AND NOT ({_U} OR {_D})")
def bool_and_not(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"and_not": [_MIDDLE, _URGENT, _DONE]}, "o_orderkey", score=True)


@_query(f"SELECT o_orderkey, CAST(CASE WHEN {_M} THEN 1 ELSE 0 END AS DOUBLE) AS score FROM orders WHERE {_U}")
def bool_and_maybe(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"and_maybe": [_URGENT, _MIDDLE, _DONE]}, "o_orderkey", score=True)


@_query(f"SELECT o_orderkey, CAST(1 AS DOUBLE) AS score FROM orders WHERE {_M} AND {_R} AND {_D}")
def bool_filter(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"filter": [_MIDDLE, _UPPER_RANGE, _DONE]}, "o_orderkey", score=True)


@_query(f"SELECT o_orderkey, CAST(2.5 AS DOUBLE) AS score FROM orders WHERE {_M}")
def bool_scale(spark, sf_dir):
    return _rows(_orders(spark, sf_dir), {"scale": {"query": _MIDDLE, "factor": 2.5}}, "o_orderkey", score=True)


# ---------------------------------------------------------------- ranking, order, pages


@_query(f"""
SELECT {', '.join(_LINE)}, CAST(3 * (l_quantity BETWEEN 10 AND 30)::INT + (l_discount BETWEEN 0.05 AND 0.07)::INT AS DOUBLE) AS score
FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 OR l_discount BETWEEN 0.05 AND 0.07
ORDER BY score DESC, {', '.join(_LINE)} LIMIT 100
""")
def rank_scale_sum_topk(spark, sf_dir):
    query = {"or": [{"scale": {"query": {"field": ["l_quantity", "range", [10, 30]]}, "factor": 3}}, {"field": ["l_discount", "range", [0.05, 0.07]]}]}
    return _page(_lines(spark, sf_dir), {"query": query, "size": 100}, *_LINE, score=True)


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 50")
def sort_field_asc(spark, sf_dir):
    return _page(_customers(spark, sf_dir), {"query": {"matchall": True}, "order_by": [{"field": "c_acctbal"}], "size": 50}, "c_custkey", "c_acctbal")


@_query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50")
def sort_field_desc(spark, sf_dir):
    return _page(_customers(spark, sf_dir), {"query": {"matchall": True}, "order_by": [{"field": "c_acctbal", "ascending": False}], "size": 50}, "c_custkey", "c_acctbal")


@_query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 100")
def sort_field_multi(spark, sf_dir):
    order = [{"field": "p_brand"}, {"field": "p_size", "ascending": False}]
    return _page(_parts(spark, sf_dir), {"query": {"matchall": True}, "order_by": order, "size": 100}, "p_partkey", "p_brand", "p_size")


@_query("""
SELECT p_partkey, p_brand, CAST((p_size BETWEEN 5 AND 10)::INT + (p_size BETWEEN 8 AND 20)::INT AS DOUBLE) AS score
FROM part WHERE p_size BETWEEN 5 AND 20 ORDER BY score DESC, p_brand DESC, p_partkey LIMIT 100
""")
def sort_score_then_key(spark, sf_dir):
    query = {"or": [{"field": ["p_size", "range", [5, 10]]}, {"field": ["p_size", "range", [8, 20]]}]}
    order = [{"score": "weight"}, {"field": "p_brand", "ascending": False}]
    return _page(_parts(spark, sf_dir), {"query": query, "order_by": order, "size": 100}, "p_partkey", "p_brand", score=True)


@_query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_M} ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 40")
def page_from_size(spark, sf_dir):
    return _page(_orders(spark, sf_dir), {"query": _MIDDLE, "order_by": [{"field": "o_totalprice"}], "from": 40, "size": 25}, "o_orderkey", "o_totalprice")


@_query("""
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders)
SELECT o_orderkey, o_totalprice FROM r, (SELECT i AS own FROM r WHERE o_orderkey = 77) WHERE i >= greatest(1, own - 3) AND i < greatest(1, own - 3) + 10
""")
def page_fromdoc(spark, sf_dir):
    request = {"query": {"matchall": True}, "order_by": [{"field": "o_totalprice"}], "fromdoc": {"type": "default", "id": 77, "from": -3}, "size": 10}
    return _page(_orders(spark, sf_dir), request, "o_orderkey", "o_totalprice")


@_query("SELECT p_name, p_brand FROM part WHERE p_size BETWEEN 1 AND 5")
def display_subset(spark, sf_dir):
    request = {"query": {"field": ["p_size", "range", [1, 5]]}, "display": ["p_name", "p_brand", "none"], "size": -1}
    return Search(_parts(spark, sf_dir), request).items().select("p_name", "p_brand")


@_query("SELECT count(*) AS total_docs, count(*) FILTER (WHERE event_type = 'click') AS matches FROM events")
def count_total_docs(spark, sf_dir):
    return Search(_events(spark, sf_dir), {"query": {"field": ["event_type", "is", "click"]}}).counts()


# ---------------------------------------------------------------- facets and term statistics


@_query("SELECT event_type AS value, count(*) AS count FROM events WHERE value BETWEEN 5 AND 50 GROUP BY 1")
def facet_exact(spark, sf_dir):
    return Search(_events(spark, sf_dir), {"query": {"field": ["value", "range", [5, 50]]}}).facet_counts({"field": "event_type"})


@_query(f"SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, count(*) AS count FROM orders WHERE {_U} GROUP BY ALL")
def facet_date(spark, sf_dir):
    counts = Search(_orders(spark, sf_dir), {"query": _URGENT}).facet_counts({"field": "o_orderdate"})
    return counts.select(*[F.col(f"value.{p}").cast("long").alias(p) for p in ("year", "month", "day")], "count")


@_query("SELECT l_quantity AS value, count(*) AS count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def facet_numeric(spark, sf_dir):
    return Search(_lines(spark, sf_dir), {"query": {"field": ["l_returnflag", "is", "R"]}}).facet_counts({"field": "l_quantity"})


@_query(f"""
WITH f AS (SELECT o_orderpriority FROM orders WHERE {_M} ORDER BY o_totalprice, o_orderkey LIMIT 200)
SELECT o_orderpriority AS value, count(*) AS count FROM f GROUP BY 1 ORDER BY count DESC, value LIMIT 3
""")
def facet_limits(spark, sf_dir):
    search = Search(_orders(spark, sf_dir), {"query": _MIDDLE, "order_by": [{"field": "o_totalprice"}]})
    return search.facet_counts({"field": "o_orderpriority", "doc_limit": 200, "result_limit": 3})


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@_query(f"SELECT w AS term, count(*) AS count FROM (SELECT unnest(list_distinct({_WORDS})) AS w FROM benchmark) GROUP BY 1")
def info_occur(spark, sf_dir):
    return Search(_benchmark(spark, sf_dir), {"query": {"matchall": True}}).occurrences({"group": "t"})


def _benchmark(spark, sf_dir) -> Source:
    fields = {"item_id": {"type": "id"}, "text": {"type": "text", "group": "t"}}
    return typed(_table(spark, sf_dir, "benchmark"), fields, id_column="item_id", pattern=text.ASCII_WORD)


@_query(f"""
WITH w AS (SELECT doc_id, lang, unnest(list_distinct({_WORDS})) AS w FROM documents),
s AS (SELECT lang, substr(w, 3) AS term FROM w WHERE w[1:2] = 'th')
SELECT term, count(*) FILTER (WHERE lang = 'en') AS count, count(*) AS termfreq FROM s
WHERE term NOT IN ('e', 'at') GROUP BY 1 HAVING count(*) FILTER (WHERE lang = 'en') > 0
""")
def info_occur_termfreq_stopwords(spark, sf_dir):
    search = Search(_documents(spark, sf_dir), {"query": {"field": ["lang", "is", "en"]}})
    return search.occurrences({"group": "t", "prefix": "th", "stopwords": ["e", "at"], "get_termfreqs": True})


@_query(f"""
WITH w AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS w FROM benchmark)
SELECT a.w AS term1, b.w AS term2, count(*) AS count FROM w a JOIN w b ON a.item_id = b.item_id AND a.w < b.w GROUP BY 1, 2
""")
def info_cooccur(spark, sf_dir):
    return Search(_benchmark(spark, sf_dir), {"query": {"matchall": True}}).cooccurrences({"group": "t"})


# ---------------------------------------------------------------- text


def _english(query: dict) -> dict:
    return {"filter": [query, {"field": ["lang", "is", "en"]}]}


def _text_sql(condition: str) -> str:
    return f"WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents WHERE lang = 'en') SELECT doc_id FROM d WHERE {condition}"


def _next_sql(*words: str) -> str:
    tests = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len(t) + 1), lambda i: {tests})) > 0"


@_query(_text_sql("list_contains(t, 'that') AND list_contains(t, 'the') AND list_contains(t, 'of')"))
def text_and(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), _english({"field": ["text", "text", {"text": "that the of", "op": "and"}]}), "doc_id")


@_query(_text_sql("list_contains(t, 'benchmark') OR list_contains(t, 'ation') OR list_contains(t, 'whhe')"))
def text_or(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), _english({"field": ["text", "text", {"text": "benchmark ation whhe", "op": "or"}]}), "doc_id")


@_query(_text_sql(_next_sql("the", "and")))
def text_phrase(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), _english({"field": ["text", "text", "the and"]}), "doc_id")


@_query(_text_sql(f"({_next_sql('of', 'to')}) OR ({_next_sql('to', 'of')})"))
def text_near(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), _english({"field": ["text", "text", {"text": "of to", "op": "near"}]}), "doc_id")


@_query(_text_sql("len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' AND (list_contains(t[i:i + 4], 'to') OR list_contains(t[greatest(1, i - 4):i], 'to')))) > 0"))
def text_near_window(spark, sf_dir):
    spec = {"text": "of to", "op": "near", "window": 5, "strict_window": True}
    return _rows(_documents(spark, sf_dir), _english({"field": ["text", "text", spec]}), "doc_id")


@_query(_text_sql("list_contains(t, 'the') AND (list_contains(t, 'of') OR list_contains(t, 'to')) AND NOT list_contains(t, 'is')"))
def text_parse(spark, sf_dir):
    return _rows(_documents(spark, sf_dir), _english({"field": ["text", "parse", "the AND (of OR to) NOT is"]}), "doc_id")


@_query()
def text_stemmed(spark, sf_dir):
    """Words of an and query meet those of the text by their English stems."""
    query = _english({"field": ["text", "text", {"text": "ands others", "op": "or"}]})
    return _rows(_documents(spark, sf_dir, "stem_en"), query, "doc_id")


# ---------------------------------------------------------------- categories


def _nations(spark, sf_dir) -> tuple[Source, Taxonomy]:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name").collect()  # 25 nations
    tree = Taxonomy({r["n_name"]: [r["r_name"]] for r in rows} | {})
    for r in {r["r_name"] for r in rows}:
        tree.add_parent(r, "WORLD")
    customer = _table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    fields = {"c_custkey": {"type": "id"}, "n_name": {"type": "cat", "group": "nation", "taxonomy": "world"}}
    return typed(customer, fields, id_column="c_custkey", taxonomies={"world": tree}), tree


_NATIONS = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@_query(f"SELECT c_custkey {_NATIONS} WHERE n_name IN ('NATION_3', 'NATION_8')")
def cat_is(spark, sf_dir):
    return _rows(_nations(spark, sf_dir)[0], {"field": ["n_name", "is", ["NATION_3", "NATION_8"]]}, "c_custkey")


@_query(f"SELECT c_custkey {_NATIONS} WHERE r_name = 'ASIA'")
def cat_descendant(spark, sf_dir):
    return _rows(_nations(spark, sf_dir)[0], {"field": ["n_name", "is_descendant", ["ASIA"]]}, "c_custkey")


@_query(f"SELECT c_custkey {_NATIONS} WHERE r_name = 'EUROPE' OR n_name = 'NATION_3'")
def cat_or_descendant(spark, sf_dir):
    return _rows(_nations(spark, sf_dir)[0], {"field": ["n_name", "is_or_is_descendant", ["EUROPE", "NATION_3"]]}, "c_custkey")


@_query("SELECT 'WORLD' AS category, (SELECT count(DISTINCT r_name) FROM region) AS child_count, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS descendant_count")
def taxonomy_top(spark, sf_dir):
    top = _nations(spark, sf_dir)[1].top()
    return spark.createDataFrame([(c, n["child_count"], n["descendant_count"]) for c, n in top.items()], "category string, child_count long, descendant_count long")


@_query("""
WITH RECURSIVE e AS (
  SELECT n_name AS category, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region
), up AS (SELECT category, parent AS ancestor FROM e UNION SELECT up.category, e.parent FROM up JOIN e ON up.ancestor = e.category)
SELECT category, ancestor FROM up
""")
def taxonomy_closure(spark, sf_dir):
    return closure(_nations(spark, sf_dir)[1].edges(spark))


# ---------------------------------------------------------------- places


def _places(table: DataFrame, key: str, shift: int = 0) -> F.Column:
    k = F.col(key) + shift
    return F.struct(((k * 37 % 360) - 180).cast("double").alias("lon"), ((k * 17 % 181) - 90).cast("double").alias("lat"))


def _haversine(key: str, lon: float, lat: float) -> str:
    x, y = f"(({key}) * 37 % 360 - 180)", f"(({key}) * 17 % 181 - 90)"
    h = f"pow(sin(radians({lat} - {y}) / 2), 2) + cos(radians({y})) * cos(radians({lat})) * pow(sin(radians({lon} - {x}) / 2), 2)"
    return f"(2 * 6372797.6 * asin(least(1.0, sqrt({h}))))"


def _placed(spark, sf_dir, many: bool = False) -> Source:
    table = _table(spark, sf_dir, "customer")
    place = F.array(_places(table, "c_custkey"), _places(table, "c_custkey", 5)) if many else _places(table, "c_custkey")
    return typed(table, {"c_custkey": {"type": "id"}, "place": {"type": "lonlat"}}, id_column="c_custkey", columns={"place": place})


@_query(f"SELECT c_custkey, round(1000.0 / ({_haversine('c_custkey', 12.5, 41.9)} + 1000.0), 6) AS score FROM customer")
def geo_distscore(spark, sf_dir):
    return _rows(_placed(spark, sf_dir), {"field": ["place", "distscore", {"center": [12.5, 41.9]}]}, "c_custkey", score=True)


@_query(f"SELECT c_custkey, round(1000.0 / ({_haversine('c_custkey', 12.5, 41.9)} + 1000.0), 6) AS score FROM customer WHERE {_haversine('c_custkey', 12.5, 41.9)} <= 3000000")
def geo_max_range(spark, sf_dir):
    spec = {"center": {"lon": 12.5, "lat": 41.9}, "max_range": 3000000}
    return _rows(_placed(spark, sf_dir), {"field": ["place", "distscore", spec]}, "c_custkey", score=True)


@_query(f"SELECT c_custkey, round(1000.0 / (least({_haversine('c_custkey', 12.5, 41.9)}, {_haversine('c_custkey + 5', 12.5, 41.9)}) + 1000.0), 6) AS score FROM customer")
def geo_nearest_of_many(spark, sf_dir):
    return _rows(_placed(spark, sf_dir, many=True), {"field": ["place", "distscore", {"center": [12.5, 41.9]}]}, "c_custkey", score=True)


# ---------------------------------------------------------------- presence


def _labelled(spark, sf_dir) -> Source:
    labels = _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc_id")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs = docs.join(labels, docs.doc_id == labels.l_doc_id, "left").drop("l_doc_id")
    fields = {"doc_id": {"type": "id"}, "lang": _exact("lang"), "quality": {"type": "double"}, "toxic": {"type": "double"}}
    return typed(docs, fields, id_column="doc_id")


_LABELS = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@_query(f"SELECT d.doc_id {_LABELS} WHERE quality IS NOT NULL")
def meta_exists(spark, sf_dir):
    return _rows(_labelled(spark, sf_dir), {"meta": ["exists", "quality"]}, "doc_id")


@_query(f"SELECT d.doc_id {_LABELS} WHERE toxic IS NOT NULL OR quality IS NOT NULL")
def meta_nonempty(spark, sf_dir):
    return _rows(_labelled(spark, sf_dir), {"meta": ["nonempty", ["quality", "toxic"]]}, "doc_id")


@_query(f"SELECT d.doc_id {_LABELS} WHERE quality IS NULL")
def meta_empty(spark, sf_dir):
    return _rows(_labelled(spark, sf_dir), {"meta": ["empty", "quality"]}, "doc_id")


@_query(f"SELECT d.doc_id {_LABELS} WHERE false")
def meta_error(spark, sf_dir):
    return _rows(_labelled(spark, sf_dir), {"meta": ["error", None]}, "doc_id")


# ---------------------------------------------------------------- JSON restructuring


def _bodies(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.format_string('{"id": %d, "kind": "%s", "props": %s}', "event_id", "event_type", "props").alias("body"))


_K = "regexp_extract(props, '[0-9]+')"


@_query(f"""SELECT '{{"id": [' || event_id || '], "key": [' || {_K} || '], "kind": ["' || event_type || '"]}}' AS body FROM events""")
def map_preserve(spark, sf_dir):
    pipe = Pipe.of({"mappings": [{"map": [{"from": ["props", "k"], "to": "key"}]}]})
    return send(_bodies(spark, sf_dir).select("body"), "p", {"p": pipe})


@_query(f"""SELECT '{{"key": [' || {_K} || ']}}' AS body FROM events""")
def map_discard(spark, sf_dir):
    pipe = Pipe.of({"mappings": [{"default": "discard", "map": [{"from": ["props", "k"], "to": "key"}]}]})
    return send(_bodies(spark, sf_dir).select("body"), "p", {"p": pipe})


@_query("""SELECT '{"conv": [' || conv_id || '], "turn": [' || turn || ']}' AS body FROM conversations""")
def map_index_path(spark, sf_dir):
    body = F.format_string('{"at": [%d, %d], "conv": %d}', "conv_id", "turn", "conv_id").alias("body")
    pipe = Pipe.of({"mappings": [{"map": [{"from": ["at", 1], "to": "turn"}]}]})
    return send(_table(spark, sf_dir, "conversations").select(body), "p", {"p": pipe})


@_query(f"""
SELECT '{{"click": [' || event_id || ']}}' AS body FROM events WHERE event_type = 'click'
UNION ALL SELECT '{{"all": [' || {_K} || ']}}' FROM events
""")
def pipe_apply_all(spark, sf_dir):
    """One document in, one for each mapping that applies out."""
    first = {"when": {"equals": [{"get": ["kind"]}, {"literal": "click"}]}, "map": [{"from": "id", "to": "click"}], "default": "discard"}
    second = {"map": [{"from": ["props", "k"], "to": "all"}], "default": "discard"}
    return send(_bodies(spark, sf_dir).select("body"), "p", {"p": Pipe.of({"mappings": [first, second], "apply_all": True})})


@_query("SELECT event_id, true AS has_k, false AS has_other FROM events")
def cond_exists(spark, sf_dir):
    v = F.parse_json("body")
    tests = {"has_k": {"exists": ["props", "k"]}, "has_other": {"exists": ["props", 0]}}
    return _bodies(spark, sf_dir).select("event_id", *[condition_column(c, v).alias(n) for n, c in tests.items()])


@_query(f"SELECT event_id, event_type = 'click' AS click, {_K}::INT = 7 AS seven FROM events")
def cond_equals(spark, sf_dir):
    v = F.parse_json("body")
    tests = {"click": {"equals": [{"get": ["kind"]}, {"literal": "click"}]}, "seven": {"equals": [{"literal": 7}, {"get": ["props", "k"]}]}}
    return _bodies(spark, sf_dir).select("event_id", *[condition_column(c, v).alias(n) for n, c in tests.items()])


# ---------------------------------------------------------------- text categories

def _grams_sql(name: str, key: str, table: str) -> str:
    """CTEs up to ``name(label, ngram, n, rank)``: the profile of each label's texts."""
    return f"""
{name}_w AS (SELECT {key} AS label, '|' || unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) || '|' AS b FROM {table}),
{name}_s AS (SELECT label, b, unnest(range(1, length(b) + 1)) AS i FROM {name}_w),
{name}_g AS (SELECT label, unnest(list_transform(range(1, least(5, length(b) - i + 1) + 1), lambda k: substr(b, i, k))) AS ngram FROM {name}_s),
{name}_c AS (SELECT label, ngram, count(*) AS n FROM {name}_g GROUP BY 1, 2),
{name}_r AS (SELECT label, ngram, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, ngram) - 1 AS INT) AS rank FROM {name}_c),
{name} AS (SELECT * FROM {name}_r WHERE rank < 400)"""


def _distance_sql(name: str, sample: str, target: str) -> str:
    return f""", {name}_t AS (SELECT DISTINCT label AS target FROM {target}),
{name} AS (SELECT s.label, l.target, CAST(sum(coalesce(abs(s.rank - t.rank), 400)) + (400 - count(*)) * 400 AS BIGINT) AS distance
  FROM {sample} s CROSS JOIN {name}_t l LEFT JOIN {target} t ON t.label = l.target AND t.ngram = s.ngram GROUP BY 1, 2)"""


@_query(f"WITH {_grams_sql('p', 'lang', 'documents')} SELECT label, ngram, n, rank FROM p")
def cat_ngram_profile(spark, sf_dir):
    return categorise.profiles(_table(spark, sf_dir, "documents"), "lang", "text", pattern=text.ASCII_WORD)


@_query(f"WITH {_grams_sql('p', 'lang', 'documents')}{_distance_sql('d', 'p', 'p')} SELECT label, target, distance FROM d")
def cat_ngram_distance(spark, sf_dir):
    found = categorise.profiles(_table(spark, sf_dir, "documents"), "lang", "text", pattern=text.ASCII_WORD)
    return categorise.distances(found, found)


@_query(f"""
WITH {_grams_sql('p', 'lang', 'documents')}, {_grams_sql('q', 'item_id', 'benchmark')}{_distance_sql('d', 'q', 'p')},
m AS (SELECT label AS item_id, target, distance, min(distance) OVER (PARTITION BY label) AS low FROM d),
r AS (SELECT item_id, string_agg(target, ',' ORDER BY distance, target) AS labels, count(*) AS n FROM m WHERE distance <= low * 1.03 GROUP BY 1)
SELECT item_id, CASE WHEN n <= 3 THEN labels ELSE '' END AS labels FROM r
""")
def cat_categorise(spark, sf_dir):
    """The languages of the benchmark's texts, by profiles of all documents."""
    model = categorise.trained(_table(spark, sf_dir, "documents"), "lang", "text", pattern=text.ASCII_WORD)
    items = _table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.array_join(model.column(F.col("text")), ",").alias("labels"))


# ---------------------------------------------------------------- several types, ingestion, the log


@_query("""
SELECT 'customer' AS doc_type, c_custkey AS doc_id, CAST(1 AS DOUBLE) AS score FROM customer WHERE c_acctbal BETWEEN 100 AND 900
UNION ALL SELECT 'supplier', s_suppkey, CAST(1 AS DOUBLE) FROM supplier WHERE s_acctbal BETWEEN 100 AND 900
""")
def multi_type_search(spark, sf_dir):
    fields = {"doc_id": {"type": "id"}, "name": _exact("name"), "balance": {"type": "double"}}
    sources = [
        typed(_table(spark, sf_dir, t).select(F.col(f"{p}_{k}").alias("doc_id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance")), fields, name=t, id_column="doc_id")
        for t, p, k in (("customer", "c", "custkey"), ("supplier", "s", "suppkey"))
    ]
    return _rows(together(sources), {"field": ["balance", "range", [100, 900]]}, "doc_type", "doc_id", score=True)


def _commands(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("user").alias("doc_type"), F.col("user_id").cast("string").alias("doc_id"), "event_type", "value"
    )


_LATEST = "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS doc_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@_query(_LATEST)
def upsert_latest(spark, sf_dir):
    return latest(_commands(spark, sf_dir)).drop("doc_type")


@_query(f"""
WITH a AS ({_LATEST.replace('FROM events', 'FROM (SELECT * FROM events WHERE value <= 230)')}),
b AS ({_LATEST.replace('FROM events', 'FROM (SELECT * FROM events WHERE value > 230)')})
SELECT seq, doc_id, event_type, value FROM b
UNION ALL SELECT seq, doc_id, event_type, value FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) AND event_type <> 'error'
""")
def delete_tombstone(spark, sf_dir):
    """A version with some keys replaced and some deleted."""
    commands = _commands(spark, sf_dir)
    old, new = latest(commands.where("value <= 230")), latest(commands.where("value > 230"))
    return upserted(old, new, old.where("event_type = 'error'").select("doc_type", "doc_id")).drop("doc_type")


@_query("""
WITH u AS (SELECT page_id, url, length(url) AS n, substr(url, 35) AS rest FROM pages),
h AS (SELECT page_id, url, n, CASE WHEN n > 40 THEN list_reduce(list_prepend(CAST(1 AS BIGINT), list_transform(range(1, length(rest) + 1), lambda i: CAST(ord(rest[i]) AS BIGINT))),
  lambda a, b: (a * 33 + b) % 4294967296) END AS h FROM u)
SELECT page_id, CASE WHEN n <= 40 THEN url ELSE substr(url, 1, 34) || list_aggregate(list_transform(range(0, 6),
  lambda j: CASE WHEN (h >> (6 * j)::INT) > 0 THEN chr((((h >> (6 * j)::INT) & 63) + 33)::INT) ELSE ' ' END), 'string_agg', '') END AS term FROM h
""")
def hash_long_term(spark, sf_dir):
    config = Field.of(_exact("url", max_length=40, too_long_action="hash"))
    return _table(spark, sf_dir, "pages").select("page_id", normal_column(config, F.col("url")).alias("term"))


@_query("""
WITH s AS (SELECT page_id, translate(CAST(page_id AS VARCHAR), '0123456789', '零一二三四五六七八九') AS s FROM pages),
c AS (SELECT page_id, s, unnest(range(1, length(s) + 1)) AS i FROM s),
g AS (SELECT page_id, i, s[i] AS term FROM c UNION ALL SELECT page_id, i, s[i:i + 1] FROM c WHERE i < length(s) UNION ALL SELECT page_id, length(s) + 2, 'page' FROM s)
SELECT page_id, term, CAST(count(*) AS INT) AS wdf, string_agg(DISTINCT CAST(i AS VARCHAR), ',' ORDER BY CAST(i AS VARCHAR)) AS positions FROM g GROUP BY 1, 2
""")
def cjk_tokens(spark, sf_dir):
    """Terms and positions of CJK text; each page's number in Chinese signs and its URL's host."""
    signs = F.translate(F.col("page_id").cast("string"), "0123456789", "零一二三四五六七八九")
    terms = _table(spark, sf_dir, "pages").select("page_id", F.explode(text.cjk_terms(F.array(F.concat(signs, F.lit(" page"))))).alias("t"))
    return terms.select("page_id", "t.term", "t.wdf", F.array_join(F.transform("t.positions", lambda p: p.cast("string")), ",").alias("positions"))


@_query()
def stem_en(spark, sf_dir):
    """The English stems of all words of the benchmark, and how often each occurs."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(text.stems(text.words(F.col("text")))).alias("stem"))
    return words.groupBy("stem").agg(F.count("*").alias("n"))


@_query("""
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_acctbal AS balance, c_name AS name, lower(c_mktsegment) AS word, '["' || c_name || '"]' AS stored FROM customer
""")
def ingest_default_schema(spark, sf_dir):
    """Customers as JSON documents, indexed by what their field names mean."""
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name_tag"), F.col("c_acctbal").alias("balance_num"), F.col("c_mktsegment").alias("segment_text")))
    docs = ingest.resolved(_table(spark, sf_dir, "customer").select(body.alias("body")))
    rows = ingest.indexed(docs, "default", default_schema(), ["balance_num", "id", "name_tag", "segment_text"])
    slot = lambda name: F.element_at(F.col(f"f_{name}"), 1)
    return rows.select("doc_id", slot("nbalance").alias("balance"), slot("gname").alias("name"), F.col("t_tsegment")[0]["term"].alias("word"), F.col("data")["name_tag"].alias("stored"))


@_query("SELECT CAST(user_id AS VARCHAR) AS doc_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_command_log(spark, sf_dir):
    """Events as a command log that a stream applies to a collection; the committed documents."""
    commands = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("put").alias("op"), F.lit("user").alias("doc_type"), F.col("user_id").cast("string").alias("doc_id"),
        F.to_json(F.struct(F.col("event_type").alias("kind_tag"), F.col("value").alias("value_num"))).alias("body"),
    )
    path = scratch(spark, "log")
    log = CommandLog(spark, Collection(spark, "users", f"{path}/collection"), path)
    log.append(commands)
    log.start().awaitTermination()
    return log.collection.source().table.select("doc_id", F.element_at("f_nvalue", 1).alias("value"))


# ---------------------------------------------------------------- many-valued fields, indexing, connectors


def _talks(spark, sf_dir) -> Source:
    talks = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn").cast("array<double>")).alias("turns"), F.array_sort(F.collect_set("role")).alias("roles"))
    fields = {"conv_id": {"type": "id"}, "turns": {"type": "double"}, "roles": _exact("role")}
    return typed(talks, fields, id_column="conv_id")


@_query("SELECT conv_id, CAST(1 AS DOUBLE) AS score FROM conversations WHERE turn BETWEEN 5 AND 6 GROUP BY 1")
def many_range(spark, sf_dir):
    """Any value of a field within the range."""
    return _rows(_talks(spark, sf_dir), {"field": ["turns", "range", [5, 6]]}, "conv_id", score=True)


@_query("SELECT conv_id FROM conversations WHERE role IN ('system', 'tool') GROUP BY 1")
def many_is(spark, sf_dir):
    return _rows(_talks(spark, sf_dir), {"field": ["roles", "is", ["system", "tool"]]}, "conv_id")


@_query("SELECT role AS value, count(DISTINCT conv_id) AS count FROM conversations GROUP BY 1")
def many_facet(spark, sf_dir):
    """A document counts once for each of its distinct values."""
    return Search(_talks(spark, sf_dir), {"query": {"matchall": True}}).facet_counts({"field": "roles"})


@_query("SELECT conv_id, CAST(max(turn) AS DOUBLE) AS last FROM conversations GROUP BY 1 ORDER BY min(turn) DESC, conv_id LIMIT 40")
def many_sort(spark, sf_dir):
    """The smallest value is the key, in both directions."""
    request = {"query": {"matchall": True}, "order_by": [{"field": "turns", "ascending": False}], "size": 40}
    return Search(_talks(spark, sf_dir), request).page().select("conv_id", F.array_max("turns").alias("last"))


_ANY_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@_query(f"""
WITH w AS (SELECT item_id, unnest({_ANY_WORDS}) AS w, unnest(range(1, len({_ANY_WORDS}) + 1)) AS i FROM benchmark)
SELECT CAST(item_id AS VARCHAR) AS doc_id, w AS term, CAST(count(*) AS INT) AS wdf, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM w GROUP BY 1, 2
""")
def index_text_terms(spark, sf_dir):
    """Terms with frequencies and positions of JSON documents."""
    body = F.to_json(F.struct(F.col("item_id").alias("id"), "text"))
    docs = ingest.resolved(_table(spark, sf_dir, "benchmark").select(body.alias("body")))
    rows = ingest.indexed(docs, "default", default_schema(), ["id", "text"])
    terms = rows.select("doc_id", F.explode("t_t").alias("t")).select("doc_id", "t.term", "t.wdf", "t.positions")
    return terms.withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@_query("""
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'quality' END AS nonempty, CASE WHEN l.doc_id IS NULL THEN 'quality' ELSE '' END AS empty
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def index_presence(spark, sf_dir):
    """Which fields of JSON documents hold something, and which are null."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("own"), "quality")
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    docs = docs.join(labels, docs.doc_id == labels.own, "left")
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("null"))
    found = ingest.resolved(docs.select(F.concat(F.lit('{"id": '), "doc_id", F.lit(', "quality": '), quality, F.lit("}")).alias("body")))
    schema = default_schema()
    schema.set("quality", Field.of({"type": "double", "slot": "q"}))
    rows = ingest.indexed(found, "default", schema, ["id", "quality"])
    return rows.select("doc_id", F.array_join("meta.N", ",").alias("nonempty"), F.array_join("meta.M", ",").alias("empty"))


@_query("""
SELECT event_id % 7 = 0 AS many, CASE WHEN event_id % 7 = 0 THEN 'several ids' WHEN event_type = 'click' THEN 'the types differ' ELSE '' END AS problem, count(*) AS n FROM events GROUP BY ALL
""")
def ingest_problems(spark, sf_dir):
    """Bodies with several ids, or another type than the request says."""
    many = F.expr("event_id % 7 = 0").alias("many")
    body = F.when(many, F.format_string('{"id": [%d, 0], "type": "%s"}', "event_id", "event_type")).otherwise(F.format_string('{"id": %d, "type": "%s"}', "event_id", "event_type"))
    given = F.when(F.col("event_type") == "click", "other").otherwise(F.col("event_type"))
    found = ingest.resolved(_table(spark, sf_dir, "events").select(many, body.alias("body"), given.alias("doc_type")))
    return found.groupBy("many", F.coalesce("_problem", F.lit("")).alias("problem")).agg(F.count("*").alias("n"))


@_query("""
SELECT event_id, CASE WHEN event_id % 40 < 31 AND month(ts) BETWEEN 1 AND 12 THEN CAST(year(ts) AS DOUBLE) END AS year,
  CASE WHEN event_id % 40 < 31 THEN CAST(event_id % 40 + 1 AS INT) END AS day FROM events
""")
def date_values(spark, sf_dir):
    """Dates from text: any day up to 31 in any month; others are errors."""
    made = F.concat(F.year("ts"), F.lit("-"), F.month("ts"), F.lit("-"), F.expr("event_id % 40 + 1"))
    v = F.parse_json(F.concat(F.lit('"'), made, F.lit('"')))
    date = ingest.date_value(v)
    return _table(spark, sf_dir, "events").select("event_id", date["year"].alias("year"), date["day"].alias("day"))


@_query("SELECT page_id, substr(url, 1, 25) AS term FROM pages")
def truncate_long_term(spark, sf_dir):
    config = Field.of(_exact("url", max_length=25, too_long_action="truncate"))
    return _table(spark, sf_dir, "pages").select("page_id", normal_column(config, F.col("url")).alias("term"))


@_query(f"SELECT c_custkey, r_name AS ancestor {_NATIONS} UNION ALL SELECT c_custkey, 'WORLD' {_NATIONS}")
def cat_ancestors(spark, sf_dir):
    """All documents with the ancestors of their categories."""
    source, tree = _nations(spark, sf_dir)
    up = closure(tree.edges(spark))
    return source.table.join(F.broadcast(up), F.col("n_name") == F.col("category")).select("c_custkey", "ancestor")


@_query("""
SELECT c_custkey FROM customer
WHERE ((c_custkey * 37 % 360) - 180 >= -20 AND (c_custkey * 37 % 360) - 180 <= 30) AND (c_custkey * 17 % 181) - 90 BETWEEN 10 AND 60
""")
def geo_box(spark, sf_dir):
    """A box across the meridian where longitudes wrap."""
    table = _table(spark, sf_dir, "customer")
    place = _places(table, "c_custkey")
    return table.where(geo.inside(place["lon"], place["lat"], -20, 10, 30, 60)).select("c_custkey")


@_query("""
SELECT c_custkey, round(CASE WHEN abs((c_custkey * 17 % 181) - 90) = 90 THEN 0 ELSE (c_custkey * 37 % 360 + 180) % 360 END, 6)::DOUBLE AS lon, ((c_custkey * 17 % 181) - 90)::DOUBLE AS lat FROM customer
""")
def geo_stored(spark, sf_dir):
    """Coordinates at the stored precision; longitudes from 0 to 360, and 0 at the poles."""
    table = _table(spark, sf_dir, "customer")
    place = _places(table, "c_custkey")
    lon, lat = geo.stored(place["lon"], place["lat"])
    return table.select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@_query(f"""
WITH w AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS w FROM benchmark), f AS (SELECT w, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT a.w AS term1, b.w AS term2, count(*) AS count FROM w a JOIN w b ON a.item_id = b.item_id AND a.w < b.w GROUP BY 1, 2)
SELECT term1, term2, count, x.n AS termfreq1, y.n AS termfreq2 FROM p JOIN f x ON x.w = term1 JOIN f y ON y.w = term2 ORDER BY count DESC, term1, term2 LIMIT 100
""")
def info_cooccur_termfreq(spark, sf_dir):
    """The most frequent pairs of words of all items, with each word's frequency."""
    fields = {"item_id": {"type": "id"}, "text": {"type": "text", "group": "t"}}
    search = Search(typed(_table(spark, sf_dir, "benchmark"), fields, id_column="item_id", pattern=text.ASCII_WORD), {"query": {"matchall": True}})
    return search.cooccurrences({"group": "t", "get_termfreqs": True, "result_limit": 100})


@_query("SELECT CAST(event_id AS BIGINT) AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, value FROM events")
def connector_export(spark, sf_dir):
    """A document store's export: whole numbers, doubles and dates in their extended notation."""
    path = scratch(spark, "export")
    line = F.format_string(
        '{"_id": {"$oid": "%s"}, "n": {"$numberLong": "%d"}, "v": {"$numberDouble": "%s"}, "at": {"$date": {"$numberLong": "%d"}}}',
        F.hex("event_id"), "event_id", F.col("value").cast("string"), F.expr("unix_millis(cast(ts as timestamp))"),
    )
    _table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    v = F.parse_json("body")
    get = lambda p, t: F.try_variant_get(v, p, t)
    return connectors.store_export(spark, path).select(get("$.n", "long").alias("id"), get("$.at", "long").alias("ms"), get("$.v", "double").alias("value"))


@_query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1")
def connector_json_lines(spark, sf_dir):
    """Documents written as lines of JSON and read back."""
    path = scratch(spark, "lines")
    _table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang")).alias("value")).write.text(path)
    lang = F.try_variant_get(F.parse_json("body"), "$.lang", "string")
    return connectors.json_lines(spark, path).groupBy(lang.alias("label")).agg(F.count("*").alias("n"))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id FROM part WHERE p_size BETWEEN 10 AND 20 AND list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'red')")
def collection_search(spark, sf_dir):
    """JSON documents put into a collection, committed, and searched."""
    c = Collection(spark, "parts", scratch(spark, "parts"))
    body = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name_text"), F.col("p_size").alias("size_num")))
    c.put_all(_table(spark, sf_dir, "part").select(body.alias("body")))
    c.commit()
    query = {"and": [{"field": ["name_text", "text", {"text": "red", "op": "and"}]}, {"field": ["size_num", "range", [10, 20]]}]}
    return c.search({"query": query}).matches.select("doc_id")
