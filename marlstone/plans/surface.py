"""More registered queries: documents as users put, read and delete them, schemas, tokenisers, statistics over
missing fields and several types, taxonomy edits, connectors, and the log. Each has its SQL."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..collection import Collection, Engine, together, typed
from ..errors import InvalidValueError
from ..functions import text
from ..operators import categorise
from ..operators.mapping import Pipe, condition_column, loads, send
from ..operators.search import Search, Source
from ..operators.taxonomy import Taxonomy
from ..sources import connectors, ingest
from ..sources.store import scratch
from ..streaming.commands import CommandLog
from .catalogue import _exact, _orders, _query, _rows, _table
from .schema import Field, Schema, default_schema, valid_name


def _json(**columns) -> F.Column:
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])).alias("body")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(_json(id="c_custkey", name_tag="c_name", balance_num="c_acctbal"))


def _collection(spark: SparkSession, sf_dir: str, path: str | None = None) -> Collection:
    c = Collection(spark, "customers", path or scratch(spark, "customers"))
    c.put_all(_customers(spark, sf_dir))
    c.commit()
    return c


# ---------------------------------------------------------------- documents in collections


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey IN (7, 11)")
def point_lookup(spark, sf_dir):
    """Documents by their ids; one that isn't there gives nothing."""
    c = _collection(spark, sf_dir)
    found = [(i, c.get("default", i)) for i in (7, 11, -1)]
    rows = [(str(i), d["data"]["name_tag"][0], float(d["data"]["balance_num"][0])) for i, d in found if d is not None]
    return spark.createDataFrame(rows, "doc_id string, name string, balance double")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '["' || c_name || '"]' AS name, '[' || c_custkey || ']' AS id FROM customer""")
def document_dump(spark, sf_dir):
    """All stored data of a collection."""
    table = _collection(spark, sf_dir).source().table
    return table.select("doc_id", F.col("data")["name_tag"].alias("name"), F.col("data")["id"].alias("id"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_custkey NOT IN (1, 2, 3)")
def delete_documents(spark, sf_dir):
    c = _collection(spark, sf_dir)
    for i in (1, 2, 3, -5):
        c.delete("default", i)
    c.commit()
    return c.source().table.select("doc_id")


@_query("SELECT step, CASE WHEN step = 'before' THEN n ELSE 0 END AS documents FROM (SELECT count(*) AS n FROM customer), (VALUES ('before'), ('after')) AS s(step)")
def delete_collection(spark, sf_dir):
    c = _collection(spark, sf_dir)
    before = c.info()["doc_count"]
    c.drop()
    return spark.createDataFrame([("before", before), ("after", c.info()["doc_count"])], "step string, documents long")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000")
def reopened_collection(spark, sf_dir):
    """Documents and schemas of a collection that another session opens."""
    path = scratch(spark, "engine")
    engine = Engine(spark, path)
    _collection(spark, sf_dir, f"{path}/customers")
    again = engine.collection("customers")
    return again.search({"query": {"field": ["balance_num", "range", [1000, 2000]]}}).matches.select("doc_id")


@_query("SELECT 'customers' AS collection, count(*) AS documents FROM customer UNION ALL SELECT 'empty', 0")
def collection_listing(spark, sf_dir):
    path = scratch(spark, "engine")
    engine = Engine(spark, path)
    _collection(spark, sf_dir, f"{path}/customers")
    engine.collection("empty").put_config(engine.collection("empty").config())
    rows = [(name, engine.collection(name).info()["doc_count"]) for name in engine.collections()]
    return spark.createDataFrame(rows, "collection string, documents long")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_acctbal < 0")
def search_from_file(spark, sf_dir):
    """A request read from a file, with comments in it."""
    c = _collection(spark, sf_dir)
    path = scratch(spark, "request")
    request = '{"query": /* debts */ {"field": ["balance_num", "range", [-100000, -0.001]]}} // end'
    spark.createDataFrame([(request,)], "value string").coalesce(1).write.text(path)
    return c.search_file(path, "default").matches.select("doc_id")


@_query("SELECT c_custkey AS id, c_name AS name, n AS found, total FROM customer, (SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS n FROM customer) WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 25")
def search_result(spark, sf_dir):
    """The response of a search as an object, with its exact counts."""
    request = {"query": {"field": ["balance_num", "range", [0.001, 1e9]]}, "order_by": [{"field": "balance_num", "ascending": False}], "size": 25, "display": ["id", "name_tag"]}
    out = _collection(spark, sf_dir).search(request).to_dict()
    rows = [(int(r["id"][0]), r["name_tag"][0], out["matches_estimated"], out["total_docs"]) for r in out["items"]]
    return spark.createDataFrame(rows, "id long, name string, found long, total long")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_acctbal > 0 THEN '' ELSE 'balance_num: not a number' END AS problem FROM customer")
def index_errors(spark, sf_dir):
    """Fields in error, a row for each document."""
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise('"none"')
    body = F.format_string('{"id": %d, "balance_num": %s}', "c_custkey", balance)
    docs = ingest.resolved(_table(spark, sf_dir, "customer").select(body.alias("body")))
    rows = ingest.indexed(docs, "default", default_schema(), ["balance_num", "id"])
    problem = F.array_join(F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["message"])), ",")
    return rows.select("doc_id", problem.alias("problem"))


def _faulty(spark, sf_dir) -> Collection:
    c = Collection(spark, "faulty", scratch(spark, "faulty"))
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise('"none"')
    c.put_all(_table(spark, sf_dir, "customer").select(F.format_string('{"id": %d, "balance_num": %s}', "c_custkey", balance).alias("body")))
    return c


@_query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_acctbal <= 0")
def meta_error_found(spark, sf_dir):
    """Documents with a field in error."""
    c = _faulty(spark, sf_dir)
    c.commit()
    return c.search({"query": {"meta": ["error", "balance_num"]}}).matches.select("doc_id")


@_query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(least(count(*), 100) AS BIGINT) AS listed FROM customer WHERE c_acctbal <= 0")
def error_totals(spark, sf_dir):
    """The errors before a checkpoint: all are counted, the first are listed."""
    c = _faulty(spark, sf_dir)
    state = c.checkpoints.state(c.checkpoint())
    return spark.createDataFrame([(state["total_errors"], len(state["errors"]))], "total long, listed long")


@_query("SELECT CAST(item_id AS VARCHAR) AS doc_id, CASE WHEN item_id % 2 = 0 THEN 'text: text is needed' ELSE '' END AS problem FROM benchmark")
def text_needs_text(spark, sf_dir):
    """A number where text is needed is an error of its field."""
    body = F.when(F.expr("item_id % 2 = 0"), F.format_string('{"id": %d, "text": 5}', "item_id")).otherwise(F.format_string('{"id": %d, "text": "five"}', "item_id"))
    docs = ingest.resolved(_table(spark, sf_dir, "benchmark").select(body.alias("body")))
    rows = ingest.indexed(docs, "default", default_schema(), ["id", "text"])
    kind = F.when(F.size("errors") > 0, F.concat(F.col("errors")[0]["field"], F.lit(": text is needed"))).otherwise("")
    return rows.select("doc_id", kind.alias("problem"))


# ---------------------------------------------------------------- indexing by type


@_query("""
SELECT CAST(event_id AS VARCHAR) AS doc_id, CAST(epoch_us(ts) // 1000 AS DOUBLE) / 1000 AS at, event_type AS term, 3 AS wdf, '[' || user_id || ']' AS stored FROM events
""")
def index_by_type(spark, sf_dir):
    """Timestamps, terms that weigh more, stored fields and named slots."""
    schema = Schema.of({"fields": {
        "id": {"type": "id"}, "at": {"type": "timestamp", "slot": "when"}, "kind": _exact("k", wdfinc=3), "user": {"type": "stored", "store_field": "user"}, "left_out": {"type": "ignore"},
    }})
    at = (F.expr("unix_millis(cast(ts as timestamp))") / 1000).alias("at")
    events = _table(spark, sf_dir, "events").select("event_id", at, "event_type", "user_id")
    docs = ingest.resolved(events.select(_json(id="event_id", at="at", kind="event_type", user="user_id", left_out="event_id")))
    rows = ingest.indexed(docs, "default", schema, ["at", "id", "kind", "left_out", "user"])
    term = F.col("t_k")[0]
    return rows.select("doc_id", F.element_at("f_when", 1).alias("at"), term["term"].alias("term"), term["wdf"].alias("wdf"), F.col("data")["user"].alias("stored"))


@_query("""
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE round(CAST(c_custkey % 360 AS DOUBLE), 6) END AS lon,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE CAST(c_custkey % 80 AS DOUBLE) END AS lat, c_custkey % 4 = 3 AS bad FROM customer
""")
def lonlat_forms(spark, sf_dir):
    """Coordinates as pairs, as objects, and with a member missing."""
    key = F.col("c_custkey")
    body = (
        F.when(key % 4 == 3, F.format_string('{"id": %d, "at_lonlat": {"lon": 5}}', key))
        .when(key % 4 == 1, F.format_string('{"id": %d, "at_lonlat": {"lon": %d, "lat": %d}}', key, key % 360, key % 80))
        .otherwise(F.format_string('{"id": %d, "at_lonlat": [%d, %d]}', key, key % 360, key % 80))
    )
    docs = ingest.resolved(_table(spark, sf_dir, "customer").select(body.alias("body")))
    rows = ingest.indexed(docs, "default", default_schema(), ["at_lonlat", "id"])
    point = F.try_element_at("f_lat", F.lit(1))
    return rows.select("doc_id", F.round(point["lon"], 6).alias("lon"), point["lat"].alias("lat"), (F.size("errors") > 0).alias("bad"))


@_query("SELECT name, kind, place FROM (VALUES ('balance_num', 'double', 'nbalance'), ('name_tag', 'exact', 'gname'), ('id', 'id', ''), ('note', 'text', ''), ('where_lonlat', 'lonlat', 'lwhere'), ('made_time', 'timestamp', 'dmade')) AS v(name, kind, place)")
def schema_grows(spark, sf_dir):
    """What the default patterns make of new fields' names."""
    schema = default_schema()
    names = ["balance_num", "name_tag", "id", "note", "where_lonlat", "made_time"]
    rows = [(n, c.type, str(c.slot) if c.type not in ("id", "text") else "") for n in names for c in [schema.resolve(n)]]
    return spark.createDataFrame(rows, "name string, kind string, place string")


@_query("SELECT DISTINCT p_type AS name, strpos(p_type, chr(9)) = 0 AND strpos(p_type, '/') = 0 AS valid FROM part UNION SELECT 'a/b', false UNION SELECT '', false UNION SELECT 'a' || chr(9) || 'b', false")
def valid_names(spark, sf_dir):
    """Which values may name a collection, type or category."""
    names = sorted(r[0] for r in _table(spark, sf_dir, "part").select("p_type").distinct().collect()) + ["a/b", "", "a\tb"]

    def valid(name: str) -> bool:
        try:
            return valid_name(name) == name
        except InvalidValueError:
            return False

    return spark.createDataFrame([(n, valid(n)) for n in names], "name string, valid boolean")


@_query("""
SELECT DISTINCT p_name AS name, 268435456 + (list_reduce(list_prepend(CAST(1 AS BIGINT), list_transform(range(1, length(p_name) + 1), lambda i: CAST(ord(p_name[i]) AS BIGINT))),
  lambda a, b: (a * 33 + b) % 4294967296) & 4026531839) AS slot FROM part
""")
def hash_slot(spark, sf_dir):
    """Numbers of named slots; the names are a schema's, and few, so they are made on the driver."""
    names = [r[0] for r in _table(spark, sf_dir, "part").select("p_name").distinct().collect()]
    return spark.createDataFrame([(n, text.slot_number(n)) for n in names], "name string, slot long")


# ---------------------------------------------------------------- words of any language

_D, _A = r"\p{Nd}", r"[\p{L}\p{Nl}\p{No}\p{M}_]"
_SEP, _NUM = "['&·״‧]", "[,.;;։؍߸⁄︐︓︔]"
_D1, _A1, _E1 = f"(?:{_D}|{_NUM}{_D})", f"(?:{_A}|{_SEP}{_A})", f"(?:{_D}|{_SEP}{_D})"
_AFTER_DIGIT = f"(?:{_D1}*{_A1}+{_E1})*{_D1}*{_A1}*"
#: The word rules for an engine that can't look around: what may follow a digit, and what a letter.
_WORD_SQL = f"(?:{_D}{_AFTER_DIGIT}|{_A}{_A1}*(?:{_E1}{_AFTER_DIGIT})?)".replace("'", "''")
_FOLDED = "translate(replace(replace(coalesce(text, ''), '+', ' '), '#', ' '), '’‛​‌‍⁠﻿', '''''')"


@_query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower({_FOLDED}), '{_WORD_SQL}') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INT) AS words, md5(array_to_string(w, ' ')) AS digest FROM w
""")
def unicode_words(spark, sf_dir):
    """The words of all documents by the full rules (signs that may end a word are taken out before)."""
    docs = _table(spark, sf_dir, "documents")
    words = text.words(F.translate(F.coalesce("text", F.lit("")), "+#", "  "))
    return docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@_query(f"""
WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower({_FOLDED}), '{_WORD_SQL}') AS w FROM documents)
SELECT doc_id FROM w WHERE list_contains(w, 'der') AND NOT list_contains(w, 'the')
""")
def unicode_text_query(spark, sf_dir):
    """A text query by the engine's own tokeniser."""
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "+#", "  "))
    source = typed(docs, {"doc_id": {"type": "id"}, "text": {"type": "text", "group": "t"}}, id_column="doc_id")
    ask = lambda w: {"field": ["text", "text", {"text": w, "op": "and"}]}
    return _rows(source, {"and_not": [ask("der"), ask("the")]}, "doc_id")


_SIGNS = "translate(CAST(page_id AS VARCHAR), '0123456789', '零一二三四五六七八九')"


@_query(f"""
WITH s AS (SELECT page_id, {_SIGNS} AS s FROM pages), c AS (SELECT page_id, s, unnest(range(1, length(s) + 1)) AS i FROM s),
g AS (SELECT page_id, i, s[i] AS term FROM c UNION ALL SELECT page_id, i, s[i:i + 1] FROM c WHERE i < length(s) UNION ALL SELECT page_id, length(s) + 1, 'page' FROM s)
SELECT page_id, term, CAST(count(*) AS INT) AS wdf, string_agg(DISTINCT CAST(i AS VARCHAR), ',' ORDER BY CAST(i AS VARCHAR)) AS positions FROM g GROUP BY 1, 2
""")
def cjk_terms(spark, sf_dir):
    """Each sign alone and with the next one, at one position."""
    signs = F.translate(F.col("page_id").cast("string"), "0123456789", "零一二三四五六七八九")
    terms = _table(spark, sf_dir, "pages").select("page_id", F.explode(text.cjk_terms(F.array(F.concat(signs, F.lit("page"))))).alias("t"))
    return terms.select("page_id", "t.term", "t.wdf", F.array_join(F.array_sort(F.transform("t.positions", lambda p: p.cast("string"))), ",").alias("positions"))


def _signed(spark, sf_dir) -> Collection:
    c = Collection(spark, "signs", scratch(spark, "signs"))
    c.put_schema("default", {"fields": {"id": {"type": "id"}, "s": {"type": "text", "group": "s", "processor": "cjk"}}})
    signs = F.translate(F.col("page_id").cast("string"), "0123456789", "零一二三四五六七八九")
    c.put_all(_table(spark, sf_dir, "pages").select(_json(id="page_id", s=signs)))
    c.commit()
    return c


@_query(f"SELECT CAST(page_id AS VARCHAR) AS doc_id FROM pages WHERE contains({_SIGNS}, '一二')")
def cjk_query(spark, sf_dir):
    """Two signs next to each other."""
    return _signed(spark, sf_dir).search({"query": {"field": ["s", "text", {"text": "一二", "op": "and"}]}}).matches.select("doc_id")


# ---------------------------------------------------------------- searches


def _two_types(spark, sf_dir) -> Source:
    fields = {"doc_id": {"type": "id"}, "name": _exact("name"), "balance": {"type": "double"}, "nation": _exact("nation", slot="nation")}
    return together([
        typed(_table(spark, sf_dir, t).select(F.col(f"{p}_{k}").alias("doc_id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance"), F.col(f"{p}_nationkey").cast("string").alias("nation")), fields, name=t, id_column="doc_id")
        for t, p, k in (("customer", "c", "custkey"), ("supplier", "s", "suppkey"))
    ])


@_query("SELECT s_suppkey AS doc_id FROM supplier WHERE s_acctbal BETWEEN 100 AND 900")
def type_filter(spark, sf_dir):
    """Documents of one type among several."""
    found = Search(_two_types(spark, sf_dir), {"query": {"field": ["balance", "range", [100, 900]]}}, "supplier")
    return found.matches.select("doc_id")


@_query("SELECT 'customer' AS doc_type, c_custkey AS doc_id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal > 5000")
def unknown_field(spark, sf_dir):
    """A field that no type has matches nothing, and leaves the rest of a query as it is."""
    query = {"or": [{"field": ["nowhere", "is", ["x"]]}, {"field": ["balance", "range", [5000.001, 1e9]]}]}
    return _rows(_two_types(spark, sf_dir), query, "doc_type", "doc_id")


@_query("SELECT 'supplier' AS doc_type, count(*) AS found FROM supplier UNION ALL SELECT 'nobody', 0")
def unknown_type(spark, sf_dir):
    """A type that isn't there has no documents."""
    rows = [(t, Search(_two_types(spark, sf_dir), {"query": {"matchall": True}}, t).count()) for t in ("supplier", "nobody")]
    return spark.createDataFrame(rows, "doc_type string, found long")


_INVALID = {
    "unknown_node": {"nonsense": []}, "text_range": {"field": ["o_totalprice", "text", "x"]}, "range_of_exact": {"field": ["o_orderstatus", "range", [1, 2]]},
    "two_members": {"and": [], "or": []}, "bad_field": {"field": ["o_orderstatus"]}, "fine": {"field": ["o_orderstatus", "is", ["F"]]},
}


@_query("SELECT request, request <> 'fine' AS refused FROM (VALUES " + ", ".join(f"('{n}')" for n in _INVALID) + ") AS v(request)")
def invalid_queries(spark, sf_dir):
    """Requests that have no meaning are refused before anything runs."""
    source, rows = _orders(spark, sf_dir), []
    for name, query in _INVALID.items():
        try:
            Search(source, {"query": query})
            rows.append((name, False))
        except InvalidValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "request string, refused boolean")


@_query("SELECT nation AS value, count(*) AS count FROM (SELECT CAST(c_nationkey AS VARCHAR) AS nation FROM customer UNION ALL SELECT CAST(s_nationkey AS VARCHAR) FROM supplier) GROUP BY 1")
def facet_across_types(spark, sf_dir):
    return Search(_two_types(spark, sf_dir), {"query": {"matchall": True}}).facet_counts({"field": "nation"})


@_query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS matches, CAST(0 AS BIGINT) AS values_seen")
def facet_missing_field(spark, sf_dir):
    """A facet over a field that nobody has counts nothing; the search goes on."""
    found = Search(_two_types(spark, sf_dir), {"query": {"matchall": True}, "size": 0, "info": [{"facet_count": {"field": "nowhere"}}]}).to_dict()
    return spark.createDataFrame([(found["matches_estimated"], found["info"][0]["values_seen"])], "matches long, values_seen long")


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 30")
def sort_unknown_field(spark, sf_dir):
    """An order that names no field is passed over; keys decide."""
    request = {"query": {"field": ["o_totalprice", "range", [300000.001, 1e12]]}, "order_by": [{"field": "nowhere"}], "size": 30}
    return Search(_orders(spark, sf_dir), request).page().select("o_orderkey")


@_query("SELECT n AS requested, count(*) FILTER (o_orderstatus = 'F') AS lower, count(*) FILTER (o_orderstatus = 'F') AS upper FROM orders, (VALUES (0), (50), (1000000)) AS v(n) GROUP BY 1")
def check_at_least(spark, sf_dir):
    """Counts are exact, however many documents a request wants checked."""
    rows = []
    for n in (0, 50, 1_000_000):
        out = Search(_orders(spark, sf_dir), {"query": {"field": ["o_orderstatus", "is", ["F"]]}, "size": 1, "check_at_least": n}).to_dict()
        rows.append((n, out["matches_lower_bound"], out["matches_upper_bound"]))
    return spark.createDataFrame(rows, "requested int, lower long, upper long")


@_query("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50")
def display_all(spark, sf_dir):
    """Without a list, all stored fields are shown."""
    request = {"query": {"field": ["o_orderstatus", "is", ["P"]]}, "size": 50}
    return Search(_orders(spark, sf_dir), request).items().select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


# ---------------------------------------------------------------- conditions, mappings and categories


@_query("SELECT event_id, event_type = 'click' AS has_click, event_type <> 'click' AS has_other FROM events")
def cond_exists_found(spark, sf_dir):
    """Members that some documents have and others don't."""
    body = F.format_string('{"%s": {"at": [%d]}}', "event_type", "event_id")
    v = F.parse_json(body)
    click = condition_column({"exists": ["click", "at", 0]}, v)
    others = [condition_column({"exists": [r[0]]}, v) for r in _table(spark, sf_dir, "events").where("event_type <> 'click'").select("event_type").distinct().collect()]
    other = F.lit(False)
    for o in others:
        other = other | o
    return _table(spark, sf_dir, "events").select("event_id", click.alias("has_click"), other.alias("has_other"))


@_query("SELECT '{\"kind\": [\"' || event_type || '\"], \"same\": [' || event_id || ']}' AS body FROM events WHERE event_type = 'click'")
def map_when(spark, sf_dir):
    """Only documents whose condition holds leave a pipe, and go on to its target."""
    body = F.format_string('{"id": %d, "kind": "%s"}', "event_id", "event_type").alias("body")
    first = {"mappings": [{"when": {"equals": [{"get": ["kind"]}, {"literal": "click"}]}, "map": [{"from": "id", "to": "same"}]}], "target": "second"}
    second = {"mappings": [{"default": "preserve_top"}]}
    return send(_table(spark, sf_dir, "events").select(body), "first", {"first": Pipe.of(first), "second": Pipe.of(second)})


@_query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM benchmark")
def map_categorised(spark, sf_dir):
    """A mapping that puts a text's category into a field."""
    model = categorise.Categoriser({}, 1.03, 3, 50, 1)
    model.add("even", "aaaa bbbb aaaa")
    model.add("odd", "xyxy zzzz xyxy")
    sample = F.when(F.expr("item_id % 2 = 0"), "bbbb aaaa").otherwise("zzzz xyxy")
    pipe = Pipe.of({"mappings": [{"map": [{"from": ["t"], "to": "label", "categoriser": "c"}]}]})
    made = send(_table(spark, sf_dir, "benchmark").select(_json(id="item_id", t=sample)), "p", {"p": pipe}, {"c": model})
    v = F.parse_json("body")
    return made.select(F.try_variant_get(v, "$.id[0]", "long").alias("item_id"), F.try_variant_get(v, "$.label[0]", "string").alias("label"))


@_query("SELECT n_name AS category, r_name AS ancestor, 1 AS gone FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def taxonomy_edits(spark, sf_dir):
    """Parents added and taken away: what the edit says has changed, and who has which ancestors after it."""
    pairs = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    tree = Taxonomy({r["n_name"]: [r["r_name"]] for r in pairs})
    one = min(r["n_name"] for r in pairs)
    tree.add("ATLANTIS")
    tree.add_parent(one, "ATLANTIS")
    gone = tree.remove("ATLANTIS")
    again = Taxonomy(tree.to_json())
    return spark.createDataFrame([(one, a, int(one in gone)) for a in sorted(again.ancestors(one))], "category string, ancestor string, gone int")


@_query("SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS below FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def taxonomy_views(spark, sf_dir):
    """Children of each top category, from the views."""
    pairs = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    tree = Taxonomy({r["n_name"]: [r["r_name"]] for r in pairs})
    rows = [(c, ",".join(tree.view(c)["descendants"])) for c in tree.top() if all(tree.is_parent(n, c) for n in tree.view(c)["children"])]
    return spark.createDataFrame(rows, "region string, below string")


# ---------------------------------------------------------------- connectors


@F.pandas_udf(T.BinaryType())
def _deflated(part: pd.Series) -> pd.Series:
    return part.map(lambda t: None if t is None else zlib.compress(t.encode()))


@_query("SELECT page_id, md5(coalesce(html, '')) AS digest FROM pages")
def connector_inflate(spark, sf_dir):
    """zlib data of a store's binary fields unpacked."""
    connectors.small_batches(spark)
    packed = _table(spark, sf_dir, "pages").select("page_id", _deflated(F.coalesce("html", F.lit(""))).alias("z"))
    return packed.select("page_id", F.md5(connectors.inflated(F.col("z"))).alias("digest"))


@_query("SELECT lang, count(*) AS documents FROM documents GROUP BY 1")
def connector_json_files(spark, sf_dir):
    """Whole files below a folder, its subfolders too: here one for each language."""
    path = scratch(spark, "files")
    docs = _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    docs.select(F.coalesce("lang", F.lit("none")).alias("folder"), F.to_json(F.struct("lang", "n")).alias("value")).repartition("folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    v = F.parse_json("body")
    found = connectors.json_files(spark, path).where("problem is null")
    return found.select(F.try_variant_get(v, "$.lang", "string").alias("lang"), F.try_variant_get(v, "$.n", "long").alias("documents"))


@_query("SELECT query, extended FROM (VALUES ('{\"a\": 5}', '{\"a\": 5}'), ('{\"a\": [4294967296]}', '{\"a\": [{\"$numberLong\": \"4294967296\"}]}')) AS v(query, extended)")
def connector_query(spark, sf_dir):
    """Queries for a store: whole numbers beyond 32 bits in their extended notation; comments are allowed."""
    rows = [(json.dumps(loads(q)), json.dumps(connectors.extended(loads(q)))) for q in ('{"a": 5 /* small */}', '{"a": [4294967296]} // large')]
    return spark.createDataFrame(rows, "query string, extended string")


# ---------------------------------------------------------------- the log


@_query("SELECT CAST(user_id AS VARCHAR) AS doc_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_late_commands(spark, sf_dir):
    """Commands whose files come in the wrong order, a third of them in each micro-batch: the last command wins all the same."""
    commands = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("put").alias("op"), F.lit("user").alias("doc_type"), F.col("user_id").cast("string").alias("doc_id"), _json(value_num="value")
    )
    path = scratch(spark, "log")
    log = CommandLog(spark, Collection(spark, "users", f"{path}/collection"), path)
    top = commands.agg(F.max("seq")).first()[0] or 0
    for part in (2, 0, 1):
        log.append(commands.where((F.col("seq") > top * part // 3) & (F.col("seq") <= top * (part + 1) // 3) | ((F.col("seq") <= 0) & F.lit(part == 0))))
        log.start().awaitTermination()
    return log.collection.source().table.select("doc_id", F.element_at("f_nvalue", 1).alias("value"))


@_query("SELECT 'here' AS checkpoint, true AS reached, count(*) FILTER (event_type = 'click') AS errors FROM events UNION ALL SELECT 'later', true, 0")
def stream_checkpoints(spark, sf_dir):
    """Errors up to a checkpoint in the log, and none up to the next one."""
    body = F.when(F.col("event_type") == "click", "nonsense").otherwise("{}")
    commands = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("put").alias("op"), F.lit("t").alias("doc_type"), F.col("event_id").cast("string").alias("doc_id"), body.alias("body")
    )
    top = commands.agg(F.max("seq")).first()[0] or 0
    points = spark.createDataFrame([(top + 1, "checkpoint", None, "here", None), (top + 2, "checkpoint", None, "later", None)], "seq long, op string, doc_type string, doc_id string, body string")
    path = scratch(spark, "log")
    log = CommandLog(spark, Collection(spark, "events", f"{path}/collection"), path)
    log.append(commands.unionByName(points))
    log.start().awaitTermination()
    states = [(n, log.collection.checkpoints.state(n)) for n in ("here", "later")]
    return spark.createDataFrame([(n, s["reached"], s["total_errors"]) for n, s in states], "checkpoint string, reached boolean, errors long")
