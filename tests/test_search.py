"""Searches over typed tables against a plain evaluator, and the rules of the request grammar."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.collection import typed
from marlstone.errors import InvalidValueError, UnknownNameError
from marlstone.operators.search import Search

ROWS = [(i, ["a", "b", "c", None][i % 4], [None, 1.0, 5.0, 9.0, 5.0][i % 5], [i % 3, (i * 7) % 5] if i % 6 else None) for i in range(40)]
FIELDS = {"k": {"type": "id"}, "s": {"type": "exact", "group": "s"}, "x": {"type": "double"}, "m": {"type": "double"}, "keep": {"type": "stored", "store_field": "keep"}, "out": {"type": "ignore"}}


@pytest.fixture(scope="module")
def source(spark):
    df = spark.createDataFrame(ROWS, "k long, s string, x double, m array<int>").selectExpr("k", "s", "x", "transform(m, v -> double(v)) AS m", "s AS keep", "s AS out")
    return typed(df.cache(), FIELDS, id_column="k")


LEAVES = [
    {"matchall": True}, {"matchnothing": True}, None, {}, {"field": ["s", "is", ["a", "c"]]}, {"field": ["s", "is", "b"]}, {"field": ["k", "is", [3, "4", 17]]},
    {"field": ["x", "range", [1, 5]]}, {"field": ["m", "range", [2, 3]]}, {"field": ["unknown", "is", "a"]}, {"meta": ["empty", "x"]}, {"meta": ["exists", ["s"]]},
]


def plain(q, row):
    """(match, weight) of one row."""
    k, s, x, m = row
    if not q:
        return False, 0.0
    ((kind, body),) = q.items()
    if kind in ("matchall", "matchnothing"):
        return kind == "matchall", 0.0
    if kind == "meta":
        value = {"x": x, "s": s}[body[1] if isinstance(body[1], str) else body[1][0]]
        return (value is None) == (body[0] == "empty"), 0.0
    if kind == "field":
        name, how, value = body
        if how == "is":
            mine = {"s": s, "k": str(k)}.get(name)
            return mine is not None and mine in [str(v) for v in (value if isinstance(value, list) else [value])], 0.0
        values = {"x": [x] if x is not None else [], "m": m or []}[name]
        hit = any(value[0] <= v <= value[1] for v in values)
        return hit, float(hit)
    if kind == "scale":
        hit, w = plain(body["query"], row)
        return hit, w * body["factor"]
    found = [plain(x, row) for x in body]
    hits, total = [h for h, _ in found], sum(w for h, w in found if h)
    if kind == "and":
        return all(hits) and bool(hits), total
    if kind == "or":
        return any(hits), total
    if kind == "xor":
        return sum(hits) % 2 == 1, total
    if kind == "and_not":
        return hits[0] and not any(hits[1:]), found[0][1]
    if kind == "filter":
        return all(hits), found[0][1]
    return hits[0], total


def trees():
    leaf = st.sampled_from(LEAVES)
    return st.recursive(
        leaf,
        lambda q: st.one_of(
            st.builds(lambda kind, qs: {kind: qs}, st.sampled_from(["and", "or", "xor"]), st.lists(q, max_size=3)),
            st.builds(lambda kind, qs: {kind: qs}, st.sampled_from(["and_not", "and_maybe", "filter"]), st.lists(q, min_size=2, max_size=3)),
            st.builds(lambda x, f: {"scale": {"query": x, "factor": f}}, q, st.sampled_from([0.0, 0.5, 3.0])),
        ),
        max_leaves=6,
    )


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture], derandomize=True)
@given(q=trees())
def test_trees_equal_a_plain_evaluator(source, q):
    got = {r["k"]: r["_score"] for r in Search(source, {"query": q}).matches.select("k", "_score").collect()}
    want = {row[0]: w for row in ROWS for hit, w in [plain(q, row)] if hit}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def keys(source, **request):
    return [r["k"] for r in Search(source, {"query": {"matchall": True}, **request}).page().collect()]


def test_order_and_missing_values_last(source):
    by = lambda row, sign: (row[2] is None, sign * (row[2] or 0), row[0])
    assert keys(source, order_by=[{"field": "x"}], size=-1) == [r[0] for r in sorted(ROWS, key=lambda r: by(r, 1))]
    assert keys(source, order_by=[{"field": "x", "ascending": False}], size=-1) == [r[0] for r in sorted(ROWS, key=lambda r: by(r, -1))]
    first = lambda row: (row[3] is None, -min(row[3] or [0]), row[0])  # noqa: E731  the smallest value, whatever the direction
    assert keys(source, order_by=[{"field": "m", "ascending": False}], size=-1) == [r[0] for r in sorted(ROWS, key=first)]
    assert keys(source, order_by=[{"field": "unknown"}]) == list(range(10))


def test_pages(source):
    assert keys(source) == list(range(10)) and keys(source, **{"from": 35}) == [35, 36, 37, 38, 39] and keys(source, size=0) == []
    order = [r[0] for r in sorted(ROWS, key=lambda r: (r[2] is None, r[2] or 0, r[0]))]
    at = order.index(13)
    for shift in (-3, 0, 4):
        spec = {"type": "default", "id": 13, "from": shift}
        assert keys(source, order_by=[{"field": "x"}], fromdoc=spec, size=5) == order[max(0, at + shift) : max(0, at + shift) + 5]
    with pytest.raises(UnknownNameError):
        keys(source, fromdoc={"type": "default", "id": 99})
    with pytest.raises(InvalidValueError):
        keys(source, fromdoc={"type": "default", "id": 13}, **{"from": 2})


def test_response(source):
    request = {"query": {"field": ["x", "range", [1, 5]]}, "display": ["s", "none"], "size": 2, "info": [{"facet_count": {"field": "s"}}, {"unknown": {}}, {"facet_count": {"field": "none"}}], "verbose": True}
    out = Search(source, request).to_dict()
    want = [r for r in ROWS if r[2] is not None and 1 <= r[2] <= 5]
    assert out["matches_estimated"] == out["matches_lower_bound"] == len(want) and out["total_docs"] == 40 and out["size_requested"] == 2
    assert out["items"] == [{"s": r[1]} for r in want[:2]] and "query_description" in out
    seen = [r[1] for r in want if r[1]]
    counts = sorted({(-seen.count(s), s) for s in seen})
    assert out["info"][0] == {"type": "facet_count", "fieldname": "s", "docs_seen": len(want), "values_seen": len(seen), "counts": [[s, -n] for n, s in counts]}
    assert out["info"][1] == {"type": "facet_count", "fieldname": "none", "docs_seen": 0, "values_seen": 0, "counts": []}


@pytest.mark.parametrize(
    "query",
    [
        {"field": ["s", "range", [1, 2]]}, {"field": ["keep", "is", "a"]}, {"field": ["out", "is", "a"]}, {"field": ["x", "range", [1]]}, {"field": ["s"]}, {"unknown": 1}, {"matchall": False},
        {"and": [{"matchall": True}], "or": []}, {"and_not": [{"matchall": True}]}, {"scale": {"query": {"matchall": True}, "factor": -1}}, {"field": ["x", "range", ["a", "b"]]}, {"meta": ["no", None]},
    ],
)
def test_wrong_queries(source, query):
    with pytest.raises(InvalidValueError):
        Search(source, {"query": query})


@pytest.mark.parametrize("request_", [{"from": -1}, {"size": "x"}, {"order_by": [{"field": "x"}, {"score": "weight"}, {"field": "s"}]}, {"order_by": {"field": "x"}}, {"order_by": [{"score": "weight", "ascending": True}]}])
def test_wrong_requests(source, request_):
    with pytest.raises(InvalidValueError):
        Search(source, {"query": {"matchall": True}, **request_})


def test_the_filter_can_stand_beside_the_query(source):
    q = {"query": {"field": ["x", "range", [1, 5]]}, "filter": {"field": ["s", "is", "a"]}}
    assert Search(source, {"query": q}).count() == sum(r[1] == "a" and r[2] in (1.0, 5.0) for r in ROWS)
