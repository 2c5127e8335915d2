import random

import pytest

from marlstone.errors import InvalidValueError
from marlstone.operators.taxonomy import Taxonomy, closure


def _line(t, c):
    v = t.view(c)
    return ":".join(",".join(v[k]) for k in ("parents", "ancestors", "children", "descendants"))


def test_closure_of_a_chain():
    t = Taxonomy()
    assert t.add_parent("cat0", "cat1") == {"cat0", "cat1"}
    t.add_parent("cat1", "cat2")
    assert [_line(t, c) for c in ("cat0", "cat1", "cat2")] == ["cat1:cat1,cat2::", "cat2:cat2:cat0:cat0", "::cat1:cat0,cat1"]
    t.remove("cat1")
    assert [_line(t, c) for c in ("cat0", "cat2")] == [":::", ":::"]


def test_cycles_are_refused():
    t = Taxonomy({"a": ["b"], "b": ["c"]})
    for pair in (("c", "a"), ("b", "a"), ("a", "a")):
        with pytest.raises(InvalidValueError):
            t.add_parent(*pair)
    assert t.to_json() == {"a": ["b"], "b": ["c"], "c": []}
    assert Taxonomy(t.to_json()).to_json() == t.to_json()
    assert t.top() == {"c": {"child_count": 1, "descendant_count": 2}} and t.is_parent("a", "b")


def test_random_edits_keep_the_closure():
    rng, t = random.Random(42), Taxonomy()
    names = [f"c{i}" for i in range(20)]
    for _ in range(200):
        a, b, kind = rng.choice(names), rng.choice(names), rng.random()
        before = {c: t.view(c) for c in t.parents}
        try:
            changed = t.add(a) if kind < 0.15 else t.add_parent(a, b) if kind < 0.7 else t.remove_parent(a, b) if kind < 0.85 else t.remove(a)
        except InvalidValueError:
            assert a == b or a in t.ancestors(b)
            continue
        after = {c: t.view(c) for c in t.parents}
        assert changed == {c for c in before.keys() | after.keys() if before.get(c) != after.get(c)}
        for c, v in after.items():
            assert c not in v["ancestors"]
            assert set(v["ancestors"]) == set(v["parents"]) | {x for p in v["parents"] for x in after[p]["ancestors"]}
            assert all(c in after[p]["children"] for p in v["parents"]) and all(c in after[d]["ancestors"] for d in v["descendants"])


def test_closure_table(spark):
    t = Taxonomy({"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["e"]})
    got = {(r["category"], r["ancestor"]) for r in closure(t.edges(spark)).collect()}
    assert got == {(c, x) for c in t.parents for x in t.ancestors(c)}
