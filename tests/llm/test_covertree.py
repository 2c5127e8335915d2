import numpy as np
import pandas as pd
import pytest

from marlstone.llm import covertree
from marlstone.llm.shared import Union


def brute(rows, cosine):
    """(vec_id, n_links, component_id) by all pairs."""
    ok = {}
    for i, (k, v) in enumerate(rows):
        x = np.array([np.nan if a is None else a for a in v], float) if v else np.zeros(0)
        if k is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = x / np.linalg.norm(x)
    union, links = Union(len(rows)), [0] * len(rows)
    for i in ok:
        for j in ok:
            if i < j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[union.find(i)] = min(k, low.get(union.find(i), k))
    return sorted(((k is None, k or 0), links[i], k if k is None else low[union.find(i)]) for i, (k, _) in enumerate(rows))


def check(spark, rows, cosine=0.95):
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, v string")
    got = covertree.near_vectors(df, cosine).collect()
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in got) == brute(rows, cosine)


def cloud(seed, n, dim, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + noise * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + 20] = x[3]
    x[n - 10 :] *= rng.uniform(0.1, 100, (10, 1))
    return x.astype(np.float32)


@pytest.mark.parametrize(("noise", "cosine"), [(0.15, 0.95), (0.3, 0.95), (1.0, 0.5)])
def test_equals_all_pairs(spark, noise, cosine):
    x = cloud(1, 300, 16, noise)
    check(spark, [(int(i) * 3, [float(a) for a in v]) for i, v in zip(np.random.default_rng(2).permutation(300), x, strict=True)], cosine)


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "ROWS", 40)
    monkeypatch.setattr(covertree, "MOST", 40)
    x = cloud(5, 400, 8, 0.2)
    check(spark, [(i, [float(a) for a in v]) for i, v in enumerate(x)])


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (4, [2.0, 4.0, 6.0]), (3, None), (2, []), (1, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [float("inf"), 2.0, 3.0]), (9, [1.0, 2.0]), (10, [-1.0, -2.0, -3.0]), (None, v)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None)])


def test_repeated_rows_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in covertree.near_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_one_id_on_rows_with_different_vectors(spark):
    v, w = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    near = lambda x: [x[0], x[1], 0.15]
    check(spark, [(1, v), (1, w), (2, near(v)), (3, near(w)), (4, near(w)), (1, [1.0, 0.1]), (5, [1.0, 0.12])])


@pytest.mark.parametrize(("cells", "depth", "fan"), [(1, 12, 32), (200, 12, 3), (40, 2, 4)])
def test_blocks_of_one_cell_and_deep_cells(spark, monkeypatch, cells, depth, fan):
    """Cells that may not grow have many blocks, some of them empty; cells that may are split again and again."""
    for name, value in (("ROWS", 6), ("MOST", 6), ("CELLS", cells), ("DEPTH", depth), ("FAN", fan), ("FINE", 2 if depth > 2 else 64)):
        monkeypatch.setattr(covertree, name, value)
    x = cloud(8, 120, 5, 0.1)
    check(spark, [(i, [float(a) for a in v]) for i, v in enumerate(x)])


def test_dense_groups_are_counted_whole(spark, monkeypatch):
    """A third of all vectors within eps of each other, and as many spread about; no pair is lost or counted twice."""
    monkeypatch.setattr(covertree, "ROWS", 50)
    monkeypatch.setattr(covertree, "MOST", 50)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=6) + 0.02 * rng.normal(size=(150, 6)), rng.normal(size=(150, 6)), rng.normal(size=6) + 0.12 * rng.normal(size=(100, 6))])
    check(spark, [(i, [float(a) for a in v]) for i, v in zip(rng.permutation(400).tolist(), x, strict=True)])


def test_a_leaf_that_eps_covers_is_not_compared():
    rng = np.random.default_rng(10)
    x = np.array([1.0, 2, 3]) + 0.01 * rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.Tree(pd.DataFrame({"rep": np.arange(60), "n": 1, "v": [v.tobytes() for v in x]}))
    assert any(linked is None for _, _, linked in covertree.traverse(tree, tree, 0.95))


def test_exchange_grows_with_the_rows_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(covertree, "ROWS", 200)
    monkeypatch.setattr(covertree, "MOST", 200)
    rng, visits = np.random.default_rng(11), []
    for n in (3000, 15000):
        centres = rng.normal(size=(n // 50, 16))
        x = centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
        own = spark.createDataFrame([(i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "rep long, n long, v binary")
        eps = float(np.sqrt(0.1))
        cells, now = covertree._grown(own, 16, eps, 200, covertree.CELLS)
        packs, members = cells.packs(200)
        assert sum(map(len, members.values())) == len(set(c for m in members.values() for c in m))
        assert all(sum(cells.size[c] for c in m) <= 200 or (len(m) == 1 and 2 * cells.radius[m[0]] <= eps) for m in members.values())
        visits.append(n + now.mapInPandas(covertree._visit(cells.packed(), packs, eps), "rep long, n long, v binary, pack long").count())
    print("rows sent", visits)
    assert visits[1] <= visits[0] * 5**1.1
