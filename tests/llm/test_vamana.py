import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import vamana


def brute(rows, k, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            near = sorted((-(w * v).sum(), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = vamana.nearest(df, F.col("vec_id") % every == 0, k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert got.keys() == {q for q, w in want.items() if w}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(1).normal(size=(1500, 24)).astype(np.float32) * np.random.default_rng(2).uniform(0.5, 3, (1500, 1)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    got, want = found(spark, rows), brute(rows, 20)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 20 * len(want)
    exact = {q: dict(w) for q, w in brute(rows, 1500).items()}
    assert all(abs(s - exact[q][i]) < 1e-9 for q in got for i, s in got[q])


def test_few_candidates_ties_and_odd_vectors(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (20, v), (3, v), (2, v), (1, [3.0, 1.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]), (120, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, v), (140, [1.0, 2.0, 3.0])]
    same(found(spark, rows), brute(rows, 20))
    same(found(spark, rows, 2), brute(rows, 2))
    assert found(spark, []) == {}


def test_many_copies(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(300 + i, [1.0, float(i)]) for i in range(50)]
    same(found(spark, rows), brute(rows, 20))


def test_repeated_rows(spark):
    got = found(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])])
    assert got == {0: [(1, 2.0)]}


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [0, 2.1]], np.float32)
    norm = np.einsum("ij,ij->i", x, x)
    kept = vamana.pruned(x, norm, np.array([0]), np.array([[1, 2, 3, 4, 4]]), 4, 1.2)[0]
    assert kept.tolist() == [1, 3, -1, -1]


def test_recall_of_a_full_shard_with_varied_norms():
    """20,000 Gaussian vectors, norms from 0.5 to 3, in the norm bands that ``nearest`` deals them into: what all
    bands' graphs find together, against brute force."""
    n, k = 20_000, 20
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 64))
    x *= (rng.uniform(0.5, 3, n) / np.linalg.norm(x, axis=1))[:, None]
    at = rng.choice(n, 200, replace=False)
    want = np.argsort(-(x[at] @ x.T), axis=1)[:, :k]
    single = x / np.linalg.norm(x, axis=1)[:, None]
    for rows, low in ((x, 0.9), (single, 0.9)):
        u, size = vamana.directions(rows)
        band = np.rint(size / np.log(vamana.RATIO))
        found = [[] for _ in at]
        for b in np.unique(band):
            own = np.flatnonzero(band == b)
            edges, entry = vamana.graph(u[own])
            for f, near in zip(found, vamana.best(rows[own], rows[at], edges, entry, vamana.WIDE), strict=True):
                f += own[near[near >= 0]].tolist()
        want = np.argsort(-(rows[at] @ rows.T), axis=1)[:, :k]
        hits = [len(set(w) & set(sorted(f, key=lambda i, q=q: -(rows[i] @ rows[q]))[:k])) for q, w, f in zip(at, want.tolist(), found, strict=True)]
        recall = sum(hits) / (k * len(at))
        print(f"recall {recall:.3f}")
        assert recall >= low


def test_a_single_graph_of_the_largest_size():
    """One band alone, as full as it may be: the largest shard that production makes."""
    n, k = vamana.MOST, 20
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 64))
    x *= (rng.uniform(1 / vamana.RATIO**0.5, vamana.RATIO**0.5, n) / np.linalg.norm(x, axis=1))[:, None]
    at = rng.choice(n, 200, replace=False)
    edges, entry = vamana.graph(vamana.directions(x)[0])
    near = vamana.best(x, x[at], edges, entry, vamana.WIDE)
    want = np.argsort(-(x[at] @ x.T), axis=1)[:, :k]
    hits = [len(set(w) & set(sorted(f, key=lambda i, q=q: -(x[i] @ x[q]))[:k])) for q, w, f in zip(at, want.tolist(), near.tolist(), strict=True)]
    print(f"recall {sum(hits) / (k * len(at)):.3f}")
    assert sum(hits) >= 0.9 * k * len(at)


def test_routing_loses_nothing(spark, monkeypatch):
    """Clustered vectors of many norms in many cells: visits are fewer than all, and no neighbour is lost to them."""
    monkeypatch.setattr(vamana, "LEAST", 40)
    monkeypatch.setattr(vamana, "MOST", 60)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 900)] + 0.05 * rng.normal(size=(900, 8))
    x *= np.exp(rng.uniform(-2, 2, (900, 1)))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
    same(found(spark, rows, 5), brute(rows, 5))


def test_bounds_hold():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 6)) * np.exp(rng.uniform(-1, 1, (500, 1)))
    u, size = vamana.directions(x)
    c = vamana.centres(u, 9)
    own = (u @ c.T).argmax(axis=1)
    near = {i: (float((u @ c.T)[own == i, i].min()), float(size[own == i].max())) for i in np.unique(own).tolist()}
    router = vamana.Router({(48, 0): (0, c)}, near, {i: (i, 1) for i in near})
    q = rng.normal(size=(40, 6))
    reach = np.sort(q @ x.T, axis=1)[:, -10]
    seen = {(i, s) for i, s in router.visits(48, q, None)} | {(i, s) for i, s in router.visits(48, q, reach)}
    assert all((i, own[j]) in seen for i in range(40) for j in np.flatnonzero(q[i] @ x.T >= reach[i]))
    assert len(seen) < 40 * len(near)


def test_one_id_on_rows_with_different_vectors(spark):
    got = found(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [1.0, 5.0]), (2, [0.5, 0.5]), (20, [1.0, 1.0])])
    assert got[0] == [(1, 5.0), (20, 1.0), (2, 0.5)]
    assert got[20] == [(1, 6.0), (0, 1.0), (2, 1.0)]
