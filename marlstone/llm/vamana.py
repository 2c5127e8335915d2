"""Nearest neighbours by inner product from robust-pruned directed graphs, one for each shard.

As in DiskANN's Vamana (Subramanya et al.): a point is inserted by a greedy search for it, and keeps from
the points met on the way those that relaxed distance pruning leaves (a candidate goes if a nearer kept
one is ``ALPHA`` times nearer to it than the point is); edges back are added and pruned where they overflow.
Points are inserted in batches that double in size, each search stepping all queries of a batch at once.

Shards hold vectors of one length, of norms within a factor of ``RATIO`` and of near directions, and a graph is one
over directions: within a shard the largest inner products are near the largest cosines, so a beam search by
cosine meets them. What it meets is scored exactly, in double precision, on the original vectors. (A graph
over points lifted to equal length, the usual reduction, loses most neighbours where norms vary.)

Routing drops nothing but what cannot matter: a cell's centre, covering angle and largest norm, measured on all of
its members, bound every inner product with them. A query first searches the cell of the largest bound,
and then every other cell whose bound reaches the k-th best score found there. Where neither norms nor directions
have structure, that is every shard, and the work grows with queries times shards.

All rows are indexed: identical vectors stand once in a graph, with the k + 1 smallest ids, the only ones
that can be in a result. Cells come from a bounded sample (``SAMPLE`` vectors), at most ``CELLS`` of them, so what
every task gets of them is bounded; cells that hold more than a graph may are dealt by hash into several graphs.
A shard is copied once for each block of ``BLOCK`` queries that visit it, so the copies weigh about what the
visits do. The driver gets one row for each vector length and norm band, cell and shard.

Recall at 20 of Gaussian vectors of 64 dimensions, the hardest kind (no structure), measured in
``tests/llm/test_vamana.py``: 0.977 in one shard of 20,000 of length 1, 0.965 in one whose norms fill a band, 1.000 over
the bands of 20,000 vectors with norms from 0.5 to 3.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without
vec_id, take no part; only vectors of a query's length are its candidates; ties go to the smaller vec_id; a
query's own vec_id is no candidate; with fewer candidates than k, all are returned. Rows that share a vec_id but not the vector
are searched and found by each of their vectors; a result lists a vec_id once, with its largest score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .vectors import as_bytes, matrix

DEGREE, BEAM, ALPHA = 32, 80, 1.2
#: The beam of a query. A shard of no more points is scanned.
WIDE = 160
#: Vectors of a graph at most, and queries of a block (fewer of long vectors: MEGABYTES of them); a table is dealt
#: into SHARDS graphs or more unless they would hold fewer than LEAST vectors.
MOST, BLOCK, MEGABYTES = 20_000, 1 << 14, 64
SHARDS, LEAST = 12, 2048
#: Norms of a shard differ by this factor at most. Vectors that make cells, and cells at most.
RATIO, SAMPLE, CELLS = 1.25, 1 << 16, 8192
STEP = 4  # nodes of a beam that are expanded at a time


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points scaled to length 1 in single precision, and the logarithms of their lengths."""
    top = np.abs(x).max(axis=1)
    x = x / top[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return (x / norm[:, None]).astype(np.float32), np.log(norm) + np.log(top)


def greedy(x: np.ndarray, norm: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int):
    """Beams (ids and squared distances, nearest first) and the nodes expanded, for a batch of queries."""
    n, rows = len(q), np.arange(len(q))
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    qn = np.einsum("ij,ij->i", q, q)
    dist[:, 0] = norm[entry] + qn - 2 * (q @ x[entry])
    trail = []
    live = rows
    while len(live):
        part = done[live]
        order = np.argsort(part, axis=1, kind="stable")[:, :STEP]  # the nearest that aren't expanded
        at = ids[live[:, None], order]
        fresh = ~np.take_along_axis(part, order, 1)
        done[live[:, None], order] = True
        at[~fresh] = -1
        trail.append((live, at))
        near = edges[at].reshape(len(live), -1)
        near[np.repeat(at < 0, edges.shape[1], axis=1)] = -1
        ok = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(ok, near, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        width = int((near >= 0).sum(axis=1).max(initial=0))
        near.sort(axis=1)
        near = near[:, near.shape[1] - width :]
        ok = near >= 0
        seen[np.repeat(live, width)[ok.ravel()], near[ok]] = True
        d = norm[near] + qn[live][:, None] - 2 * np.einsum("ijk,ik->ij", x[near], q[live])
        d[~ok] = np.inf
        all_d = np.concatenate((dist[live], d), axis=1)
        all_i = np.concatenate((ids[live], near), axis=1)
        all_e = np.concatenate((done[live], ~ok), axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.take_along_axis(all_i, order, 1)
        done[live] = np.take_along_axis(all_e, order, 1) | ~np.isfinite(dist[live])
        live = live[~done[live].all(axis=1)]
    return ids, dist, trail


def pruned(x: np.ndarray, norm: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse candidates of each point's pool (-1: none)."""
    pool = np.where(pool == points[:, None], -1, pool)
    pool.sort(axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    v = x[pool]
    to = norm[pool] + norm[points][:, None] - 2 * np.einsum("ijk,ik->ij", v, x[points])
    to = np.where(pool < 0, np.inf, np.maximum(to, 0))
    out = np.full((len(points), degree), -1, np.int64)
    rows, left = np.arange(len(points)), to.copy()
    for k in range(degree):
        pick = left.argmin(axis=1)
        some = np.isfinite(left[rows, pick])
        if not some.any():
            break
        out[some, k] = pool[rows, pick][some]
        s = v[rows, pick]
        gap = norm[pool] + norm[pool[rows, pick]][:, None] - 2 * np.einsum("ijk,ik->ij", v, s)
        left[(alpha * alpha * gap <= to) & some[:, None]] = np.inf
        left[rows, pick] = np.inf
    return out


def graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and the entry point."""
    n = len(x)
    norm = np.einsum("ij,ij->i", x, x)
    entry = int((norm - 2 * (x @ x.mean(axis=0))).argmin())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    lo = 1
    while lo < n:
        batch = order[lo : lo + min(512, max(1, lo))]
        lo += len(batch)
        ids, _, trail = greedy(x, norm, edges, entry, x[batch], beam)
        steps = np.full((len(batch), STEP * len(trail)), -1, np.int64)
        for i, (live, at) in enumerate(trail):
            steps[live, i * STEP : (i + 1) * STEP] = at
        steps = steps[:, (steps >= 0).any(axis=0)]
        pool = np.concatenate((ids, steps), axis=1)
        edges[batch] = pruned(x, norm, batch, pool, degree, alpha)
        src = np.repeat(batch, degree)
        dst = edges[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(count.max())
        extra = np.full((len(heads), most), -1, np.int64)
        extra[np.repeat(np.arange(len(heads)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        have = (edges[heads] >= 0).sum(axis=1)
        over = have + count > degree
        for h, e, k, c in zip(heads[~over].tolist(), extra[~over], have[~over].tolist(), count[~over].tolist(), strict=True):
            edges[h, k : k + c] = e[:c]
        many = np.flatnonzero(over)
        for at in range(0, len(many), 512):
            pick = many[at : at + 512]
            pool = np.concatenate((edges[heads[pick]], extra[pick]), axis=1)
            edges[heads[pick]] = pruned(x, norm, heads[pick], pool, degree, alpha)
    return edges, entry


def centres(x: np.ndarray, most: int, rounds: int = 4) -> np.ndarray:
    """Directions of up to ``most`` cells of a sample of directions (spherical k-means)."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(11)
    x = x[rng.permutation(len(x))[: 32 * most]]
    c = x[:most]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros(c.shape, np.float64)
        np.add.at(total, own, x)
        size = np.sqrt(np.einsum("ij,ij->i", total, total))
        c = np.where(size[:, None] > 1e-6, total / np.maximum(size, 1e-6)[:, None], c).astype(np.float32)
    return c


def _banded(batches):
    for pdf in batches:
        if len(pdf):
            pdf["band"] = 0
            for _, rows in pdf.groupby("dim").groups.items():
                _, size = directions(matrix(pdf.loc[rows, "v"]))
                pdf.loc[rows, "band"] = np.rint(size / np.log(RATIO)).astype(int)
            yield pdf.astype({"band": "int32"})


def _celled(cells: dict):
    """Each vector's cell (its number), the cosine to the cell's centre, and the logarithm of its length."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                pdf["cell"], pdf["near"], pdf["size"] = 0, 1.0, 0.0
                for key, rows in pdf.groupby(["dim", "band"]).groups.items():
                    u, size = directions(matrix(pdf.loc[rows, "v"]))
                    first, c = cells[tuple(map(int, key))]
                    cos = u @ c.T
                    at = cos.argmax(axis=1)
                    pdf.loc[rows, "cell"] = first + at
                    pdf.loc[rows, "near"] = cos[np.arange(len(at)), at].astype(float)
                    pdf.loc[rows, "size"] = size
                yield pdf.astype({"cell": "int32"})

    return run


class Router:
    """All cells: lengths of their vectors, centres, covering angles, largest norms, and their shards."""

    def __init__(self, cells: dict, measured: dict, parts: dict):
        self.by_dim = {}
        for dim in {d for d, _ in cells}:
            number, centre = [], []
            for (d, _), (first, c) in sorted(cells.items()):
                if d == dim:
                    used = [i for i in range(len(c)) if first + i in measured]
                    number += [first + i for i in used]
                    centre.append(c[used])
            angle = np.arccos(np.clip([measured[n][0] for n in number], -1, 1)) + 1e-3  # single precision
            size = np.array([measured[n][1] for n in number])
            shards = [parts[n] for n in number]
            self.by_dim[dim] = (np.concatenate(centre), angle, size, shards)

    def visits(self, dim: int, q: np.ndarray, reach: np.ndarray | None):
        """Pairs of queries and shards: the cell of the largest bound, or (with the scores to reach)
        all others whose bound reaches them."""
        centre, angle, size, shards = self.by_dim[dim]
        u, norm = directions(q)
        away = np.arccos(np.clip(u @ centre.T, -1, 1))
        cos = np.cos(np.clip(away - angle, 0, np.pi)).astype(float)
        with np.errstate(over="ignore"):
            bound = np.where(cos > 0, np.exp(size[None, :] + norm[:, None]) * cos * (1 + 1e-9), 0)
        rows = np.arange(len(q))
        home = np.lexsort((away, -bound), axis=1)[:, 0]
        if reach is None:
            pairs = zip(rows.tolist(), home.tolist(), strict=True)
        else:
            hit = bound >= np.where(np.isnan(reach), -np.inf, reach)[:, None]
            hit[rows, home] = False
            pairs = zip(*(x.tolist() for x in np.nonzero(hit)), strict=True)
        return [(i, s) for i, c in pairs for s in range(shards[c][0], shards[c][0] + shards[c][1])]


def _visiting(router: Router):
    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if int(dim) not in router.by_dim:
                    continue
                for lo in range(0, len(part), 256):
                    some = part.iloc[lo : lo + 256].reset_index(drop=True)
                    reach = some["reach"].to_numpy(float) if "reach" in some else None
                    pairs = router.visits(int(dim), matrix(some["v"]), reach)
                    for at in range(0, len(pairs), 4096):
                        row, shard = map(list, zip(*pairs[at : at + 4096], strict=True))
                        chosen = some.iloc[row]
                        yield pd.DataFrame({"query_id": chosen["query_id"].to_numpy(), "v": chosen["v"].to_numpy(), "shard": np.array(shard, np.int32)})

    return run


def _indexed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h1", "h2"]).reset_index(drop=True)
    if len(pdf) > WIDE:
        edges, entry = graph(directions(matrix(pdf["v"]))[0])
    else:
        edges, entry = np.full((len(pdf), 1), -1), 0
    at = np.arange(len(pdf))
    return pd.DataFrame({"shard": pdf["shard"], "at": at, "v": pdf["v"], "ids": pdf["ids"], "edges": [e[e >= 0] for e in edges], "entry": at == entry})


def best(raw: np.ndarray, q: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """For each query the points that a beam search meets last (all points of a small shard); -1 for none."""
    if len(raw) <= beam:
        return np.tile(np.arange(len(raw)), (len(q), 1))
    u, v = directions(raw)[0], directions(q)[0]
    return greedy(u, np.ones(len(u), np.float32), edges, entry, v, beam)[0]


def _searched(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(queries):
            index = index.sort_values("at")
            raw, q = matrix(index["v"]), matrix(queries["v"])
            edges = np.full((len(raw), DEGREE), -1, np.int64)
            for i, e in enumerate(index["edges"]):
                edges[i, : len(e)] = e
            entry = int(index["entry"].to_numpy().argmax())
            copies = index["ids"].tolist()
            for lo in range(0, len(q), 512):
                part = q[lo : lo + 512]
                ids = best(raw, part, edges, entry, max(WIDE, 2 * k))
                for own, v, near in zip(queries["query_id"].iloc[lo : lo + 512].tolist(), part, ids, strict=True):
                    near = near[near >= 0]
                    score = (raw[near] * v).sum(axis=1)
                    found: dict[int, float] = {}
                    for i in np.argsort(-score, kind="stable"):
                        if len(found) > k and score[i] < last:
                            break
                        for c in copies[near[i]]:
                            if c != own:
                                found.setdefault(c, score[i])
                        last = score[i]
                    for s, c in sorted((-s, c) for c, s in found.items())[:k]:
                        out["query_id"].append(own)
                        out["vec_id"].append(c)
                        out["score"].append(-s)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _rows(dim: int, most: int) -> int:
    """How many vectors of ``dim`` bytes a task holds."""
    return max(256, min(most, (MEGABYTES << 20) // dim))


def nearest(table: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of ``table(vec_id, embedding)`` to each row that ``queries`` (a condition on
    vec_id) marks: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    known = as_bytes(table, unit=False).where("v is not null and vec_id is not null")
    known = written(known.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1)), "dim": F.length("v")}), "vectors")
    by = Window.partitionBy("h1", "h2", "dim").orderBy("vec_id")
    first = known.select("vec_id", "h1", "h2", "dim", "v").distinct().withColumn("copy", F.row_number().over(by)).where(F.col("copy") <= k + 1)
    distinct = first.groupBy("dim", "h1", "h2").agg(F.min(F.struct("vec_id", "v"))["v"].alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kinds = "dim int, h1 long, h2 long, v binary, ids array<long>"
    distinct = written(distinct.mapInPandas(_banded, f"{kinds}, band int"), "distinct")

    groups = {(r["dim"], r["band"]): r["n"] for r in distinct.groupBy("dim", "band").agg(F.count("*").alias("n")).collect()}
    want = {(d, b): max(-(-n // _rows(d, MOST)), min(SHARDS, -(-n // LEAST))) for (d, b), n in groups.items()}
    longest = max((d for d, _ in groups), default=8)
    allowed = max(1, min(CELLS, (MEGABYTES << 20) // longest) // max(1, len([g for g in want if want[g] > 1])))
    share = min(1.0, min(SAMPLE, (MEGABYTES << 20) // longest) / max(1, sum(groups.values())))
    taken: dict = {}
    if any(n > 1 for n in want.values()):
        draw = F.shiftrightunsigned(F.xxhash64("h1", F.lit(3)), 11) / float(1 << 53)
        for r in distinct.where(draw < share).select("dim", "band", "v").collect():
            taken.setdefault((r["dim"], r["band"]), []).append(r["v"])
    cells, at = {}, 0
    for g in sorted(groups):
        if want[g] > 1 and g in taken:
            c = centres(directions(matrix(taken[g]))[0], min(want[g], allowed))
        else:
            c = np.zeros((1, g[0] // 8), np.float32)
            c[0, 0] = 1
        cells[g] = (at, c)
        at += len(c)
    placed = distinct.mapInPandas(_celled(cells), f"{kinds}, band int, cell int, near double, size double")
    placed = written(placed, "placed")
    rows = placed.groupBy("cell", "dim").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.max("size").alias("size")).collect()
    parts, shards = {}, 0
    for r in sorted(rows, key=lambda r: r["cell"]):
        parts[r["cell"]] = (shards, -(-r["n"] // _rows(r["dim"], MOST)))
        shards += parts[r["cell"]][1]
    router = Router({g: c for g, c in cells.items()}, {r["cell"]: (r["near"], r["size"]) for r in rows}, parts)
    plan = spark.createDataFrame([(c, *p) for c, p in parts.items()], "cell int, first int, parts int")
    sharded = placed.join(F.broadcast(plan), "cell").withColumn("shard", (F.col("first") + F.pmod("h1", F.col("parts"))).cast("int"))
    index = sharded.groupBy("shard").applyInPandas(_indexed, "shard int, at int, v binary, ids array<long>, edges array<int>, entry boolean")
    index = written(index, "graphs")
    block = _rows(longest, BLOCK)

    def searched(asked: DataFrame) -> DataFrame:
        visits = asked.mapInPandas(_visiting(router), "query_id long, v binary, shard int")
        counts = visits.groupBy("shard").agg(F.count("*").alias("n")).collect()
        blocks = spark.createDataFrame([(r["shard"], -(-r["n"] // block)) for r in counts], "shard int, blocks int")
        own = F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")).cast("int").alias("block")
        visits = visits.join(F.broadcast(blocks), "shard").select("query_id", "v", "shard", own)
        copies = index.join(F.broadcast(blocks), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        key = ["shard", "block"]
        return copies.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(_searched(k), "query_id long, vec_id long, score double")

    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    asked = known.where(queries).select("dim", F.col("vec_id").alias("query_id"), "v").distinct()
    home = written(searched(asked), "home")
    reach = top(home).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(float("nan")).alias("reach"))
    rest = searched(asked.join(reach, "query_id", "left").select("dim", "query_id", "v", F.coalesce("reach", F.lit(float("nan"))).alias("reach")))
    return top(home.unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
