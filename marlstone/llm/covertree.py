"""Exact pairs of vectors above a cosine, by dual traversal of cover trees.

On unit vectors, a cosine of at least t is a distance of at most eps = sqrt(2 - 2t). A tree's levels are
nested nets whose radii halve from level to level; every node knows its covering radius, the distance to
its farthest descendant. Two nodes can hold a pair only if their centres are no farther apart than eps and
both radii, and hold nothing but pairs if centres and radii together stay within eps.

The upper levels are cells: one that is wider than eps, or holds more vectors than a task takes, is split at
centres from a bounded sample of it, again and again, so that cells grow in number with the table; radii are
measured on all vectors. Tasks take packs of cells, as many as fit into one. A vector is traversed against
the cells: it visits the packs of those that a link of it can be in, by their covering radii, and since every
vector went to the nearest of sibling centres, only of those no more than 2 eps farther than the nearest sibling.
A pack then joins its own vectors, and those with its visitors from packs of smaller numbers, in blocks, each pair
of blocks in one task that builds the lower levels of both trees. In a pack that eps covers all are linked, and
nothing is compared. A task gives back link counts and a spanning forest, never pairs, so a large group of near
copies costs rows in proportion to its size. Identical vectors are collapsed first.

Only vectors that lie within eps of another pack's cells are sent more than once, so the exchange grows with the
rows of clustered vectors. Where vectors have no cluster structure nothing can be pruned above single vectors, and
all blocks meet each other: exact joins of such data are quadratic, spread over all tasks. The centres of at most
``CELLS`` cells (MEGABYTES of them) are sent to the tasks; beyond that, cells have several blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; every row is a vector of its own, so repeated rows link with each
other; a null vec_id has a null component and is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Union, components, dropped, with_groups, written
from .vectors import as_bytes, matrix

#: Vectors of a sample that splits a cell, children of a cell, cells, and levels of cells at most.
SAMPLE, FAN, CELLS, DEPTH = 1024, 32, 1 << 14, 12
#: Cells of so few vectors aren't split for being wide.
FINE = 16
#: Vectors of a block, at least and at most (fewer of long vectors), and megabytes of a block or of all centres.
ROWS, MOST, MEGABYTES = 8192, 32768, 64
#: Radii of the lower trees' nets from the finest up.
FINEST, SAFE = 0.25, 1e-4


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres (indexes) no two of which are within radius, and each point's centre within radius."""
    least = 1 - radius * radius / 2
    x32 = x.astype(np.float32)
    centres: list[int] = []
    of = np.full(len(x), -1, np.int64)
    for lo in range(0, len(x), 512):
        part = x32[lo : lo + 512]
        if centres:
            c = np.array(centres)
            cos = part @ x32[c].T
            near = cos.argmax(axis=1)
            ok = cos[np.arange(len(part)), near] >= least
            of[lo : lo + 512][ok] = c[near[ok]]
        own = part @ part.T
        for i in np.flatnonzero(of[lo : lo + 512] < 0):
            if of[lo + i] < 0:
                centres.append(lo + i)
                left = of[lo : lo + 512]
                left[(left < 0) & (own[i] >= least)] = lo + i
                left[i] = lo + i
    return np.array(centres, np.int64), of


def levels(x: np.ndarray) -> list[np.ndarray]:
    """For the levels from the finest up, each point's node (the index of its centre)."""
    out, radius = [], FINEST
    centres, of = net(x, radius)
    out.append(of)
    while len(centres) > 64:
        radius *= 2
        upper, up = net(x[centres], radius)
        if radius >= 2 or len(upper) > 0.5 * len(centres):
            break
        place = np.full(len(x), -1, np.int64)
        place[centres] = centres[up]
        out.append(place[out[-1]])
        centres = centres[upper]
    return out


class Tree:
    """One block: unit vectors, their nodes on each level, covering radii."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("rep")
        self.x = matrix(pdf["v"])
        self.x32 = self.x.astype(np.float32)
        self.rep, self.n = pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        self.levels = []  # from the coarsest down: nodes, radii, members of each (points at the end)
        for of in reversed(levels(self.x)):
            node, inverse = np.unique(of, return_inverse=True)
            gap = np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.x, self.x[of]))
            radius = np.zeros(len(node))
            np.maximum.at(radius, inverse, np.sqrt(gap))
            self.levels.append((node, radius, inverse))

    def below(self, k: int) -> list[np.ndarray]:
        """For each node of level k, its nodes on level k + 1 (or its points, below the finest)."""
        inverse = self.levels[k][2]
        if k + 1 < len(self.levels):
            child = self.levels[k + 1][2]
            _, first = np.unique(child, return_index=True)
            inverse = inverse[first]
        order = np.argsort(inverse, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(inverse[order])) + 1)


def _near(a: Tree, b: Tree, ka: int, kb: int, rows: np.ndarray, cols: np.ndarray, eps: float) -> np.ndarray:
    na, ra, _ = a.levels[ka]
    nb, rb, _ = b.levels[kb]
    cos = a.x32[na[rows]] @ b.x32[nb[cols]].T
    far = eps + ra[rows][:, None] + rb[cols][None, :] + SAFE
    return np.argwhere(cos >= 1 - far * far / 2)


def traverse(a: Tree, b: Tree, cosine: float):
    """``(points of a, points of b, links as a matrix)`` of leaf pairs that may hold links; None for the matrix
    where every pair is a link (of a leaf with itself: every pair of different points)."""
    eps = float(np.sqrt(2 - 2 * cosine))
    depth = max(len(a.levels), len(b.levels))
    pairs = None
    for k in range(depth):
        ka, kb = (max(0, k - depth + len(t.levels)) for t in (a, b))
        if pairs is None:
            rows, cols = np.arange(len(a.levels[ka][0])), np.arange(len(b.levels[kb][0]))
            found = [_near(a, b, ka, kb, rows[lo : lo + 1024], cols, eps) + [lo, 0] for lo in range(0, len(rows), 1024)]
        else:
            da = a.below(ka - 1) if k > depth - len(a.levels) else None
            db = b.below(kb - 1) if k > depth - len(b.levels) else None
            found = []
            for i, js in _by_first(pairs):
                rows = da[i] if da is not None else np.array([i])
                cols = np.concatenate([db[j] for j in js]) if db is not None else js
                hit = _near(a, b, ka, kb, rows, cols, eps)
                found.append(np.stack([rows[hit[:, 0]], cols[hit[:, 1]]], axis=1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pa_, pb_ = a.below(len(a.levels) - 1), b.below(len(b.levels) - 1)
    (na, ra, _), (nb, rb, _) = a.levels[-1], b.levels[-1]
    same = a is b
    for i, js in _by_first(pairs):
        rows = pa_[i]
        near = eps - ra[i] - rb[js] - SAFE
        whole = (near > 0) & (a.x32[na[i]] @ b.x32[nb[js]].T >= 1 - near * near / 2 + 1e-6)
        if same:
            whole &= js != i
            if 2 * ra[i] <= eps - SAFE:
                whole |= js == i
        for j in js[whole]:
            if not (same and i == j and len(rows) == 1):
                yield rows, pb_[j], None
        if whole.all():
            continue
        cols = np.concatenate([pb_[j] for j in js[~whole]])
        if same and len(rows) == len(cols) == 1 and rows[0] == cols[0]:
            continue
        for lo in range(0, len(rows), 2048):
            for at in range(0, len(cols), 2048):
                r, c = rows[lo : lo + 2048], cols[at : at + 2048]
                linked = a.x[r] @ b.x[c].T >= cosine
                if same:
                    linked &= r[:, None] != c[None, :]
                if linked.any():
                    yield r, c, linked


def _by_first(pairs: np.ndarray):
    if len(pairs):
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        cut = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        for part in np.split(pairs, cut):
            yield int(part[0, 0]), part[:, 1]


def _lowered(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component (its smallest row) of each row and column that has a link; -1 for the others."""
    big = linked.shape[0]
    row, col = np.arange(big), np.full(linked.shape[1], big)
    while True:
        new_col = np.where(linked, row[:, None], big).min(axis=0)
        new_row = np.minimum(row, np.where(linked, new_col[None, :], big).min(axis=1))
        if np.array_equal(new_row, row) and np.array_equal(new_col, col):
            break
        row, col = new_row, new_col
    return np.where(linked.any(axis=1), row, -1), np.where(col < big, col, -1)


def _joined(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["part"].iloc[0] == 0 and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if not same and pdf["first"].nunique() < 2:  # a block that the hash left empty
            return pd.DataFrame([], columns=["rep", "links", "low"], dtype="int64")
        left = Tree(pdf[pdf["first"]])
        right = left if same else Tree(pdf[~pdf["first"]])
        n = len(left.rep)
        union = Union(n if same else n + len(right.rep))
        shift = 0 if same else n
        links = np.zeros(len(union.up), np.int64)
        for r, c, linked in traverse(left, right, cosine):
            if linked is None:
                own = same and np.array_equal(r, c)
                links[r] += right.n[c].sum() - (left.n[r] if own else 0)
                if not same:
                    links[c + shift] += left.n[r].sum()
                for i in r[1:].tolist():
                    union.join(i, int(r[0]))
                for j in c.tolist():
                    union.join(j + shift, int(r[0]))
                continue
            links[r] += linked @ right.n[c]
            if not same:
                links[c + shift] += left.n[r] @ linked
            row, col = _lowered(linked)
            for i, x in zip(r[row >= 0].tolist(), r[row[row >= 0]].tolist(), strict=True):
                union.join(i, x)
            for j, x in zip(c[col >= 0].tolist(), r[col[col >= 0]].tolist(), strict=True):
                union.join(j + shift, x)
        rep = left.rep if same else np.concatenate((left.rep, right.rep))
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[some], "links": links[some], "low": rep[[union.find(i) for i in some.tolist()]]}).astype("int64")

    return run


def _split(fan: int):
    """A cell's children: centres from its sample, of the finest net (radii halve) with no more than ``fan``; the
    first points where even the coarsest net has more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf.sort_values("rep")["v"])
        radius, best = 1.0, x[:fan]
        while radius > 0.01:
            found, _ = net(x, radius)
            if len(found) > fan:
                break
            best, radius = x[found], radius / 2
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "v": [c.tobytes() for c in best]})

    return run


class Cells:
    """The upper levels: each cell's centre, children, covering radius and size. Cell 0 holds all."""

    def __init__(self, dim: int):
        self.centre, self.children, self.radius, self.size = [np.zeros(dim)], [[]], [2.0], [0]

    def split(self, cell: int, centres: list[np.ndarray]) -> None:
        self.children[cell] = list(range(len(self.centre), len(self.centre) + len(centres)))
        for c in centres:
            self.centre.append(c)
            self.children.append([])
            self.radius.append(0.0)
            self.size.append(0)

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def packs(self, rows: int) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Each cell's pack (-1 for those above packs), and the packs' cells: the highest ones that hold no more
        than so many vectors, or aren't split, neighbours in the tree together as far as they fit."""
        out, members, open_, room = np.full(len(self.centre), -1), {}, None, 0
        stack = [0]
        while stack:
            cell = stack.pop()
            if self.size[cell] > rows and self.children[cell]:
                stack += reversed(self.children[cell])
                continue
            if self.size[cell] > room:
                open_, room = cell, max(0, rows)
                members[cell] = []
            members[open_].append(cell)
            room -= self.size[cell]
            below = [cell]
            while below:
                at = below.pop()
                out[at] = open_
                below += self.children[at]
        return out, members

    def packed(self) -> list:
        """For each cell that has children: them, their centres, and their radii."""
        return [(np.array(c), np.stack([self.centre[i] for i in c]), np.array([self.radius[i] for i in c])) if c else None for c in self.children]


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ centres.T))


def placed(cells: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's leaf, found by the nearest child on every level, and how far its centre is."""
    at, away = np.zeros(len(x), np.int64), np.zeros(len(x))
    open_ = np.arange(len(x))
    while len(open_):
        left = []
        for cell in np.unique(at[open_]).tolist():
            if cells[cell] is None:
                continue
            rows = open_[at[open_] == cell]
            names, centres, _ = cells[cell]
            gap = _apart(x[rows], centres)
            pick = gap.argmin(axis=1)
            at[rows], away[rows] = names[pick], gap[np.arange(len(rows)), pick]
            left.append(rows)
        open_ = np.concatenate(left) if left else np.zeros(0, np.int64)
    return at, away


def visited(cells: list, packs: np.ndarray, x: np.ndarray, home: np.ndarray, eps: float):
    """``(rows, pack)``: packs of larger numbers than a row's own whose cells can hold a link of it; ``packs``
    has each cell's pack, -1 above packs."""
    hit: dict[int, np.ndarray] = {}
    stack = [(0, np.arange(len(x)))]
    while stack:
        cell, rows = stack.pop()
        pack = int(packs[cell])
        if pack >= 0:
            seen = hit.setdefault(pack, home >= pack)
            rows = rows[~seen[rows]]
            if not len(rows):
                continue
            if cells[cell] is None:
                seen[rows] = True
                continue
        names, centres, radius = cells[cell]
        gap = _apart(x[rows], centres)
        near = (gap <= radius + eps + SAFE) & (gap <= gap.min(axis=1, keepdims=True) + 2 * eps + SAFE)
        for k in np.flatnonzero(near.any(axis=0)).tolist():
            stack.append((int(names[k]), rows[near[:, k]]))
    for pack, seen in hit.items():
        rows = np.flatnonzero(seen & (home < pack))
        if len(rows):
            yield rows, pack


def _place(cells: list):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                cell, away = placed(cells, matrix(pdf["v"]))
                yield pdf.assign(cell=cell, away=away)

    return run


def _visit(cells: list, packs: np.ndarray, eps: float):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                for rows, pack in visited(cells, packs, matrix(pdf["v"]), packs[pdf["cell"].to_numpy()], eps):
                    yield pdf.iloc[rows][["rep", "n", "v"]].assign(pack=pack)

    return run


def _grown(own: DataFrame, dim: int, eps: float, rows: int, most: int) -> tuple[Cells, DataFrame]:
    """Cells that are narrow or small, as far as splitting helps, and the vectors in them."""
    cells, now = Cells(dim), None
    for depth in range(DEPTH + 1):
        then, now = now, written(own.mapInPandas(_place(cells.packed()), "rep long, n long, v binary, cell long, away double"), "placed")
        if then is not None:
            dropped(then)
        for r in now.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
            cells.size[r["cell"]] = r["n"]
            cells.radius[r["cell"]] = r["radius"] if r["cell"] else 2.0
        # The radius of a cell that has just been split was measured before, on the same vectors.
        wide = lambda c: cells.size[c] > FINE and cells.radius[c] > eps
        large = [c for c in cells.leaves() if wide(c) or (cells.size[c] > rows and 2 * cells.radius[c] > eps - SAFE)]
        large = sorted(large, key=lambda c: -cells.size[c])[: max(0, most - len(cells.centre)) // FAN]
        if not large or depth == DEPTH:
            break
        share = own.sparkSession.createDataFrame([(c, SAMPLE / cells.size[c]) for c in large], "cell long, share double")
        draw = F.shiftrightunsigned(F.xxhash64("rep", F.lit(depth)), 11) / float(1 << 53)
        sample = now.join(F.broadcast(share), "cell").where(draw < F.col("share")).select("cell", "rep", "v")
        found: dict[int, list] = {}
        for r in sample.groupBy("cell").applyInPandas(_split(FAN), "cell long, v binary").collect():
            found.setdefault(r["cell"], []).append(np.frombuffer(r["v"], np.float64))
        found = {c: v for c, v in found.items() if len(v) > 1}
        if not found:
            break
        for c in sorted(found):
            cells.split(c, found[c])
    return cells, now


def _links(own: DataFrame, dim: int, cosine: float) -> DataFrame:
    """``(rep, links, low)`` of ``own(rep, n, v)``: parts of link counts, and a vector that it is joined to."""
    spark = own.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = min(max(ROWS, min(MOST, own.count() // 256)), max(256, (MEGABYTES << 18) // (8 * dim)))
    cells, now = _grown(own, dim, eps, rows, min(CELLS, (MEGABYTES << 20) // (8 * dim)))
    packed, (packs, members) = cells.packed(), cells.packs(rows)
    visitors = now.mapInPandas(_visit(packed, packs, eps), "rep long, n long, v binary, pack long")
    coming = {r["pack"]: r["n"] for r in visitors.groupBy("pack").agg(F.count("*").alias("n")).collect()}
    plan = []
    for pack, own_cells in members.items():
        size = sum(cells.size[c] for c in own_cells)
        alone = len(own_cells) == 1 and pack > 0 and 2 * cells.radius[pack] <= eps - SAFE
        if size:
            plan.append((pack, -(-size // rows), -(-coming.get(pack, 0) // rows), alone))
    plan = spark.createDataFrame(plan, "pack long, homes int, visits int, solid boolean")
    of_leaf = spark.createDataFrame([(c, int(packs[c])) for c in cells.leaves() if cells.size[c]], "cell long, pack long")
    block = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    home = now.select("rep", "n", "v", "cell").join(F.broadcast(of_leaf.join(plan, "pack")), "cell").drop("cell")
    columns = ["rep", "n", "v", "pack", "i", "j", "first", "part"]
    pair = home.where("not solid").withColumn("own", block("homes")).withColumn("other", every("homes"))
    pair = pair.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "first": F.col("own") <= F.col("other"), "part": F.lit(0)})
    host = home.where("visits > 0").withColumn("i", block("homes")).withColumn("j", every("visits")).withColumns({"first": F.lit(True), "part": F.lit(1)})
    guest = visitors.join(F.broadcast(plan), "pack").withColumn("j", block("visits")).withColumn("i", every("homes")).withColumns({"first": F.lit(False), "part": F.lit(1)})
    met = pair.select(columns).unionByName(host.select(columns)).unionByName(guest.select(columns))
    out = met.groupBy("part", "pack", "i", "j").applyInPandas(_joined(cosine), "rep long, links long, low long")
    solid = home.where("solid").select("rep", "n", "pack")
    whole = solid.groupBy("pack").agg(F.sum("n").alias("all"), F.min("rep").alias("low"))
    inside = solid.join(F.broadcast(whole), "pack").select("rep", (F.col("all") - F.col("n")).alias("links"), "low")
    out = written(out.unionByName(inside.where("links > 0")), "joined")
    dropped(now)
    return out


def near_vectors(table: DataFrame, cosine: float = 0.95) -> DataFrame:
    """For each row of ``table(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    known = as_bytes(table, unit=True).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1)), "dim": F.length("v")})
    known = written(known.withColumn("h1", F.when(F.col("vec_id").isNotNull() & F.col("v").isNotNull(), F.col("h1"))), "units")
    # A group of equal vectors has a number of its own, since one vec_id may stand in several groups.
    groups = known.where("h1 is not null").groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    heads = written(groups.withColumn("rep", F.monotonically_increasing_id()), "heads")
    same = heads.drop("v")

    found = spark.createDataFrame([], "rep long, links long, low long")
    for dim in [r[0] for r in heads.select("dim").distinct().collect()]:
        found = found.unionByName(_links(heads.where(F.col("dim") == dim).select("rep", "n", "v"), dim // 8, cosine))
    label = written(components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")), "vectors"), "label")
    named = label.join(same, label.node == same.rep).groupBy("component").agg(F.min("first").alias("found"))
    label = label.join(named, "component").select("node", "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = (
        same.join(links, "rep", "left")
        .join(label, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", "dim", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("found", "first").alias("found"))
    )
    return (
        with_groups(known.select("vec_id", "h1", "h2", "dim"), written(reps, "reps"), ["h1", "h2", "dim"], "n")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("found", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
