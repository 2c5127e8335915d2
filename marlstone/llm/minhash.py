"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

Signatures follow Ertl, "SuperMinHash - A New Minwise Hashing Algorithm for Jaccard Similarity
Estimation": element d has a random permutation p of the slots and fractions r; slot p[j] gets the
smallest j + r[j] over all elements. Levels j are taken one after another for all elements of a batch at
once, and a document stops early: as soon as all its slots hold values below j + 1, later levels cannot
change it.

Defined results: a null, empty or blank text has the empty set and links with nothing. Rows that share a
doc_id are one node. A row whose doc_id is null keeps a null component and is kept. Equal sets are
collapsed before banding, whatever their number, and each input row gets one output row. Shingles are hashed
twice with independent 64-bit hashes: the first proposes candidates, and links are confirmed on full sets of the
second; sets count as equal where size and digests of both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import U64, Union, components, dropped, mix, shingle_sets, small_batches, text_slices, with_groups, written

#: 120 slots in 30 bands of 4: a pair at 0.8 shares no band with probability 1.4e-7, at 0.85 with 2e-10.
SLOTS, ROWS = 120, 4
#: The seed of the hash that confirms.
CONFIRM = 1
#: A block of a bucket's members that are compared in one task holds about so many documents and so many
#: shingles (a longer document alone), and so does one of those that visit a bucket's largest component.
BLOCK, VISITORS, SHINGLES = 256, 1024, 1 << 21
#: A pair is set aside without verification if the signatures' estimate is this far below the threshold: for
#: independent slots that befalls a pair at 0.85 with probability 1e-10 and one at 0.8 with 2e-9, and the slots
#: of SuperMinHash vary less.
SLACK = 0.24


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row of 32-bit values for each set (zeros for an empty one)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * slots, np.iinfo(np.int64).max, np.int64)
    live = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    history: list[np.ndarray] = []
    for j in range(slots):
        if not len(live):
            break
        r = mix(live + U64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = ((r >> U64(32)) * U64(slots - j) >> U64(32)).astype(np.int16) + np.int16(j)
        at = k
        for i in range(j - 1, -1, -1):  # what stands at place k after the swaps so far
            at = np.where(history[i] == at, np.int16(i), at)
        value = (r & U64(0xFFFFFFFF)).astype(np.int64) + (j << 32)
        np.minimum.at(out, owner * slots + at, value)
        history.append(k)
        open_ = out.reshape(-1, slots).max(axis=1) >= (j + 1) << 32
        open_ &= sizes > 0
        stay = open_[owner]
        if not stay.all():
            live, owner = live[stay], owner[stay]
            history = [h[stay] for h in history]
    out = out.reshape(-1, slots)
    out[sizes == 0] = 0
    return mix(out.astype(U64)).astype(np.uint32) * (sizes > 0)[:, None].astype(np.uint32)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    n, slots = sig.shape
    bands = sig.reshape(n, slots // rows, rows).astype(U64)
    key = np.zeros(bands.shape[:2], U64) + np.arange(1, slots // rows + 1, dtype=U64)
    for i in range(rows):
        key = mix(key * U64(0x2545F4914F6CDD1D) + bands[:, :, i])
    return key.view(np.int64)


def _digest(s: np.ndarray) -> int:
    """64 bits of a set, independent of order."""
    return int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64)) if len(s) else 0


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(data, offsets, k)
                sig = signatures(sets)
                keys = band_keys(sig)
                other = shingle_sets(data, offsets, k, CONFIRM)
                dig = np.array([(_digest(a), _digest(b)) for a, b in zip(sets, other, strict=True)], np.int64).reshape(-1, 2)
                sizes = np.array([len(s) for s in sets], np.int64)
                width = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(sizes),
                        pa.array(dig[:, 0]),
                        pa.array(dig[:, 1]),
                        pa.array([r.tobytes() for r in sig], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * width, pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(data, offsets, k, CONFIRM)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "members"],
                )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_members"), batch.column("b_members")
            ok = [
                similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent)
                for x, y in zip(a, b, strict=True)
            ]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])

    return run


def _within(percent: int):
    """Links between the two blocks of a task (or inside its one block) whose rows are not yet in one
    component: pairs in the order of their estimate, each confirmed on full sets, until no pair joins two
    components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        sig = np.stack([np.frombuffer(x, np.uint32) for x in pdf["sig"]])
        sets = [np.frombuffer(x, U64) for x in pdf["members"]]
        node, second = pdf["node"].to_numpy(), pdf["second"].to_numpy()
        inside = pdf["part"].iloc[0] == 2 and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        _, local = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        union, found, pairs = Union(local.max() + 1), [], []
        first = np.flatnonzero(~second)
        for k in first if inside else np.flatnonzero(second):
            other = first[local[first] != local[k]]
            if inside:
                other = other[other < k]
            if len(other):
                est = (sig[other] == sig[k]).mean(axis=1)
                near = est >= percent / 100 - SLACK
                pairs.append(np.stack([np.full(near.sum(), k), other[near], np.round(est[near] * -1e6).astype(np.int64)], axis=1))
        if pairs:
            pairs = np.concatenate(pairs)
            for i, j, _ in pairs[np.argsort(pairs[:, 2], kind="stable")]:
                if union.find(local[i]) != union.find(local[j]) and similar(sets[i], sets[j], percent):
                    union.join(local[i], local[j])
                    found.append((max(node[i], node[j]), min(node[i], node[j])))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Every two documents whose Jaccard similarity is at least ``percent`` / 100 are linked; a component
    is what links reach, its id the smallest doc_id. Candidates share a band. Within a bucket, all are
    first compared with its smallest member (linear, so that a bucket of copies resolves at once), and
    only members that are still in different components then meet each other, in blocks, in one task
    each, where nothing but confirmed links is emitted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(
        docs.mapInArrow(_sketch(words), "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<bigint>"),
        "sketch",
    )
    usable = sketch.where("doc_id is not null and n_shingles > 0")
    sets = ["d1", "d2", "n_shingles"]
    rep = usable.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    same = with_groups(usable.select("doc_id", *sets), rep, sets, "n", "inner").select("doc_id", "rep", "n_shingles")
    same = written(same, "same")
    # A doc_id on several rows may stand in several groups of equal sets: they are one node.
    copies = same.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    heads = usable.join(rep, (usable.doc_id == rep.rep) & (usable.d1 == rep.d1) & (usable.d2 == rep.d2), "left_semi")
    heads = heads.select(F.col("doc_id").alias("node"), "n_shingles", "sig", "bands")
    members = heads.select("node", F.explode("bands").alias("key"))
    low = members.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    low = written(low, "buckets")
    members = written(with_groups(members, low, ["key"], "n", "inner").select("key", "node", "low", "n"), "members")

    star = written(members.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct(), "star")
    wanted = members.select("node").distinct()
    full = written(
        docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node", "left_semi").mapInArrow(
            _sets(words), "node long, members binary"
        ),
        "sets",
    )
    links = (
        star.join(full.select(F.col("node").alias("u"), F.col("members").alias("a_members")), "u")
        .join(full.select(F.col("node").alias("v"), F.col("members").alias("b_members")), "v")
        .select("u", "v", "a_members", "b_members")
        .mapInArrow(_confirm(percent), "u long, v long")
    )
    links = written(links, "links")

    cc1 = components(links, "cc1")
    label = written(cc1, "label")
    placed = (
        members.where("n > 2")
        .join(label.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    )
    # In a bucket of several components, members of the largest one need not meet each other. All others
    # visit that component: each pair of document and component once, whatever the number of buckets that
    # they share. A task holds one block of either side.
    main = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = main.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.count("*").alias("c"), F.sum("m").alias("all"))
    # Distinct, since a row that stands there twice would cancel itself in the sets' hashes below.
    placed, main = written(placed, "placed"), main.where("c > 1").select("key", "most", "all")
    torn = written(with_groups(placed, main, ["key"], "all", "inner").drop("all").distinct(), "torn")
    bulk = heads.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles"))
    torn, bare = written(torn.join(bulk, "node"), "sized"), torn
    sides = torn.select(F.col("most").alias("key"), "node", "component", "n_shingles", (F.col("component") != F.col("most")).alias("second")).distinct()

    def parts(of: Column, most: int) -> Column:
        rows, shingles = F.count_if(of), F.sum(F.when(of, F.col("n_shingles")).otherwise(0))
        return F.greatest(F.ceil(rows / most), F.ceil(shingles / SHINGLES)).cast("int")

    sizes = sides.groupBy("key").agg(parts(~F.col("second"), BLOCK).alias("homes"), parts(F.col("second"), VISITORS).alias("visits"), F.count("*").alias("all"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = with_groups(sides, sizes, ["key"], "all", "inner")
    first = sides.where("not second").select("key", "node", "component", "second", block("homes").alias("i"), every("visits").alias("j"))
    first = first.unionByName(sides.where("second").select("key", "node", "component", "second", block("visits").alias("j"), every("homes").alias("i")))
    # Those others meet among themselves, each set of members once.
    others = torn.where("component <> most")
    sets = others.groupBy("key").agg(
        F.min("component").alias("a"),
        F.max("component").alias("b"),
        F.count("*").alias("n"),
        parts(F.lit(True), BLOCK).alias("blocks"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.col("node"), F.lit(7))).alias("y"),
    )
    sets = sets.where("a < b").groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.max("blocks").alias("blocks")).select("key", "blocks", "n")
    own = with_groups(others, sets, ["key"], "n", "inner").select("key", "node", "component", block("blocks").alias("own"), every("blocks").alias("other"))
    second = own.select("key", "node", "component", (F.col("own") > F.col("other")).alias("second"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    mixed = first.withColumn("part", F.lit(1)).unionByName(second.withColumn("part", F.lit(2)))
    more = (
        mixed.join(heads.select("node", "sig"), "node")
        .join(full, "node")
        .groupBy("part", "key", "i", "j")
        .applyInPandas(_within(percent), "u long, v long")
    )
    more = written(more, "more")
    first_label, cc2 = label, components(links.unionByName(more).unionByName(copies), "cc2")
    label = written(cc2, "label")
    for table in (low, members, star, full, links, cc1, first_label, placed, bare, torn, more, cc2):
        dropped(table)
    of = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    of = of.join(label, of.doc_id == label.node, "left").select(
        of.doc_id, F.coalesce("component", "rep").alias("found")
    )
    out = (
        sketch.select("doc_id", "n_shingles")
        .join(of, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    out._marlstone_parts = (sketch, same, label)
    return out


def deduplicated(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id."""
    found = near_duplicates(docs, words=words, percent=percent)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    for table in found._marlstone_parts:
        dropped(table)
    return docs.join(gone, docs.doc_id.cast("long") == gone["_gone"], "left_anti")
