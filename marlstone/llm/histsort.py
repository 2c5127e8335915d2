"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined, one exchange.

Each row has a 63-bit order key: 39 bits of its text's hash, then 24 bits of its doc_id's hash. Equal texts
are neighbours, and a boundary falls between texts wherever that meets the tolerance; a group of copies is
cut only where it is itself what stands across a boundary. Every round counts, over all rows, the bytes in
each cell between the boundaries still in question (a pre-aggregated ``groupBy``; some thousand sums reach
the driver) and narrows each to a cell, until all are within tolerance. Rows then move once, into the groups
in which they get their slots.

Defined results: a null text has 0 bytes, CRC 0 and size 1; rows that share doc_id and text stay in one shard
and are interchangeable there; a null doc_id is a value like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Cells of an interval in one round; a shard's bytes may miss the mean by this share.
CELLS, TOLERANCE = 512, 0.004
LOW_BITS, TOP = 24, 1 << 63
#: Slots are given in groups of so many bits of the text's and of the doc_id's hash.
TEXT_BITS, ID_BITS = 9, 7


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), LOW_BITS + 1), LOW_BITS)
        .bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
        .alias("key"),
    )


def splitters(keyed: DataFrame, n: int, tolerance: float = TOLERANCE) -> list[int]:
    """n - 1 boundaries; rows below the i-th hold i/n of all bytes, as near as tolerance and rows allow."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / n / 2
    # boundary -> [low, bytes below low, high, bytes below high]
    open_ = {i: [0, 0, TOP, total] for i in range(1, n)}
    found: dict[int, int] = {}
    while open_:
        spans = sorted({(lo, base, hi) for lo, base, hi, _ in open_.values()})
        index = F.lit(None).cast("int")
        cell = F.lit(None).cast("long")
        steps = {}
        for k, (lo, _, hi) in enumerate(spans):
            step = max(1, -(-(hi - lo) // CELLS))
            unit = 1 << LOW_BITS
            if hi - lo > unit:  # boundaries between texts first
                step = -(-step // unit) * unit
            steps[k] = step
            inside = (F.col("key") >= lo) & (F.col("key") <= hi - 1)
            index = F.when(inside, F.lit(k)).otherwise(index)
            cell = F.when(inside, F.floor((F.col("key") - F.lit(lo)) / F.lit(step)) if step == 1 else F.expr(f"(key - {lo}) div {step}")).otherwise(cell)
        sums = keyed.groupBy(index.alias("span"), cell.cast("long").alias("cell")).agg(F.sum("size").alias("bytes"))
        seen = {(r["span"], r["cell"]): r["bytes"] for r in sums.where("span is not null").collect()}
        for i in list(open_):
            lo, base, hi, upto = open_[i]
            k = spans.index((lo, base, hi))
            goal, below, at = i * total / n, base, lo
            for c in sorted(c for s, c in seen if s == k):
                after = below + seen[k, c]
                edge = min(hi, lo + (c + 1) * steps[k])
                if after >= goal:
                    lo, base, hi, upto = max(at, lo + c * steps[k]), below, edge, after
                    break
                below, at = after, edge
            nearest = (lo, base) if goal - base <= upto - goal else (hi, upto)
            if abs(nearest[1] - goal) <= slack or hi - lo <= 1:
                found[i] = nearest[0]
                del open_[i]
            else:
                open_[i] = [lo, base, hi, upto]
    return [found[i] for i in sorted(found)]


def sharded(docs: DataFrame, n: int = 8) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    keyed = written(_keyed(docs), "keyed")
    edges = splitters(keyed, n)
    shard = F.lit(0)
    for e in edges:
        shard = shard + (F.col("key") >= F.lit(e)).cast("int") if e < TOP else shard
    placed = keyed.select(
        "*",
        shard.cast("int").alias("shard"),
        F.shiftright("key", 63 - TEXT_BITS).cast("int").alias("a"),
        F.shiftright(F.col("key").bitwiseAND(F.lit((1 << LOW_BITS) - 1)), LOW_BITS - ID_BITS).cast("int").alias("b"),
    )
    group = ["shard", "a", "b"]
    before = Window.partitionBy("shard").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*group).agg(F.count("*").alias("n"))
    starts = starts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "size", "text_crc32")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, group)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
