"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source whose target is f times its size gives each of its documents f copies in expectation: floor(f)
for sure, and the fraction by the pivotal method (Deville and Tille, "Unequal probability sampling without
replacement through a splitting method"): two fractional documents meet, and one gives mass to the other
until one of them is integral; the other goes on. Mass is counted in words, and who gives is drawn so that
neither's expectation changes, so a meeting keeps the words taken as they are. Documents meet in blocks of
about 64, long ones first. Each block leaves at most one fractional document; those meet again, 64 blocks at
a time, until one document of the source is left, which is rounded by its own fraction: a source misses its
target by less than that one document. All draws are hashes of the two documents and
the level, so that reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, the last one; a source of
size 0 has target 0; of rows with equal doc_id, source and size, as many get a copy more as their fractions sum
to, and the rest of that sum is what goes through the meetings; in ``mixed``, the copies of such rows go to texts
in the order of their hashes, and among equal texts to any rows, so that the words taken are those of
``assigned``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK, WEIGHTS, SHARE, MOST = 64, (3, 1, 2), 1.5, 2
#: Equal rows are told apart again in runs of so many.
RUN = 4096

#: A unit: equal rows (n of them; whole of them get a copy more for sure), of which one is still fractional.
_UNIT = "struct<doc_id:bigint,size:bigint,base:int,n:bigint,whole:bigint>"
_STATE = f"struct<done:array<struct<unit:{_UNIT},extra:int>>,cur:{_UNIT},p:double>"
_OUT = "array(named_struct('unit', {0}, 'extra', cast(round({1}) as int)))"
_DRAW = "(shiftrightunsigned(xxhash64(acc.cur.doc_id, acc.cur.size, x.unit.doc_id, x.unit.size, {seed}), 11) / 9007199254740992D)"
#: Words that the current unit can give to the next one, and those that it can take from it.
_GIVE = "least(acc.p * acc.cur.size, (1 - x.p) * x.unit.size)"
_TAKE = "least(x.p * x.unit.size, (1 - acc.p) * acc.cur.size)"
_WHOLE = "abs({0} - round({0})) < 1e-9"


def _fold(seed: int) -> Column:
    """Meetings of a block's units, one after another. acc: the units done, the current one and its
    fraction; x: the next unit."""
    give = f"{_DRAW.format(seed=seed)} * ({_GIVE} + {_TAKE}) < {_TAKE}"
    masses = (
        f"CASE WHEN {give} THEN named_struct('a', acc.p - {_GIVE} / acc.cur.size, 'b', x.p + {_GIVE} / x.unit.size)"
        f" ELSE named_struct('a', acc.p + {_TAKE} / acc.cur.size, 'b', x.p - {_TAKE} / x.unit.size) END"
    )
    a, b = _OUT.format("acc.cur", "m.a"), _OUT.format("x.unit", "m.b")
    met = (
        f"CASE WHEN {_WHOLE.format('m.a')} AND {_WHOLE.format('m.b')} THEN named_struct('done', concat(acc.done, {a}, {b}), 'cur', cast(null as {_UNIT}), 'p', 0D)"
        f" WHEN {_WHOLE.format('m.a')} THEN named_struct('done', concat(acc.done, {a}), 'cur', x.unit, 'p', m.b)"
        f" ELSE named_struct('done', concat(acc.done, {b}), 'cur', acc.cur, 'p', m.a) END"
    )
    step = (
        f"CASE WHEN {_WHOLE.format('x.p')} THEN named_struct('done', concat(acc.done, {_OUT.format('x.unit', 'x.p')}), 'cur', acc.cur, 'p', acc.p)"
        f" WHEN acc.cur IS NULL THEN named_struct('done', acc.done, 'cur', x.unit, 'p', x.p)"
        f" ELSE element_at(transform(array({masses}), m -> {met}), 1) END"
    )
    empty = f"cast(named_struct('done', array(), 'cur', null, 'p', 0D) as {_STATE})"
    return F.expr(f"aggregate(units, {empty}, (acc, x) -> cast({step} as {_STATE}))")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """For each source of ``sized(source, size)``: source_size, target. Shares above MOST times a
    source's size are cut to that and the excess reshared by weight: with the sources in the order of
    cap / weight, a prefix is cut, and the first source that isn't sets the level of all others."""
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    source = source.withColumn("weight", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    spent = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    every = Window.partitionBy()
    source = source.withColumn("level", (SHARE * F.sum("source_size").over(every) - spent) / rest)
    free = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.max(F.when(free, F.col("level"))).over(every)
    target = F.least(F.coalesce(level * F.col("weight"), F.col("cap")), F.col("cap"))
    return source.select("source", "source_size", target.alias("target"))


def assigned(docs: DataFrame) -> DataFrame:
    """For each row of ``docs(doc_id, text, source)``: doc_id, size, source, source_size, target, copies,
    taken."""
    return _assigned(written(_sized(docs), "sized"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *more)


def _assigned(sized: DataFrame) -> DataFrame:
    goal = written(targets(sized), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1), F.ceil(F.col("groups") / BLOCK)).cast("long"))
    right = goal.withColumnRenamed("source", "of")
    # Equal rows are one unit, so that no block grows with their number.
    alike = written(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "alike")
    groups = alike.groupBy("source").agg(F.count("*").alias("groups"))
    most = groups.agg(F.max("groups")).first()[0] or 0
    share = goal.join(groups, goal.source.eqNullSafe(groups.source)).select(goal.source.alias("of"), F.least(rate, F.lit(float(MOST))).alias("rate"), "groups")
    extra = F.when(F.col("size") > 0, F.col("n") * (F.col("rate") - F.floor("rate"))).otherwise(0.0)
    unit = F.struct("doc_id", "size", F.floor("rate").cast("int").alias("base"), "n", F.floor("extra").cast("long").alias("whole"))
    units = (
        alike.join(share, alike.source.eqNullSafe(share.of))
        .withColumn("extra", extra)
        .select(
            "source",
            at.alias("block"),
            F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id").alias("h"), unit.alias("unit"), (F.col("extra") - F.floor("extra")).alias("p")).alias("unit"),
        )
    )
    blocks = -(-most // BLOCK)
    done, level = None, 0
    while True:
        level += 1
        folded = written(
            units.groupBy("source", "block").agg(F.array_sort(F.collect_list("unit")).alias("units")).select("source", "block", _fold(level).alias("acc")),
            f"level{level}",
        )
        out = folded.select("source", F.explode("acc.done").alias("d")).select("source", "d.unit", "d.extra")
        done = out if done is None else done.unionByName(out)
        left = folded.where("acc.cur is not null")
        if blocks <= 1:
            break
        blocks = -(-blocks // BLOCK)
        units = left.select(
            "source",
            F.expr(f"block div {BLOCK}").alias("block"),
            F.expr("named_struct('order', -acc.cur.size, 'h', xxhash64(acc.cur.doc_id), 'unit', acc.cur, 'p', acc.p)").alias("unit"),
        )
    draw = F.expr("shiftrightunsigned(xxhash64(acc.cur.doc_id, acc.cur.size, 0), 11) / 9007199254740992D")
    done = done.unionByName(left.select("source", F.col("acc.cur").alias("unit"), (draw < F.col("acc.p")).cast("int").alias("extra")))
    rows = done.withColumn("part", F.explode(F.expr(f"sequence(0L, (unit.n - 1) div {RUN})"))).withColumn(
        "i", F.explode(F.expr(f"sequence(part * {RUN} + 1, least(unit.n, (part + 1) * {RUN}))"))
    )
    copies = F.col("unit.base") + (F.col("i") <= F.col("unit.whole") + F.col("extra")).cast("int")
    return rows.join(right, rows.source.eqNullSafe(right.of)).select(
        "unit.doc_id", "unit.size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("unit.size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; rows not taken go."""
    key = ["doc_id", "source", "hash"]
    sized = written(_sized(docs, F.xxhash64("text").alias("hash")), "sized")
    group = ["doc_id", "source", "size"]
    total = _assigned(sized).groupBy(*group).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    total = total.select(*[F.col(c).alias(f"_{c}") for c in total.columns])
    texts = sized.groupBy(*group, "hash").agg(F.count("*").alias("n"))
    texts = texts.join(total, [texts[c].eqNullSafe(total[f"_{c}"]) for c in group])
    # All rows of a group get base copies, and the first more of them one more.
    base, more = F.floor(F.col("_copies") / F.col("_rows")), F.col("_copies") % F.col("_rows")
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))
    extra = F.least(F.col("n"), F.greatest(F.lit(0), more - F.coalesce(before, F.lit(0))))
    texts = texts.select(*key, "n", base.alias("base"), extra.alias("extra"))
    texts = written(texts.select(*[F.col(c).alias(f"_{c}") for c in texts.columns]), "copies")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: plain[f"c{i}"] for i, c in enumerate(docs.columns)}
    match = at["doc_id"].cast("long").eqNullSafe(texts["_doc_id"]) & at["source"].eqNullSafe(texts["_source"]) & (F.xxhash64(at["text"]) == texts["_hash"])

    def repeated(rows: DataFrame, copies: Column) -> DataFrame:
        return rows.withColumn("_copies", copies).where("_copies > 0").select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_i")).drop("_i")

    out = repeated(plain.join(texts.where("_extra in (0, _n)"), match), F.col("_base") + F.when(F.col("_extra") > 0, 1).otherwise(0))
    some = texts.where("_extra not in (0, _n)")  # equal texts on several rows, of which only some get a copy more
    if not some.isEmpty():
        order = Window.partitionBy("_doc_id", "_source", "_hash").orderBy(F.lit(0))
        torn = plain.join(some, match).withColumn("_at", F.row_number().over(order))
        out = out.unionByName(repeated(torn, F.col("_base") + (F.col("_at") <= F.col("_extra")).cast("int")))
    return out.toDF(*docs.columns)
