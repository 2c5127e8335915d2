"""What the operators have in common: written tables, Arrow text buffers, word hashes, components.

All intermediate results that cut lineage are Parquet tables below ``spark.checkpoint.dir``, a folder
that every executor and the driver see, so a lost executor costs at most its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

# ---------------------------------------------------------------- written tables


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only where it names none and all work is done on this
    machine (tests) is one made, once a process; a cluster without one is refused, since each executor would write
    to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    return base.rstrip("/") + "/marlstone"


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="marlstone-")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: computed once, lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_marlstone_path", None)
    if path:
        _removed(df.sparkSession, path)


def cleared(spark: SparkSession) -> None:
    """Removes all tables that this session's operators have written, those of results too."""
    _removed(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def _removed(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the Arrow batches that Python workers get; long texts then stay within memory. The session's
    setting is only ever lowered, so that no operator undoes what another one needs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


#: A group of so many rows, and of this share of all rows, is hot; there are at most 1 / HOT such groups.
HOT_ROWS, HOT = 1000, 1e-5


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """``rows`` joined (``left`` or ``inner``) to ``groups``, which has one row for each combination of ``keys`` and
    the number of ``rows`` that hold it. Hot groups, at most 100,000 by their definition, are broadcast and their
    rows never shuffled by key; rows with a null key match nothing and stay where they are. Both tables are
    read several times: they should be written ones, or narrow projections of such."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, HOT * total)
    hot = groups.where(F.col(count) >= least).collect()
    more = [f for f in groups.schema if f.name not in keys]
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    names = [*rows.columns, *[f.name for f in more]]
    if hot:
        hot = rows.sparkSession.createDataFrame(hot, groups.schema)
        whole = rows.where(known)
        out = whole.join(F.broadcast(hot), keys).select(*names)
        out = out.unionByName(whole.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(count) < least), keys, how).select(*names))
    else:
        out = rows.where(known).join(groups, keys, how).select(*names)
    if how == "left":
        out = out.unionByName(rows.where(~known).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]))
    return out


# ---------------------------------------------------------------- Arrow text buffers

#: Bytes of text that are handled at a time (a single longer text is handled alone).
SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows; a null text counts as empty here."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Segments are hashed in chunks of so many bytes.
CHUNK = 64
_TABLES: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    """A random 64-bit number for each place in a chunk and each byte."""
    if seed not in _TABLES:
        at = np.arange(CHUNK * 256, dtype=U64) + U64(((seed + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        _TABLES[seed] = mix(mix(at) + U64(0xD1342543DE82EF95))
    return _TABLES[seed]


def _whole(data: np.ndarray) -> type:
    """Places in these bytes, in half the memory where they are few enough."""
    return np.int32 if len(data) < 1 << 31 else np.int64


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes from each start up to its end; segments hold a byte or more and don't
    overlap. Tabulation: each byte and its place in a chunk stand for a random number, a chunk's sum is
    mixed with the chunk's place, and so are the chunks' sums; no arithmetic structure of the bytes is left.
    Different seeds give independent hashes."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    parts = -(-size // CHUNK)
    if int(size.max()) > CHUNK:
        owner = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        heads = starts[owner] + nth * CHUNK
        tails = np.minimum(heads + CHUNK, ends[owner])
    else:
        nth, heads, tails = 0, starts, ends
    length = tails - heads
    upto = np.cumsum(length)
    first = upto - length
    place = np.arange(int(upto[-1]), dtype=_whole(data))
    place -= np.repeat(first.astype(place.dtype), length)
    byte = data[place + np.repeat(heads.astype(place.dtype), length)]
    place *= 256
    place += byte
    sums = np.add.reduceat(_table(seed)[place], first)
    sums = mix(sums + mix(np.asarray(nth + 1, U64).reshape(-1)))  # with and without long neighbours alike
    if heads is not starts:
        sums = np.add.reduceat(sums, np.cumsum(parts) - parts)
    return mix(sums + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def distinct_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first segment of each group of equal ones, and each segment's group. Hashes propose the groups
    and the bytes decide: where two different segments share a hash, all are told apart by their bytes."""
    _, first, inverse = np.unique(segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size, head = ends - starts, first[inverse]
    same = np.array_equal(size, size[head])
    if same and len(starts):
        other = np.flatnonzero(head != np.arange(len(starts)))
        length = size[other]
        place = np.arange(int(length.sum()), dtype=_whole(data))
        place -= np.repeat((np.cumsum(length) - length).astype(place.dtype), length)
        own, its = (np.repeat(starts[x].astype(place.dtype), length) for x in (other, head[other]))
        own += place
        its += place
        same = np.array_equal(data[own], data[its])
    if not same:
        known: dict[bytes, int] = {}
        inverse = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.unique(inverse, return_index=True)[1]
    return first, inverse


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, words of each text)`` of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    return starts, np.flatnonzero(stops) + 1, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, seed: int = 0) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z lower-cased; with fewer
    words, the whole sequence is one; without words the set is empty. Sets of different seeds have
    nothing in common but the texts."""
    data = LOWER[data]
    starts, ends, counts = words_at(data, offsets)
    h = segment_hashes(data, starts, ends, seed)
    n = len(h)
    rolled = np.zeros(n, U64)
    for i in range(k):
        left = max(0, n - i)
        rolled[:left] = mix(rolled[:left] * U64(0x2545F4914F6CDD1D) + h[i:])
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            x = np.array([c], U64)
            for i in range(c):
                x = mix(x * U64(0x2545F4914F6CDD1D) + h[at + i])
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
        at += c
    return out


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``, both longs; component is the smallest
    node that links reach.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond"). A step finds each node's smallest neighbour by a pre-aggregated ``groupBy`` and joins
    it back, that of hubs by broadcast. Only a count, a checksum and the hubs reach the driver.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def stepped(e: DataFrame) -> DataFrame:
        sym = both(e)
        low = sym.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = with_groups(sym, low, ["u"], "n", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    seen = state(now)
    while seen[0]:
        then, now = now, written(stepped(now), label)
        dropped(then)
        before, seen = seen, state(now)
        if before == seen:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out._marlstone_path = now._marlstone_path
    return out


class Union:
    """Union-find with path halving; the root of a set is its smallest index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
