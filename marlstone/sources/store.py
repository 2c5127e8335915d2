"""Versioned snapshots of a collection in a folder: Parquet tables, a configuration, a pointer.

A version is a base, partitioned by document type, and deltas: rows put since the base was written, and marks of deleted
keys. A commit appends one delta, with what it changes alone, and then writes the pointer; only when deltas have grown
to a share of the base, or in number, are they merged into it. Pointer and configuration are numbered files that are renamed
into place and never replaced: a reader takes the one with the largest number, so it sees all of a commit
or nothing of it, and a writer that dies between any two steps leaves the version before. One writer at a time.

Rows keep the number of their command. Where commands come later than ones of larger numbers, those of the
same key that are in the store already win, deletions too, which is why marks of deleted keys stay in the base.
Readers leave out the base's rows whose keys the deltas hold (an anti-join, which lets filters through to the
scan). Files go through Hadoop's file system API.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a file at most; the share of the base's rows, and the number of deltas, beyond which they are merged into it.
FRAGMENT, MERGE, DELTAS = 100_000_000, 0.125, 16
KEYS, GONE, SEQ = ["doc_type", "doc_id"], "_deleted", "_seq"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder that the session names; only where it names none and all work is
    done on this machine (tests), in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/marlstone/{label}-{uuid.uuid4().hex}"


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="marlstone-")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- small files

    def _file(self, name: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str) -> list[int]:
        fs, top = self._file("")
        if not fs.exists(top):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(top))
        return sorted(int(n[len(name) + 1 :]) for n in names if n.startswith(f"{name}.") and n[len(name) + 1 :].isdigit())

    def read_text(self, name: str) -> str | None:
        """What was written last."""
        found = self._numbers(name)
        if not found:
            return None
        fs, p = self._file(f"{name}.{found[-1]}")
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, content: str) -> None:
        """A new numbered file, written beside and renamed; the one before stays for readers at work, older ones go."""
        found = self._numbers(name)
        new = f"{name}.{found[-1] + 1 if found else 1}"
        fs, p = self._file(new)
        _, side = self._file(f"{new}-{uuid.uuid4().hex}")
        stream = fs.create(side, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        if fs.exists(p) or not fs.rename(side, p):
            raise RuntimeError(f"another writer has made {new}")
        for n in found[:-1]:
            self.remove(f"{name}.{n}")

    def remove(self, name: str = "") -> None:
        fs, p = self._file(name)
        fs.delete(p, True)

    # ---- state

    def state(self) -> dict:
        """version, batch (the last stream batch in it), seq (the largest command), and the parts: name, rows and
        schema of the base, the newest delta, and the older ones."""
        return json.loads(self.read_text("_pointer.json") or '{"version": 0, "batch": -1, "seq": -1, "base": null, "delta": null, "older": []}')

    def config(self) -> dict | None:
        content = self.read_text("_config.json")
        return None if content is None else json.loads(content)

    def save_config(self, config: dict) -> None:
        self.write_text("_config.json", json.dumps(config, sort_keys=True))

    def _read(self, part: dict | None) -> DataFrame | None:
        return None if part is None else self.spark.read.schema(T.StructType.fromJson(part["schema"])).parquet(f"{self.path}/{part['name']}")

    def _write(self, rows: DataFrame, name: str) -> dict:
        path = f"{self.path}/{name}"
        rows.write.mode("overwrite").option("maxRecordsPerFile", FRAGMENT).partitionBy("doc_type").parquet(path)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        return {"name": name, "rows": self.spark.read.schema(schema).parquet(path).count(), "schema": schema.jsonValue()}

    def _deltas(self, state: dict) -> DataFrame | None:
        """The last change of each key since the base was written."""
        parts = [*state["older"], state["delta"]] if state["delta"] else []
        frames = [self._read(p).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        if len(frames) < 2:
            return frames[0].drop("_part") if frames else None
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return latest(both.withColumn("_order", F.struct(SEQ, "_part")).drop("_part"), "_order").drop("_order")

    def _all(self, state: dict) -> DataFrame | None:
        base, delta = self._read(state["base"]), self._deltas(state)
        return base if base is None or delta is None else upserted(base, delta)

    def table(self) -> DataFrame | None:
        """The committed rows."""
        found = self._all(self.state())
        return None if found is None else found.where(f"not {GONE}").drop(GONE, SEQ)

    def commit(self, rows: DataFrame, deleted: DataFrame | None = None, batch: int = -1, seq: int = -1, late: bool = False) -> int:
        """Puts rows and takes keys away; the new version's number. Rows have their command's number in ``seq``, or ``seq`` is
        that of all; ``late``: some may be older than what is in the store."""
        state = self.state()
        v, top = state["version"] + 1, max(seq, state["seq"])
        new = {"version": v, "batch": max(batch, state["batch"]), "seq": top, "base": state["base"], "delta": None, "older": []}
        number = lambda df: df.withColumnRenamed("seq", SEQ) if "seq" in df.columns else df.withColumn(SEQ, F.lit(top).cast("long"))
        changes = number(rows).withColumn(GONE, F.lit(False))
        if deleted is not None:
            gone = number(deleted.select(*KEYS, *[c for c in deleted.columns if c == "seq"]))
            changes = changes.unionByName(gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        if state["base"] is None:
            new["base"] = self._write(changes, f"base-{v}")
        else:
            if late:
                there = self._all(state).where("doc_id is not null").select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col(SEQ).alias("_there"))
                same = reduce(lambda a, b: a & b, [changes[k] == there[f"_{k}"] for k in KEYS])
                changes = changes.join(there, same & (there["_there"] > changes[SEQ]), "left_anti")
            new["older"] = [*state["older"], state["delta"]] if state["delta"] else []
            new["delta"] = self._write(changes, f"delta-{v}")
            parts = [*new["older"], new["delta"]]
            if sum(p["rows"] for p in parts) > MERGE * new["base"]["rows"] or len(parts) > DELTAS:
                new["base"], new["delta"], new["older"] = self._write(self._all(new), f"base-{v}"), None, []
        self.write_text("_pointer.json", json.dumps(new))
        self._sweep(v, {p["name"] for s in (state, new) for p in (s["base"], s["delta"], *s["older"]) if p})
        return v

    def _sweep(self, version: int, keep: set[str]) -> None:
        """Removes what neither this version nor the last one reads: readers of that may still be at work."""
        fs, top = self._file("")
        for s in fs.listStatus(top):
            name = s.getPath().getName()
            if name.startswith(("base-", "delta-")) and name not in keep and int(name.rpartition("-")[2]) < version:
                self.remove(name)


def latest(commands: DataFrame, order: str = "seq") -> DataFrame:
    """The last command of each (doc_type, doc_id); rows without doc_id are documents of their own."""
    keyed = commands.where("doc_id is not null")
    rest = [c for c in commands.columns if c not in ("doc_type", "doc_id")]
    last = keyed.groupBy("doc_type", "doc_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("doc_type", "doc_id", *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    return last.select(*commands.columns).unionByName(commands.where("doc_id is null"))


def upserted(old: DataFrame | None, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Old rows with those of the same key replaced, and deleted keys gone."""
    if old is None:
        return new
    gone = new.select(*KEYS) if deleted is None else new.select(*KEYS).unionByName(deleted.select(*KEYS))
    return old.join(gone.where("doc_id is not null").distinct(), KEYS, "left_anti").unionByName(new, allowMissingColumns=True)
