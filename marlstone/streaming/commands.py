"""The ordered command log of a collection on Structured Streaming.

Commands lie in a folder as files and have numbers, ``seq``. Put and delete change documents: the last command of a key
wins, whatever files and micro-batches its commands came in. The others are barriers (what precedes one is committed
before it): config, schema, pipe, categoriser and taxonomy set what ``doc_id`` names (a schema: the type that
``doc_type`` names) to their body, drop_taxonomy takes one away, and checkpoint publishes the one that doc_id names.
Each micro-batch is applied as a whole, and one that comes again after a failure changes nothing. One query is
the only writer of a collection; it applies back-pressure by ``per_trigger``, the files of a batch, and tells
writers how full the log is (``status``), which may refuse more (``append``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection
from ..errors import InvalidValueError, QueueFullError
from ..operators.mapping import loads
from ..sources.store import Store

SCHEMA = "seq long, op string, doc_type string, doc_id string, body string"


DOCUMENTS = ("put", "delete")
#: Waiting commands from which on the log counts as low on space, and as full.
LOW, FULL = 1_000_000, 10_000_000


class CommandLog:
    def __init__(self, spark: SparkSession, collection: Collection, path: str, per_trigger: int = 1000, low: int = LOW, full: int = FULL):
        self.spark, self.collection, self.path, self.per_trigger = spark, collection, path.rstrip("/"), per_trigger
        self.low, self.full = low, full

    def status(self) -> dict:
        """How many commands wait, and what room that leaves: HAS_SPACE, LOW_SPACE or FULL."""
        fs, p = Store(self.spark, self.path)._file("log")
        waiting = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/log").where(F.col("seq") > self.collection.store.state()["seq"]).count() if fs.exists(p) else 0
        return {"waiting": waiting, "space": "FULL" if waiting >= self.full else "LOW_SPACE" if waiting >= self.low else "HAS_SPACE"}

    def append(self, commands: DataFrame, unless_full: bool = False) -> None:
        """Adds ``commands(seq, op, doc_type, doc_id, body)``; with ``unless_full``, a full log refuses them."""
        if unless_full and self.status()["space"] == "FULL":
            raise QueueFullError("the command log is full")
        commands.select("seq", "op", "doc_type", "doc_id", "body").write.mode("append").parquet(f"{self.path}/log")

    def start(self, *, once: bool = True, idle: str = "5 seconds") -> StreamingQuery:
        """Runs the log: what is there now, or for ever with a commit every ``idle``."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", self.per_trigger).parquet(f"{self.path}/log")
        writer = stream.writeStream.option("checkpointLocation", f"{self.path}/progress").foreachBatch(
            self._applied
        )
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=idle)).start()

    def _applied(self, batch: DataFrame, number: int) -> None:
        """Documents up to each barrier, the barrier, and at last the rest with the batch's number. A batch that comes
        again in part applies the same commands to the same end."""
        if 0 <= number <= self.collection.store.state()["batch"]:
            return
        barriers = batch.where(~F.col("op").isin(*DOCUMENTS)).orderBy("seq").collect()
        batch = self._spread(batch)
        batch = batch.persist() if barriers else batch
        documents, at = batch.where(F.col("op").isin(*DOCUMENTS)), None
        for r in barriers:
            part = documents.where(F.col("seq") < r["seq"])
            part = part if at is None else part.where(F.col("seq") > at)
            if not part.isEmpty():
                self.collection.apply(part)
            self._barrier(r)
            at = r["seq"]
        self.collection.apply(documents if at is None else documents.where(F.col("seq") > at), number)
        if barriers:
            batch.unpersist()

    def _spread(self, batch: DataFrame) -> DataFrame:
        """A batch of few large files is dealt over all cores, since parsing its commands takes far longer than reading them."""
        least = 2 * self.spark.sparkContext.defaultParallelism
        return batch if batch.rdd.getNumPartitions() >= least else batch.repartition(least, "seq")

    def _barrier(self, r) -> None:
        c, op, name, body = self.collection, r["op"], r["doc_id"], r["body"]
        if op == "checkpoint":
            c.checkpoints.publish(r["seq"], name)
            c.store.commit(c.process(self.spark.createDataFrame([], SCHEMA)), seq=r["seq"])
            c.errors = c.checkpoints.reach(r["seq"], c.errors)
            return
        try:
            if op == "config":
                c.load_config(body)
            elif op == "schema":
                c.put_schema(r["doc_type"], loads(body))
            elif op == "pipe":
                c.put_pipe(name, body)
            elif op == "categoriser":
                c.put_categoriser(name, loads(body))
            elif op == "taxonomy":
                c.put_taxonomy(name, loads(body))
            elif op == "drop_taxonomy":
                c.delete_taxonomy(name)
            else:
                raise InvalidValueError(f"unknown command: {op!r}")
        except (AttributeError, KeyError, TypeError, ValueError) as e:  # a bad command is told, and the log goes on
            c.errors.append(str(e), r["doc_type"], name)
        c.store.save_config(c.config())

    def reached(self, seq: int) -> dict:
        """The state of a checkpoint."""
        if self.collection.store.state()["seq"] < seq:
            return {"reached": False}
        return {"reached": True, **self.collection.errors.to_json()}
