"""Collections: documents of several types with schemas, pipes, categorisers and taxonomies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidValueError, UnknownNameError
from .operators.categorise import Categoriser
from .operators.mapping import Pipe, loads, send
from .operators.query import Type
from .operators.search import Search, Source
from .operators.taxonomy import Taxonomy
from .plans.schema import FORMAT, Field, Schema, default_schema, valid_name
from .sources import ingest
from .sources.store import Store, latest
from .streaming.checkpoints import Checkpoints, ErrorLog


def typed(
    df: DataFrame, fields: dict[str, dict], *, name: str = "default", id_column: str | None = None, columns: dict[str, Column] | None = None,
    taxonomies: dict[str, Taxonomy] | None = None, pattern: str | None = None, meta: bool = True, type_column: str | None = None,
) -> Source:
    """An existing table as a source, without a JSON round trip: fields read plain columns, so filters and
    column pruning reach the scan. ``columns``: fields that are expressions of others."""
    schema = {n: Field.of(c) for n, c in fields.items()}
    added = {n: c for n, c in (columns or {}).items()}
    if added:
        df = df.withColumns(added)
    kinds = dict(df.dtypes)
    arrays = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}

    def presence(code: str, field: str | None) -> Column:
        names = [field] if field is not None else [n for n, c in schema.items() if c.type not in ("id", "meta")]
        tests = [F.col(n).isNotNull() if code in "FN" else F.col(n).isNull() if code == "M" else F.lit(False) for n in names if n in kinds]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    guard = (F.col(type_column) == name) if type_column else None
    more = {} if pattern is None else {"pattern": pattern}
    t = Type(name, schema, lambda f, c: F.col(f), lambda f, c: f in arrays, None, guard, presence if meta else None, kinds=kinds, **more)
    keys = [k for k in (type_column, id_column) if k]
    return Source(df, [t], keys, taxonomies or {}, {n: n for n in kinds if n not in added or n in fields}, type_column)


def together(sources: list[Source], type_column: str = "doc_type") -> Source:
    """Sources of one type each as one, told apart by ``type_column``."""
    types, frames, stored = [], [], {}
    for s in sources:
        t = s.types[0]
        frames.append(s.table.withColumn(type_column, F.lit(t.name)))
        t.guard = F.col(type_column) == t.name
        types.append(t)
        stored |= s.stored
    key = "doc_id" if all("doc_id" in f.columns for f in frames) else None
    return Source(ingest.union(frames), types, [type_column] + ([key] if key else []), {}, {type_column: type_column} | stored, type_column)


class Collection:
    """A named store with its configuration. Writes are buffered until ``commit``; searches see the last
    commit."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.store = spark, valid_name(name), Store(spark, path)
        self.special = {"id_field": "id", "type_field": "type", "meta_field": "_meta"}
        self._reset()
        saved = self.store.config()
        if saved:
            self.load_config(saved)
        self._pending: list[DataFrame] = []
        self._seq = self.store.state()["seq"] + 1
        self.errors = ErrorLog()
        self.checkpoints = Checkpoints()

    def _reset(self) -> None:
        self.default_type = default_schema().to_json()
        self.types: dict[str, Schema] = {}
        self.pipes: dict[str, Pipe] = {}
        self.categorisers: dict[str, Categoriser] = {}
        self.taxonomies: dict[str, Taxonomy] = {}

    # ---- configuration

    def config(self) -> dict:
        return {
            "format": FORMAT, "default_type": self.default_type, "special_fields": self.special,
            "types": {n: s.to_json() for n, s in self.types.items()}, "pipes": {n: p.to_json() for n, p in self.pipes.items()},
            "categorisers": {n: c.to_json() for n, c in self.categorisers.items()}, "taxonomies": {n: t.to_json() for n, t in self.taxonomies.items()},
        }

    def load_config(self, config: dict | str) -> None:
        """Replaces types, pipes, categorisers and taxonomies; the rest stays where it isn't given."""
        config = loads(config) if isinstance(config, str) else config
        if config.get("format") != FORMAT:
            raise InvalidValueError(f"the configuration's format must be {FORMAT}")
        self.default_type = config.get("default_type", self.default_type)
        self.special = {**self.special, **config.get("special_fields", {})}
        self.types = {n: Schema.of(c) for n, c in config.get("types", {}).items()}
        self.pipes = {n: Pipe.of(c) for n, c in config.get("pipes", {}).items()}
        self.categorisers = {n: Categoriser.of(c) for n, c in config.get("categorisers", {}).items()}
        self.taxonomies = {n: Taxonomy(c) for n, c in config.get("taxonomies", {}).items()}

    def put_config(self, config: dict | str) -> None:
        self.load_config(config)
        self.store.save_config(self.config())

    def schema(self, doc_type: str) -> Schema:
        if doc_type not in self.types:
            raise UnknownNameError(f"no type {doc_type!r}")
        return self.types[doc_type]

    def put_schema(self, doc_type: str, config: dict) -> None:
        self.types.setdefault(valid_name(doc_type), Schema()).merge(config)

    def _get(self, table: dict, name: str):
        if name not in table:
            raise UnknownNameError(name)
        return table[name]

    def pipe(self, name: str) -> Pipe:
        return self._get(self.pipes, name)

    def put_pipe(self, name: str, config: dict | str) -> None:
        self.pipes[name] = Pipe.of(loads(config) if isinstance(config, str) else config)

    def categoriser(self, name: str) -> Categoriser:
        return self._get(self.categorisers, name)

    def put_categoriser(self, name: str, categoriser: Categoriser | dict) -> None:
        self.categorisers[name] = categoriser if isinstance(categoriser, Categoriser) else Categoriser.of(categoriser)

    def categorise(self, name: str, sample: str) -> list[str]:
        return self.categoriser(name).categorise(sample)

    def taxonomy(self, name: str) -> Taxonomy:
        return self._get(self.taxonomies, name)

    def put_taxonomy(self, name: str, parents: dict[str, list[str]]) -> Taxonomy:
        self.taxonomies[valid_name(name)] = Taxonomy(parents)
        return self.taxonomies[name]

    def delete_taxonomy(self, name: str) -> None:
        self.taxonomies.pop(name, None)

    def taxonomy_groups(self, name: str) -> list[str]:
        """The groups whose category fields use a taxonomy."""
        return sorted({c.group for s in self.types.values() for c in s.fields.values() if c.type == "cat" and c.taxonomy == name})

    # ---- documents

    def _type(self, doc_type: str) -> Schema:
        if doc_type not in self.types:
            self.types[doc_type] = Schema.of(self.default_type)
        return self.types[doc_type]

    def process(self, docs: DataFrame) -> DataFrame:
        """Indexed rows of ``docs(body[, doc_type, doc_id, seq])``; new fields join the schemas."""
        s = self.special
        found = ingest.resolved(docs, "default", s["id_field"], s["type_field"])
        frames = []
        for doc_type, names in sorted(ingest.field_names(found).items()):
            frames.append(ingest.indexed(found, doc_type, self._type(doc_type), names, (s["id_field"], s["type_field"], s["meta_field"])))
        if not frames:
            empty = "doc_type string, doc_id string, data map<string,string>, errors array<struct<field:string,message:string>>"
            return self.spark.createDataFrame([], empty)
        return ingest.union(frames)

    def put_all(self, docs: DataFrame) -> None:
        """Adds ``docs(body[, doc_type, doc_id])``."""
        self._pending.append(docs.withColumn("seq", F.lit(self._seq)).withColumn("op", F.lit("put")))
        self._seq += 1

    def put(self, doc: dict | str, doc_type: str | None = None, doc_id: str | None = None, raise_on_error: bool = False) -> None:
        """Adds one document; with ``raise_on_error``, one whose type, id or fields are in error is refused
        at once instead of being told at the next checkpoint."""
        body = doc if isinstance(doc, str) else json.dumps(doc)
        docs = self.spark.createDataFrame([(body, doc_type, doc_id)], "body string, doc_type string, doc_id string")
        if raise_on_error:
            s = self.special
            for r in ingest.problems(ingest.resolved(docs, "default", s["id_field"], s["type_field"])).collect():
                raise InvalidValueError(r["message"])
            for r in self.process(docs).select(F.explode("errors").alias("e")).select("e.*").collect():
                raise InvalidValueError(f"{r['field']}: {r['message']}")
        self.put_all(docs)

    def delete(self, doc_type: str, doc_id: str) -> None:
        row = self.spark.createDataFrame([("{}", doc_type, str(doc_id))], "body string, doc_type string, doc_id string")
        self._pending.append(row.withColumn("seq", F.lit(self._seq)).withColumn("op", F.lit("delete")))
        self._seq += 1

    def pipe_all(self, docs: DataFrame, name: str, doc_type: str | None = None) -> None:
        """Sends ``docs(body)`` through a pipe; what leaves it is added."""
        made = send(docs.select("body"), name, self.pipes, self.categorisers)
        self.put_all(made if doc_type is None else made.withColumn("doc_type", F.lit(doc_type)))

    def import_all(self, docs: DataFrame, pipe: str = "default", doc_type: str | None = None) -> str:
        """Imports ``docs(body, problem)`` of a document store: problems go to the error log, the others
        through a pipe and into a commit. The id of the checkpoint behind them."""
        bad = docs.where("problem is not null")
        self._log(bad.select(F.lit(doc_type).cast("string").alias("doc_type"), F.lit(None).cast("string").alias("doc_id"), F.col("problem").alias("message")))
        self.pipe_all(docs.where("problem is null"), pipe, doc_type)
        return self.checkpoint()

    def apply(self, commands: DataFrame, batch: int = -1) -> None:
        """Applies ``commands(seq, op, doc_type, doc_id, body)`` in the order of seq and commits; commands that come
        after ones of larger numbers don't undo them. A batch that is already in the store is passed over."""
        state = self.store.state()
        if 0 <= batch <= state["batch"]:
            return
        s = self.special
        columns = ["seq", "op", "doc_type", "doc_id", "body"]
        found = ingest.resolved(commands.select(*columns), "default", s["id_field"], s["type_field"]).select(*columns, "_problem").cache()
        number = lambda test: F.count_if(F.expr(test))
        low, top, bad, deletes = found.agg(F.min("seq"), F.max("seq"), number("op = 'put' and _problem is not null"), number("op = 'delete'")).first()
        if bad:
            self._log(ingest.problems(found.where("op = 'put'")))
        last = latest(found.where("_problem is null").select(*columns)).cache()
        rows = self.process(last.where("op = 'put'")).cache()
        if rows.agg(F.sum(F.size("errors"))).first()[0]:
            self._log(rows.select("doc_type", "doc_id", F.explode("errors").alias("e")).select("doc_type", "doc_id", F.concat_ws(": ", "e.field", "e.message").alias("message")))
        gone = last.where("op = 'delete'").select("doc_type", "doc_id", F.col("seq").cast("long").alias("seq")) if deletes else None
        put = rows.withColumn("seq", F.col("seq").cast("long")) if "seq" in rows.columns else rows
        self.store.commit(put, gone, batch, -1 if top is None else int(top), late=low is not None and low <= state["seq"])
        self.store.save_config(self.config())
        self.errors = self.checkpoints.reach(self.store.state()["seq"], self.errors)
        for made in (rows, last, found):
            made.unpersist()

    def _log(self, problems: DataFrame) -> None:
        """Counts all problems; the first of them come to the driver."""
        listed = problems.limit(self.errors.most).collect()
        for r in listed:
            self.errors.append(r["message"], r["doc_type"], r["doc_id"])
        if len(listed) == self.errors.most:
            self.errors.total += problems.count() - len(listed)

    def commit(self) -> None:
        if self._pending:
            commands = ingest.union(self._pending)
            for c in ("doc_type", "doc_id"):
                if c not in commands.columns:
                    commands = commands.withColumn(c, F.lit(None).cast("string"))
            self._pending = []
            self.apply(commands)

    # ---- reading

    def source(self) -> Source:
        table = self.store.table()
        if table is None:
            table = self.spark.createDataFrame([], "doc_type string, doc_id string, data map<string,string>")
        types: list[Type] = [ingest.indexed_type(n, s, table.columns) for n, s in sorted(self.types.items())]
        return Source(table, types, ["doc_type", "doc_id"], self.taxonomies, None, "doc_type")

    def search(self, request: dict | str, doc_type: str | None = None) -> Search:
        return Search(self.source(), loads(request) if isinstance(request, str) else request, doc_type)

    def search_file(self, path: str, doc_type: str = "default") -> Search:
        """A search whose request is in a file."""
        return self.search("\n".join(r[0] for r in self.spark.read.text(path).collect()), doc_type)

    def get(self, doc_type: str, doc_id) -> dict | None:
        """A document's data, terms and values; None if there is none."""
        table = self.source().table
        row = table.where((F.col("doc_type") == doc_type) & (F.col("doc_id") == str(doc_id))).first()
        if row is None:
            return None
        row = row.asDict(recursive=True)
        out: dict = {"data": {k: json.loads(v) for k, v in (row["data"] or {}).items()}, "terms": {}, "values": {}}
        for k, v in row.items():
            if k.startswith("t_") and v:
                for t in v:
                    out["terms"][f"{k[2:]}\t{t['term']}"] = {n: t[n] for n in ("wdf", "positions") if t[n]}
            elif k.startswith("z_") and v:
                out["terms"] |= {f"Z{k[2:]}\t{t}": {} for t in v}
            elif k.startswith("f_") and v:
                out["values"][k[2:]] = v
        return {k: v for k, v in out.items() if v}

    def info(self) -> dict:
        return {"doc_count": self.source().table.count()}

    def checkpoint(self, commit: bool = True) -> str:
        """The id of a new checkpoint behind all that has been put so far, which is committed unless told
        otherwise."""
        name = self.checkpoints.publish(self._seq - 1)
        if commit:
            self.commit()
        self.errors = self.checkpoints.reach(self.store.state()["seq"], self.errors)
        return name

    def get_fields(self, doc_type: str, doc_id, display: list[str] | None = None) -> dict | None:
        """A document's stored fields: those asked for, or all that the type's schema stores."""
        names = self.schema(doc_type).stored_names() if display is None else display
        found = self.get(doc_type, doc_id)
        return None if found is None else {n: found["data"][n] for n in names if n in found.get("data", {})}

    def drop(self) -> None:
        """Deletes documents and configuration."""
        self.store.remove()
        self._reset()
        self._pending = []


class Engine:
    """All collections below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def collection(self, name: str) -> Collection:
        return Collection(self.spark, name, f"{self.path}/{valid_name(name)}")

    def collections(self) -> list[str]:
        fs, p = Store(self.spark, self.path)._file("")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def status(self) -> dict:
        return {"collections": len(self.collections()), "streams": [q.status for q in self.spark.streams.active]}
