"""JSON documents to indexed rows: one generated projection for each document type.

An indexed row: doc_type, doc_id, data (stored fields as JSON text of arrays), f_<slot> (sorted distinct
values), t_<group> (terms with positions), z_<group> (stems), meta (which fields are present, not empty,
empty or in error), errors, failed. Which fields exist is found in one pass over the documents' keys; what
they mean follows from their names alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.mapping import json_path
from ..operators.query import Type
from ..plans.schema import Field, Schema

_INVALID = r"""[\x00-\x1f:/\\.,\[\]{}]"""


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolved(docs: DataFrame, default_type: str = "default", id_field: str = "id", type_field: str = "type") -> DataFrame:
    """``docs(body[, doc_type, doc_id])`` with the body parsed, and type and id from the request or the
    body; ``_problem`` says why a document can't be used."""
    for name in ("doc_type", "doc_id"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    docs = _apart(docs, _v=F.try_parse_json("body"))
    first, inner = {}, {}
    for name, member in (("type", type_field), ("id", id_field)):
        v = F.try_variant_get("_v", json_path([member]), "variant")
        many = F.try_variant_get("_v", json_path([member]), "array<variant>")
        first[f"_n_{name}"] = F.when(many.isNotNull(), F.size(many)).when(v.isNotNull() & ~F.is_variant_null(v), 1).otherwise(0)
        first[f"_o_{name}"] = F.when(many.isNotNull(), F.when(F.size(many) > 0, F.element_at(many, 1))).otherwise(v)
        inner[name] = F.col(f"_{name}")
    docs = _apart(docs, **first)
    one = {n: F.col(f"_o_{n}") for n in inner}
    docs = _apart(docs, **{f"_{n}": F.when(o.isNotNull() & ~F.is_variant_null(o), id_value(o)) for n, o in one.items()})
    problem = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "not a JSON object")
        .when(F.col("_n_type") > 1, "several types")
        .when(F.col("_n_id") > 1, "several ids")
        .when((F.col("_n_id") == 1) & inner["id"].isNull(), "the id is neither text nor a whole number")
        .when(F.col("doc_type").isNotNull() & inner["type"].isNotNull() & (F.col("doc_type") != inner["type"]), "the types differ")
        .when(F.col("doc_id").isNotNull() & inner["id"].isNotNull() & (F.col("doc_id") != inner["id"]), "the ids differ")
    )
    docs = docs.withColumn("_problem", problem)
    docs = docs.withColumn("doc_type", F.coalesce("doc_type", inner["type"], F.lit(default_type))).withColumn("doc_id", F.coalesce("doc_id", inner["id"]))
    bad = F.when((F.col("doc_type") == "") | F.col("doc_type").rlike(_INVALID), "not a valid type").when((F.col("doc_id") == "") | F.col("doc_id").rlike(_INVALID), "not a valid id")
    return docs.withColumn("_problem", F.coalesce("_problem", bad)).drop("_n_type", "_n_id", "_o_type", "_o_id", "_type", "_id")


def _apart(docs: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that later uses don't copy their expressions."""
    return docs.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def id_value(v: Column) -> Column:
    """A JSON value as identifiers take it; null where it is neither text nor from 0 to 2**64 - 1."""
    kind, s = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    # A whole number: as many digits as 2**64 - 1 has, and then no more than it in the order of text.
    whole = s.rlike("^[0-9]{1,19}$") | (s.rlike("^[0-9]{20}$") & (s <= "18446744073709551615"))
    return (
        F.when(kind == "VOID", "")
        .when((kind == "STRING") | whole, s)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("string"))
    )


def number_value(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(kind != "STRING", F.try_variant_get(v, "$", "double"))


def text_value(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def date_value(v: Column) -> Column:
    s = text_value(v)
    part = lambda i: F.regexp_extract(s, r"^\s*(-?[0-9.]+)-(\d{1,2})-(\d{1,2})\s*$", i)
    y, m, d = part(1).try_cast("double"), part(2).try_cast("int"), part(3).try_cast("int")
    return F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31), F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def point_value(v: Column) -> Column:
    lon = F.coalesce(F.try_variant_get(v, "$[0]", "double"), F.try_variant_get(v, "$.lon", "double"))
    lat = F.coalesce(F.try_variant_get(v, "$[1]", "double"), F.try_variant_get(v, "$.lat", "double"))
    x, y = geo.stored(lon, lat)
    return F.when(lon.isNotNull() & lat.between(-90, 90), F.struct(x.alias("lon"), y.alias("lat")))


_VALUE = {"id": id_value, "exact": id_value, "cat": id_value, "text": text_value, "double": number_value, "timestamp": number_value, "date": date_value, "lonlat": point_value}
_MESSAGE = {
    "id": "neither text nor a number from 0 to 2**64 - 1", "text": "not text", "double": "not a number", "timestamp": "not a number",
    "date": "not a date", "lonlat": "not a coordinate",
}


def _values(name: str) -> tuple[Column, Column, Column]:
    """The field's values as an array (a lone value is an array of one, a top-level null none), whether
    it looks like one coordinate pair, and the raw value."""
    v = F.try_variant_get("_v", json_path([name]), "variant")
    kind = F.schema_of_variant(v)
    many = F.try_variant_get("_v", json_path([name]), "array<variant>")
    point = kind.startswith("ARRAY") & (F.size(many) == 2) & F.forall(many, lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    values = F.when(v.isNull() | F.is_variant_null(v), F.lit(None)).when(kind.startswith("ARRAY"), many).otherwise(F.array(v))
    return values, F.coalesce(point, F.lit(False)), v


def _blank(x: Column) -> Column:
    return F.is_variant_null(x) | ((F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") == ""))


# Spark counts a lambda's parameters, defaults too; what it needs besides is therefore bound here.
def _longer(most: int):
    return lambda x: F.octet_length(x) > most


def _shorter(most: int):
    return lambda x: F.octet_length(x) <= most


def _hashed(most: int):
    return lambda x: text.hashed_term(x, most)


def _cut(most: int):
    return lambda x: text.cut_term(x, most)


def _term(wdf: int):
    return lambda x: F.struct(x.alias("term"), F.lit(wdf).alias("wdf"), F.array().cast("array<int>").alias("positions"))


def typed_name(slot: str | int) -> str:
    return f"f_{slot}"


def indexed(docs: DataFrame, doc_type: str, schema: Schema, names: list[str], special: tuple[str, str, str] = ("id", "type", "_meta")) -> DataFrame:
    """The indexed rows of ``resolved`` documents of one type; ``names``: the fields that occur."""
    id_field, type_field, meta_field = special
    out = docs.where((F.col("doc_type") == doc_type) & F.col("_problem").isNull())
    keep = ["doc_type", "doc_id"] + (["seq"] if "seq" in docs.columns else [])
    known = [(n, c) for n in names if (c := schema.resolve(n)) is not None and c.type not in ("ignore",) and n != meta_field]
    meta_config = schema.resolve(meta_field)
    slots: dict[str, list[Column]] = {}
    groups: dict[tuple[str, str], list[Column]] = {}
    flat: dict[str, list[Column]] = {}
    stored: dict[str, Column] = {}
    errors: list[Column] = []
    flags: dict[str, list[Column]] = {k: [] for k in "FNME"}
    pre: dict[str, Column] = {}
    for i, (name, c) in enumerate(known):
        values, point, raw = _values(name)
        if c.type == "lonlat":
            values = F.when(point, F.array(raw)).otherwise(values)
        pre[f"_a{i}"] = values
        pre[f"_p{i}"] = raw.isNotNull()
    out = _apart(out.select(*keep, "_v"), **pre) if pre else out.select(*keep, "_v")
    text_arrays: dict[tuple[str, str], list[Column]] = {}
    for i, (name, c) in enumerate(known):
        a, present = F.col(f"_a{i}"), F.col(f"_p{i}")
        bad = F.lit(False)
        if c.type in _VALUE:
            made = F.transform(a, _VALUE[c.type])
            good = F.filter(made, lambda x: x.isNotNull())
            bad = F.exists(made, lambda x: x.isNull())
            if c.type in ("id", "exact", "cat"):
                if c.too_long_action == "error":
                    long_ = F.exists(good, _longer(c.max_length))
                    errors.append(F.when(long_, F.struct(F.lit(name).alias("field"), F.lit("too long").alias("message"))))
                    bad = bad | long_
                    terms = F.filter(good, _shorter(c.max_length))
                else:
                    terms = good
                if c.type == "exact" and c.lowercase:
                    terms = F.transform(terms, F.lower)
                if c.too_long_action == "hash":
                    terms = F.transform(terms, _hashed(c.max_length))
                elif c.too_long_action == "truncate":
                    terms = F.transform(terms, _cut(c.max_length))
                if c.group:
                    flat.setdefault(c.group, []).append(terms)
                    wdf = c.wdfinc
                    groups.setdefault((c.group, "term"), []).append(
                        F.transform(F.array_sort(F.array_distinct(terms)), _term(wdf))
                    )
            if c.type == "text":
                text_arrays.setdefault((c.group, c.processor), []).append(F.coalesce(good, F.array().cast("array<string>")))
            if c.slot != "" and c.slot is not None:
                slots.setdefault(typed_name(c.slot), []).append(F.slice(good, 1, 1) if c.type == "text" else good)
            errors.append(F.when(F.exists(made, lambda x: x.isNull()), F.struct(F.lit(name).alias("field"), F.lit(_MESSAGE.get(c.type, _MESSAGE["id"])).alias("message"))))
        if c.store_field:
            stored[c.store_field] = F.when(a.isNotNull(), F.to_json(a))
        if name not in (id_field, type_field):
            flags["F"].append(F.when(present, name))
            flags["N"].append(F.when(F.exists(a, lambda x: ~_blank(x)), name))
            flags["M"].append(F.when(present & (a.isNull() | F.exists(a, _blank)), name))
            flags["E"].append(F.when(bad, name))
    columns = [F.col(k) for k in keep]
    for k, parts in slots.items():
        columns.append(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p, F.filter(p, lambda x: F.lit(False))) if len(parts) == 1 else p for p in parts]))).alias(k))
    for (group, processor), parts in text_arrays.items():
        groups.setdefault((group, "term"), []).append((text.cjk_terms if processor == "cjk" else text.text_terms)(F.concat(*parts)))
        if processor.startswith("stem_"):
            words = F.flatten(F.transform(F.concat(*parts), lambda v: text.words(v)))
            groups.setdefault((group, "stem"), []).append(text.stems(words))
    empty = F.array().cast("array<struct<term:string,wdf:int,positions:array<int>>>")
    for (group, kind), parts in groups.items():
        if kind == "term":
            columns.append(F.concat(*[F.coalesce(p, empty) for p in parts]).alias(f"t_{group}"))
        else:
            columns.append(F.array_sort(F.array_distinct(F.concat(*parts))).alias(f"z_{group}"))
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in stored.items()]
    none = F.array().cast("array<struct<key:string,value:string>>")
    columns.append(F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()) if pairs else none).alias("data"))
    names_of = lambda k: F.array_sort(F.filter(F.array(*flags[k]), lambda x: x.isNotNull())) if flags[k] else F.array().cast("array<string>")
    if meta_config is not None:
        columns.append(F.struct(*[names_of(k).alias(k) for k in "FNME"]).alias("meta"))
    no_error = F.array().cast("array<struct<field:string,message:string>>")
    columns.append((F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else no_error).alias("errors"))
    return out.select(*columns)


def field_names(docs: DataFrame) -> dict[str, list[str]]:
    """The top-level keys of ``resolved`` documents, by type: one distinct pass."""
    keys = docs.where("_problem is null").select("doc_type", F.explode_outer(F.json_object_keys("body")).alias("k")).distinct().collect()
    out: dict[str, list[str]] = {}
    for r in keys:
        out.setdefault(r["doc_type"], []).extend([] if r["k"] is None else [r["k"]])
    return {t: sorted(k) for t, k in out.items()}


def problems(docs: DataFrame) -> DataFrame:
    """Documents that can't be used, and why."""
    return docs.where("_problem is not null").select("doc_type", "doc_id", "body", F.col("_problem").alias("message"))


def indexed_type(name: str, schema: Schema, columns: list[str]) -> Type:
    """How queries see the indexed rows of a type."""

    def column(field: str, c: Field) -> Column:
        if c.type == "id":
            return F.col("doc_id")
        if c.slot != "" and typed_name(c.slot) in columns:
            return quoted(typed_name(c.slot))
        return F.lit(None).cast("array<double>" if c.type in ("double", "timestamp") else "array<string>")

    def terms(c: Field) -> Column:
        here = f"t_{c.group}"
        return quoted(here) if here in columns else F.array().cast("array<struct<term:string,wdf:int,positions:array<int>>>")

    def meta(code: str, field: str | None) -> Column:
        return F.size(F.col(f"meta.{code}")) > 0 if field is None else F.array_contains(F.col(f"meta.{code}"), field)

    def any_meta(code: str, field: str | None) -> Column:
        return meta("N", field) | meta("M", field) if code == "F" and field is None else meta(code, field)

    fields = {n: c for n, c in schema.fields.items()}
    return Type(name, fields, column, lambda f, c: c.type != "id", terms, F.col("doc_type") == name, any_meta if "meta" in columns else None)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
