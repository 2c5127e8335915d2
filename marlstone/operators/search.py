"""Search requests: ranking, paging, display, facets and term statistics."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValueError, UnknownNameError
from ..functions import text
from .query import Node, Type, compiled
from .taxonomy import Taxonomy

log = logging.getLogger(__name__)
PAGE = 10_000  # how far around a document its page is looked for, when the request doesn't say


@dataclass
class Source:
    """What is searched: a table, its types, its keys, and how a stored field is shown."""

    table: DataFrame
    types: list[Type]
    keys: list[str]
    taxonomies: dict[str, Taxonomy]
    stored: dict[str, str] | None = None  # display name -> column; None: the map column ``data``
    type_column: str | None = None


@dataclass
class Order:
    column: Column
    ascending: bool


def _whole(request: dict, name: str, default: int, least: int) -> int:
    v = request.get(name, default)
    if isinstance(v, bool) or not isinstance(v, int) or v < least:
        raise InvalidValueError(f"{name} must be a whole number from {least}")
    return v


class Search:
    """One request over a source. Nothing runs until a result is asked for, but for ``fromdoc``, whose place is looked
    up at once."""

    def __init__(self, source: Source, request: dict, doc_type: str | None = None):
        if not isinstance(request, dict):
            raise InvalidValueError("a search is an object")
        self.source, self.request, self.doc_type = source, request, doc_type
        self.types = [t for t in source.types if doc_type is None or t.name == doc_type]
        self.start = _whole(request, "from", 0, 0)
        self.size = _whole(request, "size", 10, -1)
        self.check = _whole(request, "check_at_least", 0, -1)
        self.node: Node = compiled(request.get("query"), self.types, source.taxonomies)
        self.orders = self._orders(request.get("order_by"))
        if request.get("fromdoc") is not None:
            self.start = self._from_document(request["fromdoc"])

    # ---- rows

    @property
    def scope(self) -> DataFrame:
        """All documents of the searched types."""
        guards = [t.guard for t in self.types if t.guard is not None]
        if self.doc_type is None:
            return self.source.table
        return self.source.table.where(reduce(or_, guards)) if guards else self.source.table if self.types else self.source.table.limit(0)

    @cached_property
    def matches(self) -> DataFrame:
        """All matching rows with their weight, unordered."""
        return self.scope.where(self.node.match).withColumn("_score", self.node.score())

    def _orders(self, order_by) -> list[Order]:
        if order_by is None:
            return [Order(F.col("_score"), False)] if self.node.weight is not None else []
        if not isinstance(order_by, list):
            raise InvalidValueError("order_by is a list")
        out = []
        for i, item in enumerate(order_by):
            if item.get("score") == "weight":
                if i not in (0, len(order_by) - 1) or sum("score" in x for x in order_by) > 1:
                    raise InvalidValueError("the score comes first or last, once")
                if item.get("ascending", False):
                    raise InvalidValueError("the score is only for descending order")
                out.append(Order(F.col("_score"), False))
                continue
            name = item.get("field")
            found = [(t, c) for t in self.types if (c := t.find(name)) is not None and c.type not in ("ignore", "stored", "meta", "text")]
            if not found:
                log.warning("no field to order by: %s", name)
                continue
            keys = [F.when(t.guard, self._key(t, name, c)) if t.guard is not None else self._key(t, name, c) for t, c in found]
            out.append(Order(F.coalesce(*keys) if len(keys) > 1 else keys[0], bool(item.get("ascending", True))))
        return out

    @staticmethod
    def _key(t: Type, name: str, c) -> Column:
        """The smallest value, whatever the direction."""
        column = t.column(name, c)
        return F.array_min(column) if t.many(name, c) else column

    def _sorting(self) -> list[Column]:
        return [o.column.asc_nulls_last() if o.ascending else o.column.desc_nulls_last() for o in self.orders] + [F.col(k).asc() for k in self.source.keys]

    @property
    def ordered(self) -> DataFrame:
        return self.matches.orderBy(*self._sorting())

    def _from_document(self, spec: dict) -> int:
        """Where the page starts, relative to a document's rank: the number of rows that sort before it,
        counted without sorting."""
        if self.request.get("from", 0) != 0:
            raise InvalidValueError("from must be 0 beside fromdoc")
        if not isinstance(spec, dict) or any(spec.get(k) in (None, "") for k in ("type", "id")):
            raise InvalidValueError("fromdoc needs a type and an id")
        _whole(spec, "pagesize", PAGE, 1)  # checked only: rows are counted, not paged through
        keys = self.source.keys
        mine = self.matches
        if self.source.type_column:
            mine = mine.where(F.col(self.source.type_column) == str(spec.get("type")))
        mine = mine.where(F.col(keys[-1]).cast("string") == str(spec.get("id")))
        names = [f"_k{i}" for i in range(len(self.orders))]
        row = mine.select(*[o.column.alias(n) for o, n in zip(self.orders, names, strict=True)], *[F.col(k).alias(f"_d_{k}") for k in keys]).first()
        if row is None:
            raise UnknownNameError(f"document {spec.get('id')!r} is not among the results")
        before, same = F.lit(False), F.lit(True)
        steps = [(o.column, o.ascending, row[n]) for o, n in zip(self.orders, names, strict=True)]
        for column, up, value in [*steps, *[(F.col(k), True, row[f"_d_{k}"]) for k in keys]]:
            if value is None:
                ahead, equal = column.isNotNull(), column.isNull()
            else:
                ahead, equal = (column < F.lit(value)) if up else (column > F.lit(value)), column == F.lit(value)
            before = before | (same & F.coalesce(ahead, F.lit(False)))
            same = same & F.coalesce(equal, F.lit(False))
        return max(0, self.matches.where(before).count() + int(spec.get("from", 0)))

    def page(self) -> DataFrame:
        """The asked rows in order, all columns."""
        rows = self.ordered
        if self.size < 0:
            return rows.offset(self.start) if self.start else rows
        return rows.offset(self.start).limit(self.size) if self.start else rows.limit(self.size)

    def items(self) -> DataFrame:
        """The asked rows in order, as displayed."""
        wanted = self.request.get("display")
        rows = self.page()
        if self.source.stored is None:
            data = F.col("data") if wanted is None else F.map_filter("data", lambda k, _: k.isin(list(wanted)))
            return rows.select(*self.source.keys, data.alias("data"), "_score")
        names = list(self.source.stored) if wanted is None else [n for n in wanted if n in self.source.stored]
        return rows.select(*[F.col(self.source.stored[n]).alias(n) for n in names], "_score")

    # ---- counts and statistics

    def counts(self) -> DataFrame:
        """``(total_docs, matches)`` in one scan."""
        hits = F.count_if(F.coalesce(self.node.match, F.lit(False)))
        return self.scope.agg(F.count("*").alias("total_docs"), hits.alias("matches"))

    def total_docs(self) -> int:
        return self.scope.count()

    def count(self) -> int:
        return self.matches.count()

    def _first(self, spec: dict) -> DataFrame:
        limit = spec.get("doc_limit")
        return self.matches if limit is None else self.ordered.limit(int(limit))

    def facet_counts(self, spec: dict) -> DataFrame:
        """``(value, count)`` of a field among the results, the most frequent first."""
        values = self._facet_values(spec.get("field"))
        seen = self._first(spec).select(F.explode(values).alias("value")) if values is not None else self.matches.limit(0).select(F.lit("").alias("value"))
        counts = seen.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("value"))
        return counts if spec.get("result_limit") is None else counts.limit(int(spec["result_limit"]))

    def _facet_values(self, name: str) -> Column | None:
        found = [(t, c) for t in self.types if (c := t.find(name)) is not None and c.type not in ("ignore", "stored", "meta")]
        if not found:
            return None
        if len({(c.type, c.slot) for _, c in found}) > 1:
            raise InvalidValueError(f"types disagree on the slot of {name!r}")
        t, c = found[0]
        column = t.column(name, c)
        if c.type == "date" and t.kinds.get(name, "").startswith(("date", "timestamp")):
            column = F.struct(F.year(column).alias("year"), F.month(column).alias("month"), F.dayofmonth(column).alias("day"))
        if t.many(name, c):
            return F.array_distinct(column)
        return F.when(column.isNotNull(), F.array(column))

    def _group_terms(self, spec: dict) -> Column:
        """Each row's distinct terms of a group that start with the prefix, cut after it."""
        group, prefix = spec.get("group", ""), spec.get("prefix", "")
        parts = []
        for t in self.types:
            for name, c in t.fields.items():
                if c.group == group and c.type in ("text", "exact", "cat"):
                    if t.terms is not None:
                        part = F.transform(t.terms(c), lambda x: x["term"])
                    elif c.type == "text":
                        part = text.words(t.column(name, c), t.pattern)
                    else:
                        part = t.column(name, c) if t.many(name, c) else F.array(t.column(name, c))
                    parts.append(F.when(t.guard, part) if t.guard is not None else part)
        if not parts:
            return F.array().cast("array<string>")
        empty = F.array().cast("array<string>")
        terms = F.array_distinct(F.concat(*[F.coalesce(p, empty) for p in parts]))
        if prefix:
            terms = F.transform(F.filter(terms, lambda x: x.startswith(prefix)), lambda x: F.substring(x, len(prefix) + 1, 1 << 30))
        stop = spec.get("stopwords")
        return F.array_except(terms, F.array(*[F.lit(s) for s in stop])) if stop else terms

    def occurrences(self, spec: dict) -> DataFrame:
        """``(term, count[, termfreq])``: in how many results each term stands, and in how many documents
        of the collection."""
        terms = self._group_terms(spec)
        if spec.get("get_termfreqs") and spec.get("doc_limit") is None:  # one scan cuts all words once
            guards = [t.guard for t in self.types if t.guard is not None]
            here = self.node.match if self.doc_type is None or not guards else self.node.match & reduce(or_, guards)
            here = here if self.types else F.lit(False)
            seen = self.source.table.select(F.coalesce(here, F.lit(False)).alias("here"), F.explode(terms).alias("term"))
            counts = seen.groupBy("term").agg(F.count_if("here").alias("count"), F.count("*").alias("termfreq")).where("count > 0")
        else:
            counts = self._first(spec).select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("count"))
            if spec.get("get_termfreqs"):
                everywhere = self.source.table.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("termfreq"))
                counts = counts.join(everywhere, "term", "left")
        counts = counts.orderBy(F.desc("count"), F.asc("term"))
        return counts if spec.get("result_limit") is None else counts.limit(int(spec["result_limit"]))

    def cooccurrences(self, spec: dict) -> DataFrame:
        """``(term1, term2, count[, ...])`` for pairs of terms in one document, the first the smaller."""
        terms = F.array_sort(self._group_terms(spec))
        rows = self._first(spec).select(terms.alias("terms")).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms")))))
        pairs = rows.where(F.size("terms") > 1).select(F.element_at("terms", F.col("i")).alias("term1"), F.explode(F.expr("slice(terms, i + 1, size(terms))")).alias("term2"))
        counts = pairs.groupBy("term1", "term2").agg(F.count("*").alias("count"))
        if spec.get("get_termfreqs"):
            everywhere = self.source.table.select(F.explode(self._group_terms(spec)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
            for k in ("1", "2"):
                counts = counts.join(everywhere.select(F.col("t").alias(f"term{k}"), F.col("n").alias(f"termfreq{k}")), f"term{k}", "left")
        counts = counts.orderBy(F.desc("count"), "term1", "term2")
        return counts if spec.get("result_limit") is None else counts.limit(int(spec["result_limit"]))

    def info(self) -> list[dict]:
        """Results of the request's info entries in order; unknown ones contribute nothing."""
        out = []
        for entry in self.request.get("info", []):
            if not isinstance(entry, dict) or len(entry) != 1:
                raise InvalidValueError("an info entry has exactly one member")
            (kind, spec), = entry.items()
            if kind == "facet_count":
                name = spec.get("field")
                values = self._facet_values(name)
                seen, total = 0, 0
                if values is not None:
                    row = self._first(spec).agg(F.count("*").alias("d"), F.sum(F.coalesce(F.size(F.coalesce(values, F.array())), F.lit(0))).alias("v")).first()
                    seen, total = row["d"], row["v"] or 0
                counts = [[_plain(r["value"]), r["count"]] for r in self.facet_counts(spec).collect()]
                out.append({"type": kind, "fieldname": name, "docs_seen": seen, "values_seen": total, "counts": counts})
            elif kind in ("occur", "cooccur"):
                frame = self.occurrences(spec) if kind == "occur" else self.cooccurrences(spec)
                terms = self._group_terms(spec)
                row = self._first(spec).agg(F.count("*").alias("d"), F.sum(F.size(terms)).alias("t")).first()
                out.append(
                    {"type": kind, "prefix": spec.get("prefix", ""), "docs_seen": row["d"], "terms_seen": row["t"] or 0, "counts": [list(r) for r in frame.collect()]}
                )
        return out

    def to_dict(self) -> dict:
        """The response: exact counts, the items, and the statistics asked for."""
        total, found = self.counts().first()
        size = self.size if self.size >= 0 else total
        limits = [spec["doc_limit"] for e in self.request.get("info", []) for spec in e.values() if spec.get("doc_limit") is not None]
        check = max([total if self.check < 0 else self.check, *limits])
        out = {
            "from": self.start, "size_requested": size, "check_at_least": check, "total_docs": total,
            "matches_lower_bound": found, "matches_estimated": found, "matches_upper_bound": found, "items": [_item(r.asDict(recursive=True)) for r in self.items().collect()],
        }
        if "info" in self.request:
            out["info"] = self.info()
        if self.request.get("verbose"):
            out["query_description"] = self.matches._jdf.queryExecution().optimizedPlan().toString()
        return out


def _plain(v):
    return list(v) if hasattr(v, "asDict") else v


def _item(row: dict) -> dict:
    row.pop("_score", None)
    return {k: json.loads(v) for k, v in (row["data"] or {}).items()} if isinstance(row.get("data"), dict) else row
