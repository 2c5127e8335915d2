"""JSON restructuring: conditions, mappings and pipes.

``Pipe.column`` applies a pipe's mappings to a column of JSON texts with one Arrow UDF; conditions on fixed
paths also compile to VARIANT expressions (``condition_column``), which need no Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValueError, UnknownNameError
from .categorise import Categoriser

_ABSENT = object()
_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|/\*.*?\*/|//[^\n]*', re.S)


def loads(source: str):
    """JSON, in which comments are allowed."""
    return json.loads(_COMMENT.sub(lambda m: m[1] or " ", source))


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def valid_path(path) -> list:
    if isinstance(path, str):
        return [path]
    if not isinstance(path, list) or any(isinstance(p, bool) or not isinstance(p, str | int) or (isinstance(p, int) and p < 0) for p in path):
        raise InvalidValueError(f"a path holds names and positions: {path!r}")
    return path


def at(value, path: list):
    """What stands at a path; ``_ABSENT`` if nothing does."""
    for p in path:
        if isinstance(p, str) and isinstance(value, dict) and p in value:
            value = value[p]
        elif isinstance(p, int) and isinstance(value, list) and p < len(value):
            value = value[p]
        else:
            return _ABSENT
    return value


def walk(value, path: tuple = ()) -> Iterator[tuple[str, tuple, object]]:
    """Events start, leaf and end with their paths, depth first."""
    if isinstance(value, dict | list) and value:
        yield "start", path, value
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from walk(v, (*path, k))
        yield "end", path, value
    else:
        yield "leaf", path, value


def evaluate(clause: dict | None, doc):
    """The value of a condition clause: exists, get, literal or equals."""
    if not isinstance(clause, dict) or len(clause) != 1:
        raise InvalidValueError("a condition has exactly one member")
    (kind, body), = clause.items()
    if kind == "exists":
        return at(doc, valid_path(body)) is not _ABSENT
    if kind == "get":
        found = at(doc, valid_path(body))
        return None if found is _ABSENT else found
    if kind == "literal":
        return body
    if kind == "equals":
        values = [canonical(evaluate(c, doc)) for c in body]
        return all(v == values[0] for v in values)
    raise InvalidValueError(f"unknown condition: {kind!r}")


def json_path(path: list) -> str:
    """The path in Spark's notation."""
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in valid_path(path))


def condition_column(clause: dict, variant: Column) -> Column:
    """``evaluate`` as a column: boolean for exists and equals, canonical JSON text otherwise."""
    (kind, body), = clause.items()
    if kind == "exists":
        return F.lit(True) if body == [] else F.try_variant_get(variant, json_path(body), "variant").isNotNull()
    if kind == "get":
        return F.coalesce(F.to_json(F.try_variant_get(variant, json_path(body), "variant")), F.lit("null"))
    if kind == "literal":
        return F.lit(canonical(body))
    if kind == "equals":
        parts = [condition_column(c, variant) for c in body]
        out = F.lit(True)
        for p in parts[1:]:
            out = out & p.eqNullSafe(parts[0])
        return out
    raise InvalidValueError(f"unknown condition: {kind!r}")


def _place(path: list) -> list[tuple]:
    """Sorts paths as a walk through a document meets them."""
    return [(0, p, b"") if isinstance(p, int) else (1, 0, p.encode()) for p in path]


@dataclass
class Mapping:
    """Picks fields of a document into a new one."""

    rules: list[dict] = field(default_factory=list)
    when: dict | None = None
    default: str = "preserve_top"

    @staticmethod
    def of(config: dict) -> Mapping:
        default = config.get("default", "preserve_top")
        if default not in ("preserve_top", "discard"):
            raise InvalidValueError(f"unknown default: {default!r}")
        rules = [dict(r, **{"from": valid_path(r["from"])}) for r in config.get("map", [])]
        if any(not isinstance(r.get("to"), str) for r in rules):
            raise InvalidValueError("a rule maps to a name")
        return Mapping(rules, config.get("when"), default)

    def to_json(self) -> dict:
        out: dict = {"map": self.rules} if self.rules else {}
        if self.default != "preserve_top":
            out["default"] = self.default
        return out | ({"when": self.when} if self.when is not None else {})

    def apply(self, doc, categorisers: dict[str, Categoriser] | None = None) -> dict | None:
        """The new document, all values in lists; None if the condition doesn't hold. Values come in the
        order in which they stand in the document, with names in the order of their bytes."""
        if not isinstance(doc, dict):
            raise InvalidValueError("a mapping takes an object")
        if self.when is not None and not evaluate(self.when, doc):
            return None
        out: dict[str, list] = {}

        def put(name: str, value) -> None:
            if value == [] or name not in out:
                out[name] = []
            out[name] += value if isinstance(value, list) else [value]

        by_top: dict[str, list[dict]] = {}
        for r in sorted(self.rules, key=lambda r: _place(r["from"])):
            if r["from"]:
                by_top.setdefault(r["from"][0], []).append(r)
        for top in sorted(doc, key=str.encode):
            found = [(r, v) for r in by_top.get(top, []) if (v := at(doc, r["from"])) is not _ABSENT]
            for r, value in found:
                put(r["to"], self._category(r["categoriser"], value, categorisers or {}) if r.get("categoriser") else value)
            if not found and self.default == "preserve_top":
                put(top, doc[top])
        return out

    @staticmethod
    def _category(name: str, value, categorisers: dict[str, Categoriser]):
        """Labels of a text or of an array's texts; an empty text where there is none."""
        if name not in categorisers:
            raise UnknownNameError(name)
        sample = value if isinstance(value, str) else "".join(f"{v} " for v in value if isinstance(v, str)) if isinstance(value, list) else ""
        return categorisers[name].categorise(sample) if sample else ""


@dataclass
class Pipe:
    """Mappings tried in turn: the first that applies, or all; results go to a target pipe or the index."""

    mappings: list[Mapping] = field(default_factory=list)
    apply_all: bool = False
    target: str = ""

    @staticmethod
    def of(config: dict) -> Pipe:
        if not isinstance(config, dict):
            raise InvalidValueError("a pipe is an object")
        return Pipe([Mapping.of(m) for m in config.get("mappings", [])], bool(config.get("apply_all", False)), config.get("target", ""))

    def to_json(self) -> dict:
        return {"mappings": [m.to_json() for m in self.mappings], "apply_all": self.apply_all, "target": self.target}

    def apply(self, doc, categorisers: dict[str, Categoriser] | None = None) -> list[dict]:
        out = []
        for m in self.mappings:
            new = m.apply(doc, categorisers)
            if new is not None:
                out.append(new)
                if not self.apply_all:
                    break
        return out

    def column(self, body: Column, categorisers: dict[str, Categoriser] | None = None) -> Column:
        """What a pipe makes of a column of documents. A body that is no JSON object passes unchanged, for
        the index to report."""
        pipe = self

        def one(b: str | None) -> list[str] | None:
            try:
                doc = None if b is None else json.loads(b)
            except ValueError:
                doc = None
            if not isinstance(doc, dict):
                return None if b is None else [b]
            return [json.dumps(d, ensure_ascii=False, sort_keys=True) for d in pipe.apply(doc, categorisers)]

        @F.pandas_udf("array<string>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield part.map(one)

        return run(body)


def send(docs: DataFrame, name: str, pipes: dict[str, Pipe], categorisers: dict[str, Categoriser] | None = None) -> DataFrame:
    """``(body)`` of ``docs(body)`` after a pipe and those that follow it."""
    passed: list[str] = []
    while name:
        if name not in pipes:
            raise UnknownNameError(f"no pipe {name!r}")
        if name in passed:
            raise InvalidValueError(f"pipes form a loop: {' -> '.join([*passed, name])}")
        passed.append(name)
        docs = docs.select(F.explode(pipes[name].column(F.col("body"), categorisers)).alias("body"))
        name = pipes[name].target
    return docs
