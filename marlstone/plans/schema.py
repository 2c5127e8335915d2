"""Field types, name patterns and per-type schemas."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from ..errors import InvalidValueError

FORMAT = 3
#: Members of each type's configuration with their defaults; None: required.
MEMBERS: dict[str, dict] = {
    "id": {"max_length": 64, "too_long_action": "error", "slot": "", "store_field": ""},
    "exact": {"group": None, "max_length": 64, "too_long_action": "error", "wdfinc": 0, "lowercase": False, "slot": "", "store_field": ""},
    "text": {"group": None, "processor": "", "slot": "", "store_field": ""},
    "double": {"slot": "", "store_field": ""},
    "timestamp": {"slot": "", "store_field": ""},
    "date": {"slot": "", "store_field": ""},
    "cat": {"group": None, "taxonomy": None, "max_length": 64, "too_long_action": "error", "slot": "", "store_field": ""},
    "lonlat": {"slot": "", "store_field": ""},
    "stored": {"store_field": None},
    "ignore": {},
    "meta": {"group": None, "slot": ""},
}


def valid_name(name: str) -> str:
    """A collection, type, document or category name; no control characters nor any of ``:/\\.,[]{}``."""
    if not isinstance(name, str) or not name or re.search(r"[\x00-\x1f:/\\.,\[\]{}]", name):
        raise InvalidValueError(f"not a valid name: {name!r}")
    return name


#: Processors that stem: English is the only language whose stems are made here; others are refused, not stemmed as English.
STEMMERS = ("stem_en", "stem_english")


@dataclass(frozen=True)
class Field:
    """One field's configuration."""

    type: str
    group: str = ""
    slot: str | int = ""
    store_field: str = ""
    max_length: int = 64
    too_long_action: str = "error"
    wdfinc: int = 0
    lowercase: bool = False
    processor: str = ""
    taxonomy: str = ""

    @staticmethod
    def of(config: dict) -> Field:
        kind = config.get("type")
        if kind not in MEMBERS:
            raise InvalidValueError(f"unknown field type: {kind!r}")
        values = {"type": kind}
        for name, default in MEMBERS[kind].items():
            value = config.get(name, default)
            if value is None:
                raise InvalidValueError(f"a field of type {kind} needs {name}")
            if default is None and (not isinstance(value, str) or "\t" in value or not value):
                raise InvalidValueError(f"{name} must be text without tabs")
            if name == "max_length" and (not isinstance(value, int) or not 0 < value <= 240):
                raise InvalidValueError("max_length must be from 1 to 240")
            if name == "too_long_action" and value not in ("error", "hash", "truncate"):
                raise InvalidValueError(f"unknown too_long_action: {value!r}")
            if name == "processor" and not (value in ("", "cjk") or value in STEMMERS):
                raise InvalidValueError(f"unknown processor: {value!r}")
            values[name] = value
        return Field(**values)

    def config(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k == "type" or k in MEMBERS[self.type]}


def matched(pattern: str, name: str) -> str | None:
    """What the leading ``*`` of a pattern stands for in a name ('' for a literal one); None: no match."""
    if pattern.startswith("*"):
        return name[: len(name) - len(pattern) + 1] if name.endswith(pattern[1:]) else None
    return "" if pattern == name else None


@dataclass
class Schema:
    """The fields of one document type; unknown ones are configured by the first pattern that fits."""

    fields: dict[str, Field] = field(default_factory=dict)
    patterns: list[tuple[str, dict]] = field(default_factory=list)

    @staticmethod
    def of(config: dict) -> Schema:
        s = Schema()
        s.merge(config)
        return s

    def merge(self, config: dict) -> None:
        """Adds fields; a field's configuration can't change. A non-empty pattern list replaces the old."""
        for name, c in config.get("fields", {}).items():
            self.set(name, Field.of(c))
        if config.get("patterns"):
            for pattern, c in config["patterns"]:
                if "*" in pattern[1:]:
                    raise InvalidValueError(f"only a leading * is allowed: {pattern!r}")
                Field.of(c)
            self.patterns = [(p, dict(c)) for p, c in config["patterns"]]

    def set(self, name: str, config: Field) -> None:
        if self.fields.get(name, config) != config:
            raise InvalidValueError(f"field {name!r} has another configuration")
        self.fields[name] = config

    def get(self, name: str) -> Field | None:
        return self.fields.get(name)

    def resolve(self, name: str) -> Field | None:
        """The field's configuration, made from the patterns if it is new; None: skip it."""
        if name not in self.fields:
            for pattern, config in self.patterns:
                prefix = matched(pattern, name)
                if prefix is not None:
                    made = {k: v.replace("*", prefix, 1) if isinstance(v, str) else v for k, v in config.items()}
                    self.fields[name] = Field.of(made)
                    break
        return self.fields.get(name)

    def field_list(self, request: dict) -> list[str]:
        """The fields that a request displays: those that it lists, or all."""
        display = request.get("display")
        if display is None:
            return sorted(self.fields)
        if not isinstance(display, list) or any(not isinstance(n, str) for n in display):
            raise InvalidValueError("display is a list of names")
        return display

    def stored_names(self) -> list[str]:
        return sorted({f.store_field for f in self.fields.values() if f.store_field})

    def to_json(self) -> dict:
        return {"fields": {n: f.config() for n, f in sorted(self.fields.items())}, "patterns": [[p, c] for p, c in self.patterns]}


def default_patterns() -> list[tuple[str, dict]]:
    """What fields mean by their names: ``*_text``, ``text``, ``*_num`` ... and ``*``."""
    out: list[tuple[str, dict]] = []
    long_, cats = {"max_length": 100, "too_long_action": "hash"}, {"max_length": 32, "too_long_action": "hash"}
    for suffix, kind, letter, places, more in (
        ("text", "text", "t", ("group",), {"processor": "stem_en"}),
        ("num", "double", "n", ("slot",), {}),
        ("time", "timestamp", "d", ("slot",), {}),
        ("tag", "exact", "g", ("group", "slot"), long_),
        ("url", "exact", "u", ("group", "slot"), long_),
        ("cat", "cat", "c", ("group", "slot"), cats),
        ("lonlat", "lonlat", "l", ("slot",), {}),
    ):
        for star, name in (("*", f"*_{suffix}"), ("", suffix)):
            config = {"type": kind, "store_field": name} | {p: letter + star for p in places} | more
            out.append((name, config | ({"taxonomy": name} if kind == "cat" else {})))
    out.append(("id", {"type": "id", "store_field": "id"}))
    out.append(("type", {"type": "exact", "group": "!", "slot": 1, "store_field": "type"}))
    out.append(("_meta", {"type": "meta", "group": "#", "slot": 0}))
    out.append(("*", {"type": "text", "group": "t", "store_field": "*"}))
    return out


def default_schema() -> Schema:
    return Schema({}, default_patterns())
