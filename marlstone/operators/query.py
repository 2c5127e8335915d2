"""Query trees compiled to pairs of columns: does a row match, and with what weight.

A leaf compares plain columns where a field holds one value, so that Parquet gets the predicate, and uses
higher-order functions where it holds many. A null comparison is no match; ``WHERE`` and ``WHEN`` treat it so,
and only negation, parity and projection need it spelled out.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidValueError
from ..functions import geo, text
from ..plans.schema import Field
from .taxonomy import Taxonomy

def never() -> Column:
    return F.lit(False)


@dataclass
class Node:
    match: Column
    weight: Column | None = None  # None: 0 for every row
    dear: bool = False  # cut words or distances: tested after plain comparisons

    def score(self) -> Column:
        return F.lit(0.0) if self.weight is None else self.weight


@dataclass
class Type:
    """How one document type's fields lie in the collection's table.

    ``column(name, config)``: a field's values, one or an array; ``terms(config)``: for indexed text, the
    group's terms with positions, else None, and words are then cut from the column by ``pattern``.
    """

    name: str
    fields: dict[str, Field]
    column: Callable[[str, Field], Column]
    many: Callable[[str, Field], bool]
    terms: Callable[[Field], Column] | None = None
    guard: Column | None = None
    meta: Callable[[str, str | None], Column] | None = None
    pattern: str = text.WORD
    id_column: str = "doc_id"
    kinds: dict[str, str] = field(default_factory=dict)

    def find(self, name: str) -> Field | None:
        return self.fields.get(name)


# ---------------------------------------------------------------- values


def id_text(value) -> str:
    """A value as identifiers and exact fields take it: text, or a number from 0 to 2**64 - 1 in decimal."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, int | float) and int(value) == value and 0 <= value < 1 << 64:
        return str(int(value))
    raise InvalidValueError(f"neither text nor a number from 0 to 2**64 - 1: {value!r}")


def hashed(term: str, most: int) -> str:
    """``text.hashed_term`` on the driver."""
    data = term.encode()
    if len(data) <= most:
        return term
    keep = most - 6 if most >= 6 else 0
    h = 1
    for b in data[keep:]:
        h = (h * 33 + b) & 0xFFFFFFFF
    return data[:keep].decode("utf-8", "replace") + "".join(chr((h >> 6 * j & 63) + 33) if h >> 6 * j else " " for j in range(6))


def normal(config: Field, value) -> str:
    """A queried value as the index holds it."""
    v = id_text(value)
    if config.lowercase:
        v = v.lower()
    if len(v.encode()) > config.max_length:
        if config.too_long_action == "hash":
            return hashed(v, config.max_length)
        if config.too_long_action == "truncate":
            return v.encode()[: config.max_length].decode("utf-8", "ignore")
    return v


def normal_column(config: Field, values: Column) -> Column:
    """A stored value as ``normal`` makes it."""
    if config.lowercase:
        values = F.lower(values)
    if config.too_long_action == "hash":
        return text.hashed_term(values, config.max_length)
    if config.too_long_action == "truncate":
        return text.cut_term(values, config.max_length)
    return values


_DATE = re.compile(r"\s*(-?[0-9.]+)-(\d{1,2})-(\d{1,2})\s*")


def date_parts(value: str) -> tuple[float, int, int]:
    """Year (may be negative or fractional), month 1 to 12 and day 1 to 31, any day in any month."""
    m = _DATE.fullmatch(value) if isinstance(value, str) else None
    if not m or not 1 <= int(m[2]) <= 12 or not 1 <= int(m[3]) <= 31:
        raise InvalidValueError(f"not a date: {value!r}")
    return float(m[1]), int(m[2]), int(m[3])


def listed(value) -> list:
    return value if isinstance(value, list) else [value]


# ---------------------------------------------------------------- leaves


def _any(column: Column, many: bool, test: Callable[[Column], Column]) -> Column:
    return F.exists(column, test) if many else test(column)


def _is(t: Type, name: str, c: Field, values: list) -> Column:
    column, many = t.column(name, c), t.many(name, c)
    wanted = sorted({normal(c, v) for v in values})
    if not wanted:
        return never()
    if t.terms is not None and c.type != "id":
        lists = [F.lit(v) for v in wanted]
        return F.exists(t.terms(c), lambda x: x["term"].isin(*lists))
    if t.kinds.get(name) in ("int", "bigint", "smallint", "tinyint"):
        return column.isin([int(v) for v in wanted if re.fullmatch(r"\d+", v)])
    return _any(column, many, lambda x: normal_column(c, x).isin(wanted))


def _categories(t: Type, name: str, c: Field, kind: str, values: list, taxonomies: dict[str, Taxonomy]) -> Column:
    own = {id_text(v) for v in values}
    tree = taxonomies.get(c.taxonomy) or Taxonomy()
    below = {d for v in own for d in tree.descendants(v)}
    wanted = {"is": own, "is_descendant": below, "is_or_is_descendant": own | below}[kind]
    return _is(t, name, c, sorted(wanted))


def _range(t: Type, name: str, c: Field, value) -> Column:
    if not isinstance(value, list) or len(value) != 2:
        raise InvalidValueError("a range has exactly two ends")
    lo, hi = value
    column, many, kind = t.column(name, c), t.many(name, c), t.kinds.get(name, "")
    if c.type == "date":
        lo, hi = date_parts(lo), date_parts(hi)
        if kind.startswith(("date", "timestamp")):
            try:
                ends = [datetime.date(int(y), m, d) for y, m, d in (lo, hi)]
                return (column >= F.lit(ends[0])) & (column < F.lit(ends[1] + datetime.timedelta(days=1)))
            except ValueError:  # a day that the month doesn't have
                column = F.struct(F.year(column).cast("double"), F.month(column), F.dayofmonth(column))
        a, b = (F.struct(F.lit(y), F.lit(m), F.lit(d)) for y, m, d in (lo, hi))
        return _any(column, many, lambda x: (x >= a) & (x <= b))
    for x in (lo, hi):
        if isinstance(x, bool) or not isinstance(x, int | float):
            raise InvalidValueError(f"not a number: {x!r}")
        if c.type == "timestamp" and (not isinstance(x, int) or x < 0):
            raise InvalidValueError("ends of a timestamp range are whole seconds")
    if kind == "timestamp_ntz":  # wall time is read as UTC
        ends = [datetime.datetime.fromtimestamp(x, datetime.UTC).replace(tzinfo=None).isoformat(sep=" ") for x in (lo, hi)]
        return column.between(*[F.lit(x).cast("timestamp_ntz") for x in ends])
    if kind == "timestamp":
        return column.between(F.timestamp_seconds(F.lit(lo)), F.timestamp_seconds(F.lit(hi)))
    return _any(column, many, lambda x: x.between(float(lo), float(hi)))


def point_of(value) -> tuple[float, float]:
    """Longitude and latitude from ``[lon, lat]`` or an object with both."""
    try:
        lon, lat = (value["lon"], value["lat"]) if isinstance(value, dict) else value
        lon, lat = float(lon), float(lat)
    except (KeyError, TypeError, ValueError) as e:
        raise InvalidValueError(f"not a coordinate: {value!r}") from e
    if not -90 <= lat <= 90:
        raise InvalidValueError(f"latitude out of range: {lat}")
    return lon % 360.0, lat


def _distance(t: Type, name: str, c: Field, value) -> Node:
    if not isinstance(value, dict) or "center" not in value:
        raise InvalidValueError("distscore needs a center")
    lon, lat = point_of(value["center"])
    most = float(value.get("max_range") or 0)
    column = t.column(name, c)
    metres = geo.nearest(column if t.many(name, c) else F.array(column), lon, lat)
    match = metres <= most if most > 0 else metres.isNotNull()
    return Node(match, geo.weight(metres), dear=True)


def _positions(terms: Column, word: str) -> Column:
    return F.coalesce(F.element_at(F.filter(terms, lambda x: x["term"] == word), 1)["positions"], F.array().cast("array<int>"))


def _next_to(terms: Column, units: list[str]) -> Column:
    places = F.array(*[_positions(terms, w) for w in units])
    tests = lambda q, p: reduce(and_, [F.array_contains(q[i], p + i) for i in range(len(units))])
    return text.let(places, lambda q: F.exists(q[0], lambda p: tests(q, p)))


def _together(terms: Column, units: list[str], window: int) -> Column:
    places = F.array(*[_positions(terms, w) for w in dict.fromkeys(units)])
    return text.let(places, lambda q: F.exists(F.flatten(q), lambda p: F.forall(q, lambda own: F.exists(own, lambda x: (x >= p) & (x < p + window)))))


def cjk_units(query: str) -> list[str]:
    """One term for each position: the longest that starts there."""
    best: dict[int, str] = {}
    for term, pos in text.cjk_words(query):
        if len(term) > len(best.get(pos, "")):
            best[pos] = term
    return [best[p] for p in sorted(best)]


def _over_words(t: Type, name: str, c: Field, words: list[str], make: Callable) -> Column:
    """``make(has)``, where ``has(word)`` tests for a word: by its stem, unless it starts with a capital or the
    field has none. A plain column's words are cut, and stemmed, once for each row."""

    def by_stem(w: str) -> bool:
        return c.processor.startswith("stem_") and not w[:1].isupper()

    if t.terms is not None:
        terms, z = t.terms(c), F.col(f"`z_{c.group}`")

        def held(w: str) -> Column:
            low = w.lower()
            return F.array_contains(z, text.stem_english(low)) if by_stem(w) else F.exists(terms, lambda x: x["term"] == low)

        return make(held)
    tokens = text.words(t.column(name, c), t.pattern)
    if not any(map(by_stem, words)):
        return text.let(tokens, lambda x: make(lambda w: F.array_contains(x, w.lower())))
    both = F.struct(tokens.alias("t"), text.stems(tokens).alias("s"))
    return text.let(both, lambda x: make(lambda w: F.array_contains(x["s"], text.stem_english(w.lower())) if by_stem(w) else F.array_contains(x["t"], w.lower())))


def _text(t: Type, name: str, c: Field, value) -> Column:
    spec = value if isinstance(value, dict) else {"text": value}
    query, op, window = spec.get("text"), spec.get("op", "phrase"), spec.get("window")
    if not isinstance(query, str):
        raise InvalidValueError("a text query needs text")
    if op not in ("phrase", "near", "and", "or"):
        raise InvalidValueError(f"unknown text operator: {op!r}")
    cjk = c.processor == "cjk"
    units = cjk_units(query) if cjk else text.words_of(query, t.pattern, lower=False)
    if not units:
        return never()
    if op in ("and", "or"):
        wanted = list(dict.fromkeys(units))
        return _over_words(t, name, c, wanted, lambda has: reduce(and_ if op == "and" else or_, [has(w) for w in wanted]))
    units = [w.lower() for w in units]
    strict = spec.get("strict_window", False) or cjk
    span = max(int(window), len(units)) if window and strict else len(units)
    if t.terms is not None:
        terms = t.terms(c)
        if op == "phrase" and span == len(units):
            return _next_to(terms, units)
        return _together(terms, units, span)
    tokens = text.words(t.column(name, c), t.pattern)
    return text.has_phrase(tokens, units) if op == "phrase" and span == len(units) else text.has_near(tokens, units, span)


_TOKEN = re.compile(r'\(|\)|[^\s()"]+')


def _parse(t: Type, name: str, c: Field, value) -> Column:
    """A query string with AND, OR, NOT, XOR and brackets; words side by side are joined by ``op``."""
    spec = value if isinstance(value, dict) else {"text": value}
    query, op = spec.get("text"), spec.get("op", "and")
    if not isinstance(query, str) or op not in ("and", "or"):
        raise InvalidValueError("a parsed query needs text, and op and or or")
    if c.processor == "cjk":
        raise InvalidValueError("CJK text can't be parsed")
    tokens, at = _TOKEN.findall(query), 0
    has: Callable | None = None

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def level(word: str, below: Callable, join: Callable) -> Column | None:
        left = below()
        while peek() == word:
            take()
            right = below()
            left = right if left is None else left if right is None else join(left, right)
        return left

    def known(x: Column) -> Column:
        return F.coalesce(x, never())

    def either() -> Column | None:
        return level("OR", lambda: level("XOR", both, lambda a, b: known(a) != known(b)), or_)

    def both() -> Column | None:
        return level("AND", less, and_)

    def less() -> Column | None:
        return level("NOT", run, lambda a, b: a & ~known(b))

    def run() -> Column | None:
        parts = []
        while peek() not in (None, ")", "AND", "OR", "XOR", "NOT"):
            if take() == "(":
                inner = either()
                if peek() != ")":
                    raise InvalidValueError("a bracket is not closed")
                take()
                if inner is not None:
                    parts.append(inner)
            else:
                parts += [has(w) for w in text.words_of(tokens[at - 1], t.pattern, lower=False)]
        return reduce(and_ if op == "and" else or_, parts) if parts else None

    def whole(test: Callable) -> Column:
        nonlocal at, has
        at, has = 0, test
        found = either()
        if peek() is not None:
            raise InvalidValueError("a bracket is not opened")
        return never() if found is None else found

    words = [w for x in tokens if x not in ("(", ")", "AND", "OR", "XOR", "NOT") for w in text.words_of(x, t.pattern, lower=False)]
    return _over_words(t, name, c, words, whole)


_META = {"exists": "F", "nonempty": "N", "empty": "M", "error": "E"}


def _meta(t: Type, kind: str, names) -> Column:
    if kind not in _META:
        raise InvalidValueError(f"unknown meta query: {kind!r}")
    if t.meta is None:
        return never()
    wanted = [None] if names is None else listed(names)
    return reduce(or_, [t.meta(_META[kind], n) for n in wanted]) if wanted else never()


def _leaf(t: Type, name: str, c: Field, kind: str, value, taxonomies: dict[str, Taxonomy]) -> Node:
    if c.type in ("id", "exact") and kind == "is":
        return Node(_is(t, name, c, listed(value)))
    if c.type == "cat" and kind in ("is", "is_descendant", "is_or_is_descendant"):
        return Node(_categories(t, name, c, kind, listed(value), taxonomies))
    if c.type in ("double", "timestamp", "date") and kind == "range":
        return Node(_range(t, name, c, value), F.lit(1.0))
    if c.type == "lonlat" and kind == "distscore":
        return _distance(t, name, c, value)
    if c.type == "text" and kind == "text":
        return Node(_text(t, name, c, value), dear=True)
    if c.type == "text" and kind == "parse":
        return Node(_parse(t, name, c, value), dear=True)
    if c.type == "meta" and kind in _META:
        return Node(_meta(t, kind, value))
    raise InvalidValueError(f"a field of type {c.type} can't be asked for {kind!r}")


# ---------------------------------------------------------------- trees


def _guarded(t: Type, node: Node) -> Node:
    return node if t.guard is None else Node(t.guard & node.match, node.weight, node.dear)


def _sum(nodes: list[Node], only_matching: bool) -> Column | None:
    parts = [F.when(n.match, n.weight).otherwise(0.0) if only_matching else n.weight for n in nodes if n.weight is not None]
    return reduce(lambda a, b: a + b, parts) if parts else None


def _all(nodes: list[Node]) -> Column:
    """All match; what costs little is tested first."""
    return reduce(and_, [n.match for n in sorted(nodes, key=lambda n: n.dear)])


def _either(nodes: list[Node]) -> Node:
    if not nodes:
        return Node(never())
    return nodes[0] if len(nodes) == 1 else Node(reduce(or_, [n.match for n in nodes]), _sum(nodes, True), any(n.dear for n in nodes))


def compiled(query: dict | None, types: list[Type], taxonomies: dict[str, Taxonomy] | None = None) -> Node:
    """A query tree over a collection's types."""
    taxonomies = taxonomies or {}
    sub = lambda q: compiled(q, types, taxonomies)
    if not query:
        return Node(never())
    if not isinstance(query, dict) or not (len(query) == 1 or (set(query) == {"query", "filter"})):
        raise InvalidValueError("a query node has exactly one member")
    if len(query) == 2:  # sugar: the query beside its filter
        return sub({"filter": [query["query"] or {"matchall": True}, query["filter"]]})
    (kind, body), = query.items()
    if kind == "matchall":
        if body is not True:
            raise InvalidValueError("matchall is true")
        return Node(F.lit(True))
    if kind == "matchnothing":
        if body is not True:
            raise InvalidValueError("matchnothing is true")
        return Node(never())
    if kind == "field":
        if not isinstance(body, list) or len(body) != 3:
            raise InvalidValueError("a field query has a name, a type and a value")
        name, how, value = body
        found = [(t, c) for t in types if (c := t.find(name)) is not None]
        return _either([_guarded(t, _leaf(t, name, c, how, value, taxonomies)) for t, c in found])
    if kind == "meta":
        if not isinstance(body, list) or len(body) != 2:
            raise InvalidValueError("a meta query has a type and names")
        return _either([_guarded(t, Node(_meta(t, *body))) for t in types if t.meta is not None])
    if kind == "scale":
        factor = float(body.get("factor", 0.0))
        if factor < 0:
            raise InvalidValueError("a factor can't be negative")
        inner = sub(body.get("query"))
        return Node(inner.match, None if inner.weight is None else inner.weight * factor, inner.dear)
    if kind not in ("and", "or", "xor", "and_not", "and_maybe", "filter"):
        raise InvalidValueError(f"unknown query node: {kind!r}")
    if not isinstance(body, list) or (kind in ("and_not", "and_maybe", "filter") and len(body) < 2 and not (kind == "filter" and len(body) == 1)):
        raise InvalidValueError(f"{kind} takes a list of at least two queries")
    nodes = [sub(q) for q in body]
    if not nodes:
        return Node(never())
    first, rest, dear = nodes[0], nodes[1:], any(n.dear for n in nodes)
    if kind == "and":
        return Node(_all(nodes), _sum(nodes, False), dear)
    if kind == "or":
        return _either(nodes)
    if kind == "xor":
        odd = reduce(lambda a, b: a + b, [F.coalesce(n.match, never()).cast("int") for n in nodes])
        return Node(F.pmod(odd, F.lit(2)) == 1, _sum(nodes, True), dear)
    if kind == "and_not":
        others = ~F.coalesce(reduce(or_, [n.match for n in rest]), never())
        return Node(_all([first, Node(others, dear=any(n.dear for n in rest))]), first.weight, dear)
    if kind == "filter":
        return Node(_all(nodes), first.weight, dear)
    more = _sum(rest, True)
    return Node(first.match, first.weight if more is None else more if first.weight is None else first.weight + more, first.dear)
