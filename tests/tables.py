"""Comparing tables as sets of rows."""

import math


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(cell(v) for v in x)
    return x


def rows_of(df) -> tuple[list[str], list[tuple]]:
    """Columns in the order of their names, rows in any order that is the same for equal tables."""
    names = sorted(df.columns)
    rows = [tuple(cell(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, sorted(rows, key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    rows = [tuple(cell(r[i]) for i in order) for r in found.fetchall()]
    return [found.columns[i] for i in order], sorted(rows, key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def same_types(df, found) -> bool:
    """Whether a table and a DuckDB relation have the same columns of the same types."""
    return sorted((c, TYPES.get(t, t)) for c, t in df.dtypes) == sorted((c, str(t)) for c, t in zip(found.columns, found.types, strict=True))
