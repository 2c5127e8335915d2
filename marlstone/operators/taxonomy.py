"""Taxonomies: category graphs with their closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidValueError, UnknownNameError
from ..plans.schema import valid_name


class Taxonomy:
    """A named acyclic graph of categories, edited on the driver (some hundred categories).

    Every edit returns the categories whose neighbours or closure it changed. Documents keep their own
    categories; ancestors are looked up when a query runs, so nothing is rewritten after an edit.
    """

    def __init__(self, parents: dict[str, list[str]] | None = None):
        self.parents: dict[str, set[str]] = {}
        for category, above in (parents or {}).items():
            self.add(category)
            for p in above:
                self.add_parent(category, p)

    # ---- edits

    def _edit(self, change) -> set[str]:
        before = {c: self.view(c) for c in self.parents}
        change()
        after = {c: self.view(c) for c in self.parents}
        return {c for c in before.keys() | after.keys() if before.get(c) != after.get(c)}

    def add(self, category: str) -> set[str]:
        valid_name(category)
        return set() if category in self.parents else self._edit(lambda: self.parents.setdefault(category, set()))

    def add_parent(self, category: str, parent: str) -> set[str]:
        if valid_name(category) == valid_name(parent):
            raise InvalidValueError(f"{category!r} can't be its own parent")
        if category in self.ancestors(parent):
            raise InvalidValueError(f"{parent!r} is below {category!r}")

        def change() -> None:
            self.parents.setdefault(parent, set())
            self.parents.setdefault(category, set()).add(parent)

        return self._edit(change)

    def remove(self, category: str) -> set[str]:
        def change() -> None:
            self.parents.pop(category, None)
            for above in self.parents.values():
                above.discard(category)

        return self._edit(change)

    def remove_parent(self, category: str, parent: str) -> set[str]:
        return self._edit(lambda: self.parents.get(category, set()).discard(parent))

    # ---- lookups

    def _reach(self, start: str, step) -> set[str]:
        seen: set[str] = set()
        todo = list(step(start))
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += step(c)
        return seen

    def children(self, category: str) -> set[str]:
        return {c for c, above in self.parents.items() if category in above}

    def ancestors(self, category: str) -> set[str]:
        return self._reach(category, lambda c: self.parents.get(c, set()))

    def descendants(self, category: str) -> set[str]:
        below: dict[str, list[str]] = {}
        for c, above in self.parents.items():
            for p in above:
                below.setdefault(p, []).append(c)
        return self._reach(category, lambda c: below.get(c, []))

    def view(self, category: str) -> dict[str, list[str]]:
        if category not in self.parents:
            raise UnknownNameError(category)
        return {
            "parents": sorted(self.parents[category]),
            "ancestors": sorted(self.ancestors(category)),
            "children": sorted(self.children(category)),
            "descendants": sorted(self.descendants(category)),
        }

    def is_parent(self, category: str, parent: str) -> bool:
        return parent in self.parents.get(category, set())

    def top(self) -> dict[str, dict[str, int]]:
        """Categories without parents, with how many children and descendants each has."""
        return {
            c: {"child_count": len(self.children(c)), "descendant_count": len(self.descendants(c))}
            for c, above in sorted(self.parents.items())
            if not above
        }

    def to_json(self) -> dict[str, list[str]]:
        return {c: sorted(above) for c, above in sorted(self.parents.items())}

    # ---- tables

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = [(c, p) for c, above in self.parents.items() for p in sorted(above)]
        return spark.createDataFrame(rows, "category string, parent string")


def closure(edges: DataFrame) -> DataFrame:
    """``(category, ancestor)`` for all of ``edges(category, parent)``, by a recursive query."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE up(category, ancestor) AS (
             SELECT category, parent FROM {edges}
             UNION ALL
             SELECT up.category, e.parent FROM up JOIN {edges} e ON up.ancestor = e.category
           ) SELECT DISTINCT category, ancestor FROM up""",
        edges=edges,
    )
