"""Checkpoints of a collection's command log: named points in it, and the errors since the point before."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

#: Errors that a checkpoint lists, and seconds after which one that nobody asks about is forgotten.
MOST_ERRORS, MOST_AGE = 100, 86_400.0


@dataclass
class ErrorLog:
    """The first errors, and how many there were."""

    most: int = MOST_ERRORS
    total: int = 0
    errors: list[dict] = field(default_factory=list)

    def append(self, message: str, doc_type: str | None = None, doc_id: str | None = None) -> None:
        if len(self.errors) < self.most:
            self.errors.append({"msg": message} | ({"doc_type": doc_type} if doc_type else {}) | ({"doc_id": doc_id} if doc_id else {}))
        self.total += 1

    def to_json(self) -> dict:
        return {"total_errors": self.total, "errors": list(self.errors)}


@dataclass
class _Point:
    seq: int
    log: ErrorLog | None = None
    touched: float = field(default_factory=time.monotonic)


class Checkpoints:
    """Checkpoints by id. One is reached once the committed seq is at or beyond its own."""

    def __init__(self):
        self._points: dict[str, _Point] = {}

    def publish(self, seq: int, name: str | None = None) -> str:
        name = name or uuid.uuid4().hex
        self._points.setdefault(name, _Point(seq))
        return name

    def reach(self, seq: int, log: ErrorLog) -> ErrorLog:
        """Marks those up to seq; the first of them takes the errors. Returns the log to go on with."""
        for p in sorted((p for p in self._points.values() if p.log is None and p.seq <= seq), key=lambda p: p.seq):
            p.log, log, p.touched = log, ErrorLog(log.most), time.monotonic()
        return log

    def state(self, name: str) -> dict | None:
        """None for one that isn't known."""
        p = self._points.get(name)
        if p is None:
            return None
        p.touched = time.monotonic()
        return {"reached": False} if p.log is None else {"reached": True, **p.log.to_json()}

    def ids(self) -> list[str]:
        return sorted(self._points)

    def expire(self, most_age: float = MOST_AGE) -> None:
        """Forgets those that nobody has asked about for so many seconds."""
        now = time.monotonic()
        self._points = {k: p for k, p in self._points.items() if now - p.touched < most_age}
