"""Errors that callers can tell apart."""


class InvalidValueError(ValueError):
    """A request, schema or document value that has no meaning here."""


class UnknownNameError(KeyError):
    """A collection, type, pipe, categoriser, taxonomy or category that doesn't exist."""


class QueueFullError(RuntimeError):
    """The command log takes no more for now."""
