"""Errors that a query, the catalogue or an insert can raise."""


class LoomError(Exception):
    """Base of all errors of this library."""


class QueryError(LoomError):
    """A query text can't be planned."""


class QuerySyntaxError(QueryError):
    """The text isn't in the language."""


class UnsupportedError(QueryError):
    """The text is in the language, but the construct isn't served; `label` names it."""

    def __init__(self, label: str):
        super().__init__(f"unsupported: {label}")
        self.label = label


class TimeRangeError(QueryError, ValueError):
    """A start or end of the time range is missing or they are turned round."""


class NoStreamsMatchedError(QueryError):
    """A selector matches no stream."""


class CatalogError(LoomError):
    """A stream can't be created, found or told apart."""


class ValueTypeError(LoomError, TypeError):
    """An inserted value isn't of the stream's type."""
