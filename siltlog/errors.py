"""Errors, with the codes that remote callers see."""


class SearchError(Exception):
    code = 1001


class BadRequest(SearchError):
    code = 1002


class NotAuthorized(SearchError):
    code = 1003


class QuerySyntaxError(BadRequest):
    """A query that can't be parsed: what is left of it, and where that begins."""

    def __init__(self, message: str, text: str, at: int):
        self.remaining = text[at:]
        self.line = text.count("\n", 0, at) + 1
        self.column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} at line {self.line}, column {self.column}: {self.remaining[:40]!r}")


class QueryExecutionError(BadRequest):
    """A query that parses but can't be run: an unknown function, a value of the wrong kind."""


class ContractError(SearchError):
    """Filters that don't fit together, or an event that breaks a contract."""


class ConfigurationError(SearchError):
    """Settings that lack something or don't fit what they configure."""
