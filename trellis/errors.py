"""Errors of requests, each with a stable code."""

from __future__ import annotations


class QueryError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def invalid(message: str) -> QueryError:
    return QueryError("QUERY_INVALID_EXPRESSION", message)


def unknown(message: str) -> QueryError:
    return QueryError("UNKNOWN_IDENTIFIER", message)
