"""Error hierarchy of the query language; every error has a code and a 1-based position."""

from __future__ import annotations


class QueryError(Exception):
    stage = "query"

    def __init__(self, code: str, message: str, line: int = 1, col: int = 1) -> None:
        super().__init__(f"{self.stage}.{code} at {line}:{col}: {message}")
        self.code, self.line, self.col = f"{self.stage}.{code}", line, col


class LexError(QueryError):
    stage = "lex"


class ParseError(QueryError):
    stage = "parse"


class EvalError(QueryError):
    stage = "eval"
