"""One exception for everything the dialect refuses, with its SQLSTATE."""

from __future__ import annotations


class SqlError(Exception):
    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"{message} (SQLSTATE {sqlstate})")
        self.sqlstate, self.message = sqlstate, message


def unsupported(what: str) -> SqlError:
    return SqlError("0A000", f"{what} is not supported")
