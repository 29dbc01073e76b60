"""Status codes and the one exception that carries them."""

from __future__ import annotations

from enum import IntEnum


class Status(IntEnum):
    OK = 0
    NOT_FOUND = 1
    DUP = 2
    ERR = 3
    VERSION = 4
    INVALID = 5
    READONLY = 6
    LOCKED = 7
    NO_UNDO = 8
    FULL = 9


class EngineError(Exception):
    def __init__(self, status: Status, message: str):
        super().__init__(message)
        self.status, self.message = status, message


def invalid(message: str) -> EngineError:
    return EngineError(Status.INVALID, message)


def missing(message: str) -> EngineError:
    return EngineError(Status.NOT_FOUND, message)
