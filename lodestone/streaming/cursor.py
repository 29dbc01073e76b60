"""Cursors over ordered results, and scans with a callback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

from ..errors import invalid


class Cursor:
    """Yields rows in the order of its DataFrame, a partition at a time; ends when the table has changed."""

    def __init__(self, df: DataFrame, generation: Callable[[], int]):
        self._generation, self._opened = generation, generation()
        self._rows: Iterator[Row] = df.toLocalIterator()

    def __iter__(self) -> Cursor:
        return self

    def __next__(self) -> Row:
        if self._generation() != self._opened:
            raise invalid("the cursor is stale: the database has changed")
        return next(self._rows)


def scan(df: DataFrame, call: Callable[[Row], bool | None]) -> int:
    """Calls for each row until a call returns True; the number of rows seen."""
    n = 0
    for row in df.toLocalIterator():
        n += 1
        if call(row):
            break
    return n
