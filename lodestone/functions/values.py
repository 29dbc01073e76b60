"""How values are stored, coerced and shown."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid
from ..plans.dialect import ColumnDef, Literal


def canonical_char(c: Column) -> Column:
    """A CHAR value ends at its first NUL; blanks at its end don't count."""
    return F.rtrim(F.substring_index(c, "\0", 1))


def canonical(value: str) -> str:
    return value.split("\0", 1)[0].rstrip(" ")


def stored(column: ColumnDef, literal: Literal, strict: bool = True):
    """The value that a literal has in a column. strict: too long a CHAR is an error, else it is cut."""
    if literal.kind == "null":
        return None
    if column.dtype == "int":
        if literal.kind != "int":
            raise invalid(f'column "{column.name}" needs an integer')
        return literal.value
    if column.dtype == "real":
        if literal.kind not in ("int", "real"):
            raise invalid(f'column "{column.name}" needs a number')
        return float(literal.value)
    if literal.kind != "str":
        raise invalid(f'column "{column.name}" needs a string')
    if column.dtype == "text":
        return literal.value
    raw = literal.value.rstrip(" ").encode()
    if strict and len(raw) > column.csize:
        raise invalid(f'value too long for column "{column.name}"')
    return canonical(raw[: column.csize].decode("utf-8", "ignore"))


def es15_8(x: float) -> str:
    """A real in the form 2.50000000E+00; three digits of an exponent take the place of the E."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    text = f"{Decimal(repr(x)).normalize():E}"  # the shortest decimal that reads as x, as the column form has it
    sign, exponent = "-" if str(x).startswith("-") else "", int(text.split("E")[1]) if x else 0
    digits = abs(Decimal(repr(x))).scaleb(-exponent).quantize(Decimal("1.00000000"), ROUND_HALF_UP)
    if digits >= 10:
        digits, exponent = digits / 10, exponent + 1
    end = f"E{'-' if exponent < 0 else '+'}{abs(exponent):02d}" if abs(exponent) < 100 else f"{'-' if exponent < 0 else '+'}{abs(exponent):03d}"
    return f"{sign}{digits:.8f}{end}"


def es15_8_column(c: Column) -> Column:
    text = F.format_string("%.8E", c)
    return F.regexp_replace(text, r"E([+-]\d{3})$", "$1")


def cell(value) -> str:
    if value is None:
        return "NULL"
    return es15_8(value) if isinstance(value, float) else str(value)


def cell_column(c: Column, dtype: str) -> Column:
    """The rendered form as an expression, for result sinks that stay distributed."""
    shown = es15_8_column(c) if dtype == "real" else F.rtrim(c) if dtype == "char" else c.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def ascii_name(name: str) -> bool:
    return bool(name) and len(name.encode()) <= 32 and not re.search(r"[/\\\x00-\x1f\x7f]|\.\.", name)
