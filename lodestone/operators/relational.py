"""Filter, projection, ordering and key operators. Each returns a lazy DataFrame for Catalyst to plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid, missing
from ..functions.values import canonical
from ..plans.dialect import ColumnDef, Condition, Groups, Literal

RID = "_rid"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def column_of(columns: Iterable[ColumnDef], name: str) -> ColumnDef:
    for c in columns:
        if c.name == name:
            return c
    raise missing(f'no such column "{name}"')


def check_condition(columns: Sequence[ColumnDef], c: Condition) -> None:
    column = column_of(columns, c.column)
    if c.op in ("isnull", "notnull"):
        return
    if column.dtype in ("text", "opaque"):
        raise invalid(f'column "{c.column}" can only be tested for NULL')
    for x in (c.low, c.high):
        if x is None:
            continue
        if x.kind == "null":
            raise invalid("NULL can't be compared; use IS NULL")
        if (x.kind == "str") != (column.dtype == "char"):
            raise invalid(f'literal does not fit column "{c.column}"')


def _value(column: ColumnDef, x: Literal) -> Column:
    if column.dtype == "char":
        return F.lit(canonical(x.value))
    return F.lit(x.value)


def condition(columns: Sequence[ColumnDef], c: Condition) -> Column:
    """One comparison. Null never matches; NaN matches <> only."""
    column, x = column_of(columns, c.column), col(c.column)
    if c.op == "isnull":
        return x.isNull()
    if c.op == "notnull":
        return x.isNotNull()
    low = _value(column, c.low)
    if c.op == "between":
        return x.between(low, _value(column, c.high))
    test = {"=": x == low, "<>": x != low, "<": x < low, "<=": x <= low, ">": x > low, ">=": x >= low}[c.op]
    # NaN is the greatest value to Spark, and unordered here
    return test & ~F.isnan(x) if column.dtype == "real" and c.op in (">", ">=") else test


def predicate(columns: Sequence[ColumnDef], groups: Groups) -> Column | None:
    for g in groups:
        for c in g:
            check_condition(columns, c)
    if not groups:
        return None
    return reduce(Column.__or__, (reduce(Column.__and__, (condition(columns, c) for c in g)) for g in groups))


def filter_rows(df: DataFrame, columns: Sequence[ColumnDef], groups: Groups) -> DataFrame:
    test = predicate(columns, groups)
    return df if test is None else df.where(test)


def order_keys(column: str, descending: bool) -> Column:
    """Nulls come last ascending and first descending."""
    return col(column).desc_nulls_first() if descending else col(column).asc_nulls_last()


def band_index(columns: Sequence[ColumnDef], indices: Sequence[Sequence[str]], groups: Groups) -> Sequence[str] | None:
    """The index whose order a scan by one comparison has: exact, else the first that the column leads."""
    if len(groups) != 1 or len(groups[0]) != 1:
        return None
    c = groups[0][0]
    if c.op not in ("=", "<", "<=", ">", ">=", "between"):
        return None
    column = column_of(columns, c.column)
    literals = [x for x in (c.low, c.high) if x]
    if column.dtype == "int" and any(x.kind != "int" for x in literals):
        return None
    if column.dtype == "char" and any(len(canonical(x.value).encode()) > column.csize for x in literals):
        return None
    return next((i for i in indices if list(i) == [c.column]), None) or next((i for i in indices if i[0] == c.column), None)


def select(df: DataFrame, columns: Sequence[ColumnDef], names: Sequence[str] | None, groups: Groups = (), order: str | None = None,
           descending: bool = False, limit: int | None = None, ties: Sequence[str] = (RID,), indices: Sequence[Sequence[str]] = ()) -> DataFrame:
    """A query on one table.

    Rows are ordered by the order column, ties in scan order: that of an index where one serves
    the predicate, else that of row ids (ties). A limit without an order cuts the scan order; with
    neither, the order is left to whoever reads it. An order with a limit is a top-k without a
    full sort.
    """
    names = [c.name for c in columns] if names is None else list(names)
    for n in names:
        column_of(columns, n)
    out = filter_rows(df, columns, groups)
    index = band_index(columns, indices, groups)
    if index:  # it gives the order alone; rows that are null in another member come behind, and an index never changes the rows
        ties = [*index, *ties]
    if order is not None:
        if column_of(columns, order).dtype in ("text", "opaque"):
            raise invalid(f'column "{order}" can\'t be ordered')
        out = out.orderBy(order_keys(order, descending), *[col(t).asc_nulls_last() for t in ties if t != order])
    elif limit is not None or index:
        out = out.orderBy(*[col(t).asc_nulls_last() for t in ties])
    if limit is not None:
        out = out.limit(limit)
    return out.select(*[col(n) for n in names])


def index_scan(df: DataFrame, members: Sequence[str], ties: Sequence[str] = (RID,)) -> DataFrame:
    """All rows of an index in its order; rows with a null member are not in it."""
    return df.where(reduce(Column.__and__, (col(m).isNotNull() for m in members))).orderBy(*[col(m) for m in (*members, *ties)])


def index_range(df: DataFrame, members: Sequence[str], low, high, ties: Sequence[str] = (RID,)) -> DataFrame:
    """The band [low, high] of an index's first member, in the index's order."""
    return index_scan(df.where(col(members[0]).between(F.lit(low), F.lit(high))), members, ties)


def find_first(df: DataFrame, members: Sequence[str], value, ties: Sequence[str] = (RID,)) -> DataFrame:
    """The first row in index order whose first member has the value."""
    return index_scan(df.where(col(members[0]) == F.lit(value)), members, ties).limit(1)


def by_key(df: DataFrame, values: dict) -> DataFrame:
    """Rows with a full key; a null key finds none."""
    return df.where(reduce(Column.__and__, (col(k) == F.lit(v) for k, v in values.items())))


def duplicate_keys(df: DataFrame, members: Sequence[str]) -> DataFrame:
    """Keys without nulls that more than one row has, with their `n_rows`."""
    keyed = df.where(reduce(Column.__and__, (col(m).isNotNull() for m in members)))
    return keyed.groupBy(*[col(m) for m in members]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def has_nan(df: DataFrame, names: Sequence[str]) -> bool:
    return bool(names) and not df.where(reduce(Column.__or__, (F.isnan(col(n)) for n in names))).isEmpty()


def match(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows whose value a regular expression finds; a bad pattern is an error at once."""
    try:
        df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise invalid(f"bad pattern: {pattern}") from e
    return df.where(col(name).rlike(pattern))


def dense_ids(held: DataFrame, mark: str, first: int, name: str = RID) -> tuple[DataFrame, int]:
    """(rows of held with ids first, first + 1, … in the order of mark, their number).

    mark is a monotonically increasing id that is stored with the rows. Only a count for each
    writing task is gathered, and joined back as a small table.
    """
    part, inside = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    n, starts = 0, []
    for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        starts.append((r.p, first + n))
        n += r.n
    of = held.sparkSession.createDataFrame(starts, "_part long, _first long")
    joined = held.withColumn("_part", part).join(F.broadcast(of), "_part")
    return joined.withColumn(name, F.col("_first") + inside).drop("_part", "_first", mark), n
