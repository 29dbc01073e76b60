"""A session on a database: statements, rows, indices, transactions, history."""

from __future__ import annotations

import copy
import os
import tempfile
import uuid
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError, Status, invalid, missing
from .functions.values import ascii_name, canonical, canonical_char, cell, cell_column, stored
from .operators import relational as R
from .operators.relational import RID
from .plans.dialect import ColumnDef, Literal, Statement, parse
from .sources.store import Files, Store
from .streaming.cursor import Cursor, scan

SPARK_TYPES = {"int": T.IntegerType(), "real": T.DoubleType(), "char": T.StringType(), "text": T.StringType()}
#: Row ids are longs; the greatest INTEGER.
MAX_RECORD, MAX_RID, MAX_INT, HISTORY = 1 << 20, (1 << 63) - 1, (1 << 31) - 1, 100


def scratch(spark: SparkSession) -> str:
    """A new database's place in the folder that the cluster shares; on one machine, where none is named, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise invalid("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.removeprefix('file://')}/lodestone-db-{uuid.uuid4().hex}"


@dataclass
class Result:
    """kind: rows, count or message."""

    kind: str
    df: DataFrame | None = None
    count: int = 0
    message: str = ""
    columns: tuple[ColumnDef, ...] = ()

    def render(self) -> str:
        if self.kind == "message":
            return self.message
        if self.kind == "count":
            return f"{self.count} row(s) affected"
        names = [c.name for c in self.columns]
        if not names:
            return "(no columns)"
        rows = [[cell(v) for v in r] for r in self.df.collect()]
        widths = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
        lines = [names, ["-" * w for w in widths], *rows]
        return "\n".join(["  ".join(v.ljust(w) for v, w in zip(x, widths)) for x in lines] + [f"({len(rows)} row(s))"])

    def rendered(self) -> DataFrame:
        """The cells as strings, still distributed."""
        return self.df.select(*[cell_column(R.col(c.name), c.dtype).alias(c.name) for c in self.columns])


class Session:
    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store
        self.generation = 0
        self._staged: dict | None = None
        self._before: dict | None = None
        self._label: str | None = None
        self._undo: deque = deque(maxlen=HISTORY)
        self._redo: deque = deque(maxlen=HISTORY)

    # ---- opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str, readonly: bool = False, files: Files | None = None) -> Session:
        return cls(spark, Store(path, readonly, files))

    def close(self) -> None:
        if self._staged is not None:
            self.rollback()
        if not self.store.readonly:
            self.store.collect([self.store.state])
        self.store.close()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def set_readonly(self) -> None:
        self._no_txn()
        self.store.share()

    # ---- state

    @property
    def state(self) -> dict:
        return self._staged if self._staged is not None else self.store.state

    def tables(self) -> list[str]:
        return list(self.state["tables"])

    def _table(self, name: str) -> dict:
        if name not in self.state["tables"]:
            raise missing(f'no such table "{name}"')
        return self.state["tables"][name]

    def columns(self, name: str) -> list[ColumnDef]:
        return [ColumnDef(c["name"], c["dtype"], c["csize"]) for c in self._table(name)["columns"]]

    def indices(self, name: str) -> list[tuple[tuple[str, ...], bool]]:
        names = {c["id"]: c["name"] for c in self._table(name)["columns"]}
        return [(tuple(names[i] for i in x["columns"]), x["unique"]) for x in self._table(name)["indices"]]

    def live_count(self, name: str) -> int:
        return self._table(name)["live"]

    def record_size(self, name: str) -> int:
        columns = self.columns(name)
        return 1 + (len(columns) + 7) // 8 + sum({"int": 4, "real": 8, "text": 12}.get(c.dtype, c.csize) for c in columns)

    def rows(self, name: str) -> DataFrame:
        """The table with its row ids; columns are found by id, so a dropped name never comes back."""
        t = self._table(name)
        return self._read(t).select(RID, *self._named(t))

    def _read(self, t: dict) -> DataFrame:
        schema = T.StructType([T.StructField(RID, T.LongType()), *[T.StructField(f"c{c['id']}", SPARK_TYPES[c["dtype"]]) for c in t["columns"]]])
        return self.spark.read.schema(schema).parquet(*[self.store.part(p) for p in t["parts"]]) if t["parts"] else self.spark.createDataFrame([], schema)

    @staticmethod
    def _named(t: dict) -> list:
        return [F.col(f"c{c['id']}").alias(c["name"]) for c in t["columns"]]

    def df(self, name: str) -> DataFrame:
        return self.rows(name).drop(RID)

    # ---- transactions

    def _writable(self) -> None:
        if self.store.readonly:
            raise EngineError(Status.READONLY, "the database is read-only")

    def _no_txn(self) -> None:
        if self._staged is not None:
            raise invalid("not allowed inside a transaction")

    def begin(self, label: str | None = None) -> None:
        self._writable()
        if self._staged is not None:
            raise invalid("a transaction is already open")
        self._staged, self._before, self._label = copy.deepcopy(self.store.state), copy.deepcopy(self.store.state), label

    def commit(self) -> None:
        if self._staged is None:
            raise invalid("no transaction is open")
        staged, before, label = self._staged, self._before, self._label
        self._staged = self._before = self._label = None
        if staged == before:
            return
        named = {p for t in staged["tables"].values() for p in t["parts"]}
        staged["digests"] = {p: d for p, d in staged.get("digests", {}).items() if p in named}
        try:
            self.store.commit(staged)
        except BaseException:
            self.generation += 1
            raise
        self._redo.clear()
        if label is not None:
            self._undo.append((before, copy.deepcopy(staged), label))
        else:  # a step back over a change without a label would lose that change
            self._undo.clear()

    def rollback(self) -> None:
        if self._staged is None:
            raise invalid("no transaction is open")
        self._staged = self._before = self._label = None
        self.generation += 1
        self._collect()

    def _collect(self) -> None:
        if not self.store.readonly and self._staged is None:
            self.store.collect([self.store.state, *(s for x in (*self._undo, *self._redo) for s in x[:2])])

    def _change(self, edit, structural: bool = False):
        """Runs an edit of the staged state: whole or not at all, in the open transaction or its own."""
        self._writable()
        if structural:
            self._no_txn()
        own = self._staged is None
        if own:
            self.begin()
        saved = copy.deepcopy(self._staged)
        try:
            out = edit(self._staged)
        except BaseException:
            if own:
                self.rollback()
            else:
                self._staged = saved
            raise
        self.generation += 1
        if own:
            self.commit()
        if structural:
            self.reset_history()
        return out

    # ---- history

    def can_undo(self) -> bool:
        return bool(self._undo)

    def can_redo(self) -> bool:
        return bool(self._redo)

    def reset_history(self) -> None:
        self._undo.clear()
        self._redo.clear()

    def undo(self) -> str:
        return self._step(self._undo, self._redo, 0)

    def redo(self) -> str:
        return self._step(self._redo, self._undo, 1)

    def _step(self, take: deque, give: deque, side: int) -> str:
        self._writable()
        self._no_txn()
        if not take:
            raise EngineError(Status.NO_UNDO, "nothing to undo or redo")
        step = take.pop()
        state = copy.deepcopy(step[side]) | {"next_part": self.store.state["next_part"]}
        self.store.commit(state)
        give.append(step)
        self.generation += 1
        return step[2]

    # ---- tables and columns

    def create_table(self, name: str, columns: list[ColumnDef]) -> None:
        if name in self.state["tables"]:
            raise EngineError(Status.DUP, f'table "{name}" exists')
        self._check_columns([name, *(c.name for c in columns)], columns)

        def edit(state):
            state["tables"][name] = {
                "columns": [{"id": i, "name": c.name, "dtype": c.dtype, "csize": c.csize} for i, c in enumerate(columns)],
                "next_column": len(columns), "next_id": 1, "live": 0, "indices": [], "parts": []}

        self._writable()
        self._no_txn()
        self._change(edit)

    @staticmethod
    def _check_columns(names: list[str], columns: list[ColumnDef]) -> None:
        if not columns:
            raise invalid("a table needs a column")
        for n in names:
            if not ascii_name(n):
                raise invalid(f'bad name "{n}"')
        if len({c.name for c in columns}) != len(columns):
            raise invalid("a column name is repeated")
        for c in columns:
            if c.dtype not in SPARK_TYPES or (c.dtype == "char" and not 1 <= c.csize <= 65_536):
                raise invalid(f'bad type of column "{c.name}"')
        if 1 + (len(columns) + 7) // 8 + sum({"int": 4, "real": 8, "text": 12}.get(c.dtype, c.csize) for c in columns) > MAX_RECORD:
            raise invalid("the record is too large")

    def drop_table(self, name: str) -> None:
        self._table(name)
        self._change(lambda s: s["tables"].pop(name), structural=True)
        self._collect()

    def add_column(self, table: str, column: ColumnDef) -> None:
        self._check_columns([column.name], [*self.columns(table), column])

        def edit(state):
            t = state["tables"][table]
            t["columns"].append({"id": t["next_column"], "name": column.name, "dtype": column.dtype, "csize": column.csize})
            t["next_column"] += 1

        self._change(edit, structural=True)

    def drop_column(self, table: str, column: str) -> None:
        R.column_of(self.columns(table), column)
        if len(self.columns(table)) == 1:
            raise invalid("the only column can't be dropped")

        def edit(state):
            t = state["tables"][table]
            gone = next(c["id"] for c in t["columns"] if c["name"] == column)
            t["columns"] = [c for c in t["columns"] if c["id"] != gone]
            t["indices"] = [i for i in t["indices"] if gone not in i["columns"]]

        self._change(edit, structural=True)

    # ---- indices

    def create_index(self, table: str, columns: list[str], unique: bool = False) -> None:
        defs = {c.name: c for c in self.columns(table)}
        for c in columns:
            if R.column_of(defs.values(), c).dtype == "text":
                raise invalid(f'column "{c}" can\'t be indexed')
        if not columns or len(set(columns)) != len(columns):
            raise invalid("a member is missing or repeated")
        if any(list(i) == list(columns) for i, _ in self.indices(table)):
            raise EngineError(Status.DUP, "the index exists")
        rows = self.rows(table)
        if R.has_nan(rows, [c for c in columns if defs[c].dtype == "real"]):
            raise invalid("NaN can't be indexed")
        if unique and not R.duplicate_keys(rows, columns).isEmpty():
            raise EngineError(Status.DUP, "rows have equal keys")

        def edit(state):
            t = state["tables"][table]
            ids = {c["name"]: c["id"] for c in t["columns"]}
            t["indices"].append({"columns": [ids[c] for c in columns], "unique": unique})

        generation = self.generation
        self._change(edit, structural=True)
        self.generation = generation  # no row has changed

    def drop_index(self, table: str, columns: list[str]) -> None:
        at = [i for i, (c, _) in enumerate(self.indices(table)) if list(c) == list(columns)]
        if not at:
            raise missing("no such index")
        self._change(lambda s: s["tables"][table]["indices"].pop(at[0]), structural=True)

    def _check_keys(self, table: str, rows: DataFrame, touched: set[str] | None = None) -> None:
        """The end state's keys: NaN in no index, and no key twice in a unique one."""
        dtypes = {c.name: c.dtype for c in self.columns(table)}
        for members, unique in self.indices(table):
            if touched is not None and touched.isdisjoint(members):
                continue
            if R.has_nan(rows, [m for m in members if dtypes[m] == "real"]):
                raise invalid("NaN can't be indexed")
            if unique and not R.duplicate_keys(rows, members).isEmpty():
                raise EngineError(Status.DUP, "duplicate key")

    # ---- writing

    def _write(self, state: dict, table: str, df: DataFrame) -> str:
        """A new part; physical names are column ids."""
        name = f"{state['next_part']:08d}"
        state["next_part"] += 1
        ids = {c["name"]: c["id"] for c in state["tables"][table]["columns"]}
        out = df.select(F.col(RID).cast("long").alias(RID), *[R.col(c).alias(f"c{i}") for c, i in ids.items()])
        seen = Observation()
        out.observe(seen, _content(out.columns).alias("h")).write.mode("overwrite").parquet(self.store.part(name))
        ddl = ", ".join(f"{c} {t}" for c, t in out.dtypes)
        state["digests"] = {**state.get("digests", {}), name: [ddl, str(seen.get["h"])]}
        return name

    def _append(self, state: dict, table: str, df: DataFrame, n: int) -> None:
        t = state["tables"][table]
        if t["next_id"] - 1 + n > MAX_RID:
            raise EngineError(Status.FULL, "no row ids are left")
        if not n:
            return
        t["parts"].append(self._write(state, table, df))
        t["next_id"] += n
        t["live"] += n

    def insert_many(self, table: str, rows: list[list], strict: bool = True) -> list[int]:
        """Rows of Python values, one for each column; all or none go in. Their ids."""
        columns = self.columns(table)
        for r in rows:
            if len(r) != len(columns):
                raise invalid(f"expected {len(columns)} values per row, got {len(r)}")
        values = [[stored(c, v if isinstance(v, Literal) else _literal(v), strict) for c, v in zip(columns, r)] for r in rows]
        first = self._table(table)["next_id"]
        if first - 1 + len(rows) > MAX_RID:
            raise EngineError(Status.FULL, "no row ids are left")
        schema = T.StructType([T.StructField(RID, T.LongType()), *[T.StructField(c.name, SPARK_TYPES[c.dtype]) for c in columns]])

        def edit(state):
            df = self.spark.createDataFrame([(first + i, *v) for i, v in enumerate(values)], schema).coalesce(1)
            if self.indices(table):
                self._check_new(table, df)
            self._append(state, table, df, len(rows))

        if rows:
            self._change(edit)
        return list(range(first, first + len(rows)))

    def _check_new(self, table: str, new: DataFrame) -> None:
        """New rows against themselves and, by a semi join on the key, against the table."""
        self._check_keys(table, new)
        for members, unique in self.indices(table):
            if unique:
                keys = new.select(*[R.col(m) for m in members]).na.drop()
                if not keys.join(self.rows(table).select(*[R.col(m) for m in members]), list(members), "left_semi").isEmpty():
                    raise EngineError(Status.DUP, "duplicate key")

    def append(self, table: str, df: DataFrame) -> int:
        """Rows of a DataFrame, in its order; the way to load much. Too wide integers are errors."""
        columns = self.columns(table)
        cast = [
            (canonical_char(R.col(c.name)) if c.dtype == "char" else R.col(c.name)).cast(SPARK_TYPES[c.dtype]).alias(c.name) for c in columns]

        def edit(state):
            staged = self.store.part(f"{state['next_part']:08d}-staged")
            df.select(*cast).withColumn("_o", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
            try:
                held = self.spark.read.parquet(staged)
                long = [c for c in columns if c.dtype == "char"]
                if long and not held.where(" OR ".join(f"octet_length({R.quoted(c.name)}) > {c.csize}" for c in long)).isEmpty():
                    raise invalid("a value is too long for its column")
                new, n = R.dense_ids(held, "_o", state["tables"][table]["next_id"])
                if not n:
                    return 0
                if self.indices(table):
                    self._check_new(table, new)
                self._append(state, table, new, n)
                return n
            finally:
                import shutil

                shutil.rmtree(staged, ignore_errors=True)

        return self._change(edit)

    def _rewrite(self, table: str, hit, new_rows, touched: set[str] | None) -> int:
        """Copy on write: only parts that have a row that is hit are written anew, all in one job. The number of rows hit."""
        def edit(state):
            t = state["tables"][table]
            test = F.lit(True) if hit is None else F.coalesce(hit, F.lit(False))
            counts: dict[str, int] = {}
            if t["parts"]:
                each = self._read(t).select(RID, *self._named(t), _part_of().alias("_part")).where(test).groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
                counts = {r["_part"]: r["n"] for r in each.collect()}  # a row for each part at most
            total, kept = sum(counts.values()), [p for p in t["parts"] if p not in counts]
            if counts:
                out = new_rows(self._read({**t, "parts": sorted(counts)}).select(RID, *self._named(t)))
                if out is not None:
                    kept.append(self._write(state, table, out))
            t["parts"] = kept
            if touched is None:
                t["live"] -= total
            elif total:
                self._check_keys(table, self.rows(table), touched)
            return total

        return self._change(edit)

    def _delete_where(self, table: str, hit) -> int:
        return self._rewrite(table, hit, lambda rows: None if hit is None else rows.where(~F.coalesce(hit, F.lit(False))), None)

    def _update_where(self, table: str, hit, values: dict) -> int:
        dtypes = {c.name: SPARK_TYPES[c.dtype] for c in self.columns(table)}
        test = F.lit(True) if hit is None else F.coalesce(hit, F.lit(False))

        def new_rows(rows):
            return rows.withColumns({k: F.when(test, F.lit(v).cast(dtypes[k])).otherwise(R.col(k)) for k, v in values.items()})

        return self._rewrite(table, hit, new_rows, set(values))

    # ---- rows by id and key

    def insert(self, table: str, row: list) -> int:
        """One row; too long a CHAR is cut, as rows are by this way in."""
        return self.insert_many(table, [row], strict=False)[0]

    def get(self, table: str, row_id: int):
        out = self.rows(table).where(F.col(RID) == row_id).first()
        if out is None:
            raise missing(f"no row {row_id}")
        return out

    def find_rid(self, table: str, test) -> int:
        """The least id of the rows that meet a test."""
        found = self.rows(table).where(test).agg(F.min(RID)).first()[0]
        if found is None:
            raise missing("no such row")
        return found

    def update(self, table: str, row_id: int, row: list) -> None:
        """A row is replaced; its TEXT stays unless the new row has another value, or has null."""
        columns = self.columns(table)
        if len(row) != len(columns):
            raise invalid(f"expected {len(columns)} values per row, got {len(row)}")
        values = {c.name: stored(c, _literal(v), strict=False) for c, v in zip(columns, row) if v is not KEEP}
        if not self._update_where(table, F.col(RID) == row_id, values):
            raise missing(f"no row {row_id}")

    def delete(self, table: str, row_id: int) -> None:
        if not self._delete_where(table, F.col(RID) == row_id):
            raise missing(f"no row {row_id}")

    def set_text(self, table: str, row_id: int, column: str, text: str) -> None:
        if R.column_of(self.columns(table), column).dtype != "text":
            raise invalid(f'column "{column}" is no TEXT')
        generation = self.generation
        if not self._update_where(table, F.col(RID) == row_id, {column: text}):
            raise missing(f"no row {row_id}")
        self.generation = generation

    def get_text(self, table: str, row_id: int, column: str) -> str | None:
        if R.column_of(self.columns(table), column).dtype != "text":
            raise invalid(f'column "{column}" is no TEXT')
        return self.get(table, row_id)[column]

    def _key(self, table: str, values: dict):
        if not any(u and sorted(m) == sorted(values) for m, u in self.indices(table)):
            raise invalid("no unique index on exactly these columns")
        dtypes = {c.name: c for c in self.columns(table)}
        if any(v is None for v in values.values()):
            raise missing("a key without a value finds no row")
        found = R.by_key(self.rows(table), {k: stored(dtypes[k], _literal(v)) for k, v in values.items()}).first()
        if found is None:
            raise missing("no row has this key")
        return found

    def get_by_key(self, table: str, values: dict):
        return self._key(table, values)

    def update_by_key(self, table: str, values: dict, row: list) -> None:
        self.update(table, self._key(table, values)[RID], row)

    def delete_by_key(self, table: str, values: dict) -> None:
        self.delete(table, self._key(table, values)[RID])

    # ---- ordered access

    def _index_for(self, table: str, column: str, *values) -> tuple[str, ...]:
        c = R.column_of(self.columns(table), column)
        kinds = {"int": int, "real": float, "char": str}
        if any(not isinstance(v, kinds.get(c.dtype, ())) or isinstance(v, bool) for v in values):
            raise missing(f'the value does not fit column "{column}"')
        found = [m for m, _ in self.indices(table)]
        index = next((m for m in found if m == (column,)), None) or next((m for m in found if m[0] == column), None)
        if index is None:
            raise missing(f'no index on "{column}"')
        return index

    def cursor(self, table: str, column: str) -> Cursor:
        return Cursor(R.index_scan(self.rows(table), self._index_for(table, column)), lambda: self.generation)

    def find_range(self, table: str, column: str, low, high) -> Cursor:
        index = self._index_for(table, column, low, high)
        low, high = (canonical(x) if isinstance(x, str) else x for x in (low, high))
        return Cursor(R.index_range(self.rows(table), index, low, high), lambda: self.generation)

    def find_by(self, table: str, column: str, value):
        index = self._index_for(table, column, value)
        row = R.find_first(self.rows(table), index, canonical(value) if isinstance(value, str) else value).first()
        if row is None:
            raise missing("no row has this value")
        return row

    def scan(self, table: str, call) -> int:
        return scan(self.rows(table).orderBy(RID), call)

    def match(self, table: str, column: str, pattern: str) -> DataFrame:
        if R.column_of(self.columns(table), column).dtype != "char":
            raise invalid(f'column "{column}" is no CHAR')
        return R.match(self.rows(table), column, pattern).orderBy(RID)

    # ---- maintenance

    def compact(self, table: str) -> None:
        """One range-partitioned rewrite; ids become 1 to n in their old order."""
        self._table(table)

        def edit(state):
            t = state["tables"][table]
            staged = self.store.part(f"{state['next_part']:08d}-staged")
            ordered = self.rows(table).repartitionByRange(RID).sortWithinPartitions(RID)
            ordered.withColumn("_o", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
            held = self.spark.read.parquet(staged)
            new, n = R.dense_ids(held, "_o", 1)
            t["parts"] = [self._write(state, table, new)] if n else []
            t["next_id"], t["live"] = n + 1, n
            import shutil

            shutil.rmtree(staged, ignore_errors=True)

        self._change(edit, structural=True)
        self._collect()

    def verify(self, table: str) -> list[str]:
        """What is wrong with a table; empty if nothing is."""
        t, out = self._table(table), []
        if lost := [p for p in t["parts"] if not os.path.isdir(self.store.part(p))]:
            return [f"parts are missing: {', '.join(lost)}"]
        by_schema: dict[str, list[str]] = {}
        digests = self.state.get("digests", {})
        for p in t["parts"]:
            by_schema.setdefault(digests[p][0], []).append(p)
        try:
            for ddl, parts in by_schema.items():
                df = self.spark.read.schema(ddl).parquet(*[self.store.part(p) for p in parts])
                got = {r["_part"]: str(r.h) for r in df.groupBy(_part_of().alias("_part")).agg(_content(df.columns).alias("h")).collect()}
                out += [f"part {p} is damaged" for p in parts if got.get(p) != digests[p][1]]
        except Exception as e:  # a file that can't be read; Spark names it
            return [f"a part is damaged: {str(e).splitlines()[0]}"]
        if out:
            return out
        rows = self.rows(table)
        n, ids, top = rows.agg(F.count(F.lit(1)), F.countDistinct(RID), F.max(RID)).first()
        if n != t["live"]:
            out.append(f"{n} rows, but {t['live']} are counted")
        if ids != n:
            out.append("row ids are repeated")
        if (top or 0) >= t["next_id"]:
            out.append("a row id is beyond the counter")
        for members, unique in self.indices(table):
            if unique and not R.duplicate_keys(rows, members).isEmpty():
                out.append(f"keys are repeated in ({', '.join(members)})")
        return out

    # ---- statements

    def sql(self, text: str) -> Result:
        return getattr(self, f"_{s.kind}")(s) if (s := parse(text)) else None

    def _select(self, s: Statement) -> Result:
        columns = self.columns(s.table)
        df = R.select(self.rows(s.table), columns, s.columns, s.where, s.order, s.descending, s.limit, (RID,), [m for m, _ in self.indices(s.table)])
        names = s.columns if s.columns is not None else [c.name for c in columns]
        return Result("rows", df, columns=tuple(R.column_of(columns, n) for n in names))

    def _insert(self, s: Statement) -> Result:
        columns = self.columns(s.table)
        names = [c.name for c in columns]
        if s.columns is not None:
            for n in s.columns:
                R.column_of(columns, n)
            if len(set(s.columns)) != len(s.columns):
                raise invalid("a column is named twice")
            rows = [[dict(zip(s.columns, r)).get(n, Literal("null")) for n in names] for r in s.values]
        else:
            if len(s.values[0]) != len(columns):
                raise invalid(f"expected {len(columns)} values per row, got {len(s.values[0])}")
            rows = s.values
        self.insert_many(s.table, rows)
        return Result("count", count=len(rows))

    def _update(self, s: Statement) -> Result:
        columns = self.columns(s.table)
        hit = R.predicate(columns, s.where)
        values = {n: stored(R.column_of(columns, n), v) for n, v in s.sets}
        return Result("count", count=self._update_where(s.table, hit, values))

    def _delete(self, s: Statement) -> Result:
        return Result("count", count=self._delete_where(s.table, R.predicate(self.columns(s.table), s.where)))

    def _create_table(self, s: Statement) -> Result:
        self.create_table(s.table, s.defs)
        return Result("message", message="table created")

    def _drop_table(self, s: Statement) -> Result:
        self.drop_table(s.table)
        return Result("message", message="table dropped")

    def _create_index(self, s: Statement) -> Result:
        self.create_index(s.table, s.columns, s.unique)
        return Result("message", message="index created")

    def _drop_index(self, s: Statement) -> Result:
        self.drop_index(s.table, s.columns)
        return Result("message", message="index dropped")

    def _add_column(self, s: Statement) -> Result:
        self.add_column(s.table, s.defs[0])
        return Result("message", message="column added")

    def _drop_column(self, s: Statement) -> Result:
        self.drop_column(s.table, s.columns[0])
        return Result("message", message="column dropped")

    def _begin(self, s: Statement) -> Result:
        self.begin()
        return Result("message", message="transaction started")

    def _commit(self, s: Statement) -> Result:
        self.commit()
        return Result("message", message="committed")

    def _rollback(self, s: Statement) -> Result:
        self.rollback()
        return Result("message", message="rolled back")


def _content(names: list[str]):
    """A sum over the hashes of rows: alike in any order, made while they are written."""
    return F.sum(F.xxhash64(*names).cast("decimal(38,0)"))


def _part_of():
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


#: In a row for update(): the column keeps its value.
KEEP = object()


def _literal(v) -> Literal:
    if isinstance(v, Literal):
        return v
    if v is None:
        return Literal("null")
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        raise invalid(f"unsupported value {v!r}")
    if isinstance(v, int) and not -(1 << 31) <= v <= MAX_INT:
        raise invalid(f"integer out of range: {v}")
    return Literal({int: "int", float: "real", str: "str"}[type(v)], v)
