"""python -m lodestone.shells.table_shell: commands on a database, on new columns, and on one table."""

from __future__ import annotations

import shlex
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from ..errors import EngineError, invalid, missing
from ..functions.values import cell
from ..operators.relational import RID
from ..plans.dialect import ColumnDef
from ..session import Session
from ..sources.store import pack, unpack
from .sql_shell import type_text

# Commands of each state with their shortest forms.
STATES = {
    "root": {"open": "o", "close": "cl", "readonly": "readonly", "tables": "t", "desc": "d", "create": "cr", "use": "u", "drop": "dr", "pack": "pack", "unpack": "unpack", "run": "ru", "quit": "q"},
    "creator": {"col": "col", "done": "done", "cancel": "cancel", "quit": "q"},
    "table": {
        "insert": "i", "update": "u", "select": "s", "get": "g", "delete": "del", "compact": "co", "addcolumn": "addcolumn", "dropcolumn": "dropcolumn", "index": "in",
        "dropindex": "dropindex", "verify": "v", "find": "f", "range": "r", "match": "m", "getk": "getk", "delk": "delk", "back": "b", "quit": "q"},
}


class TableShell:
    def __init__(self, spark: SparkSession, out: TextIO = sys.stdout, err: TextIO = sys.stderr):
        self.spark, self.out, self.err = spark, out, err
        self.session: Session | None = None
        self.state, self.table, self.pending = "root", "", []
        self._files: list[str] = []

    def run(self, lines) -> None:
        for line in lines:
            if self.line(line):
                break
        if self.session:
            self.session.close()

    def line(self, text: str) -> bool:
        try:
            words = shlex.split(text)
            if not words:
                return False
            found = [c for c, least in STATES[self.state].items() if c.startswith(words[0]) and len(words[0]) >= len(least)]
            if len(found) != 1:
                raise invalid(f"{'ambiguous' if found else 'unknown'} command: {words[0]}")
            if found[0] == "quit":
                return True
            return bool(getattr(self, f"{self.state}_{found[0]}")(*words[1:]))
        except EngineError as e:
            print(f"error: {e.message}", file=self.err)
        except (TypeError, ValueError) as e:
            print(f"error: bad arguments: {e}", file=self.err)
        return False

    def say(self, text: str) -> None:
        print(text, file=self.out)

    @property
    def s(self) -> Session:
        if not self.session:
            raise invalid("no database open")
        return self.session

    def run_file(self, path: str) -> bool:
        """The lines of a file, which may run further files; # begins a remark. Whether the shell ends."""
        if len(self._files) >= 16:
            raise invalid("files are nested too deeply")
        self._files.append(path)
        try:
            with open(path, encoding="utf-8") as f:
                return any(self.line(x) for x in f if not x.startswith("#"))
        except OSError as e:
            raise missing(f"can't read {path}") from e
        finally:
            self._files.pop()

    # ---- root

    def root_run(self, file: str) -> bool:
        return self.run_file(file)

    def root_open(self, directory: str) -> None:
        if self.session:
            self.session.close()
            self.session = None
        self.session = Session.open(self.spark, directory)

    def root_close(self) -> None:
        self.s.close()
        self.session = None

    def root_readonly(self) -> None:
        self.s.set_readonly()

    def root_tables(self) -> None:
        for t in self.s.tables():
            self.say(f"{t}  ({self.s.live_count(t)} rows)")

    def root_desc(self, table: str) -> None:
        for c in self.s.columns(table):
            self.say(f"{c.name} {type_text(c)}")
        for members, unique in self.s.indices(table):
            self.say(f"{'unique ' if unique else ''}index ({', '.join(members)})")

    def root_create(self, table: str) -> None:
        self.table, self.pending, self.state = table, [], "creator"

    def root_use(self, table: str) -> None:
        self.s.columns(table)
        self.table, self.state = table, "table"

    def root_drop(self, table: str) -> None:
        self.s.drop_table(table)

    def root_pack(self, directory: str, file: str) -> None:
        pack(directory, file)

    def root_unpack(self, file: str, directory: str) -> None:
        unpack(file, directory)

    # ---- creator

    @staticmethod
    def column(name: str, kind: str, width: str | None = None) -> ColumnDef:
        if kind not in ("int", "real", "text", "char") or (kind == "char") != (width is not None):
            raise invalid("usage: <name> int | real | text | char <N>")
        return ColumnDef(name, kind, int(width or 0))

    def creator_col(self, *args: str) -> None:
        self.pending.append(self.column(*args))

    def creator_done(self) -> None:
        self.s.create_table(self.table, self.pending)
        self.state = "root"

    def creator_cancel(self) -> None:
        self.state = "root"

    # ---- table

    def value(self, c: ColumnDef, text: str):
        if text.lower() == "null":
            return None
        return {"int": int, "real": float}.get(c.dtype, str)(text)

    def values(self, words) -> list:
        columns = self.s.columns(self.table)
        if len(words) != len(columns):
            raise invalid(f"expected {len(columns)} values per row, got {len(words)}")
        return [self.value(c, w) for c, w in zip(columns, words)]

    def pairs(self, words) -> dict:
        columns = {c.name: c for c in self.s.columns(self.table)}
        return {k: self.value(columns[k], v) for k, v in zip(words[::2], words[1::2], strict=True)}

    def show(self, row) -> None:
        self.say("  ".join(f"{k}={cell(v)}" for k, v in row.asDict().items() if k != RID) + f"  [{row[RID]}]")

    def table_insert(self, *words: str) -> None:
        self.say(f"row {self.s.insert(self.table, self.values(words))}")

    def table_update(self, row_id: str, *words: str) -> None:
        self.s.update(self.table, int(row_id), self.values(words))

    def table_select(self) -> None:
        self.say(f"{self.s.scan(self.table, self.show)} row(s)")

    def table_get(self, row_id: str) -> None:
        self.show(self.s.get(self.table, int(row_id)))

    def table_delete(self, row_id: str) -> None:
        self.s.delete(self.table, int(row_id))

    def table_compact(self) -> None:
        self.s.compact(self.table)

    def table_addcolumn(self, *args: str) -> None:
        self.s.add_column(self.table, self.column(*args))

    def table_dropcolumn(self, name: str) -> None:
        self.s.drop_column(self.table, name)

    def table_index(self, *names: str) -> None:
        unique = bool(names) and names[0] == "unique"
        self.s.create_index(self.table, list(names[unique:]), unique)

    def table_dropindex(self, *names: str) -> None:
        self.s.drop_index(self.table, list(names))

    def table_verify(self) -> None:
        self.say("\n".join(self.s.verify(self.table)) or "ok")

    def _typed(self, column: str, *texts: str) -> list:
        c = next((c for c in self.s.columns(self.table) if c.name == column), None)
        return [self.value(c, t) if c else t for t in texts]

    def table_find(self, column: str, text: str) -> None:
        self.show(self.s.find_by(self.table, column, *self._typed(column, text)))

    def table_range(self, column: str, low: str, high: str) -> None:
        for row in self.s.find_range(self.table, column, *self._typed(column, low, high)):
            self.show(row)

    def table_match(self, column: str, pattern: str) -> None:
        for row in self.s.match(self.table, column, pattern).toLocalIterator():
            self.show(row)

    def table_getk(self, *words: str) -> None:
        self.show(self.s.get_by_key(self.table, self.pairs(words)))

    def table_delk(self, *words: str) -> None:
        self.s.delete_by_key(self.table, self.pairs(words))

    def table_back(self) -> None:
        self.state = "root"


def main() -> None:
    TableShell(SparkSession.builder.appName("table_shell").getOrCreate()).run(sys.stdin)


if __name__ == "__main__":
    main()
