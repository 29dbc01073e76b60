"""python -m lodestone.shells.sql_shell [DIR]: statements and dot commands."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from ..errors import EngineError, invalid, missing
from ..session import Session
from ..sources.store import pack, unpack

HELP = """Commands:
  .open <dir>            open a database, made if needed
  .close                 close it
  .tables                tables with their rows and columns
  .schema [table]        column definitions
  .pack <dir> <file>     a database as one file
  .unpack <file> <dir>   and back
  .read <file>           run a file of lines
  .quit                  leave
Anything else is a statement."""

USAGE = {".open": "<dir>", ".pack": "<dir> <file>", ".unpack": "<file> <dir>", ".read": "<file>"}
TYPES = {"int": "INTEGER", "real": "REAL", "text": "TEXT"}


def type_text(c) -> str:
    return TYPES.get(c.dtype) or f"CHAR({c.csize})"


class SqlShell:
    def __init__(self, spark: SparkSession, out: TextIO = sys.stdout, err: TextIO = sys.stderr):
        self.spark, self.out, self.err, self.session = spark, out, err, None
        self._files: list[str] = []

    def run(self, lines, prompt: str = "") -> None:
        """prompt: shown before each line that is read."""
        if prompt:
            print("Statements, or .help", file=self.err)
            print(prompt, end="", file=self.err, flush=True)
        for line in lines:
            if self.line(line.strip()):
                break
            if prompt:
                print(prompt, end="", file=self.err, flush=True)
        if self.session:
            self.session.close()

    def run_file(self, path: str) -> bool:
        """The lines of a file, which may name further files; # begins a remark. Whether the shell ends."""
        if len(self._files) >= 16:
            raise invalid("files are nested too deeply")
        self._files.append(path)
        try:
            with open(path, encoding="utf-8") as f:
                return any(self.line(x.strip()) for x in f if not x.startswith("#"))
        except OSError as e:
            raise missing(f"can't read {path}") from e
        finally:
            self._files.pop()

    def line(self, text: str) -> bool:
        """Whether the shell ends."""
        try:
            if text.startswith("."):
                return self._command(*text.split())
            if text:
                print(self._open().sql(text).render(), file=self.out)
        except EngineError as e:
            print(f"error: {e.message}", file=self.err)
        return False

    def _open(self) -> Session:
        if not self.session:
            raise invalid("no database open")
        return self.session

    def _command(self, name: str, *args: str) -> bool:
        name = name.lower()
        if name in (".quit", ".exit", ".q"):
            return True
        if name in USAGE and len(args) != len(USAGE[name].split()):
            raise invalid(f"usage: {name} {USAGE[name]}")
        if name == ".read":
            return self.run_file(args[0])
        if name in (".help", ".h"):
            print(HELP, file=self.err)
        elif name == ".open":
            if self.session:
                self.session.close()
                self.session = None
            self.session = Session.open(self.spark, args[0])
        elif name == ".close":
            self._open().close()
            self.session = None
        elif name == ".tables":
            s = self._open()
            for t in s.tables():
                print(f"{t}  ({s.live_count(t)} rows, {len(s.columns(t))} cols)", file=self.out)
            if not s.tables():
                print("(no tables)", file=self.err)
        elif name == ".schema":
            s = self._open()
            for t in args or s.tables():
                columns = s.columns(t)
                print(f"CREATE TABLE {t}", file=self.out)
                for i, c in enumerate(columns):
                    print(f"    {c.name} {type_text(c)}" + ("," if i + 1 < len(columns) else ""), file=self.out)
        elif name == ".pack":
            pack(*args)
        elif name == ".unpack":
            unpack(*args)
        else:
            print(f"unknown command: {name}", file=self.err)
        return False


def main() -> None:
    spark = SparkSession.builder.appName("sql_shell").getOrCreate()
    shell = SqlShell(spark)
    if len(sys.argv) > 1:
        shell.line(f".open {sys.argv[1]}")
    shell.run(sys.stdin, "sql> " if sys.stdin.isatty() else "")


if __name__ == "__main__":
    main()
