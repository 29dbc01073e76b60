"""The SQL dialect: tokens, statements, and a parser that accepts the subset and nothing else."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import invalid

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
MAX_CHAR, MAX_COLUMNS, MAX_MEMBERS = 65_536, 256, 64

_TOKEN = re.compile(r"""\s+|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<real>\d+(?:\.\d*(?:[eE][+-]?\d+)?|[eE][+-]?\d+))|(?P<int>\d+)
    |'(?P<str>(?:[^']|'')*)'|(?P<op><>|<=|>=|[<>=(),;*+.-])""", re.X)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    def is_word(self, word: str) -> bool:
        return self.kind == "name" and self.text.isascii() and self.text.lower() == word


@dataclass(frozen=True)
class Literal:
    """kind: int, real, str or null."""

    kind: str
    value: int | float | str | None = None


@dataclass(frozen=True)
class Condition:
    """op: = <> < <= > >= between isnull notnull."""

    column: str
    op: str
    low: Literal | None = None
    high: Literal | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    dtype: str
    csize: int = 0


#: A predicate is an OR of AND groups.
Groups = tuple[tuple[Condition, ...], ...]


@dataclass
class Statement:
    kind: str
    table: str = ""
    columns: list[str] | None = None
    where: Groups = ()
    order: str | None = None
    descending: bool = False
    limit: int | None = None
    values: list[list[Literal]] = field(default_factory=list)
    sets: list[tuple[str, Literal]] = field(default_factory=list)
    defs: list[ColumnDef] = field(default_factory=list)
    unique: bool = False


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise invalid("unterminated string" if text[at] == "'" else f"unexpected character '{text[at]}'")
        at = m.end()
        if m.lastgroup:
            value = m[m.lastgroup]
            out.append(Token(m.lastgroup, value.replace("''", "'") if m.lastgroup == "str" else value))
    return out


class Parser:
    """Recursive descent; no word is reserved, so a column may have any name."""

    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "end of statement")

    def word(self, word: str) -> bool:
        if self.peek().is_word(word):
            self.at += 1
            return True
        return False

    def need_word(self, word: str) -> None:
        if not self.word(word):
            raise invalid(f"expected {word.upper()} near '{self.peek().text}'")

    def op(self, text: str) -> bool:
        t = self.peek()
        if t.kind == "op" and t.text == text:
            self.at += 1
            return True
        return False

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise invalid(f"expected '{text}' near '{self.peek().text}'")

    def name(self) -> str:
        t = self.peek()
        if t.kind != "name":
            raise invalid(f"expected a name near '{t.text}'")
        self.at += 1
        return t.text

    def literal(self) -> Literal:
        sign = -1 if self.op("-") else 1
        signed = sign < 0 or self.op("+")
        t = self.peek()
        self.at += 1
        if t.kind == "int":
            value = sign * int(t.text)
            if not INT_MIN <= value <= INT_MAX:
                raise invalid(f"integer out of range: {value}")
            return Literal("int", value)
        if t.kind == "real":
            return Literal("real", sign * float(t.text))
        if not signed and t.kind == "str":
            return Literal("str", t.text)
        if not signed and t.is_word("null"):
            return Literal("null")
        raise invalid(f"expected a literal near '{t.text}'")

    def names(self, most: int) -> list[str]:
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        if len(out) > most:
            raise invalid(f"too many names: {len(out)}, the most is {most}")
        return out

    def statement(self) -> Statement:
        t = self.peek()
        if t.kind != "name":
            raise invalid("empty statement" if t.kind == "end" else f"unexpected '{t.text}'")
        parse = {
            "select": self.select, "insert": self.insert, "update": self.update, "delete": self.delete, "create": self.create, "drop": self.drop,
            "alter": self.alter, "begin": lambda: self.txn("begin"), "commit": lambda: self.txn("commit"), "rollback": lambda: self.txn("rollback"),
        }.get(t.text.lower() if t.text.isascii() else "")
        if not parse:
            raise invalid(f"unknown statement '{t.text}'")
        self.at += 1
        out = parse()
        self.op(";")
        if self.peek().kind != "end":
            raise invalid(f"unexpected '{self.peek().text}' after the statement")
        return out

    def txn(self, kind: str) -> Statement:
        self.word("transaction")
        return Statement(kind)

    def select(self) -> Statement:
        out = Statement("select")
        if not self.op("*"):
            out.columns = self.names(MAX_COLUMNS)
        self.need_word("from")
        out.table = self.name()
        self.tail(out, order=True)
        return out

    def tail(self, out: Statement, order: bool) -> None:
        if self.word("where"):
            out.where = self.groups()
        if order and self.word("order"):
            self.need_word("by")
            out.order = self.name()
            if self.word("desc"):
                out.descending = True
            else:
                self.word("asc")
        if order and self.word("limit"):
            t = self.peek()
            if t.kind != "int" or int(t.text) > INT_MAX:
                raise invalid("LIMIT needs a non-negative integer")
            self.at += 1
            out.limit = int(t.text)

    def groups(self) -> Groups:
        out = [self.group()]
        while self.word("or"):
            out.append(self.group())
        return tuple(out)

    def group(self) -> tuple[Condition, ...]:
        out = [self.condition()]
        while self.word("and"):
            out.append(self.condition())
        return tuple(out)

    def condition(self) -> Condition:
        column = self.name()
        if self.word("is"):
            negated = self.word("not")
            self.need_word("null")
            return Condition(column, "notnull" if negated else "isnull")
        if self.word("between"):
            low = self.literal()
            self.need_word("and")
            return Condition(column, "between", low, self.literal())
        t = self.peek()
        if t.kind != "op" or t.text not in ("=", "<>", "<", "<=", ">", ">="):
            raise invalid(f"expected a comparison near '{t.text}'")
        self.at += 1
        return Condition(column, t.text, self.literal())

    def insert(self) -> Statement:
        self.need_word("into")
        out = Statement("insert", self.name())
        if self.op("("):
            out.columns = self.names(MAX_COLUMNS)
            self.need_op(")")
        self.need_word("values")
        while True:
            self.need_op("(")
            row = [self.literal()]
            while self.op(","):
                row.append(self.literal())
            self.need_op(")")
            if out.values and len(row) != len(out.values[0]):
                raise invalid("rows of VALUES differ in length")
            out.values.append(row)
            if not self.op(","):
                break
        if out.columns and len(out.columns) != len(out.values[0]):
            raise invalid(f"{len(out.columns)} columns but {len(out.values[0])} values")
        return out

    def update(self) -> Statement:
        out = Statement("update", self.name())
        self.need_word("set")
        while True:
            column = self.name()
            self.need_op("=")
            out.sets.append((column, self.literal()))
            if not self.op(","):
                break
        self.tail(out, order=False)
        return out

    def delete(self) -> Statement:
        self.need_word("from")
        out = Statement("delete", self.name())
        self.tail(out, order=False)
        return out

    def column_def(self) -> ColumnDef:
        name, kind = self.name(), self.name().lower()
        if kind in ("integer", "int"):
            return ColumnDef(name, "int")
        if kind in ("real", "text"):
            return ColumnDef(name, kind)
        if kind in ("char", "character"):
            self.need_op("(")
            t = self.peek()
            if t.kind != "int" or not 1 <= int(t.text) <= MAX_CHAR:
                raise invalid(f"CHAR needs a width from 1 to {MAX_CHAR}")
            self.at += 1
            self.need_op(")")
            return ColumnDef(name, "char", int(t.text))
        raise invalid(f"unknown type '{kind}'")

    def index_columns(self) -> Statement:
        self.need_word("on")
        out = Statement("", self.name())
        self.need_op("(")
        out.columns = self.names(MAX_MEMBERS)
        self.need_op(")")
        return out

    def create(self) -> Statement:
        if self.word("table"):
            out = Statement("create_table", self.name())
            self.need_op("(")
            out.defs.append(self.column_def())
            while self.op(","):
                out.defs.append(self.column_def())
            self.need_op(")")
            if len(out.defs) > MAX_COLUMNS:
                raise invalid("too many columns")
            return out
        unique = self.word("unique")
        self.need_word("index")
        out = self.index_columns()
        out.kind, out.unique = "create_index", unique
        return out

    def drop(self) -> Statement:
        if self.word("table"):
            return Statement("drop_table", self.name())
        self.need_word("index")
        out = self.index_columns()
        out.kind = "drop_index"
        return out

    def alter(self) -> Statement:
        self.need_word("table")
        table = self.name()
        if self.word("add"):
            self.need_word("column")
            return Statement("add_column", table, defs=[self.column_def()])
        self.need_word("drop")
        self.need_word("column")
        return Statement("drop_column", table, columns=[self.name()])


def parse(text: str) -> Statement:
    return Parser(text).statement()
