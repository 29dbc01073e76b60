import io
import os

import pytest

from lodestone.errors import EngineError, Status
from lodestone.session import KEEP, Session
from lodestone.shells.sql_shell import SqlShell
from lodestone.shells.table_shell import TableShell
from lodestone.sources.store import Files, pack, unpack


@pytest.fixture
def db(spark, tmp_path):
    with Session.open(spark, str(tmp_path / "db")) as s:
        yield s


def values(s, text):
    return [tuple(r) for r in s.sql(text).df.collect()]


def status(call, *args):
    with pytest.raises(EngineError) as e:
        call(*args)
    return e.value.status


def test_a_shelf_of_jars(db):
    """One table through all statements."""
    db.sql("CREATE TABLE jar (no INTEGER, content CHAR(16), shelf CHAR(4), grams REAL)")
    db.sql("CREATE INDEX ON jar (shelf)")
    db.sql("INSERT INTO jar VALUES (10,'plum','low',310.5),(11,'quince','low',275),(12,'pepper','top',42.25),(13,'salt','top',900),(14,'rye','low',512)")
    assert values(db, "SELECT content FROM jar WHERE shelf = 'low' AND grams > 300 ORDER BY grams DESC") == [("rye",), ("plum",)]
    assert db.sql("UPDATE jar SET grams = 850.0 WHERE no = 13").count == 1
    assert db.sql("DELETE FROM jar WHERE shelf = 'low' OR no = 77").count == 3
    assert values(db, "SELECT * FROM jar") == [(12, "pepper", "top", 42.25), (13, "salt", "top", 850.0)]
    assert db.sql("SELECT no, content FROM jar").render().splitlines()[:2] == ["no  content", "--  -------"]


PARITY = [
    ("INTEGER", "-4,7,7,20", {"= 7": 2, "= 7.0": 2, "= 7.25": 0, "BETWEEN 0 AND 19": 2, "BETWEEN 19 AND 0": 0, "< 7": 1, "<= 7": 3, "> 7": 1, ">= 7": 3, "< 7.25": 3, "BETWEEN -4 AND 7.25": 3}),
    ("REAL", "-0.5,2.25,2.25,8.0", {"= 2.25": 2, "BETWEEN 1.0 AND 7.0": 2, "< 2.25": 1, ">= 2.25": 3, "> 8": 0, "<= 0": 1}),
    ("CHAR(8)", "'fig','oak','fig','yew '", {"= 'fig   '": 2, "BETWEEN 'fig' AND 'oak'": 3, "BETWEEN 'fig' AND 'yew'": 4, "< 'oak'": 2, "> 'figs'": 2, "< 'zzzzzzzzzz'": 4, "= 'yew'": 1}),
]


@pytest.mark.parametrize(("dtype", "rows", "wanted"), PARITY)
def test_scan_and_index_agree(db, dtype, rows, wanted):
    db.sql(f"CREATE TABLE t (x {dtype})")
    db.sql("INSERT INTO t VALUES " + ",".join(f"({v})" for v in rows.split(",")))
    for indexed in (False, True):
        if indexed:
            db.sql("CREATE INDEX ON t (x)")
        for test, n in wanted.items():
            assert len(values(db, f"SELECT x FROM t WHERE x {test}")) == n, (test, indexed)


def test_order_and_nulls(db):
    db.sql("CREATE TABLE t (i INTEGER, v INTEGER, note TEXT)")
    db.sql("INSERT INTO t VALUES (5, NULL, ''), (1, 2, NULL), (3, 2, 'x')")
    assert values(db, "SELECT i FROM t WHERE i > 0 LIMIT 1") == [(5,)]
    assert values(db, "SELECT i FROM t ORDER BY v") == [(1,), (3,), (5,)]
    assert values(db, "SELECT i FROM t ORDER BY v DESC") == [(5,), (1,), (3,)]
    assert values(db, "SELECT i FROM t WHERE v <> 7") == [(1,), (3,)]
    assert values(db, "SELECT i FROM t WHERE note IS NULL") == [(1,)]
    db.sql("CREATE INDEX ON t (i)")
    assert values(db, "SELECT i FROM t WHERE i > 0") == [(1,), (3,), (5,)]
    for bad in ("SELECT i FROM t WHERE note = 'x'", "SELECT i FROM t ORDER BY note", "SELECT i FROM t WHERE v = NULL", "SELECT i FROM t WHERE v = 'a'", "CREATE INDEX ON t (note)", "SELECT q FROM t"):
        with pytest.raises(EngineError):
            db.sql(bad)


def test_keys(db):
    db.sql("CREATE TABLE inv (sku CHAR(8), region INTEGER, qty INTEGER)")
    db.sql("CREATE UNIQUE INDEX ON inv (sku, region)")
    db.sql("INSERT INTO inv VALUES ('AAA',1,10),('AAA',2,20),('BBB',1,30),(NULL,1,1),(NULL,1,2)")
    assert db.get_by_key("inv", {"sku": "AAA", "region": 2}).qty == 20
    assert status(db.sql, "INSERT INTO inv VALUES ('CCC',1,1),('AAA',1,5)") == Status.DUP
    assert db.live_count("inv") == 5
    assert status(db.sql, "UPDATE inv SET region = 1 WHERE sku = 'AAA'") == Status.DUP
    assert status(db.get_by_key, "inv", {"sku": "AAA"}) == Status.INVALID
    db.delete_by_key("inv", {"sku": "AAA", "region": 1})
    assert status(db.get_by_key, "inv", {"sku": "AAA", "region": 1}) == Status.NOT_FOUND
    db.sql("CREATE INDEX ON inv (qty)")
    assert [r.qty for r in db.find_range("inv", "qty", 2, 30)] == [2, 20, 30]
    c = db.cursor("inv", "qty")
    db.insert("inv", ["a too long one", 9, 9])
    with pytest.raises(EngineError):
        next(c)
    assert db.find_by("inv", "sku", "a too lo").qty == 9
    db.compact("inv")
    assert [r._rid for r in db.rows("inv").orderBy("_rid").collect()] == [1, 2, 3, 4, 5] and db.verify("inv") == []


def test_transactions_and_history(db):
    db.sql("CREATE TABLE t (v INTEGER)")
    db.sql("BEGIN")
    db.sql("INSERT INTO t VALUES (1)")
    assert values(db, "SELECT v FROM t") == [(1,)]
    assert status(db.sql, "CREATE INDEX ON t (v)") == Status.INVALID
    db.sql("ROLLBACK")
    assert values(db, "SELECT v FROM t") == []
    for v in (1, 2):
        db.begin(f"add {v}")
        db.sql(f"INSERT INTO t VALUES ({v})")
        db.commit()
    assert db.undo() == "add 2" and values(db, "SELECT v FROM t") == [(1,)]
    assert db.redo() == "add 2" and values(db, "SELECT v FROM t") == [(1,), (2,)]
    db.sql("INSERT INTO t VALUES (3)")  # without a label: history ends
    assert status(db.undo) == Status.NO_UNDO and status(db.commit) == Status.INVALID


def test_reopen_lock_archive(spark, tmp_path):
    at = str(tmp_path / "db")
    with Session.open(spark, at) as s:
        s.sql("CREATE TABLE t (a INTEGER, b TEXT)")
        s.sql("INSERT INTO t VALUES (1, 'x')")
        assert status(Session.open, spark, at) == Status.LOCKED
        s.set_readonly()
        with Session.open(spark, at, True) as r:
            assert values(r, "SELECT * FROM t") == [(1, "x")]
            assert status(r.sql, "DELETE FROM t") == Status.READONLY
    pack(at, str(tmp_path / "one"))
    unpack(str(tmp_path / "one"), str(tmp_path / "two"))
    with Session.open(spark, str(tmp_path / "two")) as s:
        assert values(s, "SELECT * FROM t") == [(1, "x")]
    raw = bytearray((tmp_path / "one").read_bytes())
    raw[len(raw) // 2] ^= 1
    (tmp_path / "bad").write_bytes(raw)
    with pytest.raises(EngineError):
        unpack(str(tmp_path / "bad"), str(tmp_path / "three"))
    assert not os.path.exists(tmp_path / "three")


class Failing(Files):
    def __init__(self, at):
        self.left = at

    def _count(self):
        self.left -= 1
        if self.left == 0:
            raise OSError("injected")

    def write(self, path, data):
        self._count()
        super().write(path, data)

    def rename(self, a, b):
        self._count()
        super().rename(a, b)

    def sync(self, path):
        if "/parts/" in path:
            self._count()
        super().sync(path)


@pytest.mark.parametrize("at", range(3, 11))
def test_failed_commits_leave_the_state(spark, tmp_path, at):
    with Session.open(spark, str(tmp_path / "db"), files=Failing(at)) as s:
        s.sql("CREATE TABLE t (v INTEGER)")
        done = 0
        for v in range(3):
            try:
                s.sql(f"INSERT INTO t VALUES ({v})")
                done += 1
            except EngineError as e:
                assert e.status == Status.ERR
        assert done == 2 and s.live_count("t") == 2 and s.verify("t") == []
    with Session.open(spark, str(tmp_path / "db")) as s:
        assert s.live_count("t") == 2


def test_alter(db):
    db.sql("CREATE TABLE al (a INTEGER, b CHAR(4))")
    db.sql("INSERT INTO al VALUES (1,'x'),(2,'y')")
    db.sql("ALTER TABLE al DROP COLUMN b")
    db.sql("ALTER TABLE al ADD COLUMN b CHAR(4)")
    assert values(db, "SELECT * FROM al") == [(1, None), (2, None)]
    assert status(db.sql, "INSERT INTO al VALUES (3,'toolong')") == Status.INVALID
    db.sql("ALTER TABLE al DROP COLUMN b")
    assert status(db.sql, "ALTER TABLE al DROP COLUMN a") == Status.INVALID


def test_an_index_changes_no_answer(db):
    db.sql("CREATE TABLE t (a INTEGER, b INTEGER)")
    db.sql("INSERT INTO t VALUES (1, NULL), (1, 2), (0, 9), (2, NULL), (1, 1)")
    plain = sorted(values(db, "SELECT * FROM t WHERE a >= 1"), key=str)
    db.sql("CREATE INDEX ON t (a, b)")
    assert values(db, "SELECT * FROM t WHERE a >= 1") == [(1, 1), (1, 2), (1, None), (2, None)] and sorted(values(db, "SELECT * FROM t WHERE a >= 1"), key=str) == plain


def test_nan_and_dropped_indices_and_tables(db):
    db.sql("CREATE TABLE t (id INTEGER, x REAL)")
    db.sql("CREATE INDEX ON t (x)")
    assert status(db.insert, "t", [1, float("nan")]) == Status.INVALID and db.live_count("t") == 0
    db.sql("DROP INDEX ON t (x)")
    assert status(db.sql, "DROP INDEX ON t (x)") == Status.NOT_FOUND
    db.insert("t", [1, float("nan")])
    assert status(db.create_index, "t", ["x"]) == Status.INVALID and db.indices("t") == []
    db.sql("BEGIN")
    for text in ("DROP TABLE t", "CREATE TABLE u (a INTEGER)", "ALTER TABLE t ADD COLUMN c INTEGER", "ALTER TABLE t DROP COLUMN x", "CREATE INDEX ON t (id)"):
        assert status(db.sql, text) == Status.INVALID
    assert status(db.compact, "t") == Status.INVALID
    db.sql("ROLLBACK")
    db.sql("DROP TABLE t")
    assert db.tables() == [] and status(db.sql, "SELECT * FROM t") == Status.NOT_FOUND


def test_rows_by_id_key_and_text(db):
    db.sql("CREATE TABLE t (k INTEGER, v CHAR(4), note TEXT)")
    db.sql("CREATE UNIQUE INDEX ON t (k)")
    a, b = db.insert("t", [1, "one", "first"]), db.insert("t", [2, "two", None])
    db.update("t", a, [1, "uno", KEEP])
    assert tuple(db.get("t", a))[1:] == (1, "uno", "first")
    db.set_text("t", b, "note", "x" * 70_000)
    assert db.get_text("t", b, "note") == "x" * 70_000 and status(db.get_text, "t", b, "v") == Status.INVALID
    db.update_by_key("t", {"k": 2}, [3, "drei", None])
    assert db.get_by_key("t", {"k": 3}).note is None and status(db.update_by_key, "t", {"k": 2}, [2, "x", None]) == Status.NOT_FOUND
    assert status(db.get_by_key, "t", {"k": None}) == Status.NOT_FOUND and status(db.update, "t", 99, [9, "x", None]) == Status.NOT_FOUND
    seen = []
    assert db.scan("t", lambda r: seen.append(r.k)) == 2 and seen == [1, 3]
    assert db.scan("t", lambda r: True) == 1


def test_history_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.session.HISTORY", 3)
    with Session.open(spark, str(tmp_path / "db")) as s:
        s.sql("CREATE TABLE t (v INTEGER)")
        for v in range(5):
            s.begin(f"add {v}")
            s.sql(f"INSERT INTO t VALUES ({v})")
            s.commit()
        assert [s.undo() for _ in range(3)] == ["add 4", "add 3", "add 2"] and status(s.undo) == Status.NO_UNDO
        assert s.redo() == "add 2"
        s.begin("new")
        s.sql("INSERT INTO t VALUES (9)")
        s.commit()
        assert status(s.redo) == Status.NO_UNDO and values(s, "SELECT v FROM t ORDER BY v") == [(0,), (1,), (2,), (9,)]


def test_damage_is_found(spark, tmp_path):
    at = tmp_path / "db"
    with Session.open(spark, str(at)) as s:
        s.sql("CREATE TABLE t (v INTEGER)")
        s.sql("INSERT INTO t VALUES (1), (2)")
        s.sql("INSERT INTO t VALUES (3), (4)")
        assert s.verify("t") == []
        one, two = (next((at / "parts" / p).glob("*.parquet")) for p in s.state["tables"]["t"]["parts"])
        two.write_bytes(one.read_bytes())  # as many rows, but others
        for crc in (at / "parts").rglob(".*.crc"):
            crc.unlink()
        spark.catalog.clearCache()
        assert any("damaged" in x for x in s.verify("t"))
    newest = max(at.glob("manifest-*.json"))
    newest.write_text(newest.read_text()[:-9])
    with Session.open(spark, str(at)) as s:
        assert s.live_count("t") == 2


def test_updates_over_many_parts_are_one_write(db):
    db.sql("CREATE TABLE t (v INTEGER)")
    for v in range(4):
        db.sql(f"INSERT INTO t VALUES ({v}), ({v + 10})")
    parts = list(db.state["tables"]["t"]["parts"])
    assert db.sql("UPDATE t SET v = 99 WHERE v = 1 OR v = 12").count == 2
    now = db.state["tables"]["t"]["parts"]
    assert len(now) == 3 and set(now[:2]) < set(parts) and sorted(values(db, "SELECT v FROM t")) == [(0,), (2,), (3,), (10,), (11,), (13,), (99,), (99,)]


def test_shell_files(spark, tmp_path):
    (tmp_path / "inner").write_text("INSERT INTO t VALUES (1), (2)\nSELECT a FROM t\n")
    (tmp_path / "outer").write_text(f"# a remark\n.open {tmp_path}/db\nCREATE TABLE t (a INTEGER)\n.read {tmp_path}/inner\n.open\n.read {tmp_path}/none\n")
    (tmp_path / "loop").write_text(f".read {tmp_path}/loop\n")
    out, err = io.StringIO(), io.StringIO()
    SqlShell(spark, out, err).run([f".read {tmp_path}/outer", f".read {tmp_path}/loop"], "sql> ")
    assert "(2 row(s))" in out.getvalue()
    assert all(x in err.getvalue() for x in ("usage: .open <dir>", "can't read", "nested too deeply", "sql> "))
    (tmp_path / "commands").write_text(f"o {tmp_path}/db\nuse t\ns\nb\nd t\ntables\n")
    out, err = io.StringIO(), io.StringIO()
    TableShell(spark, out, err).run([f"run {tmp_path}/commands", "create u", "col x real", "cancel", "readonly", "drop t", "quit"])
    assert "2 row(s)" in out.getvalue() and "a INTEGER" in out.getvalue() and "t  (2 rows)" in out.getvalue() and "read-only" in err.getvalue()


def test_shells(spark, tmp_path):
    out, err = io.StringIO(), io.StringIO()
    SqlShell(spark, out, err).run([f".open {tmp_path}/db", "CREATE TABLE t (a INTEGER)", "INSERT INTO t VALUES (7)", ".tables", ".schema", "SELECT b FROM t", "SELECT a FROM t", ".quit"])
    assert "t  (1 rows, 1 cols)" in out.getvalue() and "(1 row(s))" in out.getvalue() and "no such column" in err.getvalue()
    out, err = io.StringIO(), io.StringIO()
    TableShell(spark, out, err).run([f"o {tmp_path}/db", "cr f", "col id int", "col word char 16", "done", "u f", "i 1 apple", "i 2 apricot", "i 3 banana", "index word", "m word ^a", "r word b c", "v", "x", "b", "d f"])
    text = out.getvalue()
    assert "word=apple" in text and "word=banana" in text and "ok" in text and "index (word)" in text and "unknown command" in err.getvalue()
