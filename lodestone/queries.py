"""The read operators and end states as queries on the given tables, each with its SQL."""

from __future__ import annotations

import atexit
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EngineError, Status
from .functions.values import es15_8_column
from .operators import relational as R
from .plans.dialect import ColumnDef, parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[ColumnDef]:
    """Types that the dialect compares; the others it reads and returns only."""
    kinds = {T.IntegerType: "int", T.LongType: "int", T.DoubleType: "real", T.StringType: "char"}
    return [ColumnDef(f.name, kinds.get(type(f.dataType), "opaque"), 65_536) for f in df.schema.fields]


def dialect(spark: SparkSession, df: DataFrame, text: str, ties: tuple[str, ...], indices=()) -> DataFrame:
    s = parse(text)
    return R.select(df, columns_of(df), s.columns, s.where, s.order, s.descending, s.limit, ties, indices)


KEYS = {
    "nation": ("n_nationkey",), "region": ("r_regionkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "customer": ("c_custkey",),
    "supplier": ("s_suppkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
}


def add(name: str, text: str, sql: str | None = None, indices=()) -> None:
    """A query in the dialect; its SQL is the same text unless the dialect means something else by it."""
    t = parse(text).table
    QUERIES[name] = lambda spark, d: dialect(spark, table(spark, d, t), text, KEYS[t], indices)
    SQL[name] = sql or text


def define(name: str, sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


add("scan_star", "SELECT * FROM nation")
add("scan_region", "SELECT * FROM region")
add("scan_events", "SELECT event_id, user_id, event_type, value FROM events")
add("project_cols", "SELECT p_partkey, p_name, p_size FROM part")
add("filter_eq_int", "SELECT p_partkey, p_size FROM part WHERE p_size = 11")
add("filter_ne_int", "SELECT p_partkey, p_size FROM part WHERE p_size <> 11")
add("filter_lt_real", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5.0")
add("filter_le_real", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 5.0")
add("filter_gt_real", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45.0")
add("filter_ge_real", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45.0")
add("filter_int_real_literal", "SELECT p_partkey, p_size FROM part WHERE p_size = 11.0 OR p_size < 3.5",
    "SELECT p_partkey, p_size FROM part WHERE p_size = CAST(11.0 AS DOUBLE) OR p_size < CAST(3.5 AS DOUBLE)")
add("filter_char_eq", "SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#23'")
add("filter_char_range", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'F' AND c_mktsegment < 'N'")
add("filter_char_blank", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING  '",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE rtrim(c_mktsegment) = rtrim('BUILDING  ')")
add("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000.0 AND 50000.0")
add("filter_between_empty", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000.0 AND 1000.0")
add("filter_and_or_dnf", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 40.0 AND l_returnflag = 'R' OR l_discount = 0.0 AND l_linenumber = 1")
add("filter_documents", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 2000")
add("filter_labels", "SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1")
add("order_limit_topk", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 ORDER BY o_totalprice DESC LIMIT 100",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000.0 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100")
add("order_nonprojected", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice LIMIT 25",
    "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice NULLS LAST, p_partkey LIMIT 25")
add("limit_rid_order", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 10.0 LIMIT 50",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 10.0 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 50")
add("limit_index_order", "SELECT p_partkey, p_size FROM part WHERE p_size > 40 LIMIT 20",
    "SELECT p_partkey, p_size FROM part WHERE p_size > 40 ORDER BY p_size, p_partkey LIMIT 20", indices=(("p_size",),))
add("limit_zero", "SELECT n_name FROM nation LIMIT 0")

NULLABLE = "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END"


def nullable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(NULLABLE).alias("size"))


def add_nullable(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: dialect(spark, nullable(spark, d), text, ("p_partkey",))
    SQL[name] = f"WITH t AS (SELECT p_partkey, {NULLABLE} AS size FROM part) {sql}"


add_nullable("filter_is_null", "SELECT * FROM t WHERE size IS NULL", "SELECT * FROM t WHERE size IS NULL")
add_nullable("filter_is_not_null", "SELECT * FROM t WHERE size IS NOT NULL", "SELECT * FROM t WHERE size IS NOT NULL")
add_nullable("filter_ne_with_null", "SELECT * FROM t WHERE size <> 11", "SELECT * FROM t WHERE size <> 11")
add_nullable("order_asc_nulls_last", "SELECT * FROM t ORDER BY size LIMIT 200", "SELECT * FROM t ORDER BY size NULLS LAST, p_partkey LIMIT 200")
add_nullable("order_desc_nulls_first", "SELECT * FROM t ORDER BY size DESC LIMIT 900", "SELECT * FROM t ORDER BY size DESC NULLS FIRST, p_partkey LIMIT 900")


@define("filter_nan", "SELECT p_partkey FROM part WHERE p_size % 5 <> 0 AND p_retailprice > 950.0")
def filter_nan(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_size % 5 = 0 THEN double('NaN') ELSE p_retailprice END").alias("v"))
    return dialect(spark, df, "SELECT p_partkey FROM part WHERE v > 950.0", ("p_partkey",))


@define("index_cursor", "SELECT o_orderkey, o_orderdate FROM orders")
def index_cursor(spark, d):
    return R.index_scan(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ("o_orderkey",), ())


@define("index_range_int", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 200")
def index_range_int(spark, d):
    return R.index_range(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ("o_custkey",), 10, 200, ("o_orderkey",))


@define("index_range_real", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000.0 AND 2500.5")
def index_range_real(spark, d):
    return R.index_range(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice",), 1000.0, 2500.5, ("o_orderkey",))


@define("index_range_char", "SELECT p_partkey, p_brand FROM part WHERE p_brand BETWEEN 'Brand#2' AND 'Brand#4'")
def index_range_char(spark, d):
    return R.index_range(table(spark, d, "part").select("p_partkey", "p_brand"), ("p_brand",), "Brand#2", "Brand#4", ("p_partkey",))


@define("index_range_leading", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand BETWEEN 'Brand#2' AND 'Brand#4' ORDER BY p_brand, p_size, p_partkey LIMIT 40")
def index_range_leading(spark, d):
    return R.index_range(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ("p_brand", "p_size"), "Brand#2", "Brand#4", ("p_partkey",)).limit(40)


@define("find_first_in_key_order", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = 'Brand#23' ORDER BY p_size, p_partkey LIMIT 1")
def find_first_in_key_order(spark, d):
    return R.find_first(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ("p_brand", "p_size"), "Brand#23", ("p_partkey",))


@define("row_by_id", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def row_by_id(spark, d):
    return R.by_key(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderkey": 7})


@define("get_by_key", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def get_by_key(spark, d):
    return R.by_key(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), {"conv_id": 3, "turn": 1})


@define("unique_violation_probe", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violation_probe(spark, d):
    return R.duplicate_keys(table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"))


@define("regex_match", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^s')")
def regex_match(spark, d):
    return R.match(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "^s")


@define("regex_match_ignoring_case", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^S')")
def regex_match_ignoring_case(spark, d):
    return R.match(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "(?i)^S")


@define("render_es15_8", "SELECT p_partkey, printf('%.8E', p_retailprice) AS shown FROM part")
def render_es15_8(spark, d):
    return table(spark, d, "part").select("p_partkey", es15_8_column(F.col("p_retailprice")).alias("shown"))


_opened: list = []


@atexit.register
def _clear() -> None:
    for s in _opened:
        s.close()
        shutil.rmtree(s.store.path, ignore_errors=True)


def stored(spark: SparkSession, d: str, name: str, columns: list[str], ids: str):
    """A database in the shared folder with a copy of one table; it is closed and deleted when the driver ends."""
    from .session import Session, scratch

    df = table(spark, d, name).select(*columns)
    s = Session.open(spark, scratch(spark))
    _opened.append(s)
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "string": "CHAR(64)"}
    s.sql(f"CREATE TABLE t ({', '.join(f'{c} {kinds[k]}' for c, k in df.dtypes)})")
    s.append("t", df.orderBy(ids))
    return s


NATION = ["n_nationkey", "n_name", "n_regionkey"]


@define("insert_then_select", "SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', NULL UNION ALL SELECT 101, 'MU', 2")
def insert_then_select(spark, d):
    s = stored(spark, d, "nation", NATION, "n_nationkey")
    s.sql("INSERT INTO t VALUES (100, 'ATLANTIS', NULL), (101, 'MU  ', 2)")
    return s.sql("SELECT * FROM t").df


@define("update_then_select", "SELECT p_partkey::INT AS p_partkey, CASE WHEN p_size > 40 THEN 'large' ELSE p_brand END AS p_brand, p_size::INT AS p_size FROM part")
def update_then_select(spark, d):
    s = stored(spark, d, "part", ["p_partkey", "p_brand", "p_size"], "p_partkey")
    s.sql("UPDATE t SET p_brand = 'large' WHERE p_size > 40")
    return s.sql("SELECT * FROM t").df


@define("delete_then_select", "SELECT o_orderkey::INT AS o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice < 100000.0)")
def delete_then_select(spark, d):
    s = stored(spark, d, "orders", ["o_orderkey", "o_totalprice"], "o_orderkey")
    s.sql("DELETE FROM t WHERE o_totalprice < 100000.0")
    return s.sql("SELECT * FROM t").df


@define("alter_add_column", "SELECT r_regionkey::INT AS r_regionkey, r_name, CAST(NULL AS INT) AS extra FROM region")
def alter_add_column(spark, d):
    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    s.sql("ALTER TABLE t ADD COLUMN extra INTEGER")
    return s.sql("SELECT * FROM t").df


@define("alter_drop_column", "SELECT r_regionkey::INT AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM region")
def alter_drop_column(spark, d):
    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    s.sql("ALTER TABLE t DROP COLUMN r_name")
    s.sql("ALTER TABLE t ADD COLUMN r_name CHAR(64)")
    return s.sql("SELECT * FROM t").df


@define("txn_rollback", "SELECT r_regionkey::INT AS r_regionkey, r_name FROM region")
def txn_rollback(spark, d):
    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    for text in ("BEGIN", "DELETE FROM t", "INSERT INTO t VALUES (9, 'x')", "ROLLBACK"):
        s.sql(text)
    return s.sql("SELECT * FROM t").df


@define("undo_redo", "SELECT r_regionkey::INT AS r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
def undo_redo(spark, d):
    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    for key in (0, 1):
        s.begin(label=f"delete {key}")
        s.sql(f"DELETE FROM t WHERE r_regionkey = {key}")
        s.commit()
    s.undo()
    s.undo()
    s.redo()
    return s.sql("SELECT * FROM t").df


@define("compact_renumber", "SELECT row_number() OVER (ORDER BY o_orderkey)::INT AS row_id, o_orderkey::INT AS o_orderkey FROM orders WHERE NOT (o_totalprice < 100000.0)")
def compact_renumber(spark, d):
    s = stored(spark, d, "orders", ["o_orderkey", "o_totalprice"], "o_orderkey")
    s.sql("DELETE FROM t WHERE o_totalprice < 100000.0")
    s.compact("t")
    return s.rows("t").select(F.col(R.RID).alias("row_id"), "o_orderkey")


COMPOSITE = "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END"


@define("composite_index_nulls", f"SELECT p_partkey, p_size, {COMPOSITE} AS brand FROM part WHERE p_size >= 20 ORDER BY p_size, brand NULLS LAST, p_partkey LIMIT 300")
def composite_index_nulls(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", F.expr(COMPOSITE).alias("brand"))
    return dialect(spark, df, "SELECT p_partkey, p_size, brand FROM t WHERE p_size >= 20 LIMIT 300", ("p_partkey",), (("p_size", "brand"),))


@define("drop_table_then_create", "SELECT 7 AS a, 'again' AS b")
def drop_table_then_create(spark, d):
    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    for text in ("DROP TABLE t", "CREATE TABLE t (a INTEGER, b CHAR(8))", "INSERT INTO t VALUES (7, 'again')"):
        s.sql(text)
    return s.sql("SELECT * FROM t").df


@define("create_drop_index", "SELECT n_nationkey::INT AS n_nationkey, n_regionkey::INT AS n_regionkey FROM nation WHERE n_regionkey > 1 ORDER BY n_nationkey LIMIT 7")
def create_drop_index(spark, d):
    s = stored(spark, d, "nation", NATION, "n_nationkey")
    s.sql("CREATE INDEX ON t (n_regionkey)")
    s.sql("DROP INDEX ON t (n_regionkey)")
    return s.sql("SELECT n_nationkey, n_regionkey FROM t WHERE n_regionkey > 1 LIMIT 7").df


@define("update_row_by_id", "SELECT n_nationkey::INT AS n_nationkey, CASE WHEN n_nationkey = 2 THEN 'changed' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 2 THEN n_regionkey::INT END AS n_regionkey FROM nation")
def update_row_by_id(spark, d):
    s = stored(spark, d, "nation", NATION, "n_nationkey")
    s.update("t", s.find_rid("t", F.col("n_nationkey") == 2), [2, "changed", None])
    return s.sql("SELECT * FROM t").df


@define("update_and_delete_by_key", "SELECT n_nationkey::INT AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'by key' ELSE n_name END AS n_name, n_regionkey::INT AS n_regionkey FROM nation WHERE n_nationkey <> 5")
def update_and_delete_by_key(spark, d):
    from .session import KEEP

    s = stored(spark, d, "nation", NATION, "n_nationkey")
    s.sql("CREATE UNIQUE INDEX ON t (n_nationkey)")
    s.update_by_key("t", {"n_nationkey": 3}, [KEEP, "by key", KEEP])
    s.delete_by_key("t", {"n_nationkey": 5})
    return s.sql("SELECT * FROM t").df


@define("set_text", "SELECT r_regionkey::INT AS r_regionkey, CASE WHEN r_regionkey = 1 THEN 'a long note' END AS note FROM region")
def set_text(spark, d):
    s = stored(spark, d, "region", ["r_regionkey"], "r_regionkey")
    s.sql("ALTER TABLE t ADD COLUMN note TEXT")
    s.set_text("t", s.find_rid("t", F.col("r_regionkey") == 1), "note", "a long note")
    return s.sql("SELECT * FROM t").df


@define("batch_insert_rejected", "SELECT r_regionkey::INT AS r_regionkey, r_name FROM region UNION ALL SELECT 11, 'fits'")
def batch_insert_rejected(spark, d):
    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    s.sql("CREATE UNIQUE INDEX ON t (r_regionkey)")
    try:
        s.sql("INSERT INTO t VALUES (10, 'new'), (1, 'taken')")
    except EngineError as e:
        if e.status != Status.DUP:
            raise
    s.sql("INSERT INTO t VALUES (11, 'fits')")
    return s.sql("SELECT * FROM t").df


@define("redo_after_a_new_gesture", "SELECT r_regionkey::INT AS r_regionkey, r_name FROM region WHERE r_regionkey <> 2")
def redo_after_a_new_gesture(spark, d):
    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    for key in (0, 2):
        s.begin(label=f"delete {key}")
        s.sql(f"DELETE FROM t WHERE r_regionkey = {key}")
        s.commit()
        if not key:
            s.undo()
    if s.can_redo():
        s.redo()
    return s.sql("SELECT * FROM t").df


@define("pack_and_unpack", "SELECT r_regionkey::INT AS r_regionkey, r_name FROM region")
def pack_and_unpack(spark, d):
    from .session import Session, scratch
    from .sources.store import pack, unpack

    s = stored(spark, d, "region", ["r_regionkey", "r_name"], "r_regionkey")
    s.set_readonly()
    to = scratch(spark)
    pack(s.store.path, f"{s.store.path}/one.pack")
    unpack(f"{s.store.path}/one.pack", to)
    _opened.append(Session.open(spark, to))
    return _opened[-1].sql("SELECT * FROM t").df
