"""What the corpus operators share: tables, the shared working folder, names, byte tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words and line ends here.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_tables: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a folder of its own; on a cluster there
    is no folder that all executors see, and that is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    This cuts the lineage as a checkpoint does, in a form that any executor can read after
    others are lost. The tables are deleted by release(), else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stashed() -> int:
    """A mark for release(): how many tables there are."""
    return len(_tables)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def release(mark: int) -> None:
    """Deletes the tables stashed since the mark; only for a caller that has written what was read from them."""
    while len(_tables) > mark:
        remove(*_tables.pop())


def at_end(spark: SparkSession, path: str) -> None:
    """The path is deleted when the driver ends."""
    _tables.append((spark, path))


@atexit.register
def _clear() -> None:
    for spark, path in _tables:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before; the folder is the cluster's to clear then
            return


def carried(df: DataFrame, names: list[str]) -> Column:
    """The named columns as one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[df[quoted(c)].alias(c) for c in names]) if names else F.struct(F.lit(True).alias("none"))


def restored(names: list[str], of: str = "row") -> list[Column]:
    """What carried() packed."""
    return [F.col(of).getField(c).alias(c) for c in names]


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty; the name is quoted, so dots in it do no harm."""
    return F.coalesce(df[quoted(column)].cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash_pair(*columns: Column) -> tuple[Column, Column]:
    """128 bits as two longs."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; looks at no more than most + 1 of them."""
    return df.limit(most + 1).count() <= most
