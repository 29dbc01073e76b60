"""Line dedup: lines that many documents share are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, carried, hash_pair, load, restored, stash, text_of


def line_keys(text: Column) -> Column:
    """The forms in which a text's lines are compared: no white space at their ends, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(WS)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """docs with `kept` (text without common lines), `n_lines` and `n_dropped` in place of the text.

    A line is common when its key, of at least min_chars code points, stands in at least
    min_docs documents; each row is a document, equal rows included. Lines are exploded and
    their keys hashed to 128 bits; the documents of each hash are counted with a partial sum
    on the map side, so a line of a third of all documents costs each map task one row.
    The hashes of common lines go back to their texts by a join that adaptive execution can
    split, and each document drops them and joins its other lines in their old order.

    Null or empty text: one empty line, kept. An empty table gives an empty result. Rows are
    recognised by a hash of their text, for equal texts lose the same lines; repeated rows come
    back as often as they stand. Ties can't be: a key is common or not. Other columns pass
    through whatever their names; one that has a name of a new column is replaced by it. A
    text is held whole, with its lines, in the task that reads it.
    """
    new = ("kept", "n_lines", "n_dropped")
    names = [c for c in docs.columns if c != text and c.lower() not in new]
    a, b = hash_pair(text_of(docs, text))
    named = docs.select(carried(docs, names).alias("row"), text_of(docs, text).alias("text"), a.alias("t1"), b.alias("t2"))
    keys = F.filter(line_keys(F.col("text")), lambda x: F.length(x) >= min_chars)
    each = named.select("t1", "t2", F.inline(F.transform(F.array_distinct(keys), key_hash)))
    # both are stored, so that the joins that follow deal their sides anew and a hot line's or text's rows can be split
    common = stash(each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"))
    found = stash(
        each.join(common, ["h1", "h2"], "left_semi")
        .groupBy(F.col("t1").alias("f1"), F.col("t2").alias("f2")).agg(F.collect_set(F.struct("h1", "h2")).alias("common")))
    joined = named.join(found, (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")), "left")
    whole = F.col("text")
    lines = F.split(whole, "\n", -1)
    # only texts that have a common line are compared by line
    drops = F.transform(line_keys(whole), lambda x: (F.length(x) >= min_chars) & F.array_contains(F.col("common"), key_hash(x)))
    stays = F.filter(F.zip_with(lines, drops, lambda x, d: F.when(~d, x)), lambda x: x.isNotNull())
    kept = F.when(F.col("common").isNull(), lines).otherwise(stays)
    out = joined.select("row", F.size(lines).alias("n_lines"), kept.alias("kept"))
    return out.select(
        *restored(names), F.array_join("kept", "\n").alias("kept"), F.col("n_lines").cast("long").alias("n_lines"),
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id
"""
