"""A corpus from documents to shards: each stage works on all that the one before it kept.

All stages take null, empty and very long texts, repeated rows, empty tables and further columns
of any name; what they make of them is said with each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import at_end, free, hash_pair, load, quoted, release, remove, shared_dir, stash, stashed, text_of
from lodestone.llm.decontaminate import decontaminate
from lodestone.llm.mixing import mix, shuffled
from lodestone.llm.near_copies import near_copies
from lodestone.llm.quality_rules import ledger, passes
from lodestone.llm.sharding import record_size, shard, stored_maps

N_SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy v1.

    Each row is judged by itself, so repeated rows stay or go together. Null and empty texts have
    too few words and go.
    """
    return ledger(docs).where(passes("v1")).select(*[quoted(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id; of several with that doc_id the one of least hash.

    Near copies have a Jaccard similarity of 0.8 or more of their 5-word shingles, and so have those
    that are joined by such links. Links that SimHash finds are verified by that; those that 64
    bits can't find are found by an exact join. Rows equal in doc_id and text are one. A null
    doc_id comes last, so such a row stays only if all of its group are so. Null and empty texts
    are copies of each other. Of rows that tie in all of this, one stays.
    """
    h1, h2 = hash_pair(docs["doc_id"], text_of(docs))
    a, b = free(docs, "_h1"), free(docs, "_h2")
    named = docs.withColumns({a: h1, b: h2})
    groups = stash(near_copies(docs))
    ids = named.select(F.col(a).alias("h1"), F.col(b).alias("h2"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h1", "h2")).alias("first")
    kept = groups.join(ids, ["h1", "h2"]).groupBy("component").agg(first).select("first.h1", "first.h2")
    out = named.join(kept, (named[a] == kept["h1"]) & (named[b] == kept["h2"]), "left_semi").dropDuplicates([a, b])
    return out.select(*[quoted(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with any benchmark item: here one item is enough to go.

    Null and empty texts share none. Copies go or stay together.
    """
    judged = decontaminate(docs, load(spark, sf_dir, "benchmark"), min_items=1)
    return judged.where("NOT contaminated").select(*[quoted(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws it, in a global shuffle.

    Null sources are one source; sources without bytes get nothing, so null and empty texts of
    such a source go. Rows equal in doc_id and text are drawn alike.
    """
    return shuffled(mix(docs)).select(*[quoted(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and place in it, by the stored slot map of this table's path.

    Rows equal in doc_id and text differ by their places alone. A column size is replaced.
    """
    return shard(docs, N_SHARDS, maps=stored_maps(spark, f"{sf_dir}/pipeline", N_SHARDS)).withColumn("size", record_size(F.col("text")))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Near copies and their components can't be said in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is written to the shared folder and read again.

    What a stage read, and the tables it made for itself, are deleted once its result stands.
    """
    docs, before = load(spark, sf_dir, "documents"), None
    at = f"{shared_dir(spark)}/lodestone-pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path, mark = f"{at}/{name}", stashed()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(mark)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    at_end(spark, at)
    return docs
