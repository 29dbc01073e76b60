"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, few, load, quoted, restored, stash, text_of

#: A rate above this is drawn as a sum of equal parts below it.
PART = 16.0
#: Terms of a part's distribution; the rest of a rate of 16 is far below 2 ** -53.
TERMS = 96
#: Bits of a copy's place.
PLACE_BITS = 60
#: So many sources are broadcast; more are joined by a shuffle.
MOST_SOURCES = 10_000


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the key's MD5, the same on every run and machine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict | None, power: float, source: str = "source", text: str = "text") -> DataFrame:
    """A row for each source: `n_bytes`, `rate` (copies of each document, in the mean), `parts`, `cdf`.

    weights are target shares of the bytes by source; sources that are not named get 0. None:
    shares in proportion to a source's bytes to the power. The mixture is as large as the input.
    """
    sized = docs.groupBy(docs[quoted(source)].alias("source")).agg(F.sum(F.octet_length(text_of(docs, text)).cast("long")).alias("n_bytes"))
    if weights is None:
        share = F.pow(F.col("n_bytes").cast("double"), F.lit(power))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sized = sized.withColumn("share", F.when(F.col("n_bytes") > 0, share).otherwise(F.lit(0.0)))
    sized = stash(sized)
    whole = sized.agg(F.sum("share").alias("shares"), F.sum("n_bytes").alias("n_bytes")).first()
    rate = F.when(F.col("share") > 0, F.col("share") / F.lit(whole.shares or 1.0) * F.lit(float(whole.n_bytes or 0)) / F.col("n_bytes")).otherwise(F.lit(0.0))
    lam = F.col("rate") / F.col("parts")
    # terms of the distribution and their running sums
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(F.exp(-lam).alias("term"), F.array(F.exp(-lam)).alias("sums")),
        lambda a, k: F.struct(
            (a["term"] * lam / k).alias("term"),
            F.concat(a["sums"], F.array(F.element_at(a["sums"], -1) + a["term"] * lam / k)).alias("sums"),
        ),
        lambda a: a["sums"],
    )
    return (
        sized.withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
        .select("source", "n_bytes", "rate", "parts", cdf.alias("cdf"))
    )


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.5, seed: int = 17, key: str = "doc_id",
        source: str = "source", text: str = "text") -> DataFrame:
    """docs, each row as often as its Poisson draw says, with `copy` (from 1), `n_copies` and `place`.

    The draw inverts the Poisson distribution whose mean is the source's rate at a uniform
    number hashed from seed, key and text, so that it is the same on each run, on any
    partitioning, and independent between documents. A row drawn 0 times goes; that is the
    operator's feature. `place` is a hash of the copy: sorted by it, the mixture is shuffled.

    Null keys and texts hash as empty, a null source is a source like any other. Rows equal in
    key and text get equal draws, which is how ties and repeated rows come out. Sources without
    bytes get nothing. An empty table stays empty. Other columns pass through whatever their
    names; those with the names of new ones are replaced. A text is only hashed, so its length
    bears on nothing else. Sources are few in practice and then broadcast, after their number
    is counted; beyond MOST_SOURCES a join by source runs that adaptive execution can split.
    """
    new = ("copy", "n_copies", "place")
    names = [c for c in docs.columns if c.lower() not in new]
    of = stash(rates(docs, weights, power, source, text)).select(F.struct("source").alias("of"), "parts", "cdf")
    if few(of, MOST_SOURCES):
        of = F.broadcast(of)
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[quoted(key)].cast("string"), F.lit("")), F.md5(text_of(docs, text).cast("binary")))
    named = docs.select(carried(docs, names).alias("row"), F.struct(docs[quoted(source)].alias("source")).alias("s"), ident.alias("ident"))
    both = named.join(of, F.col("s").eqNullSafe(F.col("of")))
    # one number for each part; each is then compared with the sums of the distribution
    numbers = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.col("ident"), j.cast("string")))
    drawn = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    # inlined as rows, so that the draw is a column of its own and not made again for each use
    counted = both.select("row", "ident", F.inline(F.array(F.struct(drawn.alias("n_copies"))))).where("n_copies > 0")
    each = counted.select("row", "ident", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("place"), "ident", F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return each.select(*restored(names), "n_copies", "copy", place.alias("place"))


def shuffled(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mixture in the order of `place`: a global shuffle.

    Places are spread evenly over 60 bits, so their ranges are known without a sample and each
    row is made once. partitions: by default as many as Spark's shuffles have.
    """
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = -(-(1 << PLACE_BITS) // n)
    return mixed.repartitionById(n, F.floor(F.col("place") / F.lit(width)).cast("int")).sortWithinPartitions("place")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return shuffled(mix(docs).select("doc_id", "source", "n_copies", "copy", "place"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS b FROM documents),
s AS (SELECT source, sum(b)::BIGINT AS n_bytes, CASE WHEN sum(b) > 0 THEN pow(sum(b)::DOUBLE, 0.5) ELSE 0 END AS share FROM d GROUP BY source),
r AS (SELECT source, CASE WHEN share > 0 THEN share / (sum(share) OVER ()) * (sum(n_bytes) OVER ())::DOUBLE / n_bytes ELSE 0 END AS rate FROM s),
p AS (SELECT source, greatest(ceil(rate / 16.0), 1)::INT AS parts, rate / greatest(ceil(rate / 16.0), 1) AS lam FROM r),
t AS (SELECT source, parts, k, exp(-lam) * pow(lam, k) / gamma(k + 1) AS term FROM p, range(0, 97) AS x(k)),
cdf AS (SELECT source, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM t),
u AS (SELECT doc_id, source, '17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text) AS ident FROM d),
h AS (SELECT u.*, j, ('0x' || substr(md5(ident || ':' || j::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source, range(1, (SELECT max(parts) FROM p) + 1) AS y(j) WHERE j <= p.parts),
n AS (SELECT h.doc_id, h.source, h.ident, count(*) AS n_copies FROM h JOIN cdf ON h.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= h.u GROUP BY ALL)
SELECT doc_id, source, n_copies::INT AS n_copies, g::INT AS copy,
       ('0x' || substr(md5('place:' || ident || ':' || g::VARCHAR), 1, 15))::BIGINT AS place
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS g FROM n)
"""
