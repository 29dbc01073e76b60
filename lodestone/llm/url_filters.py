"""URL filters: rules by host and path, and trust that spreads over links between hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, load, quoted, stash

#: (verdict, host, path) of the query's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(host, path, verdict, rule); null if none does.

    A rule fits its host and the host's subdomains where the path starts with the rule's. Of
    rules of one length that both fit, the one with the longer host is taken, then the first by name.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")) for v, h, p in ordered])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.when(F.size(fits) > 0, F.element_at(fits, 1))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): hosts of which one has a page that links to the other. Links within a host are none."""
    found = F.array_distinct(F.regexp_extract_all(pages[quoted(html)].cast("string"), F.lit(LINK), 1))
    each = pages.select(host_of(pages[quoted(url)]).alias("src"), F.explode(found).alias("dst"))
    return each.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst AND src <> ''").distinct()


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-7) -> DataFrame:
    """(host, trust, distrust) from hosts(host, trusted, blocked), the last two as seed weights.

    Personalised PageRank: trust flows from trusted seeds along edges, each host dividing its
    own among those it links to; distrust flows from blocked seeds against the edges, each host
    dividing its own among those that link to it. Rounds end when no trust and no distrust moves by more than
    the tolerance times the weight of one seed of its own kind, so copies of a graph are judged as
    the graph is. What moves in a round is less than in the one before by the damping at least,
    so the rounds end by themselves, the later the more seeds there are, and reach as far as
    that takes. Fewer rounds, if given, are an error where they do not suffice. What flows into a
    host without edges onward ends there.

    Messages are summed on the map side before they are shuffled, and the joins are of a kind
    that adaptive execution splits, so a host with a large part of all edges is no single task.
    """
    total = hosts.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    seeds = hosts.select("host", (F.col("trusted") / F.lit(total.t or 1.0) * (1 - damping)).alias("s_trust"),
                         (F.col("blocked") / F.lit(total.b or 1.0) * (1 - damping)).alias("s_distrust"))
    ranks = seeds.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    if edges.isEmpty():
        return ranks
    out_degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    in_degree = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))
    edges = stash(edges.join(out_degree, "src").join(in_degree, "dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    seeds = stash(nodes.join(seeds, "host", "full").na.fill(0.0))
    ranks = seeds.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    most = max(total.t or 1.0, total.b or 1.0)
    for _ in range(rounds or 2 + math.ceil(math.log(tolerance / most) / math.log(damping))):
        on = edges.join(ranks.select(F.col("host").alias("src"), "trust"), "src").where("trust > 0").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("trust") / F.col("n_out")).alias("in_trust"))
        back = edges.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").where("distrust > 0").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("distrust") / F.col("n_in")).alias("in_distrust"))
        new = seeds.join(on, "host", "left").join(back, "host", "left").select(
            "host", (F.col("s_trust") + damping * F.coalesce("in_trust", F.lit(0.0))).alias("trust"),
            (F.col("s_distrust") + damping * F.coalesce("in_distrust", F.lit(0.0))).alias("distrust"))
        both = new.join(ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")), "host")
        both = stash(both)
        ranks = both.select("host", "trust", "distrust")
        moved = both.agg(F.max(F.abs(F.col("trust") - F.col("t0"))).alias("t"), F.max(F.abs(F.col("distrust") - F.col("d0"))).alias("d")).first()
        if (moved.t or 0.0) <= tolerance * (1 - damping) / (total.t or 1.0) and (moved.d or 0.0) <= tolerance * (1 - damping) / (total.b or 1.0):
            return ranks
    raise RuntimeError(f"scores still move after {rounds} rounds")


def filter_urls(pages: DataFrame, rules=RULES, ratio: float = 1.0, damping: float = 0.85, rounds: int | None = None, key: str = "page_id",
                url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of each page.

    The longest rule that fits decides; for other pages their host does: block where distrust
    is over ratio times trust, else allow, so a tie allows. Seeds are hosts of which over half of
    the pages have rules for one verdict. DataFrame operations only.

    Null or malformed urls have host and path empty, no links and the verdict allow. Null html
    has no links; html is searched for links whole, however long. Repeated rows are judged each,
    and weigh twice in their host's seed. Links to hosts without pages carry trust through them.
    An empty table gives an empty result. Other columns are not returned, whatever their names;
    a key that has the name of a new column is returned with a _ before it.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    name = f"_{key}" if key.lower() in new else key
    p = pages.select(F.struct(pages[quoted(key)].alias("key")).alias("of"), host_of(pages[quoted(url)]).alias("host"), path_of(pages[quoted(url)]).alias("path"))
    p = p.withColumn("fits", rule_for(F.col("host"), F.col("path"), rules))
    n = F.count(F.lit(1))
    is_a = lambda v: F.count(F.when(F.col("fits.verdict") == v, 1))
    hosts = stash(p.where("host <> ''").groupBy("host").agg(
        F.when(is_a("allow") * 2 > n, 1.0).otherwise(0.0).alias("trusted"), F.when(is_a("block") * 2 > n, 1.0).otherwise(0.0).alias("blocked")))
    scores = propagate(hosts, stash(host_edges(pages, url, html)), damping, rounds)
    out = p.join(scores, "host", "left")
    return out.select(
        F.col("of.key").alias(name), "host", "path", F.col("fits.rule").alias("rule"),
        F.coalesce("fits.verdict", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
