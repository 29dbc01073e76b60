"""SimHash near-dedup: fingerprints that differ in few bits are found by generalised pigeonhole."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, load, quoted, stash, text_of

BITS, DISTANCE, WORDS, SEED = 64, 4, 4, 42
#: A probe or index row moves through a shuffle and a sort (some 1.7 us as measured); a candidate is one test of two longs in the join (0.1 us).
ROW_COST, CANDIDATE_COST = 17.0, 1.0
#: A bucket with over HEAVY candidates is heavy. If the heavy ones have over CANDIDATES for each fingerprint, which is what a
#: round of some 20 rows for each costs, they are first joined by LEADERS of each bucket.
HEAVY, CANDIDATES, LEADERS = 100_000, int(20 * ROW_COST / CANDIDATE_COST), 8
#: Edges that one task joins by itself: some 100 bytes of memory each.
EDGES = 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's n-word shingles; no words: 0."""
    words = (text or "").encode().translate(_LOWER).split()  # of bytes: splits at ASCII white space only
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):  # sums of bytes that fit a byte are fast
            ones += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int(((2 * ones > len(starts)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(key, fp long) of each row."""
    narrow = docs.select(docs[quoted(key)].alias("key"), text_of(docs, text).alias("text"))
    schema = T.StructType([narrow.schema["key"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["key", "fp"])

    return narrow.mapInArrow(run, schema)


def bit_products(fps: DataFrame) -> np.ndarray:
    """For each two bits the sum over all fingerprints of their product, as -1 and 1; last row: sums of the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS), np.int64)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64) * 2 - 1
            total += np.vstack([x.T @ x, x.sum(axis=0)]).astype(np.int64)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], names=["i", "j", "s"])

    out = np.zeros((BITS + 1, BITS))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, s long").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = r.s
    return out


def group_bits(products: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Correlated bits go together: a part grows by the bit that is most correlated with it."""
    mean = products[BITS] / n
    corr = np.abs(products[:BITS] / n - np.outer(mean, mean)) / np.sqrt(np.outer(1 - mean**2, 1 - mean**2) + 1e-9)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        own = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        left.remove(own[0])
        while len(own) < size:
            b = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def ball(size: int, radius: int) -> int:
    return sum(len(list(itertools.combinations(range(size), r))) for r in range(radius + 1)) if radius >= 0 else 0


def near(differ: np.ndarray, radius: int) -> float:
    """Chance that at most radius of independent bits differ, each with its own chance."""
    p = np.zeros(radius + 2)
    p[0] = 1
    for q in differ:
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
        p[-1] = 0
    return float(p[: radius + 1].sum())


def plan(products: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts of the bits, each with a threshold; two fingerprints within distance meet some part's threshold.

    Generalised pigeonhole: if thresholds sum to distance - parts + 1 (a part of threshold -1
    is not probed), the parts of two near fingerprints can't all differ by more. For each
    number of parts, dynamic programming chooses the thresholds with the fewest estimated
    candidates and probes; of these plans the cheapest is taken.
    """
    mean = products[BITS] / n
    differ = (1 - mean**2) / 2  # for two fingerprints, by bit
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, distance + 2):
        groups = group_bits(products, n, parts)
        budget = distance - parts + 1

        def cost(group: list[int], t: int) -> float:
            if t < 0:
                return 0.0
            probes = ball(len(group), t)
            return ROW_COST * n * (probes + 1) + CANDIDATE_COST * 0.5 * n * n * near(differ[group], t) if probes <= 4096 else float("inf")

        # table: thresholds' sum -> (cost, thresholds)
        table: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for g in groups:
            new: dict[int, tuple[float, tuple]] = {}
            for s, (c, ts) in table.items():
                for t in range(-1, distance + 1):
                    x = (c + cost(g, t), (*ts, t))
                    if s + t not in new or x < new[s + t]:
                        new[s + t] = x
            table = new
        if budget in table and table[budget][0] < best[0]:
            best = (table[budget][0], list(zip(groups, table[budget][1])))
    return [(g, t) for g, t in best[1] if t >= 0]


def as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(fp, comp, part, bits, probe): each fingerprint once in the index of each part, and with all patterns within its threshold as a probe."""
    rows = []
    for i, (bits, t) in enumerate(parts):
        whole = as_signed(sum(1 << b for b in bits))
        flips = [as_signed(sum(1 << b for b in c)) for r in range(t + 1) for c in itertools.combinations(bits, r)]
        own = ", ".join(f"{x}L" if x > -(1 << 63) else "cast(-9223372036854775808 AS bigint)" for x in flips)
        rows.append(F.array(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(whole)).alias("bits"), F.lit(False).alias("probe"))))
        rows.append(F.expr(f"transform(array({own}), m -> struct({i} AS part, (fp & {whole}L) ^ m AS bits, true AS probe))"))
    return nodes.select("fp", "comp", F.inline(F.concat(*rows)))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between fingerprints, distance or fewer bits apart, that leave the components of all such links.

    fps has each fingerprint once, in a stored table. Each part of a plan indexes its bits and is
    probed with all patterns within its threshold; candidates are verified by their whole
    distance. Not all links are made, for in a neighbourhood of n fingerprints they are n * n.
    Where buckets have many candidates, each probe is first tested with LEADERS members of the
    bucket, and what links is one component from then on; candidates within a component are no
    more formed. Rounds go on while they help. All candidates of different components are then
    verified, so no two components stay apart that any link joins.
    """
    n = fps.count()
    if not n:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    parts = plan(bit_products(fps), n, distance)
    nodes, found, last = fps.select("fp", F.col("fp").alias("comp")), None, float("inf")
    key = ["part", "bits"]
    near_by = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance
    for star in itertools.count():
        rows = buckets(nodes, parts)
        size = [F.count(F.when(~F.col("probe"), 1)).alias("i"), F.count(F.when(F.col("probe"), 1)).alias("p")]
        if found is None:  # each is its own component
            each = rows.groupBy(*key).agg(*size).select(*key, (F.col("i") * F.col("p") - F.col("i")).alias("apart"))
        else:
            each = rows.groupBy(*key, "comp").agg(*size).groupBy(*key).agg(
                (F.sum("i") * F.sum("p") - F.sum(F.col("i") * F.col("p"))).alias("apart"), F.max_by("comp", F.col("i") + F.col("p")).alias("major"))
        heavy = stash(each.where(F.col("apart") > HEAVY))
        most = heavy.agg(F.sum("apart")).first()[0] or 0
        if most <= CANDIDATES * n or most > 0.75 * last:
            break
        last = most
        of_heavy = rows.join(heavy.select(*key), key)
        order = [F.min(F.struct(F.xxhash64("fp", F.lit(star), F.lit(j)).alias("o"), "fp", "comp")).alias(f"l{j}") for j in range(LEADERS)]
        leaders = stash(of_heavy.where("NOT probe").groupBy(*key).agg(*order).select(*key, F.array(*[F.struct(f"l{j}.fp", f"l{j}.comp") for j in range(LEADERS)]).alias("leaders")))
        own = F.filter("leaders", lambda x: (x["comp"] != F.col("comp")) & near_by(x["fp"], F.col("fp")))
        new = of_heavy.where("probe").join(leaders, key).select("fp", F.explode(F.array_distinct(F.transform(own, lambda x: x["fp"]))).alias("b"))
        new = new.select(F.col("fp").alias("a"), "b")
        found = stash(forest(new if found is None else found.union(new)))
        names = components(found)
        nodes = stash(fps.join(names, fps["fp"] == names["node"], "left").select("fp", F.coalesce("least", "fp").alias("comp")))
    x, y = (rows.where(side).drop("probe") for side in ("NOT probe", "probe"))
    if most and found is not None:
        # in heavy buckets the members of the largest component are not set against each other
        major = heavy.select(*key, "major")
        side = lambda many, few: F.when(F.col("major").isNull(), F.array(F.lit(0))).when(F.col("comp") == F.col("major"), F.array(*map(F.lit, many))).otherwise(F.array(*map(F.lit, few)))
        x = x.join(major, key, "left").withColumn("side", F.explode(side([1], [2, 3]))).drop("major")
        y = y.join(major, key, "left").withColumn("side", F.explode(side([3], [1, 2]))).drop("major")
        key = [*key, "side"]
    x, y = x.withColumnsRenamed({"fp": "a", "comp": "comp_a"}), y.withColumnsRenamed({"fp": "b", "comp": "comp_b"})
    rest = x.join(y, key).where((F.col("comp_a") != F.col("comp_b")) & near_by(F.col("a"), F.col("b"))).select("a", "b")
    if all(t == 0 for _, t in parts):
        rest = rest.where("a < b")  # both ways are there
    rest = forest(rest)
    return stash(rest if found is None else found.union(rest))


def forest(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes, without those that close a ring within a part of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = top(x), top(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    a.append(x)
                    b.append(y)
            if len(up) > 1 << 20:
                up.clear()  # memory stays bounded; a few more edges pass
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """(a, b), a > b: each node with the least that it reaches over the edges of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def flat() -> pa.RecordBatch:
            own = [(x, top(x)) for x in list(up)]
            own = [(x, y) for x, y in own if x != y]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = top(x), top(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
            if len(up) > 4 * EDGES:  # memory stays bounded; what is known so far goes on as edges
                yield flat()
                up.clear()
        yield flat()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, least node that it reaches) for each node of an edge: within tasks first, then by large and small stars.

    Tasks of EDGES edges in the mean join what they hold. While more than EDGES are left, rounds
    join each node's neighbours to the least of them, until the edges no longer change, which
    they do within some log(n) squared rounds; as soon as no more than EDGES are left, one task
    ends it. Each round's edges are a table in the shared folder, and so are the least neighbours
    of nodes that have larger ones: the centres of stars, few as a rule, so that no join needs a
    hot centre's edges in one task.
    """
    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(r)

    edges = stash(edges.select("a", "b").where("a <> b"))
    now, seen = mark(edges), None
    if now[0] > EDGES:  # few rounds are left after this, and a > b for all edges
        edges = stash(stars(edges.repartition(-(-now[0] // EDGES))).distinct())
        now = mark(edges)
    while now[0] > EDGES and now != seen:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        centres = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max("b").alias("top")).where("top > a").drop("top"))
        large = both.where("b > a").join(centres, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = stash(small.where("a <> b").distinct())
        now, seen = mark(edges), now
    if now[0] <= EDGES:
        edges = stash(stars(edges.repartition(1)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).union(edges.select(F.col("b"), F.col("b")).distinct())


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(key, fp long, component_id): component_id is the least key that is reached over links.

    Fingerprints link at distance or fewer differing bits. Rows of one fingerprint are
    collapsed first, so copies cost one entry, and links are found between fingerprints;
    ties go to the least key. Null or empty text has fingerprint zero and is linked like any
    other. Null keys take part; their component_id is the least key that is not null, null if
    there is none. Repeated rows are returned as often as they stand. An empty table gives an
    empty result. Other columns are not returned, whatever their names. A text's words are held
    whole while its shingles are hashed, some 100 bytes a word.
    """
    fps = stash(fingerprints(docs, key, text, n))
    own = stash(fps.groupBy("fp").agg(F.min("key").alias("least_key")))
    if own.isEmpty():
        return fps.select("key", "fp", F.col("key").alias("component_id"))
    labels = components(links(own.select("fp"), distance))
    named = stash(own.join(labels, own["fp"] == labels["node"], "left").select("fp", "least_key", F.coalesce("least", "fp").alias("least")))
    # stored, so that the joins deal their sides anew and a component or fingerprint of many rows can be split
    first = stash(named.groupBy("least").agg(F.min("least_key").alias("component_id")))
    named = stash(named.join(first, "least").select("fp", "component_id"))
    return fps.join(named, "fp").select("key", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
