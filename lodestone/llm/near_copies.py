"""Near copies by exact Jaccard similarity of word shingles: SimHash finds most, a join of sets the rest.

Fingerprints of the shingle sets that SimHash links are verified by the sets themselves. At a
similarity of 0.8 some ten of 64 bits differ, which no bearable radius reaches; what is still
apart is therefore joined by shingles, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, hash_pair, quoted, stash, text_of
from .simhash import BITS, components, forest, links

#: Similarity is held as a fraction, so that the test is one of whole numbers.
WORDS, SIMILARITY, SEED = 5, (4, 5), 42
#: Shingles are ordered by counts in so many cells, which go to the executors (8 MB); tables of cells are summed in slices.
CELLS, SLICE = 1 << 21, 1 << 10
#: Whole sets go on in batches of so many shingles (8 MB) and one set.
SETS = 1 << 20
#: If the lists of over LIST pairs have over PAIRS pairs for each unit, they are first joined by their leaders, so often at most.
LIST, PAIRS, STARS = 500, 20, 8
#: Bits of a set's sketch; shingles before one's own by which a pair is known to have met there already.
SKETCH, BEFORE = 512, 4
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(64)], np.uint64)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The set of the text's n-word shingles as sorted 64-bit hashes; a text of fewer words is one shingle."""
    words, h = (text or "").encode().translate(_LOWER).split(), xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([h(b" ".join(words), SEED)], np.uint64).view(np.int64)
    w = np.array([h(x, SEED) for x in words], np.uint64)
    size = len(w) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out += w[i : i + size] * _ODD[i]
    out ^= out >> np.uint64(32)
    out *= _ODD[63]
    return np.unique(out.view(np.int64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; as a signed number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):  # sums of bytes that fit a byte are fast
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Bit i is 1 if an odd number of the hashes falls to it: two sets differ in as many shingles, at least, as their sketches do in bits."""
    odd = np.bincount((hashes.view(np.uint64) // np.uint64((1 << 64) // SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) // np.uint64((1 << 64) // CELLS)).astype(np.int64)


def counts(docs: DataFrame, n: int = WORDS) -> np.ndarray:
    """By cell in how many documents its shingles stand, over all documents: no shingle stands in more of them than its cell says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [shingles(t.as_py(), n) for t in b.column(0).slice(at, 500)]
                total += np.bincount(cell(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
        slices = np.flatnonzero(total.reshape(-1, SLICE).any(axis=1))
        for at in range(0, len(slices), 500):
            part = slices[at : at + 500]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in part], pa.binary())], names=["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                total[i] = total.get(i, 0) + np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "cells"])

    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("cells", T.BinaryType())])
    rows = docs.select("text").mapInArrow(run, schema).repartition("slice").mapInArrow(add, schema).toArrow()
    out = np.zeros((CELLS // SLICE, SLICE), np.uint32)
    for i, x in zip(rows.column("slice").to_pylist(), rows.column("cells")):
        out[i] = np.frombuffer(x.as_buffer(), np.uint32)
    return out.ravel()


def signatures(docs: DataFrame, often: np.ndarray, n: int = WORDS) -> DataFrame:
    """(h1, h2, unit, size, fp, sketch, prefix): unit is a hash of the set, fp its SimHash, prefix its first shingles in the common order.

    Sets of x and y that are similar enough have x's size times the similarity in common, so
    they share one of x's first size - ceil(size * similarity) + 1 shingles in any order that
    is the same for all. Those of rare cells come first; the order bears on the cost alone.
    """
    p, q = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500)):
            units, sizes, fps, sketches, prefixes = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), n)
                units.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                fps.append(fingerprint_of(s))
                sketches.append(sketch(s))
                s = s[np.argsort(often[cell(s)], kind="stable")]
                prefixes.append(s[: len(s) - -(-len(s) * p // q) + 1].copy())  # not the whole set
            flat = [np.arange(len(sketches) + 1) * (SKETCH // 64), np.cumsum([0, *map(len, prefixes)])]
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts))) for at, parts in zip(flat, (sketches, prefixes))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(units, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                                              pa.array(fps, pa.int64()), *lists], names=["h1", "h2", "unit", "size", "fp", "sketch", "prefix"])

    return docs.select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, unit long, size long, fp long, sketch array<long>, prefix array<long>")


def similar(pairs: DataFrame, docs: DataFrame, members: DataFrame, n: int = WORDS) -> DataFrame:
    """Those of the pairs (a, b) of units whose sets are similar enough: each set is made anew from a text.

    Pairs are tested row by row, as a batch of rows with two whole sets each has no bound of its memory.
    """
    p, q = SIMILARITY

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, at, size = [], 0, 0
            for i, t in enumerate(b.column(1), 1):
                made.append(shingles(t.as_py(), n))
                size += len(made[-1])
                if size >= SETS or i == b.num_rows:
                    ends = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, i - at), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))], names=["unit", "set"])
                    made, at, size = [], i, 0

    units = pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    first = members.join(units, "unit", "left_semi").groupBy("unit").agg(F.min(F.struct("h1", "h2")).alias("h")).select("unit", "h.h1", "h.h2")
    made = stash(docs.join(first, ["h1", "h2"]).select("unit", "text").mapInArrow(sets, "unit long, set array<long>"))
    x, y = made.select(F.col("unit").alias("a"), F.col("set").alias("x")), made.select(F.col("unit").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(both * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(h1, h2, component): rows of one component are joined by links of Jaccard similarity 0.8 or more of n-word shingles.

    h1 and h2 are hash_pair of key and text; rows equal in both are returned once. All links
    count, none is missed: candidates share a shingle of their prefixes, and each is tested by
    its whole sets. Texts of one set are one entry (unit). Where groups would have many pairs,
    rounds test each unit with only one leader and join what is similar; at the end all
    pairs of units that are still apart are tested, so the rounds save work and drop no link.
    Null or empty texts are one group. An empty table gives an empty result.
    """
    p, q = SIMILARITY
    own = text_of(docs, text)
    h1, h2 = hash_pair(docs[quoted(key)], own)
    docs = docs.select(h1.alias("h1"), h2.alias("h2"), own.alias("text"))
    signed = stash(signatures(docs, counts(docs, n), n).dropDuplicates(["h1", "h2"]))
    members = signed.select("h1", "h2", "unit")
    units = stash(signed.groupBy("unit").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")))
    n_units = units.count()
    edges, names = None, None
    # links of fingerprints, from one unit of each; the others of a fingerprint are tested with that one
    one = stash(units.groupBy("fp").agg(F.min("unit").alias("first")))
    near = links(one.select("fp"))
    of = lambda side: one.select(F.col("fp").alias(side), F.col("first").alias(f"u{side}"))
    pairs = near.join(of("a"), "a").join(of("b"), "b").select("ua", "ub").union(units.join(one, "fp").where("unit <> first").select("unit", "first"))
    pairs = stash(pairs.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    if not pairs.isEmpty():
        found = stash(forest(similar(pairs, docs, members, n)))
        if not found.isEmpty():
            edges, names = found, stash(components(found))
    each = F.transform("prefix", lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.get("prefix", i - 1).alias("before")))
    postings = units.select("unit", "size", F.inline(each))
    # a shingle that has the same one before it in all its sets is the first that two sets share for none of them
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count("before").alias("behind"), F.min("before").alias("lo"), F.max("before").alias("hi"))
    shared = shared.where("n > 1 AND NOT (behind = n AND lo = hi)").select("token")
    lists = stash(postings.drop("before").join(shared, "token"))
    last = float("inf")
    for star in range(STARS + 1):
        if names is not None:
            lists_now = lists.join(names, lists["unit"] == names["node"], "left").select("token", "unit", "size", "pos", F.coalesce("least", "unit").alias("part"))
        else:
            lists_now = lists.withColumn("part", F.col("unit"))
        by_part = lists_now.groupBy("token", "part").agg(F.count(F.lit(1)).alias("n"))
        apart = by_part.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        apart = stash(apart.select("token", ((F.col("n") * F.col("n") - F.col("within")) / 2).alias("pairs")))
        most = apart.where(F.col("pairs") > LIST).agg(F.sum("pairs")).first()[0] or 0
        now = stash(lists_now.join(apart, "token"))
        if most <= PAIRS * n_units or star == STARS or most > last / 2:
            break
        last = most
        # each unit with the leader of most of its lists
        order = F.struct(F.xxhash64("unit", F.lit(star)).alias("o"), "unit", "size", "part")
        large = now.where(F.col("pairs") > LIST)
        leaders = large.groupBy("token").agg(F.min(order).alias("l"))
        met = large.join(leaders, "token").where("part <> l.part").groupBy("unit", F.col("l.unit").alias("leader"), "size", F.col("l.size").alias("other")).agg(F.count(F.lit(1)).alias("c"))
        met = met.where(F.least("size", "other") * q >= F.greatest("size", "other") * p)
        best = met.groupBy("unit").agg(F.max(F.struct("c", "leader")).alias("m"))
        pairs = stash(best.select(F.least("unit", "m.leader").alias("a"), F.greatest("unit", "m.leader").alias("b")).distinct())
        found = stash(similar(pairs, docs, members, n))
        if found.isEmpty():
            break
        edges = found if edges is None else stash(forest(edges.union(found)))
        names = stash(components(edges))
    # all pairs of units that are still apart. Similar sets have p / (p + q) of their sizes in common, and all of it stands at or
    # behind the first shingle that they share: neither may be past the place that leaves so much. For the smaller set, x, that
    # is within the first (q - p) / (p + q) of its shingles, so that others are not even paired. Nor are those whose sketches differ
    # in more bits than similar sets do in shingles, which are (q - p) / (p + q) of their sizes at most.
    # A pair whose sets have one of the shingles just before in common is met there.
    by_unit = Window.partitionBy("unit").orderBy("pos")
    before = F.array(*[F.lag("token", i + 1).over(by_unit) for i in range(BEFORE)])
    now = stash(now.join(units.select("unit", "sketch"), "unit").withColumn("before", before))
    x, y = (now.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "size", "pos", "part", "sketch", "before")]) for s in "xy")
    x = x.where(F.col("pos_x") * (p + q) <= F.col("size_x") * (q - p))
    smaller = F.struct("size_x", "unit_x") < F.struct("size_y", "unit_y")
    common = F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))
    differ = sum((F.bit_count(F.col("sketch_x")[i].bitwiseXOR(F.col("sketch_y")[i])) for i in range(SKETCH // 64)), F.lit(0))
    both = F.col("size_x") + F.col("size_y")
    can_be = (common * (p + q) >= both * p) & (differ * (p + q) <= both * (q - p)) & ~F.coalesce(F.arrays_overlap("before_x", "before_y"), F.lit(False))
    pairs = x.join(y, "token").where(smaller & (F.col("part_x") != F.col("part_y")) & can_be)
    pairs = stash(pairs.select(F.col("unit_x").alias("a"), F.col("unit_y").alias("b")).distinct())
    # c shingles of the prefixes and what follows them are all they can share
    of = lambda s: units.select(F.col("unit").alias(s), F.col("size").alias(f"size_{s}"), F.col("prefix").alias(f"prefix_{s}"))
    rest = F.size(F.array_intersect("prefix_a", "prefix_b")) + F.ceil(F.greatest("size_a", "size_b") * p / q) - 1
    pairs = stash(pairs.join(of("a"), "a").join(of("b"), "b").where(rest * (p + q) >= (F.col("size_a") + F.col("size_b")) * p).select("a", "b"))
    found = stash(forest(similar(pairs, docs, members, n)))
    names = stash(components(found if edges is None else edges.union(found)))
    return members.join(names, members["unit"] == names["node"], "left").select("h1", "h2", F.coalesce("least", "unit").alias("component"))
