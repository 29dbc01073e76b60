"""Sharding over fixed virtual slots, with a versioned map from slots to shards."""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, exists, load, quoted, restored, shared_dir, stash, text_of

SLOTS = 16_384
#: A slot with more bytes or rows than this part of a shard's mean is hot, and dealt over so many slots of its own.
HOT, SALTS = 0.125, 64


def slot_of(n_slots: int, key: Column, ident: Column) -> Column:
    """The virtual slot of a row, by hash of its key and a hash of its text."""
    return F.pmod(F.xxhash64(key, ident), F.lit(n_slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes, none for null, and 16 for the record."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 16).cast("long")


MAP = "version int, n_shards int, shards string, moved string, hot string"


@dataclass
class SlotMap:
    """Which shard has each slot. An edit makes a new version and moves as few slots as it can.

    hot: slots whose rows are dealt over SALTS slots each, which follow the others in this order.
    """

    shards: list[int]
    n_shards: int
    version: int = 1
    moved: dict[int, int] = field(default_factory=dict)
    hot: list[int] = field(default_factory=list)

    @classmethod
    def balanced(cls, sizes: list[int], n_shards: int, hot: list[int] = ()) -> SlotMap:
        """Largest slot first to the shard with the fewest bytes; ties go by number."""
        heap, shards = [(0, s) for s in range(n_shards)], [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            n, s = heapq.heappop(heap)
            shards[slot] = s
            heapq.heappush(heap, (n + sizes[slot], s))
        return cls(shards, n_shards, hot=list(hot))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, s in enumerate(self.shards):
            out[s] += sizes[slot]
        return out

    def _edit(self, moved: dict[int, int], n_shards: int) -> SlotMap:
        shards = list(self.shards)
        for slot, s in moved.items():
            shards[slot] = s
        return SlotMap(shards, n_shards, self.version + 1, moved, self.hot)

    def covering(self, hot: list[int]) -> SlotMap:
        """With slots of their own for more hot slots; they begin in the hot slot's shard."""
        new = [v for v in hot if v not in self.hot]
        if not new:
            return self
        shards = self.shards + [self.shards[v] for v in new for _ in range(SALTS)]
        return SlotMap(shards, self.n_shards, self.version + 1, {}, self.hot + new)

    def rebalanced(self, sizes: list[int], slack: float = 0.01) -> SlotMap:
        """Slots move from the fullest shard to the emptiest while that brings the two nearer; the same map if none does."""
        by: list[list[int]] = [[] for _ in range(self.n_shards)]
        for slot, s in enumerate(self.shards):
            by[s].append(slot)
        load, moved, mean = self.loads(sizes), {}, sum(sizes) / self.n_shards
        for _ in range(len(sizes)):
            top, low = max(range(self.n_shards), key=lambda s: (load[s], -s)), min(range(self.n_shards), key=lambda s: (load[s], s))
            gap = load[top] - load[low]
            fit = [x for x in by[top] if 0 < sizes[x] < gap]
            if load[top] <= mean * (1 + slack) or not fit:
                break
            slot = min(fit, key=lambda x: (abs(gap / 2 - sizes[x]), x))
            by[top].remove(slot)
            by[low].append(slot)
            load[top] -= sizes[slot]
            load[low] += sizes[slot]
            moved[slot] = low
        return self._edit(moved, self.n_shards) if moved else self

    def grown(self, sizes: list[int]) -> SlotMap:
        """One more shard, which takes slots into itself; no slot moves between the others."""
        load, new, mean, moved = self.loads(sizes), self.n_shards, sum(sizes) / (self.n_shards + 1), {}
        got = 0
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            s = self.shards[slot]
            if sizes[slot] and load[s] - sizes[slot] >= mean * 0.999 and got + sizes[slot] <= mean * 1.001:
                moved[slot] = new
                got += sizes[slot]
                load[s] -= sizes[slot]
        return self._edit(moved, new + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        """A version is one small row of a table; earlier ones stay."""
        row = (self.version, self.n_shards, json.dumps(self.shards), json.dumps({str(k): v for k, v in self.moved.items()}), json.dumps(self.hot))
        spark.createDataFrame([row], MAP).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The latest version, or the one named; None where there is none."""
        if not exists(spark, path):
            return None
        rows = spark.read.schema(MAP).parquet(path).where(F.lit(True) if version is None else F.col("version") == version)
        r = rows.orderBy(F.col("version").desc()).first()
        return r and cls(json.loads(r.shards), r.n_shards, r.version, {int(k): v for k, v in json.loads(r.moved).items()}, json.loads(r.hot))


def slot_stats(slotted: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot. n_slots rows at most reach the driver, however large the input is."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r.vslot], rows[r.vslot] = r.b, r.n
    return sizes, rows


def hot_slots(sizes: list[int], rows: list[int], n_shards: int) -> list[int]:
    """There are fewer than 2 * n_shards / HOT of them."""
    by, n = HOT * sum(sizes) / n_shards, HOT * sum(rows) / n_shards
    return [v for v in range(len(sizes)) if rows[v] > 1 and (sizes[v] > by or rows[v] > n)]


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, slots: SlotMap | None = None, key: str = "doc_id",
          text: str = "text", size: Column | None = None, ident: Column | None = None, maps: str | None = None) -> DataFrame:
    """docs with `vslot`, `shard`, `slot` (the row's place in its shard, from 0, gapless) and `map_version`.

    Rows hash to virtual slots; bytes are summed by slot; the slots go to shards so that bytes
    are near equal. maps is a folder of stored maps: the latest is read and edited, as little as
    it takes, where shards are no longer near equal, and each new version is stored there;
    without one yet, a first is made and stored. slots is a map to use as it is. A row's place
    is its rank in its virtual slot, ordered by key and text hash, after the rows of the shard's
    slots before it; a task thus sorts one slot at a time, never a whole shard. size and ident,
    by default the text's bytes plus 16 and a hash of the text, may be columns computed before,
    so that texts stay out of the shuffle.

    Rows equal in key and text are alike in everything but their places, and share a virtual
    slot. Where these make a slot hot (say many rows without a key and a text) its rows are
    dealt over SALTS slots by where they stand in a stored copy. Null keys and texts hash like
    values of their own. Empty tables give empty results. Other columns pass through whatever
    their names; those with the names of new ones are replaced. Texts are hashed only, so long
    ones bear on nothing but bytes: a shard has one row at least, so a text larger than a
    shard's share makes its shard larger.
    """
    new = ("vslot", "shard", "slot", "map_version")
    spark = docs.sparkSession
    size = record_size(docs[quoted(text)]) if size is None else size
    ident = F.xxhash64(text_of(docs, text)) if ident is None else ident
    names = [c for c in docs.columns if c.lower() not in new]
    named = docs.select(carried(docs, names).alias("row"), docs[quoted(key)].alias("key"), size.alias("size"), ident.alias("ident"))
    named = named.withColumn("vslot", slot_of(n_slots, F.col("key"), F.col("ident")))
    sizes, rows = slot_stats(named, n_slots)
    known = slots or (SlotMap.read(spark, maps) if maps else None)
    hot = list(known.hot) if known else []
    if not slots:
        hot += [v for v in hot_slots(sizes, rows, n_shards) if v not in hot]
    if hot:
        named = stash(named)
        base = spark.createDataFrame([(v, n_slots + i * SALTS) for i, v in enumerate(hot)], "hot_slot int, first int")
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        named = named.withColumn("salt", salt).join(F.broadcast(base), F.col("vslot") == F.col("hot_slot"), "left")
        named = named.withColumn("vslot", F.coalesce(F.col("first") + F.col("salt"), "vslot")).drop("salt", "hot_slot", "first")
        sizes, rows = slot_stats(named, n_slots + len(hot) * SALTS)
    if slots is None:
        slots = known.covering(hot).rebalanced(sizes) if known else SlotMap.balanced(sizes, n_shards, hot)
        if maps and slots is not known:
            slots.save(spark, maps)
    before, seen = [0] * len(sizes), [0] * slots.n_shards
    for v, s in enumerate(slots.shards):
        before[v] = seen[s]
        seen[s] += rows[v]
    # a row for each slot, a bound of the operator's own
    places = spark.createDataFrame(list(zip(range(len(sizes)), slots.shards, before)), "vslot int, shard int, before long")
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("key", "ident")).cast("long")
    return named.select("row", "vslot", rank.alias("rank")).join(F.broadcast(places), "vslot").select(
        *restored(names), "vslot", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(slots.version).alias("map_version"))


def digest(docs: DataFrame, n_shards: int = 40, n_slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """A sharding by the law `bytes`, as sizes and checksums in place of the texts."""
    text = text_of(docs)
    small = docs.select("doc_id", record_size(docs["text"]).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    return shard(small, n_shards, n_slots, size=small["size"], ident=small["text_hash"], maps=maps).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def stored_maps(spark: SparkSession, of: str, n_shards: int) -> str:
    """Where the maps of a table stand in the shared folder."""
    return f"{shared_dir(spark)}/lodestone-slot-maps/{hashlib.md5(of.encode()).hexdigest()}-{n_shards}"


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(load(spark, sf_dir, "documents").select("doc_id", "text"), maps=stored_maps(spark, f"{sf_dir}/documents", 40))
