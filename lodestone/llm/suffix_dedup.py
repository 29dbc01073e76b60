"""Suffix-array dedup: bytes of long strings that occur twice are found with run-length indexes.

One Burrows-Wheeler transform of a corpus can't be built in parts that never meet, and an index
for each part would have to be asked by every other part. So texts are first cut where equal
long strings are cut alike: of each window of byte strings the one of least hash is an anchor.
Anchors whose string occurs once can't lie in a repeat. The surroundings (contexts) of the rest
meet by anchor, and an index of the contexts that meet marks the long matches among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, hash_pair, load, restored, stash, text_of

SPAN = 200
#: Bytes of an anchor. SPAN - GRAM + 1 neighbours compete for the least hash, so each string of SPAN bytes holds an anchor.
GRAM = 32
#: Contexts of one anchor string that are indexed together; larger groups are divided first.
GROUP = 20_000
#: An index is full with so many contexts.
INDEXED = 4_000
#: Parts of a large group's windows, by where the anchor stands in them; the windows of a part share the bytes in the middle.
PARTS = 8
#: A key with more than this part of all rows is heavy; there are fewer than 1 / HEAVY such keys, so they are broadcast.
HEAVY = 0.001
#: Tasks over which the rows of a heavy key are dealt.
SALTS = 64
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 22

_B = np.uint64(0xC6A4A7935BD1E995 | 1)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + 2 * SPAN, _B, np.uint64)]), dtype=np.uint64)
_BACK = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + 2 * SPAN, np.uint64(pow(int(_B), -1, 1 << 64)), np.uint64)]), dtype=np.uint64)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=sums[1:])
    x = (sums[k:] - sums[:-k]) * _BACK[:n]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill) -> np.ndarray:
    """op over each w neighbours, in time that doesn't depend on w."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    y = np.full(blocks * w, fill, x.dtype)
    y[: len(x)] = x
    y = y.reshape(blocks, w)
    left = op.accumulate(y, axis=1).ravel()
    right = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors: k-byte strings that are the least of some span bytes, ties included.

    Long texts go in chunks that overlap by a span, so that each window is seen whole.
    """
    w = span - k + 1
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes, last = [], [], -1
    for at in range(0, len(data) - span + 1, CHUNK):
        h = gram_hashes(data[at : at + CHUNK + span - 1], k)
        least = _slide(h, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
        padded[w - 1 : w - 1 + len(least)] = least
        kept = np.flatnonzero(_slide(padded, w, np.maximum, np.uint64(0)) == h)
        new = kept[kept + at > last]
        places.append(new + at)
        hashes.append(h[new])
        if len(new):
            last = int(new[-1]) + at
    # a chunk's last anchors may be anchors only by windows of the next chunk, which lists them itself
    return np.concatenate(places), np.concatenate(hashes)


def bounds(at: int, size: int) -> tuple[int, int]:
    """The context of an anchor: all windows that hold it."""
    return max(0, at - (SPAN - GRAM)), min(size, at + SPAN)


class RunIndex:
    """A run-length index of groups of contexts: a positional Burrows-Wheeler transform.

    Contexts stand under each other with their anchors in line. At each column the rows of a
    group are ordered by what stands before it, read backwards, so the symbols of the column,
    read in that order, are the transform's and fall into runs. `since` is where the match of a
    row with the one before it in the order begins, its matching statistic. A row that goes on in
    the run of its predecessor keeps it; only at the heads of runs is it sought among the rows
    between. Where a match has SPAN bytes, a window of both rows is repeated.

    Rows of one group differ, and only equal places are compared, so a text never matches itself
    where two of its contexts overlap.
    """

    def __init__(self, contexts: list[bytes], anchors: list[int], groups: list[int]):
        n, self.width = len(contexts), 2 * SPAN - GRAM
        grid = np.zeros((n, self.width), np.uint16)  # 0: the text has ended or not begun
        for at in range(0, n, 1_000):
            part = contexts[at : at + 1_000]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            flat = np.frombuffer(b"".join(part), np.uint8)
            shift = np.cumsum(sizes) - sizes - (SPAN - GRAM - np.array(anchors[at : at + 1_000], np.int64))
            grid[np.repeat(np.arange(at, at + len(part)), sizes), np.arange(len(flat)) - np.repeat(shift, sizes)] = flat.astype(np.uint16) + 1
        self.columns = np.ascontiguousarray(grid.T)
        self.groups = np.array(groups, np.int64) * 512
        self.n_runs = 0

    def matches(self, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, lo, hi): of each row with repeated windows where the first begins and the last ends, from the anchor.

        Windows hold the anchor, so those of one row overlap and cover all that lies between.
        """
        n = len(self.groups)
        order, since = np.arange(n), np.zeros(n + 1, np.int64)
        lo, hi = np.full(n, -1), np.full(n, -1)
        for j in range(self.width):
            key = self.groups[order] + self.columns[j][order]
            falls = key[1:] < key[:-1]
            if falls.any():
                by = np.argsort(key, kind="stable")
                key = key[by]
                p, q = by[:-1], by[1:]
                new = since[q]
                jumps = np.flatnonzero((q != p + 1) & (key[1:] == key[:-1]))
                if len(jumps):  # heads of runs: the least match among the rows between
                    ends = np.empty(2 * len(jumps), np.int64)
                    ends[::2], ends[1::2] = p[jumps] + 1, q[jumps] + 1
                    new[jumps] = np.maximum.reduceat(since, ends)[::2]
                    self.n_runs += len(jumps)
                order = order[by]
                since[1:n] = new
            cut = (key[1:] != key[:-1]) | ((key[1:] & 511) == 0)
            since[1:n][cut] = j + 1
            w = j + 1 - span
            if w >= 0:
                long = np.flatnonzero(since[1:n] <= w)
                if len(long):
                    rows = np.concatenate([order[long], order[long + 1]])
                    lo[rows] = np.where(lo[rows] < 0, w, lo[rows])
                    hi[rows] = w + span
        found = np.flatnonzero(lo >= 0)
        return found, lo[found] - (SPAN - GRAM), hi[found] - (SPAN - GRAM)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _anchor_rows(only_hash: bool):
    """(t1, t2, doc key, text) -> anchors of each text, with a hash of their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, at_all, ah, ctx, n = [], [], [], [], 0
            for row, text in enumerate(b.column(2)):
                data = text.as_buffer()
                if data is None or data.size < SPAN:
                    continue
                places, hashes = anchors(np.frombuffer(data, np.uint8))
                ah.append(hashes)
                n += len(places)
                if not only_hash:
                    raw, size = data.to_pybytes(), data.size
                    of.append(np.full(len(places), row))
                    at_all.append(places)
                    ctx += [xxhash.xxh64_intdigest(raw[max(0, p - (SPAN - GRAM)) : p + SPAN], min(p, SPAN - GRAM)) >> 1 for p in places.tolist()]
                if n > 1 << 17:
                    yield _anchor_batch(b, of, at_all, ah, ctx, only_hash)
                    of, at_all, ah, ctx, n = [], [], [], [], 0
            if ah:
                yield _anchor_batch(b, of, at_all, ah, ctx, only_hash)

    return run


def _anchor_batch(b, of, at_all, ah, ctx, only_hash: bool) -> pa.RecordBatch:
    h = pa.array(np.concatenate(ah).astype(np.int64))
    if only_hash:
        return pa.RecordBatch.from_arrays([h], names=["ah"])
    rows = pa.array(np.concatenate(of))
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(at_all)), h, pa.array(ctx, pa.int64())],
        names=["t1", "t2", "at", "ah", "c"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, [(at, ah, c)]) -> (ah, c, bytes, place of the anchor in them)."""
    for b in batches:
        for text, wanted in zip(b.column(0), b.column(1)):
            raw = text.as_py().encode() if isinstance(text.as_py(), str) else text.as_py()
            rows = wanted.as_py()
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                spans = [bounds(r["at"], len(raw)) for r in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["ah"] for r in part], pa.int64()), pa.array([r["c"] for r in part], pa.int64()),
                     pa.array([raw[x:y] for x, y in spans], pa.binary()), pa.array([r["at"] - x for r, (x, y) in zip(part, spans)], pa.int32())],
                    names=["ah", "c", "bytes", "anchor"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, ah, c, bytes, anchor) in the order of the group -> spans of contexts, from their anchors.

    Whole groups are gathered until an index is full.
    """
    held: list[tuple] = []
    last = None
    for b in batches:
        for g, ah, c, raw, anchor in zip(*(col.to_pylist() for col in b.columns)):
            if g != last:
                if len(held) >= INDEXED:
                    yield _marked(held)
                    held = []
                last = g
            held.append((ah, c, raw, anchor, g))
    if held:
        yield _marked(held)


def _marked(rows: list[tuple]) -> pa.RecordBatch:
    groups = np.cumsum([0, *(a[4] != b[4] for a, b in zip(rows, rows[1:]))]).tolist()
    found, lo, hi = RunIndex([r[2] for r in rows], [r[3] for r in rows], groups).matches(SPAN)
    of = found.tolist()
    return pa.RecordBatch.from_arrays(
        [pa.array([rows[i][0] for i in of], pa.int64()), pa.array([rows[i][1] for i in of], pa.int64()), pa.array(lo), pa.array(hi)], names=["ah", "c", "lo", "hi"])


def part_edges(parts: int) -> list[tuple[int, int]]:
    """Windows by how far before the anchor they start: the first and last of each part."""
    n = SPAN - GRAM + 1
    return [(n * i // parts, n * (i + 1) // parts - 1) for i in range(parts)]


def _windows(raw_size: int, anchor: int, lo: int, hi: int) -> tuple[int, int]:
    """Of a part's windows the first and last that lie in the context; the first is over the last if none does."""
    return max(lo, anchor + SPAN - raw_size), min(hi, anchor)


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, c, bytes, anchor) -> for each part of the windows (group, span, ah, c, part).

    group: a hash of the anchor, the part and the bytes that all windows of the part share;
    span: a hash of the bytes that any of them has.
    """
    h = xxhash.xxh64_intdigest
    for b in batches:
        out: list[tuple] = []
        for ah, c, raw, anchor in zip(*(col.to_pylist() for col in b.columns)):
            for p, (lo, hi) in enumerate(part_edges(PARTS)):
                first, last = _windows(len(raw), anchor, lo, hi)
                if first <= last:
                    core = h(raw[anchor - lo : anchor - hi + SPAN], p)
                    out.append((h(ah.to_bytes(8, "little") + core.to_bytes(8, "little"), p) >> 1, h(raw[anchor - last : anchor - first + SPAN], first * SPAN + last) >> 1, ah, c, p))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["g", "s", "ah", "c", "part"])


def _cut_to_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, s, part, bytes, anchor) -> contexts of a part: only the bytes that its windows have, named (g, s)."""
    for b in batches:
        raws, anchors_ = [], []
        for p, raw, anchor in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            first, last = _windows(len(raw), anchor, *part_edges(PARTS)[p])
            raws.append(raw[anchor - last : anchor - first + SPAN])
            anchors_.append(last)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raws, pa.binary()), pa.array(anchors_, pa.int32())], names=["ah", "c", "bytes", "anchor"])


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, c, bytes, anchor) -> (w1, w2, ah, c, lo): 128 bits of each window."""
    for b in batches:
        for at in range(0, len(b), 2_000):
            out = []
            for ah, c, raw, anchor in zip(*(col.to_pylist() for col in b.slice(at, 2_000).columns)):
                for i in range(len(raw) - SPAN + 1):
                    w = xxhash.xxh3_128_intdigest(raw[i : i + SPAN], anchor - i)
                    out.append((w >> 65, (w & ((1 << 64) - 1)) >> 1, ah, c, i - anchor))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["w1", "w2", "ah", "c", "lo"])


def _spans(contexts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ah, c, lo, hi): matches among contexts(ah, c, bytes, anchor) of one anchor string. sizes: (ah, k).

    Groups of GROUP contexts or fewer are indexed. In larger ones the windows are divided by
    where the anchor stands in them; contexts that have a part's bytes alike are one there,
    covered if they are two or more, and those that differ meet only where they share the
    middle. Where still more than GROUP do so, each window is counted by itself.
    """
    spans, context = "ah long, c long, lo long, hi long", "ah long, c long, bytes binary, anchor int"

    def index(df: DataFrame) -> DataFrame:
        return df.select(F.col("ah").alias("g"), "ah", "c", "bytes", "anchor").repartition("g").sortWithinPartitions("g", "ah", "c").mapInArrow(_index, spans)

    large = stash(sizes.where(F.col("k") > GROUP).select("ah"))
    if large.isEmpty():
        return index(contexts)
    out = index(contexts.join(large, "ah", "left_anti"))
    rest = contexts.join(large, "ah", "left_semi").select("ah", "c", "bytes", "anchor")
    members = stash(rest.mapInArrow(_divided, "g long, s long, ah long, c long, part long"))
    alike = stash(members.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ah", "c", "part")).alias("first")))
    count = stash(alike.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    differ = alike.join(count, "g").select("g", "s", "k", "first.ah", "first.c", "first.part")
    spelled = stash(differ.join(rest, ["ah", "c"]).select("g", "s", "part", "bytes", "anchor").mapInArrow(_cut_to_part, context))
    many = count.where(F.col("k") > GROUP).select(F.col("g").alias("ah"))
    found = index(spelled.join(many, "ah", "left_anti"))
    each = stash(spelled.join(many, "ah", "left_semi").select("ah", "c", "bytes", "anchor").mapInArrow(_each_window, "w1 long, w2 long, ah long, c long, lo long"))
    twice = each.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    found = found.union(each.join(twice, ["w1", "w2"], "left_semi").select("ah", "c", "lo", (F.col("lo") + SPAN).alias("hi")))
    edges = F.array(*[F.struct(F.lit(-hi).cast("long").alias("lo"), F.lit(SPAN - lo).cast("long").alias("hi")) for lo, hi in part_edges(PARTS)])
    covered = alike.where("n > 1").select("g", "s", F.col("first.part").alias("part")).select("g", "s", F.element_at(edges, (F.col("part") + 1).cast("int")).alias("e")).select(
        F.col("g").alias("ah"), F.col("s").alias("c"), "e.lo", "e.hi")
    both = found.union(covered).select(F.col("ah").alias("g"), F.col("c").alias("s"), "lo", "hi")
    return out.union(dealt_join(members, both, heavy(alike, "n", "g", "s"), ["ah", "c"]).select("ah", "c", "lo", "hi"))


def heavy(counts: DataFrame, n: str, *keys: str) -> DataFrame:
    """The heavy keys of counts, a stored table that has each key once with its rows n."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > HEAVY * total).select(*keys)


def dealt_join(left: DataFrame, right: DataFrame, hot: DataFrame, ident: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by the columns of hot; left's rows of those keys are dealt over SALTS tasks by ident.

    right's rows of hot keys are repeated for each of these tasks.
    """
    keys = hot.columns
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*ident), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(marked, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(marked, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t1, t2, spans): for each text with strings of SPAN bytes that occur twice, by its hash, where they are.

    The spans overlap and are not in order; they may reach over the text's ends.
    """
    a, b = hash_pair(text_of(docs, text))
    texts = docs.select(a.alias("t1"), b.alias("t2"), text_of(docs, text).alias("text"))
    twice = stash(texts.mapInArrow(_anchor_rows(True), "ah long").groupBy("ah").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    each = texts.mapInArrow(_anchor_rows(False), "t1 long, t2 long, at long, ah long, c long")
    # copies of a text come together here; n keeps their number
    named = dealt_join(each, twice.select("ah"), heavy(twice, "n", "ah"), ["t1", "t2", "at"], "left_semi")
    found = stash(named.groupBy("t1", "t2", "at", "ah", "c").agg(F.count(F.lit(1)).alias("n")))
    contexts = stash(found.groupBy("ah", "c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), F.min(F.struct("t1", "t2", "at")).alias("first")))
    sizes = stash(contexts.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    # contexts that differ need their bytes, from one text each
    differ = dealt_join(contexts, sizes.select("ah"), heavy(sizes, "k", "ah"), ["c"], "left_semi")
    wanted = differ.groupBy("first.t1", "first.t2").agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "ah", "c")).alias("wanted"))
    own = texts.dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]).select("text", "wanted")
    spelled = stash(own.mapInArrow(_contexts, "ah long, c long, bytes binary, anchor int"))
    # all of a context that occurs twice is a repeat: each of its windows is
    whole = contexts.where("n > 1").select("ah", "c", F.lit(GRAM - SPAN).cast("long").alias("lo"), F.lit(SPAN).cast("long").alias("hi"))
    spans = whole.union(_spans(spelled, sizes)).groupBy("ah", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    at = dealt_join(found.select("t1", "t2", "at", "ah", "c"), spans, heavy(contexts, "places", "ah", "c"), ["t1", "t2", "at"])
    return at.groupBy("t1", "t2").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: F.struct((F.col("at") + x["lo"]).alias("lo"), (F.col("at") + x["hi"]).alias("hi"))))).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `kept` (binary), `n_bytes`, `n_removed` and `n_spans` in place of the text.

    Each byte that some string of SPAN UTF-8 bytes covers which also starts anywhere else in
    the corpus goes; occurrences may overlap, and all are judged on the input. Matches never
    cross documents. Null or empty text has no bytes. A text that stands in two rows is a
    repeat of itself, wholly so from SPAN bytes on. Rows are recognised by a 128-bit hash of
    their text, for equal texts lose the same bytes. An empty table gives an empty result.
    Other columns pass through whatever their names; those with the names of new ones are
    replaced. Long texts are hashed CHUNK bytes at a time and held whole while they are cut.
    """
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in docs.columns if c.lower() not in new and c != text]
    a, b = hash_pair(text_of(docs, text))
    named = docs.select(carried(docs, names).alias("row"), a.alias("r1"), b.alias("r2"), text_of(docs, text).alias("text"))
    both = named.join(repeats(docs, text), (F.col("r1") == F.col("t1")) & (F.col("r2") == F.col("t2")), "left").select("row", "text", "spans")
    schema = T.StructType([both.schema["row"], T.StructField("kept", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in new[1:]]])
    return both.mapInArrow(_cut(["row", *new]), schema).select(*restored(names), *new)


def _cut(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, counts = [], ([], [], [])
            for text, spans in zip(b.column(1), b.column(2)):
                raw = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                gone = merged([(max(0, x["lo"]), min(len(raw), x["hi"])) for x in spans.as_py() or ()])
                edges = [0, *(e for x in gone for e in x), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                for v, to in zip((len(raw), len(raw) - len(kept[-1]), len(gone)), counts):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *[pa.array(v, pa.int64()) for v in counts]], names=names)

    return run


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
