"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import carried, hash_pair, load, quoted, restored, stash, text_of

#: Words of a window that counts as shared.
SPAN = 8
#: Words of a fingerprint; the least hash of SPAN - GRAM + 1 neighbours is kept, so each shared window holds a kept one.
GRAM = 4
#: Bits of the sieve, a power of two: 8 MB.
SIEVE = 1 << 26
#: Bytes of texts that are hashed at a time; they take some 40 times as much.
CHUNK = 4 << 20
#: Bytes in which words are counted at a time.
PIECE = 1 << 18

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)
# digits, letters and all bytes of other characters are parts of words
_IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_IS_WORD_BYTES = _IS_WORD.tobytes()
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: their places in the joined bytes, their hashes, their texts' numbers."""

    def __init__(self, texts: list[bytes]):
        self.bytes = _LOW[np.frombuffer(b"".join(texts), np.uint8)]
        n = len(self.bytes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        word = np.zeros(n + 2, bool)
        word[1:-1] = _IS_WORD[self.bytes]
        cut = np.zeros(n + 1, bool)  # a text starts here
        cut[bounds] = True
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
        self.of = np.searchsorted(bounds, self.starts, side="right") - 1
        self.first = np.searchsorted(self.of, np.arange(len(texts) + 1))
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B_INV, np.uint64)]), dtype=np.uint64)
        self.hashes = _mix((sums[self.ends] - sums[self.starts]) * back[self.starts])

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; 0 where the text has fewer."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            x = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                x = x * _C + self.hashes[i : n - k + 1 + i]
            out[: n - k + 1] = np.where(self.of[: n - k + 1] == self.of[k - 1 :], _mix(x) | np.uint64(1), np.uint64(0))
        return out

    def winnowed(self, grams: np.ndarray, span: int, k: int) -> np.ndarray:
        """Which k-grams are the least of some window of span words; all that tie are kept."""
        n, w = len(grams), span - k + 1
        kept = np.zeros(n, bool)
        if n < span:
            return kept
        least = grams[: n - span + 1].copy()
        for i in range(1, w):
            np.minimum(least, grams[i : n - span + 1 + i], out=least)
        least[self.of[: n - span + 1] != self.of[span - 1 :]] = 0
        for i in range(w):
            kept[i : n - span + 1 + i] |= (least == grams[i : n - span + 1 + i]) & (least != 0)
        return kept

    def text(self, at: int, k: int) -> bytes:
        return b" ".join(self.bytes[a:b].tobytes() for a, b in zip(self.starts[at : at + k], self.ends[at : at + k]))


def chunks(text: bytes, overlap: int = SPAN - 1) -> Iterator[tuple[int, bytes]]:
    """(number of the first word, bytes): parts of a long text that share overlap words, so that each window lies whole in one."""
    if len(text) <= CHUNK:
        yield 0, text
        return
    at, first, size = 0, 0, CHUNK
    while True:
        end = at + size
        while end < len(text) and _IS_WORD[text[end]] and _IS_WORD[text[end - 1]]:
            end += 1  # not inside a word
        part = text[at:end]
        starts = Words([part]).starts
        if end < len(text) and len(starts) <= overlap:
            size *= 2  # words so long that the next part would begin where this one does
            continue
        yield first, part
        if end >= len(text):
            return
        first, at, size = first + len(starts) - overlap, at + int(starts[len(starts) - overlap]), CHUNK


def prints(w: Words, spans: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(span, places, hashes) of the fingerprints of texts: of SPAN words the least GRAM-word hashes, of fewer all of them together."""
    for span in spans:
        if span == SPAN:
            grams = w.grams(GRAM)
            at = np.flatnonzero(w.winnowed(grams, SPAN, GRAM))
            yield span, at, grams[at]
        else:
            grams = w.grams(span)
            at = np.flatnonzero(grams)
            yield span, at, grams[at]


class Sieve:
    """A fixed number of bits, those of the hashes of the test fingerprints: what it drops has no match, what it lets pass is joined.

    It is no larger for a larger benchmark, it only lets more pass.
    """

    def __init__(self, words: np.ndarray, bits: np.ndarray):
        self.table = np.zeros(SIEVE // 64, np.uint64)
        self.table[words] = bits

    @staticmethod
    def place(span: int, hashes: np.ndarray) -> np.ndarray:
        return _mix(hashes + np.uint64(span)) & np.uint64(SIEVE - 1)

    def passes(self, span: int, hashes: np.ndarray) -> np.ndarray:
        x = self.place(span, hashes)
        return (self.table[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) != 0


def test_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (item, span, words): the windows of each item; an item of fewer than SPAN words is one."""
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = text.encode()
            for _, part in chunks(raw):
                w = Words([part])
                n = len(w.starts)
                span = SPAN if n >= SPAN or len(part) < len(raw) else n
                grams = [] if not n or n < span else sorted({w.text(i, span) for i in range(n - span + 1)})
                for at in range(0, len(grams), 50_000):
                    own = grams[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array([span] * len(own), pa.int32()), pa.array([g.decode() for g in own], pa.string())], names=["item", "span", "words"])


def test_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(span, words) of windows -> (span, h): a window's fingerprints are its least GRAM-word hashes, or its own where it is short."""
    for b in batches:
        for span, at, h in _of_windows(b.column(0).to_numpy(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), span), pa.int32()), pa.array(h.view(np.int64))], names=["span", "h"])


def _of_windows(spans: np.ndarray, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for span in sorted({int(x) for x in spans}):
        texts = [t.encode() for t, x in zip(words, spans) if x == span]
        for at in range(0, len(texts), 20_000):
            yield from prints(Words(texts[at : at + 20_000]), [span])


def sieve_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(span, h) -> (word, bits) of the sieve."""
    for b in batches:
        spans, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        x = np.concatenate([Sieve.place(int(s), h[spans == s]) for s in np.unique(spans)] or [np.zeros(0, np.uint64)])
        x = np.unique(x)
        word, start = np.unique(x >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (x & np.uint64(63)), start) if len(x) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _candidates(held, spans: list[int]):
    """(t1, t2, text) -> of each text with fingerprints that pass the sieve (t1, t2, text, fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = held.value
        for b in batches:
            at, sizes = 0, pa.compute.binary_length(b.column(2)).to_numpy(zero_copy_only=False)
            while at < len(b):
                end, size = at + 1, int(sizes[at])
                while end < len(b) and size + int(sizes[end]) <= CHUNK:
                    size += int(sizes[end])
                    end += 1
                found: dict[int, set[tuple[int, int]]] = defaultdict(set)
                texts = [t.encode() for t in b.column(2).slice(at, end - at).to_pylist()]
                for part in [texts] if len(texts) > 1 else [[p] for _, p in chunks(texts[0])]:
                    w = Words(part)
                    for span, places, h in prints(w, spans):
                        ok = sieve.passes(span, h)
                        for d, x in zip(w.of[places[ok]].tolist(), h[ok].view(np.int64).tolist()):
                            found[d].add((span, x))
                if found:
                    rows = sorted(found)
                    own = b.take(pa.array([at + d for d in rows]))
                    lists = pa.array([[{"span": s, "h": h} for s, h in sorted(found[d])] for d in rows], pa.list_(pa.struct([("span", pa.int32()), ("h", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([*own.columns, lists], names=["t1", "t2", "text", "prints"])
                at = end

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, hits) -> (t1, t2, at, span, words): the windows around each hit."""
    for b in batches:
        for row in range(len(b)):
            hits = b.column(3)[row].as_py()
            for first, part in chunks(b.column(2)[row].as_py().encode()):
                w, places, spans, words = Words([part]), [], [], []
                for span in sorted({h["span"] for h in hits}):
                    table = np.sort(np.array([h["h"] for h in hits if h["span"] == span], np.int64).view(np.uint64))
                    (_, at, h), = prints(w, [span])
                    at = at[_among(h, table)]
                    if span == SPAN:
                        at = np.unique((at[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
                        at = at[(at >= 0) & (at <= len(w.starts) - SPAN)]
                    places += (at + first).tolist()
                    spans += [span] * len(at)
                    words += [w.text(i, span).decode() for i in at.tolist()]
                n = len(places)
                one = [pa.array([b.column(i)[row].as_py()] * n, pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*one, pa.array(places, pa.int64()), pa.array(spans, pa.int32()), pa.array(words, pa.string())], names=["t1", "t2", "at", "span", "words"])


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def word_counts(texts: pa.Array) -> pa.Array:
    """How many words each text has: the first bytes of words, counted in the joined bytes a piece at a time."""
    if not len(texts):
        return pa.array([], pa.int64())
    raw = texts.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    joined = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    before, seen, inside = np.zeros(len(bounds), np.int64), 0, False  # words that begin before each bound, before this piece
    for at in range(int(bounds[0]), int(bounds[-1]), PIECE):
        end = min(at + PIECE, int(bounds[-1]))
        word = np.frombuffer(joined[at:end].tobytes().translate(_IS_WORD_BYTES), bool)
        go_on = np.concatenate([[inside], word[:-1]])
        a, b = np.searchsorted(bounds, [at, end])
        go_on[bounds[a:b] - at] = False  # a text starts here
        starts = np.flatnonzero(word & ~go_on)
        before[a:b] = seen + np.searchsorted(starts, bounds[a:b] - at)
        seen, inside = seen + len(starts), bool(word[-1])
    before[np.searchsorted(bounds, bounds[-1]) :] = seen  # texts behind the last byte are empty
    return pa.array(np.diff(before))


@F.arrow_udf(LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return word_counts(texts)


def found_windows(docs: DataFrame, bench: DataFrame, text: str, item: str, item_text: str) -> DataFrame:
    """(t1, t2, n_hit, items): for each text, by its hash, that has a window of an item."""
    spark = docs.sparkSession
    named = bench.where(bench[quoted(item)].isNotNull()).select(bench[quoted(item)].cast("string").alias("item"), text_of(bench, item_text).alias("text"))
    windows = stash(named.mapInArrow(test_windows, "item string, span int, words string").distinct())
    prints_of = stash(windows.select("span", "words").mapInArrow(test_prints, "span int, h long").distinct())
    spans = sorted(r.span for r in windows.select("span").distinct().collect())  # SPAN of them at most
    bits = prints_of.mapInArrow(sieve_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # SIEVE / 64 rows at most
    held = spark.sparkContext.broadcast(Sieve(bits.column("word").to_numpy(), bits.column("bits").to_numpy().view(np.uint64)))
    a, b = hash_pair(text_of(docs, text))
    texts = docs.select(a.alias("t1"), b.alias("t2"), text_of(docs, text).alias("text"))
    schema = "t1 long, t2 long, text string, prints array<struct<span:int,h:long>>"
    maybe = stash(texts.mapInArrow(_candidates(held, spans), schema))
    # training and test fingerprints are joined; what was let through by chance ends here
    hits = maybe.select("t1", "t2", F.inline("prints")).distinct().join(prints_of, ["span", "h"], "left_semi")
    hits = stash(hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("span", "h")).alias("hits")))
    own = maybe.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(hits, ["t1", "t2"])  # copies go on the map side
    around = stash(own.select("t1", "t2", "text", "hits").mapInArrow(_extended, "t1 long, t2 long, at long, span int, words string"))
    both = around.join(windows.select("span", "words").distinct(), ["span", "words"], "left_semi").groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("at", "span"))).alias("hit"))
    # each window adds the words behind the last that is counted
    n_hit = F.aggregate("hit", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda x, w: F.struct(
        F.greatest(x["end"], w["at"] + w["span"]).alias("end"), (x["n"] + F.greatest(F.lit(0).cast("long"), w["at"] + w["span"] - F.greatest(x["end"], w["at"]))).alias("n")), lambda x: x["n"])
    hit = both.select("t1", "t2", n_hit.alias("n_hit"))
    items = around.select("t1", "t2", "span", "words").distinct().join(windows, ["span", "words"]).select("t1", "t2", "item").distinct()
    items = items.groupBy("t1", "t2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return stash(hit.join(items, ["t1", "t2"]))


def decontaminate(docs: DataFrame, bench: DataFrame, min_items: int = 2, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `n_words`, `n_hit`, `n_items`, `items` (sorted array of strings) and `contaminated`.

    A window is SPAN consecutive words of an item, or all of a shorter item. Of each SPAN words
    of documents and items the least GRAM-word hash is kept, and all that tie; so two texts that
    share a window share a kept hash. Kept hashes of documents are joined with those of the items
    (a fixed-size sieve of the items' hashes first drops most that have no match), the hits are
    extended to the windows around them, and these are joined with the items' by their words.
    Shorter items are found by one hash of all their words. A word is hit inside any window's
    occurrence. `n_words` is counted apart, from the texts' bytes, and only where it is asked for.

    The test set may be of any size: windows and fingerprints are tables, and only the sieve, of
    SIEVE bits, goes to the executors. Null text has no words; items without words, or without an
    id, have no window or no name and are never listed. Items that repeat count once by id, and
    texts that repeat are searched once. Empty tables on either side are fine. Other columns
    pass through whatever their names; those with the names of new ones are replaced. Long
    texts are hashed CHUNK bytes at a time, parts that overlap by SPAN - 1 words.
    """
    new = ("n_words", "n_hit", "n_items", "items", "contaminated")
    names = [c for c in docs.columns if c.lower() not in new]
    found = found_windows(docs, bench, text, item, item_text).withColumnsRenamed({"t1": "f1", "t2": "f2"})
    a, b = hash_pair(text_of(docs, text))
    named = docs.select(carried(docs, names).alias("row"), a.alias("t1"), b.alias("t2"), _n_words(text_of(docs, text)).alias("n_words"))
    out = named.join(found, (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*restored(names), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      items.alias("items"), (F.size(items) >= min_items).alias("contaminated"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, w, least(len(w), 8) AS k, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM bw),
spans AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, spans WHERE len(w) >= k),
hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM dw) dw JOIN win ON win.k = dw.k AND win.g = dw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
