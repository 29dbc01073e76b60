"""Token counts with a whole-token shortcut: most pre-tokens are one token and need no merging."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, load, restored, text_of

MARK = "▁"
#: Pre-tokens that are kept with their counts; beyond, the store starts anew.
CACHED = 1 << 20


class PieceCounter:
    """Counts a sentencepiece BPE model's tokens of texts.

    The model turns each space into a mark, puts one mark before the text, and merges pairs
    into vocabulary pieces. What is proved from the vocabulary, once for each model:
    - no piece has a mark after another character, and none holds a line feed, so no merge
      crosses from a pre-token into the mark or line feed after it: the tokens of a text are
      those of its pre-tokens, each with the marks before it;
    - the pieces that, encoded alone, give one token: the shortcut's table.
    A model for which the first does not hold is counted text by text.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces) and [
            len(self.model.encode(t)) for t in ("a", " a", "a b", "a\nb", "\n")] == [1, 2, 2, 3, 2]
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        #: pre-token without its mark -> 1, for those that encode alone as one token
        self.whole = {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1)) if len(ids) == 1}
        self.known, self.after = dict(self.whole), {}

    def _room(self, n: int) -> bool:
        """Whether n more fit; if not, what was known goes."""
        if fits := len(self.known) + len(self.after) + n <= CACHED:
            return fits
        self.known, self.after = dict(self.whole), {}
        return False

    def count_batch(self, texts: list[str]) -> list[int]:
        """Counts of many texts: what is new in all of them is merged in one call."""
        out: list = [0] * len(texts)
        plain: list[tuple[int, list[str], list[str]]] = []
        new: set[str] = set()
        new_after: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.splits or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
                # runs of spaces are pieces of their own; such texts are merged as a whole
                out[i] = len(self.model.encode(text))
                continue
            words, after = text.split(" "), []
            if "\n" in text:
                # a feed is one token; what follows it has no mark before it
                out[i] = text.count("\n")
                lines = [w.split("\n") for w in words if "\n" in w]
                words = [w for w in words if "\n" not in w]
                for first, *rest in lines:
                    words.append(first)
                    after += rest
            plain.append((i, words, after))
            new.update(words)
            new_after.update(after)
        new = {w for w in new if w not in self.known}
        new_after = {w for w in new_after if w not in self.after}
        if not plain:
            return out
        kept = self._room(len(new) + len(new_after))
        fresh = [w for w in set().union(*(w for _, w, _ in plain)) if w not in self.known] if not kept else list(new)
        self.known.update(zip(fresh, map(len, self.model.encode(fresh, num_threads=1))))
        self.known[""] = 1  # a mark alone
        fresh = list(new_after if kept else set().union(*(a for _, _, a in plain)))
        # behind a feed a text is merged as if no mark stood before it; mark and feed are two tokens
        self.after.update(zip(fresh, (len(x) - 2 for x in self.model.encode(["\n" + x for x in fresh], num_threads=1))))
        for i, words, after in plain:
            out[i] += sum(map(self.known.__getitem__, words)) + sum(map(self.after.__getitem__, after))
        return out

    def count(self, text: str) -> int:
        return self.count_batch([text])[0]


@functools.cache
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """docs with `n_bytes`, `n_tokens` and `over_limit` in place of the text.

    No begin or end token, no truncation; special strings inside a text are ordinary text.
    Null or empty text: 0 bytes, 0 tokens. Rows are counted one by one, without a shuffle, so
    copies, ties, repeated rows and skewed keys make no difference. An empty table gives an
    empty result. Other columns pass through whatever their names; one with the name of a new
    one is replaced. A text is held whole, and its pre-tokens, in the task that counts it.
    model_file is a path on each executor.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in docs.columns if c != text and c.lower() not in new]
    narrow = docs.select(carried(docs, rest).alias("row"), text_of(docs, text).alias("text"))
    schema = T.StructType([narrow.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = counter(model_file).count_batch
        for b in batches:
            texts = b.column(1)
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            lists = [texts.slice(i, 500).to_pylist() for i in range(0, len(texts), 500)]
            counts = pa.array([n for part in lists for n in counts_of(part)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, counts], names=["row", "n_bytes", "n_tokens"])

    out = narrow.mapInArrow(run, schema)
    return out.select(*restored(rest), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
