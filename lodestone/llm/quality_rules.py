"""Quality rules as a ledger: every rule is evaluated once, policies only read its bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, free, load, quoted, stash, text_of

SYMBOLS = "#*$%&|<>"
SPAN = 8

#: Measurements, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

#: A rule is a bit and a test on measurements that is true where the rule fails.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 20"),
    "repeated_spans": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "100 * n_symbols > 30 * n_words"),
    "repeated_lines": (3, "100 * n_dup_lines > 50 * n_lines"),
    "shouting": (4, "100 * n_upper > 60 * word_chars"),
    "word_length": (5, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
}


def mask(*rules: str) -> int:
    return sum(1 << RULES[r][0] for r in rules)


#: Policies by version: a document is rejected if it fails a rule of the mask.
POLICIES: dict[str, int] = {
    "base": mask("too_few_words", "repeated_spans"),
    "v1": mask("too_few_words", "repeated_spans", "symbols", "repeated_lines", "shouting", "word_length"),
}


def measures(text: Column) -> dict[str, Column]:
    """SQL expressions only. Windows are compared by 64-bit hashes within one text."""
    words = F.array_remove(F.split(F.translate(text, WS, " " * len(WS)), " ", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    bare = F.length(F.translate(text, WS, ""))
    return {
        "words": words, "lines": lines,
        "word_chars": bare.cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }


def doubled(hashes: Column, n: int) -> Column:
    """From hashes of n words each, those of 2n words."""
    m = F.size(hashes) - n
    return F.zip_with(F.slice(hashes, F.lit(1), m), F.slice(hashes, F.lit(n + 1), m), lambda x, y: F.xxhash64(x, y))


def repeat_words(windows: Column, span: int = SPAN) -> Column:
    """Words in windows that occur twice or more. windows: one hash for each window, in order.

    Equal hashes meet in a sort of (hash, start); each start of such a pair then counts the words
    up to the next start, span at most. All steps are linear in the text but for the two sorts.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(windows)
    later = F.slice(pairs, F.lit(2), F.greatest(last - 1, F.lit(0)))
    before = F.slice(pairs, F.lit(1), F.greatest(last - 1, F.lit(0)))
    marks = F.flatten(F.filter(
        F.zip_with(before, later, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda m: m.isNotNull()
    ))
    starts = F.sort_array(F.array_distinct(marks))
    step = F.aggregate(
        starts, F.struct(F.lit(-1000000).alias("at"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(span))).alias("n")),
        lambda acc: acc["n"],
    )
    # each start adds the words since the one before, span at most; the first adds span, as do its own words
    return F.when(F.size(F.array_distinct(windows)) == last, F.lit(0)).otherwise(step).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed_bits`, one bit for each rule that a document fails.

    Null text has no words. A column that has the name of a new one is replaced; other columns
    pass through whatever their names. Works row by row without a shuffle, so ties, copies and
    repeated rows each get their own entry, and an empty table has none. A text's words are held
    as one array, some 60 bytes a word where windows repeat.
    """
    new = {*MEASURES, "failed_bits"}
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in new]
    names = [c for c in docs.columns if c.lower() not in new]
    x = measures(text_of(docs, text))
    at = {k: free(docs, f"_m_{k}") for k in (*x, "windows")}
    first = docs.withColumns({at[k]: v for k, v in x.items()})
    w, lines = F.col(at["words"]), F.col(at["lines"])
    # hashes of single words are joined to those of 2, 4 and 8: SPAN words in three steps, each a column of its own
    step = free(first, "_m_step")
    first = first.withColumn(step, F.when(F.size(w) >= SPAN, F.transform(w, lambda x: F.xxhash64(x))))
    for n in (1, 2, 4):
        first = first.withColumn(step, doubled(F.col(step), n))
    windows = F.coalesce(F.col(step), F.array().cast("array<bigint>"))
    # inlined as rows, so that a policy's filter is never moved below and the measuring done again for each of its rules
    measured = first.withColumn(at["windows"], windows).select(*kept, F.inline(F.array(F.struct(
        F.size(w).cast("long").alias("n_words"), F.col(at["word_chars"]).alias("word_chars"),
        F.col(at["n_symbols"]).alias("n_symbols"), F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(at["windows"])).alias("n_repeat_words"), F.col(at["n_upper"]).alias("n_upper"),
    ))))
    bits = sum((F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, test in RULES.values()), F.lit(0))
    return measured.select(*[F.col(quoted(c)) for c in names], *MEASURES, bits.cast("long").alias("failed_bits"))


def written(entries: DataFrame) -> DataFrame:
    """A ledger without texts as a table in the shared folder: policies and ablations read it, and no text again."""
    return stash(entries)


def passes(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects.

    Reads the ledger only; the bits are combined before they are shuffled, so a few rows move.
    """
    whole = POLICIES[policy]
    counts = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for r, (b, _) in RULES.items() if whole >> b & 1]))
    each = counts.withColumn("r", rules)
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only_this_rule"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger with the policies base and v1 applied."""
    entries = written(ledger(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), (passes("base") & passes("v1")).alias("kept"), "failed_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy v1 rejects, and rejects alone, from a stored ledger."""
    return ablations(written(ledger(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")), "v1")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
grams AS (SELECT doc_id, i, md5(array_to_string(words[i:i+7], ' ')) AS g FROM win),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM twice WHERE n > 1),
rep AS (SELECT doc_id, sum(CASE WHEN b IS NULL THEN 8 ELSE least(8, i - b) END) AS n FROM starts GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

ABLATION_SQL = f"""
SELECT rule, count(*) FILTER ((failed_bits & bit) <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only_this_rule
FROM ({SQL}), (VALUES ('too_few_words', 1), ('repeated_spans', 2), ('symbols', 4), ('repeated_lines', 8), ('shouting', 16), ('word_length', 32)) AS r(rule, bit)
GROUP BY rule
"""
