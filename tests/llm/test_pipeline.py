"""run() against a brute-force version of its stages."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestone.llm import near_copies, quality_rules
from lodestone.llm.common import hash_pair
from lodestone.llm.mixing import SQL as MIX_SQL
from lodestone.llm.decontaminate import SQL as LEAK_SQL

SF = "/root/testdata/sf0.001"


def test_run(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    kept = {i for (i,) in c.execute(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}
    texts = {i: t for i, t in c.execute("SELECT doc_id, text FROM documents").fetchall() if i in kept}
    ids = sorted(texts)
    sets = [words_of(texts[i]) for i in ids]
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    first = {ids[x] for x in label}
    leaks = {i for (i,) in c.execute(f"SELECT doc_id FROM ({LEAK_SQL}) WHERE n_items >= 1").fetchall()}
    left = sorted(first - leaks)
    c.execute("CREATE TABLE left_over AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", [left])
    want = Counter(i for (i,) in c.execute(f"SELECT doc_id FROM ({MIX_SQL.replace('FROM documents', 'FROM left_over')})").fetchall())
    rows = P.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == want and all(r.text == texts[r.doc_id] for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert [name for name, _ in P.STAGES] == ["quality_rules", "simhash", "decontamination", "mixing", "sharding"]


def test_one_of_each_group_stays(spark):
    """Repeated and missing doc_ids: groups are of texts, so no text goes because another one has its doc_id."""
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    x, y, z = " ".join(words), " ".join(reversed(words)), " ".join(words[::3] + words[1::3])
    rows = [(2, y), (5, x), (5, y), (5, x), (7, z), (None, z), (None, "alone " + y[:90]), (None, "alone " + y[:90])]
    docs = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.simhash(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(2, y), (5, x), (7, z), (None, "alone " + y[:90])])
    assert P.simhash(spark, docs.where("false"), SF).count() == 0


def words_of(text):
    """The set of 5-word shingles, A-Z in lower case."""
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(x, y):
    x, y = words_of(x), words_of(y)
    return len(x & y) / len(x | y)


def test_stages_take_any_rows(spark):
    """Null and empty texts, nulls in each column, repeated rows, a very long text, names that operators use, and no rows at all."""
    text = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 97}x{i}" for i in range(200_000))
    rows = [(1, None, "en", "s", 1, "x"), (None, "", None, None, None, None), (2, text, "en", "s", 9, "y"), (2, text, "en", "s", 9, "y"), (3, long, None, None, None, "z"), (None, text[::-1], "en", "s", 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in P.STAGES:
        for given in (docs, docs.where("false")):
            out = stage(spark, given, SF)
            got = out.collect()
            assert name == "sharding" or out.columns == docs.columns
            assert {r.row for r in got} <= {r[5] for r in rows} and (given is docs or not got)
    assert sorted(str(r.doc_id) for r in P.quality_rules(spark, docs, SF).collect()) == ["2", "2", "3", "None"]
    assert sorted(str(r.doc_id) for r in P.simhash(spark, docs, SF).collect()) == ["1", "2", "3", "None"]
    assert P.decontamination(spark, docs, SF).count() == 6


@pytest.mark.parametrize("pairs", [20, 0])
def test_copies_edited_to_less_are_found(spark, monkeypatch, pairs):
    """Copies of similarity 0.8 to 0.95 are in one group, those under 0.8 are not; with and without rounds of leaders."""
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    monkeypatch.setattr(near_copies, "LIST", 0)
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5, 6, 8):
            w = list(base)
            for i in rng.sample(range(200), edits):
                w[i] = f"e{rng.randrange(5000)}"
            rows.append(" ".join(w).upper() if edits == 2 else " ".join(w))
    label, links = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            s = jaccard(rows[i], rows[j])
            if s >= 0.8:
                links.append(s)
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert min(links) < 0.83 and any(0.83 < s < 0.95 for s in links) and len(set(label)) > 12
    docs = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.simhash(spark, docs.repartition(3), SF).collect()) == sorted(set(label))


def test_sketches_differ_in_no_more_bits_than_sets():
    """Parity sketches bound from below in how many shingles two sets differ."""
    rng = np.random.default_rng(3)
    for size, edits in ((1, 0), (1, 1), (40, 3), (400, 30), (5000, 2000)):
        x = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, size))
        y = np.unique(np.concatenate([x[edits:], rng.integers(-(1 << 63), (1 << 63) - 1, edits)]))
        bits = sum(int(a ^ b).bit_count() for a, b in zip(near_copies.sketch(x).view(np.uint64), near_copies.sketch(y).view(np.uint64)))
        assert bits <= len(np.setxor1d(x, y)) and (edits or bits == 0)
    assert len(near_copies.sketch(x)) == near_copies.SKETCH // 64


def test_shingles_are_counted_in_all_documents(spark, monkeypatch):
    """A passage of many documents is in no set's first shingles, whichever documents have it: none is left out of the counts."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1, raising=False)
    line = " ".join(f"l{i}" for i in range(20))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + " " + line) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.where(F.pmod(hash_pair(docs["doc_id"], docs["text"])[0], F.lit(8)) != 0)  # those that one sample had left out
    made, signatures = [], near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda *given: made.append(signatures(*given)) or made[0])
    assert near_copies.near_copies(docs).count() == docs.count() > 40
    common = set(near_copies.shingles(line).tolist())
    assert not any(common & set(r.prefix) for r in made[0].collect())
    texts = [r.text for r in docs.collect()]
    often = near_copies.counts(docs)
    assert often.sum() == sum(len(near_copies.shingles(t)) for t in texts)
    assert (often[near_copies.cell(near_copies.shingles(line))] >= len(texts)).all()


def test_whole_sets_are_tested_row_by_row(spark, monkeypatch):
    """Pairs with two whole sets each go to no Python worker, where a batch of them has no bound; sets come in batches of any size."""
    monkeypatch.setattr(near_copies, "SETS", 150, raising=False)
    words = [f"w{i}" for i in range(104)]
    texts = ["", "few words", " ".join(words), " ".join(["x", *words[1:]]), " ".join(words[:52] + ["x", "y"] + words[54:]), " ".join(words[11:]), " ".join(words[30:]), " ".join(words[::-1])]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "h1 long, h2 long, text string")
    members = docs.selectExpr("h1", "h2", "h1 AS unit")
    every = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    out = near_copies.similar(spark.createDataFrame(every, "a long, b long"), docs, members)
    assert {tuple(r) for r in out.collect()} == {(i, j) for i, j in every if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} == {(i, j) for i, j in every if jaccard(texts[i], texts[j]) >= 0.8}
    assert 3 < out.count() < len(every) and "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
