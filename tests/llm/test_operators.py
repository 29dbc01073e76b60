"""Each operator against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as dec
from lodestone.llm import html_extraction as hx
from lodestone.llm import line_dedup, mixing, quality_rules, sharding, simhash, token_counts
from lodestone.llm import suffix_dedup as sd
from lodestone.llm import url_filters as uf

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    base = " ".join(rng.choice(words) for _ in range(300))
    texts = [None, "", " ", "\n\n", "Common line\nx", base, base, base.upper(), "word " * 4000, "a\tb　c\x0bd  e", "x" * 3000]
    for i in range(14):
        texts.append(f"\t COMMON line \n{' '.join(rng.choice(words) for _ in range(60))}\n{i}\n{i}")
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    return [(i if i else None, t, "src0" if i % 3 else None, "left as it is") for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # columns that operators make themselves, in other letters
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, KEPT string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_line_dedup(docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    lines = [(r[1] or "").split("\n") for r in ROWS]
    n = Counter(k for x in lines for k in {key(y) for y in x} if k)
    want = Counter((r[0], len(x), sum(n[key(y)] >= 10 for y in x), "\n".join(y for y in x if n[key(y)] < 10)) for r, x in zip(ROWS, lines))
    out = line_dedup.dedup_lines(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()) == want
    assert out.columns.count("kept") == 1 and line_dedup.dedup_lines(empty).count() == 0


def test_quality_rules(docs, empty):
    out = quality_rules.ledger(docs)
    for r in out.collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        w = [x for x in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert bool(r.failed_bits & 3) == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
    by_rule = {r.rule: r for r in quality_rules.ablations(out, "v1").collect()}
    bits = [r.failed_bits for r in out.collect()]
    for name, (b, _) in quality_rules.RULES.items():
        assert by_rule[name].n_failed == sum(x >> b & 1 for x in bits) and by_rule[name].n_only_this_rule == sum(x == 1 << b for x in bits)
    assert quality_rules.ledger(empty).count() == 0


@pytest.mark.parametrize(("group", "heavy"), [(20_000, 0.001), (3, 0.02), (3, 2.0)])
def test_suffix_dedup(docs, empty, monkeypatch, group, heavy):
    monkeypatch.setattr(sd, "GROUP", group)
    monkeypatch.setattr(sd, "HEAVY", heavy)
    raw = [(r[1] or "").encode() for r in ROWS]
    n = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    want = []
    for t in raw:
        gone = sd.merged([(i, i + 200) for i in range(len(t) - 199) if n[t[i : i + 200]] > 1])
        left = bytes(b for i, b in enumerate(t) if not any(x <= i < y for x, y in gone))
        want.append((len(t), len(t) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
    got = sd.remove_repeats(docs).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == Counter(want)
    if group > 3:
        assert sd.remove_repeats(empty).count() == 0


def test_anchors_over_chunks(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choice(b"abc ") for _ in range(6000)), np.uint8)
    whole = [x.tolist() for x in sd.anchors(data)]
    monkeypatch.setattr(sd, "CHUNK", 1000)
    assert [x.tolist() for x in sd.anchors(data)] == whole


def test_token_counts(docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r[0]: len(model.encode(r[1] or "")) for r in ROWS}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, MODEL).collect()} == want
    assert token_counts.count_tokens(empty, MODEL).count() == 0
    rng, counter = random.Random(2), token_counts.PieceCounter(MODEL)
    parts = [" ", "  ", "\n", "a", "the", "é", "▁", "x\ny", "\t", "12", "<s>", "　", "\x00", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    assert counter.count_batch(texts) == [len(model.encode(t)) for t in texts]


def test_token_store_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 15_760)
    counter, texts = token_counts.PieceCounter(MODEL), [f"unseen{i}word other{i}\nq{i}" for i in range(60)]
    assert [n for i in range(0, 60, 5) for n in counter.count_batch(texts[i : i + 5])] == [len(x) for x in counter.model.encode(texts)]


def test_simhash(docs, empty):
    fps = [simhash.fingerprint(r[1]) for r in ROWS]
    label = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for r, x in zip(ROWS, label):
        least[x] = min([v for v in (least.get(x), r[0]) if v is not None], default=None)
    want = {r[0]: (f, least[x]) for r, f, x in zip(ROWS, fps, label)}
    got = simhash.near_groups(docs).collect()
    assert {r.key: (r.fp & ((1 << 64) - 1), r.component_id) for r in got} == want and len(got) == len(ROWS)
    assert simhash.near_groups(empty).count() == 0 and fps[0] == fps[1] == 0


@pytest.mark.parametrize("n", [10, 50_000, 1_000_000, 20_000_000])
def test_plans_meet_the_pigeonhole(n):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (500, 64)) * 2.0 - 1
    x[:, 1] = x[:, 0]
    parts = simhash.plan(np.vstack([x.T @ x, x.sum(0)]) * (n / 500), n)
    assert sum(t + 1 for _, t in parts) == 5  # thresholds sum to 4 - parts + 1, those of -1 left out
    assert len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)
    assert any({0, 1} <= set(g) for g, _ in parts) or len(parts) < 2


@pytest.mark.parametrize("most", [simhash.EDGES, 340, 30])
def test_components(spark, monkeypatch, most):
    """In one task, by tasks and rounds that one task ends, and by rounds alone."""
    monkeypatch.setattr(simhash, "EDGES", most)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    up = {}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up.get(a, a), up.get(b, b))
    got = {r.node: r.least for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in up.items() if k in {x for e in edges if e[0] != e[1] for x in e}}


def test_chunks_hold_all_windows(monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 9, 300]))) for _ in range(800)).encode()
    whole = dec.Words([text])
    want = {(int(at), int(h)) for span, places, hashes in dec.prints(whole, [3, 8]) for at, h in zip(places, hashes)}
    monkeypatch.setattr(dec, "CHUNK", 500)
    got, parts = set(), list(dec.chunks(text))
    for first, part in parts:
        for _, places, hashes in dec.prints(dec.Words([part]), [3, 8]):
            got |= {(int(at) + first, int(h)) for at, h in zip(places, hashes)}
    assert got == want and len(parts) > 20 and parts[0][1] + b"" == text[: len(parts[0][1])]


def test_decontaminate(spark, docs, empty):
    base = ROWS[5][1].split()
    items = [(1, " ".join(base[10:30]).upper()), (2, " ".join(base[28:40])), (3, "edited"), (4, None), (5, ""), (None, "word word"), (6, "No such words here at all or anywhere"), (1, "x"), (7, "word word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(table))
    want = {}
    for r in ROWS:
        w, hit, ids = split(r[1]), set(), set()
        for i, t in items:
            v = split(t)
            k = min(8, len(v))
            for g in {tuple(v[x : x + k]) for x in range(len(v) - k + 1)} if v and i is not None else ():
                for x in range(len(w) - k + 1):
                    if tuple(w[x : x + k]) == g:
                        hit.update(range(x, x + k))
                        ids.add(str(i))
        want[r[0]] = (len(w), len(hit), sorted(ids), len(ids) >= 2)
    out = dec.decontaminate(docs, bench)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in out.collect()} == want
    assert dec.decontaminate(empty, bench).count() == 0
    assert dec.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_decontaminate_counts_words_without_a_regular_expression(spark):
    """By a regular expression each word is made a string of its own: most of the query's CPU time."""
    texts = [None, "", "a", " Zé-9 \x00.x\x7fy", "@`[{ /:", "long " * 3000 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = dec.decontaminate(rows, spark.createDataFrame([(1, "a b")], "item_id long, text string")).select("doc_id", "n_words")
    assert {r.doc_id: r.n_words for r in out.collect()} == {0: 0, 1: 0, 2: 1, 3: 4, 4: 0, 5: 3001}
    assert "regexp" not in out._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_in_pieces(monkeypatch):
    import re

    rng = random.Random(8)
    texts = ["".join(rng.choice("aZ09é　 .\n\x00\x7f@[`{/:") for _ in range(rng.choice([0, 0, 1, 2, 9, 300]))) for _ in range(200)] + ["", ""]
    want = [len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)) for t in texts]
    for piece in (1, 7, 100, 1 << 18):
        monkeypatch.setattr(dec, "PIECE", piece)
        assert dec.word_counts(pa.array(texts)).to_pylist() == want
        assert dec.word_counts(pa.array(texts, pa.large_string()).slice(3, 50)).to_pylist() == want[3:53]
        assert dec.word_counts(pa.array([], pa.string())).to_pylist() == []


def test_mixing(docs, empty, spark):
    many = spark.range(20_000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit("0123456789").alias("text"))
    out = mixing.mix(many, {"a": 3.0, "b": 1.0}, key="id").groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in out}
    assert abs(n["a"] - 15_000) < 600 and abs(n["b"] - 5_000) < 400
    one = mixing.mix(many.where("id < 400"), {"a": 1.0}, key="id")
    draws = [r.n_copies for r in one.where("copy = 1").collect()]
    assert abs(sum(draws) - 400) < 100 and {r["source"] for r in one.collect()} == {"a"}
    again = [sorted(map(tuple, mixing.mix(docs.repartition(k)).select("doc_id", "copy", "place").collect()), key=str) for k in (1, 5)]
    assert again[0] == again[1] and mixing.mix(empty).count() == 0
    large = mixing.mix(many.where("id < 4000").withColumn("source", F.when(F.col("id") < 10, "a").otherwise("b")), {"a": 1.0}, key="id")
    assert abs(large.count() - 4000) < 400  # a rate of 400 is drawn in parts


def test_sharding(docs, empty, spark):
    rows = sharding.digest(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in ROWS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.digest(empty, 4).count() == 0
    sizes = [random.Random(5).randrange(1, 1000) for _ in range(sharding.SLOTS)]
    first = sharding.SlotMap.balanced(sizes, 40)
    assert max(first.loads(sizes)) - min(first.loads(sizes)) <= max(sizes)
    grown = first.grown(sizes)
    assert all(a == b or b == 40 for a, b in zip(first.shards, grown.shards)) and grown.version == 2
    assert max(grown.loads(sizes)) < 1.01 * sum(sizes) / 41
    sizes[0] *= 500
    mended = first.rebalanced(sizes, 0.02)
    assert max(mended.loads(sizes)) <= max(first.loads(sizes)) and len(mended.moved) < 2000


def test_slot_map_versions(spark, tmp_path):
    first = sharding.SlotMap.balanced([5, 4, 3, 2], 2)
    first.save(spark, str(tmp_path / "m"))
    first.grown([5, 4, 3, 2]).save(spark, str(tmp_path / "m"))
    assert sharding.SlotMap.read(spark, str(tmp_path / "m"), 1) == first and sharding.SlotMap.read(spark, str(tmp_path / "m")).version == 2


PAGES = [
    ("http://a.org/1", "<html><body><nav>menu</nav><div class='ad'>buy</div><article><h1>T &amp; x</h1><p>one<b>two</b>\n three<br>four<p>five</article><footer>f</footer>"),
    ("HTTP://A.org/2", "<article><p>x</p><section class='comments'><p>me too</p></section><form>q</form><script>var t='</p>';</script></article><aside>s</aside>"),
    (None, None), ("no scheme", ""), ("http://b.org", "plain &lt;text&gt;"),
    *[(f"http://c.org/{i}", f"<body><div><p>Home</p><p>About us and more words here</p></div><div><div><p>story {i} that is long enough to be the main slot of it</p><p>and goes on {i}</p></div></div></body>") for i in range(5)],
]


def test_html_extraction(spark):
    df = spark.createDataFrame([(i, u, h, "z") for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, TEXT string")
    got = {r.page_id: r for r in hx.extract(df).collect()}
    assert got[0].text == "T & x onetwo three four five" and got[1].text == "x" and got[2].text == got[3].text == "" and got[4].text == "plain <text>"
    assert all(got[5 + i].text == f"story {i} that is long enough to be the main slot of it and goes on {i}" for i in range(5))
    assert all(r.n_chars == len(r.text) for r in got.values()) and hx.extract(df.where("false")).count() == 0
    found = {r.host: {x.kind for x in r.template} for r in hx.templates(df.select(uf.host_of(F.col("url")).alias("host"), "html")).collect()}
    assert hx.TEXT in found["c.org"] and "a.org" not in found


def test_templates_decide_where_pages_say_nothing(spark):
    """Hosts without article or main: what is alike on their pages goes, whatever its length, and names that sound like clutter do not matter."""
    words = [f"word{i}" for i in range(300)]
    rng = random.Random(8)
    rows, want = [], {}
    for h in range(4):
        always = " ".join(rng.sample(words, 80))
        for i in range(6):
            story = [" ".join(rng.sample(words, rng.randint(3, 12))) for _ in range(3)]
            page = (f"<body><div class='box{h}'><p>{always}</p></div><div class='story-header sidebar-free'><section class='share-price'><h2 id='header-files'>{story[0]}</h2>"
                    f"<p class='notice-period'>{story[1]}</p><ul id='menu-of-the-day'><li>{story[2]}</li></ul></section></div><div id='x{i}'><a href='/'>{always}</a></div></body>")
            want[len(rows)] = (" ".join(story), page)
            rows.append((len(rows), f"http://h{h}.org/{i}", page))
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    assert sum(hx.main_text(page) == text for text, page in want.values()) == 0  # each page by itself is read wrongly


def test_notices_within_the_article(spark):
    """A text on all pages of a host goes from the article too, but not where it is most of what stands there."""
    page = "<body><nav>menu</nav><article><h1>Title {0}</h1><p>Read our terms.</p><p>Story {0} has words of its own and enough of them.</p></article></body>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(5)]
    rows += [(10 + i, f"http://b.org/{i}", f"<body><nav>menu {i}</nav><article><p>One story, printed on each page of this host.</p></article></body>") for i in range(4)]
    rows += [(20 + i, "http://c.org/", rows[0][2]) for i in range(4)]  # copies of one page are no template
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} Story {i} has words of its own and enough of them." for i in range(5))
    assert all(got[10 + i] == "One story, printed on each page of this host." for i in range(4))
    assert all(got[20 + i] == "Title 0 Read our terms. Story 0 has words of its own and enough of them." for i in range(4))


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<b>x" * 200_000, '<a "' * 250_000, '<a href="' * 110_000, "<div>" * 50_000 + "</p>" * 100_000, "<p><button>" + "<b>" * 100_000 + "<hr>" * 100_000, "<" * 1_000_000])
def test_hostile_pages_are_read_in_linear_time(page):
    began = time.process_time()
    small = page[: len(page) // 8]
    hx.main_text(small)
    part = time.process_time() - began
    hx.main_text(page)
    assert time.process_time() - began < 40 * part + 2


def tree(page):
    """Tags and texts of a page, written out."""
    def out(node):
        return "".join(x if isinstance(x, str) else f"<{x.tag}>{out(x)}</{x.tag}>" for x in node.children)

    return out(hx.parse(page))


@pytest.mark.parametrize(("page", "shown"), [
    ("<p>a<p>b", "<p>a</p><p>b</p>"), ("<ul><li>a<li><b>c</ul>d", "<ul><li>a</li><li><b>c</b></li></ul>d"), ("a < b <c>", "a < b <c></c>"), ("x<br/>y<img src='a>b'>z", "x<br></br>y<img></img>z"),
    ("<a title=\"x>y\">t</a>", "<a>t</a>"), ("<p don't>t</p>", "<p>t</p>"), ("<script>a</b</script>c", "<script>a</b</script>c"), ("a<!-- <p> -->b", "ab"), ("<!-- a", ""), ("a</p>b</", "ab</"), ("<td>a<td>b", "<td>a</td><td>b</td>"),
    ("<p a='b>c</p>", "<p>c</p>"), ("<!doctype html>a<?x?>b", "ab"),
])
def test_parse(page, shown):
    assert tree(page) == shown


def test_main_part_of_the_template_wins():
    """An article that only some pages have is no part of the template, so it fills a slot of what holds it."""
    page = "<body><nav>menu</nav><main>one <article>two</article> <section class=notice>no</section> three</main></body>"
    rows = [{"id": n.id, "up": n.up, "kind": hx.CLUTTERED if n.clutter else hx.MAIN_PART if n.main else hx.ELEMENT, "leaf": False, "letters": 90} for n, _ in hx.measure(hx.parse(page)) if n.tag in ("body", "main", "nav")]
    template = hx.Template(rows)
    assert hx.main_text(page, template) == "one two three" and hx.main_text("<article>other</article>", template) == "other" and hx.main_text(None, template) == ""


def test_url_filters(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">y</a>' for h in hosts)
    rules = (("allow", "good.org", "/"), ("block", "bad.org", "/"), ("block", "good.org", "/x/"))
    rows = [("http://good.org/1", link("near.net")), ("http://sub.BAD.org/1", ""), ("http://farm.net/a?b", link("sub.bad.org", "near.net")), ("http://near.net", link("near.net")),
            ("http://good.org/x/y#z", None), (None, None), ("nothing", "<a href=//Q.org>"), ("http://notgood.org/", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r for r in uf.filter_urls(df, rules).collect()}
    assert [got[i].verdict for i in range(8)] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow"]
    assert [got[i].rule for i in (0, 1, 2, 4, 7)] == ["good.org/", "bad.org/", None, "good.org/x/", None]
    assert (got[2].host, got[2].path, got[5].host, got[3].path) == ("farm.net", "/a", "", "") and got[2].distrust > 0 == got[2].trust
    assert uf.filter_urls(df.where("false"), rules).count() == 0


def test_scores_do_not_stop_short_among_many_seeds(spark):
    """A chain of 12 hosts that leads to one of 300,000 blocked seeds: distrust goes all the way, as with one seed."""
    n, chain = 300_000, [f"c{i}" for i in range(12)]
    edges = spark.createDataFrame([*zip(chain, chain[1:]), (chain[-1], "s0")], "src string, dst string")
    for seeds in (1, n):
        hosts = spark.range(seeds).select(F.concat(F.lit("s"), "id").alias("host"), F.lit(0.0).alias("trusted"), F.lit(1.0).alias("blocked"))
        got = {r.host: r.distrust * seeds for r in uf.propagate(hosts, edges).where("host like 'c%'").collect()}
        assert all(abs(got[h] / (0.15 * 0.85 ** (12 - i)) - 1) < 1e-9 for i, h in enumerate(chain))


def rank(seeds, links, damping=0.85, rounds=400):
    """Personalised PageRank by definition: each host divides its own among those it links to."""
    total = sum(seeds.values()) or 1.0
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    x = {h: (1 - damping) * s / total for h, s in seeds.items()}
    for _ in range(rounds):
        new = {h: (1 - damping) * s / total for h, s in seeds.items()}
        for a, to in out.items():
            for b in to:
                new[b] = new.get(b, 0.0) + damping * x.get(a, 0.0) / len(to)
        x = new
    return x


def test_trust_and_distrust_over_a_graph(spark):
    """500 hosts with hubs, cycles and chains, against the definition."""
    rng = random.Random(9)
    hosts = [f"h{i}.org" for i in range(500)]
    links = {(rng.choice(hosts), rng.choice(hosts[:8])) for _ in range(600)} | {(rng.choice(hosts[:8]), rng.choice(hosts)) for _ in range(300)}
    links |= {(hosts[i], hosts[i + 1]) for i in range(100, 160)} | {(hosts[160], hosts[100])} | {(rng.choice(hosts), rng.choice(hosts)) for _ in range(400)}
    links = {(a, b) for a, b in links if a != b}
    good, bad = set(hosts[40:60]), set(hosts[200:230])
    rules = [("allow", h, "/") for h in good] + [("block", h, "/") for h in bad]
    page = lambda h: "".join(f'<a href="http://{b}/x">y</a>' for a, b in sorted(links) if a == h)
    df = spark.createDataFrame([(i, f"http://{h}/p", page(h)) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    trust = rank({h: 1.0 * (h in good) for h in hosts}, links)
    distrust = rank({h: 1.0 * (h in bad) for h in hosts}, {(b, a) for a, b in links})
    got = {r.host: r for r in uf.filter_urls(df, rules).collect()}
    for h in hosts:
        assert abs(got[h].trust - trust.get(h, 0.0)) < 1e-6 and abs(got[h].distrust - distrust.get(h, 0.0)) < 1e-6
        if h not in good | bad and abs(distrust.get(h, 0.0) - trust.get(h, 0.0)) > 1e-6:
            assert got[h].verdict == ("block" if distrust.get(h, 0.0) > trust.get(h, 0.0) else "allow")
    assert len({got[h].verdict for h in hosts if h not in good | bad}) == 2
    with pytest.raises(RuntimeError):
        uf.filter_urls(df, rules, rounds=2)


def slot(key, ident, n):
    """Spark's hash of two longs, a null one left out."""
    h = 42
    for v in (key, ident):
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return (h - (1 << 64) if h >> 63 else h) % n


def test_shard_against_brute_force(spark):
    """Slots, bytes and places by hand; many equal rows without a key are dealt over slots of their own, so that bytes stay near equal."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(1, 400)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(docs, 7, 256).collect()
    ident = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]
    slots = {r: slot(r[0], ident(r[1]), 256) for r in rows}
    assert all(r.vslot == slots[r.doc_id, r.text] for r in got)
    sizes = [0] * 256
    for (_, t), v in slots.items():
        sizes[v] += len(t) + 16
    by = sharding.SlotMap.balanced(sizes, 7)
    assert all(r.shard == by.shards[r.vslot] for r in got)
    loads = Counter()
    for r in got:
        loads[r.shard] += len(r.text) + 16
    assert max(loads.values()) - min(loads.values()) <= max(sizes)
    for s in range(7):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and [(r.vslot, r.doc_id) for r in own] == sorted((r.vslot, r.doc_id) for r in own)
    hot = spark.createDataFrame(rows + [(None, None)] * 2000, "doc_id long, text string").repartition(5)
    got = sharding.shard(hot, 7, 256).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += len(r.text or "") + 16
    assert len(got) == 3500 and max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values()) / 7
    assert max(Counter(r.vslot for r in got if r.doc_id is None).values()) < 100
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_maps_are_stored_and_edited(spark, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(3000)]
    at = str(tmp_path / "maps")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.shard for r in sharding.shard(docs, 5, 512, maps=at).collect()}
    again = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard(docs, 5, 512, maps=at).collect()}
    assert again == {k: (s, 1) for k, s in one.items()}
    more = spark.createDataFrame(rows + [(None, "y" * 400)] * 300, "doc_id long, text string")
    got = sharding.shard(more, 5, 512, maps=at).collect()
    moved = sum(one[r.doc_id] != r.shard for r in got if r.doc_id is not None)
    loads = Counter()
    for r in got:
        loads[r.shard] += len(r.text) + 16
    assert {r.map_version for r in got} == {3} and moved < 1500 and max(loads.values()) < 1.02 * sum(loads.values()) / 5
    assert sharding.SlotMap.read(spark, at, 1).shards == sharding.SlotMap.read(spark, at).shards[:512] or moved


@pytest.mark.parametrize(("heavy", "candidates"), [(100_000, 20), (5, 0)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, heavy, candidates):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "CANDIDATES", candidates)
    rng = random.Random(11)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        c = rng.getrandbits(64)
        fps |= {c} | {flip(c, rng.randint(1, 7)) for _ in range(40)}
        for _ in range(12):  # a chain that drifts away
            c = flip(c, 4)
            fps.add(c)
    fps = sorted(fps)
    label = {x: x for x in fps}
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4 and label[x] != label[y]:
                a, b = sorted((label[x], label[y]))
                label = {k: a if v == b else v for k, v in label.items()}
    path = spark.createDataFrame([(simhash.as_signed(x),) for x in fps], "fp long")
    found = simhash.links(simhash.stash(path))
    m = (1 << 64) - 1
    assert all(((r.a ^ r.b) & m).bit_count() <= 4 for r in found.collect())
    got = {r.node & m: r.least & m for r in simhash.components(found).collect()}
    groups = lambda of: sorted(sorted(x for x in fps if of(x) == g) for g in {of(x) for x in fps})
    assert groups(lambda x: got.get(x, x)) == groups(lambda x: label[x])


def test_a_dense_neighbourhood_makes_rows_in_proportion(spark):
    """All pairs of 3,000 fingerprints around one centre would be millions; links stay a few for each."""
    rng = random.Random(12)
    fps = {0}
    while len(fps) < 3000:
        fps.add(sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    found = simhash.links(simhash.stash(spark.createDataFrame([(simhash.as_signed(x),) for x in fps], "fp long")))
    assert found.count() < 20 * 3000 and {r.least for r in simhash.components(found).collect()} == {min(map(simhash.as_signed, fps))}


#: Names that operators use for themselves.
INNER = ("row", "t1", "t2", "r1", "r2", "f1", "f2", "h1", "h2", "key", "size", "ident", "s", "of", "found", "common", "hit", "prints", "spans", "template", "html_", "_text", "_source", "_before", "first", "salt", "rank", "before", "_m_words", "cdf", "parts")


def test_other_columns_pass_whatever_their_names(spark):
    rows = [(1, "Some words here\nand there", "a"), (2, None, "a"), (3, "Some words here\nand there", None), (3, "Some words here\nand there", None), (4, "x " * 200, "b")]
    extra = [f"{c}:{{0}}" for c in INNER]
    docs = spark.createDataFrame([(*r, *(e.format(i) for e in extra)) for i, r in enumerate(rows)], f"doc_id long, text string, source string, {', '.join(f'`{c}` string' for c in INNER)}")
    bench = spark.createDataFrame([(1, "some words here and there", "q")], "item_id long, text string, t1 string")
    outs = {
        "op1": line_dedup.dedup_lines(docs), "op3": mixing.mix(docs, {"a": 1.0, "b": 1.0}), "op4": sd.remove_repeats(docs), "op6": sharding.shard(docs, 2, 16), "op7": quality_rules.ledger(docs),
        "op8": token_counts.count_tokens(docs, MODEL), "op9": dec.decontaminate(docs, bench)}
    for name, out in outs.items():
        for r in out.collect():
            i = int(r["t1"].split(":")[1])
            assert all(r[c] == f"{c}:{i}" for c in INNER) and r.doc_id == rows[i][0], name
        assert name == "op3" or out.count() == 5, name
    assert {r.n_hit for r in outs["op9"].collect() if r.doc_id in (1, 3)} == {5}
    pages = docs.withColumnsRenamed({"text": "html", "source": "host"}).withColumn("url", F.lit("http://a.org/x"))
    for r in hx.extract(pages, key="doc_id").collect():
        assert r["row"].startswith("row:") and r["t1"].startswith("t1:") and "host" in r.__fields__
    got = uf.filter_urls(pages, key="host").collect()
    assert len(got) == 5 and {r["_host"] for r in got} == {"a", "b", None} and {r.host for r in got} == {"a.org"}
    assert simhash.near_groups(docs).count() == 5


def test_very_long_texts(spark):
    """One text of 4 MB among short ones, for each operator that reads documents."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(560_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, "short text", "a"), (3, long[1000:3000], "a")], "doc_id long, text string, source string")
    one = {r.doc_id: r for r in dec.decontaminate(docs, spark.createDataFrame([(7, long[2_000_000:2_000_400])], "item_id long, text string")).collect()}
    assert one[1].items == ["7"] and one[1].n_words == 560_000 and not one[3].items
    assert {r.doc_id: r.n_removed for r in sd.remove_repeats(docs).select("doc_id", "n_removed").collect()} == {1: 2000, 2: 0, 3: 2000}
    assert {r.doc_id: r.n_words for r in quality_rules.ledger(docs).select("doc_id", "n_words").collect()}[1] == 560_000
    assert line_dedup.dedup_lines(docs).count() == 3 and sharding.shard(docs, 2, 16).count() == 3 and simhash.near_groups(docs).count() == 3
    assert token_counts.count_tokens(docs, MODEL).where("n_tokens > 1000000").count() == 1
