"""Main text of web pages: the template of a host is deduced, and what fills its slots is read."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, load, quoted, restored, stash
from .url_filters import host_of

#: Templates of at most so many bytes in all are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

# Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
CLUTTER = frozenset("nav header footer aside form script style noscript template button select textarea svg canvas iframe object head title dialog menu input".split())
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: Whole names of classes: adverts, notices and reader comments differ from page to page, so that no template tells them from the article.
CLUTTER_CLASSES = frozenset("ad ads advert adverts advertisement comment comments notice notices".split())
MAIN = frozenset(["article", "main"])
LEAVES = frozenset("p h1 h2 h3 li td".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*)""")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_DIGITS = re.compile(r"\d+")

#: What a token is: an element, one that is clutter or the main part by its own name, a text, a text in the main part.
ELEMENT, CLUTTERED, MAIN_PART, TEXT, INNER_TEXT = range(5)
ROOT = 0


def _id(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


class Node:
    """An element of a page. Its id stands for its path of names from the root, numbers in names left out."""

    __slots__ = ("block", "children", "clutter", "id", "letters", "main", "tag", "up")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.children, self.up, self.letters = tag, [], up.id if up else ROOT, 0
        self.clutter, self.main, name = tag in CLUTTER, False, ""
        a = {}
        if attrs and not attrs.isspace():
            a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs) if m[1]}
            classes = a.get("class", "").split()
            name = _DIGITS.sub("0", " ".join([*classes, "#", *a.get("id", "").split()]))
            self.clutter |= a.get("role", "").lower() in CLUTTER_ROLES or not CLUTTER_CLASSES.isdisjoint(x.lower() for x in classes)
        if not self.clutter:
            self.main = tag in MAIN or bool(a) and (a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody")
        self.id = _id(f"{self.up}/{self.clutter:d}{self.main:d}{tag}[{name}]") if up else ROOT


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """Where a tag ends whose attributes go on at at; -1 if it never does. A quote counts behind an equals sign."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        at = m.end()
        if quotes:
            k = m.start() - 1
            while page[k].isspace():
                k -= 1
            if page[k] == "=" and (close := page.find(m[0], at)) >= 0:
                at = close + 1
    return -1


def parse(page: str) -> Node:
    """A tree of nodes and texts, in time and memory that grow with the page. Tags that are left open end with what holds them."""
    root = Node("", "", None)
    root.block = 0
    stack, opened = [root], Counter()
    at, begin, n, quotes = 0, 0, len(page), True  # begin: of the text that is not yet in the tree

    def close(to: int) -> None:
        for x in stack[to:]:
            opened[x.tag] -= 1
        del stack[to:]

    while (lt := page.find("<", at)) >= 0:
        m = _OPEN.match(page, lt)
        if m:
            end = m.end()
            stop = end + 1 if page[end : end + 1] == ">" else _tag_end(page, end, quotes)
            if stop < 0 and quotes:
                quotes = False  # a quote that is never closed: from here on they are like other characters
                stop = _tag_end(page, end, False)
        elif page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4) + 3
            stop = n if stop < 3 else stop
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            stop = page.find(">", lt) + 1 or -1
        else:
            at = lt + 1
            continue
        if stop < 0:
            break  # no tag ends behind here
        if lt > begin:
            stack[-1].children.append(page[begin:lt])
        at = begin = stop
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        ends = ("p",) if tag in CLOSES_P else SELF_CLOSING.get(tag, ())
        if ends and stack[stack[-1].block].tag in ends:
            close(stack[-1].block)
        attrs = page[m.start(3) : stop - 1]
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            raw = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            end = raw.start() if raw else n
            node.children.append(page[at:end])
            at = begin = page.find(">", end) + 1 or n
        elif tag not in VOID and not attrs.endswith("/"):
            node.block = stack[-1].block if tag in INLINE else len(stack)
            opened[tag] += 1
            stack.append(node)
    if begin < n:
        stack[-1].children.append(page[begin:])
    return root


def measure(root: Node) -> list[tuple[Node, bool]]:
    """Elements from the root down, each with whether it lies in a main part; their letters are of text that is neither clutter nor a link."""
    out, ups, hidden = [(root, False)], [0], [False]
    for i, (node, inside) in enumerate(out):
        for x in node.children:
            if not isinstance(x, str):
                out.append((x, inside or x.main))
                ups.append(i)
                hidden.append(hidden[i] or x.clutter or x.tag == "a")
            elif not hidden[i]:
                node.letters += len(" ".join(x.split()))
    for i in range(len(out) - 1, 0, -1):
        out[ups[i]][0].letters += out[i][0].letters
    return out


def text_id(node: Node, text: str) -> int:
    return _id(f"{node.id}#{text}")


def tokens(root: Node) -> dict[int, list]:
    """What may belong to a template: id -> holder's id, kind, whether it is a leaf, count in the page, letters."""
    out: dict[int, list] = {}
    for node, inside in measure(root):
        if node.tag:
            own = out.setdefault(node.id, [node.up, CLUTTERED if node.clutter else MAIN_PART if node.main else ELEMENT, node.tag in LEAVES or node.tag in INLINE, 0, 0])
            own[3] += 1
            own[4] += node.letters
        for x in node.children:
            if isinstance(x, str) and (t := " ".join(x.split())):
                own = out.setdefault(text_id(node, t), [node.id, INNER_TEXT if inside else TEXT, True, 0, 0])
                own[3] += 1
                own[4] += len(t)
    return out


class Template:
    """A host's template, from the tokens of its valid classes: its texts, and which of its elements hold the main slots.

    Classes nest from the root down: a token is the template's if the element that holds it is.
    What a page has in a template's element, and the template has not, fills a slot. The main
    slots are those of the element that holds the most of what fills slots on all pages of the
    host, found from the root down; where elements that name themselves the main part lie in it
    or around it, theirs. Elements that are clutter by name hold no main slot. Texts in the
    main slots that stand on every page are the template's too, unless they are most of what
    is there.
    """

    def __init__(self, rows: list[dict]):
        inner: dict[int, list[dict]] = defaultdict(list)
        for r in rows:
            inner[r["up"]].append(r)
        order, hidden = [(ROOT, None)], {ROOT: False}
        for at, _ in order:
            for r in inner[at]:
                if r["id"] not in hidden:
                    hidden[r["id"]] = hidden[at] or r["kind"] == CLUTTERED
                    order.append((r["id"], r))
        nested = [r for _, r in order[1:]]
        self.texts = frozenset(r["id"] for r in nested if r["kind"] == TEXT)
        # letters that fill slots: all but those of the template's texts, which lie in what holds them
        fixed: dict[int, int] = defaultdict(int)
        for r in reversed(nested):
            if not hidden[r["up"]] and r["kind"] != CLUTTERED:
                fixed[r["up"]] += r["letters"] if r["kind"] == TEXT else fixed[r["id"]] if r["kind"] < TEXT else 0
        filled = {r["id"]: r["letters"] - fixed[r["id"]] for r in nested if r["kind"] in (ELEMENT, MAIN_PART) and not hidden[r["id"]]}
        ups = {r["id"]: r["up"] for r in nested}
        leaf = {r["id"]: r["leaf"] for r in nested}
        node, whole = ROOT, sum(filled.get(r["id"], 0) for r in inner[ROOT])
        path = [ROOT]
        while whole > 0:
            best = max((r["id"] for r in inner[node] if r["id"] in filled), key=lambda x: (filled[x], x), default=None)
            if best is None or filled[best] < 0.6 * whole or leaf[best]:
                break
            node = best
            path.append(node)
        named = {r["id"] for r in nested if r["kind"] == MAIN_PART and r["id"] in filled}
        around = [x for x in path if x in named]

        def inside(x: int) -> bool:
            while x != ROOT and x != node:
                x = ups[x]
            return x == node

        self.main = {around[0]} if around else {x for x in named if inside(x)} or {node}
        notices = [r for r in nested if r["kind"] == INNER_TEXT and not hidden[r["up"]]]
        if 2 * sum(r["letters"] for r in notices) < sum(filled.get(x, whole) for x in self.main):
            self.texts |= {r["id"] for r in notices}

    def slots(self, root: Node) -> list[Node]:
        """The page's elements that hold its main slots, in page order; those within others are not listed."""
        return _outermost(root, lambda x: x.id in self.main)


def _outermost(root: Node, fits: Callable[[Node], bool]) -> list[Node]:
    """Elements that fit, in page order; what they hold and what clutter holds is not looked at."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if fits(node):
            out.append(node)
        else:
            todo += [x for x in reversed(node.children) if not isinstance(x, str) and not x.clutter]
    return out


def main_text(page: str | None, template: Template | None = None) -> str:
    """The text of a page's main slots, without the template's texts.

    A page without a template, or with none of its template's main elements, is read by its own
    elements: those that it calls its main part, else the one that holds the most of its text.
    """
    root = parse(page or "")
    mains = template.slots(root) if template else []
    texts = template.texts if template else frozenset()
    if not mains:
        mains = _outermost(root, lambda x: x.main)
    if not mains:
        measure(root)
        node, whole = root, root.letters
        while whole:
            inner = [x for x in node.children if not isinstance(x, str) and not x.clutter and x.tag not in INLINE]
            best = max(inner, key=lambda x: x.letters, default=None)
            if best is None or best.tag in LEAVES or best.letters < 0.6 * whole:
                break
            node = best
        mains = [node]
    parts: list[str] = []
    for node in mains:
        _emit(node, texts, parts)
        parts.append(" ")
    return " ".join("".join(parts).split())


def _emit(node: Node, template: frozenset, parts: list[str]) -> None:
    todo: list = [iter(node.children)]
    nodes = [node]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            if nodes.pop().tag not in INLINE:
                parts.append(" ")
        elif isinstance(x, str):
            if not template or text_id(nodes[-1], " ".join(x.split())) not in template:
                parts.append(html.unescape(x))
        elif not x.clutter:
            if x.tag not in INLINE:
                parts.append(" ")
            todo.append(iter(x.children))
            nodes.append(x)
        else:
            parts.append(" ")


TOKEN = "host string, id long, up long, kind int, leaf boolean"


def templates(pages: DataFrame, support: float = 0.5, least_pages: int = 3, least_tokens: int = 2) -> DataFrame:
    """(host, template): tokens of the host's valid equivalence classes, with their letters on all pages. pages: (host, html).

    Tokens of a host belong to one class if they occur equally often on each page, that is if
    their occurrence vectors are equal; vectors are compared by two sums of hashes of (page,
    count). A class is valid if it has least_tokens tokens (elements alone count as holders) and stands on least_pages pages and on
    over the given part of the host's; texts in a main part must stand on all of them. Hosts
    need least_pages different pages. Template nests the classes into each other.
    Counts are summed on the map side; a host with a third of all pages costs a task its
    distinct tokens only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list[int]] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = xxhash.xxh64_intdigest(page or "")
                hashes: dict[int, int] = {}
                for t, (up, kind, leaf, n, letters) in tokens(parse(page or "")).items():
                    s = seen.setdefault((host, t, up, kind, leaf), [0, 0, 0, 0])
                    h = hashes.get(n)
                    if h is None:
                        h = hashes[n] = xxhash.xxh64_intdigest(f"{p}:{n}")
                    s[0] += 1
                    s[1] += h >> 32
                    s[2] += h & 0xFFFFFFFF
                    s[3] += letters
            keys, types = list(seen), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)] + [pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(4)],
                names=["host", "id", "up", "kind", "leaf", "n", "v1", "v2", "letters"])

    of = pages.groupBy("host", F.xxhash64("html").alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("differ"))
    of = stash(of.where(F.col("differ") >= least_pages))
    each = pages.select("host", "html").mapInArrow(run, f"{TOKEN}, n long, v1 long, v2 long, letters long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(30,0)")).alias(c)
    counted = stash(each.groupBy("host", "id", "up", "kind", "leaf").agg(F.sum("n").alias("n"), whole("v1"), whole("v2"), F.sum("letters").alias("letters")))
    enough = F.when(F.col("kind") == INNER_TEXT, F.col("n") == F.col("pages")).otherwise(F.col("n") > support * F.col("pages"))
    fit = counted.where(F.col("n") >= least_pages).join(of, "host").where(enough)
    classes = fit.groupBy("host", "n", "v1", "v2").agg(F.collect_list(F.struct("id", "up", "kind", "leaf", "letters")).alias("tokens"))
    # an element that shares its vector with nothing may hold what is the template's, but is no place to look for the main slots
    alone = F.transform(F.filter("tokens", lambda x: x["kind"] < TEXT), lambda x: F.struct(x["id"].alias("id"), x["up"].alias("up"), x["kind"].alias("kind"), F.lit(True).alias("leaf"), x["letters"].alias("letters")))
    valid = classes.select("host", F.when(F.size("tokens") >= least_tokens, F.col("tokens")).otherwise(alone).alias("tokens"))
    kept = valid.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens")).where(F.size("tokens") > 0)
    return kept.select("host", F.array_sort("tokens").alias("template"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """pages with `text` and `n_chars` (code points) in place of the html.

    Templates are deduced by host, over all pages; what fills a page's main slots is its
    text: character references decoded, white space inside a block made one space, blocks in
    page order with one space between. Hosts with too few different pages have no template;
    their pages, and pages that lack their template's main elements, are read by their own
    elements. Null html: empty text. Null urls share the host ''. Repeated pages each get a row
    and count each in their host's vectors; of elements that hold equally much the one with the
    greater id is taken. An empty table gives an empty result. Other columns pass through
    whatever their names; those with the names of new ones are replaced. A page is parsed in
    time and memory in proportion to its length, and its tree is held while it is read.
    """
    new = ("text", "n_chars")
    names = [c for c in pages.columns if c.lower() not in new and c != html_column]
    named = pages.select(carried(pages, names).alias("row"), host_of(pages[quoted(url)]).alias("host"), pages[quoted(html_column)].cast("string").alias("html"))
    found = stash(templates(named.select("host", "html")))
    size = found.agg(F.sum(32 * F.size("template") + F.length("host"))).first()[0] or 0
    both = named.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("row", "host", "template", "html")
    schema = T.StructType([both.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for b in batches:
            out = []
            for host, rows, page in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                if rows.is_valid and host not in held:
                    if len(held) >= 256:
                        held.clear()
                    held[host] = Template(rows.as_py())
                out.append(main_text(page.as_py(), held[host] if rows.is_valid else None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["row", *new])

    return both.mapInArrow(run, schema).select(*restored(names), *new)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
