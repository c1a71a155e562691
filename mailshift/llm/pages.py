"""Main text of web pages by site style trees (operator 9).

Method: the pages of a host are merged into one style tree.  A node of it is a block
element, named by the way to it (tags, classes and ids without digits).  Its
presentations are the sequences of its child elements, its contents the texts
right in it; both are counted over the host's different pages.  Their entropies say
how much the node matters, as a share of the entropy of pages that all differ: this
share stays the same as a host grows.  The importance of a branch is that of its
presentation and of all contents below it, weighed by GAMMA to the number of
children: a part that says the same few things on every page is of little.  A text
in a branch under ``LOW`` is removed where it is common, that is on at least ``COMMON`` of
the pages that have its node; outside ``article`` and ``main`` a text on more than 1 - ``LOW`` of
them is removed in any branch.  What only few pages say thus stays, and a subheading
(h2 to h6) stays with the text it heads.

What pages mark adds to that.  Elements and roles that mean a menu, header, footer, aside or
form are no part of the article.  A class or id with a name of ``NOISE_NAMES`` is evidence, never
enough by itself: it counts two if it is made of such names alone, else one, and a branch goes with
three.  One more each count: that it holds at most half of the text around it; that the tree
shows it to be a fixture, on most pages of the host and of even presentation; and, where the host has
no say, that it stands outside the page's ``article`` or ``main``.  Of what is left, the text in
``article`` (else ``main``) is the main text, unless ``TEASER`` times as much stands outside.  A host of
under ``LEAST_PAGES`` different pages has no say, and a page never loses all of its text to
entropy.

Pages are parsed where they are read.  Only hashes go into the merge, counted in
each task first, so the pages of a hot host never meet; what comes back for each
host is its list of low branches, common texts and fixtures, which is small: it is broadcast if it has
at most ``SMALL`` entries in all, and joined on host and salt otherwise, with the same result.

Defined results: null and empty pages have an empty text; a null or odd url counts as
host '' (such pages form one tree); equal rows are extracted each for itself, but
count once in a tree; unclosed, misnested and unknown elements are read on as
browsers do, an unclosed comment or script to the end; an empty table gives no rows;
other columns are carried along by ``with_main_text``, but for one named ``text``, which the result replaces.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep

GAMMA, LOW, LEAST_PAGES, COMMON = 0.9, 0.4, 10, 0.05
TEASER, ENOUGH = 2, 3  # times the text of an article that may stand outside it; evidence that removes a named branch
SMALL, SALTS = 100_000, 32
LISTS = "low", "common", "usual", "fixtures"

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td
textarea tfoot th thead title tr ul""".split())
RAW = frozenset("iframe noembed noframes noscript object script style svg template textarea title xmp canvas audio video math".split())
#: What an opening tag closes if it is open in the same list, table or paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
          "body": {"head"}}
SUBHEADINGS = frozenset("h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("ul ol menu dir dl table select article section div main aside nav header footer form body html blockquote td th".split())

# Names by which pages mark what is no part of the article.
NOISE_TAGS = frozenset("aside button dialog fieldset footer form head header menu nav search select".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_NAMES = frozenset("""ad ads adslot adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination
popup promo promoted promotion recommended related replies reply respond share sharebar sharing sidebar signup sitenav social sponsor sponsored
subscribe subscription taboola toolbar topbar widget widgets""".split())

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?+[a-zA-Z](?:[^>"']|"[^"]*+"|'[^']*+')*+>|</?+[a-zA-Z][^>]*+>""", re.S)
_NAME = re.compile(r"</?([^\s/>]+)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """A block element: where it stands, what it is made of, and the texts right in it."""

    __slots__ = ("tag", "parent", "path", "children", "texts", "noise", "named", "main")

    def __init__(self, tag: str, parent: Node | None, path: str, noise: bool, named: int) -> None:
        self.tag, self.parent, self.path, self.noise, self.named = tag, parent, path, noise, named
        self.children: list[str] = []
        self.texts: list[str] = []
        self.main = False


def _marked(tag: str, told: dict[str, str]) -> bool:
    """Whether an element means by itself that it is no part of an article, or is hidden."""
    if tag in ("html", "body", "main", "article") and not told:
        return False
    if tag in NOISE_TAGS or told.get("role", "").lower() in NOISE_ROLES or "hidden" in told or told.get("aria-hidden") == "true":
        return True
    return tag not in ("html", "body", "main") and "display:none" in told.get("style", "").replace(" ", "").lower()


def _named(tag: str, told: dict[str, str]) -> int:
    """2 if a class or id is made of names of noise alone, 1 if one holds such a name, else 0."""
    if tag in ("html", "body", "main"):
        return 0
    found = 0
    for name in [*told.get("class", "").split(), *told.get("id", "").split()]:
        parts = {x.lower() for x in _NAMES.findall(name)}
        if not parts.isdisjoint(NOISE_NAMES):
            found = max(found, 2 if parts <= NOISE_NAMES else 1)
    return found


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The block elements of a page, and its blocks of text, both in page order."""
    root = Node("#", None, "", False, 0)
    nodes, blocks, stack, run = [root], [], [root], []
    opened = [("#", root)]  # every open element, inline ones too, with its block

    def close_run() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                here = opened[-1][1]
                here.texts.append(text)
                blocks.append((here, text))

    def pop_to(k: int) -> None:
        if any(name in BLOCK for name, _ in opened[k:]):
            close_run()
        del opened[k:]

    at, lowered = 0, None
    while True:
        m = _TOKEN.search(page, at)
        run.append(page[at:m.start()] if m else page[at:])
        if m is None:
            break
        token, at = m[0], m.end()
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                run.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag == "br" or tag == "p" and all(name != "p" for name, _ in opened):
                close_run()
                continue
            for k in range(len(opened) - 1, 0, -1):
                if opened[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and opened[k][0] in BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                lowered = lowered if lowered is not None else page.lower() if len(page.lower()) == len(page) else page
                end = lowered.find("</" + tag, at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                close_run()
            continue
        if tag in BLOCK:
            close_run()
            closes = CLOSES.get(tag, frozenset())
            for k in range(len(opened) - 1, 0, -1):
                name = opened[k][0]
                if name == "p" or name in closes:
                    pop_to(k)
                    if name == "p" and not closes:
                        break
                elif name in HOLDERS and not (tag in ("tr", "thead", "tbody", "tfoot") and name in ("td", "th")):
                    break
            told = {x[1].lower(): html.unescape(x[2] or x[3] or x[4] or "") for x in _ATTRIBUTE.finditer(token[len(tag) + 1:-1])} if len(token) > len(tag) + 2 else {}
            above = opened[-1][1]
            signature = tag
            if told:
                signature += "".join(f"{mark}{_DIGITS.sub('', ' '.join(sorted(told[key].split())))}" for mark, key in (("#", "id"), (".", "class")) if told.get(key))
            noise = _marked(tag, told)
            if noise and tag == "header" and _within(above, ("article", "main")):
                noise = False  # the heading of an article belongs to it
            node = Node(tag, above, f"{above.path}/{signature}", noise, _named(tag, told))
            above.children.append(signature)
            nodes.append(node)
            opened.append((tag, node))
            if tag in ("article", "main"):
                up = above
                while up is not None and not up.main:
                    up.main = True
                    up = up.parent
        else:
            opened.append((tag, opened[-1][1]))
    close_run()
    return nodes, blocks


def _within(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _kept(node: Node) -> bool:
    """Whether no element on the way to a node means noise; what wraps the article is none, whatever it is called."""
    up: Node | None = node
    while up is not None:
        if up.noise and not (up.main and up.tag not in NOISE_TAGS):
            return False
        up = up.parent
    return True


def path_hash(path: str) -> int:
    return int.from_bytes(blake2b(path.encode(), digest_size=8).digest(), "big", signed=True)


def text_hash(path: str, text: str) -> int:
    return path_hash(f"{path}\n{text}")


Blocks = list[tuple[Node, str]]


def _scope(node: Node | None) -> Node | None:
    """The article or main element that a node stands in."""
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node


def _unmarked(blocks: Blocks, fixtures: Collection[int] = (), say: bool = False) -> Blocks:
    """The blocks that neither their elements nor enough evidence against a name make noise."""
    blocks = [(n, t) for n, t in blocks if _kept(n)]
    held: dict[int, list] = {}  # named nodes: node, text in it
    around: dict[int | None, int] = {}  # text in each article or main, and on the page
    for n, t in blocks:
        scope, up = _scope(n), n
        around[None] = around.get(None, 0) + len(t)
        if scope is not None:
            around[id(scope)] = around.get(id(scope), 0) + len(t)
        while up is not None:
            if up.named and not up.main:
                held.setdefault(id(up), [up, 0])[1] += len(t)
            up = up.parent
    gone = set()
    for node, size in held.values():
        scope = _scope(node.parent)
        total = around[None if scope is None else id(scope)]
        outside = not say and scope is None and _scope(node) is None and len(around) > 1
        if node.named + (2 * size <= total) + (path_hash(node.path) in fixtures if fixtures else False) + outside >= ENOUGH:
            gone.add(id(node))
    return [(n, t) for n, t in blocks if not _in_any(n, gone)] if gone else blocks


def _in_any(node: Node | None, gone: set[int]) -> bool:
    while node is not None:
        if id(node) in gone:
            return True
        node = node.parent
    return False


def _chosen(blocks: Blocks) -> Blocks:
    """The blocks in article elements, or in main; all of them if much more stands outside."""
    for tags in (("article",), ("main",)):
        inside = [(n, t) for n, t in blocks if _within(n, tags)]
        size = sum(len(t) for _, t in inside)
        if inside and sum(len(t) for _, t in blocks) - size <= TEASER * size:
            return inside
    return blocks


def main_text(page: str | None, low: Collection[int] = (), common: Collection[int] = (), usual: Collection[int] = (), fixtures: Collection[int] = (), say: bool = False) -> str:
    """The main text of a page, given hashes of its host: low branches, common texts, those on most pages, and fixtures; and whether the host has a say."""
    if not page:
        return ""
    blocks = _unmarked(parse(page)[1], fixtures, say)
    if common or usual:
        seen: dict[str, bool] = {}

        def in_low(node: Node | None) -> bool:
            if node is None or node.tag in ("#", "html", "body"):
                return False
            if node.path not in seen:
                seen[node.path] = path_hash(node.path) in low or in_low(node.parent)
            return seen[node.path]

        gone = [((h := text_hash(n.path, t)) in usual or h in common) and (in_low(n) or h in usual and _scope(n) is None) for n, t in blocks]
        for k in range(len(blocks) - 2, -1, -1):
            if gone[k] and blocks[k][0].tag in SUBHEADINGS and _below(blocks[k + 1][0], blocks[k][0].parent):
                gone[k] = gone[k + 1]  # a subheading goes with what it heads
        blocks = [x for x, out in zip(blocks, gone) if not out] or blocks
    return " ".join(t for _, t in _chosen(blocks))


def _below(node: Node | None, top: Node | None) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def style_nodes(pages: DataFrame) -> DataFrame:
    """From host and html: for each node of each page its path, way (paths from the root to it), children, presentation, content, single texts, whether it bears a name of noise, and the page's fingerprint."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("path", pa.int64()), ("way", pa.list_(pa.int64())), ("children", pa.int32()),
                        ("presentation", pa.int64()), ("content", pa.int64()), ("texts", pa.list_(pa.int64())), ("named", pa.bool_())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}

        def named(path: str) -> int:
            if path not in hashes:
                if len(hashes) > 100_000:
                    hashes.clear()
                hashes[path] = path_hash(path)
            return hashes[path]

        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = page.as_py()
                if not text:
                    continue
                nodes, blocks = parse(text)
                merged: dict[str, tuple[Node, list[str], list[str]]] = {}
                for node in nodes[1:]:
                    told = merged.setdefault(node.path, (node, [], []))
                    told[1].extend(c for k, c in enumerate(node.children) if not k or node.children[k - 1] != c)
                    told[2].extend(node.texts)
                # Copies of a page, with other marked adverts perhaps, are one page of the tree: it is known by all that the marks leave.
                fingerprint = path_hash("\n".join(t for _, t in _chosen(_unmarked(blocks))))
                removable: dict[str, set[int]] = {}
                for node, said in blocks:
                    if _kept(node):
                        removable.setdefault(node.path, set()).add(text_hash(node.path, said))
                for path, (node, children, texts) in merged.items():
                    way, up = [], node
                    while up is not None and up.path:
                        way.append(named(up.path))
                        up = up.parent
                    row = (host, fingerprint, named(path), way, len(children), named("\n".join(children)), path_hash("\n".join(texts)) if texts else None,
                           sorted(removable.get(path, ())), node.named > 0)
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return pages.select("host", "html").mapInArrow(
        emit, "host string, page bigint, path bigint, way array<bigint>, children int, presentation bigint, content bigint, texts array<bigint>, named boolean")


def low_branches(pages: DataFrame) -> DataFrame:
    """For each host, hashes: low, the branches of its style tree of low importance; common, the texts that many pages have; usual, those that most have; fixtures, the named branches that most have in even presentation.

    A host of too few pages has no row.
    """
    nodes = style_nodes(pages).groupBy("host", "path", "page").agg(*[F.max(c).alias(c) for c in ("way", "children", "presentation", "content", "texts", "named")])
    # Each presentation, content and single text of a node, with the number of different pages that have it.
    kinds = F.concat(F.array(F.struct(F.lit("p").alias("kind"), F.col("presentation").alias("value")), F.struct(F.lit("c").alias("kind"), F.col("content").alias("value"))),
                     F.transform("texts", lambda x: F.struct(F.lit("t").alias("kind"), x.alias("value"))))
    values = (nodes.select("host", "path", "way", "children", "named", F.inline(kinds)).where(F.col("value").isNotNull())
              .groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("children").alias("children"), F.max("way").alias("way"), F.max("named").alias("named")))
    # What one page alone has adds to the sums only: one row for each node and kind.
    values = keep(values.withColumn("value", F.when(F.col("n") > 1, F.col("value"))).groupBy("host", "path", "kind", "value")
                  .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.max("children").alias("children"), F.max("way").alias("way"), F.max("named").alias("named")))

    def of(kind: str, column: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col(column)))

    def share(kind: str) -> Column:
        """The entropy against that of pages which all differ; it does not fall as pages are added in the same proportions."""
        n = of(kind, "n")
        return F.when(n > 1, (F.log(n) - of(kind, "n_log_n") / n) / F.log(n)).when(n == 1, 1.0)

    node = keep(values.groupBy("host", "path").agg(of("p", "n").alias("pages"), share("p").alias("presentation"), share("c").alias("content"),
                                                   F.max("children").alias("children"), F.max("way").alias("way"), F.max("named").alias("named")))
    # Contents count for all the branches that they are in.
    inside = (node.where(F.col("content").isNotNull()).select("host", F.explode("way").alias("path"), "pages", "content")
              .groupBy("host", "path").agg((F.sum(F.col("pages") * F.col("content")) / F.sum("pages")).alias("below")))
    own = F.pow(F.lit(GAMMA), F.col("children"))
    importance = (1 - own) * F.col("presentation") + own * F.col("below")
    held = node.where(F.col("pages") >= LEAST_PAGES)
    branches = held.join(inside, ["host", "path"]).where(importance < LOW).select("host", F.lit("low").alias("list"), F.col("path").alias("value"))
    texts = (values.where((F.col("kind") == "t") & F.col("value").isNotNull()).select("host", "path", "value", "n").join(held.select("host", "path", "pages"), ["host", "path"])
             .where(F.col("n") >= COMMON * F.col("pages"))
             .select("host", F.when(F.col("n") > (1 - LOW) * F.col("pages"), "usual").otherwise("common").alias("list"), "value"))
    # Every node under html counts its own pages; those of the host are the most that any node has.
    hosts = held.groupBy("host").agg(F.max("pages").alias("all_pages"))
    fixtures = (held.where("named").join(hosts, "host").where((F.col("pages") > (1 - LOW) * F.col("all_pages")) & (F.col("presentation") < LOW))
                .select("host", F.lit("fixtures").alias("list"), F.col("path").alias("value")))
    said = hosts.select("host", F.lit("say").alias("list"), F.lit(0).cast("bigint").alias("value"))
    return branches.union(texts).union(fixtures).union(said).groupBy("host").agg(*[F.collect_set(F.when(F.col("list") == x, F.col("value"))).alias(x) for x in LISTS])


def with_main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", small: int = SMALL) -> DataFrame:
    """Add text, the main text of each page."""
    host, salt, known = (fresh(pages, x) for x in ("host", "salt", "known"))
    rows = pages.withColumn(host, host_of(F.col(f"`{url_col}`")))
    low = keep(low_branches(rows.select(F.col(host).alias("host"), F.col(f"`{html_col}`").alias("html"))).select(F.col("host").alias(host), F.struct(*LISTS).alias(known)))
    entries = sum((F.size(f"{known}.{x}") for x in LISTS), F.lit(1))
    if low.agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0] <= small:
        rows = rows.join(F.broadcast(low), host, "left")
    else:
        dealt = low.withColumn(salt, F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(f"`{html_col}`"), F.lit(SALTS)).cast("int")).join(dealt, [host, salt], "left")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, *lists in batches:
            yield pd.Series([main_text(t, *[frozenset() if x is None else frozenset(x) for x in known], say=known[0] is not None) for t, *known in zip(texts, *lists)], dtype=object)

    text = extract(F.col(f"`{html_col}`"), *[F.col(f"{known}.{x}") for x in LISTS])
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"], text.alias("text"))
