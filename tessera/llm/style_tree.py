"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node for every path of tags
and classes, with the child layouts seen there (presentation) and the texts
seen there (content), each with the number of distinct pages.  A node whose
layouts and texts are much the same on all pages has low entropy and is
furniture; one that differs from page to page is content.  A node's importance
mixes both entropies with what the page states of its role (article, nav,
advert, comment ...), and branches of low importance are cut from each page.

Entropy cannot tell an advert that differs on every page from an article, so a
plain statement weighs more than entropy; a doubtful one, such as a class that
merely contains "legal" or "related", weighs less, and the entropy decides.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_small, map_batches, materialize

#: Weight of content against presentation falls with the number of layouts.
GAMMA = 0.9
#: Branches under this importance are cut.
THRESHOLD = 0.35
#: Entropies are taken to the base of the page count, but of this at most: a large host's nodes are no less important for its size.
MOST_BASE = 64
#: Of a branch cut by entropy, texts that this share of the pages have go; rarer ones stay.
COMMON_SHARE = 0.05
#: (host, text) rows up to which they are broadcast by host: about 40 MB.
BROADCAST_ROWS = 1_000_000

#: What a page states of a node: nothing, that it is or lies in the main text, that it is furniture, perhaps furniture, not shown.
NONE, MAIN, NOISE, DOUBT, HIDDEN = range(5)
#: Weight of the statement against entropy, and the importance it states.
WEIGHTS = {NONE: (0.0, 0.0), MAIN: (0.7, 1.0), NOISE: (0.7, 0.0), DOUBT: (0.4, 0.0), HIDDEN: (1.0, 0.0)}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded mtable mtr mtd".split()
)
_NOISE_TAGS = frozenset("head nav footer aside form button select textarea menu dialog".split())
_MAIN_TAGS = frozenset(("article", "main"))
_MAIN_WORDS = frozenset("articlebody article-body article-content post-content entry-content story-body main-content".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
#: Words that name furniture wherever they stand in a class or id.
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies "
    "popup modal comments disqus newsletter subscribe login signup pagination pager toolbar".split()
)
#: Words that name furniture alone or beside words of place, and leave doubt beside others.
_DOUBT_WORDS = frozenset(
    "banner promotion menu side foot consent notice notices notification alert overlay comment reply replies respond share sharing social related recommended "
    "subscription search widget copyright legal disclaimer".split()
)
_PLACE_WORDS = frozenset(
    "site main page user reader readers top bottom left right wrapper wrap container box area section block inner outer body item items list links link bar panel header "
    "content form thread tools buttons button icons text group row col column posts post articles article stories".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIERS = frozenset("article main section div body table ul ol dl nav aside footer header form blockquote".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|canvas)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_M64, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _stated(name: str) -> int:
    """What a class or id states."""
    parts = [p for p in _PARTS.split(name) if p]
    doubtful = _DOUBT_WORDS.intersection(parts)
    if _NOISE_WORDS.intersection(parts) or len(doubtful) > 1 or doubtful and all(p in _DOUBT_WORDS or p in _PLACE_WORDS or p.isdigit() for p in parts):
        return NOISE
    return DOUBT if doubtful else NONE


@lru_cache(maxsize=50_000)
def _describe(tag: str, attributes: str) -> tuple[str, int]:
    """(name in the tree, what the page states of the node)."""
    role, names = NONE, []
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"' \t\r\n").lower()
        if key in ("class", "id", "itemprop"):
            names += value.split()
        elif key == "role":
            role = NOISE if value in _NOISE_ROLES else MAIN if value == "main" else role
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return f"{tag}.hidden", HIDDEN
    if tag in _NOISE_TAGS:
        role = NOISE
    elif role == NONE and (tag in _MAIN_TAGS or _MAIN_WORDS.intersection(names)):
        role = MAIN
    if role in (NONE, MAIN) and tag not in ("body", "html", "article", "main"):
        found = {_stated(n) for n in names if n not in _MAIN_WORDS}
        role = NOISE if NOISE in found else DOUBT if DOUBT in found and role == NONE else role
    return tag + "." + ".".join(sorted({_DIGITS.sub("0", n) for n in names})), role


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)))


class _Open:
    """An open element: its place in the page's tree, and the rolling hashes of its child layouts and of the texts below."""

    __slots__ = ("tag", "node", "last", "layout", "text", "texts")

    def __init__(self, tag: str, node: int):
        self.tag, self.node, self.last, self.layout, self.text, self.texts = tag, node, -1, 1, 0, 0


class Page:
    """The tree of a page.  Node i has a path hash, a parent (a smaller number, -1 at the root) and a role; elements of one path and role are one node."""

    def __init__(self):
        self.path, self.parent, self.role = [0], [-1], [NONE]
        self.layout, self.text = [1], [0]
        self.blocks: list[tuple[int, str]] = []
        self._known: dict[tuple[int, str, int], int] = {}

    def node(self, parent: int, name: str, role: int) -> int:
        at = self._known.get((parent, name, role))
        if at is None:
            at = self._known[parent, name, role] = len(self.path)
            self.path.append(_hash(self.path[parent], name, role) >> 1)
            self.parent.append(parent)
            self.role.append(role)
            self.layout.append(1)
            self.text.append(0)
        return at

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        """(path, layout, content, role, parent) of every node; content tells node and text apart."""
        out = []
        for path, layout, text, role, parent in zip(self.path, self.layout, self.text, self.role, self.parent, strict=True):
            out.append((path, layout >> 1, (text ^ path * _BASE & _M64) >> 1, role, parent))
        return out

    def kept(self, low: set[int]) -> str:
        return kept_text(self.blocks, ((content, role, parent) for _, _, content, role, parent in self.rows()), low)


def kept_text(blocks: list[tuple[int, str]], nodes, low: set[int]) -> str:
    """The blocks left when nodes stated as furniture and contents in ``low`` are cut, joined; only those of the main text if there is one.

    ``nodes`` are (content, role, parent), parents first.
    """
    cut, main = [], []
    for content, role, parent in nodes:
        cut.append(role in (NOISE, HIDDEN) or content in low or parent >= 0 and cut[parent])
        main.append(role == MAIN or parent >= 0 and main[parent])
    shown = [(n, t) for n, t in blocks if not cut[n]]
    only = any(main[n] for n, _ in shown)
    return "\n".join(t for n, t in shown if main[n] or not only)


def parse_page(source: str) -> Page:
    """The tree and the blocks of a page, in time linear in its length and depth."""
    page = Page()
    stack, parts = [_Open("", 0)], []
    counts: dict[str, int] = {}  # open elements of each tag
    mains = 0  # open elements stated as main text

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                page.blocks.append((top.node, text))
                top.text = (top.text * _BASE + xxhash.xxh64_intdigest(text)) & _M64
                top.texts += 1

    def pop():
        nonlocal mains
        done = stack.pop()
        counts[done.tag] -= 1
        mains -= page.role[done.node] == MAIN
        at, above = done.node, stack[-1]
        page.layout[at] = (page.layout[at] * _BASE ^ done.layout) & _M64
        page.text[at] = (page.text[at] * pow(_BASE, done.texts, _M64 + 1) + done.text) & _M64
        if page.role[at] not in (NOISE, HIDDEN):
            above.text = (above.text * pow(_BASE, done.texts, _M64 + 1) + done.text) & _M64
            above.texts += done.texts

    def push(tag, name, role):
        nonlocal mains
        top = stack[-1]
        at = page.node(top.node, name, role)
        if at != top.last:  # a run of like children is one
            top.last, top.layout = at, (top.layout * _BASE + page.path[at]) & _M64
        stack.append(_Open(tag, at))
        counts[tag] = counts.get(tag, 0) + 1
        mains += page.role[at] == MAIN

    end_of_tags = source.rfind(">") + 1
    tokens = _TOKEN.findall(source[:end_of_tags])
    for raw, end, tag, attributes, end2, tag2, attributes2, text in tokens:
        if text:
            parts.append(text)
            continue
        tag = (tag or tag2).lower()
        if raw or not tag:
            continue
        if end or end2:
            if not counts.get(tag):
                continue
            if tag in _INLINE:
                k = len(stack) - 1
                while stack[k].tag in _INLINE and stack[k].tag != tag:
                    k -= 1
                if stack[k].tag == tag:
                    flush()
                    while len(stack) > k:
                        pop()
                continue
            flush()
            while stack[-1].tag != tag:
                pop()
            pop()
            continue
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in _VOID:
                name, role = _describe(tag, attributes or attributes2)
                if role in (NOISE, HIDDEN):  # an inline advert or hidden span is kept out of the text around it
                    flush()
                    push(tag, name, role)
            continue  # others neither break a block nor have a role
        flush()
        while stack[-1].tag in _INLINE:
            pop()
        if tag in _VOID:
            continue
        shuts = _CLOSES.get(tag, ())
        if counts.get("p") or any(counts.get(s) for s in shuts):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in shuts:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in _BARRIERS:
                    break
        name, role = _describe(tag, attributes or attributes2)
        if tag == "header" and not mains:
            role = NOISE
        if tag in ("html", "body") and role == MAIN:
            role = NONE
        push(tag, name, role)
    if end_of_tags < len(source):
        parts.append(source[end_of_tags:])
    flush()
    while len(stack) > 1:
        pop()
    page.layout[0], page.text[0] = stack[0].layout, stack[0].text
    inherit(page)
    return page


def inherit(page: Page) -> None:
    """What states nothing itself lies in the main text if its parent does, also a doubtful one."""
    inside = [False]
    for at in range(1, len(page.role)):
        role, above = page.role[at], inside[page.parent[at]]
        inside.append(role == MAIN or above and role in (NONE, DOUBT))
        if role == NONE and above:
            page.role[at] = MAIN


_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)
_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
_NODES = pa.list_(pa.struct([("path", pa.int64()), ("layout", pa.int64()), ("content", pa.int64()), ("role", pa.int32()), ("parent", pa.int32())]))
_NODES_SQL = "array<struct<path:bigint,layout:bigint,content:bigint,role:int,parent:int>>"


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page, nodes, blocks of every row; ``page`` is a hash of all that is on the page."""

    def run(batches):
        for batch in batches:
            hosts, prints, blocks, nodes = [], [], [], []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parsed = parse_page((source or b"").decode("utf-8", "replace"))
                host = _HOST.match(url or "")
                hosts.append(host[1].lower() if host else "")
                prints.append(_hash(parsed.layout[0], *(t for _, t in parsed.blocks)) >> 1)
                blocks.append([{"node": n, "text": t} for n, t in parsed.blocks])
                nodes.append([dict(zip(("path", "layout", "content", "role", "parent"), r, strict=True)) for r in parsed.rows()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(prints, pa.int64()), pa.array(nodes, _NODES), pa.array(blocks, _BLOCKS)],
                ["page_id", "url", "host", "page", "nodes", "blocks"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, page long, nodes {_NODES_SQL}, blocks array<struct<node:int,text:string>>"
    return map_batches(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html")), run, schema, rows=256)


def _value_counts(parsed: DataFrame) -> DataFrame:
    """host, path, role, kind (0 layout, 1 content), value, c: distinct pages with each value of each node; copies of a page count once."""
    pages = parsed.where(F.col("host") != "").groupBy("host", "page").agg(F.first("nodes").alias("nodes"))
    seen = pages.select("host", F.explode("nodes").alias("n"))
    values = seen.select("host", "n.path", "n.role", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("n.layout").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("n.content").alias("value")))).alias("v"))
    return values.groupBy("host", "path", "role", "v.kind", "v.value").agg(F.count("*").alias("c"))


def _importance(counts: DataFrame) -> DataFrame:
    c = F.col("c").cast("double")
    kinds = counts.groupBy("host", "path", "role", "kind").agg(F.sum("c").alias("pages"), F.sum(c * F.log(c)).alias("clogc"), F.count("*").alias("distinct"))
    m = F.col("pages").cast("double")
    kinds = kinds.withColumn("entropy", F.when(F.col("pages") <= 1, 1.0).otherwise(F.least(F.lit(1.0), (F.log(m) - F.col("clogc") / m) / F.log(F.least(m, F.lit(float(MOST_BASE)))))))
    of = lambda k, col: F.max(F.when(F.col("kind") == k, F.col(col)))
    mixed = kinds.groupBy("host", "path", "role").agg(F.max("pages").alias("pages"), of(0, "entropy").alias("layout"), of(0, "distinct").alias("layouts"), of(1, "entropy").alias("content"))
    share = F.pow(F.lit(GAMMA), F.col("layouts"))
    entropy = F.greatest(F.col("content"), (1 - share) * F.col("layout") + share * F.col("content"))
    # Few pages are little evidence: what they agree on counts less.
    shrunk = 1 - (1 - entropy) * (F.col("pages") - 1) / (F.col("pages") + 2)
    weight, stated = (F.coalesce(*[F.when(F.col("role") == r, F.lit(w[k])) for r, w in WEIGHTS.items()]) for k in (0, 1))
    return mixed.select("host", "path", "role", "pages", (weight * stated + (1 - weight) * shrunk).alias("importance"))


def node_importance(parsed: DataFrame) -> DataFrame:
    """host, path, role, pages, importance: the merged tree of every host.

    A value's entropy is taken to the base of the node's page count (MOST_BASE
    at most), so it is 0 if all pages agree and 1 if no two do; a node on one
    page only has 1.  Layouts weigh more the more of them there are, but a node
    whose own texts vary is never less important for its layouts.
    """
    return _importance(_value_counts(parsed))


def _low_contents(parsed: DataFrame) -> DataFrame:
    """host, content: texts of unimportant nodes that many of the host's pages have.  Nodes stated as furniture are cut without it."""
    counts = _value_counts(parsed)
    low = _importance(counts).where((F.col("importance") < THRESHOLD) & F.col("role").isin(NONE, DOUBT)).select("host", "path", "pages")
    common = counts.where((F.col("kind") == 1) & (F.col("c") > 1)).join(low, ["host", "path"])
    return common.where(F.col("c") >= COMMON_SHARE * F.col("pages")).select("host", F.col("value").alias("content")).distinct()


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row's main text.

    Branches of low importance are cut; if what is left holds a stated main
    text, only that counts.  Inside it a branch goes only if the page itself
    states or hints that it is furniture.  Null and empty html gives ''.
    Pages without a host are judged by what they state.  Repeated rows give
    repeated rows and, like other copies on a host, count as one page; null
    page_ids stay null; other columns are ignored.  Writes the parsed pages to
    the shared folder once.
    """
    parsed = materialize(parse_pages(pages), "parsed-pages")
    low = materialize(_low_contents(parsed), "low-contents")
    own = parsed.select("page_id", "url", "host", "page", "blocks", F.col("nodes.content").alias("content"), F.col("nodes.role").alias("role"), F.col("nodes.parent").alias("parent"))
    size = low.count()
    if size <= BROADCAST_ROWS:
        by_host = low.groupBy("host").agg(F.collect_list("content").alias("low"))
        joined = own.join(F.broadcast(by_host), "host", "left").withColumn("low", F.array_intersect("content", "low"))
    else:  # only a page's own contents are met with the table; a host may have any share of the pages
        met = join_small(own.select("host", "page", F.explode(F.array_distinct("content")).alias("content")).distinct(), low, ["host", "content"], 64 * size)
        joined = own.join(met.groupBy("host", "page").agg(F.collect_set("content").alias("low")), ["host", "page"], "left")

    def run(batches):
        for batch in batches:
            texts = []
            for blocks, content, role, parent, low in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                texts.append(kept_text([(b["node"], b["text"]) for b in blocks], zip(content, role, parent, strict=True), set(low or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    kept = map_batches(joined.select("page_id", "url", "blocks", "content", "role", "parent", "low"), run, f"page_id {kind}, url string, text string", rows=256)
    return kept.withColumn("n_chars", F.length("text").cast("long"))
