"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by path (block elements with their labels). Every node of the merged tree gets
an importance from entropies over the pages that have it: of its presentation, how its sequences of children are
spread, and of its content, how far its block texts tell pages apart. A branch without an important node is the
site's, not the page's, and is removed from each page. Menus, adverts and footers whose words change with every page
look important by entropy, so what a page itself says of a branch (its element, role, or class) comes first.

Pages are read twice. The first reading gives, of each page, numbers of nodes and of texts, equal pages of a host
once; only counts are joined over pages. The second takes the few unimportant nodes of its host along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskflow.llm.common import materialize

#: Nodes below this depth count as the node of this depth.
DEPTH = 48
#: Unimportant nodes of all hosts that are sent to every task at most; more are joined by host.
SENT_NODES = 500_000
#: A host with more than this share of all pages is dealt to several tasks in that join.
HOT_SHARE = 1000

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset((
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address header footer nav aside form fieldset legend details summary hgroup hr center "
    "option select dialog menu head").split())
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "summary"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table menu select".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
NOT_TEXT = frozenset((
    "head script style noscript template textarea title iframe noembed noframes nav aside footer form button select "
    "object svg math canvas audio video dialog menu datalist xmp").split())
# Words of class and id, and roles, that name what is not the article.
NOT_ARTICLE = frozenset((
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside widget widgets ad ads adv advert adverts "
    "advertisement advertising adsense adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login signin share sharing sharebar social related recommended "
    "recommendations comment comments commentlist disqus respond reply replies pagination pager toolbar topbar masthead skip "
    "copyright disclaimer outbrain taboola teaser teasers").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES_OF_BODY = frozenset(("content main-content article article-body article-content articlebody post-content post-body entry-content "
                           "story story-body page-content maincontent").split())

_TOKEN = re.compile(
    r"<!--.*?-->|<!--.*\Z|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]{0,2000}\"|'[^']{0,2000}'){0,200}+)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _words(value: str) -> set[str]:
    """Words of class and id names; a name that only says what a wrapper has or lacks names nothing."""
    words: set[str] = set()
    for name in value.split():
        if not name.lower().startswith(("has-", "no-", "with-", "without-", "is-", "has_", "no_", "with_")):
            words.update(p.lower() for p in _PARTS.findall(name))
    return words


@dataclass
class Block:
    """A text between two block borders: its node, the region (2 main, 1 article, 0 neither; -1 named body), and text."""

    node: int
    tag: str
    region: int
    linked: bool
    text: str


@dataclass
class Page:
    """What the page's own markup leaves: blocks of text, and for each node its ancestors and children."""

    blocks: list[Block] = field(default_factory=list)
    ancestors: dict[int, tuple[int, ...]] = field(default_factory=dict)
    children: dict[int, list[str]] = field(default_factory=dict)
    #: An article stands inside an element whose name says that it is no part of the article.
    lost: bool = False

    def chosen(self) -> list[Block]:
        """The blocks inside main; or, without any, inside articles; or inside what a name calls the content; or all,
        but for list items and the like that are links and nothing else."""
        for wanted in (2, 1, -1):
            inside = [b for b in self.blocks if b.region == wanted]
            if inside:
                return inside
        return [b for b in self.blocks if not (b.linked and b.tag not in ("p", "h1", "h2", "h3"))]


@dataclass
class _Open:
    tag: str
    node: int
    depth: int
    block: bool
    dropped: str
    region: int
    link: bool


class Reader:
    """Reads pages into blocks; node numbers of paths met before are remembered."""

    def __init__(self) -> None:
        self._nodes: dict[tuple[int, str], int] = {}
        self._known: dict[tuple[str, str], tuple[str, str, str]] = {}

    def _node(self, parent: int, label: str) -> int:
        key = (parent, label)
        if key not in self._nodes:
            if len(self._nodes) > 200_000:
                self._nodes.clear()
            self._nodes[key] = _number(parent, label)
        return self._nodes[key]

    def _read_attributes(self, tag: str, text: str) -> tuple[str, str, str]:
        """(label, why it is no part of the article or '', kind of region or '')."""
        found = {}
        for name, a, b, c in _ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), unescape(a or b or c))
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        label = f"{tag}.{re.sub(r'[0-9]+', '#', names)}" if names else tag
        role = found.get("role", "").lower()
        why = ""
        if tag not in ("html", "body", "main"):
            words = _words(names)
            if tag == "article":
                words &= {"comment", "comments", "reply", "respond"}
            if words & NOT_ARTICLE or role in ROLES:
                why = "name"
            elif "header" in words:
                why = "header"
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
            why = "hidden"
        region = "main" if role == "main" else "article" if "articlebody" in found.get("itemprop", "").lower() or role == "article" else ""
        if not region and set(names.lower().replace("_", "-").split()) & NAMES_OF_BODY:
            region = "named"
        return label, why, region

    def _attributes(self, tag: str, text: str) -> tuple[str, str, str]:
        if not text or not _ATTRIBUTE.search(text):
            return tag, "", ""
        key = (tag, text)
        if key not in self._known:
            if len(self._known) > 20_000:
                self._known.clear()
            self._known[key] = self._read_attributes(tag, text)
        return self._known[key]

    def read(self, html: str) -> Page:
        """The page's blocks. Where names of wrappers leave nothing of a page with an article, they are not believed."""
        page = self._read(html, True)
        return self._read(html, False) if page.lost and not page.blocks else page

    def _read(self, html: str, names: bool) -> Page:
        page = Page()
        root = self._node(0, "")
        page.children[root] = []
        stack = [_Open("", root, 0, True, "", 0, False)]
        counts: dict[str, int] = {}
        pieces: list[str] = []
        chars = linked = 0

        def flush() -> None:
            nonlocal chars, linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    top = next(o for o in reversed(stack) if o.block)
                    page.blocks.append(Block(top.node, top.tag, top.region, linked * 10 >= chars * 9, text))
                pieces.clear()
            chars = linked = 0

        def pop_to(tag: str) -> None:
            while True:
                top = stack.pop()
                counts[top.tag] -= 1
                if top.tag == tag:
                    return

        def add(text: str) -> None:
            nonlocal chars, linked
            top = stack[-1]
            if top.dropped or not text:
                return
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            size = len(text.strip())
            chars += size
            linked += size if top.link else 0

        at, end = 0, html.rfind(">") + 1
        while at < end:
            match = _TOKEN.search(html, at, end)
            if match is None:
                break
            add(html[at:match.start()])
            at = match.end()
            if match[0].startswith("<!--") and not match[0].endswith("-->"):
                at = len(html)
                break
            closing = match[1]
            if closing:
                tag = closing.lower()
                if tag in BLOCK:
                    flush()
                if counts.get(tag):
                    pop_to(tag)
                continue
            name = match[2] or match[4]
            if not name:
                continue
            tag, attributes = name.lower(), match[3] or match[5] or ""
            if tag == "br":
                add(" ")
                continue
            block = tag in BLOCK
            if block:
                flush()
            if counts.get("head") and tag not in IN_HEAD:
                pop_to("head")
            if tag in CLOSES_P and counts.get("p"):
                pop_to("p")
            if tag in SIBLINGS:
                # An item ends the open item of its own list, not that of a list around it.
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in SIBLINGS[tag]:
                        ended = stack[k]
                        while stack[-1] is not ended:
                            counts[stack.pop().tag] -= 1
                        counts[stack.pop().tag] -= 1
                        if tag != "tr":
                            break
                    elif stack[k].tag in CONTAINERS:
                        break
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                if close is None:
                    at = end = len(html)
                    break
                at = html.find(">", close.end()) + 1 or len(html)
                continue
            if tag in VOID:
                continue
            top = stack[-1]
            label, why, kind = self._attributes(tag, attributes)
            why = why if names or why != "name" else ""
            if tag in NOT_TEXT:
                why = "form" if tag == "form" else why or "element"
            elif tag == "header" and not why:
                why = "header"
            if why == "header" and top.region > 0:
                why = ""
            dropped = top.dropped or why
            if not why and (tag == "article" and top.dropped == "form" or tag == "main" and top.dropped in ("form", "name")):
                dropped = ""  # a form or a layout around the whole page
            page.lost |= tag == "article" and not why and top.dropped == "name"
            region = top.region
            if tag == "main" or kind == "main":
                region = 2
            elif (tag == "article" or kind == "article") and region < 1:
                region = 1
            elif kind == "named" and region == 0:
                region = -1
            node, depth = top.node, top.depth
            if block and depth < DEPTH:
                node, depth = self._node(node, label), depth + 1
                if not dropped:
                    children = page.children.setdefault(top.node, [])
                    if not children or children[-1] != label:
                        children.append(label)
                    page.children.setdefault(node, [])
                    if node not in page.ancestors:
                        page.ancestors[node] = (*page.ancestors.get(top.node, ()), top.node)
            stack.append(_Open(tag, node, depth, block, dropped, region, top.link or tag == "a"))
            counts[tag] = counts.get(tag, 0) + 1
        if at < len(html):
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the end of the page cuts off
            add(rest[:cut.start()] if cut else rest)
        flush()
        return page


HOST = r"^.*?://([^/?#]*)"


def host_of(url: Column) -> Column:
    """The part after the first :// up to /, ? or #, lower-cased; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, "(?s)" + HOST, 1), F.lit("")))


def style_tree(pages: DataFrame, min_pages: int = 8, threshold: float = 0.25, damping: float = 0.9) -> DataFrame:
    """host, node, m (pages that have it), importance, branch (the greatest importance in it) of the merged trees.

    Pages of a host that equal each other in all that their own markup leaves count once. Pages without a host
    are not merged. A node of fewer than min_pages pages has importance 1: too little is known of it.
    presentation: entropy of the node's sequences of children to the base m, times 1 - damping^(number of sequences).
    content: 1 less the mean entropy, to the base m, of the node's texts over the pages that hold them.
    """
    schema = "host string, page long, nodes array<long>, kinds array<boolean>, features array<long>, parents array<array<long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        arrow = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        for batch in batches:
            for start in range(0, len(batch), 256):
                part, out = batch.slice(start, 256), []
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = reader.read(html or "")
                    rows = [(node, True, _number(*kids), page.ancestors.get(node, ())) for node, kids in page.children.items()]
                    texts = dict.fromkeys((b.node, _number(b.text)) for b in page.chosen())
                    rows += [(node, False, text, ()) for node, text in texts]
                    same = _number(*(n for b in page.chosen() for n in (b.node, b.text)))
                    out.append((host, same, *map(list, zip(*rows))) if rows else (host, same, [], [], [], []))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, arrow)],
                                                 [f.split()[0] for f in schema.split(", ")])

    seen = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).filter("host <> ''").mapInArrow(run, schema)
    once = seen.groupBy("host", "page").agg(*[F.first(c).alias(c) for c in ("nodes", "kinds", "features", "parents")])
    each = once.select("host", F.explode(F.arrays_zip("nodes", "kinds", "features", "parents")).alias("x")).select(
        "host", F.col("x.nodes").alias("node"), F.col("x.kinds").alias("style"), F.col("x.features").alias("feature"), F.col("x.parents").alias("parents"))
    counted = each.groupBy("host", "node", "style", "feature").agg(F.count(F.lit(1)).alias("n"), F.first("parents").alias("parents"))
    n, style = F.col("n"), F.col("style")
    nodes = counted.groupBy("host", "node").agg(
        F.sum(F.when(style, n)).alias("m"), F.sum(F.when(style, n * F.log("n"))).alias("spread"), F.sum(style.cast("int")).alias("styles"),
        F.sum(F.when(~style, F.log("n"))).alias("held"), F.sum((~style).cast("int")).alias("texts"),
        F.max_by("parents", style).alias("parents"))
    base = F.log(F.greatest(F.col("m"), F.lit(2)))
    presentation = (1 - F.pow(F.lit(damping), F.col("styles"))) * (1 - F.col("spread") / F.col("m") / base)
    content = F.when(F.col("texts") > 0, 1 - F.col("held") / F.col("texts") / base).otherwise(0.0)
    own = F.when(F.col("m") < min_pages, 1.0).otherwise(F.greatest(presentation, content))
    scored = nodes.select("host", "node", "m", own.alias("importance"), "parents")
    up = scored.select("host", F.explode(F.concat(F.array("node"), "parents")).alias("node"), F.col("importance").alias("inside"),
                       F.col("node").alias("from"), "m", "importance")
    mine = F.col("from") == F.col("node")
    tree = up.groupBy("host", "node").agg(
        F.max(F.when(mine, F.col("m"))).alias("m"), F.max(F.when(mine, F.col("importance"))).alias("importance"), F.max("inside").alias("branch"))
    return tree.withColumn("low", F.col("branch") < threshold)


def extract(pages: DataFrame, min_pages: int = 8, threshold: float = 0.25, sent_nodes: int = SENT_NODES) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html; other columns are passed over).

    A null or empty html has an empty text; a null url has no host, so only the page's own markup counts, as for a
    host with fewer than min_pages different pages. Rows that repeat come back as often as they are there. Character
    references are decoded, runs of white space (as of Python's str.split) inside a block become a space, blocks
    are joined by one in page order. Elements that a cut-off page leaves open end with it. A page of any length is
    read whole. An empty table gives an empty result.
    """
    tree = materialize(style_tree(pages, min_pages, threshold).filter("low").select("host", "node"), "style-tree")
    lows = tree.groupBy("host").agg(F.collect_set("node").alias("low"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    if tree.count() <= sent_nodes:
        joined = rows.join(F.broadcast(lows), "host", "left")
    else:
        # At most HOT_SHARE hosts have more than that share of all pages.
        total = max(1, rows.count())
        hot = rows.groupBy("host").count().filter(F.col("count") * HOT_SHARE > total).select(
            "host", F.ceil(F.col("count") * HOT_SHARE / total).cast("int").alias("parts"))
        parted = lows.join(F.broadcast(hot), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int"))
        joined = dealt.drop("parts").join(parted.select("host", "part", "low"), ["host", "part"], "left")
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for start in range(0, len(batch), 256):
                part, texts = batch.slice(start, 256), []
                for html, low in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    gone = set(low or ())
                    blocks = reader.read(html or "").chosen()
                    # A headline inside the article is the page's own, however alike the pages of a host are.
                    texts.append(" ".join(b.text for b in blocks if b.node not in gone or (b.tag == "h1" and b.region > 0)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "low").mapInArrow(run, schema)
