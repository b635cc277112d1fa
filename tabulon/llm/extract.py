"""Main text of web pages with site style trees."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .urls import host_and_path

_RAW = r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|template|iframe|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
_TOKEN = re.compile(
    _RAW + r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<odd></?[a-z])[^>]*>|<[!?/][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
#: The same for pages whose quotes don't pair: a tag ends at the next ``>``.
_TOKEN_UNQUOTED = re.compile(_RAW + r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>[^>]*)>|(?P<odd>(?!))|<[!?/][^>]*>""", re.DOTALL | re.IGNORECASE)
#: Tags without paired quotes after which a page is read by the second pattern, so that parsing stays linear.
ODD_TAGS = 32
#: Elements nested deeper belong to the one at this depth.
DEPTH = 128
#: One attribute, whole: what is found next starts behind its value.
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold article text.
DROPPED = frozenset("aside button datalist dialog fieldset footer form head input label legend menu meter nav object option optgroup output progress select".split())
#: Words of class, id and role that mark what isn't the article, where a token has no other words.
NOISE = frozenset(
    "ad ads advert adverts advertisement sponsored sponsor promo banner cookie cookies consent gdpr notice notices disclaimer sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond social subscribe newsletter signup popup modal overlay recommended teaser widget pagination pager toolbar".split()
)
#: Elements that no class makes noise and no tree removes, as they hold the article.
HOLDERS = frozenset(("html", "body", "main"))
UNJUDGED = HOLDERS | {"article", ""}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P = frozenset(("p",))
_SCOPES = frozenset("article section div td th body blockquote li main aside nav footer header form figure dd".split())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


def _hash(*parts) -> int:
    x = xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _copy(source: str | None) -> int:
    """The hash of a page that Spark's xxhash64 gives."""
    x = xxhash.xxh64_intdigest((source or "").encode("utf-8", "surrogatepass"), 42)
    return x - (1 << 64) if x >> 63 else x


class Element(NamedTuple):
    """An open element: its path in the host's tree, the paths around it that a tree may judge (its own last),
    noise by tag, the elements around that are noise by class, whether in article or main, in a link; its children's tags."""

    tag: str
    path: int
    judged: tuple[int, ...]
    noise: bool
    named: frozenset[int]
    article: bool
    link: bool
    children: list[str]


class Block(NamedTuple):
    """A block of text: path, judged paths, text, in article or main, noise by markup, mostly links."""

    path: int
    judged: tuple[int, ...]
    text: str
    article: bool
    noise: bool
    linked: bool


class Page:
    """Blocks and element styles of a page, by one pass over its tags.

    ``blocks`` in page order; ``styles``: for each element path a hash of its sequences of
    child tags; ``inner``: the paths of elements in article or main. A path is the hash of the
    chain of tags with their classes, so elements of pages of one host that look alike meet in
    one node of its tree. An element around an article or main isn't noise by its class; text in an
    inline element that is noise is left out of its block.
    """

    def __init__(self, source: str | None):
        self.found: list[tuple[Element, list[tuple]]] = []
        self.named, self.holders = 0, set()
        self.styles: dict[int, int] = {}
        self.inner: set[int] = set()
        self.text: list[tuple[str, Element]] = []
        self.stack = [Element("", 0, (), False, frozenset(), False, False, [])]
        self.open: dict[str, int] = {}
        self.deeper: dict[str, int] = {}
        at, odd, token, source = 0, 0, _TOKEN, source or ""
        end = source.rfind(">") + 1  # behind the last one no tag can end
        while m := token.search(source, at, end):
            if m.start() > at:
                self.text.append((source[at : m.start()], self.stack[-1]))
            at = m.end()
            tag = (m["tag"] or "").lower()
            if tag:
                if m["end"]:
                    self.close(tag)
                else:
                    self.start(tag, m["attrs"])
            elif m["odd"]:
                odd += 1
                token = _TOKEN_UNQUOTED if odd >= ODD_TAGS else token
        if at < len(source):
            self.text.append((source[at:], self.stack[-1]))
        self.flush()
        while len(self.stack) > 1:
            self.pop()
        self.blocks = [b for at, pieces in self.found if (b := self.block(at, pieces))]

    def block(self, at: Element, pieces: list[tuple[str, Element]]) -> Block | None:
        noisy = lambda e: e.noise or not e.named <= self.holders
        noise = noisy(at)
        kept = pieces if noise else [p for p in pieces if not noisy(p[1])]
        text = " ".join(entities.unescape("".join(t for t, _ in kept)).split())
        links = sum(len(t) for t, e in kept if e.link)
        return Block(at.path, at.judged, text, at.article, noise, 2 * links > sum(len(t) for t, _ in kept)) if text else None

    def flush(self) -> None:
        if self.text:
            i = len(self.stack) - 1
            while i and self.stack[i].tag not in BLOCKS:
                i -= 1
            self.found.append((self.stack[i], self.text))
            self.text = []

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.flush()
            closed = CLOSES.get(tag, _P)
            if any(self.open.get(c) for c in closed):
                scope = SCOPES.get(tag) or _SCOPES - closed
                i = len(self.stack) - 1
                while i and self.stack[i].tag not in closed and self.stack[i].tag not in scope:
                    i -= 1
                if self.stack[i].tag in closed:
                    self.cut(i)
        elif tag == "br":
            self.text.append(("\n", self.stack[-1]))
        if tag in VOID:
            return
        if len(self.stack) >= DEPTH:
            self.deeper[tag] = self.deeper.get(tag, 0) + 1
            return
        top = self.stack[-1]
        noise, named, article = top.noise, top.named, top.article
        top.children.append(tag)
        marks, own = "", False
        if attrs:
            for name, *values in _ATTR.findall(attrs):
                name = name.lower()
                if name not in ("class", "id", "role", "hidden", "aria-hidden"):
                    continue
                value = "".join(values).lower()
                if name == "hidden" or (name == "aria-hidden" and value == "true"):
                    noise = True
                elif name != "aria-hidden":
                    if name != "id":
                        marks += " " + value
                    for word in value.split():
                        words = set(_PART.findall(word))
                        own = own or bool(words) and (words <= NOISE or (not article and words == {"header"}))
        noise = noise or tag in DROPPED or (tag == "header" and not article)
        if tag in ("article", "main") and not article and not (own and tag == "article"):
            self.holders |= named
        if own and tag not in HOLDERS:
            self.named += 1
            named = named | {self.named}
        article = article or tag == "article" or tag == "main"
        path, judged = top.path, top.judged
        if tag in BLOCKS or marks:
            path = _hash(path, tag, marks)
            judged = judged if tag in UNJUDGED else (*judged, path)
            if article:
                self.inner.add(path)
        self.stack.append(Element(tag, path, judged, noise, named, article, top.link or tag == "a", []))
        self.open[tag] = self.open.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.deeper.get(tag):
            self.deeper[tag] -= 1
        elif self.open.get(tag):
            i = len(self.stack) - 1
            while self.stack[i].tag != tag:
                i -= 1
            # An end of an inline element doesn't close the blocks around it.
            if tag in BLOCKS or not any(s.tag in BLOCKS for s in self.stack[i + 1 :]):
                self.cut(i)

    def cut(self, i: int) -> None:
        while len(self.stack) > i:
            self.pop()

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if e.tag in BLOCKS:
            self.styles[e.path] = _hash(self.styles.get(e.path, 0), *e.children)

    def clean(self) -> list[Block]:
        """The blocks that their markup doesn't name as noise, those inside article or main where the page has such."""
        clean = [b for b in self.blocks if not b.noise]
        return [b for b in clean if b.article] or clean

    def article(self, noisy: frozenset[int] = frozenset()) -> list[str]:
        """The texts of the clean blocks, without the branches that the host's tree shows to be noise
        (``noisy``: the paths of their elements); the tree has no say where it would leave nothing."""
        clean = self.clean()
        return [b.text for b in clean if noisy.isdisjoint(b.judged)] or [b.text for b in clean]


#: Kinds of rows of a page's nodes: a style, a text inside, an element around.
STYLE, TEXT, UP = 0, 1, 2
_NODES = "host string, path long, kind int, mark long, copy long, linked boolean, inside boolean"


def page_nodes(pages: DataFrame) -> DataFrame:
    """Rows (host, path, kind, mark, copy, linked, inside) of the judged nodes of ``pages`` (host, html), once a page.

    STYLE: mark is the hash of the node's child sequences. TEXT: mark is the hash of a text anywhere
    in the node's branch, linked if it is mostly links. UP: mark is the path of a judged element
    around the node. copy tells pages apart, exact copies not; inside: in article or main. Only
    nodes with clean blocks in their branch matter and are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                page, copy, rows = Page(source), _copy(source), set()
                for x in page.clean():
                    mark = _hash(x.text)
                    for i, path in enumerate(x.judged):
                        rows.add((path, TEXT, mark, x.linked))
                        rows.add((path, STYLE, page.styles.get(path, 0), False))
                        rows |= {(path, UP, around, False) for around in x.judged[max(0, i - 1) : i]}
                out += [(host, p, kind, mark, copy, linked, p in page.inner) for p, kind, mark, linked in rows]
            columns = zip(*out) if out else [()] * 7
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "path", "kind", "mark", "copy", "linked", "inside"])

    return pages.mapInArrow(run, _NODES)


def style_tree(pages: DataFrame, gamma: float = 0.9, strength: float = 2.0, strength_inside: float = 6.0) -> DataFrame:
    """(host, path, m, importance, up) of the judged nodes of each host's style tree.

    ``pages`` has host (not null) and html. A node is an element path, m the number of pages with it, up the
    path of the judged element around it. Its presentation importance is the entropy, base m, of
    its child sequences over the pages. Its content importance is composite, over its whole branch: the mean
    over the occurrences of texts in it of 1 - ln k / ln m, where a text is on k pages (ln k / ln m is
    the entropy, base m, of where it appears). gamma is the content's weight; what is on one page has importance 1.

    A node seen on few pages says little, so this is shrunk as by ``strength`` further pages
    (``strength_inside`` within article or main) of importance 0.9, or down to 0.3 as its texts are links.
    Exact copies of a page count once, lest an article that is copied often look like a template.
    All counts are aggregates with map-side combine; the host's pages are never one group.
    """
    marks = page_nodes(pages).distinct().groupBy("host", "path", "kind", "mark").agg(F.count("*").alias("k"), F.max("linked").alias("linked"), F.max("inside").alias("inside"))
    k, log, of = F.col("k"), F.log, lambda kind: F.col("kind") == kind
    nodes = marks.groupBy("host", "path").agg(
        F.sum(F.when(of(STYLE), k)).alias("m"),
        F.sum(F.when(of(STYLE), k * log(k))).alias("styles"),
        F.sum(F.when(of(TEXT), k * log(k))).alias("texts"),
        F.sum(F.when(of(TEXT), k)).alias("n"),
        F.sum(F.when(of(TEXT) & F.col("linked"), k).otherwise(0)).alias("links"),
        F.max("inside").alias("inside"),
        F.min(F.when(of(UP), F.col("mark"))).alias("up"),
    )
    m = F.col("m")
    presentation = (log(m) - F.col("styles") / m) / log(m)
    content = 1 - F.col("texts") / F.col("n") / log(m)
    seen = F.when(m > 1, (1 - gamma) * presentation + gamma * F.greatest(content, F.lit(0.0))).otherwise(1.0)
    s = F.when(F.col("inside"), strength_inside).otherwise(strength)
    prior = 0.9 - 0.6 * F.col("links") / F.col("n")
    return nodes.select("host", "path", "m", ((m * seen + s * prior) / (m + s)).alias("importance"), "up")


def noisy_nodes(tree: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(host, path) of the noise of ``style_tree``: nodes that are, with all nodes in their branch, of less than ``threshold``.

    What is important keeps the elements around it, level by level; as many short joins on
    (host, path) as an important branch is deep, and at most DEPTH.
    """
    tree = durable(tree)
    noisy = tree.filter(F.col("importance") < threshold).select("host", "path", "up")
    kept = tree.filter(F.col("importance") >= threshold)
    for _ in range(DEPTH):
        around = kept.filter("up is not null").select("host", F.col("up").alias("path")).distinct()
        kept = durable(noisy.join(around, ["host", "path"], "left_semi"))
        if kept.isEmpty():
            break
        noisy = durable(noisy.join(kept, ["host", "path"], "left_anti"))
    return noisy.select("host", "path")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.4, broadcast_nodes: int = 500_000) -> DataFrame:
    """One row per row of ``pages``: key, url, text (main text; empty if none) and n_chars (its code points).

    Branches are removed that their markup names as menu, header, footer, sidebar, notice,
    advert, form or comments, and those that are noise in the style tree of the page's host, see
    ``noisy_nodes``. Character references are decoded, white space inside a block becomes one
    space, blocks are joined by an empty line; nothing else is dropped. Null html has no text;
    pages without a host (null url) share one tree; repeated rows count once in the tree; an
    empty table gives none; other columns are ignored.

    Up to ``broadcast_nodes`` noisy nodes (8 bytes each) go to the tasks by host. Beyond that each page meets
    those of its own nodes that are noise in a shuffled join.
    """
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_and_path(F.col(url))[0].alias("host"), F.col(html).alias("html"))
    noisy = durable(noisy_nodes(style_tree(slim.select("host", "html")), threshold))
    if noisy.limit(broadcast_nodes + 1).count() <= broadcast_nodes:
        of = noisy.groupBy(F.col("host").alias("of")).agg(F.collect_list("path").alias("noisy"))
        met = slim.join(F.broadcast(of), F.col("host") == F.col("of"), "left")
    else:
        copy = F.xxhash64(F.coalesce("html", F.lit("")))
        own = page_nodes(slim.select("host", "html").distinct()).filter(F.col("kind") == STYLE).select("host", "path", "copy").join(noisy, ["host", "path"])
        of = own.groupBy(F.col("host").alias("of"), F.col("copy").alias("of_copy")).agg(F.collect_set("path").alias("noisy"))
        met = slim.withColumn("copy", copy).join(of, (F.col("host") == F.col("of")) & (F.col("copy") == F.col("of_copy")), "left")
    types = dict(slim.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n\n".join(Page(h.as_py()).article(frozenset(n.as_py() or ()))) for h, n in zip(b.column("html"), b.column("noisy"))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    slimmed = met.select("key", "url", "html", "noisy")
    return slimmed.mapInArrow(run, f"key {types['key']}, url {types['url']}, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
