"""Operator 3, HTML extraction with removal of site templates.

Pages are parsed to element trees in one linear pass over their tags; void elements,
unclosed paragraphs, list items and table cells, stray end tags and raw text elements
are handled as browsers do in effect. Then

1. each element that may be part of a template (a container, never a paragraph or a
   heading of an article) is hashed with all it holds: tags, attributes, text;
2. Spark counts, per host, the different main texts (before templates are removed) of the
   pages that hold each hash, each once per task before it is shuffled; a host of any size
   is spread over all tasks by hash and text;
3. hashes on pages of at least ``min_pages`` different main texts are the host's template,
   however many pages the host has; copies of one page make no template. They return to the pages that hold them and these subtrees are deleted.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and scripts (by
element, role or class), with any article in them, articles marked as comments or teasers,
and articles within an article that has paragraphs of its own are dropped too. The rest is
the main text, inside an article or not: character references decoded, white space in a
block turned to one blank, blocks in order joined by one line feed. Where nothing is left,
articles (else ``main``) in containers that only a class marks as dropped are taken.

Nulls: null html is an empty page; a null URL is the host ``''``. A null id is kept;
repeated rows are pages of their own, but count once for templates. Pages without text give ''. An empty table
gives an empty result. Pages are read whole.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, texts
from .urls import split_url

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
#: Attributes up to the end of a tag; possessive, so that a tag that never ends is read once.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
_DROP = frozenset("head nav header footer aside form script style noscript template iframe button select textarea svg math object dialog menu title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ol ul dl dt dd table tbody thead tr td th pre blockquote a b i em strong span u s small sub sup code br html body article main".split())
#: Start tags that end an open element of the listed kinds.
_CLOSES = {t: ("p",) for t in _BLOCK - {"html", "body"}} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_WALLS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_CHROME = re.compile(r"(?:^|[-_\s])(?:nav|navbar|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|ads?|advert\w*|banner|promo|sponsor\w*|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|search|share|social|related|recommended|comments?|commentlist|disqus|replies|reply|respond|widget|toolbar|pagination)(?:$|[-_\s])", re.I)
#: Classes of articles that are comments on, or teasers of, another one.
_ASIDE = re.compile(r"(?:[\w-]+[-_])?(?:comments?|repl(?:y|ies)|teasers?|related|recommended|promos?|sponsored|ads?|adverts?|advertisement)(?:[-_](?:body|item|content|card))?", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "key")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.key = tag, attributes, [], 0


class _Stack:
    """Open elements, with their places by tag, so that no start or end tag has to search all of them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        """Close the elements from place ``to`` on."""
        while len(self.nodes) > to:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        if self.at[tag]:
            self.cut(self.at[tag][-1])

    def make_room(self, tag: str) -> None:
        """Close what a start tag ends: an unclosed paragraph, or items, cells and rows up to their list or table."""
        closes = _CLOSES.get(tag)
        if not closes:
            return
        walls = _WALLS.get(tag)
        if walls:
            wall = max((self.at[w][-1] for w in walls if self.at[w]), default=0)
            ends = [self.at[c][i] for c in closes if (i := bisect_right(self.at[c], wall)) < len(self.at[c])]
            if ends:
                self.cut(min(ends))
        elif tag == "option":
            if self.at[tag] and self.at[tag][-1] > (self.blocks[-1] if self.blocks else 0):
                self.cut(self.at[tag][0] if not self.blocks else self.at[tag][bisect_right(self.at[tag], self.blocks[-1])])
        elif self.blocks and self.nodes[self.blocks[-1]].tag in closes:
            self.cut(self.blocks[-1])


def parse(page: str) -> Node:
    """The page's element tree; text children are raw strings.

    One pass: every character is read a bounded number of times, however tags nest or
    fail to close. Where quotes of a tag don't close, tags end at the next ``>`` from
    there on; a tag that never ends is text.
    """
    root = Node("#root", "")
    stack = _Stack(root)
    at = begun = 0
    quotes = True

    nodes, rest, search = stack.nodes, _REST.match, _OPEN.search
    while match := search(page, at):
        start, after = match.span()
        comment, other, slash, name = match.groups()
        if comment or other:
            close = page.find("-->", after) if comment else page.find(">", after)
            if start > begun:
                nodes[-1].children.append(page[begun:start])
            begun = at = len(page) if close < 0 else close + (3 if comment else 1)
            continue
        end = rest(page, after).end() if quotes else page.find(">", after)
        if quotes and (end == len(page) or page[end] != ">"):
            quotes, end = False, page.find(">", after)
        if end < 0:  # no tag ends any more
            break
        if start > begun:
            nodes[-1].children.append(page[begun:start])
        name, attributes = name.lower(), page[after:end]
        begun = at = end + 1
        if slash:
            stack.end(name)
            continue
        stack.make_room(name)
        node = Node(name, attributes)
        nodes[-1].children.append(node)
        if name in _RAW:
            raw = _raw_end(name).search(page, at)
            node.children.append(page[at : raw.start() if raw else len(page)])
            begun = at = raw.end() if raw else len(page)
        elif name not in _VOID and not attributes.endswith("/"):
            stack.push(node)
    if len(page) > begun:
        nodes[-1].children.append(page[begun:])
    return root


@lru_cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*+>", re.I)


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attributes)} if node.attributes else {}


def is_chrome(node: Node) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms, comments, by element, role, class or id."""
    if node.tag in _DROP:
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    a = _attributes(node)
    if node.tag == "article":
        return any(_ASIDE.fullmatch(c) for c in a.get("class", "").split())
    return a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(_CHROME.search(f"{a.get('class', '')} {a.get('id', '')}"))


def hash_subtrees(root: Node, out: set[int]) -> None:
    """Hash every element with all it holds; ``out`` gets those that may be part of a template."""
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        todo += [(c, inside) for c in node.children if type(c) is Node]
    for node, inside in reversed(order):
        parts = [node.tag, node.attributes]
        filled = False
        for c in node.children:
            if type(c) is Node:
                parts.append(f"<{c.key}>")
                filled = True
            else:
                text = " ".join(c.split())
                parts.append(text)
                filled = filled or text != ""
        node.key = xxhash.xxh3_64_intdigest("\0".join(parts))
        if filled and node.tag not in ("#root", "html", "body", "article", "main") and not (inside and node.tag in _PROSE):
            out.add(node.key)


def _find(root: Node, tag: str) -> list[Node]:
    """Outermost elements of this kind, except in elements that are always dropped."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            found.append(node)
        elif node.tag not in _DROP:
            todo += [c for c in reversed(node.children) if type(c) is Node]
    return found


def _has_paragraphs(article: Node) -> bool:
    """Whether an article holds a paragraph with text outside of articles within it."""
    todo: list = [(c, False) for c in article.children]
    while todo:
        item, inside = todo.pop()
        if type(item) is str:
            if inside and item.strip():
                return True
        elif item.tag != "article" and item.tag not in _RAW and not is_chrome(item):
            todo += [(c, inside or item.tag == "p") for c in item.children]
    return False


def main_text(root: Node, template: set[int]) -> str:
    """Text of what is neither chrome nor template."""
    return _text([root], template) or _text(_find(root, "article") or _find(root, "main"), template)


def _text(tops: list[Node], template: set[int]) -> str:
    blocks, current = [], []

    def end_block() -> None:
        if current:
            text = " ".join(html.unescape("".join(current)).split())
            current.clear()
            if text:
                blocks.append(text)

    for top in tops:
        todo: list = [(top, False)]
        while todo:
            item, alone = todo.pop()
            if item is None:
                end_block()
            elif type(item) is str:
                current.append(item)
            elif alone and item.tag == "article":
                end_block()
            elif item.tag in _RAW or is_chrome(item) or item.key in template:
                end_block() if item.tag in _BLOCK else None
            elif item.tag == "br":
                current.append(" ")
            else:
                if item.tag in _BLOCK:
                    end_block()
                    todo.append((None, alone))
                alone = alone or (item.tag == "article" and _has_paragraphs(item))
                todo += [(c, alone) for c in reversed(item.children)]
        end_block()
    return "\n".join(blocks)


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, hash and main text (as a hash) of each page, each once per 200,000 of them."""
    seen: set[tuple[str, int, int]] = set()

    def signed(k: int) -> int:
        return k - (1 << 64) if k >> 63 else k

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in seen], pa.string()), pa.array([signed(k) for _, k, _ in seen], pa.int64()), pa.array([signed(b) for _, _, b in seen], pa.int64())], names=["host", "key", "body"])
        seen.clear()
        return out

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = split_url(url.encode() if url else None)[0].decode(errors="replace")
            keys: set[int] = set()
            root = parse(page or "")
            hash_subtrees(root, keys)
            body = xxhash.xxh3_64_intdigest(main_text(root, set()))
            seen.update((host, key, body) for key in keys)
            if len(seen) > 200_000:
                yield flush()
    if seen:
        yield flush()


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", min_pages: int = 5, max_broadcast: int = 200_000, group_bytes: int = 32_000_000) -> DataFrame:
    """Per row: page_id, url, text, n_chars. Beyond ``max_broadcast`` template hashes, pages meet those of their host in groups of about ``group_bytes``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    ws = Workspace(spark, "pages")
    rows = texts(pages, page_id, url, page).toDF("page_id", "url", "html")
    held = rows.select("url", "html").mapInArrow(_hash_pages, "host string, key long, body long").distinct()
    counts = held.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    template = ws.write(counts.select("host", "key"), "template")
    out = T.StructType([T.StructField("page_id", rows.schema[0].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    schema = to_arrow_schema(out)

    def rewrite(batch, hosts_of) -> pa.RecordBatch:
        found = []
        for u, p in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = split_url(u.encode() if u else None)[0].decode(errors="replace")
            root = parse(p or "")
            known = hosts_of(host)
            if known:
                hash_subtrees(root, set())
            found.append(main_text(root, known))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
        return pa.RecordBatch.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    if template.count() <= max_broadcast:  # a checked bound; beyond it pages meet their own host's hashes only
        known: dict[str, set[int]] = {}
        for r in template.toLocalIterator():
            known.setdefault(r.host, set()).add(r.key & 0xFFFFFFFFFFFFFFFF)
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rewrite(batch, lambda host: sent.value.get(host, set()))

        return rows.mapInArrow(run, out)

    # Salted: each host's pages are spread over as many groups as its bytes need; every group gets the host's hashes once.
    hosted = rows.withColumn("__host", _host(F.col("url")))
    salts = hosted.groupBy("__host").agg(F.ceil(F.sum(F.octet_length(F.coalesce("html", F.lit("")))) / group_bytes).cast("int").alias("n"))
    salts = ws.write(salts.select(F.col("__host").alias("salted_host"), F.greatest("n", F.lit(1)).alias("__n")), "salts")
    salted = hosted.join(salts, F.col("__host") == F.col("salted_host")).withColumn("__salt", F.pmod(F.xxhash64("html", "page_id"), F.col("__n")).cast("int"))
    spread = template.join(salts, F.col("host") == F.col("salted_host")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = {k & 0xFFFFFFFFFFFFFFFF for k in right.column("key").to_pylist()}
        return pa.Table.from_batches([rewrite(left, lambda host: keys)], schema=schema)

    return salted.select("page_id", "url", "html", "__host", "__salt").groupBy("__host", "__salt").cogroup(spread.select("host", "key", "salt").groupBy("host", "salt")).applyInArrow(meet, out)


def _host(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
