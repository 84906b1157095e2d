"""Main text of web pages by consensus host paths.

1. Every page is parsed once; each container outside boilerplate is scored by the text of the
   blocks it holds, less what lies in links. A container of containers is scored by the text in all of
   them, at a discount, and counts if it beats each of them: then the article has several parts.
2. Each page votes, for its host, for the generalised tag-class paths of its best containers
   (digits in class names become ``#``); Spark sums the votes and picks one path per host.
3. Every page is parsed again and its text taken from the containers at the host's path; a page
   that has none there is read from its own best container. So is a page of another template: one whose
   own best container holds twice the text, unless the host's pages that have it mostly prefer another.

The host table is broadcast only when its measured size is under ``broadcast_bytes``; a larger one
is joined by host, where adaptive execution splits a host with very many pages.

Cases: null html or a page without text gives the empty string; a null url counts as one host of
its own; repeated pages repeat their result (and vote as often); ties between paths go to the
shorter, then the lexically smaller one; an empty table gives an empty table; columns of the input
pass through, but one named like an output column is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narralith.llm._shared import cut, released

#: No alternative reads on past the next tag's start without a quote or an end to find, and none gives back what it
#: has read, so a page is scanned in time linear in its length however broken it is.
_ATTRS = r"""(?:"[^"]*+"|'[^']*+'|[^'"<>]++)*+"""
TAG = re.compile(
    r"<!--(?:.*?-->|.*+)"
    rf"|<(script|style|template|noscript|textarea|iframe|svg|math|title|xmp)\b{_ATTRS}>(?:.*?</\1\s*+>|.*+)"
    rf"""|<(/?)([a-zA-Z][^\s/<>"']*+)({_ATTRS})>"""
    r"|<[!?/][^<>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
#: Never part of an article.
BOILERPLATE = frozenset("nav footer aside form head button select dialog menu object audio video canvas".split())
#: Words in class, id or role that mark menus, notices, adverts and reader comments.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|gdpr|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|comments?|commentlist|disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|widget|pagination|search|complementary|contentinfo)(?=$|[\s_\d-])",
    re.I,
)
#: What an open element of the first kind ends when one of the second begins.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}
SEMANTIC = {"article": 1.2, "main": 1.1}
#: What text counts in a container around the one that holds it, in a body or html, and for each further level.
GATHERED, PAGE_GATHERED, LEVEL = 0.9, 0.65, 0.98
#: How many times the text at the host's path a page's own container must hold to be read instead.
MORE = 2
#: Containers of a page that get a vote.
VOTES = 3
SCALE = 1000


class Node:
    __slots__ = ("depth", "links", "out", "path", "tag", "text", "whole")

    def __init__(self, tag: str, path: str, out: bool, depth: int):
        self.tag, self.path, self.out, self.depth = tag, path, out, depth
        self.text = self.links = self.whole = 0


#: Longer paths go on from their digest: equal paths stay equal, and a page of any depth stays small.
LONG_PATH = 600


def general_path(parent: str, tag: str, attrs: str) -> str:
    m = CLASS.search(attrs) if attrs else None
    names = (m[1] or m[2] or m[3] or "").split() if m else []
    if len(parent) > LONG_PATH:
        parent = blake2b(parent.encode("utf-8", "replace"), digest_size=16).hexdigest()
    return f"{parent}/{tag}" + "".join(f".{DIGITS.sub('#', n.lower())}" for n in sorted(names))


def walk(page: str):
    """Yields ("open", node), ("close", node) for block elements, ("text", raw, node, in link) and ("space",)."""
    root = Node("", "", False, 0)
    stack, links, at = [root], 0, 0

    def pop():
        nonlocal links
        node = stack.pop()
        links -= node.tag == "a"
        return node

    for m in TAG.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], stack[-1], links
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            block = tag in BLOCK
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        node = pop()
                        if node.tag in BLOCK:
                            yield "close", node, None, 0
                    break
                if not block and stack[i].tag in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr") and tag != "wbr":
                yield ("space" if tag != "hr" else "close"), stack[-1], None, 0
            continue
        if tag in BLOCK or tag in ENDS:
            closes, fence = ("p", ("article", "div", "section", "td", "li", "body", "main", "blockquote", "table")) if tag not in ENDS else ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == closes or (closes in ("td", "th") and stack[i].tag in ("td", "th")) or (closes in ("dt", "dd") and stack[i].tag in ("dt", "dd")):
                    while len(stack) > i:
                        node = pop()
                        if node.tag in BLOCK:
                            yield "close", node, None, 0
                    break
                if stack[i].tag in fence:
                    break
        parent, attrs = stack[-1], m[4]
        out = parent.out or tag in BOILERPLATE
        if not out and tag == "header":
            out = not any(n.tag in SEMANTIC for n in stack)
        if not out and attrs and tag not in ("html", "body", "article", "main"):
            out = any(MARKED.search(x) for t in NAMES.findall(attrs) for x in t if x)
        elif not out and attrs and tag == "article":
            out = any(n.tag == "article" for n in stack) and any(re.search(r"\bcomments?\b", x, re.I) for t in NAMES.findall(attrs) for x in t if x)
        block = tag in BLOCK
        node = Node(tag, general_path(parent.path, tag, attrs) if block else parent.path, out, parent.depth + block)
        if attrs.endswith("/") and not block:
            continue
        stack.append(node)
        links += tag == "a"
        if block:
            yield "open", node, None, 0
    if at < len(page):
        yield "text", page[at:], stack[-1], links


#: Blocks whose text counts for the container that holds them.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption summary".split())
LISTS = frozenset("ul ol dl table tbody tr thead tfoot".split())


def scores(page: str) -> dict[str, float]:
    """Score of each generalised container path of a page."""
    found: Counter = Counter()
    linked: Counter = Counter()
    around: Counter = Counter()
    weight: dict[str, float] = {}
    open_: list[Node] = []
    for kind, a, node, links in walk(page):
        if kind == "open":
            open_.append(a)
        elif kind == "close" and open_ and a in open_[-1:]:
            open_.pop()
        elif kind == "text" and not node.out:
            n = len(a.strip())
            if not n:
                continue
            holder = len(open_) - 1
            while holder >= 0 and (open_[holder].tag in LEAF or open_[holder].tag in LISTS):
                holder -= 1
            path = open_[holder].path if holder >= 0 else ""
            weight.setdefault(path, 1.0)
            found[path] += n
            linked[path] += n if links else 0
            for k in range(holder + 1):
                up = open_[k]
                if k < holder and not links and up.tag not in LEAF and up.tag not in LISTS:
                    around[up.path] += n * (PAGE_GATHERED if up.tag in ("html", "body") else GATHERED) * LEVEL ** (holder - k - 1)
                if up.tag in SEMANTIC:
                    weight[up.path] = SEMANTIC[up.tag]
                    if k < holder:
                        found[up.path] += n
                        linked[up.path] += n if links else 0
    out = {p: weight[p] * (n - linked[p]) for p, n in found.items()}
    for p in around:
        if weight.get(p, 1.0) == 1.0:
            around[p] += max(0, out.get(p, 0))
    if around:
        best = min(around, key=lambda p: (-around[p], len(p), p))
        if around[best] > max(out.values()):
            out[best] = around[best]
    return out


def best_paths(page: str) -> list[tuple[str, float]]:
    ranked = sorted(scores(page).items(), key=lambda x: (-x[1], len(x[0]), x[0]))
    return [x for x in ranked[:VOTES] if x[1] > 0]


def text_at(page: str, path: str) -> tuple[str, bool]:
    """Text of the containers at ``path``, and whether there were any."""
    blocks: list[str] = []
    raw: list[str] = []
    inside, found, shut = 0, path == "", []

    def flush():
        if raw:
            s = "".join(raw)
            s = " ".join((entities.unescape(s) if "&" in s else s).split())
            if s:
                blocks.append(s)
            raw.clear()

    for kind, a, node, _ in walk(page):
        if kind == "text":
            if (inside or path == "") and not node.out:
                raw.append(a)
        elif kind == "space":
            raw.append(" ")
        else:
            flush()
            if kind == "open" and a.path == path and not a.out:
                inside, found = inside + 1, True
                shut.append(a)
            elif kind == "close" and shut and a is shut[-1]:
                inside -= 1
                shut.pop()
    flush()
    return "\n\n".join(blocks), found


def main_text(page: str, host_path: str | None, beaten: frozenset = frozenset()) -> str:
    """Text at ``host_path`` or, where there is none or much less, at the page's own best path if it is not one of ``beaten``."""
    if not page:
        return ""
    text, found = text_at(page, host_path) if host_path is not None else ("", False)
    own = best_paths(page)
    if not own:
        return text if found and text else text_at(page, "")[0]
    if found and text and (own[0][0] == host_path or own[0][0] in beaten):
        return text
    mine = text_at(page, own[0][0])[0]
    return text if found and text and len(mine) < MORE * len(text) else mine


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, beaten): the container path that a host's pages voted for, and those that most pages that have them rank lower."""
    ballots = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("votes", T.LongType()), T.StructField("firsts", T.LongType()), T.StructField("seen", T.LongType())])

    def vote(batches):
        for b in batches:
            got: dict = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best = best_paths(page) if page else []
                for rank, (path, score) in enumerate(best):
                    sums = got.setdefault((host, path), [0, 0, 0])
                    sums[0] += round(SCALE * score / best[0][1])
                    sums[1] += rank == 0
                    sums[2] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in got], pa.string()) for i in (0, 1)] + [pa.array([v[i] for v in got.values()], pa.int64()) for i in range(3)], names=ballots.names)

    cast = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("page")).mapInArrow(released(vote), ballots)
    total = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("firsts").alias("firsts"), F.sum("seen").alias("seen"))
    beaten = F.collect_list(F.when(F.col("firsts") * 2 <= F.col("seen"), F.col("path")))
    return total.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.length("path"), F.col("path"))).alias("path"), beaten.alias("beaten"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The input's columns, without ``html_col``, plus ``text_col``."""
    winners = cut(host_paths(pages, url_col, html_col).select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("beaten").alias("__beaten")))
    size = winners.agg(F.sum(F.octet_length("__host") + F.octet_length("__path") + F.octet_length(F.array_join("__beaten", "")) + 16 * F.size("__beaten") + 64)).first()[0] or 0
    kept = [f for f in pages.schema if f.name not in (html_col, text_col)]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])
    side = F.broadcast(winners) if size <= broadcast_bytes else winners
    joined = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html_col).alias("__page"), host_of(url_col).alias("__host")).join(side, "__host", "left").select(*[F.col(f"`{f.name}`") for f in kept], "__page", "__path", "__beaten")

    def read(batches):
        for b in batches:
            texts = [main_text(p, path, frozenset(beaten or ())) for p, path, beaten in zip(*(b.column(len(kept) + k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return joined.mapInArrow(released(read), schema)
