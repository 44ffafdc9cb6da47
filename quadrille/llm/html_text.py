"""Operator 5: main text of web pages, with site templates found as subtrees that recur on a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Element names by their part in HTML, and words by which sites name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas button select textarea input menu title".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd td th tr figcaption caption".split())
# by name, as whole words of class, id, role or itemprop: what is never article, wherever it stands
BOILERPLATE = frozenset("ad ads advert advertisement comments cookies menu navigation newsletter sidebar".split())
# outside an article also as parts of names, so that site-footer and cookie_banner go too
BOILERPLATE_PARTS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comments cookie cookies footer header masthead menu nav navbar navigation newsletter sidebar sponsored".split())
ARTICLE_NAMES = frozenset(["articlebody", "article-body", "article-content", "entry-content", "post-content", "main-content"])
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "names", "kids", "digest")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.names, self.kids, self.digest = tag, names, [], 0


def parse(page: str) -> Node:
    """A forgiving tree of elements and texts: end tags may be missing, and unknown ones are skipped."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag not in INLINE and tag not in VOID:
            # a block ends an open paragraph, with whatever inline elements were left open in it
            i = len(stack) - 1
            while i > 0 and stack[i].tag in INLINE:
                i -= 1
            if i > 0 and stack[i].tag in CLOSED_BY_BLOCK:
                del stack[i:]
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPE[tag]:
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                    break
        names = tuple(w.lower() for a in _ATTRIBUTE.finditer(m[3]) for w in (a[2] or a[3] or a[4] or "").split()) if m[3] else ()
        node = Node(tag, names)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _is_boilerplate(node: Node, inside: bool) -> bool:
    """By element and name.  Inside the article names count only as a whole, and a header holds its headline and stays."""
    if node.tag in DROPPED or (node.tag in ("header", "dialog") and not inside) or not BOILERPLATE.isdisjoint(node.names):
        return True
    return not inside and any(p in BOILERPLATE_PARTS for w in node.names for p in re.split(r"[-_]+", w))


def main_nodes(root: Node) -> list[Node]:
    """Outermost articles that are no boilerplate; else main elements; else what is named as an article's body; else []."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "name": []}
    stack = [root]
    while stack:
        node = stack.pop()
        if _is_boilerplate(node, False):
            continue
        if node.tag == "article":
            found["article"].append(node)
            continue
        if node.tag == "main" or "main" in node.names:
            found["main"].append(node)
        elif ARTICLE_NAMES.intersection(node.names):
            found["name"].append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    for kind in ("article", "main", "name"):
        if found[kind]:
            outer, seen = [], set()
            for n in found[kind]:
                if id(n) not in seen:
                    outer.append(n)
                    inner = [n]
                    while inner:
                        x = inner.pop()
                        seen.add(id(x))
                        inner.extend(k for k in x.kids if isinstance(k, Node))
            return outer
    return []


def _walk(root: Node) -> list[Node]:
    """Nodes with parents before children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(k for k in n.kids if isinstance(k, Node))
    return out


def hash_subtrees(root: Node, host: str) -> None:
    """Sets every digest: host, tag, names, and the texts and digests of the children.

    White space in texts is normalised, and outside text blocks runs of digits are one mark, so that dates and counters
    do not tell copies of a template apart; link targets are no part of it.
    """
    seed = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
    for n in reversed(_walk(root)):
        parts = [n.tag, *n.names]
        texts = ["" if isinstance(k, Node) else " ".join(k.split()) for k in n.kids]
        texts = texts if n.tag in TEXT_BLOCKS else [_DIGITS.sub("0", t) for t in texts]
        parts += [str(k.digest) if isinstance(k, Node) else t for k, t in zip(n.kids, texts)]
        n.digest = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"), seed)


def _mostly_links(top: Node) -> set[int]:
    """``id()`` of the nodes below with at least half of their text, white space aside, in links."""
    size: dict[int, tuple[int, int]] = {}
    for n in reversed(_walk(top)):
        text = linked = 0
        for k in n.kids:
            a, b = size[id(k)] if isinstance(k, Node) else (len("".join(k.split())), 0)
            text, linked = text + a, linked + b
        size[id(n)] = text, text if n.tag == "a" else linked
    return {i for i, (text, linked) in size.items() if text and 2 * linked >= text}


def candidates(root: Node, main: list[Node]) -> list[Node]:
    """The nodes that may be template: block elements outside the article, and containers inside it that are mostly links.

    A text block of the article is never one, nor a list, table or section of its text, however often a site repeats it.
    Of several articles each may be one, as teasers are.
    """
    inside = {id(x) for m in main for x in _walk(m)}
    above: set[int] = set()
    # what holds the article is not template; found without recursion, as pages nest without bound
    for n in reversed(_walk(root)):
        if id(n) in inside or any(isinstance(k, Node) and id(k) in above for k in n.kids):
            above.add(id(n))
    heads, out = {id(m) for m in main}, []
    links = {i for m in main for i in _mostly_links(m)}
    for n in _walk(root):
        if n.tag in INLINE or n.tag in VOID or n.tag in ("#root", "html", "body", "head"):
            continue
        if id(n) in inside:
            if id(n) in heads:
                if len(heads) > 1:
                    out.append(n)
            elif n.tag not in TEXT_BLOCKS and id(n) in links:
                out.append(n)
        elif id(n) not in above:
            out.append(n)
    return out


def main_text(nodes: list[Node], inside: bool = True) -> str:
    """Texts of the blocks below ``nodes`` in page order, without boilerplate."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    for top in nodes:
        stack: list = [(top, False)]
        while stack:
            n, leaving = stack.pop()
            if isinstance(n, str):
                run.append(html.unescape(n) if "&" in n else n)
                continue
            if leaving:
                flush()
                continue
            if n is not top and _is_boilerplate(n, inside):
                flush()
                continue
            if n.tag in VOID:
                run.append(" ")
                continue
            if n.tag not in INLINE:
                flush()
                stack.append((n, True))
            stack.extend((k, False) for k in reversed(n.kids))
        flush()
    return "\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def extract(page: str | None, host: str, template: set[int]) -> tuple[str, int]:
    """The page's main text and how many of its subtrees went as template, those inside others not counted."""
    root = parse(page or "")
    main = main_nodes(root)
    gone: set[int] = set()
    top = 0
    if template:
        hash_subtrees(root, host)
        gone = {id(n) for n in candidates(root, main) if n.digest in template}
    if gone:
        # delete first; what is left of the page is then looked at by element and name
        stack = [root]
        while stack:
            n = stack.pop()
            kept = [k for k in n.kids if not (isinstance(k, Node) and id(k) in gone)]
            top += len(n.kids) - len(kept)
            n.kids = kept
            stack.extend(k for k in kept if isinstance(k, Node))
        main = [m for m in main if id(m) not in gone] or main_nodes(root)
    return main_text(main or [root], bool(main)), top


def page_candidates(page: str | None, host: str) -> list[int]:
    root = parse(page or "")
    hash_subtrees(root, host)
    return sorted({n.digest for n in candidates(root, main_nodes(root))})


def main_texts(pages: DataFrame, min_pages: int = 5, broadcast_rows: int = 2_000_000, min_share: float = 0.1) -> DataFrame:
    """``pages`` with new columns text, n_chars and n_template; html is whole, null is empty.

    Every block subtree outside a page's article, every container of links in it, and each of several articles is hashed
    with its host, and Spark counts on how many different pages (by digest of the whole html, so copies count once)
    each occurs.  Subtrees on ``min_pages`` and ``min_share`` of the host's pages or more are site template and are
    deleted where they stand so on a page; n_template says how many.  Of the rest, elements go that HTML marks as menus,
    headers, footers, sidebars, forms, scripts and styles, or that their names mark as such or as adverts, notices and
    comments.  What is left of the article is its text: character references decoded, white space in a block one
    space, blocks joined by a newline.  A page without an article gives what is left of the whole page.

    Counts meet as one row a task and subtree.  The template is broadcast if a count shows ``broadcast_rows`` hashes at
    most; else each page gets its own template hashes by shuffled joins.  A url without host shares the empty host.
    Repeated rows give the same text; an empty table gives an empty result.  Further columns stay; text, n_chars
    and n_template replace columns of those names, and names that begin with two underscores are kept for inner use.
    """
    rows = pages.withColumn("__page", F.xxhash64(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, site, subtree = [], [], []
            for url, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                host = host_of(url)
                of = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
                got = [of, *page_candidates(text.as_py(), host)]  # the host itself, to count its pages
                subtree += got
                site += [of] * len(got)
                page += [key] * len(got)
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (site, subtree)]
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), *longs], names=["page", "site", "h"])

    seen = rows.select("url", "html", "__page").mapInArrow(run, "page long, site long, h long")
    # read twice below, and short, so that pages are hashed once
    often = checkpointed(seen.distinct().groupBy("site", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages))
    # only hosts of so many pages ask for more than min_pages of them
    large = often.filter((F.col("h") == F.col("site")) & (F.col("n") * min_share > min_pages)).select("site", F.col("n").alias("pages"))
    template = often.filter(F.col("h") != F.col("site")).join(large, "site", "left").filter(
        F.col("n") >= F.coalesce("pages", F.lit(0)) * min_share).select("h")
    found = template.limit(broadcast_rows + 1).toPandas()["h"].to_numpy(dtype=np.int64)
    small = len(found) <= broadcast_rows
    held = pages.sparkSession.sparkContext.broadcast(np.sort(found) if small else np.zeros(0, np.int64))
    if not small:
        own = seen.join(template, "h").groupBy("page").agg(F.collect_set("h").alias("__own"))
        own = own.withColumnRenamed("page", "__of")
        rows = rows.join(own, F.col("__page") == F.col("__of"), "left").drop("__of")
    else:
        rows = rows.withColumn("__own", F.lit(None).cast("array<long>"))
    state: dict[str, set[int]] = {}

    @F.pandas_udf("text string, n int")
    def text_of(url: pd.Series, page: pd.Series, own: pd.Series) -> pd.DataFrame:
        if small and "all" not in state:
            state["all"] = set(held.value.view(np.uint64).tolist())
        every = state.get("all", set())
        return pd.DataFrame([
            extract(p, host_of(u), every if small else set(np.array([] if o is None else o, dtype=np.int64).view(np.uint64).tolist()))
            for u, p, o in zip(url, page, own)], columns=["text", "n"])

    got = rows.withColumn("__got", text_of("url", "html", "__own"))
    return got.withColumns({"text": F.col("__got.text"), "n_chars": F.length("__got.text").cast("long"),
                            "n_template": F.col("__got.n")}).drop("__own", "__page", "__got")
