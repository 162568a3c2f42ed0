"""Main text of web pages by site style trees (operator 8).

All pages of a host are laid over one another: elements with the same path of tags and classes are
one style node. A node is important when its text differs from page to page. For a text that
stands on n of a node's m pages the entropy of its pages is log n / log m, and the importance of
the node is one minus the mean over its texts; menus, notices and adverts that return from page
to page come out near zero, articles near one. A host with few pages leans on the tree of all
hosts. Branches below THRESHOLD are cut from each page.

Elements that hint by their tag or class at what they are (navigation, forms, comments, ...) have nodes
of their own in the trees. Of what entropy leaves of a page they are cut too, but only while more
text stands outside them: an element that holds most of it is an article, whatever its name.

The tree is a distinct over page bodies and two aggregations over (host, path, text hash), so a host
with a third of all pages is spread like any other; only nodes to cut go back to the pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import pieces, shared
from tracebound.plans.lineage import cut

#: Importance below which a node is cut, pages of the common tree that count besides the host's
#: own, and pages below which the common tree says nothing.
THRESHOLD, COMMON_PAGES, LEAST_PAGES = 0.5, 20, 8
#: Nodes to cut that may be broadcast (about 100 MB); above it pages are joined by host.
BROADCAST_NODES = 500_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split())
#: Tags whose text is never part of a page's body text, tags that hint at no article, and tags that no
#: hint counts for.
HIDDEN = frozenset("head title button".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
CONTENT = frozenset("html body main article".split())
#: Words of class, id or role names with the meaning of OUTSIDE.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer footer form header login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination popup promo promoted reader related reply replies search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Elements that end when another of the same group begins inside the same parent.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
#: Style paths inside article or main, and how often their characters count against those of others.
NAMED, NAMED_WEIGHT = re.compile(r"/(?:article|main)(?![a-z0-9:-])"), 10
#: One block of a page in the tree.
NODE = pa.struct([("path", pa.int64()), ("text", pa.int64())])
SCOPES = frozenset("ul ol dl table tbody thead tfoot section article div body main nav".split())


def host_of(url: str | None) -> str:
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", url or "")
    return found[1].rpartition("@")[2].partition(":")[0].lower() if found else ""


def node_name(tag: str, attributes: str) -> tuple[str, bool]:
    """(tag with its classes, whether the element hints that it is no article text)."""
    names = []
    cue = tag in OUTSIDE
    for kind, *values in CLASS.findall(attributes) if "=" in attributes else ():
        value = next((v for v in values if v), "").lower()
        words = set(re.split(r"[\s_-]+", re.sub(r"([a-z])(?=\d)", r"\1 ", value)))
        cue |= not CUES.isdisjoint(words)
        if kind.lower() == "class":
            names += sorted(value.split())
    return ".".join([tag, *(re.sub(r"\d+", "#", n) for n in names)]), cue and tag not in CONTENT


def blocks(page: str) -> Iterator[tuple[str, str]]:
    """(style path, text) of every block of a page in order; elements with a hint are left out."""
    return ((path, text) for path, text, hints in hinted_blocks(page) if not hints)


def hinted_blocks(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(style path, text, style paths of the elements with a hint around it) of every block in order."""
    stack: list[tuple[str, str, tuple | None]] = []  # tag, path, hints or None where text is hidden
    path, hints, held = "", (), []

    def block():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        return text

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            token = m[0]
            if hints is not None and (token[0] != "<" or token == "<"):
                held.append(token)
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue  # a block is read across its inline elements
        if held and (text := block()):
            yield path, text, hints
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag == "body":
                stack = [x for x in stack if x[0] == "html"]
            elif any(x[0] == "p" for x in stack):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SIBLINGS.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
            name, cue = node_name(tag, m[4])
            if tag == "header":  # the heading of an article is part of it
                cue |= not any(x[0] in ("article", "main") for x in stack)
            _, above, hints = stack[-1] if stack else ("", "", ())
            path = f"{above}/{name}{'!' * cue}"
            if tag in HIDDEN or hints is None:
                hints = None
            elif cue:
                hints = (*hints, path)
            stack.append((tag, path, hints))
        _, path, hints = stack[-1] if stack else ("", "", ())
    if held and (text := block()):
        yield path, text, hints


def main_blocks(found: list[tuple[str, str, tuple[str, ...]]]) -> list[tuple[str, str]]:
    """(style path, text) of the blocks without those that hints put outside.

    A hint counts for nothing where the elements of its style path hold more characters than stand
    outside all hints; then the hints inside them are looked at in the same way. Characters of article
    and main count NAMED_WEIGHT times, so that a short article is not outweighed by its footer.
    """
    void: set[str] = set()
    while True:
        firsts = [next((h for h in hints if h not in void), None) for _, _, hints in found]
        chars: dict[str | None, int] = {None: 0}
        for first, (path, text, _) in zip(firsts, found):
            chars[first] = chars.get(first, 0) + len(text) * (NAMED_WEIGHT if NAMED.search(path) else 1)
        more = {h for h, n in chars.items() if n > chars[None]}
        if not more:
            return [(path, text) for first, (path, text, _) in zip(firsts, found) if first is None]
        void |= more


def number(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def numbered(found: list[tuple[str, str]]) -> list[tuple[int, int]]:
    return [(number(p), number(t)) for p, t in found]


def page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, body, nodes) of every different page of one piece.

    ``body`` is a digest of the blocks in order; ``nodes`` holds (path, text) once per page. Nodes
    inside a hint are a row of their own, with the digest of the whole page, so that the other nodes
    of a copied article count once, whatever adverts stand around the copies.
    """
    for batch, texts in pieces(batches, "html"):
        rows: dict[tuple, list] = {}
        for url, raw in zip(batch.column("url").to_pylist(), texts):
            found, host = list(hinted_blocks(raw.decode(errors="replace"))), host_of(url)
            for hinted, body in (False, main_blocks(found)), (True, [x[:2] for x in found]):
                nodes = numbered([(p, t) for p, t, hints in found if bool(hints) == hinted])
                if nodes:
                    digest = xxhash.xxh3_128_digest(np.array(numbered(body), np.int64).tobytes())
                    rows.setdefault((host, digest, hinted), nodes)
        nodes = [[{"path": p, "text": t} for p, t in dict.fromkeys(x)] for x in rows.values()]
        yield pa.record_batch(
            [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary()),
             pa.array(nodes, pa.list_(NODE))], names=["host", "body", "nodes"])


def counted(bodies: DataFrame, *keys: str) -> DataFrame:
    """In how many rows of ``bodies`` each text of a node stands."""
    return bodies.select(*keys, F.inline("nodes")).groupBy(*keys, "path", "text").agg(F.count(F.lit(1)).alias("n"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every style node of ``pages(url, html)``.

    Pages with the same main blocks in the same order count once in the tree of a host, and once in the
    common tree: copies of an article and repeated rows say nothing about a template.
    """
    # The nodes follow from the body, so a hot body is one row of each task after the first step.
    bodies = cut(
        pages.select("url", "html")
        .mapInArrow(page_nodes, "host string, body binary, nodes array<struct<path bigint, text bigint>>")
        .distinct())
    return weighed(counted(bodies, "host"), ["host", "path"]).join(
        weighed(counted(bodies.drop("host").distinct()), ["path"])
        .withColumnsRenamed({"texts": "all_texts", "alike": "all_alike"}), "path"
    ).withColumns({
        "own": importance("texts", "alike"), "common": importance("all_texts", "all_alike")
    }).select("host", "path", F.col("texts").alias("pages"), F.when(
        F.col("all_texts") < LEAST_PAGES, F.lit(1.0)
    ).otherwise(
        (F.col("texts") * F.col("own") + F.lit(COMMON_PAGES) * F.col("common")) / (F.col("texts") + COMMON_PAGES)
    ).alias("importance"))


def weighed(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Per node: its texts in all, and the sum of n log n over its different texts."""
    return texts.groupBy(*keys).agg(
        F.sum("n").alias("texts"), F.sum(F.col("n") * F.log("n")).alias("alike"))


def importance(texts: str, alike: str):
    """One minus the mean entropy; a node seen once is important."""
    return F.when(F.col(texts) < 2, 1.0).otherwise(1 - F.col(alike) / (F.col(texts) * F.log(texts)))


def main_text(page: str, low: set[int]) -> str:
    return " ".join(text for _, text in main_blocks([x for x in hinted_blocks(page) if number(x[0]) not in low]))


def extract(pages: DataFrame, key: str = "page_id", limit: int = BROADCAST_NODES) -> DataFrame:
    """Key, url, text and n_chars (code points) of every row of ``pages(key, url, html)``.

    Null and empty pages give an empty text; a null url belongs to the host ""; every repeated row has
    its text, and together they count once in the trees; other columns are not read; an empty table stays empty.
    """
    low = cut(style_tree(pages).filter(F.col("importance") < THRESHOLD).select("host", "path"))
    kind = pages.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, url string, text string, n_chars bigint"

    def record(batch, texts) -> pa.RecordBatch:
        return pa.record_batch(
            [batch.column(key), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    if low.count() <= limit:
        nodes: dict[str, set[int]] = {}
        for host, path in low.collect():  # at most ``limit`` rows
            nodes.setdefault(host, set()).add(path)
        sent = shared(pages.sparkSession, nodes)

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, "html"):
                yield record(batch, [
                    main_text(raw.decode(errors="replace"), sent().get(host_of(url), set()))
                    for url, raw in zip(batch.column("url").to_pylist(), texts)])

        return pages.select(key, "url", "html").mapInArrow(looked_up, schema)

    # Many hosts: the nodes of one host, which its templates bound, travel to its pages. A host
    # with many pages is one row on one side, and the join may be split on the other.
    lists = low.groupBy("host").agg(F.collect_list("path").alias("low")).withColumnRenamed("host", "__host")
    host = F.lower(F.regexp_replace(F.regexp_replace(
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1), "^.*@", ""), ":.*$", ""))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "html"):
            yield record(batch, [
                main_text(raw.decode(errors="replace"), set(nodes or ()))
                for nodes, raw in zip(batch.column("low").to_pylist(), texts)])

    return (
        pages.select(key, "url", "html", F.coalesce(host, F.lit("")).alias("__host")).join(lists, "__host", "left")
        .select(key, "url", "html", "low").mapInArrow(joined, schema)
    )
