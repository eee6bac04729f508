"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.llm.common import short_batches, slices

#: Elements whose content is no markup; a tag name ends at white space, ``/`` or ``>``, so ``title-card`` is none of them.
RAW = "script|style|noscript|template|iframe|textarea|title"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/a-z!?][^<>]*+>", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article main section div table ul ol dl td th tr aside nav footer header form".split())
PARTS = frozenset("head nav footer aside form button dialog input fieldset menu svg select object canvas".split())
#: Drawings and choices, which a block that begins inside ends.
DRAWN = frozenset("svg select".split())
#: Reader comments are containers; a paragraph or a word so named belongs to the text.
CONTAINERS = frozenset("article aside details div dl fieldset form li main ol section table tbody td tr ul".split())
WHOLE = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: How surely a part is furniture, by the words of its names: comments may hold articles of their own, the first
#: kind may hold the page's text.
MAYBE, PLAIN, SURE = 1, 2, 3
MARKS = {word: kind for kind, words in (
    (MAYBE, "banner sidebar side rail footer header masthead topbar notice notices notification alert modal overlay "
            "subscribe signup share sharing social related recommended widget login search skip copyright legal"),
    (PLAIN, "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
            "breadcrumb breadcrumbs cookie cookies consent popup newsletter pagination pager toolbar"),
    (SURE, "aside comment comments reply replies respond discussion disqus")) for word in words.split()}
#: Words beside a mark in one name that do not change what it says: main-nav, left-sidebar, share-buttons.
BESIDE = frozenset(
    "site page global main primary secondary left right top bottom box block wrapper wrap container inner outer area "
    "list links link items item section bar buttons button form content text posts post".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marked(name: str) -> int:
    """What a class or id says as a whole: every word is a mark or goes beside one (``has-sidebar`` says nothing)."""
    words = [w for w in re.split(r"[^a-z]+", name) if w and w not in BESIDE]
    return max((MARKS[w] for w in words), default=0) if all(w in MARKS for w in words) else 0


def _clutter(tag: str, attrs: str, inside: bool) -> int:
    """How surely an element is page furniture by its tag, role, class or id, 0 if it is not; ``inside`` an article
    or main part, where density decides on what only may be furniture. The id of a heading is an anchor."""
    if tag in PARTS:
        found = MAYBE if tag in ("form", "fieldset") and not inside else SURE
    else:
        found = MAYBE if tag == "header" and not inside else 0
    if tag in WHOLE or not attrs or "=" not in attrs:
        return found
    for name, a, b, c in ATTR.findall(attrs):
        value = (a or b or c).lower()
        if name.lower() == "role":
            found = max(found, PLAIN if value in ROLES else 0)
        elif tag not in HEADINGS:
            new = max(map(_marked, value.split() if name.lower() == "class" else [value]), default=0)
            if inside and (new == MAYBE or new == SURE and tag not in CONTAINERS):
                new = 0
            found = max(found, new)
    return found


def _furniture(parent: list[int], tags: list[str], kind: list[int], own: list[int]) -> list[bool]:
    """Whether each element is cut: it or an element around it is furniture (``kind``) that may go.

    No part around a main element goes, and around an article only comments, navigation and their like. A part that
    may be furniture stays if, on a page without articles, it holds more than half of the text.
    """
    n = len(tags)
    main, article = [t == "main" for t in tags], [t in ("article", "main") for t in tags]
    for i in range(n - 1, 0, -1):
        main[parent[i]] |= main[i]
        article[parent[i]] |= article[i]
    cut = [False] * n
    for i in range(1, n):
        cut[i] = cut[parent[i]] or kind[i] == SURE and not main[i] or kind[i] == PLAIN and not article[i]
    marked = any(tags[i] in ("article", "main") and not cut[i] for i in range(n))
    size = [0 if c else s for s, c in zip(own, cut)]
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    for i in range(1, n):
        cut[i] = cut[i] or cut[parent[i]] or kind[i] == MAYBE and not article[i] and (marked or 2 * size[i] <= size[0])
    return cut


def _tree(page: str):
    """Elements in page order and the text pieces under them.

    Returns parent and tag per element, how surely it is furniture, and pieces
    ``(element, block number, text)``.
    """
    parent, tags, kind, inside = [-1], ["html"], [0], [False]
    stack, pieces, block, at = [0], [], 0, 0

    def put(raw):
        if raw:
            pieces.append((stack[-1], block, html.unescape(raw) if "&" in raw else raw))

    for match in TOKEN.finditer(page):
        put(page[at:match.start()])
        at = match.end()
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"]:
            if tag in VOID:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tags[stack[depth]]
                if open_tag == tag:
                    del stack[depth:]
                    break
                if open_tag in SCOPES and tag not in SCOPES:
                    break  # an inline end tag does not close a container
            block += tag in BLOCKS
            continue
        if tag in ("html", "body") and len(stack) <= 2:
            block += 1
            continue
        if tag in BLOCKS:
            block += 1
            closed = CLOSES.get(tag, ())
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = tags[stack[depth]]
                if open_tag == "p" or open_tag in DRAWN or open_tag in closed:
                    del stack[depth:]  # an open paragraph, or the item before this one, ends here
                elif open_tag in SCOPES:
                    break
        if tag == "br":
            pieces.append((stack[-1], block, " "))
        top = stack[-1]
        parent.append(top)
        tags.append(tag)
        kind.append(_clutter(tag, match["attrs"], inside[top]))
        inside.append(inside[top] or tag in ("article", "main"))
        if tag not in VOID and not (match["attrs"] or "").endswith("/"):
            stack.append(len(tags) - 1)
    put(page[at:])
    return parent, tags, kind, pieces


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and text-free pages.

    Furniture (``_furniture``) takes no part. For each element the composite
    density weighs its characters per tag against its links; an element's sum
    adds the densities of its children and of its own text. From the element
    with the highest sum the path to the body gives the threshold, the lowest
    density on it; every part at or above the threshold gives its subtree of
    highest sum. If the element with the highest sum is or lies in an article or
    main element, the nearest one is taken whole, and so are those around the
    other subtrees, while parts outside articles are left; an article that only
    lies beside or below the element with the highest sum changes nothing.
    """
    if not page:
        return ""
    parent, tags, kind, pieces = _tree(page)
    n = len(tags)
    size, count, links, link_tags, own = [0] * n, [1] * n, [0] * n, [0] * n, [0] * n
    for i, _, text in pieces:
        own[i] += len(" ".join(text.split()))
    cut = _furniture(parent, tags, kind, own)
    own = [0 if cut[i] else own[i] for i in range(n)]
    for i in range(n - 1, -1, -1):
        size[i] += own[i]
        if cut[i]:
            continue
        if tags[i] == "a":
            links[i], link_tags[i] = size[i], link_tags[i] + 1
        up = parent[i]
        if up >= 0 and not cut[up]:
            size[up] += size[i]
            count[up] += count[i]
            links[up] += links[i]
            link_tags[up] += link_tags[i]
    if not size[0]:
        return ""
    body_links = links[0] / size[0]

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + body_links * c + math.e)
        spread = math.log(max(1.0, c / max(1, lc) * t / max(1, lt)))
        return c / t * spread / max(math.log(base), 0.05)  # the base is 1 on pages without links

    dense = [0.0 if cut[i] else density(size[i], count[i], links[i], link_tags[i]) for i in range(n)]
    total = [density(own[i], 1, 0, 0) if own[i] and not cut[i] else 0.0 for i in range(n)]
    for i in range(n - 1, 0, -1):
        if not cut[i]:
            total[parent[i]] += dense[i]
    best = max(range(n), key=lambda i: (total[i], -i))
    path, i = [], best
    while i >= 0:
        path.append(dense[i])
        i = parent[i]
    limit = min(path)
    peak = list(range(n))  # element of the highest sum in each subtree
    for i in range(n - 1, 0, -1):
        if total[peak[i]] > total[peak[parent[i]]]:
            peak[parent[i]] = peak[i]
    around = [-1] * n  # nearest article or main element, the element itself included
    for i in range(n):
        around[i] = i if tags[i] in ("article", "main") else around[parent[i]] if i else -1
    chosen = [False] * n
    for i in range(n):
        if size[i] and not cut[i] and dense[i] >= limit:
            whole = peak[i] if around[best] < 0 else around[peak[i]]
            if whole >= 0:
                chosen[whole] = True
    for i in range(1, n):
        chosen[i] = chosen[i] or chosen[parent[i]]
    blocks: dict[int, list[str]] = {}
    for i, block, text in pieces:
        if chosen[i] and not cut[i]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", rows: int = 500) -> DataFrame:
    """``key, url, text, n_chars`` of every page (``main_text``).

    Blocks are joined by a line feed with white space inside them collapsed.
    Null and empty pages and pages without main text give an empty text.
    Repeated rows are extracted row by row and other columns are dropped.
    """
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(parts):
        for whole in parts:
            for part in slices(whole, rows):
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_pydict({"key": part.column(0), "url": part.column(1), "text": texts,
                                                  "n_chars": [len(t) for t in texts]}, schema=schema)

    short_batches(pages.sparkSession)
    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(
        run, "key long, url string, text string, n_chars long").select(
        F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
