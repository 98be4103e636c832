"""Operator 4: main text of a web page by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf path of tags (with the class or id of an element). For
each path the text length and the punctuation of all its blocks are added up and divided by their number. The two ratios
of a block's path are smoothed along the page and fused, less so the more of the path's text lies in links; a path is
content if the mean of its blocks reaches a threshold that follows the page's own spread. Text inside article or main
needs far less than text outside of them. Parts that a page itself names as headers, footers, sidebars, notices,
adverts, forms or comments are left out before the ratios are taken; menus have no list of names, the ratios find them.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<odd>[!?])[^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+(?:>|\Z)|[^>]*+(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/>]|\Z)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Fixed values of HTML: elements without an end, those whose content is raw text, and those that set text apart.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Raw elements that end with the page if nothing else ends them; of others without an end only the tag is markup.
CODE = frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: An element whose start ends an open one of these, if none of the second set lies between.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

# Elements, roles and names of what is never main text.
DROPPED = frozenset("aside form button select dialog canvas audio video datalist output search fieldset footer svg object noscript template".split())
DROPPED_ROLES = frozenset("banner complementary contentinfo search dialog alertdialog alert form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "sidebar sidebars footer masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup paywall "
    "comment comments commentlist disqus reply replies login signin share sharing".split()
)
HEADER_WORDS = frozenset("header topheader pageheader".split())
#: Beside one of these a name tells what an element lies next to, not what it is: has-sidebar, no-ads.
BESIDE_WORDS = frozenset("has with no without".split())
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、！？；，]")

#: Blocks on each side that smoothing looks at.
REACH = 1
#: Text length and punctuation of a block at which half of the way to the largest ratio is reached; the ratio of none.
LENGTH_HALF, MARKS_HALF, NO_MARKS = 100.0, 1.0, 0.05
#: What is left of the fused ratio of a path whose text is all in links.
LINKED_LEFT = 0.05
#: The threshold: so many standard deviations of the page's ratios, within these parts of its largest one, but not less
#: than the last figure.
DEVIATIONS, LEAST_PART, MOST_PART, FLOOR = 0.6, 0.1, 0.5, 0.02
#: Weights of a ratio inside article or main, and outside of them on a page that has one.
INSIDE, OUTSIDE = 50.0, 0.25


class Block:
    __slots__ = ("path", "parts", "linked", "inside")

    def __init__(self, path: int, inside: bool) -> None:
        self.path, self.inside, self.parts, self.linked = path, inside, [], 0


def unwanted(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the element and all in it is never main text. inside: it lies in article or main."""
    if name in DROPPED or name == "header" and not inside:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if name in ("html", "body", "main") or name == "article" and not re.search("comment|reply", attributes.get("class", "") + attributes.get("id", ""), re.I):
        return False
    words: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if not BESIDE_WORDS.intersection(parts):
            # the first word or the last one tells what it is: cookie-notice, article-comments, but not long-form-text
            words.update(parts[:1], parts[-1:], WORDS.findall(name.lower()) if "-" not in name and "_" not in name else ())
    return bool(words & DROPPED_WORDS) or not inside and bool(words & HEADER_WORDS)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, without unwanted parts."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, path, inside, dropped
    paths: dict[tuple[int, str], int] = {}  # a path's number by its parent's and its last label
    opened: dict[str, int] = defaultdict(int)
    ends_of: dict[str, list[int]] = {}  # where the end tags of a raw element end
    block: Block | None = None
    links, at, length = 0, 0, len(page)

    def text(start: int, end: int) -> None:
        nonlocal block
        name, path, inside, dropped = stack[-1]
        if dropped or start >= end:
            return
        value = html.unescape(page[start:end])
        if block is None:
            if not value.strip():
                return
            block = Block(path, inside)
            found.append(block)
        block.parts.append(value)
        if links:
            block.linked += len(value)

    def close(upto: int) -> None:
        nonlocal links
        for name, *_ in stack[upto:]:
            links -= name == "a"
            opened[name] -= 1
        del stack[upto:]

    while at < length:
        match = TOKEN.search(page, at)
        if match is None:
            text(at, length)
            break
        text(at, match.start())
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            block = None
        if match["end"]:
            if not opened[name]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if name == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if name in VOID:
            continue
        if name in RAW:
            if not match["rest"].endswith("/>"):
                if name not in ends_of:
                    ends_of[name] = [m.end() for m in re.finditer(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", page, re.I)]
                later = bisect.bisect_right(ends_of[name], at)
                at = ends_of[name][later] if later < len(ends_of[name]) else length if name in CODE else at
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in ENDED:
            ends, bounds = ENDED[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    if name != "tr":
                        break
                elif stack[k][0] in bounds:
                    break
        _, path, inside, dropped = stack[-1]
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(match["rest"])} if len(match["rest"]) > 1 else {}
        dropped = dropped or unwanted(name, attributes, inside)
        if name in BLOCK:
            label = attributes.get("class") or attributes.get("id") or ""
            path = paths.setdefault((path, f"{name}.{label}"), len(paths) + 1)
        links += name == "a"
        opened[name] += 1
        stack.append((name, path, inside or name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article"), dropped))
    return found


def smoothed(values: np.ndarray) -> np.ndarray:
    """A Gaussian-weighted mean over the neighbours within REACH."""
    weights = np.exp(-np.arange(-REACH, REACH + 1) ** 2 / 2.0)
    above = np.convolve(values, weights, "full")[REACH:][: len(values)]
    return above / np.convolve(np.ones(len(values)), weights, "full")[REACH:][: len(values)]


def fused(blocks: list[Block], texts: list[str]) -> np.ndarray:
    """The ratio of each block, from 0 to 1: its path's text length and punctuation, smoothed, fused, cut by the share of links."""
    total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(4))
    for b, t in zip(blocks, texts, strict=True):
        total[b.path] += (len(t), len(PUNCTUATION.findall(t)), min(b.linked, len(t)), 1)
    linked = np.array([total[b.path][2] / total[b.path][0] for b in blocks])
    # text in links doesn't gain by its neighbours: a short menu stays short beside long paragraphs
    length, marks = (smoothed(own) * (1 - linked) + own * linked for own in (np.array([total[b.path][k] / total[b.path][3] for b in blocks]) for k in (0, 1)))
    return np.sqrt(length / (length + LENGTH_HALF) * (marks + NO_MARKS) / (marks + MARKS_HALF)) * (1 - (1 - LINKED_LEFT) * linked)


def content(blocks: list[Block], ratios: np.ndarray) -> list[bool]:
    """Whether each block is main text: the mean of its path's weighted ratios reaches the threshold."""
    top = float(ratios.max())
    limit = max(min(max(DEVIATIONS * float(ratios.std()), LEAST_PART * top), MOST_PART * top), FLOOR)
    within, by_path = any(b.inside for b in blocks), defaultdict(list)
    for b, x in zip(blocks, ratios, strict=True):
        by_path[b.path].append(float(x) * (INSIDE if b.inside else OUTSIDE if within else 1.0))
    chosen = {path: float(np.mean(values)) >= limit for path, values in by_path.items()}
    return [chosen[b.path] for b in blocks]


def main_text(page: str | None) -> str:
    """The main text of a page; empty if it has none."""
    blocks, texts = [], []
    for b in blocks_of(page or ""):
        if joined := " ".join("".join(b.parts).split()):
            blocks.append(b)
            texts.append(joined)
    if not blocks:
        return ""
    return "\n\n".join(t for t, good in zip(texts, content(blocks, fused(blocks, texts)), strict=True) if good)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; null ids and urls stay null; repeated rows each give a row. A page is
    read whole, whatever its length, and broken markup is read as far as it goes: an unfinished tag at the end is
    dropped. An empty table gives no rows and other columns are ignored.
    """

    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
