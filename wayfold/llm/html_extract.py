"""Main text of web pages by the maximum-scoring subsequence.

A page is cut into blocks (runs of text between block-level tags). Words score positive and tags
negative, and one linear scan finds the contiguous run of blocks with the largest sum. Weights come
from labelled pages: pages that mark their own main text by an ``article`` or ``main`` element. A
tag's weight is the log ratio of its rate per word inside and outside the marked text, a word's weight
that of linked and unlinked words, on at most ``TRAIN_PAGES`` pages with the smallest hashes of their id.

Text of elements that can't be article text (``OUTSIDE`` tags, and elements with a class, id or role
all of whose words are ``OUTSIDE_NAMES``) scores nothing and is never returned, wherever it stands. Forms
and elements so named that enclose the main text are wrappers and don't count (see ``_wrappers``). The
run is then widened by the article or main elements it touches, so that a short last paragraph is not
lost to the tags around it; nothing of the run is given up for them.

Character references are decoded, white space in a block becomes one space, blocks are trimmed,
empty ones left out, and the rest joined in page order by one newline. Unclosed elements are closed as
browsers do: a new block ends an open paragraph, a new item an open item, an end tag all it encloses.

Defined cases: null and empty html, and pages without words, give an empty text; a ``<`` that begins no
tag is text; an unclosed comment, script, style or tag reaches to the end, and so does a quoted attribute without its
closing quote; very long pages take time in proportion; repeated pages are all returned.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 2_000

# Names of HTML elements and of their usual roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("aside button canvas dialog footer form head iframe input label legend menu nav noscript object option select svg template textarea title".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adslot advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog discussion disqus footer form login menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted "
    "related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))

# Every alternative that begins with a tag's name reaches its end or the page's, without going back: time is linear.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?>[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?", re.S)
_NAMING = frozenset(("class", "id", "role"))
_WORDS = re.compile(r"\S+")


class Block:
    """Text between two block-level tags, the tags before it, and where it stands."""

    __slots__ = ("parts", "linked", "tags", "away", "outside", "main")

    def __init__(self, away: tuple[int, ...], main: int):
        self.parts: list[str] = []
        self.linked = 0
        self.tags: list[str] = []
        self.away = away
        self.outside = bool(away)
        self.main = main

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _attributes(text: str) -> Iterator[tuple[str, str]]:
    for m in _ATTRIBUTE.finditer(text):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def _names_outside(attributes: str) -> bool:
    for name, value in _attributes(attributes):
        if name in _NAMING:
            for token in value.lower().split():
                words = set(filter(None, re.split(r"[^a-z]+", token)))
                if words and words <= OUTSIDE_NAMES:
                    return True
    return False


def _hidden(attributes: str) -> bool:
    return "hidden" in attributes.lower() and any(name == "hidden" for name, _ in _attributes(attributes))


def _wrappers(found: list[Block], enclosing: dict[str, set[int]]) -> set[int]:
    """Forms and named elements that enclose the main text: those around a main element, forms around an h1, and
    those around an article if no article or main element stands free (else it is a teaser in a list)."""
    free = any(b.main and not b.away for b in found)
    return enclosing["main"] | enclosing["h1"] | (set() if free else enclosing["article"])


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, empty ones included (their tags count)."""
    stack: list[tuple[str, bool, bool]] = []  # name, outside, main
    open_names: Counter[str] = Counter()
    away_now: list[tuple[int, str]] = []  # number and kind (tag, form, named) of the open elements that are outside
    enclosing: dict[str, set[int]] = {"main": set(), "article": set(), "h1": set()}
    numbered = links = articles = mains = 0
    current = Block((), 0)
    found = [current]

    def close() -> None:
        nonlocal links, mains
        name, was_outside, was_main = stack.pop()
        open_names[name] -= 1
        if was_outside:
            away_now.pop()
        links -= name == "a"
        mains -= was_main

    def close_to(name: str, until: frozenset[str]) -> None:
        """Closes the innermost open ``name`` unless one of ``until`` encloses it more closely."""
        if open_names[name]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        close()
                    return
                if stack[k][0] in until:
                    return

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                current.parts.append(text)
                if links:
                    current.linked += len(_WORDS.findall(text))
            continue
        name = name.lower()
        block = name in BLOCK
        if m[2]:
            if open_names[name]:
                while stack[-1][0] != name:
                    close()
                close()
        else:
            if block:
                close_to("p", BLOCK - {"p"})
                if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close_to(name, frozenset(("ul", "ol", "dl", "table", "select")))
        if name == "br" or name == "hr":
            current.parts.append(" ")
        if not m[2] and name not in VOID and not m[4].endswith("/"):
            is_main = name in MAIN
            if is_main and not mains:
                articles += 1
            if name in enclosing and not any(kind == "tag" for _, kind in away_now):
                enclosing[name].update(n for n, kind in away_now if kind == "form" or kind == "named" and is_main)
            styled = bool(m[4]) and not (is_main or name in ("body", "html"))
            away = ""
            if name in OUTSIDE and name != "form" or name == "header" and not mains or styled and _hidden(m[4]):
                away = "tag"
            elif styled and _names_outside(m[4]):
                away = "named"
            elif name == "form":
                away = "form"
            stack.append((name, bool(away), is_main))
            open_names[name] += 1
            if away:
                numbered += 1
                away_now.append((numbered, away))
            links += name == "a"
            mains += is_main
        if block:
            current = Block(tuple(n for n, _ in away_now), articles if mains else 0)
            found.append(current)
        current.tags.append(name)
    wrappers = _wrappers(found, enclosing)
    if wrappers:
        for b in found:
            b.outside = not wrappers.issuperset(b.away)
    return found


def _kinds(block: Block) -> Iterator[tuple[str, int]]:
    words = len(_WORDS.findall("".join(block.parts)))
    yield "word", words - block.linked
    yield "linked word", block.linked
    for tag in block.tags:
        yield tag, 1


def learn_weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of words and tags from their counts (inside, outside) of marked main text: words positive, tags negative."""
    inside, outside = counts.get("word", (0, 0))
    linked_in, linked_out = counts.get("linked word", (0, 0))
    inside, outside = inside + linked_in + 1, outside + linked_out + 1
    ratio = {k: math.log(((i + 1) / inside) / ((o + 1) / outside)) for k, (i, o) in counts.items()}
    weights = {k: min(-0.05, max(-4.0, v)) for k, v in ratio.items() if k not in ("word", "linked word")}
    weights["word"] = min(2.0, max(0.5, ratio.get("word", 1.0)))
    weights["linked word"] = min(weights["word"], max(0.05, ratio.get("linked word", 0.05)))
    return weights


def best_run(page_blocks: list[Block], weights: dict[str, float]) -> tuple[int, int]:
    """First and end block of the run with the largest score; an empty run if no word scores."""
    best, best_run_, total, start = 0.0, (0, 0), 0.0, 0
    for k, block in enumerate(page_blocks):
        before = sum(weights.get(tag, -1.0) for tag in block.tags)
        if total + before <= 0:
            total, start = 0.0, k
        else:
            total += before
        if not block.outside:
            words = len(_WORDS.findall("".join(block.parts)))
            total += (words - block.linked) * weights["word"] + block.linked * weights["linked word"]
        if total > best:
            best, best_run_ = total, (start, k + 1)
    return best_run_


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    found = blocks(page)
    first, end = best_run(found, weights)
    touched = {b.main for b in found[first:end] if b.main and not b.outside}
    texts = (b.text() for k, b in enumerate(found) if (first <= k < end or b.main in touched) and not b.outside)
    return "\n".join(t for t in texts if t)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column("_html"):
            found = blocks(page.as_py() or "")
            if any(b.main for b in found):
                for b in found:
                    into = inside if b.main and not b.outside else outside
                    for kind, n in _kinds(b):
                        into[kind] += n
    kinds = sorted((set(inside) | set(outside)) & (BLOCK | {"a", "b", "i", "em", "strong", "span", "br", "img", "word", "linked word"}))
    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], names=["kind", "inside", "outside"])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    sample = pages.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(train_pages).distinct()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).join(F.broadcast(sample), "_id", "left_semi")
    counts = rows.select("_html").mapInArrow(_count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return learn_weights({r["kind"]: (r["i"], r["o"]) for r in counts})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    weights = train(pages, id_col, html_col)

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py(), weights) for page in column], pa.string())

    told = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("text"))
    return told.withColumn("n_chars", F.length("text").cast("long"))
