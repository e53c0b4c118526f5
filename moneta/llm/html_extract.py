"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tags and words.  Words score positive and tags negative;
a linear scan finds the contiguous region with the largest sum, and the region's
words that score positive are the main text.

Weights come from labelled pages: a bounded sample of pages with exactly one
``article`` element is the labelled set, with the words inside it as content.
For every tag name, class and id the share of content among the words that it
encloses gives a log-odds.  A word takes its weight from the nearest enclosing
landmark (a sectioning element, or one whose class or id has a decisive weight), so
a notice or advert inside the article scores negative, and an ordinary link or
list there doesn't.  A tag costs the more, the less content it was seen with, and
little inside a content landmark.
Names that are landmarks on any page start from fixed counts, so pages of a kind
that the sample lacks are still read.

Defined results: null or empty html gives an empty text; broken markup never fails
(an unclosed tag is text, an unclosed script or comment runs to the end); ties go
to the earliest region; identical pages get the same text; an empty table gives an
empty result; input columns stay, but ``text`` and ``n_chars`` replace columns of
that name.
"""
from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import bounded_sample

# --- FIXED VALUES: names by their role in HTML ---
SKIPPED = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
SECTIONS = frozenset("article main section nav aside header footer form head body dialog menu fieldset button".split())
CONTENT = "article main content post entry story".split()
OTHER = ("nav menu header footer aside sidebar form head dialog button fieldset ad ads advert advertisement banner promo sponsor "
         "notice cookie cookies consent popup modal comment comments respond reply replies share social related breadcrumb "
         "breadcrumbs newsletter subscribe login search pagination copyright widget toolbar masthead").split()
#: Words that each fixed name counts as seen with; log-odds that decide; bounds of a tag's cost.
PRIOR, DECISIVE, CHEAP, DEAR = 50, 1.0, 0.3, 6.0
#: Cost of a tag or of a foreign word inside a content landmark, so that these don't cut the region.
INNER = 0.05

_PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(SKIPPED) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def pieces(page: str) -> Iterator[tuple[str, str, list[str] | str]]:
    """("open", tag, features), ("close", tag, []), ("text", "", decoded text)."""
    for m in _PARTS.finditer(page):
        if m[5] is not None:
            yield "text", "", html.unescape(m[5])
        elif m[3]:
            tag = m[3].lower()
            if m[2]:
                yield "close", tag, []
            else:
                names = [x.lower() for n in _NAMES.findall(m[4] or "") for x in "".join(n).split()]
                yield "open", tag, [tag, *("." + x for n in names for x in {n, *re.split(r"[-_]+", n)} if x)]


def walk(page: str, side=lambda tag, features: 0):
    """(kind, tag, features, text, open elements, near, within) of the pieces of a page.  near: the
    ``side`` (1, -1) of the nearest landmark, or 0; within: whether one around it is content."""
    stack: list[tuple[str, list[str], int, bool]] = []
    depth: Counter = Counter()
    for kind, tag, what in pieces(page):
        near, within = stack[-1][2:] if stack else (0, False)
        if kind == "open":
            yield kind, tag, what, "", stack, near, within
            if tag not in VOID:
                own = side(tag, what)
                stack.append((tag, what, own or near, within or own > 0))
                depth[tag] += 1
        elif kind == "close":
            own = [tag]
            while depth[tag]:
                name, own, _, _ = stack.pop()
                depth[name] -= 1
                if name == tag:
                    break
            near, within = stack[-1][2:] if stack else (0, False)
            yield kind, tag, own, "", stack, near, within
        else:
            yield kind, "", [], what, stack, near, within


def learn(pages: list[str]) -> dict[str, float]:
    """Log-odds of content for the tags, classes and ids of labelled pages."""
    inside, outside = Counter(), Counter()
    for x in CONTENT:
        inside[x] += PRIOR
        inside["." + x] += PRIOR
    for x in OTHER:
        outside[x] += PRIOR
        outside["." + x] += PRIOR
    for page in pages:
        for kind, _, _, text, stack, _, _ in walk(page):
            if kind == "text" and (n := len(text.split())):
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "article"), None)
                # the elements inside the article speak for content; those outside it for the rest, but not those around it
                for _, features, _, _ in stack if at is None else stack[at:]:
                    for f in set(features):
                        (outside if at is None else inside)[f] += n
    return {f: math.log((inside[f] + 1) / (outside[f] + 1)) for f in inside.keys() | outside.keys()}


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""

    def side(tag: str, features: list[str]) -> int:
        """1 or -1 for a landmark, 0 for any other element."""
        named = [weights.get(f, 0.0) for f in features if f[0] == "."] if tag not in INLINE else []
        if min(named, default=0.0) <= -DECISIVE:
            return -1
        if max(named, default=0.0) >= DECISIVE:
            return 1
        w = weights.get(tag, 0.0) if tag in SECTIONS and tag != "body" else 0.0
        return (w >= DECISIVE) - (w <= -DECISIVE)

    def word(near: int, within: bool) -> float:
        return (-INNER if within else -1.0) if near < 0 else 1.0 if near else 0.5

    def cost(features: list[str], within: bool) -> float:
        """What a tag costs: little where a landmark says content, though a menu may stand there."""
        return -INNER if within else -min(DEAR, max(CHEAP, -min((weights.get(f, 0.0) for f in features), default=0.0)))

    blocks: list[tuple[float, str]] = []  # score of the words, text; a tag is a block without text
    scores: list[float] = []
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for kind, tag, features, text, _, near, within in walk(page, side):
        if kind == "text":
            each = word(near, within)
            score = each * len(text.split())
            blocks.append((each, text))
        else:
            score = cost(features, within)
            blocks.append((0.0, "" if tag in INLINE else " "))
        scores.append(score)
        if total <= 0:
            total, start = 0.0, len(scores) - 1
        total += score
        if total > best:
            best, best_from, best_to = total, start, len(scores)
    return " ".join("".join(t if w >= 0 else " " for w, t in blocks[best_from:best_to]).split())


def extract_pages(pages: DataFrame, sample: int = 1000) -> DataFrame:
    """``pages`` without html, plus text and n_chars.  ``sample``: labelled pages, by the
    hash of their html, that the weights are learned from."""
    labelled = pages.where(F.size(F.regexp_extract_all("html", F.lit(r"(?i)(<article\b)"))) == 1).select("html")
    chosen = bounded_sample(labelled, sample, "html").toPandas()["html"]
    weights = learn(list(chosen))

    @F.pandas_udf("string")
    def main_text(page: pd.Series) -> pd.Series:
        return page.map(lambda h: extract(h, weights))

    return pages.withColumn("text", main_text("html")).withColumn("n_chars", F.char_length("text").cast("long")).drop("html")
