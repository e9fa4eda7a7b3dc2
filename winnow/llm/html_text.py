"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score by where they stand (their block element and
the section around it), tags by their name and section and never above a small loss; the weights are log odds of
standing in the main text, counted over all labelled pages. One linear scan finds the contiguous
region with the highest total, and what inside it belongs to menus, notices, adverts, forms,
comments and the like is left out.

A page is labelled by its own markup where it has one ``article`` (or, without any, one ``main``).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shipping import ship

# Fixed values of HTML: elements without content, inline elements, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HIDDEN = frozenset("head iframe math noembed noframes noscript object script style svg template textarea title".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SECTIONS = frozenset("article aside body dialog div fieldset figure footer form header main menu nav section".split())
BOILERPLATE = frozenset("aside button dialog fieldset footer form header menu nav select".split())
# Elements that hold a page or its main text, whatever their attributes say.
UNMARKED = frozenset("article body html main".split())
# Names in class, id and role attributes of a part that is no main text.
MARKS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "footer header login menu modal nav navbar navigation newsletter notice pagination popup promo related share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

TAG_LOSS = -0.05
SMOOTHING = 1.0
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Token(NamedTuple):
    """Text with its block and section, or a tag; ``gold`` is whether it stands in the page's labelled region."""

    text: str | None
    tag: str
    section: str
    boilerplate: bool
    gold: bool
    breaks: bool


Weights = dict[str, float]


def train(pages: DataFrame, text: str = "html") -> Weights:
    """Log odds of every block, section and tag; empty without labelled pages, which leaves built-in signs."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                tokens = list(tokenize(page.as_py() or ""))
                if sum(t.text is None and t.tag == "article" for t in tokens) == 1 or any(t.gold for t in tokens):
                    for token in tokens:
                        (inside if token.gold else outside).update(_features(token))
        names = sorted(inside.keys() | outside.keys())
        columns = [names, [inside[n] for n in names], [outside[n] for n in names]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["feature", "inside", "outside"])

    counted = pages.select(text).mapInArrow(run, "feature string, inside long, outside long").groupBy("feature")
    rows = counted.agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return {r.feature: math.log((r.inside + SMOOTHING) / (r.outside + SMOOTHING)) for r in rows}


def extract(pages: DataFrame, weights: Weights, text: str = "html") -> DataFrame:
    """The input's columns without ``text``'s, plus ``text`` (the main text) and ``n_chars`` (its code points).

    Null and empty pages, and pages without a region of positive score, have an empty text; repeated
    pages keep a row each. Input columns named ``text`` or ``n_chars`` are replaced.
    """
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (text, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", weights) for page in batch.column(len(kept))]
            columns = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(columns, [*kept, "text", "n_chars"])

    found = [F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")]
    return pages.select(*kept, text).mapInArrow(run, pages.select(*kept, *found).schema)


def tokenize(page: str) -> Iterator[Token]:
    """Texts and tags of a page in order; comments, declarations and hidden elements give nothing."""
    stack: list[tuple[str, str, bool, bool]] = []  # element, section, boilerplate, hidden
    main = "article" if re.search(r"<article[\s>]", page, re.I) else "main"
    depth = at = 0
    while match := _TOKEN.match(page, at):
        at = match.end()
        close, name, attributes = match.groups()
        section, boilerplate, hidden = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else ("body", False, False)
        if name is None:
            text = match.group()
            if not hidden and not (text.startswith("<!") or text.startswith("<?")):
                block = next((e for e, *_ in reversed(stack) if e not in INLINE), "body")
                yield Token(text, block, section, boilerplate, depth > 0 and not boilerplate, False)
            continue
        name = name.lower()
        breaks = name not in INLINE
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    depth -= sum(e == main for e, *_ in stack[i:])
                    del stack[i:]
                    break
            if not hidden:
                yield Token(None, name, section, boilerplate, depth > 0 and not boilerplate, breaks)
            continue
        if breaks:
            _end_paragraph(stack, name)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            marks = _marks(attributes) if attributes and name not in UNMARKED else ""
            own = name in BOILERPLATE or bool(marks and name not in INLINE)
            if name in SECTIONS:
                section = f"{name}.{marks}" if marks else name
            stack.append((name, section, boilerplate or own, hidden or name in HIDDEN))
            depth += name == main
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                at = end.start() if end else len(page)
        if not hidden:
            yield Token(None, name, section, boilerplate, depth > 0 and not boilerplate, breaks)


def main_text(page: str, weights: Weights) -> str:
    tokens = list(tokenize(page))
    first, last = region(tokens, weights)
    blocks, inside = [], []
    for token in tokens[first:last]:
        if token.text is None:
            if token.breaks:
                blocks.append("".join(inside))
                inside.clear()
        elif not token.boilerplate:
            inside.append(html.unescape(token.text))
    blocks.append("".join(inside))
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def region(tokens: list[Token], weights: Weights) -> tuple[int, int]:
    """The contiguous tokens with the highest positive total, the first and longest among equals."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, token in enumerate(tokens):
        if total <= 0:
            total, start = 0.0, i
        if token.text is None:
            total += _tag_score(token, weights)
        elif n := len(token.text.split()):
            total += n * _word_score(token, weights)
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _tag_score(token: Token, weights: Weights) -> float:
    return min(weights.get(f"tag {token.tag}", 0.0) + weights.get(f"section {token.section}", 0.0), TAG_LOSS)


def _word_score(token: Token, weights: Weights) -> float:
    block, section = weights.get(f"block {token.tag}"), weights.get(f"section {token.section}")
    if block is None and section is None:
        return -1.0 if token.boilerplate else 1.0
    score = (block or 0.0) + (section or 0.0)
    return min(score, -1.0) if token.boilerplate else score


def _features(token: Token) -> dict[str, int]:
    if token.text is None:
        return {f"tag {token.tag if len(token.tag) < 20 else 'other'}": 1}
    n = len(token.text.split())
    tag = token.tag if len(token.tag) < 20 else "other"
    return {f"block {tag}": n, f"section {token.section}": n} if n else {}


def _marks(attributes: str) -> str:
    """The first name in class, id or role that is of ``MARKS``, or made up of them alone as in ``cookie-notice``."""
    for groups in _NAMES.findall(attributes):
        for name in "".join(groups).lower().split():
            parts = [word for word in _SPLIT.split(name) if word]
            if parts and MARKS.issuperset(parts):
                return parts[0]
    return ""


def _end_paragraph(stack: list, name: str) -> None:
    """A new block ends an open paragraph, and a new item of a list or table the one before it."""
    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
    wanted = ("p", *ends.get(name, ()))
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in wanted and name != "br":
            del stack[i:]
            return
        if stack[i][0] not in INLINE:
            return
