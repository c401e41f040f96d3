"""Operator 13: the main text of web pages by maximum-scoring subsequences.

A page is a sequence of words and tags.  Words score positive and tags
negative, and the contiguous region with the greatest sum, found in one scan,
is the main content (Kadane's algorithm; of equal sums the longest).  Weights
are log ratios of how often a word or tag of a kind stands inside and outside
the content of labelled pages.  Pages label themselves: one whose text has a
single ``article`` (or, without one, ``main``) element says where its content
is, others have no part in the fit.  Kinds are few (a tag's name; a word's nearest block and
whether it is in a link), so their counts over all pages are one small table.

Elements that are never content (scripts, forms, menus, adverts, comments, what
is hidden: by name, role or class) are left out before scoring and from the text.  A region
most of which is in an ``article`` or ``main`` becomes that element, so that a
heading or last paragraph of one word isn't cut off, and what follows isn't
taken along; another region takes whole blocks.

A block's text has its character references decoded and runs of white space
turned into one space, and is trimmed; blocks are joined by one line feed.

Defined cases: null, empty and tag-only pages have an empty text; a page
without tags is one block; unclosed and stray tags are as browsers have them
(a start tag ends a paragraph, an end tag without its start is nothing);
repeated rows and null ids get a row each; other columns have no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Elements of which the whole content is skipped without looking for tags in it, and those whose words are never content (fixed values of HTML).
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = frozenset("nav aside form button select dialog menu svg math canvas object audio video map datalist fieldset footer".split())
#: Elements that begin and end a block, and those that hold blocks and are matched with their end tags (fixed values of HTML).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul search".split())
HOLDERS = NEVER | frozenset("article main section div header ul ol dl table blockquote figure details span td th li".split())
FLOW = frozenset("p h br pre blockquote b i u s em strong small big sub sup code kbd samp var cite q abbr time mark font del ins tt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Parts of a class, id or role that tell what is never content, those of reader comments and lists of other pages, and those of a page's header.
ROLE = re.compile(
    r"(?<![a-z])(ads?|adsby\w*|advert\w*|adsense|sponsor(ed|s)?|promo\w*|banner|nav(bar|igation)?|menu|breadcrumbs?|side-?bar|footer|cookies?|consent|gdpr|notices?|notification|alert|dialog|pop-?up|modal|overlay|newsletter|subscri\w+|sign-?up|login|form"
    r"|share|sharing|social|pagination|pager|widget|toolbar|skip-?link|search(box|form|bar)?|complementary|contentinfo|masthead|top-?bar)(?![a-z])"
)
OTHERS = re.compile(r"(?<![a-z])(comments?|comment-?list|respond|replies|reply|disqus|discussion|related|recommend\w*)(?![a-z])")
UNSEEN = re.compile(r"(?i)display\s*:\s*none")
HEADER = re.compile(r"((site|page|global|top|main)-)?header")
COMMENT = re.compile(r"comments?(-(body|item|entry|list|[0-9]+))?")
#: What stands before a part that an element merely has, or lacks.
HAS = re.compile(r"(?<![a-z])(has|with|without|no|show|hide)-[\w-]*")
_CONTENT = ("article", "main")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Counts that a kind has before any page is seen, inside and outside the content, and the bounds of weights.
PRIOR = {"word": (3.0, 1.0), "link": (1.0, 1.6), "tag": (1.0, 5.0), "flow": (1.0, 1.3), "edge": (1.0, 2000.0)}
BOUNDS = {"word": (-2.0, 1.0), "link": (-2.0, 1.0), "tag": (-2.0, -0.1), "flow": (-2.0, -0.1), "edge": (-8.0, -0.1)}
#: Share of a page's words that its single content element holds at least; a word outside of it counts as OUTSIDE.
LEAST_SHARE, OUTSIDE = 0.25, -1.0


# --- a page as tokens --------------------------------------------------------


def _role(name: str, attributes: str, within: bool, named: bool) -> int:
    """0 for what may be content, 1 for what is never, 2 for comments and lists of other pages; a header may be if it is the content's own.

    ``named``: whether class, id and role tell.
    """
    if name in NEVER or name == "header" and not within:
        return 1
    if not attributes or name in ("html", "body"):
        return 0
    role = 0
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = next(filter(None, values), ""), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            return 1
        for word in _CAMEL.sub("-", value).lower().replace("_", "-").split() if named and key in ("class", "id", "role") else ():
            if name in _CONTENT:
                role = max(role, 2 * bool(COMMENT.fullmatch(word)))
            else:
                part = HAS.sub("", word)
                role = max(role, 2 * bool(OTHERS.search(part)), int(bool(ROLE.search(part) or not within and HEADER.fullmatch(part))))
    return role


def tokens(html: str, named: bool = True) -> tuple[list[tuple[str, str, int]], list[tuple[int, int, str]]]:
    """Tokens (kind, text, words) of what may be content, and the token ranges of content elements with their names.

    The text of a tag is its name, with a slash before an end tag; that of
    words is the page's.  What is never content has no tokens.
    """
    out, spans, stack, open_spans = [], [], [], []  # stack: (name, role); out of sight while a role on it isn't 0
    at, hidden, link, block, end = 0, 0, False, "body", len(html)

    def pop() -> None:
        nonlocal hidden
        name, role = stack.pop()
        hidden -= role > 0
        if name in _CONTENT and open_spans and open_spans[-1][0] == len(stack):
            k = open_spans.pop()[1]
            spans[k] = (spans[k][0], len(out), name)

    def kind(name: str) -> str:
        return "tag:h" if name in HEADINGS else f"tag:{name}"

    def words(piece: str) -> None:
        if piece and not hidden:
            out.append((f"{'link' if link else 'word'}:{block}", piece, len(unescape(piece).split())))

    while at < end:
        m = _TOKEN.search(html, at)
        words(html[at : m.start()] if m else html[at:])
        if m is None:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            seen = not hidden
            if any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            if seen:
                out.append((kind(name), "/" + name, 0))
            if name == "a":
                link = False
            elif name in BLOCKS:
                block, link = next((n for n, _ in reversed(stack) if n in BLOCKS), "body"), False
            continue
        if name in RAW:
            close = _END_OF_RAW[name].search(html, at)
            at = html.find(">", close.end()) + 1 or end if close else end
            continue
        if name in BLOCKS:
            while stack and stack[-1][0] not in HOLDERS:  # a paragraph or link that ends here
                pop()
            if name == "li" and stack and stack[-1][0] == "li" or name in ("td", "th") and stack and stack[-1][0] in ("td", "th"):
                pop()
            block, link = name, False
        role = _role(name, m[3], bool(open_spans), named)
        if name in _CONTENT and not role and hidden and all(r < 2 for _, r in stack):
            while hidden:  # a menu or advert that nobody closed
                pop()
        if not hidden and not role:
            out.append((kind(name), name, 0))
        link = link or name == "a"
        if name in VOID or name in ("svg", "math") and m[3].endswith("/"):
            continue
        if name in HOLDERS or role:
            if name in _CONTENT and not hidden and not role:
                open_spans.append((len(stack), len(spans)))
                spans.append((len(out), len(out), name))
            stack.append((name, role))
            hidden += role > 0
    while stack:
        pop()
    return out, spans


# --- weights -----------------------------------------------------------------


def label_counts(html: str) -> Counter:
    """(kind, inside) -> how often, of a page that labels itself; nothing of another."""
    found, spans = tokens(html)
    counts: Counter = Counter()
    own = lone(found, spans)
    if own is None:
        return counts
    a, b, _ = own
    for k, (kind, _, n) in enumerate(found):
        counts[kind, a <= k < b] += n if kind[:3] != "tag" else 1
    return counts


def lone(found: list[tuple[str, str, int]], spans: list[tuple[int, int, str]]) -> tuple[int, int, str] | None:
    """The single article, or main without one, if it holds LEAST_SHARE of the words and isn't a teaser."""
    named = [s for s in spans if s[2] == "article"] or spans
    if len(named) != 1:
        return None
    within = sum(t[2] for t in found[named[0][0] : named[0][1]])
    return named[0] if within >= LEAST_SHARE * max(sum(t[2] for t in found), 1) else None


def weight(kind: str, inside: float, outside: float) -> float:
    """The log ratio of a kind, with its prior, within bounds; the tags of content elements are its edges."""
    sort, name = kind.split(":")
    if sort == "tag":
        sort = "edge" if name in _CONTENT else "flow" if name in FLOW else sort
    (a, b), (low, high) = PRIOR[sort], BOUNDS[sort]
    return min(high, max(low, math.log((inside + a) / (outside + b))))


def fit(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights of the kinds that labelled pages have; names that HTML doesn't know are left to the priors, so the table is bounded."""
    known = BLOCKS | HOLDERS | FLOW | {"a", "span", "img"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                counts.update(label_counts(html or ""))
        rows = [(k, i, n) for (k, i), n in counts.items() if n and k.split(":")[1] in known]
        yield pa.RecordBatch.from_pydict({"kind": [r[0] for r in rows], "inside": [r[1] for r in rows], "n": [r[2] for r in rows]}, schema=pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    found = pages.select(F.col(f"`{html_col}`")).mapInArrow(run, "kind string, inside boolean, n long")
    counts = found.groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    return {r.kind: weight(r.kind, r.a, r.b) for r in counts.collect()}


# --- extraction --------------------------------------------------------------


def best_region(scores: list[float]) -> tuple[int, int]:
    """The range with the greatest positive sum, the longest of equal ones; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best > 0 and k + 1 - start > found[1] - found[0]:
            best, found = total, (start, k + 1)
    return found


def main_text(html: str, weights: dict[str, float]) -> str:
    """The text of a page's main content; where class, id and role leave no word of a page, they don't tell."""
    found, spans = tokens(html)
    if not any(t[2] for t in found):
        found, spans = tokens(html, named=False)
    score = lambda t: (t[2] if t[0][:3] != "tag" else 1) * (weights[t[0]] if t[0] in weights else weight(t[0], 0, 0))
    own = lone(found, spans)
    scores = [score(t) if own is None or own[0] <= k < own[1] or t[0][:3] == "tag" else OUTSIDE * t[2] for k, t in enumerate(found)]
    a, b = best_region(scores)
    if a == b:
        return ""
    share = lambda x, y: sum(scores[k] for k in range(max(a, x), min(b, y)) if found[k][2])
    around = [s for s in spans if 2 * share(*s[:2]) > share(a, b)]
    if around:
        a, b, _ = min(around, key=lambda s: s[1] - s[0])
    else:
        while a and not (found[a - 1][0][:3] == "tag" and found[a - 1][1].lstrip("/") in BLOCKS):
            a -= 1
        while b < len(found) and not (found[b][0][:3] == "tag" and found[b][1].lstrip("/") in BLOCKS):
            b += 1
    blocks, own = [], []
    for kind, piece, _ in found[a:b]:
        if kind[:3] != "tag":
            own.append(piece)
        elif piece.lstrip("/") in BLOCKS:
            blocks.append(own)
            own = []
        elif piece == "br":
            own.append(" ")
    blocks.append(own)
    lines = (" ".join(unescape("".join(own)).split()) for own in blocks)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, weights: dict[str, float], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars (code points) of every page."""
    kinds = [T.StructField(c, pages.schema[c].dataType) for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = [main_text(html or "", weights) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([*kinds, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*(F.col(f"`{c}`") for c in (id_col, url_col, html_col))).mapInArrow(run, schema)
