"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block element gives a line; of scripts, styles and what is hidden there are none. A line's length is that of its text, weighed by where it stands: what is no article by its element
or its name (menus, headers, footers, sidebars, notices, adverts, forms) has little of its length, reader comments have none, and a word that may as well belong to a story (``DOUBTFUL``) counts half within
an article. A change of weight, and the ends of marked articles, leave a gap of empty lines.

Lengths are summed over windows of ``WINDOW`` lines. A surge is where the sums rise from nothing, a dive where they are nothing again; the text between is a stretch. A stretch is kept

* of full weight, outside of marked articles: if it is in links for at most ``LINKED``, however short it is, and with it the paragraphs in the same container; where there are none, all are;
* of little weight: if it still rises to ``LEAST`` and to the part ``RISE`` of the highest sum of the page;
* on a page that marks its articles: if it is in one, or has at least ``OUTWEIGHS`` times the text of all that are.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

WINDOW = 3
LINKED = 0.5
#: Part of its length that a line has which is no article by its element or name, and one that may be none.
LITTLE, HALF = 0.04, 0.5
LEAST, RISE, OUTWEIGHS = 10.0, 0.2, 2.0

# Names of elements, and words in class, id and role that mark what is no article.
RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|head"
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption address header footer nav aside form fieldset details summary hr center hgroup menu dialog".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd blockquote pre figcaption".split())
CONTAINERS = frozenset("div section table ul ol dl".split())
DROPPED = frozenset("nav footer aside form button menu dialog label input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer header copyright "
    "comment comments disqus replies respond related recommended share sharing social subscribe subscription newsletter signup login "
    "popup modal overlay search pagination pager widget widgets complementary contentinfo dialog hidden".split()
)
COMMENT_WORDS = frozenset(
    "comment comments disqus replies respond comment-list comments-list commentlist comment-body comment-content comment-text comment-form comment-respond "
    "comment-thread comment-section comments-section comments-area comments-wrapper comments-container disqus-thread user-comments post-comments reader-comments".split()
)
#: Names of several words that mark what is no article; other compounds say nothing by a word in them (no-sidebar, page-header).
BAD_NAMES = BAD_WORDS | COMMENT_WORDS | frozenset(
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper ad-placeholder advert-box banner-ad banner-ads google-ad google-ads div-gpt-ad sponsored-content sponsored-links promo-box "
    "cookie-notice cookie-banner cookie-bar cookie-consent cookie-message cookie-popup cookie-law cookies-notice cookies-banner consent-banner gdpr-notice gdpr-banner site-notice notice-bar alert-bar alert-banner "
    "side-bar left-sidebar right-sidebar sidebar-left sidebar-right primary-sidebar secondary-sidebar main-sidebar sidebar-widget side-nav side-menu "
    "main-menu main-nav main-navigation site-nav site-navigation site-menu primary-nav primary-menu secondary-nav top-nav top-menu top-bar nav-bar nav-menu nav-links navbar-nav menu-bar mobile-menu mobile-nav "
    "bread-crumb bread-crumbs breadcrumb-nav breadcrumbs-nav site-header global-header main-header top-header site-footer global-footer main-footer page-footer footer-nav footer-links footer-menu footer-widgets "
    "related-posts related-articles related-stories related-content related-links related-news recommended-posts recommended-articles recommended-stories "
    "share-bar share-buttons share-links sharing-buttons social-bar social-buttons social-icons social-links social-media social-share "
    "newsletter-signup newsletter-form newsletter-box subscribe-form subscribe-box subscription-form sign-up login-form signup-form search-form search-box search-bar "
    "post-navigation posts-navigation page-navigation page-numbers pop-up popup-overlay modal-dialog modal-overlay widget-area".split()
)
#: Words that say little within a marked article.
DOUBTFUL = frozenset("notice notices alert promotion login signup search header footer copyright widget widgets popup modal overlay dialog banner masthead topbar toolbar pager pagination subscription sponsor sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Outside of quotes no attribute has a "<", so a tag that is never closed is given up at the next one and no page is scanned again and again.
ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|(?=<body[\s>])|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES}|[^<>]*)>|<[!?][^<>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"(?:^|[;{\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)


def _tokens(page: str) -> list[tuple[str, str, object]]:
    """(kind, name, value): text with its string, open with its attributes, close."""
    out, at = [], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        if m[3]:
            out.append(("close" if m[2] else "open", m[3].lower(), m[4]))
    if at < len(page):
        out.append(("text", "", page[at:]))
    return out


def _ends(tokens: list) -> dict[int, int]:
    """Of each open token the place of its close, for elements that are closed."""
    waiting: dict[str, list[int]] = {}
    out = {}
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name not in VOID:
            waiting.setdefault(name, []).append(i)
        elif kind == "close" and waiting.get(name):
            out[waiting[name].pop()] = i
    return out


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(attributes.get("style", "")))


def _marks(attributes: dict[str, str]) -> set[str]:
    """The whole names in class, id and role, with hyphens between their words and without numbers at their end."""
    found = " ".join(attributes.get(x, "") for x in ("class", "id", "role"))
    return {re.sub(r"(?:-?\d[\dx]*)+$", "", x) for x in re.sub(r"_+|--+", "-", re.sub(r"([a-z])([A-Z])", r"\1-\2", found).lower()).split()}


def _articles(tokens: list, ends: dict[int, int], dropped) -> list[tuple[int, int]]:
    """The article and main elements that are in no other, comment or dropped element; of those in one another with the same text the inner one."""
    spans, skip = [], -1
    sizes = list(accumulate((len(t[2]) if t[0] == "text" else 0 for t in tokens), initial=0))
    for i, (kind, name, value) in enumerate(tokens):
        if i <= skip or kind != "open":
            continue
        if name in ("article", "main"):
            marks = _marks(_attributes(value))
            if name == "article" and marks & COMMENT_WORDS:
                skip = ends.get(i, i)
                continue
            j = ends.get(i, len(tokens))
            spans.append((i, j, sizes[j] - sizes[i], bool(marks & BAD_NAMES)))
        elif dropped(i, False):
            skip = ends.get(i, i)
    outer = []
    for span in spans:
        if outer and span[0] < outer[-1][1]:
            if span[2] >= outer[-1][2]:
                outer[-1] = span
        else:
            outer.append(span)
    return [x[:2] for x in outer if not x[3]] or [x[:2] for x in outer]


@dataclass(frozen=True)
class Line:
    """A line of text, or an empty one; the container that it stands in, how many of its characters are links, what they weigh, and whether it is in a marked article."""

    text: str
    container: int = -1
    linked: int = 0
    weight: float = 1.0
    marked: bool = False

    @property
    def size(self) -> float:
        return self.weight * len(self.text)


GAP = [Line("")] * WINDOW


def lines(page: str) -> list[Line]:
    """The page's lines, with gaps where the weight changes and at the ends of marked articles."""
    tokens = _tokens(page)
    ends, n = _ends(tokens), len(tokens)
    marked = [i for i, t in enumerate(tokens) if t[0] == "open" and t[1] in ("article", "main")]

    def weight(i: int, inside: bool) -> float:
        _, name, attributes = tokens[i]
        if not attributes and name not in DROPPED and name != "header":
            return 1.0
        given = _attributes(attributes) if attributes else {}
        marks = _marks(given) if "=" in attributes else set()
        if name in ("html", "body", "article", "main"):
            return 0.0 if marks & COMMENT_WORDS and name == "article" else 1.0
        if marks & COMMENT_WORDS or _hidden(given):
            return 0.0
        bad = marks & BAD_NAMES - ({"header"} if name in HEADINGS else set())
        if name not in DROPPED and not (name == "header" and not inside):
            if not bad:
                return 1.0
            if inside and bad <= DOUBTFUL:
                return HALF
        if name in VOID:
            return LITTLE
        next_mark = bisect_right(marked, i)
        return LITTLE if next_mark == len(marked) or marked[next_mark] >= ends.get(i, i) else 1.0  # else it is a wrapper of the article

    spans = _articles(tokens, ends, lambda i, inside: weight(i, inside) < HALF)
    starts, stops = {a for a, _ in spans}, {b for _, b in spans}
    # where an element ends that is never closed: a paragraph at the next block, others at the next article or first heading
    next_block, next_head = [n] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        kind, name, _ = tokens[i]
        next_block[i] = i if kind != "text" and name in BLOCKS else next_block[i + 1]
        next_head[i] = i if kind == "open" and name in ("article", "main", "h1") else next_head[i + 1]

    out: list[Line] = []
    piece: list[str] = []
    containers, paragraph, link, linked, inside = [0], False, -1, 0, False
    weights: list[tuple[int, float]] = [(n + 1, 1.0)]

    def close(gap: bool = False) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(piece)).split())
        piece.clear()
        if text:
            container = containers[-1] if paragraph or len(containers) > 1 else -1 - len(out)
            out.append(Line(text, container, min(linked, len(text)), weights[-1][1], inside))
        if gap:
            out.extend(GAP)
        linked = 0

    for i, (kind, name, value) in enumerate(tokens):
        while weights[-1][0] <= i:
            close(True)
            weights.pop()
        if i in stops:
            close(True)
            inside = False
        if i in starts:
            close(True)
            inside, paragraph = True, False
        if kind == "text":
            piece.append(value)
            if i < link:
                linked += len(" ".join(value.split()))
            continue
        if kind == "open" and (own := weight(i, inside)) < weights[-1][1]:
            close(own < HALF)
            if i in ends:
                stop = ends[i]
            elif name in VOID:
                stop = i
            else:
                stop = (next_block if name in ("p", "li") else next_head)[i + 1]
            stop = min(stop, weights[-1][0])
            if stop > i:
                weights.append((stop, own))
        if name in BLOCKS:
            close()
            paragraph = kind == "open" and name in PARAGRAPHS
            if name in CONTAINERS and kind == "open":
                containers.append(i)
            elif name in CONTAINERS and len(containers) > 1:
                containers.pop()
        elif name in ("br", "td", "th"):
            piece.append(" ")
        elif name == "a" and kind == "open" and "href" in _attributes(value):
            link = max(link, ends.get(i, i))
    close()
    return out


def stretches(sizes: list[float]) -> list[tuple[int, int, float]]:
    """From a surge of the sums over windows to the dive behind it: first line, the one after the last, and the highest sum."""
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    out, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            out.append((start, i, max(sums[start:i])))
            start = None
    return out


def between_surges(found: list[Line]) -> list[str]:
    """The text of the stretches that are kept, by the rules above."""
    sizes = [x.size for x in found]
    all_stretches = stretches(sizes)
    top = max((peak for *_, peak in all_stretches), default=0.0)
    marked = sum(x.size for x in found if x.marked and x.weight >= HALF)

    def light(a: int, b: int) -> bool:
        return all(x.weight < HALF for x in found[a:b] if x.text)

    def inside(a: int, b: int) -> bool:
        return any(x.marked for x in found[a:b] if x.text)

    own, kept = [], set()
    for a, b, peak in all_stretches:
        if light(a, b):
            if peak >= max(LEAST, RISE * top):
                kept.update(range(a, b))
        elif marked and inside(a, b):
            kept.update(range(a, b))
        elif sum(x.size for x in found[a:b]) >= OUTWEIGHS * marked:
            own.append((a, b))
    plain = [(a, b) for a, b in own if sum(x.linked for x in found[a:b]) <= LINKED * sum(len(x.text) for x in found[a:b])]
    chosen = plain or ([] if marked else own)
    kept.update(i for a, b in chosen for i in range(a, b))
    near = {found[i].container for a, b in chosen for i in range(a, b) if found[i].text}
    return [x.text for i, x in enumerate(found) if x.text and (i in kept or (x.container in near and x.weight >= HALF))]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(between_surges(lines(page)))


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points).

    A null or empty page has the text "". Each page is read whole, by itself. Columns that bear a new name are replaced; rows that repeat stay.
    """
    keep = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    source = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_column}`").alias("page_html"))
    schema = source.drop("page_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
