"""HTML extraction by line-block distribution: the text between the surge and dive points of window sums of line lengths.

Markup is stripped into lines, one for each block of the page. Lines of menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, known by their elements, roles and class names, are blanked. Each
blanked element leaves a gap of blank lines, but adverts, forms and notices leave none, as they may stand anywhere in a text.
Over the lengths of the lines, sums over windows of ``WINDOW`` lines rise from zero at a surge point and fall to zero at a
dive point, and the run between is accepted if the sum somewhere reaches ``SURGE`` (or the page's largest, if that is less).
Where a page has ``article`` or ``main`` elements with text, runs in those are looked at, and an element with an accepted run
is kept from end to end, so that nothing of an article is lost; one without is left out, unless it stands between two that
have one. On other pages lines that are mostly links count nothing, and the text goes from the first accepted run to the
last, with every line between that isn't blanked.

Defined cases: null or empty pages and pages without text give an empty text; cut-off pages are read to their end, an
unfinished tag being markup; unknown character references stay as they are. Repeated rows are extracted alike. The whole
page is read. Extra columns are not carried.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .runtime import need, ship, table
from .text import pieces

WINDOW = 3
SURGE = 60
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/><]*)([^<>]*)(?:>|\Z)|<[!?/][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names, roles and class words.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "xmp", "noframes"}
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "label", "fieldset", "search", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status", "note"}
CLASSES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "banner", "banners", "sponsor", "sponsored", "promo", "promos", "promotion", "nav", "navbar", "navigation",
    "menu", "menus", "topbar", "breadcrumb", "breadcrumbs", "crumbs", "header", "masthead", "footer", "colophon", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
    "alert", "disclaimer", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "related",
    "recommended", "recommendations", "widget", "widgets", "popup", "modal", "overlay", "toolbar", "pagination", "pager", "skip", "toc", "copyright", "legal", "form", "search",
}
#: Elements, roles and class words of parts that may stand anywhere in a text and leave no gap.
INSETS = {"form", "dialog", "button", "select", "input", "label", "fieldset", "search", "datalist"}
INSET_ROLES = {"search", "form", "dialog", "alertdialog", "alert", "status", "note"}
INSET_CLASSES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "banner", "banners", "sponsor", "sponsored", "promo", "promos", "promotion", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "notification", "alert", "disclaimer", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "popup", "modal", "overlay", "form", "search",
}
#: Words that make a class name one of the page's frame ("with-sidebar", "no-ads") rather than of the part itself.
FRAME = {"with", "has", "no", "without", "wrapper", "wrap", "container", "page", "layout", "content", "main", "body"}
#: Open elements whose end tag may be left out before an element of the name.
IMPLIED = {
    "li": {"li"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
    **dict.fromkeys(("tbody", "thead", "tfoot"), {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}),
}
HEADINGS = {"h1"}
HOLDERS = {"article", "main"}


def _tokens(page: str) -> list[tuple[str, bool, str, str]]:
    """(name, whether it closes, attributes, text behind it) of each tag; the content of raw elements is left out."""
    out: list[tuple[str, bool, str, str]] = []
    at, n = 0, len(page)
    name, closes, attributes = "", False, ""
    while True:
        m = TOKEN.search(page, at)
        out.append((name, closes, attributes, page[at : m.start() if m else n]))
        if not m:
            return out
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closes, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closes and not attributes.endswith("/"):
            end = RAW_END[name].search(page, at)
            at = end.start() if end else n


def _attributes(attributes: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}


def _named_away(name: str, attributes: str) -> bool:
    """Whether an element's role or class names say that it isn't of the article."""
    if name in ("html", "body", "main") or not attributes:
        return False
    got = _attributes(attributes)
    if got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
        return True
    for label in f"{got.get('class', '')} {got.get('id', '')}".split():
        parts = {w.lower() for w in WORD.findall(label)}
        if parts & CLASSES and not parts & FRAME or label.lower() in CLASSES:
            return True
    return False


def _inset(name: str, attributes: str) -> bool:
    """Whether an element that isn't of the article is an advert, a form or a notice, and nothing else by its names."""
    if name in DROPPED:
        return name in INSETS
    got = _attributes(attributes)
    own = {w.lower() for label in f"{got.get('class', '')} {got.get('id', '')}".split() for w in (*WORD.findall(label), label)} & CLASSES
    role = got.get("role", "").lower()
    return own <= INSET_CLASSES and (role not in ROLES or role in INSET_ROLES)


def _ends(tokens: list[tuple[str, bool, str, str]]) -> tuple[list[int], list[int]]:
    """For each opening tag, the token at which its element ends, and its parent (or -1)."""
    ends, parents, stack = [len(tokens)] * len(tokens), [-1] * len(tokens), []
    places: dict[str, list[int]] = {}  # of each name's open elements: where they are in the stack

    def pop(at: int) -> None:
        top = stack.pop()
        places[tokens[top][0]].pop()
        ends[top] = at

    for i, (name, closes, attributes, _) in enumerate(tokens):
        if not name:
            continue
        if closes:
            if own := places.get(name):
                for _ in range(len(stack) - own[-1]):
                    pop(i)
            continue
        while stack and (name in BLOCK and tokens[stack[-1]][0] == "p" or tokens[stack[-1]][0] in IMPLIED.get(name, ())):
            pop(i)
        parents[i] = stack[-1] if stack else -1
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            ends[i] = i
        else:
            places.setdefault(name, []).append(len(stack))
            stack.append(i)
    return ends, parents


def lines_of(page: str) -> tuple[list[str], list[int], list[bool]]:
    """The page's lines, blanked where they aren't of the article, the number of the article that each is in (or 0), and whether it is mostly links."""
    tokens = _tokens(page)
    ends, parents = _ends(tokens)
    headings = [i for i, t in enumerate(tokens) if t[0] in HEADINGS and not t[1]]
    holders = [i for i, t in enumerate(tokens) if t[0] in HOLDERS and not t[1]]
    holds = lambda i, marks: any(i < m < ends[i] for m in marks)
    dropped, until = [False] * len(tokens), -1
    inside, inside_until, inside_of = [0] * len(tokens), -1, 0
    inset, inset_ends, small = [False] * len(tokens), set(), False
    for i, (name, closes, attributes, _) in enumerate(tokens):
        if i >= until and name and not closes:
            away = False
            if name in DROPPED:
                kept_title = name == "header" and holds(i, headings) and any(h < i < ends[h] for h in holders)
                away = name in ("head", "nav", "footer") or not holds(i, holders) and not kept_title and not (name in ("form", "fieldset") and holds(i, headings))
            elif _named_away(name, attributes):
                away = not holds(i, headings) and (not holds(i, holders) or any(not i <= m < ends[i] for m in holders))
            if away:
                until, small = ends[i], _inset(name, attributes)
                if small and until < len(tokens) and tokens[until][1] and tokens[until][0] == name:
                    inset_ends.add(until)
        dropped[i] = i < until
        inset[i] = dropped[i] and small
        if i >= inside_until and name in HOLDERS and not closes and not dropped[i]:
            inside_until, inside_of = ends[i], inside_of + 1
        inside[i] = inside_of if i < inside_until else 0
    lines, article, links = [""], [0], [0]
    linked = 0
    for i, (name, closes, _, text) in enumerate(tokens):
        if name == "a":
            linked = max(0, linked + (-1 if closes else 1)) if closes else 1
        if inset[i]:
            if name in BLOCK and lines[-1].strip() and not (i and inset[i - 1]):
                lines.append("")
                article.append(inside[i])
                links.append(0)
            lines[-1] += " "
            continue
        if name in BLOCK and i not in inset_ends:
            lines.append("")
            article.append(inside[i])
            links.append(0)
            linked = 0
        if dropped[i]:
            if not (i and dropped[i - 1]):
                for _ in range(WINDOW):
                    lines.append("")
                    article.append(inside[i])
                    links.append(0)
            continue
        if i and dropped[i - 1] and not inset[i - 1]:
            lines.append("")
            article.append(inside[i])
            links.append(0)
        if name == "br":
            lines[-1] += " "
        if text:
            lines[-1] += text
            links[-1] += len(text) if linked else 0
    clean = [" ".join(html.unescape(x).split()) if x else "" for x in lines]
    return clean, article, [n > 0.5 * len(x) for n, x in zip(links, lines, strict=True)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, article, linked = lines_of(page)
    of = np.array(article)
    named = any(a and c for a, c in zip(article, lines, strict=True))
    size = np.array([len(c) if a or not named and not l else 0 for c, a, l in zip(lines, article, linked, strict=True)])
    padded = np.concatenate([np.zeros(WINDOW - 1, np.int64), size, np.zeros(WINDOW - 1, np.int64)])
    total = np.convolve(padded, np.ones(WINDOW, np.int64), "valid")  # total[i]: the window that ends with line i
    filled = np.concatenate([[0], (total > 0).astype(np.int64), [0]])
    surges, dives = np.flatnonzero(np.diff(filled) > 0), np.flatnonzero(np.diff(filled) < 0)
    least = max(1, min(SURGE, int(total.max(initial=0))))
    runs = [(a, min(b, len(lines))) for a, b in zip(surges, dives, strict=True) if total[a:b].max() >= least]
    if not runs:
        return ""
    first, last = runs[0][0], runs[-1][1]
    if named:
        whole = np.flatnonzero(np.isin(of, np.unique(np.concatenate([of[a:b] for a, b in runs]))) & (of > 0))
        first, last = whole[0], whole[-1] + 1
    return "\n".join(lines[i] for i in range(first, last) if lines[i] and (size[i] or not named))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``."""
    ship(pages.sparkSession)
    rows = need(pages, id=id_col, url=url_col, html=html_col)

    def extracted(batches):
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(extracted, f"id {kind}, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
