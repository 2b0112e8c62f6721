"""Main text of web pages by the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculo.llm.texts import map_batches

#: Pages with an article or main element from which the weights are learned: those with the smallest hashes of id and url.
MAX_LABELLED = 2000

# Fixed values of HTML and of common page templates.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "head", "select"}
BOILER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "legend", "input", "option"}
BOILER_WORDS = {
    "nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement",
    "advertising", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "reply",
    "replies", "discussion", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "widget", "form", "search", "copyright", "legal", "disclaimer", "toolbar", "masthead", "skip",
}
#: Words that only say which part of a layout a boilerplate word names.
LAYOUT = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "column", "container", "content", "footer", "global", "group", "inner", "item", "items", "left",
    "link", "links", "list", "main", "message", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "text", "thread",
    "title", "top", "unit", "user", "wrap", "wrapper",
}
#: Ids that name reader comments, wherever they stand.
COMMENT_IDS = {"comment", "comments", "replies", "reply", "respond", "disqus"}
#: First parts of class names that only say what a layout has or has not.
MODIFIERS = {"no", "has", "with", "without", "not", "hide", "show", "is"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACES = re.compile(r"[\s ]+")


@dataclass
class Run:
    """Text between two tags: its words' number, whether it starts a block, the element it is in, the tags before it (``outer``: those not inside boilerplate), and whether it lies inside an ``article`` or ``main`` element and inside boilerplate."""

    text: str
    words: int
    block: bool
    place: str
    tags: list[str]
    outer: list[str]
    inside: bool
    dropped: bool


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id names boilerplate as a whole: by its words and words of layout alone, or by its last word."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    if not parts or parts[0] in MODIFIERS or not BOILER_WORDS.intersection(parts):
        return False
    return parts[-1] in BOILER_WORDS or all(p in BOILER_WORDS or p in LAYOUT for p in parts)


def _boiler(tag: str, attributes: str, inside: bool) -> int:
    """2 if the element is boilerplate by its tag, 1 if by its class, id or role, else 0.

    Ids name what a part is about, not only its layout: those of headings tell nothing, and inside an article only those of
    comments do.
    """
    if tag in BOILER:
        return 2
    if tag in ("body", "html", "article", "main"):
        return 0
    for kind, a, b, c in NAMED.findall(attributes) if attributes else ():
        value = (a or b or c).lower()
        if kind.lower() == "role":
            if value in BOILER_ROLES:
                return 1
        elif kind.lower() == "id" and (inside or tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
            if tag[0] != "h" and COMMENT_IDS.intersection(re.split(r"[^a-z]+", value)):
                return 1
        elif any(map(_names_boilerplate, value.split())):
            return 1
    return 0


def _raw_end(tag: str) -> re.Pattern[str]:
    return _ENDS.setdefault(tag, re.compile(rf"</{tag}", re.I | re.A))


_ENDS: dict[str, re.Pattern[str]] = {}


def parse(page: str) -> list[Run]:
    """The page's text runs in order, with the tags before each; the time is linear in the page.

    An element that is boilerplate by its class only is none if it holds an ``article`` or ``main``
    element; a ``header`` inside one of these, with the title, is content.
    """
    out: list[Run] = []
    stack: list[tuple[str, int]] = []  # open elements, and whether each is boilerplate
    places: list[str] = []  # the open block elements
    counts: Counter[str] = Counter()  # how often each tag is open
    dropped = content = 0
    at, n = 0, len(page)
    tags: list[str] = []
    outer: list[str] = []
    block = True

    def leave() -> tuple[str, int]:
        nonlocal dropped, content
        t, bad = stack.pop()
        counts[t] -= 1
        if t in BLOCKS:
            places.pop()
        dropped -= bad > 0
        content -= t in ("article", "main")
        return t, bad

    def text(raw: str) -> None:
        nonlocal tags, outer, block
        raw = html.unescape(raw) if "&" in raw else raw
        words = len(raw.split())
        if raw:
            out.append(Run(raw, words, block, places[-1] if places else "body", tags, outer, content > 0, dropped > 0))
            tags, outer, block = [], [], False

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[1]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[1].lower()
        closing = m[0][1] == "/"
        tags.append(f"/{tag}" if closing else tag)
        block |= tag in BLOCKS
        if not closing and not dropped:
            outer.append(tag)
        if closing:
            if counts[tag]:
                while leave()[0] != tag:
                    pass
            if not dropped:
                outer.append(f"/{tag}")
        elif tag in RAW and tag != "head":
            end = -1
            if m[0].endswith("/>"):
                end = at
            elif found := _raw_end(tag).search(page, at):
                end = found.start()
            if tag == "title" or end >= 0:
                at = n if end < 0 else end
                if end >= 0 and not m[0].endswith("/>"):
                    close = page.find(">", end)
                    at = n if close < 0 else close + 1
            else:
                at = n
        elif tag not in VOID and not m[0].endswith("/>"):
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                leave()
            if tag in ("article", "main"):
                if dropped:
                    dropped -= sum(b == 1 for _, b in stack)
                    stack[:] = [(t, 0 if b == 1 else b) for t, b in stack]
                content += 1
            bad = 0 if tag == "header" and content else _boiler(tag, m[2], content > 0)
            stack.append((tag, bad))
            counts[tag] += 1
            if tag in BLOCKS:
                places.append(tag)
            dropped += bad > 0
    return out


def tokens(page: str) -> dict[tuple[str, bool], int]:
    """How often each kind of word and each tag, by the block and by whether an article holds it, occurs as content and as something else.

    Content is what an ``article`` or ``main`` element holds, without boilerplate; pages without one count nothing.
    """
    runs = parse(page)
    out: Counter[tuple[str, bool]] = Counter()
    if any(r.inside for r in runs):
        for r in runs:
            good = r.inside and not r.dropped
            if not r.dropped:
                out[f"w:{r.place}:{int(r.inside)}", good] += r.words
            for t in r.tags:
                out[f"t:{t}:{int(r.inside)}", good] += 1
    return {k: n for k, n in out.items() if n}


def weights_of(counts: dict[str, list[float]]) -> dict[str, float]:
    """Log-odds of content from [others, content] counts, held to the method's signs: words score above zero, tags below."""
    weights = {}
    for key, (bad, good) in counts.items():
        odds = math.log((good + 1) / (bad + 1))
        weights[key] = min(max(odds, LEAST_WORD), 2.0) if key[0] == "w" else min(max(odds, -8.0) / 2, -0.1)
    return weights


#: Least weight of a word.
LEAST_WORD = 0.02


def learn(pages: list[str]) -> dict[str, float]:
    """The weights that labelled pages give."""
    counts: dict[str, list[float]] = {}
    for page in pages:
        for (key, good), n in tokens(page).items():
            counts.setdefault(key, [0.0, 0.0])[good] += n
    return weights_of(counts)


def best_run(scores: list[list[float]]) -> tuple[int, int]:
    """[first, last) of the contiguous items with the greatest total, by one linear scan; an item may start only as a whole.

    ``scores`` holds for each item its parts in order; where the total falls to 0 or less a new run
    begins with the next part. Ties keep the first run; without a positive total it is empty.
    """
    best = total = 0.0
    start, span = 0, (0, 0)
    for i, parts in enumerate(scores):
        for x in parts:
            if total <= 0:
                total, start = 0.0, i
            total += x
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The best run of words and tags, with boilerplate elements inside it left out.

    Elements that are boilerplate by name, role or class (menus, headers, footers, sidebars,
    notices, adverts, forms, comments) are never part of the text and cost their own tags only,
    whatever they hold, so content on both sides of an advert stays one run. Words score by the
    block they stand in, and words and tags by whether the page marks that part as content (see ``learn``); where a page marks
    nothing they score 1. White space inside a block becomes one space, blocks are joined by one
    space. Empty without any content.
    """
    if not page:
        return ""
    runs = parse(page)
    marked = any(r.inside and r.words and not r.dropped for r in runs)
    plain = {"p", "br", "b", "i", "em", "strong", "span", "h1", "h2", "h3", "h4", "blockquote"}

    def word(r: Run) -> float:
        return weights.get(f"w:{r.place}:{int(r.inside)}", 2.0 if r.inside else LEAST_WORD) if marked else 1.0

    scores = [[*(weights.get(f"t:{t}:{int(r.inside)}", -0.1 if r.inside or t.lstrip("/") in plain else -1.0) for t in r.outer), 0.0 if r.dropped else r.words * word(r)] for r in runs]
    first, last = best_run(scores)
    parts = []
    for r in runs[first:last]:
        if not r.dropped:
            parts.append((" " if r.block else "") + r.text)
        elif r.block:
            parts.append(" ")
    return SPACES.sub(" ", "".join(parts)).strip()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (id, url, text, n_chars).

    The weights come from a bounded sample, ``MAX_LABELLED`` of the pages that mark their content with
    ``article`` or ``main``: hashes are compared first, then the chosen pages are read and counted on the executors,
    and the driver sees the counts. Without such pages fixed defaults hold. Null html gives the empty
    text; very long pages are read whole, in linear time; null and repeated ids give a row each; an
    empty table an empty result; other columns are not read. The pages are mapped without a shuffle.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    marked = own.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).withColumn("h", F.xxhash64("id", "url"))
    chosen = marked.select("h").orderBy("h").limit(MAX_LABELLED).agg(F.max("h").alias("most"), F.count("*").alias("n")).first()
    weights: dict[str, float] = {}
    if chosen["n"]:

        def count(batch: dict[str, list]) -> dict[str, list]:
            total: Counter[tuple[str, bool]] = Counter()
            for page in batch["html"]:
                total.update(tokens(page))
            return {"key": [k for k, _ in total], "good": [g for _, g in total], "n": list(total.values())}

        counted = map_batches(marked.where(F.col("h") <= F.lit(chosen["most"])).select("html"), count, "key string, good boolean, n long")
        counts: dict[str, list[float]] = {}
        for r in counted.groupBy("key", "good").agg(F.sum("n").alias("n")).collect():  # tag names and kinds of words
            counts.setdefault(r.key, [0.0, 0.0])[r.good] += r.n
        weights = weights_of(counts)

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts = [extract(h, weights) for h in batch["html"]]
        return {"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    out = map_batches(own, run, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
