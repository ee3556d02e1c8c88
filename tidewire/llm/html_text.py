"""HTML main text by minimum cut.

A page's html is cut into text blocks, each with its DOM path. A logistic classifier gives each block its log odds of
being content, from its text (length, link density, punctuation, place, tag) and from signs of its containers
(elements and words of class, role and id that speak for content or against it, and being outside of the article that the
page has, or of the containers named as one if it has none). The log odds become capacities to the source or the sink; neighbouring blocks, and blocks under one parent, are
tied by smoothness edges that grow with the share of the path they have in common. Max-flow (Dinic) separates content
from boilerplate at least cost, and nothing but the cut decides.

The classifier is trained on at most ``TRAIN_PAGES`` pages of at most ``TRAIN_PAGE_BYTES`` each that have an article or main
element (those of least hash): blocks in it, but not in a menu, header, footer, aside, form or the like, are content,
all others aren't. First the weights of the text are learned, without any sign and half of them without tags, so that
they can tell alone; then those of the signs, beside what the text says. Both are drawn towards ``PRIOR``, so signs that the training pages don't have
keep its values.

Cases: a null or empty html, or one without text, gives an empty text; broken markup is read as far as it goes (a tag
left open at the end of the html is text); rows are independent, so repeated ids and rows stay; a page without any
known container is decided by its texts and ties alone; very long pages are read whole (ties are a few for each block); only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import map_batches, table

TRAIN_PAGES, TRAIN_PAGE_BYTES = 300, 1 << 17
#: Weight of a tie of two blocks that share their whole path, in log odds.
SMOOTH = 0.6
#: Elements and words of class, id and role by what they say of the text inside.
CONTENT = frozenset(["article", "main"])
CHROME = frozenset(["nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "dialog", "menu", "fieldset"])
HIDDEN = frozenset(["script", "style", "noscript", "template", "iframe", "svg", "object", "head", "title", "textarea", "canvas", "math", "audio", "video"])
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"])
CHROME_WORDS = frozenset(["ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"])
COMMENT_WORDS = frozenset(["comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"])
CONTENT_WORDS = frozenset(["article", "content", "entry", "main", "post", "story"])
#: What names of containers say beside what they hold.
LAYOUT_WORDS = frozenset(["area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "col", "column", "container", "footer", "grid", "group", "header", "holder", "icon", "icons", "inline", "inner", "item", "items", "js", "left", "link", "links", "list", "module", "outer", "panel", "placeholder", "position", "post", "posts", "right", "row", "section", "slot", "small", "sticky", "tools", "top", "unit", "wide", "wrap", "wrapper"])
#: Elements of running text: inside of an article their names are no evidence.
PROSE = frozenset(["blockquote", "code", "dd", "dt", "em", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "i", "li", "b", "p", "pre", "strong", "td", "th"])
#: Elements whose id is a name of a part of the page; those of headings and the like are made from their text.
NAMED = frozenset(["article", "aside", "div", "dl", "footer", "form", "header", "main", "nav", "ol", "section", "table", "ul"])
TEXT = ["log_chars", "log_words", "link_share", "stops", "commas", "capital", "paragraph", "heading", "item", "loose", "depth", "place", "short", "constant"]
SIGNS = ["content", "chrome", "content_word", "chrome_word", "outside"]
#: Weights before any page has been seen.
PRIOR = {"link_share": -3.0, "log_words": 0.5, "stops": 0.8, "paragraph": 0.8, "heading": 0.8, "short": -0.8, "constant": -1.0, "content": 5.0, "chrome": -6.0, "content_word": 1.5, "chrome_word": -4.0, "outside": -3.0}

_ATTRIBUTES = r"""(?:[\s/]*+[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?=[\s/>]){_ATTRIBUTES})[\s/]*+>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
_NONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SOME = re.compile(r"class|id\b|role|hidden|style", re.I)
_WORD = re.compile(r"[^a-z]+")


class Block:
    """``element`` and ``word``: what the innermost telling element, and class, role or id, say: above 0 content, below 0 not."""

    __slots__ = ("chars", "element", "links", "path", "tag", "text", "word")

    def __init__(self, text: str, links: int, path: tuple, tag: str, element: int, word: int):
        self.text, self.chars, self.links, self.path, self.tag, self.element, self.word = text, len(text), links, path, tag, element, word


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _chrome(token: str, inside: bool) -> bool:
    """Whether a name like main-navigation speaks against content: by its first or last word, or by any if none speaks for it.

    Inside of an article it must say nothing else: share-buttons does, share-price and related-work don't.
    """
    words = [w for w in _WORD.split(token) if w]
    against = [w in CHROME_WORDS and not (inside and w in ("header", "banner")) for w in words]
    if inside:
        return any(against) and all(a or w in LAYOUT_WORDS for a, w in zip(against, words, strict=True))
    return any(against) and (against[0] or against[-1] or CONTENT_WORDS.isdisjoint(words))


def _says(tag: str, source: str, element: int, word: int) -> tuple[int, int] | None:
    """What an element and its names say, from what those around it say; None if it isn't shown."""
    if tag in HIDDEN:
        return None
    given = _attributes(source) if source and _SOME.search(source) else {}
    if given and ("hidden" in given or given.get("aria-hidden", "").lower() == "true" or _NONE.search(given.get("style", ""))):
        return None
    if tag in CHROME and not (tag == "header" and element > 0):
        element = -1
    elif tag in CONTENT and element >= 0:
        # a part of the page's frame may hold its article; its comments don't
        element, word = 1, word if word == -2 else 0
    if given and tag not in ("html", "body"):
        inside = element > 0 or word > 0
        names = f"{given.get('class', '')} {given.get('role', '')}".lower().split()
        named = given.get("id", "").lower() if tag in NAMED else ""
        own = {w for w in _WORD.split(named) if w}
        words = {w for n in names for w in _WORD.split(n)}
        if words & COMMENT_WORDS or own & COMMENT_WORDS and (not inside or own <= COMMENT_WORDS):
            word = -2
        elif inside and tag in PROSE:
            pass
        elif word != -2 and (any(_chrome(n, inside) for n in names) or named and not inside and _chrome(named, False)):
            word = -1
        elif word >= 0 and (words | own) & CONTENT_WORDS:
            word = 1
        if word == -1 and inside and tag not in BLOCKS and tag != "a":
            # an advert within a line of an article has no block of its own
            return None
    return element, word


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; hidden text is left out."""
    out: list[Block] = []
    # tag, number of the element, what it and its parents say, None if they aren't shown
    stack: list[tuple[str, int, tuple[int, int] | None]] = []
    parts: list[str] = []
    links, number, in_link, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        says = stack[-1][2] if stack else (0, 0)
        if text and says is not None:
            tag = next((t for t, _, _ in reversed(stack) if t in BLOCKS), "")
            out.append(Block(text, min(links, len(text)), tuple(n for t, n, _ in stack if t in BLOCKS), tag, *says))
        links = 0

    def close(upto: int) -> None:
        nonlocal in_link
        for tag, _, _ in stack[upto:]:
            in_link -= tag == "a"
        del stack[upto:]

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            # what isn't shown is dropped as it is read, within a paragraph too
            if not stack or stack[-1][2] is not None:
                parts.append(text)
                if in_link:
                    links += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            here = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCKS:
                flush()
            if here is not None:
                close(here)
            continue
        if tag == "br" or tag in ("img", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            # an open paragraph, and an item or cell beside the new one, end here
            ends = {"p", tag} if tag in ("li", "td", "th", "tr", "option", "dd", "dt") else {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in VOID:
            continue
        number += 1
        outer = stack[-1][2] if stack else (0, 0)
        stack.append((tag, number, None if outer is None else _says(tag, m[3], *outer)))
        in_link += tag == "a"
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def features(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``TEXT`` and rows of ``SIGNS``."""
    n = max(len(found) - 1, 1)
    has, paged = any(b.element > 0 for b in found), any(b.tag == "p" for b in found)
    # a page without an article may have a container that is named as one
    named = not has and any(b.word > 0 and b.element >= 0 for b in found)
    text, signs = [], []
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        text.append((math.log1p(b.chars), math.log1p(words), b.links / b.chars, b.text[-1] in ".!?:;\"'”»", b.text.count(",") / words, b.text[:1].isupper(), b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "td", "th", "dd", "dt"), paged and b.tag != "p" and b.tag[:1] != "h", min(len(b.path), 12) / 12, i / n, words < 6, 1))
        within = b.word > 0 and b.element >= 0
        signs.append((b.element > 0 and b.word >= 0 or named and within, b.element < 0, within, b.word < 0, has and b.element <= 0 or named and not within))
    return np.array(text, float).reshape(-1, len(TEXT)), np.array(signs, float).reshape(-1, len(SIGNS))


def _prior(names: list[str]) -> np.ndarray:
    return np.array([PRIOR.get(k, 0.0) for k in names])


def _logistic(x: np.ndarray, y: np.ndarray, offset: np.ndarray, prior: np.ndarray, ridge: float = 5.0) -> np.ndarray:
    """Weights by Newton's steps, drawn towards the prior; both kinds of rows weigh alike in all."""
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * (w - prior)
        h = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


#: What a block's text may say at most, so that signs have the last word where there are any.
TEXT_ODDS = 3.0


class Model:
    def __init__(self, text: np.ndarray, signs: np.ndarray):
        self.text, self.signs = text, signs

    def odds(self, found: list[Block]) -> np.ndarray:
        text, signs = features(found)
        return np.clip(text @ self.text, -TEXT_ODDS, TEXT_ODDS) + signs @ self.signs


def train(pages: list[str]) -> Model:
    """The model from pages that have an article or main element; the prior, if one kind of block is lacking."""
    texts, signs, ys = [], [], []
    for page in pages:
        found = blocks(page)
        if any(b.element > 0 for b in found):
            for rows, x in zip((texts, signs), features(found), strict=True):
                rows.append(x)
            ys += [b.element > 0 and b.word >= 0 for b in found]
    if len(set(ys)) < 2:
        return Model(_prior(TEXT), _prior(SIGNS))
    y, text = np.array(ys, float), np.concatenate(texts)
    # each block once more without its own tag, so that pages of divisions alone can be told too
    bare = text * [k not in ("paragraph", "heading", "item", "loose") for k in TEXT]
    w = _logistic(np.concatenate([text, bare]), np.append(y, y), np.zeros(2 * len(y)), _prior(TEXT))
    return Model(w, _logistic(np.concatenate(signs), y, np.clip(text @ w, -TEXT_ODDS, TEXT_ODDS), _prior(SIGNS)))


def _max_flow(n: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut. An arc: from, to, capacity there, capacity back."""
    ends: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, there, back in arcs:
        ends[a].append(len(to))
        to.append(b)
        room.append(there)
        ends[b].append(len(to))
        to.append(a)
        room.append(back)
    while True:
        level = [-1] * n
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            for e in ends[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        turn = [0] * n
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            moved = False
            while turn[a] < len(ends[a]):
                e = ends[a][turn[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    moved = True
                    break
                turn[a] += 1
            if not moved:
                if a == source:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]


def ties(found: list[Block], smooth: float) -> list[tuple[int, int, float]]:
    """Smoothness edges: of neighbours by their common path, and of the nearest blocks under one parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1].path
            common = next((k for k, (p, q) in enumerate(zip(a, b.path, strict=False)) if p != q), min(len(a), len(b.path)))
            out.append((i - 1, i, smooth * (0.2 + 0.8 * common / max(len(a), len(b.path), 1))))
        above = b.path[:-1]
        if above in last and last[above] < i - 1:
            out.append((last[above], i, smooth / 2))
        last[above] = i
    return out


def labelled(found: list[Block], odds: np.ndarray, smooth: float = SMOOTH) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    n = len(found)
    arcs = [(n, i, x, 0.0) if x > 0 else (i, n + 1, -x, 0.0) for i, x in enumerate(odds.tolist())]
    return _max_flow(n + 2, arcs + [(i, j, w, w) for i, j, w in ties(found, smooth)], n, n + 1)[:n]


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page) if page else []
    return "\n".join(b.text for b, content in zip(found, labelled(found, model.odds(found)), strict=True) if content) if found else ""


def fit(pages: DataFrame, rows: int = TRAIN_PAGES, page_bytes: int = TRAIN_PAGE_BYTES) -> Model:
    fair = pages.where(F.octet_length("html") <= page_bytes).where(F.rlike("html", F.lit("(?i)<(?:article|main)[\\s>]")))
    draw = F.pmod(F.xxhash64(F.lit(8), "page_id", "url"), F.lit(1 << 30))
    # pages under a rate that leaves about twice what is needed, so that tasks don't send their own best to one place
    rate = int((1 << 30) * min(1.0, 2 * rows / max(fair.count(), 1)))
    return train([r.html for r in fair.where(draw <= rate).orderBy(draw, "page_id", "url", F.md5("html")).limit(rows).select("html").collect()])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def make():
        def work(rows):
            texts = [main_text(h, model) for h in rows.column(2).to_pylist()]
            return {"page_id": rows.column(0), "url": rows.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_batches(pages, ["page_id", "url", "html"], "page_id bigint, url string, text string, n_chars bigint", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))
