"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks of text at block-level tags. Each block is described by its number of
words and link density and those of its neighbours, by its share of stock phrases (cookies,
copyright, sign up and the like), by its place (in a container that names an article, beside
one, or on a page without one), by whether a container around it names furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments), by the share of the page's plain words that
this container holds, and by whether it is a heading. A name only counts where a whole class, id
or role says so (``site-footer``, but not ``no-comments`` or ``overflow-hidden``), and a container
that holds most of the page's text is hardly furniture, whatever its name. A decision tree, grown
from the blocks of the marked pages below, says which blocks belong to the article.

Defined results: null and empty html give an empty text; unclosed, stray and truncated tags are
tolerated; references that name no character stay as they are; repeated rows are read one by one;
pages of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellscope.llm.shared import ship

# Element names and the words of class, id and role that tell what a container is.
SILENT = frozenset("script style noscript template svg math iframe object select textarea button title head canvas audio video".split())
#: Their contents are not markup and end at their own end tag only.
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog header".split())
MAIN_TAGS = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu menus sidebar footer header masthead banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
    "alert ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond disqus share sharing "
    "social related recommended newsletter subscribe signup login search pagination pager popup modal overlay widget copyright legal disclaimer toolbar "
    "skip contentinfo complementary dialog form teaser".split()
)
#: Words that may stand beside those in one name without changing what it says.
NEUTRAL_WORDS = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer box list block area section bar wrap wrapper container content group module slot unit panel "
    "column col row item items link links post posts article articles story stories entry news thread user users reader readers new old latest more sticky fixed mobile desktop media "
    "blog web body head title text image icon icons button buttons field input small large big mini default dark light placeholder policy info us by a the and of to id js el".split()
)
MAIN_WORDS = frozenset("article main content post entry story articlebody maincontent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: These close an open paragraph.
CLOSES_P = frozenset("p div ul ol li dl table section article main nav aside header footer form h1 h2 h3 h4 h5 h6 pre blockquote figure hr address".split())

# Phrases of notices and footers, in lower case.
STOCK = (
    "cookie", "cookies", "accept", "consent", "privacy", "copyright", "©", "(c)", "all rights reserved", "subscribe", "newsletter", "sign up", "sign in", "log in", "terms of", "advertisement", "sponsored", "share this",
    "follow us", "read more", "leave a comment", "reply", "contact us", "datenschutz", "alle rechte vorbehalten", "impressum", "anmelden", "tous droits réservés", "mentions légales", "s'abonner", "todos los derechos reservados", "suscríbete",
)
_STOCK = re.compile("|".join(rf"(?<!\w){re.escape(p)}(?!\w)" for p in sorted(STOCK, key=len, reverse=True)))

#: From this many words on a block is no notice, whatever phrases it holds.
LONG_BLOCK = 80
#: ``place``: 2 in a container that names an article, 1 on a page without one, 0 beside one.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "stock", "place", "furniture", "bulk", "heading")
#: Marked pages: a number stands for so many words, @ before it for words in a link, $ for a stock
#: phrase before them; + marks an element whose blocks are the article (unless a - marks them off).
PAGES = (
    # an article element between the usual furniture
    "<nav><ul><li>@1<li>@2<li>@1<li>@1</ul></nav><div class=ad>9</div><article +><h1>9</h1><p>60</p><p>3</p><p>25</p><p>110</p></article><footer>$8</footer>",
    "<header><a href=/>2</a><p>6</p></header><article +><header><h1>7</h1><p>4</p></header><p>35</p><h2>3</h2><p>20</p><ul><li>6<li>4<li>9</ul><p>48</p><div - class=related-posts><p>2</p><ul><li>@5<li>@6<li>@4</ul></div></article><aside><h3>2</h3><p>30</p></aside><footer>$12</footer>",
    "<div class=cookie-notice><p>$25</p></div><nav>@1 @1 @1</nav><main><article +><h1>6</h1><p>15</p><p>1</p><p>2</p><blockquote>40</blockquote><p>80</p></article><section - class=comments><h2>2</h2><p>45</p><p>12</p><p>70</p><p>3</p></section></main><form>5</form><footer>$6 @2</footer>",
    "<nav>@2 @2</nav><article + class=overflow-hidden><h1>5</h1><p>4</p><p>@7</p><p>30 @3</p><figure>12</figure><p>90</p><div - class=newsletter><p>$14</p></div></article><div class=sidebar><h3>2</h3><p>22</p><p>@4</p></div><footer>$20</footer>",
    "<article +><h1>12</h1><p>3</p></article><section - class=comments><p>60</p><p>80</p><p>25</p></section><footer>$5</footer>",
    "<nav>@1 @1</nav><article +><p>2</p><p>1</p><p>6</p><p>14</p></article><aside>50</aside><div class=advert>35</div><p>9</p><p>$7</p>",
    "<article +><p>18</p><aside - class=promo>15</aside><p>200</p><div - class=share>@1 @1 @1</div><div - role=alert>11</div><p>5</p><ul - ><li>@3<li>@4<li>@2<li>@5</ul></article>",
    "<div>9</div><article +><h1>4</h1><p>50</p><h2>3</h2><p>8</p><p>16</p></article><div>$10</div><div>40</div><div>@1 @2</div>",
    "<nav>@1 @2</nav><article +><h1>6</h1><p>40</p><p>$2</p><p>$6</p><p>22</p><p>$1</p></article><footer>$4</footer>", "<main +><p>30</p><p>$3</p><p>$9</p><p>15</p><p>@1</p><p>$18</p></main><div>$9</div>",
    "<nav>@1</nav><article +><h1>5</h1><p>20</p><p>$4</p><p>1</p><p>60</p><p>$12</p><p>2</p><p>$30</p><p>3</p><p>$2</p><p>1</p></article><footer>$3</footer>",
    "<article +><p>9</p><p>3</p><p>3</p><p>14</p><p>2</p><p>2</p></article><div>1</div>", "<article +><p>$20</p></article><div>$5</div>", "<article +><h1>3</h1></article>", "<article +><p>$40</p><p>$15</p><p>2</p></article><footer>9</footer>",
    "<main +><p>2</p><p>7</p><p>90</p><p>1</p><p>5</p><p>3</p><p>16</p><p>3</p><p>70</p><p>$5</p></main><footer>$5</footer>", "<article +><p>45</p><p>$70</p><p>1</p><p>$9</p><p>8</p></article><p>6</p>",
    # containers that name the article in their class or id
    "<div class=menu>@1 @2 @1</div><div id=main class=no-comments +><h1>8</h1><p>42</p><p>6</p><p>70</p></div><div class=site-footer>$9</div>",
    "<div class='post has-sidebar' +><h1>6</h1><p>33</p><p>12</p><p>64</p></div><div class=sidebar-left><p>28</p><p>@3</p></div><div id=footer>7</div>",
    "<div class='content with-sidebar'+><h2>5</h2><p>75</p><p>2</p><p>31</p><div - class=comment-list><p>18</p><p>36</p><p>9</p></div></div><div class=cookie-banner>$16</div>",
    # pages that name nothing
    "<div>@1 @1 @1 @2</div><div class=overflow-hidden +><h1>7</h1><p>38</p><p>55</p><p>4</p><p>21</p></div><div>$8</div>",
    "<div>@2</div><div>@3</div><div +><h1>6</h1><p>28</p><p>85</p><p>17</p></div><div>@2 @2</div><div>$6</div>",
    "<div>$18</div><section class=related-work +><h2>3</h2><p>48</p><p>26</p><p>9</p><p>66</p></section><p>$5</p>",
    "<ul><li>@1<li>@2<li>@1</ul><div class=side-by-side +><p>34</p><p>52</p><h3>4</h3><p>19</p></div><div>@4 2 @3</div><p>$4</p>",
    "<div data-state=not-hidden +><p>44</p><p>23</p><p>5</p><p>37</p></div><div>@2 @2 @2</div>",
    "<table><tr><td>@1<td>@1<td>@2</table><h1 +>9</h1><p +>95</p><p +>13</p><p +>58</p><p>@3 @3</p><p>$11</p>",
    "<div>1</div><div>2</div><div>1</div><h1 +>7</h1><p +>52</p><p +>3</p><p +>47</p><div>2</div><div>3</div><div>2</div>",
    "<table><tr><td>2<td>1<td>2<td>1</table><div +><p>61</p><p>30</p></div><div>3</div><div>1</div><div>2</div>",
    "<div>2</div><div>4</div><div>3</div><div +><h2>5</h2><p>24</p><p>6</p><p>83</p></div><ul><li>2<li>3<li>1</ul>",
    "<div>@1 @2</div><div>$7</div><div +><h1>4</h1><p>44</p><p>31</p><p>4</p><p>57</p></div><div>$5</div>", "<div>$5</div><div +><p>39</p><p>27</p></div><div>$13</div>", "<p>$3</p><div +><h1>6</h1><p>50</p></div>",
    "<p +>3</p>", "<h1 +>5</h1><p +>14</p>", "<p +>40</p><p>$9</p>", "<div +>120</div>", "<p +>1</p>", "<p +>12</p><p +>9</p>", "<h2 +>4</h2><p +>22</p><p>@6</p>",
    # furniture names around most of the page, and around the little that is beside it
    "<div class=menu>@1 @1</div><div class=widget +><h1>6</h1><p>50</p><p>33</p><p>72</p><p>24</p></div><div class=footer>$9</div>",
    "<div id=sidebar +><p>60</p><p>41</p><p>88</p></div><div class=ads>14</div><p>$6</p>",
    "<div class=notice><p>32</p></div><div +><h1>5</h1><p>47</p><p>68</p><p>29</p><p>54</p></div><div class=comments><h3>1</h3><p>27</p><p>40</p><p>8</p></div><div class=legal>25</div>",
    "<div class=banner>11</div><div +><p>26</p><p>62</p><p>7</p><p>45</p></div><div class=sidebar><p>20</p><p>@3</p><p>31</p></div><div class=copyright>6</div>",
)


def marked_page(page: str) -> str:
    """One of PAGES as html."""

    def words(m: re.Match) -> str:
        text = ("Copyright cookies " if "$" in m[1] else "") + " ".join(["word"] * int(m[2]))
        return f"<a href=x>{text}</a>" if "@" in m[1] else text

    out = re.sub(r"(?<=[>\s])([@$]?)(\d+)(?=[\s<]|\Z)(?![^<]*>)", words, page)
    return re.sub(r"(?<=[\s'])([+-])(?=\s*[^<]*>)", lambda m: f" data-kept={'yes' if m[1] == '+' else 'no'}", out)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, below or equal, above), or a class."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= t
            cost = sum(len(p) - (p.sum() ** 2 + (len(p) - p.sum()) ** 2) / len(p) for p in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, t, low = best
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def labelled(pages: tuple[str, ...] = PAGES) -> list[tuple]:
    """The blocks of marked pages, in the order of FEATURES, and whether each is article text."""
    out = []
    for page in pages:
        found = blocks(marked_page(page))
        out += [(*row, b.kept) for row, b in zip(described(found), found, strict=True)]
    return out


def train(pages: tuple[str, ...] = PAGES) -> tuple | int:
    table = np.array(labelled(pages), float)
    return grow(table[:, :-1], table[:, -1].astype(int))


def classify(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=1 << 14)
def _named(name: str) -> tuple[bool, bool]:
    """(furniture, main) of one class, id or role: its words all belong to the kind, or are neutral."""
    words = [w.lower() for w in _PARTS.findall(name)]
    furniture = any(w in FURNITURE_WORDS for w in words) and all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS for w in words)
    return furniture, not furniture and any(w in MAIN_WORDS for w in words) and not any(w in FURNITURE_WORDS for w in words)


@lru_cache(maxsize=1 << 14)
def _container(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool, bool | None]:
    """(furniture, main, unseen, mark) of an element by its name, its class, id and role, and
    attributes that hide it; the mark is that of a marked page."""
    furniture = tag in FURNITURE_TAGS and not (tag == "header" and in_main)
    main, unseen, mark = tag in MAIN_TAGS, False, None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for word in value.split():
                f, known = _named(word)
                f = f and not (in_main and word.lower().endswith("header")) and tag not in ("html", "body", "main")
                furniture, main = furniture or f, main or known and tag not in ("html", "body")
        elif name == "hidden":
            unseen = unseen or value.lower() != "false"
        elif name == "aria-hidden":
            unseen = unseen or value.lower() == "true"
        elif name == "style":
            unseen = unseen or bool(_UNSEEN.search(value))
        elif name == "data-kept":
            mark = value == "yes"
    return furniture, main and not (furniture and tag not in MAIN_TAGS), unseen, mark


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags and texts; after the start tag of a raw element the next token is its own end tag."""
    at = 0
    while at < len(page):
        for token in _TOKEN.finditer(page, at):
            yield token
            at = token.end()
            tag = token[2] and not token[1] and not token[3].endswith("/") and token[2].lower()
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
                break


def _visible(page: str) -> Iterator[re.Match]:
    """Tokens outside silent elements. Each end tag closes the last open start tag of its name; an
    element that is never closed silences nothing, but raw ones, which run to the page's end."""
    tokens = list(_tokens(page))
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, token in enumerate(tokens):
        tag = token[2] and token[2].lower()
        if tag in SILENT and tag != "head":
            if token[1]:
                if opened.get(tag):
                    ends[opened[tag].pop()] = i
            elif not token[3].endswith("/"):
                opened.setdefault(tag, []).append(i)
    i = 0
    while i < len(tokens):
        tag = tokens[i][2] and tokens[i][2].lower()
        if tag not in SILENT or tag == "head":
            yield tokens[i]
        i = ends.get(i, i) + 1


class Block(NamedTuple):
    """A run of text, where it stands, and the number of its outermost container of furniture (or -1)."""

    text: str
    words: int
    linked: int
    main: bool
    furniture: int
    unseen: bool
    heading: bool
    kept: bool


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = box = 0
    stack: list[tuple[str, bool, bool, bool, bool | None]] = []
    main = furniture = unseen = links = headings = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = "".join(parts).split()
            if words:
                kept = next((m for *_, m in reversed(stack) if m is not None), False)
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), main > 0, box if furniture else -1, unseen > 0, headings > 0, kept))
            parts, linked = [], 0

    def pop(to: int) -> None:
        nonlocal main, furniture, unseen, links, headings
        while len(stack) > to:
            tag, f, m, u, _ = stack.pop()
            furniture -= f
            main -= m
            unseen -= u
            links -= tag == "a"
            headings -= tag in HEADINGS

    for token in _visible(page):
        tag = token[2]
        if tag is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if links:
                    linked += len(text.split())
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        elif tag == "br":
            parts.append(" ")
        if token[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in VOID or token[3].endswith("/") and tag not in ("a", "p"):
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    # formatting that was opened in the paragraph goes with it
                    if all(t in INLINE for t, *_ in stack[i + 1 :]):
                        pop(i)
                    break
        if tag == "body":
            for i, (t, *_) in enumerate(stack):
                if t == "head":
                    pop(i)
                    break
        f, m, u, mark = _container(tag, token[3], main > 0)
        u = u or tag == "head"
        stack.append((tag, f, m, u, mark))
        box += f and not furniture
        furniture += f
        main += m
        unseen += u
        links += tag == "a"
        headings += tag in HEADINGS
    close()
    return out


def described(found: list[Block]) -> list[tuple]:
    """FEATURES of each block."""
    seen = [b for b in found if not b.unseen]
    has_main = any(b.main and b.furniture < 0 for b in seen)
    plain = sum(b.words - b.linked for b in seen)
    boxes = Counter()
    for b in seen:
        boxes[b.furniture] += b.words - b.linked
    size = [(b.words, b.linked / b.words) for b in found]
    out = []
    for i, b in enumerate(found):
        before = size[i - 1] if i else (0, 0.0)
        after = size[i + 1] if i + 1 < len(found) else (0, 0.0)
        low = b.text.lower() if b.words < LONG_BLOCK else ""
        stock = len(_STOCK.findall(low)) / b.words if any(p in low for p in STOCK) else 0.0
        place = 2 if b.main else 0 if has_main else 1
        out.append((*size[i], *before, *after, stock, place, int(b.furniture >= 0), boxes[b.furniture] / max(1, plain) if b.furniture >= 0 else 0.0, int(b.heading)))
    return out


def main_text(page: str, tree: tuple | int) -> str:
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, described(found), strict=True) if not b.unseen and classify(tree, row))


def _extract(batches: Iterator[pa.RecordBatch], tree: tuple | int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(p, tree) if p else "" for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    tree = train()
    rows = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html")
    return rows.mapInArrow(lambda it: _extract(it, tree), "page_id long, url string, text string, n_chars long")
