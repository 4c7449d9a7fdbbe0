"""The main text of web pages: flat text blocks, described by their own and their neighbours' words and links, kept or dropped by a tree.

A page is cut into blocks at block-level tags, in one pass whose time is in proportion to the page. A block has its number of words
and its link density (share of words in links), those of the blocks before and after it, and what encloses it: an article region,
or an element whose tag, role, class or id says menu, header, footer, sidebar, notice, advert, form or comments. A decision tree,
trained on the small labelled table below when a worker starts, keeps or drops each block; where nothing encloses blocks, words and
links of a block and its neighbours decide. Scripts, styles and other markup never become blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import column, slices

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:\d{8,}|[xX][0-9a-fA-F]{8,});?")
#: Elements without text of their own; those of the second line resume behind the start tag if they are never closed.
_HIDDEN = frozenset("script style title textarea xmp iframe noembed noframes".split())
_SKIPPED = frozenset("noscript template svg annotation annotation-xml object canvas audio video select".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr input button "
    "math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder mtable mtr mtd mstyle mspace semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}, "option": {"option"}}
_BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
#: Words that say, as the first or last word of a class, id or role, that an element is something else than main text.
_BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promoted promotion banner nav navbar navigation menu menubar submenu breadcrumb breadcrumbs
    pagination pager header masthead topbar footer foot colophon sidebar sidebars side rail aside widget widgets related recommended recommendations trending teaser teasers comment comments commentlist disqus
    discussion respond reply replies reaction reactions cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login signin
    search share sharing social copyright legal disclaimer toolbar skip complementary contentinfo form""".split()
)
#: Of these, the ones that an article may well have as the name of a section; as ids they count outside articles only.
_TOPICS = frozenset("related discussion legal notice notices disclaimer reply replies reaction reactions share sharing social copyright search alert alerts promotion side recommendations header".split())
_WITH = frozenset("has with no without js".split())
_REGION_WORDS = frozenset("article main story entry post".split())
_REGION_PARTS = _REGION_WORDS | {"content", "body", "text", "full", "inner", "blog", "news", "single"}
#: A region that classes or ids name counts only if it has this share of a page's words outside boilerplate.
REGION_SHARE = 0.25
_CONTENT, _BOILER, _FORM = 1, 2, 3


@lru_cache(1 << 14)
def _says(name: str, value: str, is_id: bool, inside: bool) -> int:
    """What one class, id or role says about an element."""
    words = [w for w in _SPLIT.split(_CAMEL.sub("-", value).lower()) if w]
    if not words:
        return 0
    heading = name in _HEADINGS
    for w in {words[0], words[-1]} & _BOILER_WORDS:
        if words[0] in _WITH or w == words[-1] and len(words) > 1 and words[-2] in _WITH:
            continue  # of a page with or without a sidebar
        if is_id and (heading or inside and w in _TOPICS):
            continue  # the name of a place
        if w == "header" and (inside or heading or set(words) & _REGION_WORDS):
            continue  # an article's own header
        return _BOILER
    if set(words) & _REGION_WORDS and set(words) <= _REGION_PARTS or words == ["content"]:
        return _CONTENT
    return 0


def _kind(name: str, attrs: str, inside: bool) -> tuple[int, bool]:
    """What an element is (0 where nothing says so), and whether its tag itself says so; inside an article or not."""
    if name in ("html", "body"):
        return 0, False
    if name == "form":
        return _FORM, True
    if name in _BOILER_TAGS or (name == "header" and not inside):
        return _BOILER, True
    found = 0
    if attrs and ("class" in (low := attrs.lower()) or "id" in low or "role" in low):
        for key, value in _ATTR.findall(attrs):
            value = value.strip("\"'")
            for part in value.split() if key.lower() == "class" else [value]:
                if len(part) <= 200 and (says := _says(name, part, key.lower() == "id", inside)):
                    found = max(found, says)
    if found == _BOILER:
        return found, False
    return (_CONTENT, True) if name in ("article", "main") else (found, False)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    item: bool
    article: bool
    boiler: bool


class _Reader:
    """Reads a page once. Searches that find nothing are not repeated, so that no page takes more than time in proportion."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.none: set[str] = set()
        self.last_gt = page.rfind(">")
        self.out: list[Block] = []
        self.forms: list[int] = []  # of each block, its form, or -1
        self.named: list[bool] = []  # of each block, whether a tag itself makes it an article
        self.stack: list[tuple[str, int, bool, int]] = []
        self.open: Counter[str] = Counter()
        self.counts = [0, 0, 0, 0]
        self.n_named = self.n_forms = 0
        self.form = -1  # the open one; forms within it are none
        self.parts: list[str] = []
        self.linked = 0
        self.links = self.heading = self.item = False

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def add(self, text: str, decode: bool = True) -> None:
        if text:
            if decode and "&" in text:
                if "&#" in text:
                    text = _HUGE.sub("�", _ZEROS.sub(r"&#\1", text))
                text = html.unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len(text.split())

    def close(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            self.parts.clear()
            if words:
                self.out.append(Block(" ".join(words), len(words), min(self.linked, len(words)), self.heading, self.item, self.counts[_CONTENT] > 0, self.counts[_BOILER] > 0))
                self.forms.append(self.form)
                self.named.append(self.n_named > 0)
        self.linked = 0

    def pop(self) -> None:
        name, kind, by_tag, form = self.stack.pop()
        self.open[name] -= 1
        self.counts[kind] -= 1
        self.n_named -= kind == _CONTENT and by_tag
        if form >= 0 and form == self.form:
            self.form = -1

    def push(self, name: str, kind: int, by_tag: bool) -> None:
        form = -1
        if kind == _FORM and self.form < 0:
            form, self.form, self.n_forms = self.n_forms, self.n_forms, self.n_forms + 1
        elif kind == _CONTENT and by_tag:
            self.n_named += 1
            self.form = -1  # a form around an article is around the page
        self.stack.append((name, kind, by_tag, form))
        self.open[name] += 1
        self.counts[kind] += 1

    def tag_end(self, at: int) -> int:
        """Where the > of a tag is, beyond quoted values; the next > where a quote is never closed."""
        i = at
        while found := _STOP.search(self.page, i):
            i = found.start()
            sign = self.page[i]
            if sign == ">":
                return i
            before = i - 1
            while before > at and self.page[before].isspace() and i - before < 64:
                before -= 1
            if self.page[before] != "=":
                i += 1  # a quote that begins no value
                continue
            closing = self.find(sign, i + 1)
            if closing < 0 or closing > self.last_gt:
                break
            i = closing + 1
        return self.page.find(">", at)  # there is one

    def hidden_end(self, name: str, at: int) -> int:
        """What follows the end tag of an element whose content is skipped, or -1."""
        if name in self.none:
            return -1
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
        if not found:
            self.none.add(name)
            return -1
        end = self.page.find(">", found.end())
        return end + 1 if end >= 0 else self.size

    def read(self) -> None:
        page, at = self.page, 0
        while at < self.size:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= self.size:
                break
            sign = page[lt + 1]
            if sign == "!" or sign == "?":
                self.add(page[at:lt])
                if page.startswith("<!--", lt):
                    end = self.find("-->", lt + 2)
                    at = end + 3 if end >= 0 else self.size
                elif page.startswith("<![CDATA[", lt):
                    end = self.find("]]>", lt)
                    self.add(page[lt + 9 : end if end >= 0 else self.size], False)
                    at = end + 3 if end >= 0 else self.size
                else:
                    end = self.find(">", lt)
                    at = end + 1 if end >= 0 else self.size
                continue
            ending = sign == "/"
            named = _NAME.match(page, lt + 1 + ending) if lt < self.last_gt or sign.isalpha() or ending else None
            if not named:
                self.add(page[at : lt + 1])  # a sign, not a tag
                at = lt + 1
                continue
            self.add(page[at:lt])
            if named.end() > self.last_gt:
                at = self.size  # the page ends in this tag
                break
            end = self.tag_end(named.end())
            at = end + 1
            name = named[0].lower()
            if ending:
                self.end_tag(name)
            else:
                at = self.start_tag(name, page[named.end() : end], at)
        self.add(page[at:])
        self.close()

    def end_tag(self, name: str) -> None:
        if name == "a":
            self.links = False
        if name not in _INLINE or name == "button":
            self.close()
        if name in _HEADINGS:
            self.heading = False
        if name == "li":
            self.item = False
        if self.open[name] > 0:
            if name in _INLINE:
                self.close()
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def start_tag(self, name: str, attrs: str, at: int) -> int:
        if name not in _INLINE or name == "button":
            self.close()
        if name in _HIDDEN or name in _SKIPPED:
            if attrs.endswith("/") and name in _SKIPPED:
                return at
            end = self.hidden_end(name, at)
            return end if end >= 0 else self.size if name in _HIDDEN else at
        if name == "a":
            self.links = "href" in attrs.lower()
        if name in _HEADINGS:
            self.heading = True
        if name == "li":
            self.item = True
        if name in _VOID:
            return at
        kind, by_tag = _kind(name, attrs, self.counts[_CONTENT] > 0)
        if kind or name not in _INLINE:
            ends = _ENDS.get(name, {"p"}) if name not in _INLINE else ()
            while self.stack and self.stack[-1][0] in ends:
                self.pop()  # its end tag is left out
            if kind and name in _INLINE:
                self.close()
            self.push(name, kind, by_tag)
        return at


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, character references decoded and white space made single.

    A form that holds half of the words or more, or an article, is around the page and says nothing. A region that only a class or id
    names and that has a small share of the words says nothing either.
    """
    reader = _Reader(page)
    reader.read()
    out = reader.out
    in_form: Counter[int] = Counter()
    for b, form in zip(out, reader.forms):
        in_form[form] += b.words - b.linked
    total = sum(in_form.values())
    for b, form in zip(out, reader.forms):
        b.boiler |= form >= 0 and 2 * in_form[form] < total
    if not any(reader.named[i] and not b.boiler for i, b in enumerate(out)):
        plain = [b for b in out if not b.boiler]
        if sum(b.words for b in plain if b.article) < REGION_SHARE * sum(b.words for b in plain):
            for b in out:
                b.article = False
    return out


def features(page: list[Block]) -> list[tuple[float, ...]]:
    """A row for each block: words and link density of it, of the one before and of the one after, and what it stands in."""
    region = any(b.article and not b.boiler for b in page)
    density = [b.linked / b.words for b in page]
    out = []
    for i, b in enumerate(page):
        before = (page[i - 1].words, density[i - 1]) if i else (0, 1.0)
        after = (page[i + 1].words, density[i + 1]) if i + 1 < len(page) else (0, 1.0)
        out.append((b.words, density[i], *before, *after, b.heading, b.item, b.article, b.boiler, region and not b.article))
    return out


#: The labelled table. A line is a page; + or - keeps or drops a block, given as open tags, words / words in links. Words and links are
#: filled in. First pages whose elements say what they are, then pages of which only words and links tell.
LABELLED = """
-nav>ul>li 1/1 -nav>ul>li 2/2 -div.ad 9 +article>h1 8 +article>p 90 +article>p 1 +article>p 2/1 +article>p 45/4 +article>ul>li 6 +article>p 3/3 +article>p 30 -footer 9
-header 4 -div#cookie-notice>p 30/2 +main>h1 6 +main>p 60/2 -main>aside>p 35 +main>p 5 -main>div.advert 40 +main>p 12 -section#comments>p 50 -section#comments>p 6 -form>p 12 -footer>p 25/5
-div.menu 12/12 +article>header>h1 7 +article>p 20 +article>p 1 -article>form>p 8 -div.share 4/3 -div 14 -div 40 -div.related>ul>li 8/8
+article>h1 5 +article>p 15 -div 3 -div>p 18 -div 55/1
+article>p 3 -footer 4
-nav>ul>li 2/2 +article>h1 4 +article>p 33 +article>p 2
-header 3 +main>p 1 +main>p 26/1 +main>p 5/3 +main>p 14
-nav>ul>li 2/2 +article>p 50
-nav>p 3/3 +article>p 4
-nav>p 3/3 +main>h1 3
-nav>p 1/1 +main>p 14/3 -footer 1
-main>nav>ul>li 2/2 +main>p 44 +main>p 3/3 +main>p 20 -main>aside>p 6/6 -main>div.share 4/4 -main>footer 3/3 -article>div.related>ul>li 5/5
+article>h1 6 +article>p 40 -article>ul>li 3/3 -article>ul>li 4/4 -article>ul>li 2/2 -article>ul>li 3/3 +article>p 25 +article>ul>li 9/3 +article>ul>li 7 +article>p 31
-header 2 +div.post-content>h2 5 +div.post-content>p 70/2 +div.post-content>p 8 -div 6 -div 25/2 -div.page-footer 12/2
+article>p 1 -div.article-comments>p 44 -div.article-comments>p 8
+article>h1 2 +article>p 12 -article>ul>li 5/5 -article>ul>li 4/4 -article>ul>li 6/6
+article>h1 4 +article>p 70 +article>h2 2 +article>p 90 +article>h2 3 +article>p 120 +article>p 3 -footer 6/6
+article>h1 3 +article>p 80 +article>p 2 -div.related>p 7/7 -div.related>p 6/6
+article>p 5 +article>p 65 +article>p 4 -nav>p 4/4
-nav>ul>li 1/1 -div.ad 12 +article>h1 1 +article>p 1 -footer 14
-nav>ul>li 1/1 -nav>ul>li 1/1 -div.ad 5 +article>h1 12 +article>p 14 +article>p 160 -footer 9
+article>h1 12 +article>p 150 +article>p 8/8 +article>p 140 +article>p 6/6 +article>p 2 +article>p 4 -footer 10
+main>h1 5 +main>p 75 +main>ul>li 2 +main>ul>li 3 +main>ul>li 1 +main>p 66 +main>p 1 -div 3/3 -div 40
+article>p 100 +article>p 5/5 +article>p 3 +article>p 80/20 +article>p 12/11 -footer 4
+article>h1 2 +article>h2 3 +article>h3 1 +article>p 4 +article>p 3 +article>p 2 +article>p 5 +article>p 1 -div 5/5
+article>ul>li 1 +article>ul>li 2 +article>ul>li 4 +article>p 3 +article>p 4/1 +article>p 5/2 +article>ul>li 6/3 -div>p 30
-div 4/4 +p 50
-div 3/3 -div 2/2 +p 35/2
-div 3/3 -div 2/2 +p 28 -div 3/3 -div 3
+article>p 40 +article>p 6
+main>p 9 +main>p 12
-div 5/5 -div 6/6 +h1 7 +p 80/1 +p 30 +p 4 +p 60/3 +h2 3 +p 50 -div 3/3 -div 2/2 -div 4
-td 2/2 -td 3/3 -td 2/2 +td>p 40 +td>p 8 +td>p 70/2 -td 3/2 -td 5/4
-ul>li 3/3 -ul>li 4/4 +p 18 +p 3 +p 25/1 +ul>li 12 +ul>li 15 +p 33 -p 10/9 -p 2/2
-div.banner 20 +p 55 +p 47/2 -div.comments>p 60 -div.sidebar>p 30/3 -div.footer 15/4
+p 22
+p 3
-div 4/4 -div 4/4
-div 1/1 -div 1/1 -div 2/2 -div 3 +h1 9 -div 4/1 +p 66 +p 5 +p 41 +h2 2 +p 38/2 +p 90 -div 2/2 -div 1/1 -div 6
-p 2/2 -p 2/2 +h2 4 +p 21 +p 17/1 +p 2 +p 24 -p 5/5 -p 4/4 -p 7/6
-div 2/2 -div 5/5 -div 4 -div 6/5 +div 45 +div 9 +div 52/3 +div 11 +div 36 -div 8/7 -div 3/3 -div 9
-span 3 -div 7/7 +h1 6 +p 34 +p 29 +p 13/5 +p 48 -h3 2 -ul>li 6/6 -ul>li 8/8 -ul>li 7/7 -p 5/1
-td 1/1 -td 1/1 -td 4 +td 120/3 +td 60 -td 2/2 -td 6/2
-div 3/3 -div 4/4 -div 12/10 +p 19 +p 16 +p 22 +p 6 +p 30 -div 14/12 -div 3/3
+h1 5 +p 40/1 +p 6 +p 37 -h4 2 -p 9/8 -p 7/7 -p 11/10 -p 4
-div 2/2 -div 2/2 +p 15 +p 11 +p 23 +p 4 +p 18 -div 2/2 -div 5
-ul>li 1/1 -ul>li 1/1 -ul>li 1/1 +h1 8 +p 55/4 +ul>li 4 +ul>li 9 +ul>li 6/1 +p 61 -ul>li 2/2 -ul>li 3/3 -p 8
-div 5 -div 3/3 -div 4/4 +h2 7 +p 64/2 -div 3/3 +p 72 +p 14 -div 6/6 -div 4/4 -div 10/2
-div.menu>p 3 +h1 4 +p 64
-div 3/3 -div 5 +h1 4 +p 64 +p 20 -div 3/3
-td 3 -td 4/4 +h2 5 +p 100 +h2 3 +p 130 +h3 2 +p 77 -div 5
-div 4 +h1 2 +p 300 +h2 1 +p 240 +h2 5 +p 88 -p 2/2
-p 4/4 +h1 3 +p 27 +p 1 +p 33 +h2 4 +p 7 +p 44 +h2 2 +p 19/1 +p 25 -p 3/3 -p 4
"""


def labelled_pages(table: str = LABELLED) -> list[list[tuple[str, int, int, bool]]]:
    """Open tags, words, words in links, and whether the block is kept, of each block of each page."""
    out = []
    for line in table.strip().splitlines():
        row = re.findall(r"([+-])(\S+) (\d+)(?:/(\d+))?", line)
        out.append([(path, int(words), int(linked or 0), sign == "+") for sign, path, words, linked in row])
    return out


def labelled_page(rows: list[tuple[str, int, int, bool]]) -> str:
    out = []
    for path, words, in_links, _ in rows:
        tags = [re.split(r"([.#])", t) for t in path.split(">")]
        opened = "".join(f"<{t[0]}" + (f' {"class" if t[1] == "." else "id"}="{t[2]}"' if len(t) > 1 else "") + ">" for t in tags)
        link = f"<a href='/x'>{' '.join(['w'] * in_links)}</a> " if in_links else ""
        out.append(opened + link + " ".join(["w"] * (words - in_links)) + "".join(f"</{t[0]}>" for t in reversed(tags)))
    return "".join(out)


@dataclass
class Node:
    """A split (feature below cut goes left) or, without children, a verdict."""

    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None
    kept: bool = False


def grow(rows: list[tuple[float, ...]], kept: list[bool], depth: int = 9) -> Node:
    """A tree by Gini impurity; of equally good splits, the first feature and lowest cut."""
    share = sum(kept) / len(kept)
    leaf = Node(kept=share >= 0.5)
    if depth == 0 or share in (0.0, 1.0):
        return leaf
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda i: rows[i][f])
        left = left_kept = 0
        for a, b in zip(order, order[1:]):
            left += 1
            left_kept += kept[a]
            if rows[a][f] == rows[b][f]:
                continue
            right, right_kept = len(rows) - left, sum(kept) - left_kept
            score = left_kept * (left - left_kept) / left + right_kept * (right - right_kept) / right
            if best is None or score < best[0] - 1e-9:
                best = (score, f, (rows[a][f] + rows[b][f]) / 2)
    if best is None:
        return leaf
    _, f, cut = best
    sides = [[i for i in range(len(rows)) if (rows[i][f] < cut) == low] for low in (True, False)]
    return Node(f, cut, *(grow([rows[i] for i in s], [kept[i] for i in s], depth - 1) for s in sides))


@lru_cache(1)
def tree() -> Node:
    rows, kept = [], []
    for page in labelled_pages():
        rows += features(blocks(labelled_page(page)))
        kept += [k for *_, k in page]
    return grow(rows, kept)


def verdict(node: Node, row: tuple[float, ...]) -> bool:
    while node.left:
        node = node.left if row[node.feature] < node.cut else node.right
    return node.kept


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by single spaces; empty if there are none."""
    found = blocks(page or "")
    root = tree()
    return " ".join(b.text for b, row in zip(found, features(found)) if verdict(root, row))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages, from the whole html.

    A null or empty html has an empty text; repeated rows and null ids stay; an empty table gives none; extra columns are not read.
    Markup may be broken in any way; a page that ends within a tag loses that tag.
    """
    rows = pages.select(column(pages, "page_id", "long"), column(pages, "url", "string"), column(pages, "html", "string"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
