"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Fixed values of HTML: elements without content, elements whose content isn't markup, elements that start a block,
#: and those that end an open element of the second set.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: What is never article, by its element or role. By a word of its class or id: what isn't unless it holds the article
#: element, and what isn't unless it holds that or most of the page's own text. A form is of the last kind too.
_OUT_TAGS = frozenset("head nav footer aside button label select dialog menu search".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORD = r"(?:^|\s)(?!(?:has|no|with|without|hide|is)[^a-z\s])(?:\S*[^a-z\s])?(?:%s)(?:[^a-z]|$)"
_NOT = re.compile(
    _WORD
    % (
        r"ads?|advert\w*|adsense|adbox|sponsor\w*|banners?|menus?|menubar|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|popups?|modal|overlay|"
        r"newsletter|subscribe|signup|login|comments?|commentlist|respond|disqus|replies|pagination|pager|skip"
    )
)
_HARDLY = re.compile(_WORD % r"promo\w*|sidebars?|side|rail|foot|notices?|alerts?|reader|share|sharing|social|related|recommend\w*|widgets?|search")
_REPLY = re.compile(_WORD % "comments?|replies|respond|disqus")
_HEADS = re.compile(_WORD % "header|head")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[^\s/>]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


def _tag_end(html: str, at: int) -> int:
    """The place of the > that ends the tag at `at`, outside quotes; the first one if a quote never closes; -1: none."""
    first = end = html.find(">", at)
    while end >= 0:
        quote, i = "", at
        while i < end:  # from quote to quote
            if quote:
                i = html.find(quote, i)
                if i < 0:
                    return first
                if i > end:
                    break
                quote, i = "", i + 1
            else:
                a, b = html.find('"', i, end), html.find("'", i, end)
                i = min(x for x in (a, b, end) if x >= 0)
                if i < end:
                    if html[i - 1] in "= \t\n\r\f":
                        quote = html[i]
                    i += 1
        if not quote:
            return end
        at, end = i, html.find(">", i)
        # i is the closing quote's place: go on after it
        at += 1
    return first


#: How much an element looks like what isn't article: not at all, unless it holds most of the text or the article,
#: unless it holds the article, for certain.
_FINE, _UNLIKELY, _DOUBTFUL, _OUT = range(4)


def _looks(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _OUT_TAGS or (tag == "header" and not in_article):
        return _OUT
    out = _UNLIKELY if tag == "form" else _FINE
    if not attributes or tag in ("html", "body", "main"):
        return out
    words = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in _OUT_ROLES or name == "aria-hidden" and value == "true":
            return _OUT
        if name in ("class", "id"):
            words += " " + value
    if not words:
        return out
    if tag == "article":
        return _DOUBTFUL if _REPLY.search(words) else out
    return _DOUBTFUL if _NOT.search(words) or not in_article and _HEADS.search(words) else _UNLIKELY if _HARDLY.search(words) else out


class Page:
    """The elements of a page, in document order, without what isn't article: tag, parent, and per element the
    characters and tags in it, and those of links. pieces: (element, block, text)."""

    def __init__(self, html: str, by_words: bool = True):
        self.tag, self.parent, self.looks, self.pieces, self.body = ["#page"], [-1], [_FINE], [], 0
        self._parse(html)
        n = len(self.tag)
        self.gone = [False] * n
        self._count()
        if by_words:
            self._leave_out()

    def _count(self) -> None:
        """Sums over the subtrees of what isn't gone."""
        n = len(self.tag)
        self.chars, self.tags, self.link_chars, self.link_tags, self.size = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
        for node, _, text in self.pieces:
            if not self.gone[node]:
                self.chars[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.size[p] += self.size[i]
            if self.gone[i]:
                continue
            if self.tag[i] == "a":
                self.link_chars[i], self.link_tags[i] = self.chars[i], self.tags[i] + 1
            self.chars[p] += self.chars[i]
            self.tags[p] += self.tags[i] + 1
            self.link_chars[p] += self.link_chars[i]
            self.link_tags[p] += self.link_tags[i]

    def _leave_out(self) -> None:
        """Elements that look unlikely go, with all that is in them, unless they hold all articles or main; the least
        unlikely ones of a page without either stay too if more than half of the text outside links is theirs."""
        n = len(self.tag)
        own = [c - x for c, x in zip(self.chars, self.link_chars)]
        # an article or main counts unless it lies in another, as comments may
        articles = [int(t in ("article", "main") and x == _FINE) for t, x in zip(self.tag, self.looks)]
        within = list(map(bool, articles))
        for i in range(1, n):
            if within[self.parent[i]]:
                within[i], articles[i] = True, 0
        for i in range(n - 1, 0, -1):
            articles[self.parent[i]] += articles[i]
        holds = [0 < k == articles[0] for k in articles]
        rest, i = own[0], 0
        drop = []
        while i < n:  # the doubtful ones first: their text doesn't count for the others
            if self.looks[i] == _DOUBTFUL and not holds[i]:
                drop.append(i)
                rest -= own[i]
                i += self.size[i]
            else:
                i += 1
        for at in drop:
            self.gone[at : at + self.size[at]] = [True] * self.size[at]
        self._count()
        own = [c - x for c, x in zip(self.chars, self.link_chars)]
        drop, i = [], 0
        while i < n:
            if not self.gone[i] and self.looks[i] == _UNLIKELY and not holds[i] and (holds[0] or 2 * own[i] <= rest):
                drop.append(i)
                i += self.size[i]
            else:
                i += 1
        for at in drop:
            self.gone[at : at + self.size[at]] = [True] * self.size[at]
        if drop:
            self._count()

    def _parse(self, html: str) -> None:
        stack = [0]  # open elements; those in what's left out are -1
        names = ["#page"]
        out_from = articles = block = pos = 0
        n = len(html)

        def close(depth: int) -> None:
            nonlocal out_from, articles, block
            while len(stack) > depth:
                name = names.pop()
                stack.pop()
                articles -= name in ("article", "main")
                block += name in _BLOCK
            if out_from >= len(stack):
                out_from = 0

        while pos < n:
            at = html.find("<", pos)
            if at < 0:
                at = n
            if at > pos and not out_from:
                self.pieces.append((stack[-1], block, unescape(html[pos:at])))
            if at == n:
                break
            after = html[at + 1 : at + 2]
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                pos = n if end < 0 else end + 3
                continue
            closing = after == "/"
            first = html[at + 2 : at + 3] if closing else after
            if after in ("!", "?") or (closing and first and not first.isalpha()):
                end = html.find(">", at)
                pos = n if end < 0 else end + 1
                continue
            if not (first.isalpha() and first.isascii()):
                if not out_from:
                    self.pieces.append((stack[-1], block, "<"))
                pos = at + 1
                continue
            end = _tag_end(html, at)
            if end < 0:  # the page ends in a tag
                break
            pos = end + 1
            name = _NAME.match(html, at + 1 + closing, end)
            tag = name[0].lower() if name else ""
            if closing:
                if tag in names:
                    depth = len(names) - 1 - names[::-1].index(tag)
                    close(depth)
                elif tag in _BLOCK:
                    block += 1
                continue
            if tag in _RAW and not html.startswith("/", end - 1):
                stop = _RAW_END[tag].search(html, pos)
                if stop is None:
                    break
                end = html.find(">", stop.end())
                pos = n if end < 0 else end + 1
                continue
            if tag in ("body", "article", "main") and out_from:  # an element that was never closed doesn't hold these
                close(out_from)
            if tag == "body":
                if not self.body:
                    self.body = len(self.tag)
            if tag in _BLOCK:
                block += 1
                if "p" in names and tag != "br":
                    depth = len(names) - 1 - names[::-1].index("p")
                    if not any(x in _BLOCK for x in names[depth + 1 :]):
                        close(depth)
                if tag in _ENDS:
                    for depth in range(len(names) - 1, 0, -1):
                        if names[depth] in _HOLDS[tag]:
                            break
                        if names[depth] in _ENDS[tag]:
                            close(depth)
                            break
            if tag in _VOID or html.startswith("/", end - 1) and tag not in _BLOCK:
                continue
            looks = _OUT if out_from else _looks(tag, html[name.end() : end], articles > 0)
            if not out_from and looks == _OUT:
                out_from = len(stack)
            articles += tag in ("article", "main")
            if out_from:
                stack.append(-1)
            else:
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.looks.append(looks)
                stack.append(len(self.tag) - 1)
            names.append(tag)

    def densities(self) -> list[float]:
        """Composite text density: characters per tag, times the logarithm of how little of them links hold, divided
        by one that grows with the element's and the body's share of link text."""
        body_links = self.link_chars[self.body] / max(1, self.chars[self.body])
        out = []
        for c, t, lc, lt, gone in zip(self.chars, self.tags, self.link_chars, self.link_tags, self.gone):
            if gone:
                out.append(0.0)
                continue
            t = max(1, t)
            share = c / max(1, lc) * t / max(1, lt)
            linked = c / max(1, c - lc) * lc + body_links * c
            out.append(c / t * log(max(1, share)) / (1 + log(log(linked + e))))
        return out

    def main(self) -> list[int]:
        """The elements that are the article, in page order, none in another. The threshold is the density of the
        thinnest element on the way from the body to the one whose children's densities have the largest sum. That one
        is kept, and walking from the body every other element that is at least so dense and doesn't hold it, whole. If
        an article or main holds the best one, that element alone is the article."""
        density, n = self.densities(), len(self.tag)
        total = [0.0] * n
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += density[i]
        first, last = self.body, self.body + self.size[self.body]
        best = max(range(first, last), key=lambda i: (total[i], -i))
        if not total[best]:  # no element has text of its own children: the text lies right in the body
            return [self.body]
        i = best
        while i > 0:
            if self.tag[i] in ("article", "main"):
                return [i]
            i = self.parent[i]
        threshold, i = density[best], best
        while i != self.body:
            i = self.parent[i]
            threshold = min(threshold, density[i])
        holds, i = set(), best
        while i != first:
            i = self.parent[i]
            holds.add(i)
        kept, i = [], first
        while i < last:  # past elements that hold the best one or are too thin, over those that are kept
            if i not in holds and density[i] >= threshold and not self.gone[i]:
                kept.append(i)
                i += self.size[i]
            else:
                i += 1
        return kept

    def text(self) -> str:
        kept = self.main()
        inside = [False] * len(self.tag)
        for node in kept:
            for i in range(node, node + self.size[node]):
                inside[i] = not self.gone[i]
        blocks: dict[int, list[str]] = {}
        for i, block, text in self.pieces:
            if inside[i]:
                blocks.setdefault(block, []).append(text)
        return " ".join(t for t in (" ".join("".join(x).split()) for x in blocks.values()) if t)


def main_text(html: str | None) -> str:
    """The main text; of a page with nothing but what classes and ids call boilerplate, that."""
    if not html:
        return ""
    return Page(html).text() or Page(html, by_words=False).text()


def _extract(batches):
    for batch in batches:
        text = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text and n_chars (code points).

    Each page is a task of its own on its executor; nothing is shuffled. Scripts, styles, menus, page headers, footers,
    asides and form controls never count; what class, id or role name as adverts, notices, sidebars or reader comments,
    and forms, don't unless they hold the article or, but for adverts, comments and the like, most of the text. Of the
    rest the densest subtree is the article, or the article or main that holds it; without these, every other subtree
    as dense as the thinnest element around the densest one too. All of it is returned: blocks in page order, white space
    inside a block as one space, one space between blocks, character references decoded. Null and empty pages, and pages
    without text, give an empty text; pages that break off are read as far as they go; repeated rows and null ids keep
    their rows."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(C.table(spark, sf_dir, "pages"))
