"""Main text of web pages from flat text blocks.

A page is cut at block-level tags into flat blocks. A block has its number of words and its link density, those of the
blocks before and after it, and as markup the kind of its element, whether it lies in the page's article or in an
element that isn't one, and what the names of those around it say: comments, sidebars, adverts and the like are no
article, names like share or banner leave it to words and links. A decision tree, trained on the small table of
labelled blocks below, tells content from the rest; in training a test of markup has to separate ``MARKUP_COST`` times as
well as one of words or links, so markup decides only what those leave open.

Defined results: null, empty and tagless html is handled like any other (text outside of tags is a block); pages cut off
anywhere are read to their end, but for what an unclosed script or style hides; start tags imply the end of an open
paragraph, list item, option or table part; an inline element that is named as boilerplate is a block of its own; what
isn't displayed (hidden, display: none) isn't read; a page without content has the empty text; repeated rows are separate
rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from html import unescape
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_arrow

# Names of HTML elements
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul br".split())
HIDDEN = frozenset("script style noscript template iframe object svg annotation annotation-xml title textarea canvas audio video select".split())
FOREIGN = frozenset("svg annotation annotation-xml".split())  # a slash closes them
TO_END = frozenset("script style".split())  # without an end tag they hide the rest of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav aside footer form menu dialog button fieldset header".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote figcaption dd dt caption summary".split())
ENTRIES = frozenset("li td th option legend".split())
# What names in class, id and role say of an element. NAMED is no article, LEADING neither as a name's first
# word; VAGUE may be one, which its words and links tell. TRAILING words at a name's end say nothing.
NAMED = frozenset("ad ads adsense advert adverts advertisement advertisements breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr login masthead menu nav navbar navigation newsletter notice notices pager pagination recommendations related replies responses sidebar signup sponsor sponsored sponsors subscribe".split())
LEADING = frozenset("cookie disqus gdpr newsletter related sponsored".split())
VAGUE = frozenset("banner modal popup promo search share sharing skip social toolbar widget".split())
TRAILING = frozenset("area bar banner block bottom box container content form holder inner item items left link links list menu notice panel posts right section slot text thread top unit widget wrap wrapper".split())
SIZE = re.compile(r"\d+(?:x\d+)?|x\d+")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+(?:x\d+)?")
# Start tags that imply the end of open elements (and of all in them), and the elements that this doesn't reach beyond
ITEMS = BLOCKS - frozenset("address div p li dt dd".split())
IMPLIED = {
    "li": (frozenset(["li"]), ITEMS),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), ITEMS)),
    "option": (frozenset(["option"]), ITEMS - {"option"}),
    "optgroup": (frozenset(["option", "optgroup"]), ITEMS - {"option", "optgroup"}),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"]))),
}
PARAGRAPH = frozenset(["p"]), frozenset("button table caption td th".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body br button caption frameset html legend optgroup option select tbody td tfoot th thead tr".split())

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNDISPLAYED = re.compile(r"display\s*:\s*none", re.I)
EMPTY = re.compile(r"(?:^|[\s\"'])/>\Z")


def says(name: str) -> int:
    """2 if a name is that of no article, 1 if it may be, else 0: by its last word that says something, or its first."""
    words = [w.lower() for w in WORDS.findall(name)]
    first = words[0] if words else ""
    while len(words) > 1 and (words[-1] in TRAILING or SIZE.fullmatch(words[-1])):
        words.pop()
    last = words[-1] if words else ""
    return 2 if last in NAMED or first in LEADING else 1 if last in VAGUE else 0


@lru_cache(4096)
def _marks(attributes: str) -> tuple[int, bool]:
    """What an element's names say of it, and whether its attributes keep it from being displayed."""
    named, hidden = 0, False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            named = max([named, *map(says, value.split())])
        hidden |= key == "hidden" or key == "style" and bool(UNDISPLAYED.search(value))
    return named, hidden


class Open:
    """The open elements, and how many of them are what."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.apart = self.main = self.hidden = 0
        self.says = [0, 0, 0]

    def enter(self, name: str, attributes: str) -> None:
        named, hidden = _marks(attributes)
        apart = name in APART and not (name == "header" and self.main)  # an article's own heading
        self.at[name].append(len(self.stack))
        self.stack.append((name, apart, name in MAIN, named, hidden))
        self._count(1)

    def _count(self, n: int) -> None:
        _, apart, main, named, hidden = self.stack[-1]
        self.apart, self.main, self.hidden = self.apart + n * apart, self.main + n * main, self.hidden + n * hidden
        self.says[named] += n

    def leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._count(-1)
            self.at[self.stack.pop()[0]].pop()

    def end(self, name: str) -> None:
        if self.at[name]:
            self.leave(self.at[name][-1])

    def imply(self, ended: frozenset, barrier: frozenset) -> None:
        """Close the outermost of the ended elements that no barrier keeps apart."""
        if any(self.at[x] for x in ended):
            inside = max((self.at[x][-1] for x in barrier if self.at[x]), default=-1)
            found = [self.at[x][i] for x in ended for i in [bisect_right(self.at[x], inside)] if i < len(self.at[x])]
            if found:
                self.leave(min(found))

    def kind(self) -> int:
        """Of the innermost block element: 0 any, 1 entry of a list or table, 2 paragraph, 3 heading."""
        for name, *_ in self.stack[: -4 : -1]:
            if name in BLOCKS:
                return 3 if name in HEADINGS else 2 if name in PARAGRAPHS else 1 if name in ENTRIES else 0
        return 0

    def named(self) -> int:
        return 2 if self.says[2] else 1 if self.says[1] else 0

    def place(self) -> int:
        return -1 if self.apart else 1 if self.main else 0


def blocks(html: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, kind, place, named) of the flat blocks with text; place is -1 in elements that aren't articles, 1 in articles, else 0; named is what ``says`` gives."""
    out: list[tuple[str, int, float, int, int, int]] = []
    opened = Open()
    text: list[str] = []
    linked: list[str] = []
    link = False
    endless: set[str] = set()

    def close():
        words = unescape("".join(text)).split()
        if words:
            inside = len(unescape("".join(linked)).split())
            out.append((" ".join(words), len(words), min(1.0, inside / len(words)), opened.kind(), opened.place(), opened.named()))
        text.clear()
        linked.clear()

    def add(piece):
        if not opened.hidden:
            text.append(piece)
            if link:
                linked.append(piece + " ")

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name == "body" and not ends:
            continue
        if name in HIDDEN and not ends:
            if not (name in FOREIGN and EMPTY.search(m[3])):
                end = None if name in endless else re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if end is not None:
                    at = end.end()
                elif name in TO_END:
                    at = n
                else:
                    endless.add(name)
            continue
        if name == "a":
            link = not ends
        inline = name in ("span", "label", "small", "em", "strong", "ins")
        if name in BLOCKS:
            close()
            if not ends:
                if name in IMPLIED:
                    opened.imply(*IMPLIED[name])
                if name in ENDS_PARAGRAPH:
                    opened.imply(*PARAGRAPH)
        elif inline and (any(_marks(m[3])) if not ends else opened.at[name] and any(opened.stack[opened.at[name][-1]][3:])):
            close()
        if name in VOID:
            continue
        if ends:
            opened.end(name)
        elif name in BLOCKS or inline:
            opened.enter(name, m[3])
    close()
    return out


def features(found: list[tuple[int, float, int, int, int]]) -> list[tuple]:
    """Words and link density of each block and of those before and after it, its kind, place and name; beside a page's article, all others are apart."""
    article = any(b[3] > 0 for b in found)
    none = (0, 0.0, 0, 0, 0)
    return [
        (*b[:2], *x[:2], *y[:2], b[2], -1 if article and b[3] < 1 else b[3], b[4])
        for x, b, y in zip([none, *found], found, [*found[1:], none], strict=False)
    ]


#: Labelled blocks of pages, a line each: + content or - not; > in an article, < in an element that isn't one, = neither; ! named
#: as no article, ? by a vague name; heading h, paragraph p, entry i or other d; words, and after a slash those of them in links.
TABLE = """
-<i1/1 -<i1/1 -<i1/1 -=d7 +>h9 +>p12 +>p180 +>p31 +>p1 +>p64 +>p2 -<d8
-<i1/1 -<i1/1 -<i2/2 -=!d9 +>h4 +>p2 +>p1 +>p3 +>p1 -<d6
-<i1/1 -<i1/1 -=!d11 +>h13 +>p90 +>p1 +>p240 +>p7 +>p38 -<d9
-<i2/2 -<i1/1 -=d5 +>h1 +>p1 -<d7
-<d2 -<i1/1 -<i1/1 +>h6 +>p55/2 +>p4/4 +>i9 +>i12/3 +>i3/3 +>p70 -<p14 -<p30 -<d12/2
-=d14 -<i1/1 +>h8 +>d40 +>d2 +>d120 -=p25 -=d60 -=p4 -<d20/5
-<h2 -<i1/1 -<p16 +>h7 +>p33 -<p22 +>p41 +>p6 -<h3 -<i5/5 -<i6/6 -<d8
+>h5 +>p45 +>p60 ->!h1 ->!p24 ->!d3 ->!p52 ->!p8 -<d5
+>h5 +>p28 ->!d4 +>p66 ->!p12 +>p9 ->!d2/2 ->!d3/3
+>h3 +>p5/5 +>p19 +>i4/4 +>i4/4 +>i2 +>p8 -<d3/3 -<d2/2
-<i1/1 -=d9 +>h5 +>p80 +>p4 +>p3/3 -<d4
+>h5 +>p80 +>p7 +>i2/2 +>i9 +>p2/2 +>p1 +>i1/1 +>p3
+>p3/3 +>p30 +>d2/2 +>d4 +>d1 +>i1/1 +>d90 +>d5 +>i2/2
+>i1/1 +>i2/2 +>i1/1 +>p3
+>p20 +>d1
+>h4 +>d40 +>d3
+>h2 +>d30 +>i4 +>i2 +>i1
+>p7 +>d90 +>d18
+>h3 +>p50 +>d6 +>d2
+>p11 +>p35 ->!d4/4 ->!i2/2 ->!i1/1 ->!p9/3 +>p8 +>i5
+>h6 ->!d2/2 ->!d1/1 +>p44 ->!p6/3 ->!p14/2 +>p4 +>d2
-=i1/1 -=i1/1 +>p70 +>p12 +>p1/1 -=i1/1
-=i1/1 -=i1/1 -=i2/2 +=h6 +=p44 +=p90/3 +=p14 +=p130 +=p26 -=d4/3 -=d2/2 -=d6
-=d1/1 -=d1/1 -=d2/2 -=d1/1 +=d30 +=d95 +=d41/1 +=d60 -=d2/2 -=d3/3 -=d1/1
-=d6/6 +=h7 +=p24 +=p5 +=p61 +=h3 +=p80 +=p18 -=!d12 -=!p20 -=d9/8
-=d3/3 -=d4/3 -=d2 +=h9 +=p36 +=i12 +=i7 +=i15 +=p50 -=d2/2 -=d5/4 -=d4
-=i1/1 -=i3/3 -=i2/2 -=i4/4 -=i2/2 -=d3/3 -=i6/6 -=i5/5 -=i7/7
-=!d30 -=!d5 +=h4 +=p70 +=p22 -=!h2 -=!p35 -=!p12 -=!p60 -=!d3
-=i2/2 -=d2 +=p200/4 +=p12 +=p150 -=d1 -=i1/1
-=d2/2 -=d1/1 -=d2/2 +=d8 +=d70 +=d2 +=d44 +=d15 -=d3/3 -=d2/2
-=d1/1 -=d1/1 -=d9 +=h7 +=d25 +=d66 +=d30 -=d7
-=i1/1 -=i1/1 -=i1/1 -=d6 +=h8 +=p40 +=p3 +=p18 -=d6
+=d16
+=p9
+=h3 +=p11 +=p6 
+=p3 +=p2 +=p4
-=d2/2 -=d2 -=d2/2 +=d55 +=d80 -=d3 -=d2/2 -=d2
-=i1/1 -=i1/1 +=h5 +=p1 +=p30 +=p1 +=p2 +=p25 -=d2/2 -=d6
+>h4 +>p60 ->?d1 ->?d2/2 ->?i1/1 +>?p40 +>p30 ->?d3
+>h6 +>?d35 +>?d90 +>p22 ->?d2 ->?d4/4 +>?p16
+>p50 ->?i1/1 ->?i1/1 ->?i2/2 +>p14 +>?i24 +>?i31 ->?d5
+>h3 ->?d6/4 +>p80 +>?p12 +>?p75/3 ->?d2/1 ->?d1
+>p18 +>?p26 ->?d3/3 ->?d4 +>?h5 +>?p48
-=i1/1 +=h7 +=p90 -=?d3 -=?i1/1 -=?i2/2 +=?p55 +=p20 -=?d4/4
+=h5 +=?p38 +=?p64 +=p45 -=?d2 -=?d3/3 -=d4/4
-=?d2/2 -=?d2 +=p70 +=?d44 +=p25 -=!p40 -=!p22 -=!d3
+>p33 ->!p30 ->!p51 ->!d4 +>p20 ->!d2/2 ->!p80/2
-=d4/4 +=h4 +=d40 +=d11 +=d70 +=d13 +=d52 -=d3/3
-=d2/2 +=d28 +=d10 +=d64 +=d14 +=d38 -=d1/1
+>h4 +>p40 ->?p2 +>p33 ->?p3 +>p20 ->?p5
+>p25 ->?p1 ->?p4 +>p60 +>?p44 ->?p2 +>p31
+>p4/4 +>p25 +>d3/3 +>d5 +>d1/1 +>i2/2 +>d60 +>i3/3 +>d2/2
"""
MARKUP_COST = 2
LEAST_ROWS = 5
ONE = re.compile(r"([+-])([<>=])([!?]?)([diph])(\d+)(?:/(\d+))?")


def labelled(table: str) -> list[tuple]:
    """The features of labelled blocks, and 1 for content or 0."""
    rows = []
    for line in table.split("\n"):
        found = [((int(w), int(l or 0) / int(w), "diph".index(k), "<=>".index(p) - 1, ["", "?", "!"].index(n)), int(c == "+")) for c, p, n, k, w, l in ONE.findall(line)]
        rows += [(*x, c) for x, (_, c) in zip(features([b for b, _ in found]), found, strict=True)]
    return rows


def train(rows, depth: int = 12, least: int = LEAST_ROWS, markup: int = 6, cost: float = MARKUP_COST):
    """A decision tree by Gini impurity: (feature, threshold, tree up to it, tree above it), or a label.

    Features from ``markup`` on gain 1 / cost of what they separate; no side has under ``least`` rows.
    """
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    whole = 2 * ones * (1 - ones / len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        for a, b in pairwise(sorted({r[f] for r in rows})):
            cut = (a + b) / 2
            sides = [[r for r in rows if (r[f] > cut) == s] for s in (False, True)]
            if min(map(len, sides)) < least:
                continue
            gain = whole - sum(2 * sum(r[-1] for r in s) * (1 - sum(r[-1] for r in s) / len(s)) for s in sides)
            gain /= cost if f >= markup else 1
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, cut, sides
    if best is None:
        return int(2 * ones >= len(rows))
    below, above = (train(side, depth - 1, least, markup, cost) for side in best[3])
    return below if below == above else (best[1], best[2], below, above)


def decide(tree, x) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str, tree) -> str:
    """The content blocks, joined by blanks."""
    found = blocks(html)
    return " ".join(b[0] for b, x in zip(found, features([b[1:] for b in found]), strict=True) if decide(tree, x))


def _extractor(tree):
    def run(batches):
        for b in batches:
            texts = [main_text(x or "", tree) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(column(pages, id_col).alias("page_id"), column(pages, url_col).alias("url"), column(pages, html_col).alias("html"))
    kind = dict(rows.dtypes)
    return map_arrow(rows, _extractor(train(labelled(TABLE))), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
