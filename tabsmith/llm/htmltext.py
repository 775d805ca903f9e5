"""Main text of HTML pages by tag-path ratios.

Every text node has a root-to-leaf tag path.  Per path, text length and
punctuation are added up and related to the number of its nodes; these two
ratios are smoothed over the paths in page order (a Gaussian, so that a heading
next to paragraphs counts as part of them) and fused into one score, times the
share of the path's text that isn't inside links.  Paths that reach a share of the page's
text-weighted mean score are content; a block of text is kept if one of its
nodes lies on such a path.

Paths through elements that are never the article (menus, headers, footers,
asides, forms, scripts, what is hidden) score 0.  So do elements that a class, id or role calls
an advert, a notice, a comment and so on, unless they hold at least half of the
page's text outside links, as page wrappers do (and no article or main element
with text lies outside them).  Where such a name also has a word of page
structure (``content-sidebar-wrap``, ``category-social``), it only halves the
score.  A header outside the article is kept if it holds the page's first h1,
has no more text in links than outside, and the article has no title.
``article`` and ``main`` elements are a factor: paths inside them need half the
share, and where they hold more than half of the rest's text outside links,
paths outside them score 0.  A table inside them is scored as one text.

Inside a block white space becomes one space; blocks are joined by one line
break.  One pass, no shuffle; only the html column goes to Python.

Edge cases: a null or empty page, or one without text, gives an empty text;
broken markup is read leniently (a ``<`` that opens no tag is text; elements
left open end with what surrounds them; quoted values of any length belong to
their tag, and one that never closes ends at the first ``>``; a ``p`` ends at the next block); very
long pages are read whole in one linear pass; a ``main`` element counts even
inside elements whose names speak against them.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.core import q

SHARE = 0.5        # of the text-weighted mean score that a path must reach
INSIDE = 2.0       # factor of the scores of paths inside article elements
MAJORITY = 0.5     # share of the text outside links that article elements must exceed to drop what is outside them
SIGMA = 1.0        # of the smoothing, in paths

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)""", re.S)
VALUE = re.compile(r"""=\s*+(["'])|>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
NAMES = frozenset("class id role style hidden aria-hidden itemprop".split())
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
# starting one of these ends an open p
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                   "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# starting one ends the open ones of its set, up to the element that holds them
SIBLINGS = [(frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), (frozenset(["dt", "dd"]), frozenset(["dl"])),
            (frozenset(["td", "th"]), frozenset(["tr", "table"])), (frozenset(["tr"]), frozenset(["table"])),
            (frozenset(["option"]), frozenset(["select"]))]
NEVER = frozenset("head nav footer aside form script style noscript template iframe svg math canvas object audio video button select "
                  "textarea input menu dialog search".split())
NOT_CONTENT = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside masthead topbar footer comment comments disqus replies respond share sharing social related recommended widget widgets "
    "toolbar pagination pager paywall alert form search complementary contentinfo tags".split())
# words of page structure: with one of them, a name speaks of where an element is rather than what
STRUCTURE = frozenset("content contents wrap wrapper container page layout main body post article entry story text category tag "
                      "results free with has no not without wp is".split())
HIDDEN, NAMED, DOUBTED = 3, 2, 1
OWN = 0.05  # share of the plain text that an article element must hold outside a named element, to leave that unprotected


def spoken_against(tag: str, attributes: str) -> int:
    """What class, id, role or style say: the element is hidden, named as no part of the article, or doubted (0: nothing)."""
    if tag in ("html", "body", "main"):
        return 0
    most = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name not in NAMES:
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return HIDDEN
        if name in ("class", "id", "role"):
            for part in value.split():
                words = [w.lower() for w in WORDS.findall(part)]
                if any(w in NOT_CONTENT for w in words):
                    most = max(most, DOUBTED if tag == "article" or any(w in STRUCTURE for w in words) else NAMED)
    return most


class Inside:
    """Where a text node lies: whether it is never content, in an article, a link or (the number of) a table of an
    article, and the elements around it whose names speak against them, or that are headers."""
    __slots__ = ("never", "article", "link", "table", "named")

    def __init__(self, never=False, article=False, link=False, table=0, named=()):
        self.never, self.article, self.link, self.table, self.named = never, article, link, table, named


class Element:
    """A named element or header of a page, and its text in and outside links."""
    __slots__ = ("kind", "plain", "linked", "article", "title")

    def __init__(self, kind):
        self.kind, self.plain, self.linked, self.article, self.title = kind, 0, 0, 0, False


class TagEnds:
    """Where the tags of a page end: at the first ``>`` that isn't in a quoted value, however long that is, or, where
    a quote never closes, at the first ``>``.  Linear in the page: what follows a quote is looked up once."""

    def __init__(self, page: str):
        self.page, self.after = page, {}           # opening quote: end of the tag it is in, or -1
        self.special = self.plain = (0, -1, None)  # last lookups: from, found at, what

    def first(self, at: int):
        """The first quoted value or ``>`` from ``at``, as its position and match."""
        start, found, match = self.special
        if not start <= at <= found:
            match = VALUE.search(self.page, at)
            found = match.start() if match else len(self.page)
            self.special = (at, found, match)
        return match

    def end(self, at: int) -> int:
        """The position of the ``>`` that ends a tag whose name ends at ``at``, or -1."""
        match, seen, result = self.first(at), [], -1
        while match is not None:
            if not match[1]:
                result = match.start()
                break
            opening = match.end() - 1
            if opening in self.after:
                result = self.after[opening]
                break
            seen.append(opening)
            close = self.page.find(match[1], opening + 1)
            match = VALUE.search(self.page, close + 1) if close >= 0 else None
        self.after.update(dict.fromkeys(seen, result))
        if result < 0:
            start, found, _ = self.plain
            if not start <= at <= found:
                found = self.page.find(">", at)
                found = len(self.page) if found < 0 else found
                self.plain = (at, found, None)
            result = found if found < len(self.page) else -1
        return result


def nodes(page: str, titles: list):
    """Text nodes as (block number, path, text, ``Inside``); ``titles`` gets the tag of each h1 and h2 and where it is."""
    # open elements: (tag, path, inside)
    stack, block, at, tables = [("", "", Inside())], 0, 0, 0
    n, look, ends = len(page), 0, TagEnds(page)
    while at < n:
        found = TAG.search(page, look)
        if found is None:
            break
        end = found.end()
        if found[2]:
            end = ends.end(end) + 1
            if end == 0:  # opens no tag: text
                look = found.end()
                continue
        if found.start() > at:
            yield block, stack[-1][1], page[at:found.start()], stack[-1][2]
        at = look = end
        if not found[2]:
            continue
        tag, closing, attributes = found[2].lower(), found[1], page[found.end():end - 1]
        if tag not in INLINE and tag not in ("script", "style", "noscript", "template"):
            block += 1
        elif tag == "br":
            yield block, stack[-1][1], " ", stack[-1][2]
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # the end of an inline element doesn't reach out of its block
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        for own, holder in SIBLINGS:
            if tag in own:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in own:
                        del stack[k:]
                        break
                    if stack[k][0] in holder:
                        break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = look = end.end() if end else n
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag in ("path", "svg"):
            continue
        _, path, around = stack[-1]
        says = spoken_against(tag, attributes)
        article = around.article or tag in ("article", "main") or "articleBody" in attributes
        own = Inside(around.never or tag in NEVER or says == HIDDEN, article, around.link or tag == "a", around.table, around.named)
        if tag == "main":
            own.named = ()
        elif tag == "header" and not article:
            own.named = (*own.named, Element("header"))
        elif says in (NAMED, DOUBTED):
            own.named = (*own.named, Element(says))
        if tag == "table" and article and not own.table:
            tables += 1
            own.table = tables
        if tag in ("h1", "h2"):
            titles.append((tag, own))
        # all of a table has one path
        stack.append((tag, path if around.table else f"{path}/{tag}", own))
    if at < n:
        yield block, stack[-1][1], page[at:], stack[-1][2]


def path_scores(found) -> dict:
    """Smoothed and fused score per path, from (path, text, inside a link, table or 0); a table is one text."""
    sums: dict = {}
    tables = set()
    for path, text, link, table in found:
        s = sums.setdefault(path, [0, 0, 0, 0])
        size = len(text)
        s[0] += not table or table not in tables
        tables.add(table)
        s[1] += size
        s[2] += len(PUNCTUATION.findall(text))
        s[3] += size if link else 0
    paths = list(sums)
    length = [math.log1p(sums[p][1] / sums[p][0]) for p in paths]
    marks = [math.log1p(sums[p][2] / sums[p][0]) for p in paths]
    reach = math.ceil(3 * SIGMA)
    kernel = [math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(reach + 1)]

    def smooth(x, k):
        near = range(max(0, k - reach), min(len(x), k + reach + 1))
        return sum(kernel[abs(k - j)] * x[j] for j in near) / sum(kernel[abs(k - j)] for j in near)

    plain = [1 - sums[p][3] / max(1, sums[p][1]) for p in paths]
    return {p: plain[k] * (smooth(length, k) + smooth(marks, k)) for k, p in enumerate(paths)}


def judged(found: list, titles: list) -> dict:
    """Whether each named element or header counts (1), counts half (0.5) or not at all (0)."""
    every: dict = {}
    total = articles = 0
    for _, text, at in found:
        size = len(text.strip())
        total += 0 if at.link else size
        articles += size if at.article and not at.link else 0
        for e in at.named:
            every.setdefault(id(e), e)
            e.plain += 0 if at.link else size
            e.linked += size if at.link else 0
            e.article += size if at.article and not at.link else 0
    first = next((at for tag, at in titles if tag == "h1" and not at.never), None)
    titled = any(at.article and not at.never for _, at in titles)
    out = {}
    for key, e in every.items():
        if e.kind == "header":
            out[key] = float(first is not None and any(x is e for x in first.named) and not titled and e.linked <= e.plain)
        elif 2 * e.plain >= total and articles - e.article < OWN * total:
            out[key] = 1.0
        else:
            out[key] = 0.5 if e.kind == DOUBTED else 0.0
    return out


def main_text(page) -> str:
    """The main text of one page."""
    titles: list = []
    found = [(block, path, html.unescape(text), at) for block, path, text, at in nodes(page or "", titles) if not at.never]
    weight = judged([x[1:] for x in found], titles)
    blocks: dict = {}
    for block, path, text, at in found:
        counts = min((weight.get(id(e), 1.0) for e in at.named), default=1.0)
        if counts:
            # a title's header stays with the article
            article = at.article or any(e.kind == "header" for e in at.named)
            blocks.setdefault(block, []).append((path, text, article, at.link, at.table, counts))
    every = [x for parts in blocks.values() for x in parts if x[1].strip()]
    plain = [x for x in every if not x[3]]
    majority = sum(len(x[1].strip()) for x in plain if x[2]) > MAJORITY * sum(len(x[1].strip()) for x in plain)
    # a path can be inside an article, or a doubted element, in one place and outside in another
    scores = path_scores([((x[0], x[2], x[5]), x[1].strip(), x[3], x[4]) for x in every if x[2] or not majority])
    scores = {k: score * k[2] for k, score in scores.items()}
    size = {k: 0 for k in scores}
    for path, text, article, _, _, counts in every:
        if (path, article, counts) in size:
            size[path, article, counts] += len(text.strip())
    mean = sum(scores[k] * n for k, n in size.items()) / max(1, sum(size.values()))
    chosen = {k for k, score in scores.items() if score * (INSIDE if k[1] else 1) >= SHARE * mean}
    out = []
    for parts in blocks.values():
        parts = [x for x in parts if x[2] or not majority]
        if any((x[0], x[2], x[5]) in chosen and x[1].strip() for x in parts):
            if line := " ".join("".join(x[1] for x in parts).split()):
                out.append(line)
    return "\n".join(out)


@F.arrow_udf(T.StringType())
def _main_text(page: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in page], pa.string())


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of their html."""
    return pages.withColumn(name, _main_text(F.col(q(html_col))))
