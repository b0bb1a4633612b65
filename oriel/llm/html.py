"""Main text of web pages by two-pass block rules.

The page becomes blocks (text between block-level tags, outside dropped
elements).  Pass 1 decides each block from length, link density and stop-word
density: long blocks and blocks dense in stop words are content, blocks that are
mostly links are boilerplate, short ones stay open.  Pass 2 gives open blocks the
label of their nearest decided neighbours, by distance in words; between unlike
neighbours the nearer one counts, a heading goes with what follows it.  Both
passes run on every page and every block; that a block lies in an ``article`` or
``main`` element is one feature among these.

Elements that are no part of any article (menus, forms, scripts, and elements
whose attributes say so) are dropped first.  One that is never closed ends where
its parent does, or, if that is the body, with its own first block.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import tidy

# Element names of HTML.
DROPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "svg", "iframe", "object", "head", "title", "math", "canvas", "audio", "video", "dialog", "menu"}
BLOCK = {"address", "article", "blockquote", "body", "br", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers whose class, id or role may mark them as no part of the article; single paragraphs and words are judged by their text.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "article", "main", "figure", "details", "fieldset", "center", "p", "span"}
#: Words of class, id and role attributes that mark an element as no part of the article.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|consent|disclaimer|footer|header|login|menu|modal|nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
#: Frequent function words of English, German, French and Spanish.
STOP = frozenset("the of and to in a is that for it was on are as with be by this at or from und der die das den dem des ein eine ist mit von zu nicht auf für sich als auch im le la les de du des un une et en que qui est dans pour sur pas par au aux avec el los las del y es por con para se una no lo su al".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WHITE = re.compile(r"\s+")

CONTENT, OPEN, BOILERPLATE = 1, 0, -1


class Block:
    """Text between block-level tags: characters in links, whether it is a heading or within an article, and the unclosed dropped element it may belong to."""

    __slots__ = ("heading", "inside", "linked", "parts")

    def __init__(self, inside: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.inside = inside
        self.heading = False


def _away(name: str, attributes: dict[str, str], article: int) -> bool:
    """Whether an element is no part of any article."""
    if name in DROPPED:
        return not (name == "header" and article)
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    said = name in CONTAINERS and any(ASIDE.search(attributes.get(k, "")) for k in ("class", "id", "role"))
    # within an article only containers of their own, not its paragraphs and phrases
    return said and not (article and name in ("p", "span", "main"))


def _elements(page: str):
    """(start, end, name, closes, attributes) of each tag, raw elements as one; the text lies between."""
    at, n = 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        if not tag:
            return
        start, at = tag.span()
        name = (tag[2] or "").lower()
        if name in RAW and not tag[1]:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            # an unclosed raw element ends with its line
            feed = page.find("\n", at)
            at = close.end() if close else (n if feed < 0 else feed)
            yield start, at, "", False, ""
        else:
            yield start, at, name, bool(tag[1]), tag[3] or ""


def _closings(tags: list) -> set[int]:
    """Indices of start tags that an end tag of theirs closes."""
    opened: dict[str, list[int]] = {}
    closed: set[int] = set()
    for k, (_, _, name, closes, _) in enumerate(tags):
        if not name:
            continue
        if not closes:
            opened.setdefault(name, []).append(k)
        elif opened.get(name):
            closed.add(opened[name].pop())
    return closed


def blocks_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, within an article, heading) of each block that has text, in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, opens a dropped part, is an article
    dropped = article = links = 0
    now = Block(False)
    once = 0  # an unclosed dropped element takes one block with text

    def end() -> None:
        nonlocal now, once
        text = _WHITE.sub(" ", unescape("".join(now.parts))).strip()
        if text and once:
            once = 0
        elif text:
            out.append((text, min(now.linked, len(text)), now.inside, now.heading))
        now = Block(article > 0)

    tags = list(_elements(page))
    closed = _closings(tags)
    at = 0
    for index, (start, stop, name, closes, rest) in enumerate(tags):
        if start > at and not dropped:
            now.parts.append(page[at:start])
            if links:
                now.linked += len(unescape(page[at:start]).strip())
        at = stop
        if not name:
            continue
        if name in BLOCK or name in DROPPED:
            end()
        if not closes:
            if name in VOID or rest.endswith("/") and name not in BLOCK | DROPPED | {"a", "b", "i", "span"}:
                continue
            attributes = dict((k.lower(), (v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(rest))
            away = _away(name, attributes, article)
            if name == "p":  # a paragraph ends the one before it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        dropped -= sum(x[1] for x in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK | DROPPED:
                        break
            if away and index not in closed and name != "p":
                once = 1 if not dropped else once
                continue
            # a teaser or a reader's comment says nothing about the page
            main = name in ("article", "main") and not away
            stack.append((name, away, main))
            dropped += away
            article += main
            links += name == "a" and index in closed
            if main:
                now.inside = article > 0
            now.heading = name in HEADINGS
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for x in stack[k:]:
                        dropped -= x[1]
                        article -= x[2]
                        links -= x[0] == "a"
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body", "html", "table") and name not in ("article", "main", "body", "html", "table"):
                    break  # a stray end tag closes nothing beyond its container
            links = max(links, 0)
        now.inside = article > 0
    if len(page) > at and not dropped:
        now.parts.append(page[at:])
    end()
    return out


def first_pass(blocks: list[tuple[str, int, bool, bool]]) -> list[int]:
    """Length, link density and stop-word density decide; short blocks and headings stay open.

    An article's own blocks may hold more links; on a page with most of its text
    in articles, blocks outside need both length and stop words.
    """
    labels = []
    framed = 2 * sum(len(b[0]) for b in blocks if b[2]) > sum(len(b[0]) for b in blocks)
    for text, linked, inside, heading in blocks:
        words = text.split(" ")
        stop = sum(w.strip(".,;:!?\"'()").lower() in STOP for w in words) / len(words)
        if linked > (0.5 if inside else 0.33) * len(text):
            labels.append(BOILERPLATE)
        elif heading or len(words) < 8:
            labels.append(OPEN)
        elif (len(words) >= 20 and stop >= 0.1) or ((inside or not framed) and (len(words) >= 20 or stop >= 0.1)):
            labels.append(CONTENT)
        else:
            labels.append(OPEN)
    return labels


def second_pass(blocks: list[tuple[str, int, bool, bool]], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided block, by words between; a heading, of the one after it.

    With none decided on one side the other side counts, of two equally near
    ones that of boilerplate; where none is decided at all, all is content.
    Inside an article only its own blocks count, and an open one goes only
    between two of boilerplate; an article's text does not speak for blocks outside.
    """
    size = [b[0].count(" ") + 1 for b in blocks]

    def nearest(order: range) -> list[tuple[int, int, bool]]:
        """(label, words between, in the same article) of the last decided block before each."""
        out = [(OPEN, 0, False)] * len(blocks)
        label, apart, inside = OPEN, 0, False
        for k in order:
            out[k] = (label, apart, inside)
            if labels[k]:
                label, apart, inside = labels[k], 0, blocks[k][2]
            else:
                apart += size[k]
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    out = list(labels)
    for k, label in enumerate(labels):
        if label:
            continue
        (b, near, b_in), (a, far, a_in) = before[k], after[k]
        inside, heading = blocks[k][2], blocks[k][3]
        if inside:  # beyond the article's edge nothing speaks against its own blocks
            b, a = b if b_in else CONTENT, a if a_in else CONTENT
            out[k] = a if heading else max(b, a)
            continue
        b, a = BOILERPLATE if b_in else b, BOILERPLATE if a_in else a
        if heading and a:
            out[k] = a
        elif b and a and b != a:
            out[k] = b if near < far else a if far < near else BOILERPLATE
        else:
            out[k] = b or a or CONTENT
    return out


def classified(blocks: list[tuple[str, int, bool, bool]]) -> list[str]:
    """Both passes; the texts of content blocks in order."""
    labels = second_pass(blocks, first_pass(blocks))
    return [b[0] for b, x in zip(blocks, labels, strict=True) if x == CONTENT]


def main_text(page: str | None) -> str:
    return "\n\n".join(classified(blocks_of(page))) if page else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text (main text, empty if none) and n_chars (its code points).

    A null or empty page gives the empty text; broken markup is read as far as
    it goes; whole pages of any length are read; repeated rows and null keys or
    addresses stay as they are; other columns are left out, whatever their
    names.  An empty table gives no rows.
    """
    kinds = dict(pages.dtypes)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["k", "u", "text", "n_chars"])

    out = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).cast("string").alias("h"))
    return out.mapInArrow(tidy(run), f"k {kinds[key]}, u {kinds[url]}, text string, n_chars long").withColumnsRenamed({"k": key, "u": url})
