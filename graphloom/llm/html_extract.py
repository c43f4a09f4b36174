"""Operator 10, HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags. Text in menus, headers, footers, sidebars, notices,
adverts, forms and comments, by their tags and names, is set aside. The first pass then decides blocks by link
density, and by length and stop-word density; in the second pass ambiguous short blocks inherit the
label of the nearest decided neighbours.

`article` and `main` are evidence that the text can outweigh. Where they hold TRUSTED of the prose, blocks
outside them are boilerplate, and blocks inside are kept but for link lists and short blocks between
these; elsewhere they only count for a block that the two passes leave open. A wrapper named like
boilerplate does not take an article with it that holds most of the prose (`layout has-sidebar`), and a
form around the whole page is no form.

Character references are decoded, white space inside a block becomes one space, and the kept blocks
are joined in page order by one space.

Defined cases: null, empty and tag-only pages give the empty string; unclosed tags, comments and
scripts run to the end of the page, an unclosed link to the end of its paragraph or of the element it
stands in; a null url stays null; repeated rows each get a row; extra columns are left out; very long
pages take time linear in their length; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices

# Tags that begin a new block.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol "
    "optgroup option p pre section summary table tbody td textarea tfoot th thead title tr ul".split()
)
# Elements whose content is never text of the page.
RAW_TAGS = {"script", "style", "template", "svg", "iframe", "canvas", "textarea", "title", "annotation", "annotation-xml"}
# Containers of boilerplate.
BAD_TAGS = {"nav", "footer", "aside", "form", "select", "button", "dialog", "menu", "head", "fieldset", "header"}
GOOD_TAGS = {"article", "main"}
# Words in a class, id or role that name boilerplate.
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply "
    "search share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget alert".split()
)
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = set(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this "
    "to was were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich ihr im ist mit nach nicht "
    "oder sich sie sind so um und von vor war wie wir zu zum zur über "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour "
    "qu que qui sa se ses son sur un une vous "
    "al como con del el entre era esta este ha las lo los más me muy no para pero por si sin sobre su sus también y ya".split()
)
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINKS_HIGH = 0.2

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_TAG_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_PARTS = re.compile(r"[^a-z0-9]+")
_EDGE = re.compile(r"^\W+|\W+$")
# A name that begins so tells of the layout, not of the element.
LAYOUT_NAMES = {"has", "with", "without", "no", "not", "layout"}
#: Share of a page's prose above which its articles are trusted to hold the main text.
TRUSTED = 0.4


def _says_bad(attributes: str) -> bool:
    """Whether an element is hidden, or a class, an id or a role names it as boilerplate."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and _HIDDEN_STYLE.search(value):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = [x for x in _PARTS.split(_CAMEL.sub(r"\1-\2", one).lower()) if x]
                if parts and parts[0] not in LAYOUT_NAMES and BAD_NAMES.intersection(parts):
                    return True
    return False


@dataclass
class Block:
    """Text, its share in links, the outermost article or main around it (0: none), whether boilerplate
    holds that one."""

    text: str
    links: float
    inside: int
    doubted: bool


class _Page:
    """The blocks of one page, built up tag by tag."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str | None]] = []  # open elements with what they say
        self.bad = self.outer = 0  # boilerplate around the text: since the outermost article, and before it
        self.inside = self.depth = self.articles = 0
        self.link: tuple[int, bool] | None = None  # depth of an open link, and whether in a loose element
        self.loose = False
        self.parts: list[str] = []
        self.linked: list[str] = []

    def text(self, raw: str) -> None:
        if not self.bad:
            self.parts.append(raw)
            if self.link:
                self.linked.append(raw)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                linked = len("".join(html.unescape("".join(self.linked)).split())) if self.linked else 0
                share = linked / max(1, len(text) - text.count(" "))
                self.blocks.append(Block(text, share, self.inside, self.inside > 0 and self.outer > 0))
            self.parts, self.linked = [], []

    def end_loose(self) -> None:
        """A paragraph, list item or cell ends; so does a link left open in it."""
        if self.link and self.link[1]:
            self.link = None
        self.loose = False

    def start(self, tag: str, attributes: str, forms: bool) -> None:
        says = None
        if tag == "body":  # a head that was never closed ends here
            self.open, self.bad, self.outer, self.inside, self.depth = [], 0, 0, 0, 0
        elif tag in GOOD_TAGS:
            says = "good"
            self.depth += 1
            if self.depth == 1:
                self.articles += 1
                self.inside, self.outer, self.bad = self.articles, self.bad + (bool(attributes) and _says_bad(attributes)), 0
        elif tag == "noscript":
            says = None if self.inside else "bad"
        elif tag in BAD_TAGS and not (tag == "header" and self.inside) and not (tag == "form" and not forms):
            says = "bad"
        elif tag != "html" and attributes and _says_bad(attributes):
            says = "bad"
        self.open.append((tag, says))
        self.bad += says == "bad"

    def end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    _, says = self.open.pop()
                    if says == "bad":
                        self.bad -= 1
                    elif says == "good":
                        self.depth -= 1
                        if not self.depth:
                            own = sum(x == "bad" for _, x in self.open)
                            self.inside, self.outer, self.bad = 0, 0, own
                if self.link and self.link[0] > len(self.open):
                    self.link = None
                return


# Elements without content, and block tags whose end tag may be left out.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LOOSE_TAGS = {"p", "li", "dd", "dt", "tr", "td", "th", "option"}


_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}


def parse(page: str, forms: bool = True) -> list[Block]:
    """The blocks of a page that no boilerplate container holds; forms: whether a form is one."""
    p, at, n = _Page(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            p.text(page[at:])
            break
        if lt > at:
            p.text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _TAG_LOOSE.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("/",) or page[lt + 1 : lt + 2].isalpha():
                end = page.find(">", lt)  # a tag that never ends swallows the rest
                at = n if end < 0 else end + 1
            else:
                p.text("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW_TAGS and not closing:
            if not attributes.endswith("/"):
                closer = _CLOSERS[tag].search(page, at)
                gt = page.find(">", closer.end()) if closer else -1
                at = n if gt < 0 else gt + 1
            p.text(" ")
        elif tag == "br":
            p.text(" ")
        elif tag == "a":
            p.link = None if closing else (len(p.open), p.loose)
        elif tag in BLOCK_TAGS or tag in BAD_TAGS or tag in GOOD_TAGS:
            p.end_block()
            if tag == "hr" or tag in VOID_TAGS:
                continue
            if closing:
                p.end_loose()
                p.end(tag)
            elif tag in LOOSE_TAGS:
                p.end_loose()
                p.loose = True
                if attributes and _says_bad(attributes):
                    p.start(tag, attributes, forms)
            else:
                p.start(tag, attributes, forms)
        elif not closing and tag not in VOID_TAGS and (tag == "noscript" or attributes and _says_bad(attributes)):
            p.start(tag, attributes, forms)
        elif closing:
            p.end(tag)
    p.end_block()
    return p.blocks


def _stop_density(text: str) -> float:
    words = [_EDGE.sub("", w).lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def _first_pass(block: Block, trusted: bool) -> str:
    """good, bad, near (long enough to speak, but not clearly), short, or lean: short, in a trusted
    article."""
    text, links = block.text, block.links
    if trusted:
        if links > 0.5:
            return "bad"
        return "lean" if len(text) < SHORT else "good"
    if links > LINKS_HIGH:
        return "bad"
    if len(text) < SHORT:
        return "bad" if links else "short"
    density = _stop_density(text)
    if density >= STOP_HIGH:
        return "good" if len(text) > LONG else "near"
    return "near" if density >= STOP_LOW or block.inside else "bad"


def classify(blocks: list[Block]) -> list[bool]:
    """Whether each block belongs to the main text."""
    prose: dict[int, float] = {}
    for b in blocks:
        if len(b.text) >= SHORT:
            prose[b.inside] = prose.get(b.inside, 0.0) + len(b.text) * (1 - b.links)
    doubted = {b.inside for b in blocks if b.doubted and 2 * prose.get(b.inside, 0.0) <= sum(prose.values())}
    for x in doubted:
        prose.pop(x, None)
    outside, held = prose.pop(0, 0.0), sum(prose.values())
    articles = {b.inside for b in blocks if b.inside and b.inside not in doubted}
    trust = bool(articles) and held >= TRUSTED * (held + outside)
    labels = ["bad" if b.inside in doubted or trust and not b.inside else _first_pass(b, trust) for b in blocks]
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    out, k = [], 0
    for i, x in enumerate(labels):
        while k < len(decided) and decided[k] < i:
            k += 1
        if x in ("good", "bad"):
            out.append(x == "good")
            continue
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        if before is None and after is None:  # nothing on the page speaks against it
            out.append(True)
        elif x == "lean":  # only between two link lists of the same article
            beside = [before, after]
            out.append(not all(y is not None and labels[y] == "bad" and blocks[y].inside == blocks[i].inside for y in beside))
        elif before is None or after is None:
            out.append(labels[after if before is None else before] == "good")
        elif labels[before] == labels[after] or i - before != after - i:
            out.append(labels[before if i - before <= after - i else after] == "good")
        else:
            out.append(True)  # between main text and boilerplate, equally near: a heading or a last line
    return out


def main_text(page: str | None) -> str:
    blocks = parse(page or "")
    if not blocks and page and "<form" in page.lower():
        blocks = [b for b in parse(page, forms=False)]
        if not any(len(b.text) > LONG and _stop_density(b.text) >= STOP_HIGH for b in blocks):
            blocks = []
    return " ".join(b.text for b, keep in zip(blocks, classify(blocks), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "html"):
                texts = [main_text(x) for x in b.column("html").to_pylist()]
                yield pa.record_batch(
                    [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
