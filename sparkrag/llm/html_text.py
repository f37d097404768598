"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags.  Pass one decides a block by where it stands (menus,
footers, forms, comments and the like are out), by its link density, and by length and stop-word
density; short blocks and doubtful ones stay open.  Stop words say nothing about text in other scripts,
nor on a page whose long blocks mostly hold few; there length and link density decide.  Pass two lets
an open block inherit the label of the nearest decided neighbours, those of its own section first.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_column

COLUMN = "main_text"
LINKED = 0.5  # share of link characters that makes a block navigation
MENU = 3  # link blocks in a row
SHORT = 60  # characters below which words say little
DENSE = 0.12  # stop-word density of running text

STOP_WORDS = frozenset(
    # English
    "a about after all also an and are as at be been but by can for from had has have he her his "
    "i if in into is it its more no not of on one or out she so than that the their there they "
    "this to up was we were what when which who will with would you "
    # German
    "aber als am auch auf aus bei bis das dass dem den der des die ein eine einem einen einer er "
    "es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und "
    "uns von vor war was wie wird zu zum zur "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne "
    "nous on ou par pas plus pour qu que qui sa se ses si son sont sur un une vous "
    # Spanish
    "al como con cuando del desde donde el ella ellos entre era es esta este fue ha hay la las lo "
    "los más me muy no o para pero por que se ser si sin sobre son su sus también un una uno y ya"
    .split())

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Their end tag ends a region; all other block tags only part blocks.
_REGION = frozenset(
    "article aside blockquote button details dialog div dl fieldset figure footer form header "
    "main menu nav ol search section select table ul li p head span svg".split())
#: Of these, what stands inside a block; only those that are out are followed.
_INLINE = frozenset(("span", "svg"))
_OUT = frozenset("nav footer aside form menu dialog search button select fieldset head".split())
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CORE = frozenset(("article", "main"))

_TAG = r"[a-zA-Z][a-zA-Z0-9:-]*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title)\b"
    r"(?P<own>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>{_TAG})(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|</?(?P<odd>{_TAG})[^>]*(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"(?:class|id|role|data-component)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CUE = re.compile(
    r"(?:^|[\s\"'_-])(?:(?P<soft>header|masthead|topbar|banner)|(?P<reader>comments?|comment-?list|"
    r"disqus\w*|repl(?:y|ies)|respond)|(?P<other>ads?|advert\w*|adsense|sponsor\w*|promo\w*|"
    r"side-?bar\w*|menus?|nav|navbar|navigation|breadcrumbs?|footer|cookies?|cookie\w*|notices?|"
    r"consent|gdpr|popup|modal|alert|shar(?:e|ing)|social|"
    r"related(?![_-](?!posts?|articles?|links?|stories|content|items?|news|reading|box|list|block|"
    r"section|widget|topics?|pages?|products?|videos?))|recommend\w*|newsletter|"
    r"subscribe|subscription|signup|login|widgets?|paginat\w*|pager|skip\w*|toolbar|"
    r"complementary|contentinfo|search))(?=$|[\s\"'_-]|\d)", re.I)


#: Names that put an inline element out; others may stand around words of a sentence.
_ADVERT = re.compile(r"(?:^|[\s\"'_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*)"
                     r"(?=$|[\s\"'_-]|\d)", re.I)


class Block:
    __slots__ = ("text", "linked", "out", "core", "section", "label")

    def __init__(self, text: str, linked: int, out: bool, core: bool, section: int):
        self.text, self.linked = text, linked
        self.out, self.core, self.section = out, core, section
        self.label: bool | None = None


def _cue(rest: str, name: str, core: bool) -> str:
    """Why the names of an element put it out, if they do."""
    said = " ".join(_NAMES.findall(rest))
    if name in _INLINE and not _ADVERT.search(said):
        return ""
    for found in _CUE.finditer(said):
        kind = found.lastgroup
        if name in _CORE and kind != "reader" or kind == "soft" and core:
            continue
        return kind
    return ""


class _Open:
    """The open elements, with counts and places kept so that a tag costs no walk over them."""

    def __init__(self) -> None:
        self.stack: list[list] = []  # name, why it is out ("" if not), is the core, section
        self.places: dict[str, list[int]] = {}
        self.out = self.hidden = self.core = 0
        self.lifted: list[list] = []  # elements that are out until a main part begins

    def push(self, name: str, why: str, core: bool, section: int) -> None:
        entry = [name, why, core, section]
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(entry)
        self._count(entry, 1)
        if why and why not in ("reader", "aside"):
            self.lifted.append(entry)

    def _count(self, entry: list, by: int) -> None:
        if entry[1]:
            if entry[0] in _INLINE:
                self.hidden += by
            else:
                self.out += by
        self.core += by * entry[2]

    def pop(self) -> list:
        entry = self.stack.pop()
        if entry[0]:
            self.places[entry[0]].pop()
        self._count(entry, -1)
        if self.lifted and self.lifted[-1] is entry:
            self.lifted.pop()
        return entry

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def section(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def ends_out(self, name: str) -> bool:
        """Whether closing the name ends an element that is out."""
        return self.out > 0 and self.has(name) and any(
            e[1] and e[0] not in _INLINE for e in self.stack[self.places[name][-1]:])

    def close(self, name: str) -> None:
        """Close the innermost element of the name and what is open in it."""
        if self.has(name):
            at = self.places[name][-1]
            while len(self.stack) > at:
                self.pop()

    def begin_core(self) -> None:
        """A page names its main part: a menu or wrapper around it was left open or means more."""
        for entry in self.lifted:
            self._count(entry, -1)
            entry[1] = ""
            self._count(entry, 1)
        self.lifted.clear()

    def lose(self, name: str) -> None:
        """Elements of the name were left open and are over; what is in them stays open."""
        for at in self.places.get(name, ()):
            entry = self.stack[at]
            self._count(entry, -1)
            entry[0], entry[1] = "", ""
            self._count(entry, 1)
        self.places[name] = []


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order; white space folded, character references decoded."""
    out: list[Block] = []
    opened = _Open()
    parts: list[tuple[str, bool]] = []
    links, sections, at = 0, 0, 0

    def flush() -> None:
        if not parts:
            return
        text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(t if k else " " for t, k in parts))
                                  .split()))
            out.append(Block(text, linked, opened.out > 0, opened.core > 0, opened.section()))
        parts.clear()

    while token := _TOKEN.search(page, at):
        if token.start() > at and not opened.hidden:
            parts.append((page[at:token.start()], links > 0))
        at = token.end()
        if token["raw"] and token["own"].endswith("/") and opened.has("svg"):
            at = token.end("own") + 1  # in a graphic such an element is empty
        name = (token["name"] or token["odd"] or "").lower()
        if not name:
            continue
        closing = page.startswith("</", token.start())
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            parts.append((" ", False))
        if name in _BLOCK or name in ("button", "select", "head"):
            flush()
            while opened.hidden and opened.top() in _INLINE:
                opened.pop()  # an inline element that was left open ends with its block
        if name == "body" and opened.has("head"):
            opened.lose("head")
        if name not in _REGION or name in _VOID:
            continue
        if closing:
            if opened.ends_out(name):
                flush()
            opened.close(name)
            continue
        rest = token["rest"] or ""
        if rest.endswith("/") and name not in _BLOCK:
            continue
        while opened.top() == "p" and name in _BLOCK or opened.top() == "li" == name:
            opened.pop()
        core = opened.core > 0
        if name in _CORE:
            opened.begin_core()
        why = name if name in _OUT or name == "svg" or name == "header" and not core else _cue(
            rest, name, core)
        if why == "other" and re.search("related|recommend", rest, re.I):
            why = "aside"
        if why and name not in _INLINE:
            flush()
        if name in _CORE or name in _OUT or name in ("section", "header"):
            sections += 1
            section = sections
        else:
            section = opened.section()
        if name not in _INLINE or why:
            opened.push(name, why, name in _CORE and not why, section)
    if at < len(page) and not opened.hidden:
        parts.append((page[at:], links > 0))
    flush()
    return out


def _size(text: str) -> int:
    """Characters; one that stands for a syllable or a word counts twice."""
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def _other_script(text: str) -> bool:
    """Whether most letters are of a script that no stop word is written in."""
    return not text.isascii() and 2 * len(_LATIN.findall(text)) < sum(map(str.isalpha, text))


def _decide(block: Block) -> bool | None:
    """Pass one: main text, not main text, or open."""
    text = block.text
    size = len(text)
    if block.out or block.linked >= LINKED * size and not block.core:
        return False
    if block.linked >= LINKED * size:
        return None  # in the main part only a row of such blocks is a menu
    words = text.lower().split()
    density = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
    if not block.core and "©" in text and size < 4 * SHORT and (
            size < SHORT or density < DENSE):
        return False
    if _size(text) < SHORT:
        return None
    return True if density >= DENSE or _other_script(text) else None


def _lengths(blocks: list[Block]) -> None:
    """On a page without a main part of its own, and with less running text than other long blocks,
    stop words don't tell what is text: all long blocks are."""
    if any(b.core for b in blocks):
        return
    long = [b for b in blocks if b.label is not False and _size(b.text) >= SHORT]
    if 2 * sum(len(b.text) for b in long if b.label) < sum(len(b.text) for b in long):
        for b in long:
            b.label = True


def _menus(blocks: list[Block]) -> None:
    """Rows of three and more link blocks at an edge of the main part are not main text; between
    running text they are part of it."""
    told = [i for i, b in enumerate(blocks) if b.core and b.label]
    run: list[Block] = []
    for i, b in enumerate([*blocks, Block("", 0, True, False, -1)]):
        if b.core and not b.out and b.linked >= LINKED * len(b.text):
            run.append(b)
            continue
        if len(run) >= MENU and not (told and told[0] < i - len(run) and i <= told[-1]):
            for x in run:
                x.label = False
        run = []


def _inherit(blocks: list[Block]) -> None:
    """Pass two: open blocks take the label of the nearest decided blocks.

    A page without any running text keeps all that is open.
    """
    if not any(b.label for b in blocks):
        for b in blocks:
            b.label = b.label is None
        return
    decided = [b.label for b in blocks]
    cored = any(b.core for b in blocks)
    n = len(blocks)
    for same in (True, False):
        before: list[tuple[int, bool] | None] = [None] * n
        after: list[tuple[int, bool] | None] = [None] * n
        for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
            last: dict[int, tuple[int, bool]] = {}
            for i in order:
                key = blocks[i].section if same else 0
                # Inside a section only its running text and what isn't its menu says anything.
                if decided[i] is not None and not (same and (blocks[i].out or blocks[i].core
                                                             and not decided[i])):
                    last[key] = i, decided[i]
                near[i] = last.get(key)
        for i, b in enumerate(blocks):
            if b.label is not None:
                continue
            near = [x for x in (before[i], after[i]) if x]
            if not near:
                if same and b.core:
                    b.label = True  # nothing decided in the page's own main part
                continue
            if len(near) == 2 and near[0][1] != near[1][1]:
                closer = min(near, key=lambda x: (abs(x[0] - i), not x[1]))
                b.label = closer[1] or b.core or not cored and _size(b.text) >= SHORT
            else:
                b.label = near[0][1]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    for b in blocks:
        b.label = _decide(b)
    _lengths(blocks)
    _menus(blocks)
    _inherit(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def _extract_batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = [main_text(t) for t in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                         names=[*batch.schema.names, COLUMN])


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages(html, ...)`` and ``main_text``.

    Blocks are joined by line feeds in page order, white space inside a block is one space.  Null, empty
    and textless pages give an empty string; open or crossed tags, and pages that break off, are
    read as far as they go.  A column named ``main_text`` in the input is replaced.
    """
    return add_column(pages, COLUMN, T.StringType(), _extract_batches)
