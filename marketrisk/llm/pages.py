"""Visible text of HTML pages, laid out as a reader sees it.

A builder keeps the stack of open elements, closes what the next tag implies to be closed and opens what it implies to
be open (rows and bodies of tables, lists' items).  What is visible goes into flows of lines: blocks start lines of their
own and keep their spacing, list items get their bullet or number and hang below it, preformatted text keeps its lines,
and cells of tables are padded to aligned columns.  In a row with a long line, as layout tables have, the cells follow
one another as blocks.  Indents grow up to a limit.  Nothing visible is left out.

Hidden are: the head, scripts, styles, templates, comments and embedded objects; elements with ``hidden``, a hidden
input, a closed dialog; elements whose own style or class or id (by simple rules of the page's style elements) says
``display:none``; and, until shown again further down, ``visibility:hidden``.  The head ends at the first tag or text
that cannot stand in it.  Text of drawings and formulas is shown, their descriptions are not.

All style elements of a page are read first, as they apply wherever they stand.  A rule hides only if its selector is one
class, one id or ``[hidden]`` and it surely applies on a screen, and only elements for which no rule of more weight
(importance, specificity, order) may show them: a rule that shows counts if the last part of its selector fits, whatever
stands before it and under whatever condition, except in print.

Defined cases: a null page is null, an empty page or one without visible text is the empty string; broken markup closes
at the end of the page, a declaration of any kind is skipped up to the next ``>``; no markup raises, and time is in
proportion to the page; repeated rows and other columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head title script style template noscript iframe object canvas audio video datalist desc metadata clippath mask "
    "annotation annotation-xml".split()
)
#: Start tags that do not end the head.
IN_HEAD = frozenset("html head title script style template noscript base basefont bgsound link meta noframes".split())
#: Drawn only where a ``use`` element asks for them.
REUSED = frozenset("defs symbol".split())
FOREIGN = frozenset("svg math".split())
#: Parts of drawings and formulas that hold HTML, and the start tags that end a drawing or formula elsewhere.
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements whose style elements do not apply.
INERT = frozenset("noscript template iframe noframes".split())
#: Blocks and the blank lines they keep above and below.
BLOCKS = dict.fromkeys(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend "
    "li main menu nav option optgroup search section select summary tbody td tfoot th thead tr".split(),
    0,
) | dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul caption".split(), 1)
#: A start tag in the first set closes an open element of the second, up to a boundary of the third.
IMPLIED_END = (
    ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"option"}, {"option"}, {"select"}),
    ({"optgroup"}, {"option", "optgroup"}, {"select"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    ({"tr"}, {"td", "th", "tr"}, {"table"}),
    ({"tbody", "thead", "tfoot"}, {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    ({"body"}, {"head"}, set()),
)
CLOSES_P = frozenset(t for t in BLOCKS if t not in ("option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "select"))
SCOPE = frozenset("table td th caption".split())
LONGEST_CELL = 80
LONGEST_INDENT = 64

_SPACE = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"<style\b", re.I)
_USE = re.compile(r"<(?:\w+:)?use\b", re.I)
_CSS_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_CSS_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|url\([^)\"']*\)", re.S | re.I)
_CSS_MARK = re.compile(r"[{};]")
_SIMPLE = re.compile(r"[.#][\w-]+|\[hidden\]")
_COMMA = re.compile(r",(?![^(]*\))")
_BRACKETS = re.compile(r"(?<!\\)\[[^\]]*\]|\([^()]*\)")
_COMBINATOR = re.compile(r"[\s>+~]+")
_PSEUDO_ELEMENT = re.compile(r"(?<!\\):(?::|(?:before|after|first-line|first-letter)\b)", re.I)
_PSEUDO_CLASS = re.compile(r"(?<!\\):[\w-]+")
_NAME = re.compile(r"([.#]?)((?:\\.|[\w-])+)")
_HEX_ESCAPE = re.compile(r"\\[0-9a-fA-F]")
_WEIGHTS = (re.compile(r"(?<!\\)#"), re.compile(r"(?<!\\)[.\[:]"), re.compile(r"(?:^|[\s>+~(,])[a-zA-Z]"))
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([^;}]*)", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(\w+)", re.I)


class Flow:
    """Lines of text; blank lines between blocks are at most what the larger of two neighbours asks for."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indents: list[int] = []
        self.indent = ""
        self.marker = ""

    def deeper(self, width: int) -> None:
        """Further lines stand ``width`` columns to the right, up to the limit."""
        self.indents.append(width if len(self.indent) + width <= LONGEST_INDENT else 0)
        self.indent += " " * self.indents[-1]

    def back(self) -> None:
        self.indent = self.indent[: len(self.indent) - self.indents.pop()]

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[:1] == " " and (not self.now or self.now[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.now.append(text)

    def exact(self, text: str) -> None:
        first, *others = text.split("\n")
        if first:
            self.now.append(first)
        for line in others:
            self.end_line(strip=False, keep=True)
            if line:
                self.now.append(line)

    def end_line(self, strip: bool = True, keep: bool = False) -> None:
        text = "".join(self.now)
        text = text.rstrip(" ") if strip else text
        self.now = []
        if not text.strip() and not keep:
            return
        self.put(text)

    def put(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead = self.indent
        if self.marker:
            lead = lead[: len(lead) - self.indents[-1]] + self.marker
            self.marker = ""
        self.lines.append((lead + text).rstrip(" ") if not text.strip() else lead + text)

    def block(self, margin: int) -> None:
        self.end_line()
        self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def display_of(declarations: str) -> tuple[bool, bool] | None:
    """(important, shown) of the display declaration that counts; None without any."""
    counts = None
    for value in _DISPLAY.findall(declarations):
        value, _, flag = value.lower().partition("!")
        important = flag.strip() == "important"
        if value.strip() and (counts is None or important >= counts[0]):
            counts = (important, value.strip() != "none")
    return counts


def _applies(media: str) -> int:
    """Whether a list of media is that of a screen: 2 surely, 1 perhaps, 0 never."""
    kinds = [" ".join(m.lower().split()).removeprefix("only ") for m in media.split(",")]
    if any(k in ("", "all", "screen") for k in kinds):
        return 2
    return 0 if all(k.split(" ")[0] in ("print", "speech") for k in kinds) else 1


def css_rules(css: str, applies: int = 2) -> Iterator[tuple[str, str, int]]:
    """(selectors, declarations, applies) of all rules, those in at-rules and nested ones included."""
    css = _CSS_STRING.sub('""', _CSS_NOISE.sub(" ", css))
    blocks: list[tuple[str, list[str], int]] = []
    at = 0
    for mark in [*_CSS_MARK.finditer(css), None]:
        piece = css[at : mark.start() if mark else len(css)].strip()
        at = mark.end() if mark else at
        outer, _, state = blocks[-1] if blocks else ("", [], applies)
        if mark and mark[0] == "{":
            if piece.startswith("@"):
                name, _, condition = piece.partition(" ") if " " in piece else piece.partition("(")
                own = _applies(condition) if name.lower() == "@media" else 1
                blocks.append((outer, [], min(state, own)))
            else:
                nested = piece.replace("&", "" if "," in outer else outer)
                blocks.append((nested, [], min(state, 1) if outer else state))
            continue
        if blocks:
            blocks[-1][1].append(piece)
        while blocks and (mark is None or mark[0] == "}"):
            selectors, declarations, state = blocks.pop()
            if selectors:
                yield selectors, ";".join(declarations), state
            if mark:
                break


class Lenient(HTMLParser):
    """Declarations of any kind end at the next ``>``; marked sections of drawings and formulas are text."""

    foreign = 0

    def parse_html_declaration(self, i: int) -> int:
        page = self.rawdata
        if page.startswith("<!--", i):
            return super().parse_html_declaration(i)
        if self.foreign and page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            end = len(page) if end < 0 else end
            self.handle_data(page[i + 9 : end])
            return min(end + 3, len(page))
        end = page.find(">", i)
        return len(page) if end < 0 else end + 1


def small_number(text: str, most: int) -> int | None:
    """The number that a text of digits stands for, at most ``most``; None of other texts."""
    if not (text.isascii() and text.isdigit()):
        return None
    text = text.lstrip("0") or "0"
    return most if len(text) > 9 else min(int(text), most)


class Sheet(Lenient):
    """The display rules of a page's style elements."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.hides: dict[str, tuple] = {}  # weight of the strongest rule by class, id or [hidden]
        self.shows: dict[frozenset[str], tuple] = {}  # weight of the strongest rule by the names an element must have
        self.by_name: dict[str, list[frozenset[str]]] | None = None
        self.inert: dict[str, int] = dict.fromkeys(INERT, 0)
        self.applies = 0
        self.css: list[str] | None = None
        self.rules = 0
        if _STYLE.search(page):
            self.feed(page)
            self.close()
            self.handle_endtag("style")

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in self.inert:
            self.inert[tag] = self.inert[tag] + 1 if tag == "template" else 1
        elif tag == "style" and not any(self.inert.values()):
            a = {k: v or "" for k, v in attributes}
            if a.get("type", "").strip().lower() in ("", "text/css"):
                self.css, self.applies = [], _applies(a.get("media", ""))

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        if tag != "style":
            self.handle_starttag(tag, attributes)

    def handle_data(self, data: str) -> None:
        if self.css is not None:
            self.css.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inert:
            self.inert[tag] = max(0, self.inert[tag] - 1)
        elif tag == "style" and self.css is not None:
            for selectors, declarations, applies in css_rules("".join(self.css), self.applies):
                if applies and (found := display_of(declarations)):
                    for selector in _COMMA.split(selectors):
                        self.add(selector.strip(), *found, applies)
            self.css = None

    def add(self, selector: str, important: bool, shown: bool, applies: int) -> None:
        self.rules += 1
        weight = (important, 0, *(len(w.findall(selector)) for w in _WEIGHTS), self.rules)
        if not shown:
            if applies == 2 and _SIMPLE.fullmatch(selector):
                self.hides[selector] = max(weight, self.hides.get(selector, weight))
            return
        bare = selector
        while bare != (bare := _BRACKETS.sub("", bare)):
            pass
        last = _COMBINATOR.split(bare)[-1]
        if not _PSEUDO_ELEMENT.search(last):
            names = _NAME.findall(_PSEUDO_CLASS.sub("", last))
            needed = {(k + n.replace("\\", "")) if k else n.lower() for k, n in names if not _HEX_ESCAPE.search(n)}
            self.shows[frozenset(needed)] = max(weight, self.shows.get(frozenset(needed), weight))

    def shown_over(self, strongest: tuple, names: set[str]) -> bool:
        """Whether a rule of more weight shows an element of these names."""
        if self.by_name is None:
            often = Counter(n for needed in self.shows for n in needed)
            self.by_name = {}
            for needed in self.shows:  # found by the rarest of its names
                rarest = min(needed, key=lambda n: (often[n], n), default="")
                self.by_name.setdefault(rarest, []).append(needed)
        candidates = (needed for n in ("", *names) for needed in self.by_name.get(n, ()))
        return any(needed <= names and self.shows[needed] > strongest for needed in candidates)

    def hidden(self, tag: str, a: dict[str, str]) -> bool:
        """Whether the cascade says ``display:none``, the ``hidden`` attribute and closed dialogs being its weakest rules."""
        own = display_of(a["style"]) if "style" in a else None
        names = {f".{c}" for c in a.get("class", "").split()} | {f"#{a.get('id', '')}", tag}
        found = []
        if "hidden" in a:
            names.add("[hidden]")
        if "hidden" in a or (tag == "dialog" and "open" not in a):
            found.append((False, -1))
        if own and not own[1]:
            found.append((own[0], 1))
        found += [self.hides[n] for n in names if n in self.hides]
        if not found:
            return False
        strongest = max(found)
        if own and own[1] and (own[0], 1) > strongest:
            return False
        return not self.shown_over(strongest, names)


class Page(Lenient):
    """Events of one page; ``text`` gives the result."""

    def __init__(self, page: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.sheet = Sheet(page)
        self.hidden_tags = HIDDEN if _USE.search(page) else HIDDEN | REUSED
        self.open: list[tuple[str, bool, bool]] = []  # tag, displayed, visible
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.flows = [Flow()]
        self.lists: list[list] = []  # [numbered, next number]
        self.tables: list[list[list[tuple[list[str], int]]]] = []
        self.pre = 0

    # open elements

    def innermost(self, tags: Iterable[str], below: int | None = None) -> int:
        """Place of the innermost open element of these tags (under the place ``below``); -1 without any."""
        found = -1
        for tag in tags:
            places = self.places.get(tag)
            if places and below is not None and places[-1] >= below:
                places = places[:-1] if len(places) < 2 else places[-2:-1]
            if places:
                found = max(found, places[-1])
        return found

    def has(self, tags: Iterable[str], boundary: Iterable[str] = ()) -> bool:
        place = self.innermost(tags)
        return place >= 0 and place >= self.innermost(boundary)

    def close_through(self, tags: set[str]) -> None:
        while self.open:
            tag = self.open[-1][0]
            self.leave()
            if tag in tags:
                return

    def end_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.leave()

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag == "head" and len(self.open) > len(self.places.get("html", ())):
            return
        if tag not in IN_HEAD:
            self.end_head()
        if self.foreign and tag in ENDS_FOREIGN:
            while self.has(FOREIGN, HTML_INSIDE):
                self.close_through(FOREIGN)
        for starts, ended, boundary in IMPLIED_END:
            if tag in starts:
                while self.has(ended, boundary):
                    self.close_through(ended)
        if tag in CLOSES_P and self.has({"p"}, SCOPE):
            self.close_through({"p"})
        if tag in ("td", "th") and self.has({"table"}) and not self.has({"tr"}, {"table"}):
            self.enter("tr", {})
        self.enter(tag, {k: v or "" for k, v in attributes})
        if tag in VOID:
            self.leave()

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attributes)
        # only drawings, formulas and what is in them close themselves
        if tag in FOREIGN or (self.foreign and len(self.open) > depth and self.drawn()):
            self.leave()

    def drawn(self) -> bool:
        """Whether the innermost element belongs to a drawing or formula, not to HTML inside one."""
        top = len(self.open) - 1
        return self.innermost(FOREIGN, top) > self.innermost(HTML_INSIDE, top)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.has({"p"}, SCOPE):
            self.handle_starttag("p", [])
        boundary = SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else frozenset({"table"} - {tag})
        if tag not in VOID and self.has({tag}, boundary):
            self.close_through({tag})

    # visibility

    def enter(self, tag: str, a: dict[str, str]) -> None:
        displayed, visible = self.open[-1][1:] if self.open else (True, True)
        if (
            tag in self.hidden_tags
            or (tag == "input" and a.get("type", "").lower() == "hidden")
            or self.sheet.hidden(tag, a)
        ):
            displayed = False
        if found := _VISIBILITY.search(a.get("style", "")):
            visible = found[1].lower() not in ("hidden", "collapse")
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, displayed, visible))
        self.foreign += tag in FOREIGN
        if displayed:
            self.begin(tag, a)

    def leave(self) -> None:
        tag, displayed, _ = self.open.pop()
        self.places[tag].pop()
        self.foreign -= tag in FOREIGN
        if displayed:
            self.end(tag)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        tag, displayed, visible = self.open[-1] if self.open else ("", True, True)
        if displayed and visible and not (tag in ("table", "tr", "tbody", "thead", "tfoot") and not data.strip()):
            (self.flows[-1].exact if self.pre else self.flows[-1].inline)(data)

    # layout

    def begin(self, tag: str, a: dict[str, str]) -> None:
        flow = self.flows[-1]
        if tag == "br":
            flow.end_line(keep=True)
            return
        if tag == "wbr":
            return
        if tag == "text" and self.foreign and not self.pre:
            flow.inline(" ")
        if tag in BLOCKS:
            flow.block(0 if self.lists and tag in ("ul", "ol") else BLOCKS[tag])
        if tag == "pre":
            self.pre += 1
        elif tag in ("ul", "ol", "menu", "dir"):
            start = small_number(a.get("start", "1"), 10**9)
            self.lists.append([tag == "ol", 1 if start is None else start])
        elif tag == "li":
            numbered = self.lists[-1] if self.lists else [False, 1]
            marker = f"{numbered[1]}. " if numbered[0] else "- "
            numbered[1] += 1
            flow.deeper(len(marker))
            flow.marker = marker
        elif tag in ("dd", "blockquote"):
            flow.deeper(2)
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            self.flows.append(Flow())
            self.tables[-1][-1:] = self.tables[-1][-1:] or [[]]
            self.tables[-1][-1].append(([], small_number(a.get("colspan", "1"), 1000) or 1))

    def end(self, tag: str) -> None:
        if tag == "li":
            flow = self.flows[-1]
            flow.block(0)
            flow.marker = ""
            flow.back()
            return
        if tag in ("td", "th") and self.tables and len(self.flows) > 1:
            lines = self.flows.pop().done()
            self.tables[-1][-1][-1][0].extend(lines)
            return
        if tag == "text" and self.foreign and not self.pre:
            self.flows[-1].inline(" ")
        if tag == "table" and self.tables:
            for line in aligned(self.tables.pop()):
                self.flows[-1].put(line)
        if tag in BLOCKS:
            self.flows[-1].block(0 if len(self.lists) > 1 and tag in ("ul", "ol") else BLOCKS[tag])
        if tag == "pre":
            self.pre -= 1
        elif tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag in ("dd", "blockquote"):
            self.flows[-1].back()

    def text(self) -> str:
        self.close()
        while self.open:
            self.leave()
        return "\n".join(self.flows[0].done())


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table: columns padded to their widest cell; a row with a long line is written cell after cell."""
    rows = [r for r in rows if any(lines for lines, _ in r)]
    long = [any(len(line) > LONGEST_CELL for lines, _ in r for line in lines) for r in rows]
    widths: list[int] = []
    for row, apart in zip(rows, long, strict=True):
        at = 0
        for lines, span in [] if apart else row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max([widths[at], *map(len, lines)])
            at += span
    out = []
    for row, apart in zip(rows, long, strict=True):
        if apart:
            out += [line for lines, _ in row for line in lines]
            continue
        for k in range(max(len(lines) for lines, _ in row)):
            line, at = "", 0
            for lines, span in row:
                width = sum(widths[at : at + span]) + 2 * (span - 1)
                line += (lines[k] if k < len(lines) else "").ljust(width) + "  "
                at += span
            out.append(line.rstrip(" "))
    return out


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    builder = Page(page)
    builder.feed(page)
    return builder.text()


@F.pandas_udf(T.StringType())
def _visible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(visible_text)


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Every row of ``pages`` with its visible text as a further (or replaced) column ``text``."""
    return pages.withColumn(text, _visible(F.col(f"`{html}`")))
