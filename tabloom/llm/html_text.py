"""Layout-aware text of HTML pages.

Pages are read once from left to right. A stack of open elements with implied start and end tags says what is visible
and where its text goes: to the lines of the page, of a table cell, or of an option. No step looks back over the page
or through the stack, so time is linear in the page, and nesting has no limit.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import slices

# Element names of the HTML standard, by how they are treated.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes object datalist audio video canvas title progress meter rp".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table caption"
    " ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
SPECIAL = BLOCK | TABLE_PARTS | frozenset("button head iframe marquee object select template textarea".split())
#: Blocks set off by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp listing plaintext table figure".split())
LISTS = frozenset("ul ol menu dir".split())
#: End tags and implied ends do not reach beyond these; those of paragraphs and list items have further ones.
SCOPE = frozenset("table td th caption marquee object template".split())
PARAGRAPH_SCOPE = SCOPE | {"button"}
#: Start tags that end an open element of these names, unless one of the others was opened since.
IMPLIED_END = {
    "li": (frozenset({"li"}), SCOPE | LISTS),
    "dt": (frozenset({"dt", "dd"}), SCOPE | {"dl"}),
    "dd": (frozenset({"dt", "dd"}), SCOPE | {"dl"}),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"optgroup"}), frozenset({"select"})),
    "button": (frozenset({"button"}), SCOPE),
    "table": (frozenset({"table"}), frozenset("td th caption template".split())),
}
HEAD_ONLY = frozenset("meta link base title style script noscript template".split())
#: Elements whose end also ends formatting begun inside of them.
MARKERS = frozenset("td th caption marquee object template".split())
#: Start tags that end an open svg or math, and what is not drawn there.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre"
    " ruby s small span strong strike sub sup table tt u ul var".split()
)
UNDRAWN = frozenset("title desc defs metadata symbol style script annotation annotation-xml clippath mask pattern marker".split())
#: Kinds of input that show no text, or show their description.
SILENT_INPUTS = frozenset("hidden checkbox radio password file range color".split())

_W = r" \t\n\f\r"
_ATTRIBUTE = rf"[^{_W}/>][^{_W}/>=]*+(?:[{_W}]*+=[{_W}]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^{_W}>]*+))?+"
#: A whole tag. Repeats are possessive: it ends at its first ``>`` outside of quoted values, or not at all.
_TAG = re.compile(rf"<(/?)([A-Za-z][^{_W}/>]*+)((?:[{_W}]++|/(?!>)|{_ATTRIBUTE})*+)(/?)>")
_ATTR = re.compile(rf"([^{_W}/>][^{_W}/>=]*+)(?:[{_W}]*+=[{_W}]*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^{_W}>]*+)))?+")
_COMMENT_END = re.compile(r"--!?>")
_SPACES = re.compile(rf"[{_W}]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[{_W}/>])", re.I) for name in RAW}
_HTML = re.compile(rf"<html(?=[{_W}/>])", re.I)
_INTEGER = re.compile(rf"[{_W}]*([+-]?[0-9]{{1,9}})")

#: List levels that are indented, and nested tables that are laid out in columns; text of deeper ones stays, unaligned.
INDENTED, ALIGNED = 16, 8


class Writer:
    """Lines of text with collapsed blanks; breaks and empty lines are asked for and merged."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.blank = False
        self.owed = self.indent = 0
        self.levels: list[tuple[str, int, bool]] = []
        self.marks: list[str] = []

    def put(self, text: str) -> None:
        body = _SPACES.sub(" ", text).strip(" ")
        if text and self.parts and text[0] in " \t\n\f\r":
            self.space = True
        if body:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(body)
            self.space = text[-1] in " \t\n\f\r"

    def put_exact(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if self.space and self.parts and first:
            self.parts.append(" ")
        self.space = False
        self.parts.append(first)
        for x in rest:
            self.line(forced=True)
            self.parts.append(x)

    def line(self, empty: bool = False, forced: bool = False) -> None:
        text = "".join(self.parts).rstrip(" \t\f")
        self.parts = []
        self.space = False
        if text:
            self.emit(text)
        elif forced:
            self.owed += 1
        if empty and not self.marks:
            self.blank = True

    def emit(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * max(self.owed, int(self.blank))
        self.lines.append((" " * self.indent + "".join(self.marks) + text).rstrip(" "))
        for mark, width, _ in self.levels[len(self.levels) - len(self.marks) :]:
            self.indent += min(width, len(mark))
        self.marks = []
        self.blank, self.owed = False, 0

    def block(self, lines: Iterable[str]) -> None:
        self.line()
        for x in lines:
            self.emit(x)

    def open_item(self, mark: str) -> None:
        self.line()
        self.levels.append((mark, len(mark) if len(self.levels) < INDENTED else 0, self.blank))
        self.marks.append(mark)

    def close_item(self) -> None:
        self.line()
        mark, width, blank = self.levels.pop()
        if self.marks:
            self.marks.pop()
            self.blank = blank
        else:
            self.indent -= min(width, len(mark))
            self.blank = False
        self.owed = 0

    def done(self) -> list[str]:
        self.line()
        return self.lines


class Table:
    """Cells of a table by row and column, and what stands outside of cells."""

    def __init__(self) -> None:
        self.loose, self.caption = Writer(), Writer()
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.column = 0
        #: Columns taken by cells of earlier rows: first, end, and the row from which on they are free again.
        self.taken: list[tuple[int, int, int]] = []
        self.reaching: list[tuple[int, int, int]] = []

    def open_row(self) -> None:
        self.close_row()
        self.rows.append([])
        self.column = 0
        self.at = 0

    def close_row(self) -> None:
        if self.reaching or any(x[2] <= len(self.rows) for x in self.taken):
            merged: list[tuple[int, int, int]] = []
            for x in sorted([y for y in self.taken if y[2] > len(self.rows)] + self.reaching):
                if merged and merged[-1][1] == x[0] and merged[-1][2] == x[2]:
                    merged[-1] = (merged[-1][0], x[1], x[2])
                else:
                    merged.append(x)
            self.taken, self.reaching = merged, []

    def place(self, across: int, down: int) -> int:
        while self.at < len(self.taken) and self.taken[self.at][0] <= self.column:
            self.column = max(self.column, self.taken[self.at][1])
            self.at += 1
        column = self.column
        self.column += across
        if down != 1:
            self.reaching.append((column, column + across, len(self.rows) - 1 + down if down else 1 << 30))
        return column

    def layout(self, budget: list[int]) -> list[str]:
        columns = sorted({c for row in self.rows for c, _, lines in row if lines})
        place = {c: i for i, c in enumerate(columns)}
        widths = [0] * len(columns)
        wide = []
        for row in self.rows:
            for c, across, lines in row:
                if lines:
                    need, first, end = max(map(len, lines)), place[c], bisect_left(columns, c + across)
                    if end - first == 1:
                        widths[first] = max(widths[first], need)
                    else:
                        wide.append((end - first, first, end, need))
        for _, first, end, need in sorted(wide):
            widths[end - 1] += max(0, need - sum(widths[first:end]) - 2 * (end - first - 1))
        offsets = [0]
        for w in widths:
            offsets.append(offsets[-1] + w + 2)
        # Padding is paid from an allowance of the page; beyond it cells are parted by two blanks.
        price = sum(offsets[place[c]] * len(lines) for row in self.rows for c, _, lines in row if lines)
        aligned = price <= budget[0]
        budget[0] -= price if aligned else 0
        out = []
        for row in self.rows:
            by_line: dict[int, list[tuple[int, str]]] = defaultdict(list)
            for c, _, lines in row:
                for k, x in enumerate(lines):
                    by_line[k].append((place[c], x))
            for k in sorted(by_line):
                parts, length = [], 0
                for i, x in by_line[k]:
                    gap = max(offsets[i] - length, 2 if length else 0) if aligned else 2 if length else 0
                    parts += [" " * gap, x]
                    length += gap + len(x)
                out.append("".join(parts).rstrip(" "))
        return [*self.loose.done(), *self.caption.done(), *out]


@dataclass(slots=True)
class Open:
    """An open element: where its text goes, whether it is displayed and visible, and what its end does."""

    name: str
    out: Writer
    shown: bool = True
    seen: bool = True
    exact: bool = False
    items: dict | None = None
    table: Table | None = None
    tables: int = 0
    choices: list | None = None
    summary: bool = False
    end: Callable[[], None] | None = None


@dataclass
class Formatting:
    """Formatting elements that are still on, since the last marker: by name, whether each is displayed."""

    names: dict[str, list[bool]] = field(default_factory=lambda: defaultdict(list))
    hidden: int = 0


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTR.finditer(text):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def page_attributes(page: str) -> dict[str, str]:
    """Attributes of the first html tag."""
    found = _HTML.search(page)
    tag = found and _TAG.match(page, found.start())
    return attributes(tag[3]) if tag else {}


def _integer(text: str | None, default: int) -> int:
    found = _INTEGER.match(text or "")
    return int(found[1]) if found else default


def _display(name: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether it sets itself visible (None: like its parent)."""
    if not attrs:
        return name not in HIDDEN and name != "dialog", None
    styles = {}
    for part in attrs.get("style", "").split(";"):
        key, _, value = part.partition(":")
        styles[key.strip().lower()] = value.replace("!important", "").strip().lower()
    shown = name not in HIDDEN and not (name == "dialog" and "open" not in attrs)
    if "hidden" in attrs:
        shown = shown and "display" in styles
    visibility = styles.get("visibility")
    return shown and styles.get("display") != "none", {"hidden": False, "collapse": False, "visible": True}.get(visibility)


class Page:
    """The open elements of a page that is being read, and the lines written so far."""

    def __init__(self, size: int) -> None:
        self.out = Writer()
        self.stack = [Open("html", self.out)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.specials = [0]
        self.formats = [Formatting()]
        self.budget = [16 * size + 100_000]
        self.skip_newline = False

    def nearest(self, names: Iterable[str]) -> int:
        places, found = self.places, -1
        for n in names:
            if n in places and (x := places[n]) and x[-1] > found:
                found = x[-1]
        return found

    def pop_to(self, size: int) -> None:
        while len(self.stack) > max(1, size):
            x = self.stack.pop()
            self.places[x.name].pop()
            if x.name in SPECIAL:
                self.specials.pop()
            if x.name in MARKERS:
                self.formats.pop()
            if x.end:
                x.end()

    def close(self, names: Iterable[str], limits: Iterable[str]) -> bool:
        """End the nearest open element of these names and all in it, unless a limit is nearer."""
        i = self.nearest(names)
        if i > 0 and i > self.nearest(limits):
            self.pop_to(i)
            return True
        return False

    def push(self, x: Open) -> None:
        self.places[x.name].append(len(self.stack))
        if x.name in SPECIAL:
            self.specials.append(len(self.stack))
        if x.name in MARKERS:
            x.shown = x.shown and not self.formats[-1].hidden
            self.formats.append(Formatting())
        self.stack.append(x)

    def end_formatting(self, name: str) -> None:
        """Formatting ends alone if blocks were opened since, else with what is open in it."""
        scope = self.formats[-1]
        if scope.names[name]:
            scope.hidden -= not scope.names[name].pop()
        i = self.nearest({name})
        if i > self.specials[-1]:
            self.pop_to(i)

    @property
    def writing(self) -> bool:
        return self.stack[-1].shown and self.stack[-1].seen and not self.formats[-1].hidden

    def text(self, piece: str, escaped: bool = True) -> None:
        if self.skip_newline:
            self.skip_newline = False
            piece = piece.removeprefix("\r").removeprefix("\n")
        if not piece:
            return
        if self.stack[-1].name == "head" and not piece.isspace():
            self.pop_to(len(self.stack) - 1)
        if self.writing:
            x = self.stack[-1]
            (x.out.put_exact if x.exact else x.out.put)(html.unescape(piece) if escaped else piece)

    def foreign(self) -> int:
        """Place of an open svg or math whose content is not HTML again; -1 if there is none."""
        if not (self.places["svg"] or self.places["math"]):
            return -1
        i = self.nearest(("svg", "math"))
        return i if i > self.nearest(("foreignobject",)) else -1

    def start(self, name: str, given: str, ended: bool) -> None:
        self.skip_newline = False
        attrs = attributes(given) if given else {}
        if (i := self.foreign()) > 0 and name in BREAKOUT:
            self.pop_to(i)
        if name in ("html", "body"):
            shown, seen = _display("", attrs)
            if name == "body":
                self.close({"head"}, ())
            if len(self.stack) == 1:
                self.stack[0].shown &= shown
                self.stack[0].seen = self.stack[0].seen if seen is None else seen
            return
        if self.foreign() > 0 or name in ("svg", "math"):
            if not ended:
                self.open(name, attrs, drawn=name not in UNDRAWN)
            return
        if self.stack[-1].name == "head" and name not in HEAD_ONLY:
            self.pop_to(len(self.stack) - 1)
        if name in TABLE_PARTS:
            if not self.table_part(name):
                return
        elif name in BLOCK and name not in ("legend", "summary"):
            self.close({"p"}, PARAGRAPH_SCOPE)
        if name in IMPLIED_END:
            self.close(*IMPLIED_END[name])
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if name == "a" and self.formats[-1].names["a"]:
            self.end_formatting("a")
        if name in VOID:
            self.single(name, attrs)
        else:
            self.open(name, attrs)

    def table_part(self, name: str) -> bool:
        """Make room for a part of a table: end what is open in it, and imply a row around cells."""
        table = self.nearest({"table"})
        if table < 0 or self.nearest({"template"}) > table:
            self.text(" ")
            return False
        group = max(table, self.nearest(("tbody", "thead", "tfoot")))
        if name == "tr":
            self.pop_to(group + 1)
        elif name in ("td", "th"):
            row = self.nearest({"tr"})
            self.pop_to(max(row, group) + 1)
            if row < table:
                self.open("tr", {})
        else:
            self.pop_to(table + 1)
        return name not in ("col", "colgroup")

    def single(self, name: str, attrs: dict[str, str]) -> None:
        shown, seen = _display(name, attrs)
        x = self.stack[-1]
        if not shown or not x.shown or self.formats[-1].hidden:
            return
        visible = x.seen if seen is None else seen
        if name == "br":
            x.out.line(forced=True)
        elif name == "hr":
            x.out.block(["---"] if visible else [])
        elif name == "img" and visible:
            x.out.put(attrs.get("alt", ""))
        elif name == "input" and visible:
            kind = attrs.get("type", "").strip().lower()
            if kind not in SILENT_INPUTS:
                x.out.put(f" {attrs.get('alt', '') if kind == 'image' else attrs.get('value') or attrs.get('placeholder', '')} ")

    def open(self, name: str, attrs: dict[str, str], drawn: bool = True) -> None:
        above = self.stack[-1]
        shown, seen = _display(name, attrs)
        seen = above.seen if seen is None else seen
        x = Open(
            name, above.out, above.shown, seen, above.exact, above.items, above.table, above.tables, above.choices
        )
        if name in FORMATTING:
            self.push(x)
            self.formats[-1].names[name].append(shown)
            self.formats[-1].hidden += not shown
            return
        displayed = above.shown or (above.summary and name == "summary")
        above.summary = above.summary and name != "summary"
        x.shown = displayed and shown and drawn
        if not x.shown:
            # Nothing of it is written, so it needs no place.
            x.out, x.table, x.items = Writer(), None, None
            self.push(x)
            return
        out = above.out
        if name == "details" and "open" not in attrs:
            x.shown, x.summary = False, True
        if name in ("pre", "listing", "xmp", "plaintext"):
            x.exact = True
            self.skip_newline = name in ("pre", "listing")
        if name in LISTS:
            outer = above.items is None
            start = _integer(attrs.get("start"), 1)
            x.items = {"ordered": name == "ol", "next": start}
            out.line(empty=outer)
            x.end = lambda: out.line(empty=outer)
        elif name == "li":
            mark = ""
            if x.items is not None and seen:
                number = _integer(attrs.get("value"), x.items["next"])
                x.items["next"] = number + 1
                mark = f"{number}. " if x.items["ordered"] else "- "
            out.open_item(mark)
            x.end = out.close_item
        elif name == "table":
            self.open_table(x, out)
        elif name in TABLE_PARTS:
            self.open_part(x, attrs)
        elif name in BLOCK:
            empty = name in SPACED
            out.line(empty=empty)
            x.end = lambda: out.line(empty=empty)
        elif name == "select":
            every = "multiple" in attrs or _integer(attrs.get("size"), 1) > 1
            x.choices, x.out = [], Writer()
            x.end = lambda: self.choose(out, x.choices, every)
        elif name == "option" and x.choices is not None:
            x.out = Writer()
            x.end = lambda: x.choices.append(("selected" in attrs, "disabled" in attrs, attrs.get("label") or " ".join(x.out.done())))
        elif name in ("text", "option"):
            out.put(" ")
            x.end = lambda: out.put(" ")
        self.push(x)

    @staticmethod
    def choose(out: Writer, choices: list[tuple[bool, bool, str]], every: bool) -> None:
        """A list box shows all options; a closed menu its last selected one, else its first that can be selected."""
        if not every:
            chosen = [x for x in choices if x[0]][-1:] or [x for x in choices if not x[1]][:1]
            choices = chosen or choices[:1]
        for x in choices:
            out.put(f" {x[2]} ")

    def open_table(self, x: Open, out: Writer) -> None:
        out.line(empty=True)
        x.tables += 1
        if x.tables > ALIGNED:
            x.table = None
            x.end = lambda: out.line(empty=True)
            return
        x.table = table = Table()
        x.out, x.items = table.loose, None

        def end() -> None:
            out.block(table.layout(self.budget))
            out.line(empty=True)

        x.end = end

    def open_part(self, x: Open, attrs: dict[str, str]) -> None:
        table, out = x.table, x.out
        if table is None:
            # Too deep for columns: rows are lines, cells are parted by blanks.
            if x.name in ("td", "th"):
                out.put(" ")
            else:
                out.line()
            x.end = (lambda: out.put(" ")) if x.name in ("td", "th") else out.line
        elif x.name == "tr":
            table.open_row()
        elif x.name == "caption":
            x.out = table.caption
            x.end = table.caption.line
        elif x.name in ("td", "th"):
            across = min(max(_integer(attrs.get("colspan"), 1), 1), 1000)
            column = table.place(across, min(max(_integer(attrs.get("rowspan"), 1), 0), 65534))
            x.out, x.items = Writer(), None
            row = table.rows[-1]
            x.end = lambda: row.append((column, across, x.out.done()))

    def finish(self, name: str) -> None:
        """An end tag."""
        self.skip_newline = False
        if name == "br":
            self.single("br", {})
        elif name == "p":
            if not self.close({"p"}, PARAGRAPH_SCOPE) and self.stack[-1].shown and not self.formats[-1].hidden:
                self.stack[-1].out.line(empty=True)
        elif name in FORMATTING:
            self.end_formatting(name)
        elif name in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif name in TABLE_PARTS:
            self.close({name}, {"table", "template"})
        elif name in ("table", "template"):
            self.close({name}, {"template"} - {name})
        elif name == "li":
            self.close({"li"}, SCOPE | LISTS)
        elif name in SPECIAL:
            self.close({name}, SCOPE - {name})
        elif name not in ("html", "body") and (i := self.nearest({name})) > self.specials[-1]:
            self.pop_to(i)

    def raw(self, name: str, given: str, piece: str) -> None:
        """An element whose content is text, not markup."""
        self.start(name, given, False)
        if self.stack[-1].name == name:
            if name == "textarea":
                self.stack[-1].exact = self.skip_newline = True
            self.text(piece, escaped=name in ("textarea", "title"))
            self.pop_to(len(self.stack) - 1)


def page_text(page: str | None) -> str:
    """Visible text of a page: one line per block or <br>, empty lines around paragraphs, marked list items, tables in
    aligned columns (a cell may have several lines).

    Tags and comments end where browsers end them, so what follows an unclosed quoted value or comment is not text.
    Hidden elements, closed details but for their summary, and options of a menu that are not chosen are left out; a
    visible child of an invisible parent is kept. List levels beyond ``INDENTED`` are not indented further, and tables
    nested deeper than ``ALIGNED``, or whose padding would outgrow the page by far, have cells parted by blanks.
    """
    page = page or ""
    to = Page(len(page))
    at, size = 0, len(page)
    while at < size:
        here = page.find("<", at)
        if here < 0:
            to.text(page[at:])
            break
        to.text(page[at:here])
        mark = page[here + 1 : here + 2]
        after = page[here + 2 : here + 3]
        if mark.isascii() and mark.isalpha() or mark == "/" and after.isascii() and after.isalpha():
            tag = _TAG.match(page, here)
            if not tag:
                break
            name, at = tag[2].lower(), tag.end()
            if tag[1]:
                to.finish(name)
            elif name in RAW and to.foreign() < 0:
                end = None if name == "plaintext" else _RAW_END[name].search(page, at)
                stop = end.start() if end else size
                to.raw(name, tag[3], page[at:stop])
                tag = end and _TAG.match(page, stop)
                at = tag.end() if tag else size
            else:
                to.start(name, tag[3], bool(tag[4]))
        elif page.startswith("<!--", here):
            if page.startswith((">", "->"), here + 4):
                at = page.find(">", here) + 1
            else:
                end = _COMMENT_END.search(page, here + 4)
                at = end.end() if end else size
        elif page.startswith("<![CDATA[", here) and to.foreign() > 0:
            end = page.find("]]>", here)
            to.text(page[here + 9 : end if end >= 0 else size], escaped=False)
            at = end + 3 if end >= 0 else size
        elif mark in ("!", "?") and mark or mark == "/" and after:
            end = page.find(">", here)
            at = end + 1 if end >= 0 else size
        else:
            to.text("<")
            at = here + 1
    to.pop_to(1)
    return "\n".join(to.out.done()).strip("\n")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "html"):
        texts = [page_text(x) for x in piece.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``, repeated ones too: page_id, text. Null and empty pages have empty text, an empty
    table gives an empty one; other columns are not read, nothing is shuffled."""
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(_extract, "page_id long, text string")
