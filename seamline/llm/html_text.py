"""HTML to text by a layout-aware rendering.

A tokeniser by the states of the HTML standard feeds a tree builder that knows void
elements, raw-text elements, scopes and implied end tags; a renderer then walks the tree
and emits all visible text: blocks on lines of their own with blank lines between
paragraphs, list items with markers and indentation, preformatted text as it is, and tables
with cells aligned in columns.  Hidden are comments, head matter, scripts, styles,
templates, elements with the ``hidden`` attribute (``aria-hidden="true"`` still shows on
screen), with ``display:none`` in a style attribute, hidden inputs, closed dialogs, the body
of closed ``details``, and the content of closed alternatives such as ``noscript``.
``visibility:hidden`` hides text down to an element that is ``visibility:visible`` again.
Style sheets are not read.  Formulas of MathML show their text without annotations; drawings
of SVG show their ``text`` and ``foreignObject`` elements, but not what only a ``use`` would
draw; a ``select`` shows all its options, a line each, as ``innerText`` does.

Scale.  Work is linear in a page's length.  Inline elements without an effect leave no
node; open elements are found by lists of their places, not by search; parsing and
rendering keep stacks of their own, so nesting has no limit.  Only layout has bounds, which
lose no text: indentation stops growing at ``MAX_INDENT`` columns, cells wider than
``MAX_CELL`` columns don't widen their column, and tables inside of ``MAX_TABLES`` others
show their rows as lines.

Cases.  Null and empty pages give an empty text.  Broken markup never fails: stray end tags
are dropped, open elements are closed at the end, and a tag or comment that the end of the
page cuts off is dropped, as the standard has it.  Rows are treated one by one: repeated
rows repeat their result, a null page_id stays null.  Extra columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the layout alone.
MAX_INDENT, MAX_CELL, MAX_TABLES = 64, 80, 32
MAX_SPAN = 1000

#: Element classes of the HTML standard: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noscript iframe noembed".split())
NEVER_SHOWN = frozenset("head script style template noscript title meta link noframes noembed iframe object audio video canvas datalist colgroup annotation annotation-xml rp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr ul".split()
)
SPACED = frozenset("p blockquote ul ol dl pre table h1 h2 h3 h4 h5 h6 figure".split())
PREFORMATTED = frozenset("pre textarea listing plaintext xmp".split())
CLOSES_P = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption", "legend"}
#: Elements that matter to the renderer; other elements in the open only hold text.
LAYOUT = BLOCK | NEVER_SHOWN | PREFORMATTED | frozenset("td th option optgroup select svg math".split())
#: Void elements that show something.
SHOWING_VOID = frozenset("br hr img input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What tags do not reach across: most of them, a paragraph's, a list item's, those of a table's parts.
SCOPE = ("table", "td", "th", "caption", "object", "template", "foreignobject")
P_SCOPE, LI_SCOPE, TABLE_SCOPE = (*SCOPE, "button"), (*SCOPE, "ul", "ol"), ("table", "template")
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: A start tag closes these open elements, up to one of the barriers: the nearest, or all of them.
NEAREST = {
    "li": (("li",), ("ul", "ol", "menu", "dir", *SCOPE)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "optgroup")),
    "body": (("head",), ()),
}
ALL_OPEN = {
    "dt": (("dt", "dd"), ("dl", *SCOPE)),
    "dd": (("dt", "dd"), ("dl", *SCOPE)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "optgroup": (("option", "optgroup"), ("select",)),
}
#: Hidden elements whose end tag may be left out, and the start tags that leave them open.
#: Any other start tag, and text that is not blank, closes them.
HIDDEN_OPEN = {
    "head": frozenset("base basefont bgsound link meta title noscript noframes style script template".split()),
    "colgroup": frozenset(("col", "template")),
}
FOREIGN = ("svg", "math")
#: Elements of drawings and formulas that hold HTML.
INTEGRATION = ("foreignobject", "desc", "annotation-xml")
SVG_UNSEEN = frozenset("defs symbol clippath mask marker pattern desc metadata".split())
#: Start tags that end an open drawing, as the HTML standard lists them.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)

# Tags by the states of the standard; groups never give back what they took, so a tag is read once.
_W = r"[\t\n\f\r ]"
_NAME = r"[^\t\n\f\r />][^\t\n\f\r />=]*+"
_TAG = re.compile(
    rf"<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?>[\t\n\f\r /]++|{_NAME}"
    rf"(?>{_W}*+={_W}*+(?>\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r \"'>][^\t\n\f\r >]*+|(?=>))|(?!{_W}*+=)))*+)>"
)
_ATTRIBUTES = re.compile(rf"({_NAME})(?:{_W}*+={_W}*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\t\n\f\r \"'>][^\t\n\f\r >]*+)|\Z))?+")
_COMMENT_END = re.compile(r"--!?>")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BLANK = " \t\n\r\f"


def tag_at(page: str, at: int) -> tuple[int, str, str, bool] | None:
    """The tag that begins at ``at``: its end, name, attributes and whether it's an end tag; None if cut off."""
    m = _TAG.match(page, at)
    return None if m is None else (m.end(), m[2].lower(), m[3], bool(m[1]))


def markup_end(page: str, at: int, foreign: bool = False) -> tuple[int, str]:
    """Where a comment, declaration or the like that begins at ``at`` ends, and the text that it holds."""
    if page.startswith("<!--", at):
        if page.startswith("<!-->", at):
            return at + 5, ""
        if page.startswith("<!--->", at):
            return at + 6, ""
        end = _COMMENT_END.search(page, at + 4)
        return (end.end() if end else len(page)), ""
    if foreign and page.startswith("<![CDATA[", at):
        end = page.find("]]>", at + 9)
        return (len(page), page[at + 9 :]) if end < 0 else (end + 3, page[at + 9 : end])
    return (page.find(">", at + 2) + 1 or len(page)), ""


class Element:
    """A node: ``hidden`` takes it out of the layout, ``visible`` sets what its text is (None: as around it)."""

    __slots__ = ("tag", "attributes", "children", "hidden", "visible")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.attributes = tag, [], attributes
        self.hidden, self.visible = tag in NEVER_SHOWN, None
        if attributes:
            _style(self)
        elif tag == "dialog":
            self.hidden = True


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTES.findall(source):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _style(element: Element) -> None:
    """What attributes say of being shown."""
    low = element.attributes.lower()
    if element.tag != "dialog" and "hidden" not in low and "display" not in low and "visibility" not in low:
        return
    attributes = attributes_of(element.attributes)
    hidden = "hidden" in attributes or (element.tag == "dialog" and "open" not in attributes)
    if element.tag == "input" and attributes.get("type", "").strip().lower() == "hidden":
        element.hidden = True
    said: dict[str, tuple[bool, str]] = {}
    for declaration in attributes.get("style", "").lower().split(";"):
        name, _, value = declaration.partition(":")
        name, strong = name.strip(), "!important" in value.replace(" ", "")
        value = value.partition("!")[0].strip()
        if value and (strong or not said.get(name, (False,))[0]):
            said[name] = (strong, value)
    if "display" in said:  # the style of an element overrides its hidden attribute
        hidden = said["display"][1] == "none"
    element.hidden = element.hidden or hidden
    if "visibility" in said and said["visibility"][1] in ("visible", "hidden", "collapse"):
        element.visible = said["visibility"][1] == "visible"


class _Open:
    """The open elements: names by place, the node that content goes to, and the places of each name."""

    def __init__(self, root: Element):
        self.names: list[str | None] = ["html"]
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: Element) -> None:
        self.places.setdefault(tag, []).append(len(self.names))
        self.names.append(tag)
        self.nodes.append(node)

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element among ``tags``; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_after(self, tags: Iterable[str], place: int) -> int:
        """Place of the outermost open element among ``tags`` that is inside of ``place``; 0 if there is none."""
        found = 0
        for t in tags:
            p = self.places.get(t)
            if p and p[-1] > place:
                at = p[bisect_right(p, place)]
                found = min(found, at) if found else at
        return found

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside of it."""
        while len(self.names) > place:
            name = self.names.pop()
            self.nodes.pop()
            if name is not None:
                self.places[name].pop()
        self._drop_closed()

    def forget(self, place: int, tag: str) -> None:
        """Close an inline element only: blocks inside of it stay open."""
        self.places[tag].pop()
        self.names[place] = None
        self._drop_closed()

    def _drop_closed(self) -> None:
        while self.names[-1] is None:
            self.names.pop()
            self.nodes.pop()

    def foreign(self) -> bool:
        """Whether content belongs to a drawing or formula."""
        places = self.places
        return bool(places.get("svg") or places.get("math")) and self.last(FOREIGN) > self.last(INTEGRATION)


def _close_implied(open_: _Open, tag: str) -> None:
    if tag in NEAREST:
        closed, barriers = NEAREST[tag]
        at = open_.last(closed)
        if at > open_.last(barriers):
            open_.close(at)
    elif tag in ALL_OPEN:
        closed, barriers = ALL_OPEN[tag]
        at = open_.first_after(closed, open_.last(barriers))
        if at:
            open_.close(at)
    if tag in CLOSES_P:
        at = open_.last(("p",))
        if at > open_.last(P_SCOPE):
            open_.close(at)
        if tag in HEADINGS and open_.names[-1] in HEADINGS:
            open_.close(len(open_.names) - 1)


def _leave_hidden(open_: _Open, tag: str | None = None) -> None:
    """Close an open head or colgroup that a start tag, or text, shows to be over."""
    while len(open_.names) > 1 and open_.names[-1] in HIDDEN_OPEN and tag not in HIDDEN_OPEN[open_.names[-1]]:
        open_.close(len(open_.names) - 1)


def _end(open_: _Open, tag: str) -> None:
    """An end tag."""
    at = open_.last((tag,))
    if tag == "p" and at <= open_.last(P_SCOPE):  # an empty paragraph: it breaks the line
        _leave_hidden(open_, tag)
        open_.nodes[-1].children.append(Element("p"))
        return
    if not at and tag in HEADINGS:  # the end of any heading ends an open one
        at = open_.last(HEADINGS)
    barrier = TABLE_SCOPE if tag in TABLE_PARTS else LI_SCOPE if tag == "li" else SCOPE
    if not at or at < open_.last(barrier):
        return
    if tag in LAYOUT or tag in SCOPE or open_.foreign():
        open_.close(at)
    else:  # an inline end tag leaves the blocks inside open
        open_.forget(at, tag)


def _self_closed(open_: _Open, tag: str, source: str) -> bool:
    """Whether a start tag of a formula or drawing is its own end: HTML's are not."""
    if not source.endswith("/") or (tag not in FOREIGN and not open_.foreign()):
        return False
    last = None
    for last in _ATTRIBUTES.finditer(source):
        pass
    return last is None or last[4] is None or last.end() < len(source)  # a slash may end an unquoted value


def _add_text(open_: _Open, text: str) -> None:
    if open_.names[-1] in HIDDEN_OPEN and text.strip(_BLANK):
        _leave_hidden(open_)
    open_.nodes[-1].children.append(text)


def parse(page: str) -> Element:
    """The element tree of a page, without inline elements that only hold text."""
    if "\r" in page:
        page = page.replace("\r\n", "\n").replace("\r", "\n")
    root = Element("html")
    open_, at, n = _Open(root), 0, len(page)
    while at < n:
        less = page.find("<", at)
        while 0 <= less < n - 1 and not (page[less + 1] in "!?/" or page[less + 1].isascii() and page[less + 1].isalpha()):
            less = page.find("<", less + 1)
        if less < 0 or less == n - 1 or less == n - 2 and page[less + 1] == "/":
            _add_text(open_, html.unescape(page[at:]))
            break
        if less > at:
            _add_text(open_, html.unescape(page[at:less]))
        sign = page[less + 1]
        if sign in "!?" or sign == "/" and not (page[less + 2].isascii() and page[less + 2].isalpha()):
            at, text = markup_end(page, less, open_.foreign())
            if text:
                _add_text(open_, text)
            continue
        tag_ = tag_at(page, less)
        if tag_ is None:
            break
        at, tag, source, ends = tag_
        if ends:
            if tag == "br":
                _leave_hidden(open_, tag)
                open_.nodes[-1].children.append(Element("br"))
            elif tag not in ("body", "html"):  # what follows those still belongs to them
                _end(open_, tag)
            continue
        if tag == "html":
            continue
        if tag == "image":
            tag = "img"
        _leave_hidden(open_, tag)
        foreign = open_.foreign()
        if foreign and tag in BREAKS_OUT:
            open_.close(open_.first_after(FOREIGN, open_.last(INTEGRATION)))
            foreign = open_.foreign()
        if not foreign:
            _close_implied(open_, tag)
        if tag in VOID and not foreign:
            if tag in SHOWING_VOID:
                open_.nodes[-1].children.append(Element(tag, source))
            continue
        low = source.lower() if source else ""
        if not (foreign or tag in LAYOUT or "hidden" in low or "style" in low):
            open_.push(tag, open_.nodes[-1])
            continue
        element = Element(tag, source)
        open_.nodes[-1].children.append(element)
        if (foreign or tag in FOREIGN) and _self_closed(open_, tag, source):
            continue
        if tag == "plaintext":
            element.children.append(page[at:])
            break
        if tag in RAW and not foreign:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            body = page[at:stop]
            element.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            if end is None:
                break
            closing = tag_at(page, stop)
            if closing is None:
                break
            at = closing[0]
            continue
        open_.push(tag, element)
        if tag in ("pre", "listing") and page.startswith("\n", at):
            at += 1
    return root


def width(text: str) -> int:
    """Columns that a text takes in a fixed-width font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines under construction: inline text collapses blanks, blocks break lines.

    Blocks that are set in write to the lines of what they are in, from ``start`` on.
    """

    def __init__(self, within: Lines | None = None, indent: int = 0):
        self.within = within
        self.done: list[str] = within.done if within else []
        self.margins: list[int] = within.margins if within else []
        self.marks: dict[int, list[tuple[int, str]]] = within.marks if within else {}
        self.indent = min(MAX_INDENT, (within.indent if within else 0) + indent)
        self.start = len(self.done)
        self.now: list[str] = []
        self.gap = False  # a blank line is due before the next text

    def empty(self) -> bool:
        return len(self.done) == self.start

    def text(self, data: str) -> None:
        data = _SPACE.sub(" ", data)
        if not data or (data == " " and (not self.now or self.now[-1].endswith(" "))):
            return
        if not self.now or self.now[-1].endswith(" "):
            data = data.lstrip(" ")
        self.now.append(data)

    def line(self) -> None:
        if self.now:
            joined = "".join(self.now).rstrip(" ")
            self.now = []
            if joined:
                self.add([joined])

    def add(self, lines: list[str]) -> None:
        opened, outer = [], self
        while outer is not None and outer.empty():
            opened.append(outer)
            outer = outer.within
        if outer is not None and outer.gap:
            self.done.append("")
            self.margins.append(0)
            outer.gap = False
        for x in opened:
            x.start, x.gap = len(self.done), False
        self.done.extend(lines)
        self.margins.extend([self.indent] * len(lines))

    def blank(self) -> None:
        self.line()
        self.gap = True

    def mark(self, mark: str) -> None:
        """Put a list item's marker into the margin of its first line."""
        self.marks.setdefault(self.start, []).append((self.indent - len(mark), mark))

    def finished(self) -> list[str]:
        self.line()
        out = [" " * m + x if x else "" for m, x in zip(self.margins, self.done)]
        for i, marks in self.marks.items():
            margin = list(" " * self.margins[i])
            for at, mark in marks:  # inner ones first; the outer ones write over them where no margin is left
                at = max(0, at)
                margin[at : at + len(mark)] = mark
            out[i] = ("".join(margin) + self.done[i]).rstrip(" ") if not self.done[i] else "".join(margin) + self.done[i]
        return out


def _span(cell: Element) -> int:
    if not cell.attributes or "colspan" not in cell.attributes.lower():
        return 1
    said = attributes_of(cell.attributes).get("colspan", "1")
    return max(1, min(int(said), MAX_SPAN)) if re.fullmatch("[0-9]{1,9}", said) else 1


def _table(out: Lines, element: Element, seen: bool, tables: int):
    """Rows of a table, cells aligned in columns; a cell's own lines stay together."""
    loose = Lines()  # text outside of cells is shown before the table
    rows: list[list[tuple[int, list[str]]]] = []  # cells with the column that each begins in

    def row_cells(children: list, seen: bool):
        cells, column = [], 0
        for cell in children:
            if isinstance(cell, str):
                if seen and cell.strip(_BLANK):
                    loose.add([_SPACE.sub(" ", cell).strip(" ")])
            elif not cell.hidden:
                inner = Lines()
                yield _fill(inner, cell, False, seen if cell.visible is None else cell.visible, tables + 1)
                cells.append((column, inner.finished()))
                column += _span(cell)
        if cells:
            rows.append(cells)

    pending = [(iter(element.children), seen)]
    while pending:
        children, seen = pending[-1]
        child = next(children, None)
        if child is None:
            pending.pop()
            continue
        if isinstance(child, str):
            if seen and child.strip(_BLANK):
                loose.add([_SPACE.sub(" ", child).strip(" ")])
            continue
        shown = seen if child.visible is None else child.visible
        if child.hidden:
            continue
        if child.tag in ("thead", "tbody", "tfoot", "form"):
            pending.append((iter(child.children), shown))
        elif child.tag == "tr":
            yield row_cells(child.children, shown)
        elif child.tag in ("td", "th"):
            yield row_cells([child], seen)
        else:
            yield _fill_one(loose, child, False, seen, tables + 1)
            loose.line()
    lines = loose.finished()
    used = sorted({c for r in rows for c, _ in r})
    place = {c: i for i, c in enumerate(used)}
    wide = [0] * len(used)
    for r in rows:
        for c, cell in r:
            i = place[c]
            wide[i] = max(wide[i], max((w for x in cell if (w := width(x)) <= MAX_CELL), default=0))
    begins = [0]
    for w in wide:
        begins.append(begins[-1] + w + 2)
    for r in rows:
        for k in range(max(len(cell) for _, cell in r)):
            parts, at, before = [], 0, 0
            for c, cell in r:
                if k < len(cell) and cell[k]:
                    due = begins[place[c]]
                    # a cell that is wider than its column moves those after it
                    pad = max(due - at, 2 if before else 0)
                    parts.append(" " * min(pad, 4 * MAX_CELL))
                    parts.append(cell[k])
                    at += min(pad, 4 * MAX_CELL) + width(cell[k])
                    before = 1
            lines.append("".join(parts).rstrip(" "))
    if lines:
        out.add(lines)


def _fill_drawing(out: Lines, element: Element, seen: bool, tables: int):
    for child in element.children:
        if isinstance(child, str) or child.hidden or child.tag in SVG_UNSEEN:
            continue
        shown = seen if child.visible is None else child.visible
        if child.tag == "text":
            out.text(" ")
            yield _fill(out, child, False, shown, tables)
            out.text(" ")
        elif child.tag == "foreignobject":
            out.line()
            yield _fill(out, child, False, shown, tables)
            out.line()
        else:
            yield _fill_drawing(out, child, shown, tables)


def _fill(out: Lines, element: Element, pre: bool, seen: bool, tables: int):
    """Put an element's content into ``out``; yields the work on its children."""
    pre = pre or element.tag in PREFORMATTED
    if element.tag == "svg":
        yield _fill_drawing(out, element, seen, tables)
        return
    number = None
    if element.tag == "ol":
        start = attributes_of(element.attributes).get("start", "1") if element.attributes else "1"
        number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    children = element.children
    if element.tag == "details" and "open" not in attributes_of(element.attributes):
        children = next(([c] for c in children if not isinstance(c, str) and c.tag == "summary"), [])
    for child in children:
        if isinstance(child, str):
            if not seen:
                continue
            if pre:
                first, *rest = child.expandtabs(8).split("\n")
                out.now.append(first)
                for part in rest:
                    out.add(["".join(out.now).rstrip()])
                    out.now = [part]
            else:
                out.text(child)
        elif child.hidden:
            continue
        elif child.tag == "li":
            out.line()
            mark = "- " if number is None else f"{number}. "
            number = None if number is None else number + 1
            item = Lines(out, len(mark))
            yield _fill(item, child, pre, seen if child.visible is None else child.visible, tables)
            item.line()
            if not item.empty():
                item.mark(mark)
        else:
            yield _fill_one(out, child, pre, seen, tables, element.tag)


def _fill_one(out: Lines, child: Element, pre: bool, seen: bool, tables: int, around: str = ""):
    tag = child.tag
    seen = seen if child.visible is None else child.visible
    if child.hidden:
        return
    if tag == "br":
        if out.now:
            out.line()
        elif not out.empty() and not out.gap and out.done[-1] != "":
            out.add([""])
    elif tag == "hr":
        out.line()
    elif tag == "img":
        if seen and child.attributes and "alt" in child.attributes.lower():
            out.text(attributes_of(child.attributes).get("alt", ""))
    elif tag == "input":
        values = attributes_of(child.attributes)
        if seen and values.get("type", "text").lower() in ("submit", "button", "reset", "text"):
            out.text(values.get("value", ""))
    elif tag == "table":
        out.blank()
        yield _table(out, child, seen, tables) if tables < MAX_TABLES else _fill(out, child, pre, seen, tables)
        out.blank()
    elif tag in ("blockquote", "dd"):
        out.blank() if tag == "blockquote" else out.line()
        inner = Lines(out, 2)
        yield _fill(inner, child, pre, seen, tables)
        inner.line()
        out.blank() if tag == "blockquote" else out.line()
    elif tag in SPACED:
        nested = tag in ("ul", "ol") and around == "li"
        out.line() if nested else out.blank()
        yield _fill(out, child, pre, seen, tables)
        out.line() if nested else out.blank()
    elif tag in BLOCK:
        out.line()
        yield _fill(out, child, pre, seen, tables)
        out.line()
    elif tag in ("option", "optgroup"):
        out.line()
        label = attributes_of(child.attributes).get("label", "") if child.attributes else ""
        if seen:
            out.text(label)
        if tag == "optgroup" or not label:
            out.line()
            yield _fill(out, child, pre, seen, tables)
        out.line()
    elif tag in ("td", "th"):  # outside of a table
        out.text(" ")
        yield _fill(out, child, pre, seen, tables)
        out.text(" ")
    else:
        yield _fill(out, child, pre, seen, tables)


def render(page: str | None) -> str:
    """All visible text of a page."""
    if not page:
        return ""
    out = Lines()
    stack = [_fill(out, parse(page), False, True, 0)]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)
    return "\n".join(out.finished())


_OUT = pa.schema([("page_id", pa.int64()), ("text", pa.string())])


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=_OUT)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, html): page_id, text."""
    common.prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_run, "page_id long, text string")
