"""Visible text of web pages, laid out as a browser would place it.

A tolerant tree builder closes what HTML lets authors leave open (paragraphs, list items, table parts, options, the
head), opens the bodies and rows that a table's cells stand in, moves what is misplaced between cells before the table,
and ignores end tags that match nothing.  Elements that do not show are left out: head matter, scripts,
templates, `hidden`, `display: none` and `visibility: hidden` in style attributes or in a page's own rules for a tag,
class or id, closed dialogs and details, unselected options.  Visibility is inherited, so a visible part of a hidden
element shows; a rule or style for `display` wins over `hidden`.  Rules hold that apply to a screen of SCREEN pixels; of
several, the one that wins by importance, kind of selector and order.  The rest is rendered block by block: white space runs
collapse outside `pre`, paragraphs, headings, lists, tables and quotes stand apart by a blank line, other blocks by a
line break, list items are marked and indented, and table cells are padded to common column widths, wide letters
counting as two.

Null and empty pages have empty text.  Elements nested deeper than DEPTH are laid out as siblings, as in browsers:
their text stands in order, blocks on lines of their own, without list marks or columns.  No text is lost, and what
their own elements hide stays hidden at any depth.  Rows are rendered one by one; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsframe.llm.shared import small_batches

DEPTH = 150
# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style template noscript iframe object audio video canvas svg math datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header html legend li main menu nav optgroup option section summary td th tr thead tbody tfoot".split()
)
CLOSES_P = BLOCKS - frozenset("body html li dd dt td th tr thead tbody tfoot caption option optgroup summary legend".split())
# an element that opens closes these if they are still open, looked for up to the nearest of the scope
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set()),
}
CELL_SCOPE = frozenset({"td", "th", "caption", "table"})
CELLS, SECTIONS = frozenset({"td", "th", "caption"}), frozenset({"thead", "tbody", "tfoot"})
ROWS = SECTIONS | {"table", "tr"}  # these hold parts of a table only
PARTS = CELLS | SECTIONS | {"tr", "col", "colgroup"}
APART = frozenset({"noscript", "iframe", "template"})  # their content does not reach the table around them
# a desktop screen: its size, and the features that style sheets ask for
SCREEN = {"width": 1280, "height": 720}
FEATURES = {
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light",
    "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "scripting": "enabled", "update": "fast",
}
NESTED = frozenset({"table", "select", "details"})  # their parts need room below DEPTH
ROOM = 8
UNSEEN_INPUTS = frozenset("hidden checkbox radio password file image range color".split())
EM = 16
SKIP = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|url\([^()"']*\)""", re.S | re.I)
LENGTH = r"([\d.]+)\s*(px|em|rem|)"
BOUND = re.compile(r"(min-|max-|)(?:device-)?(width|height)\s*:\s*" + LENGTH)
RANGE = re.compile(rf"(?:{LENGTH}\s*(<=?|>=?|=)\s*)?(width|height)\s*(?:(<=?|>=?|=)\s*{LENGTH})?")
COMPARE = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__, "min-": float.__ge__, "max-": float.__le__, "": float.__eq__}
SIMPLE = re.compile(r"[a-z][\w-]*|[.#][\w-]+", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; `up` is the parent of one beyond DEPTH, the rest is settled before the page is laid out."""

    __slots__ = ("attrs", "children", "gone", "hidden", "kept", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.up: Node | None = None
        self.gone: bool | None = None  # not displayed, itself or with an element around it
        self.hidden, self.kept = False, True


def _pixels(number: str, unit: str) -> float:
    return float("0" + number if number.count(".") < 2 else 0) * (EM if unit in ("em", "rem") else 1)


def _feature(text: str) -> bool | None:
    """Whether the screen has a feature; None if that is not known."""
    if m := BOUND.fullmatch(text):
        return COMPARE[m[1]](float(SCREEN[m[2]]), _pixels(m[3], m[4]))
    if m := RANGE.fullmatch(text):
        size = float(SCREEN[m[4]])
        return (not m[3] or COMPARE[m[3]](_pixels(m[1], m[2]), size)) and (not m[5] or COMPARE[m[5]](size, _pixels(m[6], m[7])))
    name, _, value = (x.strip() for x in text.partition(":"))
    if name in FEATURES:
        return FEATURES[name] == value if value else FEATURES[name] != "no-preference"
    return True if text == "color" else None


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for the screen; what is not known does not hold."""
    for query in media.lower().split(","):
        words = re.findall(r"\([^()]*\)|[\w-]+", query)
        negated = words[:1] == ["not"]
        asked = [w for w in words[negated:] if w not in ("and", "or", "only")]
        held = [None if w == "not" else _feature(w[1:-1].strip()) if w[0] == "(" else w in ("all", "screen") for w in asked]
        if None not in held and (any(held) if "or" in words else all(held)) != negated:
            return True
    return False


def _plain(css: str) -> str:
    """Style text without comments and the content of strings."""
    return SKIP.sub(lambda m: " " if m[0][0] in "/<-" else '""', css)


def _declared(body: list[str]) -> dict[str, tuple[bool, bool | None]]:
    """Whether `display` and `visibility` are declared important, and whether they hide (None: as around it)."""
    out: dict[str, tuple[bool, bool | None]] = {}
    for name, value in (x.lower().split(":", 1) for x in body if ":" in x):
        name, (value, _, mark) = name.strip(), value.partition("!")
        if name in ("display", "visibility") and value.strip():
            important = mark.strip() == "important"
            if important or not out.get(name, (False,))[0]:
                value = value.strip()
                as_around = name == "visibility" and value in ("inherit", "unset", "revert")
                out[name] = important, None if as_around else value in (("none",) if name == "display" else ("hidden", "collapse"))
    return out


def screen_rules(css: str) -> Iterator[tuple[str, dict[str, tuple[bool, bool]]]]:
    """Selector lists and what they declare, in order, of the rules that apply to the screen."""
    css = _plain(css)
    blocks: list[tuple[bool, str | None, list[str]]] = []  # open blocks: whether they apply, selectors if a rule, declarations
    at = 0
    for m in re.finditer(r"[{};]|\Z", css):
        text, at = css[at : m.start()].strip(), m.end()
        if m[0] == "{":
            applies = not blocks or blocks[-1][0] and blocks[-1][1] is None  # rules within rules have no simple selector
            if text.startswith("@"):
                name, rest = re.match(r"@([\w-]*)(.*)", text, re.S).groups()
                group = name.lower() in ("layer", "supports") or name.lower() == "media" and on_screen(rest)
                blocks.append((applies and group, None, []))
            else:
                blocks.append((applies, text, []))
            continue
        if blocks:
            blocks[-1][2].append(text)
        for _ in range(len(blocks) if not m[0] else min(len(blocks), m[0] == "}")):
            applies, selectors, body = blocks.pop()
            if applies and selectors and (declared := _declared(body)):
                yield selectors, declared


class Builder(HTMLParser):
    """Element tree of a page, and what its style sheets say of simple selectors."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open, self.styles = [self.root], []
        self.over: list[Node] = []  # open elements beyond DEPTH, and how many of each tag
        self.count: Counter[str] = Counter()

    def _hold(self, node: Node) -> None:
        """Place a leaf of the elements beyond DEPTH."""
        node.up = self.over[-1] if self.over else None
        if self.open[-1].tag in ROWS and (table := self._table()):
            self.open[table - 1].children.insert(-1, node)
        else:
            self.open[-1].children.append(node)

    def _push(self, node: Node) -> None:
        node.up = self.over[-1] if self.over else self.open[-1]
        if node.tag in BLOCKS:
            self._hold(Node("br", {}))
        self.over.append(node)
        self.count[node.tag] += 1

    def _pop(self, tag: str) -> None:
        """End the last element of this tag beyond DEPTH, and those in it."""
        while True:
            node = self.over.pop()
            self.count[node.tag] -= 1
            if node.tag in BLOCKS:
                self._hold(Node("br", {}))
            if node.tag == tag:
                return

    def _close_first(self, tags: set[str], scope: set[str] | frozenset[str]) -> None:
        found = next((t for t in tags if self.count[t]), None)
        if found:
            self._pop(found)
        else:
            self._close(tags, scope)

    def _close(self, tags: set[str], scope: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in scope:
                return
            if self.open[k].tag in tags:
                del self.open[k:]
                return self._close(tags, scope)

    def _last(self, tags: frozenset[str] | set[str]) -> int:
        return next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag in tags), 0)

    def _table(self) -> int:
        """Place of the open table whose parts come next; 0 in a cell, a caption or no table."""
        k = self._last(CELL_SCOPE | APART)
        return k if self.open[k].tag == "table" else 0

    def _part(self, tag: str) -> None:
        """Make room for a part of a table: end what may not hold it, and open the body and row it needs."""
        k = self._last({"table"} | APART)
        if self.open[k].tag != "table":
            return
        inner = [n.tag for n in self.open[k + 1 :]]
        row = next((j for j, t in enumerate(inner) if t == "tr"), None)
        body = next((j for j, t in enumerate(inner) if t in SECTIONS), None)
        if tag in ("td", "th") and row is not None:
            del self.open[k + row + 2 :]
        elif tag in ("td", "th", "tr"):
            del self.open[k + 1 if body is None else k + body + 2 :]
            for missing in ["tbody"] * (body is None) + ["tr"] * (tag != "tr"):
                self._add(Node(missing, {}))
        else:
            del self.open[k + 1 :]

    def _add(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if len(self.open) < DEPTH:
            self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        before = len(self.open)
        if not self.count["table"]:
            if tag in PARTS:
                self._part(tag)
            if tag == "table" and not self.over and (table := self._table()):
                del self.open[table:]
            if tag in CLOSES_P:
                self._close_first({"p"}, CELL_SCOPE | {"button", "object"})
            if tag not in SILENT and tag not in VOID:
                self._close({"head"}, frozenset())
            if tag in IMPLIED:
                tags, scope = IMPLIED[tag]
                self._close_first(tags, scope | APART if tag in PARTS else scope | APART | CELL_SCOPE)
        self._left(before)
        node = Node(tag, dict(attrs))
        if self.over and tag in VOID:
            return self._hold(node)
        if self.over or (tag not in VOID and len(self.open) >= DEPTH - ROOM * (tag in NESTED)):
            return self._push(node)
        table = self._table()
        if table and tag not in PARTS and tag not in SILENT and tag != "form" and self.open[-1].tag in ROWS:
            self.open[table - 1].children.insert(-1, node)  # the table is the last child so far
        else:
            self.open[-1].children.append(node)
        if tag not in VOID and tag != "colgroup" and not (table and tag == "form"):
            self.open.append(node)

    def _left(self, before: int) -> None:
        """Elements beyond DEPTH end with the element that they stand in."""
        if len(self.open) < before:
            self.over.clear()
            self.count.clear()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            return self._pop(tag)
        if self.count["table"] and tag != "body":
            return
        before = len(self.open)
        self._end(tag)
        self._left(before)

    def _end(self, tag: str) -> None:
        scope = {"table"} if tag in CELLS or tag in SECTIONS or tag == "tr" else frozenset() if tag in ("table", "body") else CELL_SCOPE
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in scope:
                return

    def handle_data(self, data: str) -> None:
        if self.over:
            if self.over[-1].tag == "style" and not any(self.count[t] for t in APART) and not self._last(APART):
                self.over[-1].children.append(data)
                self.styles.append(self.over[-1])
            holder = Node("span", {})
            holder.children.append(data)
            return self._hold(holder)
        parent = self.open[-1]
        if parent.tag == "style" and not self._last(APART):
            self.styles.append(parent)
        if parent.tag == "head" and not data.isspace():
            self._close({"head"}, frozenset())
            parent = self.open[-1]
        table = self._table() if parent.tag in ROWS and not data.isspace() else 0
        if table:
            self.open[table - 1].children.insert(-1, data)
        else:
            parent.children.append(data)


    def rules(self) -> dict[str, dict[str, tuple[bool, int, int, bool]]]:
        """For each simple selector and property the winning rule: important, kind of selector, order, whether it hides."""
        out: dict[str, dict[str, tuple[bool, int, int, bool]]] = {}
        sheets = ("".join(c for c in node.children if isinstance(c, str)) for node in dict.fromkeys(self.styles) if on_screen(node.attrs.get("media") or "all"))
        for turn, (selectors, declared) in enumerate(rule for sheet in sheets for rule in screen_rules(sheet)):
            for name in (x.strip().lower() for x in selectors.split(",")):
                if SIMPLE.fullmatch(name):
                    known = out.setdefault(name, {})
                    for what, (important, hides) in declared.items():
                        known[what] = max(known.get(what, (False, -1, -1, False)), (important, ".#".find(name[0]) + 1, turn, hides))
        return out


class Layout:
    """Renders a tree to lines; a block is a list of lines, None standing for a wanted blank line."""

    def __init__(self, rules: dict[str, dict[str, tuple[bool, int, int, bool]]]):
        self.rules = rules

    def _styled(self, node: Node) -> dict[str, bool | None]:
        """Whether `display` and `visibility` of an element hide it, where the page says so."""
        attrs = node.attrs
        found = [{"display": (False, -1, 0, True)}] if "hidden" in attrs else []
        if self.rules:
            names = [node.tag, "#" + (attrs.get("id") or "").lower(), *("." + c.lower() for c in (attrs.get("class") or "").split())]
            found += [self.rules[n] for n in names if n in self.rules]
        if attrs.get("style"):
            own = _declared(_plain(attrs["style"]).split(";"))
            found.append({what: (important, 3, 0, hides) for what, (important, hides) in own.items()})
        return {w: max((rule[w] for rule in found if w in rule), key=lambda r: r[:3])[3] for w in {w for rule in found for w in rule}}

    def _judge(self, node: Node, around: Node | None) -> None:
        attrs, styled = node.attrs, self._styled(node)
        unseen = node.tag == "input" and (attrs.get("type") or "").lower() in UNSEEN_INPUTS
        closed = node.tag == "dialog" and "open" not in attrs
        node.gone = bool(around and around.gone) or node.tag in SILENT or unseen or closed or bool(styled.get("display"))
        hidden = styled.get("visibility")
        node.hidden = bool(around and around.hidden) if hidden is None else hidden

    def settle(self, root: Node) -> None:
        """Decide for all elements whether they, or anything in them, show."""
        root.gone, order = False, [root]
        for node in order:
            for child in node.children:
                if isinstance(child, str):
                    continue
                chain, around = [child], child.up or node
                while around.gone is None:  # an element beyond DEPTH
                    chain.append(around)
                    around = around.up
                for element in reversed(chain):
                    self._judge(element, around)
                    around = element
                order.append(child)
        for node in reversed(order):
            node.kept = not node.gone and (not node.hidden or any(not isinstance(c, str) and c.kept for c in node.children))

    def block(self, node: Node, pre: bool = False) -> list[str | None]:
        """Lines of a node's content."""
        lines: list[str | None] = []
        run: list[str] = []

        def flush() -> None:
            text = "".join(run)
            run.clear()
            if pre:
                if text:
                    lines.extend(text.strip("\n").split("\n"))
                return
            for line in text.split("\v"):  # line breaks inside a paragraph
                lines.append(SPACES.sub(" ", line).strip(" "))
            while lines and lines[-1] == "":
                lines.pop()

        self._content(node, pre, run, lines, flush)
        if run:
            flush()
        return lines

    def _content(self, node: Node, pre: bool, run: list[str], lines: list, flush) -> None:
        for child in self._visible(node):
            if isinstance(child, str):
                run.append(child if pre else child.replace("\v", " "))
            elif child.tag == "br":
                run.append("\n" if pre else "\v")
            elif child.tag == "input":
                run.append("" if child.hidden else child.attrs.get("value") or "")
            elif child.tag in BLOCKS:
                if run:
                    flush()
                self._apart(lines, self._block(child, pre), child.tag in SPACED)
            elif child.tag != "img" and child.tag not in VOID:
                self._content(child, pre, run, lines, flush)

    def _visible(self, node: Node) -> list:
        children = [c for c in node.children if (not node.hidden if isinstance(c, str) else c.kept)]
        if node.tag == "details" and "open" not in node.attrs:
            return [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        if node.tag == "select" and "multiple" not in node.attrs:
            options = [c for c in _inside(children, "option")]
            return [c for c in options if "selected" in c.attrs][-1:] or options[:1]
        return children

    @staticmethod
    def _apart(lines: list, more: list, spaced: bool) -> None:
        if not more:
            return
        if spaced and lines and lines[-1] is not None:
            lines.append(None)
        lines.extend(more)
        if spaced:
            lines.append(None)

    def _block(self, node: Node, pre: bool) -> list[str | None]:
        if node.tag == "table":
            return self._table(node)
        if node.tag in ("ul", "ol", "menu", "dir"):
            return self._list(node)
        if node.tag == "pre":
            return self.block(node, True)
        lines = self.block(node, pre)
        return [line if not line else "  " + line for line in lines] if node.tag in ("blockquote", "dd") else lines

    def _list(self, node: Node) -> list[str | None]:
        lines: list[str | None] = []
        number = _whole(node.attrs.get("start"), 1)
        loose = Node("span", {})

        def flush() -> None:
            lines.extend(_trimmed(self.block(loose)))
            loose.children.clear()

        for child in self._visible(node):
            if isinstance(child, str) or child.tag not in BLOCKS:
                loose.children.append(child)
                continue
            flush()
            body = _trimmed(self.block(child) if child.tag == "li" else self._block(child, False))
            if child.tag != "li":
                lines.extend("  " + x if x else x for x in body)
                continue
            mark = "- "
            if node.tag == "ol":
                number = _whole(child.attrs.get("value"), number)
                mark, number = f"{number}. ", number + 1
            lines.extend((mark if k == 0 else " " * len(mark)) + x if x is not None else None for k, x in enumerate(body or [""]))
        flush()
        return lines

    def _table(self, node: Node) -> list[str | None]:
        out: list[str | None] = []
        for caption in _inside(self._visible(node), "caption"):
            out.extend(_trimmed(self.block(caption)))
        grid: list[dict[int, list[str]]] = []
        spans: dict[int, int] = {}  # rows a cell above still covers, by column
        wide: list[tuple[int, int, int]] = []
        rows = _inside(self._visible(node), "tr", ("thead", "tbody", "tfoot"), self)
        for row in rows:
            cells, at = {}, 0
            for cell in (c for c in self._visible(row) if not isinstance(c, str) and c.tag in ("td", "th")):
                while spans.get(at, 0) > 0:
                    at += 1
                width, height = max(1, min(_whole(cell.attrs.get("colspan"), 1), 1000)), max(1, min(_whole(cell.attrs.get("rowspan"), 1), 65_534))
                cells[at] = [x or "" for x in _trimmed(self.block(cell))]
                if width > 1:
                    wide.append((len(grid), at, width))
                for k in range(at, at + width):
                    spans[k] = height
                at += width
            spans = {k: n - 1 for k, n in spans.items() if n > 1}
            grid.append(cells)
        widths: dict[int, int] = {}
        several = {(r, c) for r, c, _ in wide}
        for r, cells in enumerate(grid):
            for c, body in cells.items():
                if (r, c) not in several:
                    widths[c] = max(widths.get(c, 0), max((_width(x) for x in body), default=0))
        for r, c, span in sorted(wide, key=lambda w: w[2]):  # the last column makes room for a cell that is wider than its columns
            lacks = max((_width(x) for x in grid[r][c]), default=0) - sum(widths.get(j, 0) + 2 for j in range(c, c + span)) + 2
            if lacks > 0:
                widths[c + span - 1] = widths.get(c + span - 1, 0) + lacks
        for cells in grid:
            for k in range(max((len(body) for body in cells.values()), default=0)):
                line = ""
                for c in sorted(cells):
                    text = cells[c][k] if k < len(cells[c]) else ""
                    start = sum(widths.get(j, 0) + 2 for j in range(c)) if c else 0
                    at = _width(line)
                    line = line + " " * (max(start, at + 2 if line else start) - at) + text if text else line
                out.append(line.rstrip())
        other = [x for c in self._visible(node) if not isinstance(c, str) and c.tag not in ("caption", "thead", "tbody", "tfoot", "tr", "col", "colgroup") for x in _trimmed(self.block(c))]
        loose = SPACES.sub(" ", "".join(c for c in self._visible(node) if isinstance(c, str))).strip(" ")
        return ([loose] if loose else []) + other + out


def _inside(children: list, tag: str, through: tuple[str, ...] = ("optgroup",), layout: Layout | None = None) -> list[Node]:
    out: list[Node] = []
    for child in children:
        if not isinstance(child, str):
            if child.tag == tag:
                out.append(child)
            elif child.tag in through:
                out.extend(_inside(layout._visible(child) if layout else child.children, tag, through, layout))
    return out


def _width(line: str) -> int:
    """Columns a line takes: two for each wide letter, none for marks above another."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in line)


def _whole(text: str | None, default: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(found[1]) if found else default


def _trimmed(lines: list) -> list:
    while lines and not lines[-1]:
        lines = lines[:-1]
    while lines and not lines[0]:
        lines = lines[1:]
    return lines


def visible_text(html: str) -> str:
    builder = Builder()
    builder.feed(html)
    builder.close()
    layout = Layout(builder.rules())
    layout.settle(builder.root)
    lines = _trimmed(layout.block(builder.root))
    out: list[str] = []
    for line in lines:
        line = (line or "").replace("\xa0", " ")
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out)


def pages_text(df: DataFrame) -> DataFrame:
    """(page_id, n_chars, n_lines, text) of every page."""
    small_batches(df.sparkSession)

    def render(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [visible_text(h) if h else "" for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array(texts, pa.string()),
            ], names=["page_id", "n_chars", "n_lines", "text"])

    return df.select(df["page_id"].cast("long"), "html").mapInArrow(render, "page_id long, n_chars long, n_lines long, text string")
