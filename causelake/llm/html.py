"""Layout-aware text of HTML pages.

A tolerant tokenizer feeds a tree builder that supplies what authors leave out: implied ``html``,
``head``, ``body``, ``tbody``, ``tr`` and ends of paragraphs, list items, cells and options.  A
renderer then emits all visible text: what style, ``hidden`` or the element itself makes invisible
is left out (``visibility`` is inherited, so a visible element shows inside a hidden one; of ``style``
sheets the rules that name an element, class or id are followed, and a rule with a longer selector
can only show what they hide), closed ``details`` show their summary, buttons and filled fields their
value, blocks stand on lines of their own with blank lines around paragraphs and headings,
list items carry their marks, preformatted text keeps its blanks, and table cells are aligned.
What stands in a table outside its cells goes before the table, as in browsers.  Of SVG the labels are
shown, each on its own line, and of MathML the tokens, with blanks between the parts of fractions,
scripts and matrices; text that an SVG only refers to by ``use`` is not.

Defined cases: null and empty pages have the empty text; a null ``page_id`` or ``url`` is kept; repeated
rows are kept; unclosed, stray and crossing tags never fail; pages of any length are read whole; deep
nesting is walked without recursion, and beyond ``MOST_DEPTH`` nested tables the text of cells stays but
is no longer aligned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.llm.common import lean, table, text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
NEVER_SHOWN = frozenset(
    "head title script style template noscript iframe object embed applet audio video canvas datalist noembed noframes param source track meta link base annotation annotation-xml".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre section summary table tbody tfoot thead tr ul xmp caption".split()
)
#: Blank lines around a block.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset menu dir listing xmp".split())
PREFORMATTED = frozenset("pre listing xmp plaintext textarea".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup tbody tfoot thead tr caption legend".split())
HEAD_ONLY = frozenset("title meta link base style script".split())
#: A start tag ends these open elements, up to the scope named with them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
ENDS["caption"] = ENDS["colgroup"] = ENDS["tbody"]
#: Only these stand in tables, sections and rows themselves.
CONTEXT = frozenset({"table", "tbody", "thead", "tfoot", "tr"})
CELLS = frozenset({"td", "th", "caption"})
TABLE_PARTS = CONTEXT | CELLS | {"colgroup", "col"}
#: Embedded languages, where their text is HTML's again, tags that end them, and parts of SVG that are only referred to.
FOREIGN = frozenset({"svg", "math"})
AGAIN_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var".split()
)
SVG_STORE = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
MATH_PARTS = frozenset("mfrac msup msub msubsup mroot munder mover munderover mmultiscripts mtr mlabeledtr mtable".split())
#: End tags do not reach beyond these.
WALLS = frozenset({"table", "td", "th", "caption", "html", "body"})

#: Attributes by state: only a quote right behind "=" opens a quoted value, elsewhere it is an ordinary letter.
_VALUE = r"""\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+)"""
_NAME = r"(?:=?+[^\s/>=]++|=)"
TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(!\[CDATA\[)|([!?][^>]*+(?:>|\Z)|/(?:>|[^a-zA-Z][^>]*+(?:>|\Z)))"
    rf"|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_VALUE})?+)*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"""(=?+[^\s/>=]++|=)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+""", re.S)
BLANKS = re.compile(r"[ \t\n\f\r]+")
DECLARED = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important\s*)?(?=[;}]|$)", re.I)
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SIMPLE = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
#: Fields whose value is shown.
SHOWN_INPUTS = frozenset("submit button reset text search email url tel number date time month week datetime-local".split())
PRE_STYLE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre|pre-wrap|break-spaces)\s*(?=;|$)", re.I)


@dataclass(slots=True)
class Node:
    name: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)


class TreeBuilder:
    """Builds the element tree of one page."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.head, self.body = Node("head", {}), Node("body", {})
        self.root.children += [self.head, self.body]
        self.open = [self.root, self.head]
        self.in_body = False
        self.count: Counter[str] = Counter()  # of the open elements below head or body
        self.homes: dict[int, Node] = {}  # parents of tables

    def _cut(self, i: int) -> None:
        """Closes the open elements from number ``i`` on."""
        for n in self.open[i:]:
            self.count[n.name] -= 1
        del self.open[i:]

    def _into_body(self) -> None:
        if not self.in_body:
            self.open, self.in_body = [self.root, self.body], True
            self.count.clear()

    def _end_implied(self, ended: set[str], scope: set[str]) -> None:
        """Closes the outermost open element of ``ended`` inside the nearest of ``scope``."""
        if not any(self.count[n] for n in ended):
            return
        last = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].name in scope:
                break
            if self.open[i].name in ended:
                last = i
        if last is not None:
            self._cut(last)

    def _in_table(self) -> int | None:
        """Number of the open table, section or row that is not yet left for a cell."""
        if self.count["table"]:
            for i in range(len(self.open) - 1, 1, -1):
                if self.open[i].name in CELLS:
                    return None
                if self.open[i].name in CONTEXT:
                    return i
        return None

    def foreign(self) -> bool:
        """Whether the next start tag belongs to SVG or MathML."""
        if self.count["svg"] or self.count["math"]:
            for n in reversed(self.open):
                if n.name in FOREIGN:
                    return True
                if n.name in AGAIN_HTML:
                    return False
        return False

    def _place(self, item: Node | str) -> None:
        """Appends to the open element; what may not stand in a table itself goes before the table."""
        if self.open[-1].name == "colgroup" and not (isinstance(item, Node) and item.name == "col") and (isinstance(item, Node) or item.strip()):
            self._cut(len(self.open) - 1)
        if self.open[-1].name in CONTEXT and self.count["table"] and (item.name not in TABLE_PARTS if isinstance(item, Node) else item.strip()):
            table = next(n for n in reversed(self.open) if n.name == "table")
            self.homes[id(table)].children.insert(-1, item)  # an open table is its parent's last child
            return
        if isinstance(item, Node) and item.name == "table":
            self.homes[id(item)] = self.open[-1]
        self.open[-1].children.append(item)

    def start(self, name: str, attributes: dict[str, str], self_closing: bool) -> None:
        if name in ("html", "body", "head"):
            node = {"html": self.root, "body": self.body, "head": self.head}[name]
            for k, v in attributes.items():
                node.attributes.setdefault(k, v)
            if name == "body":
                self._into_body()
            return
        if not self.in_body and name not in HEAD_ONLY:
            self._into_body()
        foreign = self.foreign()
        if foreign and name in ENDS_FOREIGN:
            self._cut(next(i for i in range(len(self.open) - 1, 1, -1) if self.open[i].name in FOREIGN))
            foreign = False
        if foreign:
            self._push(Node(name, attributes))
            if self_closing:
                self._cut(len(self.open) - 1)
            return
        at = self._in_table() if name in TABLE_PARTS or name == "form" else None
        if at is not None:
            if name == "form":  # holds nothing in a table
                return
            self._cut(at + 1)
            if name == "table":
                self._cut(next(i for i in range(at, 1, -1) if self.open[i].name == "table"))
        if name in CLOSES_P and self.count["p"]:
            for i in range(len(self.open) - 1, 1, -1):
                if self.open[i].name == "p":
                    self._cut(i)
                    break
                if self.open[i].name in WALLS:
                    break
        if name in ENDS:
            self._end_implied(*ENDS[name])
        if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.open[-1].name):
            self._cut(len(self.open) - 1)
        here = self.open[-1].name
        if name in ("td", "th") and here in ("table", "tbody", "thead", "tfoot"):
            if here == "table":
                self._push(Node("tbody", {}))
            self._push(Node("tr", {}))
        elif name == "tr" and here == "table":
            self._push(Node("tbody", {}))
        node = Node(name, attributes)
        self._push(node)
        if name in VOID or self_closing and name not in BLOCK and name not in RAW and name not in ("a", "b", "i", "span", "em", "strong"):
            self._cut(len(self.open) - 1)

    def _push(self, node: Node) -> None:
        self._place(node)
        self.open.append(node)
        self.count[node.name] += 1

    def end(self, name: str) -> None:
        if name == "head":
            self._into_body()
            return
        if name in ("body", "html"):
            return
        if name == "br":
            return self.start("br", {}, True)
        if name == "p" and not self.count["p"]:
            self.start("p", {}, False)
            self._cut(len(self.open) - 1)
            return
        if not self.count[name]:
            return
        for i in range(len(self.open) - 1, 1, -1):
            here = self.open[i].name
            if here == name:
                self._cut(i)
                return
            if here in WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return

    def text(self, data: str) -> None:
        if not self.in_body and self.open[-1].name not in RAW:
            if not data.strip():
                return
            self._into_body()
        self._place(data)


def parse(page: str) -> Node:
    """The element tree of a page."""
    builder, at, n = TreeBuilder(), 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            builder.text(html.unescape(page[at:]))
            break
        if m.start() > at:
            builder.text(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m.group(4)
        if m.group(1):  # text in SVG and MathML, a comment elsewhere
            inside = builder.foreign()
            end = page.find("]]>" if inside else ">", at)
            if inside:
                builder.text(page[at : end if end >= 0 else n])
            at = n if end < 0 else end + (3 if inside else 1)
            continue
        if name is None:
            continue
        name = name.lower()
        if m.group(3):
            builder.end(name)
            continue
        attributes = {}
        if m.group(5):
            for a in ATTRIBUTE.finditer(m.group(5)):
                attributes.setdefault(a.group(1).lower(), html.unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        closed = m.group(0).endswith("/>")
        empty = closed and name not in ENDS_FOREIGN and builder.foreign()
        builder.start(name, attributes, closed)
        if name in RAW and not empty:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at) if name != "plaintext" else None
            data = page[at : close.start() if close else n]
            if data:
                builder.text(html.unescape(data) if name in ("textarea", "title") else data)
            at = close.end() if close else n
            builder.end(name)
    return builder.root


class Sheet:
    """The rules of a page's style sheets on what is displayed and visible."""

    def __init__(self, root: Node) -> None:
        self.rules: dict[str, list[tuple]] = {}  # by the last name of the selector
        stack, order = [root], 0
        sheets = []
        while stack:
            node = stack.pop()
            if node.name == "style":
                sheets.append("".join(c for c in node.children if isinstance(c, str)))
            elif node.name not in RAW:
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        for text in sheets:
            if "display" not in text and "visibility" not in text:
                continue
            text = re.sub(r"/\*.*?(?:\*/|\Z)", "", text, flags=re.S)
            text = re.sub(r"@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*(?:\}|\Z))", "", text)
            for selectors, body in RULE.findall(text):
                said = [(k.lower(), v.lower(), bool(i)) for k, v, i in DECLARED.findall(body)]
                for selector in selectors.split(",") if said else ():
                    order += 1
                    self._add(selector.strip(), said, order)

    def _add(self, selector: str, said: list[tuple[str, str, bool]], order: int) -> None:
        last = re.split(r"[\s>+~]+", selector)[-1]
        alone = last == selector
        bare = re.sub(r"::?[\w-]+(?:\([^)]*\))?|\[[^\]]*\]", "", last)
        m = SIMPLE.fullmatch(bare)
        if not m or not selector or "::" in last:
            return
        exact = alone and bare == last
        said = [d for d in said if exact or d[1] not in ("none", "hidden", "collapse")]
        tag = (m.group(1) or "*").lower()
        parts = re.findall(r"[.#][\w-]+", m.group(2))
        weight = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), int(tag != "*"))
        # a longer selector outweighs here, as only what shows is left of it
        weight = weight if exact else (weight[0] + 1, *weight[1:])
        if said:
            self.rules.setdefault(parts[-1] if parts else tag, []).append((tag, frozenset(parts), weight, order, said))

    def said(self, node: Node) -> dict[str, str]:
        """``display`` and ``visibility`` as declared for an element."""
        best: dict[str, tuple] = {}
        a = node.attributes
        if self.rules:
            names = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if a.get("id") else set())
            for key in (*names, node.name, "*"):
                for tag, parts, weight, order, said in self.rules.get(key, ()):
                    if tag in ("*", node.name) and parts <= names:
                        for k, v, important in said:
                            best[k] = max(best.get(k, ()), (important, 0, weight, order, v))
        if "style" in a:
            for i, (k, v, important) in enumerate(DECLARED.findall(a["style"])):
                k = k.lower()
                best[k] = max(best.get(k, ()), (bool(important), 1, (0, 0, 0), i, v.lower()))
        return {k: v[-1] for k, v in best.items()}

    def shown(self, node: Node, hidden: bool) -> tuple[bool, bool]:
        """(whether an element is rendered at all, whether its own text is hidden)."""
        a = node.attributes
        if node.name in NEVER_SHOWN:
            return False, hidden
        said = self.said(node) if "style" in a or self.rules else {}
        display = said.get("display")
        if display is None and ("hidden" in a and a["hidden"].lower() != "until-found" or node.name == "dialog" and "open" not in a):
            return False, hidden
        if "visibility" in said and said["visibility"] != "inherit":
            hidden = said["visibility"] in ("hidden", "collapse")
            if said["visibility"] == "collapse" and node.name in ("tr", "tbody", "thead", "tfoot"):
                return False, hidden
        return display != "none", hidden


def field_text(node: Node) -> str:
    """What a form field shows: its value, or what stands in its place."""
    a, kind = node.attributes, node.attributes.get("type", "text").strip().lower()
    if kind == "image":
        return a.get("alt", "")
    if kind in SHOWN_INPUTS or kind not in ("hidden", "checkbox", "radio", "file", "password", "range", "color"):
        return a.get("value") or ("" if kind in ("submit", "button", "reset") else a.get("placeholder", ""))
    return ""


def width(text: str) -> int:
    """Columns a line takes: wide East Asian letters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Collects rendered lines; blanks collapse, and blank lines between blocks never add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.pending_blank = False
        self.gap = 0
        self.prefixes: list[str] = []
        self.mark: str | None = None

    def text(self, data: str, preformatted: bool) -> None:
        if preformatted:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in rest:
                self.line(True)
                self._add(line)
            return
        words = BLANKS.split(data)
        for i, w in enumerate(words):
            if i:
                self.pending_blank = True
            if w:
                self._add(w, bool(self.now) and self.pending_blank)
                self.pending_blank = False

    def _add(self, text: str, blank: bool = False) -> None:
        if text:
            self.now.append(f" {text}" if blank else text)

    def line(self, forced: bool = False) -> None:
        """Ends the line if it has anything, or anyway."""
        self.pending_blank = False
        if not self.now and not forced:
            return
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.prefixes)
        if self.mark is not None:
            indent, self.mark = "".join(self.prefixes[:-1]) + self.mark, None
        self.lines.append((indent + "".join(self.now)).rstrip(" \t"))
        self.now = []

    def space(self) -> None:
        """At least one blank line before what comes."""
        self.line()
        self.gap = 1

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.now = [line]
            self.line(True)


def _rows(node: Node, sheet: Sheet, hidden: bool) -> Iterator[tuple[str, Node, bool]]:
    """Rows and captions of a table in order of show (head, bodies, foot), and whether they are hidden."""
    parts = {"thead": [], "tbody": [], "tfoot": []}
    for child in node.children:
        if isinstance(child, Node):
            shown, h = sheet.shown(child, hidden)
            if not shown:
                continue
            if child.name == "caption":
                yield "caption", child, h
            elif child.name == "tr":
                parts["tbody"].append((child, h))
            elif child.name in parts:
                rows = [(c, *sheet.shown(c, h)) for c in child.children if isinstance(c, Node) and c.name == "tr"]
                parts[child.name] += [(c, k) for c, ok, k in rows if ok]
    for rows in parts.values():
        for row, h in rows:
            yield "tr", row, h


def _span(cell: Node, name: str) -> int:
    try:
        return max(1, min(int(cell.attributes.get(name, "1")), 1000))
    except ValueError:
        return 1


def render_table(node: Node, depth: int, sheet: Sheet, hidden: bool) -> list[str]:
    """Captions, then rows of cells in aligned columns; a cell may have several lines."""
    out: list[str] = []
    grid: list[list[tuple[int, int, list[str]]]] = []  # rows of (column, span, lines)
    taken: dict[int, int] = {}
    for kind, item, h in _rows(node, sheet, hidden):
        if kind == "caption":
            out += render(item, depth + 1, sheet, h)
            continue
        row, column, later = [], 0, {}
        for cell in item.children:
            if not isinstance(cell, Node):
                continue
            shown, covered = sheet.shown(cell, h)
            if not shown:
                continue
            while taken.get(column, 0):
                column += 1
            across, down = _span(cell, "colspan"), _span(cell, "rowspan")
            row.append((column, across, render(cell, depth + 1, sheet, covered) or [""]))
            for c in range(column, column + across):
                later[c] = down
            column += across
        taken = {c: n - 1 for c, n in ({c: taken.get(c, 0) for c in taken} | later).items() if n > 1}
        if row:
            grid.append(row)
    widths: dict[int, int] = {}
    for row in grid:
        for column, across, lines in row:
            if across == 1:
                widths[column] = max(widths.get(column, 0), max(map(width, lines)))
            else:
                for c in range(column, column + across):
                    widths.setdefault(c, 0)
    for row in grid:
        for i in range(max(len(lines) for _, _, lines in row)):
            line, at = "", 0
            for column, across, lines in row:
                start = sum(widths[c] + 2 for c in sorted(widths) if c < column)
                piece = lines[i] if i < len(lines) else ""
                if piece:
                    line += " " * max(start - at, 2 if line else 0) + piece
                    at = max(start, at + 2 if at else start) + width(piece)
            out.append(line.rstrip())
    return out


def labels(svg: Node, sheet: Sheet, hidden: bool) -> list[tuple[Node, bool]]:
    """The texts and embedded HTML of a drawing as blocks, and whether they are hidden."""
    out, stack = [], [(c, hidden) for c in svg.children[::-1]]
    while stack:
        node, h = stack.pop()
        if not isinstance(node, Node) or node.name in SVG_STORE or node.attributes.get("display") == "none":
            continue
        if "visibility" in node.attributes:
            h = node.attributes["visibility"] in ("hidden", "collapse")
        shown, inner = sheet.shown(node, h)
        if not shown:
            continue
        if node.name in ("text", "foreignobject"):
            out.append((Node("div", {}, [node]), h))
        else:
            stack += [(c, inner) for c in node.children[::-1]]
    return out


MOST_DEPTH = 60


def _number(node: Node, name: str, default: int) -> int:
    try:
        return int(node.attributes.get(name, default))
    except ValueError:
        return default


def render(root: Node, depth: int = 0, sheet: Sheet | None = None, hidden: bool = False) -> list[str]:
    """The lines of an element's visible text."""
    out, sheet = Lines(), sheet or Sheet(root)
    # walked with a stack of its own: (node, whether leaving, preformatted, whether text is hidden)
    stack: list[tuple] = [(c, False, root.name in PREFORMATTED, hidden) for c in reversed(root.children)]
    counters: list[list[int] | None] = []  # next number and step
    while stack:
        node, leaving, pre, hidden = stack.pop()
        if not isinstance(node, Node):
            if not hidden:
                out.text(node, pre)
            continue
        name = node.name
        if leaving:
            if name == "li" or name == "dd" or name == "blockquote":
                out.line()
                if out.mark is not None:  # an item without text keeps its line
                    out.line(True)
                out.prefixes.pop()
            if name in ("ul", "ol", "menu", "dir"):
                counters.pop()
                out.line()
                if not counters:
                    out.space()
                continue
            if name in SPACED:
                out.space()
            elif name in BLOCK:
                out.line()
            elif name in ("td", "th"):
                out.pending_blank = True
            continue
        shown, hidden = sheet.shown(node, hidden)
        if not shown:
            continue
        if name == "br":
            out.line(True)
            continue
        if name in ("img", "input"):
            said = node.attributes.get("alt", "") if name == "img" else field_text(node)
            if said.strip() and not hidden:
                out.text(said, False)
            continue
        if name == "hr":
            out.space()
            continue
        if name == "wbr":
            continue
        if name == "table" and depth < MOST_DEPTH:
            out.space()
            out.block(render_table(node, depth, sheet, hidden))
            out.space()
            continue
        if name in ("ul", "ol", "menu", "dir"):
            out.line()
            if not counters:
                out.space()
            down = name == "ol" and "reversed" in node.attributes
            items = sum(isinstance(c, Node) and c.name == "li" for c in node.children) if down else 1
            counters.append([_number(node, "start", items), -1 if down else 1] if name == "ol" else None)
        elif name in SPACED:
            out.space()
        elif name in BLOCK:
            out.line()
        if name == "li":
            counter = counters[-1] if counters else None
            text = "- "
            if counter is not None:
                now = _number(node, "value", counter[0])
                text, counter[0] = f"{now}. ", now + counter[1]
            out.mark = " " * len(text) if hidden else text
            out.prefixes.append(" " * len(text))
        elif name in ("dd", "blockquote"):
            out.prefixes.append("    " if name == "dd" else "> ")
        inner = pre or name in PREFORMATTED or bool(PRE_STYLE.search(node.attributes.get("style", "")))
        stack.append((node, True, pre, hidden))
        if name == "svg":
            stack += [(c, False, inner, h) for c, h in reversed(labels(node, sheet, hidden))]
            continue
        children = node.children
        if name == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        if name in MATH_PARTS:
            children = [x for c in children for x in (c, " ")][:-1]
        if name in PREFORMATTED and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        stack += [(c, False, inner, hidden) for c in reversed(children)]
    out.line()
    return out.lines


def page_text(page: str | None) -> str:
    """All visible text of a page."""
    return "\n".join(render(parse(page or "")))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every whole page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "html"):
                texts = pa.array([page_text(p) for p in rows.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lean(extract), "page_id long, url string, text string")


def op1_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
