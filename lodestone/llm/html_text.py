"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules, and a renderer of blocks, lists and tables.

Every visible piece of text is emitted, in order. Blocks stand on lines of their own, with an empty line where the usual style
has a margin; list items carry their marker and indent; table cells are aligned in columns; preformatted text keeps its white space.
Not visible: what is never rendered (head, script, style, template ...), the hidden attribute, display:none and visibility:hidden in
style attributes or in the page's own style rules on a tag, classes or an id (in at-rule blocks, those that hold on any screen), closed details and dialogs.

Style rules are weighed as style sheets are: important ones first, then by the parts of their selector, then by order.

No scripts run, so noscript content shows. A line is indented by INDENT columns at most, so deep lists don't grow without bound. Parsing takes time in proportion to the
page, however broken it is; tables in tables take it once for each line and level.

Defined results: a null or empty page has the empty text; pages of any length are whole; broken markup never fails: unknown
tags are inline, stray end tags are ignored, what is open at the end is closed; rows are rendered row by row, repeated or
not; null ids stay null; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDENT = 256

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ESCAPABLE = frozenset(("textarea", "title"))
UNSEEN = frozenset("head script style template title meta link base noembed noframes iframe audio video canvas object datalist rp area param source track".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp caption".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul dir listing xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr listing main menu nav ol p pre search section summary table ul dd dt li plaintext xmp".split()
)
#: A start tag ends the open elements named here, up to one of the limits.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, {"html"}),
}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption"))

_OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ASIDE = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z))", re.S)
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_MARK = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_ON_SCREEN = re.compile(r"(?:(?:only\s+)?(?:all|screen)|not\s+print)?")
_COMPOUND = re.compile(r"(?:([a-zA-Z][\w-]*)|\*)?((?:[.#][\w-]+)*)\Z")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class _Ends:
    """Where tags end. Each quote that a search passed in vain is remembered, so that no text is searched again and again."""

    def __init__(self, page: str):
        self.page, self.vain, self.last = page, set(), page.rfind(">")

    def of(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose name ends here: outside quotes, or the next one where that fails; -1: there is none."""
        start, passed = at, []
        while at <= self.last:
            m = _STOP.search(self.page, at)
            if m[0] == ">":
                return m.start()
            quote = m.start()
            if quote in self.vain:
                break
            passed.append(quote)
            at = self.page.find(m[0], quote + 1) + 1
            if not at:
                break
        self.vain.update(passed)
        return self.page.find(">", start) if start <= self.last else -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds text, start, end. Raw elements give their content as one text."""
    at, size, lower, ends = 0, len(page), None, _Ends(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            yield "text", unescape(page[at:]), ""
            return
        m = _OPENING.match(page, tag)
        end = ends.of(m.end()) + 1 if m else other.end() if (other := _ASIDE.match(page, tag)) else 0
        if not end:  # a bare "<" is text
            end = page.find("<", tag + 1)
            end = size if end < 0 else end
            yield "text", unescape(page[at:end]), ""
            at = end
            continue
        if tag > at:
            yield "text", unescape(page[at:tag]), ""
        at = end
        if m is None:
            continue
        name = m[2].lower()
        yield ("end" if m[1] else "start"), name, page[m.end() : end - 1]
        if name in RAW and not m[1]:
            lower = page.lower() if lower is None or len(lower) != size else lower
            end = (page if len(lower) != size else lower).find(f"</{name}", at)
            end = size if end < 0 else end
            if end > at:
                yield "text", unescape(page[at:end]) if name in ESCAPABLE else page[at:end], ""
            at = end


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Open:
    """The open elements, and where those of each tag stand."""

    def __init__(self, root: Node):
        self.stack: list[Node | None] = [root]  # None: closed, while blocks that began inside are open
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def holds(self, tag: str) -> bool:
        return bool(self.at.get(tag))

    def _last(self, tags) -> int:
        return max((held[-1] for t in tags if (held := self.at.get(t))), default=0)

    def pop(self) -> None:
        node = self.stack.pop()
        if node is not None:
            self.at[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def close(self, names, limits) -> bool:
        """Close the innermost element named, unless a limit is open inside it."""
        k = self._last(names)
        if not k or self._last(limits) > k:
            return False
        if self.stack[k].tag in FORMATTING and self.blocks and self.blocks[-1] > k:
            self.at[self.stack[k].tag].pop()
            self.stack[k] = None
            return True
        while len(self.stack) > k:
            self.pop()
        while self.stack[-1] is None:
            self.stack.pop()
        return True


_HEADINGS = tuple(f"h{i}" for i in range(1, 7))


def build(page: str) -> Node:
    """The tree of a page, below a root named html."""
    root = Node("html", {})
    open_ = _Open(root)
    for kind, name, rest in tokens(page):
        if kind == "text":
            if open_.top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not name.strip(" \t\n\r\f"):
                continue
            open_.top.children.append(name)
        elif kind == "start":
            if name == "html" or (name == "body" and open_.holds("body")):
                continue
            if name in CLOSES_P:
                open_.close(("p",), ("td", "th", "caption", "table", "button", "object"))
            if (implied := IMPLIED_ENDS.get(name)) is not None:
                while open_.close(*implied):
                    pass
            if name in ("td", "th") and open_.top.tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", {})
                open_.top.children.append(row)
                open_.push(row)
            if name not in TABLE_PARTS and open_.top.tag == "head" and name in BLOCKS:
                open_.close(("head",), ())
            node = Node(name, attributes(rest) if rest else {})
            open_.top.children.append(node)
            if name not in VOID and not (rest.endswith("/") and name in ("svg", "path")):
                open_.push(node)
        elif name == "br":
            open_.top.children.append(Node("br", {}))
        elif name == "p" and not open_.holds("p"):
            open_.top.children.append(Node("p", {}))
        elif name in _HEADINGS:
            open_.close(_HEADINGS, ("table", "td", "th"))
        elif name not in ("html", "body"):
            open_.close((name,), ("table",) if name in TABLE_PARTS else ("td", "th", "caption") if name != "table" else ())
    return root


def _applies(prelude: str) -> bool:
    """Whether the rules in an at-rule's block hold on any screen; blocks of other at-rules hold no style rules, or depend on sizes."""
    name, _, condition = re.sub(r"^@([\w-]+)", r"\1 ", prelude.lower()).partition(" ")
    if name == "media":
        return any(_ON_SCREEN.fullmatch(query.strip()) for query in condition.split(","))
    return name == "layer" or (name == "supports" and not condition.strip().startswith("not"))


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the style rules that hold on a screen, by balanced braces; rules nested in style rules are left out."""
    sheet = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
    # Open blocks: True if the rules inside apply, False if not, None for a style rule.
    opened: list[bool | None] = [True]
    start, selectors, own = 0, "", []
    for m in _MARK.finditer(sheet):
        before = sheet[start : m.start()]
        if m[0] == "{":
            prelude = before.strip()
            if opened[-1] is not True:
                opened.append(False)
            elif prelude.startswith("@"):
                opened.append(_applies(prelude))
            else:
                opened.append(None)
                selectors, own = prelude, []
        elif m[0] == "}":
            if len(opened) > 1 and opened.pop() is None:
                yield selectors, ";".join([*own, before])
        elif m[0] != ";" or (opened[-1] is not None and not before.lstrip().startswith("@")):
            continue
        elif opened[-1] is None:
            own.append(before)
        start = m.end()
    if opened[-1] is None:
        yield selectors, ";".join([*own, sheet[start:]])


def _declared(style: str) -> tuple[tuple[bool, bool] | None, tuple[bool, str] | None]:
    """Of declarations: (important, not displayed) and (important, visibility), each as the last that counts says, or None."""
    gone = seen = None
    for m in _DECLARATION.finditer(style.lower()):
        important = m[3] is not None
        if m[1] == "display" and not (gone and gone[0] and not important):
            gone = (important, m[2] == "none")
        elif m[1] == "visibility" and m[2] in ("hidden", "collapse", "visible") and not (seen and seen[0] and not important):
            seen = (important, m[2])
    return gone, seen


class Rules:
    """The page's own style rules that hide or show: selectors of a tag, classes and ids, without combinators."""

    def __init__(self, root: Node):
        #: By an id, a class or a tag that a rule needs: (weight, tag, classes, ids, display, visibility).
        self.rules: dict[str, list[tuple]] = {}
        self.known: dict[tuple, tuple] = {}
        self.count = 0
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style" and any(_ON_SCREEN.fullmatch(q.strip()) for q in node.attributes.get("media", "").lower().split(",")):
                self._add("".join(c for c in node.children if isinstance(c, str)))
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def _add(self, sheet: str) -> None:
        for selectors, style in style_rules(sheet):
            gone, seen = _declared(style)
            if gone is None and seen is None:
                continue
            for selector in selectors.split(","):
                if (c := _COMPOUND.match(selector.strip())) is None:
                    continue
                parts = re.findall(r"[.#][\w-]+", c[2])
                ids, classes = frozenset(p[1:] for p in parts if p[0] == "#"), frozenset(p[1:] for p in parts if p[0] == ".")
                tag = c[1].lower() if c[1] else None
                self.count += 1
                weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), tag is not None, self.count)
                key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag or "*"
                self.rules.setdefault(key, []).append((weight, tag, classes, ids, gone, seen))

    def _ruled(self, tag: str, name: str | None, classes: str) -> tuple:
        """What rules say of an element: the heaviest (important, weight, value) for display and for visibility, or None."""
        if (found := self.known.get((tag, name, classes))) is None:
            held = set(classes.split())
            keys = {f".{c}" for c in held} | {tag, "*"} | ({f"#{name}"} if name is not None else set())
            gone = seen = None
            for weight, needs, need_classes, ids, hides, sees in (r for k in keys for r in self.rules.get(k, ())):
                if (needs is None or needs == tag) and need_classes <= held and ids <= {name}:
                    gone = max(gone, (hides[0], weight, hides[1])) if hides and gone else (hides[0], weight, hides[1]) if hides else gone
                    seen = max(seen, (sees[0], weight, sees[1])) if sees and seen else (sees[0], weight, sees[1]) if sees else seen
            found = self.known[tag, name, classes] = (gone, seen)
        return found

    def of(self, node: Node) -> tuple[bool, str | None]:
        """(not displayed, visibility)."""
        own = node.attributes
        gone, seen = "hidden" in own and own["hidden"].lower() != "until-found", None
        ruled = self._ruled(node.tag, own.get("id"), own.get("class", "")) if self.rules else (None, None)
        said = _declared(own["style"]) if own.get("style") else (None, None)
        # An element's own style outweighs rules that aren't important.
        first, second = (s if s and (not r or s[0] or not r[0]) else r for s, r in zip(said, ruled, strict=True))
        return (first[-1] if first else gone), (second[-1] if second else seen)


class _Page:
    """Lines in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent: list[int] = []
        self.columns = 0  # the sum of the indents
        self.marker = ""

    def deeper(self, columns: int) -> None:
        self.indent.append(columns)
        self.columns += columns

    def back(self) -> None:
        self.columns -= self.indent.pop()

    def flow(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text == " " or not text:
            self.space = self.space or (bool(text) and bool(self.line))
            return
        if (self.space or text[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(text.strip(" "))
        self.space = text[-1] == " "

    def literal(self, text: str) -> None:
        first, *others = text.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for other in others:
            self.end(True)
            self.line.append(other)

    def end(self, always: bool = False) -> None:
        """End the line; always: an empty one counts."""
        text = "".join(self.line)
        if text.strip(" ") or (always and not self.marker):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            head = " " * min(self.columns, INDENT)
            if self.marker:
                head = head[: max(0, len(head) - len(self.marker))] + self.marker
                self.marker = ""
            self.lines.append((head + text).rstrip(" ") if text.strip(" ") else "")
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or (spaced and bool(self.lines))


def _marker(node: Node, counters: dict[int, int], parent: Node) -> str:
    if parent.tag != "ol":
        return "- "
    value = node.attributes.get("value", "")
    counters[id(parent)] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else counters.get(id(parent), int(s) - 1 if re.fullmatch(r"-?\d{1,9}", s := parent.attributes.get("start", "")) else 0) + 1
    return f"{counters[id(parent)]}. "


def _run(task: Generator) -> list[str]:
    """Run a renderer that yields renderers of what is inside and gets their lines: nesting takes no stack of the language."""
    tasks, lines = [task], None
    while tasks:
        try:
            tasks.append(tasks[-1].send(lines))
            lines = None
        except StopIteration as done:
            tasks.pop()
            lines = done.value
    return lines


def _lines(top: Node, rules: Rules, seen: bool) -> Generator:
    """Render what is below a node; the result is a list of lines."""
    page, counters, pre = _Page(), {}, 0
    #: (node or text, its parent, visible, or None to leave the node)
    stack: list[tuple] = [(c, top, seen) for c in reversed(top.children)]
    while stack:
        node, parent, visible = stack.pop()
        if isinstance(node, str):
            if visible:
                page.literal(node) if pre else page.flow(node)
            continue
        tag = node.tag
        if visible is None:  # leave
            page.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and page.indent))
            if tag in ("pre", "textarea", "listing", "xmp"):
                pre -= 1
            if tag in ("li", "dd", "blockquote"):
                if tag == "li" and page.marker:
                    page.line.append("")
                    page.marker = ""
                page.back()
            continue
        if tag in UNSEEN or (tag == "input" and node.attributes.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in node.attributes):
            continue
        gone, own = rules.of(node)
        if gone:
            continue
        visible = visible if own is None else own == "visible"
        if tag == "br":
            page.end(True) if page.line or page.lines and not page.gap else None
            continue
        if tag == "hr":
            page.block(True)
            if visible:
                page.line.append("---")
            page.block(True)
            continue
        if tag == "input" and visible and node.attributes.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number") and node.attributes.get("value"):
            page.flow(f" {node.attributes['value']} ")
            continue
        if tag == "table":
            page.block(True)
            for line in (yield _table(node, rules, visible)):
                page.line.append(line)
                page.end(True)
            page.block(True)
            continue
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in BLOCKS or tag == "textarea":
            page.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and page.indent))
            if tag == "li":
                page.marker = _marker(node, counters, parent)
                page.deeper(len(page.marker))
            elif tag in ("dd", "blockquote"):
                page.deeper(2)
            elif tag in ("pre", "textarea", "listing", "xmp"):
                pre += 1
                if children and isinstance(children[0], str):
                    children = [children[0].removeprefix("\n"), *children[1:]]
            stack.append((node, parent, None))
        elif tag == "q" and visible:
            children = ['"', *children, '"']
        stack += [(c, node, visible) for c in reversed(children)]
    page.end()
    return page.lines


class _Grid:
    """Columns that cells from rows above still fill, as spans: start, end, the row that is free again."""

    def __init__(self):
        self.row, self.spans = 0, []

    def next_row(self) -> None:
        self.row += 1
        self.spans = [x for x in self.spans if x[2] > self.row]

    def free(self, column: int) -> int:
        """The first free column from here on."""
        for start, end, _ in self.spans:
            if start <= column < end:
                column = end
            elif start > column:
                break
        return column

    def fill(self, fresh: list[tuple[int, int, int]]) -> None:
        """Cells of this row that reach into later ones; neighbours that end together are one span."""
        spans: list[list[int]] = []
        for start, end, until in sorted([*self.spans, *fresh]):
            if spans and spans[-1][1] == start and spans[-1][2] == until:
                spans[-1][1] = end
            else:
                spans.append([start, end, until])
        self.spans = [tuple(x) for x in spans]


def _number(text: str, most: int) -> int:
    digits = text.strip()
    return max(1, min(most, int(digits[:9]) if len(digits.lstrip("0")) < 9 else most)) if re.fullmatch(r"[0-9]+", digits) else 1


def _table(table: Node, rules: Rules, seen: bool) -> Generator:
    """Rows of a table with cells aligned; a caption stands above; cells may hold blocks and span columns and rows."""
    out: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []  # of each row: (column, span, lines)
    grid = _Grid()
    todo = [(c, seen) for c in reversed(table.children)]
    while todo:
        node, visible = todo.pop()
        if isinstance(node, str):
            if visible and node.strip(" \t\n\r\f"):
                rows.append([(0, 1, [_SPACE.sub(" ", node).strip(" ")])])
            continue
        gone, own = rules.of(node)
        if gone or node.tag in UNSEEN:
            continue
        visible = visible if own is None else own == "visible"
        if node.tag in ("tbody", "thead", "tfoot"):
            todo += [(c, visible) for c in reversed(node.children)]
        elif node.tag == "caption":
            out += yield _lines(node, rules, visible)
        elif node.tag == "tr":
            row, column, fresh = [], 0, []
            for cell in node.children:
                if isinstance(cell, str):
                    if not visible or not cell.strip(" \t\n\r\f"):
                        continue
                    cell = _around(cell)
                hidden, own_cell = rules.of(cell)
                if hidden or cell.tag in UNSEEN:
                    continue
                column = grid.free(column)
                span, deep = _number(cell.attributes.get("colspan", ""), 1000), _number(cell.attributes.get("rowspan", ""), 65534)
                lines = yield _lines(cell if cell.tag in ("td", "th") else _around(cell), rules, visible if own_cell is None else own_cell == "visible")
                row.append((column, span, lines))
                if deep > 1:
                    fresh.append((column, column + span, grid.row + deep))
                column += span
            grid.fill(fresh)
            grid.next_row()
            rows.append(row)
        else:
            rows.append([(0, 1, (yield _lines(_around(node), rules, visible)))])
    # Only columns in which a cell ends have a width: they are numbered in order.
    last = {c: k for k, c in enumerate(sorted({c + s - 1 for row in rows for c, s, _ in row}))}
    edges = list(last)
    width = [0] * len(last)
    longest = lambda lines: max(map(len, lines), default=0)
    for row in rows:
        for c, span, lines in row:
            if span == 1:
                width[last[c]] = max(width[last[c]], longest(lines))
    for row in rows:
        for c, span, lines in row:
            if span > 1:  # the last column takes what the others don't hold
                others = [w for w in width[bisect_left(edges, c) : last[c + span - 1]] if w]
                width[last[c + span - 1]] = max(width[last[c + span - 1]], longest(lines) - sum(others) - 2 * len(others))
    begins, at = [], 0
    for w in width:
        begins.append(at)
        at += w + 2 if w else 0
    start = {c: begins[k] if (k := bisect_left(edges, c)) < len(begins) else at for row in rows for c, _, _ in row}
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for c, _, lines in row:
                if k < len(lines) and lines[k]:
                    line = line.ljust(start[c]) + lines[k]
            out.append(line.rstrip(" "))
    while out and not out[-1]:
        out.pop()
    return out


def _around(inner: Node | str) -> Node:
    node = Node("td", {})
    node.children.append(inner)
    return node


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    root = build(page)
    return "\n".join(_run(_lines(root, Rules(root), True))).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([render(x.as_py()) for x in batch["html"]], pa.string())], names=["id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, "id long, text string")
