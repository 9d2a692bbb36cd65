"""HTML extraction by layout-aware rendering.

A small tree builder applies the implied-tag rules of HTML (paragraphs, list
items, table parts, void and raw-text elements); visibility rules drop what a browser
does not show: head matter, scripts, the hidden attribute, closed details and dialogs, and what display and
visibility say, cascaded from style attributes and from style sheets for all screens (selectors of tags, ids, classes
and attributes below one another). A visible element in an invisible one is shown. The rest
is laid out as text: blocks on lines of their own, blank lines around paragraphs,
bullets and numbers for lists, table cells aligned by column, with spans, pre kept as it is.

Edge cases: null html gives null text, empty html an empty text; long pages are rendered whole; an empty table gives no rows; broken markup
never fails (stray end tags are ignored, open elements are closed at the end);
elements nested deeper than MAX_DEPTH are laid out at that depth, and a hidden one hides all it holds; repeated rows are
rendered one by one; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

MAX_DEPTH = 150
#: A table is laid out in columns up to so many characters for each one of its text.
MOST_PADDING = 20
BATCH_ROWS = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = PARAGRAPH | frozenset("html body div section article aside header footer nav main address form fieldset figcaption details summary li dt dd tr caption center dir menu legend".split())
CLOSES_P = (BLOCK | frozenset(["plaintext"])) - frozenset("html body li dt dd tr caption legend summary figcaption".split())
#: A start tag closes these open elements, up to the nearest of the bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
HEAD_ONLY = frozenset("meta link base title style script noscript template head".split())
SCOPE = frozenset("table td th caption html body button".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
CSS_MARK = re.compile(r"[{};]")
#: Conditions of @media that hold on every screen.
SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*", re.I)
SHOWING = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
#: Parts of selectors that are understood.
COMPOUND = re.compile(r"(?:\*|[\w-]+)?(?:[.#][\w-]+|\[[^\]]*\])*")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "looks")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent
        self.looks: tuple[bool, bool | None] | None = None  # displayed, and visible where it says so itself


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source) if source else ():
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class Open:
    """The open elements: tag, the node that gets their content, and whether text in them is lost; the nearest of a tag is found at once."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.push("html", root, False)

    def push(self, tag: str, node: Node, mute: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, mute))

    def pop(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            self.places[self.stack.pop()[0]].pop()

    def nearest(self, tags: set | frozenset) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close_to(self, wanted: set | frozenset, bounds: set | frozenset) -> bool:
        at = self.nearest(wanted)
        if at == 0 or at < self.nearest(bounds):
            return False
        self.pop(at)
        return True


def build(source: str, sheet: Sheet) -> tuple[Node, list[str], bool]:
    """The tree of a page, its style sheets, and whether it is deeper than MAX_DEPTH.

    An element past that depth is an empty child of the last one above it, and what it holds follows; unless it is hidden, then that is left out.
    """
    root = Node("html", {})
    open_, styles, at, deep = Open(root), [], 0, False
    stack = open_.stack

    def text(start: int, end: int) -> None:
        if end > start:
            value = source[start:end]
            if stack[-1][0] == "head" and value.strip():
                open_.pop(len(stack) - 1)
            if not stack[-1][2]:
                stack[-1][1].children.append(html.unescape(value) if "&" in value else value)

    while found := TOKEN.search(source, at):
        text(at, found.start())
        at = found.end()
        if not (name := found[2]):
            continue
        tag = name.lower()
        if found[1]:
            if tag == "p" and not open_.places.get("p"):
                stack[-1][1].children.append(Node("p", {}, stack[-1][1]))
            elif tag not in VOID and tag not in ("html", "body"):
                open_.close_to({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset(["html"] + ["table"] * (tag != "table")))
            continue
        if tag == "html":
            root.attributes |= {k: v for k, v in attributes_of(found[3]).items() if k not in root.attributes}
            continue
        if stack[-1][0] == "head" and tag not in HEAD_ONLY:
            open_.pop(len(stack) - 1)
        if tag in CLOSES_P:
            open_.close_to({"p"}, SCOPE)
        if tag in IMPLIED:
            wanted, bounds = IMPLIED[tag]
            while open_.close_to(wanted, bounds):
                pass
        if tag in ("td", "th") and stack[-1][0] in ("table", "tbody", "thead", "tfoot") and len(stack) < MAX_DEPTH:
            row = Node("tr", {}, stack[-1][1])
            row.parent.children.append(row)
            open_.push("tr", row, stack[-1][2])
        node = Node(tag, attributes_of(found[3]), stack[-1][1])
        node.parent.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            raw = source[at : end.start() if end else len(source)]
            at = end.end() if end else len(source)
            if tag == "style":
                if on_screen(node.attributes.get("media", "")):
                    styles.append(raw)
            elif tag in ("title", "textarea"):
                node.children.append(html.unescape(raw))
            else:
                node.children.append(raw)
        elif tag not in VOID and not found[3].endswith("/"):
            mute = stack[-1][2]
            if len(stack) < MAX_DEPTH:
                open_.push(tag, node, mute)
                continue
            deep = True
            displayed, visible = sheet.looks(node)
            open_.push(tag, node.parent, mute or not displayed or visible is False)
    text(at, len(source))
    return root, styles, deep


def on_screen(media: str) -> bool:
    """Whether a list of media conditions holds on every screen."""
    return not media.strip() or any(SCREEN.fullmatch(f"@media {m.strip()}") for m in media.split(","))


def rules_of(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on every screen; those in other at-rules are left out."""
    outer: list[tuple[str, int]] = []  # open blocks, and where they begin
    begin, sheet = 0, CSS_COMMENT.sub(" ", sheet)
    for found in CSS_MARK.finditer(sheet):
        before, begin = sheet[begin : found.start()], found.end()
        if found[0] == "{":
            outer.append((before.strip(), found.end()))
        elif found[0] == "}" and outer:
            head, start = outer.pop()
            if not head.startswith("@") and all(h.lower().startswith("@media") and on_screen(h[6:]) for h, _ in outer):
                yield head, sheet[start : found.start()]


class Compound:
    """One part of a selector: a tag, ids, classes and attributes that an element must have."""

    def __init__(self, source: str):
        self.tag = re.match(r"[\w-]*", source)[0].lower()
        self.ids, self.classes = re.findall(r"#([\w-]+)", source), re.findall(r"\.([\w-]+)", re.sub(r"\[[^]]*\]", "", source))
        self.attributes = [(n.lower(), (a or b or c) if eq else None) for n, eq, a, b, c in re.findall(r"\[\s*([\w-]+)\s*(=)?\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*\]", source)]
        self.weight = len(self.ids), len(self.classes) + len(self.attributes), int(bool(self.tag))
        self.key = "#" + self.ids[0] if self.ids else "." + self.classes[0] if self.classes else self.tag or "*"

    def fits(self, node: Node) -> bool:
        a = node.attributes
        return (
            self.tag in ("", node.tag)
            and all(a.get("id") == i for i in self.ids)
            and (not self.classes or set(self.classes) <= set(a.get("class", "").split()))
            and all(n in a and v in (None, a[n]) for n, v in self.attributes)
        )


class Sheet:
    """What style sheets say on display and visibility. Selectors are compounds with descendant and child combinators; others are left out."""

    def __init__(self, styles: list[str]):
        self.rules: dict[str, list] = {}
        n = 0
        for source in styles:
            for selectors, body in rules_of(source):
                for name, value, forced in SHOWING.findall(body) if selectors else ():
                    for selector in selectors.split(","):
                        n += 1
                        parts = re.findall(r">|[^\s>]+", selector)
                        if parts and ">" not in (parts[0], parts[-1]) and all(p == ">" or COMPOUND.fullmatch(p) for p in parts):
                            chain = [(">" if i and parts[i - 1] == ">" else " ", Compound(p)) for i, p in enumerate(parts) if p != ">"]
                            weight = tuple(map(sum, zip(*(c.weight for _, c in chain))))
                            self.rules.setdefault(chain[-1][1].key, []).append((chain, (bool(forced), False, weight, n), name.lower(), value.lower()))

    def fits(self, node: Node, chain: list) -> bool:
        if not chain[-1][1].fits(node):
            return False
        found = [node]
        for (how, _), (_, part) in zip(chain[:0:-1], chain[-2::-1]):
            if how == ">":
                up = [n.parent for n in found if n.parent]
            else:  # the lowest element that fits has the most ancestors
                up, n = [], found[0].parent
                while n:
                    up.append(n)
                    n = n.parent
            found = [n for n in up if part.fits(n)]
            if not found:
                return False
        return True

    def looks(self, node: Node) -> tuple[bool, bool | None]:
        """Whether an element is displayed, and whether it is visible if it says so itself."""
        if node.looks is None:
            a, best = node.attributes, {}
            keys = ["*", node.tag, f"#{a.get('id')}", *(f".{c}" for c in set(a.get("class", "").split()))] if self.rules else []
            said = [(rank, name, value) for k in keys for chain, rank, name, value in self.rules.get(k, ()) if self.fits(node, chain)]
            if "style" in a:
                said += [((bool(forced), True, (), i), name.lower(), value.lower()) for i, (name, value, forced) in enumerate(SHOWING.findall(a["style"]))]
            for rank, name, value in said:
                if value not in ("inherit", "unset", "revert") and (name not in best or best[name][0] < rank):
                    best[name] = rank, value
            away = "hidden" in a or (node.tag == "dialog" and "open" not in a)
            displayed = best["display"][1] != "none" if "display" in best else not away
            node.looks = displayed and node.tag not in NEVER_SHOWN, best["visibility"][1] == "visible" if "visibility" in best else None
        return node.looks


class Layout:
    """Lines of text with pending inline text and blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def add(self, text: str) -> None:
        if text := SPACE.sub(" ", text):
            if text[0] == " " and (not self.inline or self.inline[-1].endswith((" ", "\n"))):
                text = text[1:]
            if text:
                self.inline.append(text)

    def end_line(self, blank: bool = False) -> None:
        text = "".join(self.inline).strip(" \n")
        self.inline = []
        if text.strip():
            self.put(text.split("\n"))
        self.gap |= blank

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines += [line.rstrip() for line in lines]


def shown_children(node: Node, sheet: Sheet, shown: bool) -> Iterator[tuple[Node | str, bool]]:
    """Children that are displayed, and whether they are visible; of closed details only the summary."""
    closed, summary = node.tag == "details" and "open" not in node.attributes, False
    for child in node.children:
        if isinstance(child, str):
            if not closed:
                yield child, shown
            continue
        if closed and (child.tag != "summary" or summary):
            continue
        summary |= child.tag == "summary"
        displayed, visible = sheet.looks(child)
        if displayed:
            yield child, shown if visible is None else visible


def render(node: Node, sheet: Sheet, out: Layout, shown: bool = True) -> None:
    for child, seen in shown_children(node, sheet, shown):
        if isinstance(child, str):
            if seen:
                out.add(child)
            continue
        tag = child.tag
        if tag == "br":
            if out.inline:
                out.inline[-1] = out.inline[-1].rstrip(" ")
                out.inline.append("\n")
        elif tag in ("option", "optgroup", "select", "textarea"):
            out.add(" ")
            if seen and tag == "optgroup":
                out.add(child.attributes.get("label", "") + " ")
            render(child, sheet, out, seen)
            out.add(" ")
        elif tag == "img":
            if seen:
                out.add(child.attributes.get("alt", ""))
        elif tag not in BLOCK:
            render(child, sheet, out, seen)
            if tag in ("td", "th"):
                out.add(" ")
        else:
            blank = tag in PARAGRAPH
            out.end_line(blank)
            if tag in ("ul", "ol", "menu", "dir"):
                render_list(child, sheet, out, seen)
            elif tag == "table":
                render_table(child, sheet, out, seen)
            elif tag == "pre":
                lines = "".join(strings(child, sheet, seen)).split("\n")
                lines = lines[not lines[0] : len(lines) - (len(lines) > 1 and not lines[-1])]
                if any(line.strip() for line in lines):
                    out.put(lines)
            elif tag in ("dd", "blockquote"):
                put_indented(child, sheet, out, seen, "  ", "  ")
            elif tag == "hr":
                if seen:
                    out.put(["---"])
            else:
                render(child, sheet, out, seen)
            out.end_line(blank)


def strings(node: Node, sheet: Sheet, shown: bool) -> Iterator[str]:
    for child, seen in shown_children(node, sheet, shown):
        if isinstance(child, str):
            if seen:
                yield child
        elif child.tag == "br":
            yield "\n"
        else:
            yield from strings(child, sheet, seen)


def put_indented(node: Node, sheet: Sheet, out: Layout, shown: bool, first: str, rest: str) -> None:
    inner = Layout()
    render(node, sheet, inner, shown)
    inner.end_line()
    if inner.lines:
        out.put([(rest if i else first) + line if line else "" for i, line in enumerate(inner.lines)])


def number_of(source: str) -> int | None:
    return int(source) if re.fullmatch(r"\s*-?\d{1,9}\s*", source) else None


def render_list(node: Node, sheet: Sheet, out: Layout, shown: bool) -> None:
    start = number_of(node.attributes.get("start", ""))
    number = 1 if start is None else start
    for child, seen in shown_children(node, sheet, shown):
        if isinstance(child, str):
            if seen:
                out.add(child)
            continue
        out.end_line()
        if child.tag == "li":
            own = number_of(child.attributes.get("value", ""))
            number = number if own is None else own
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            put_indented(child, sheet, out, seen, mark if seen else "", " " * len(mark))
        else:
            put_indented(child, sheet, out, seen, "  ", "  ")
    out.end_line()


def rows_of(node: Node, sheet: Sheet, shown: bool) -> Iterator[tuple[Node, bool]]:
    for child, seen in shown_children(node, sheet, shown):
        if not isinstance(child, str):
            if child.tag == "tr":
                yield child, seen
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from rows_of(child, sheet, seen)


def strays(node: Node, sheet: Sheet, shown: bool) -> Iterator[Node | str]:
    """What stands in a table outside its cells."""
    for child, seen in shown_children(node, sheet, shown):
        if isinstance(child, str):
            if seen and child.strip() and node.tag not in ("colgroup", "col"):
                yield child
        elif child.tag in ("thead", "tbody", "tfoot", "tr"):
            yield from strays(child, sheet, seen)
        elif child.tag not in ("colgroup", "col") and not (node.tag == "tr" and child.tag in ("td", "th")):
            yield child


def span_of(source: str, most: int = 1000) -> int:
    """Columns or rows that a cell spans; as in browsers 1000 columns and 65534 rows at most, and 0 rows (to the end) for "0"."""
    digits = re.match(r"\s*0*(\d{0,6})", source)[1]
    return max(1, min(int(digits or 1), most))


def grid_of(node: Node, sheet: Sheet, shown: bool) -> list[list[list[str]]]:
    """Lines of each cell by row and column; where a cell spans more, the places are empty."""
    grid, taken = [], {}  # taken: rows that a cell from above still covers, by column
    for row, seen in rows_of(node, sheet, shown):
        cells: list[list[str]] = []
        covered = {c for c, left in taken.items() if left > 0}
        for cell, visible in shown_children(row, sheet, seen):
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                continue
            while len(cells) in covered:
                cells.append([])
            inner = Layout()
            render(cell, sheet, inner, visible)
            inner.end_line()
            down, wide = span_of(cell.attributes.get("rowspan", ""), 65534), span_of(cell.attributes.get("colspan", ""))
            if down > 1:
                taken |= {c: down for c in range(len(cells), len(cells) + wide)}
            cells.append([line for line in inner.lines if line])
            cells += [[]] * (wide - 1)
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        grid.append(cells)
    return grid


def render_table(node: Node, sheet: Sheet, out: Layout, shown: bool) -> None:
    """Caption and stray content as blocks, then the cells in columns, two blanks apart; without columns where padding would swell the text."""
    loose = Node("div", {})
    loose.children = list(strays(node, sheet, shown))
    render(loose, sheet, out, shown)
    out.end_line()
    grid = grid_of(node, sheet, shown)
    width = [0] * max(map(len, grid), default=0)
    for cells in grid:
        for i, lines in enumerate(cells):
            if lines:
                width[i] = max(width[i], *map(len, lines))
    tall = sum(max(map(len, cells), default=0) for cells in grid)
    text = sum(len(line) for cells in grid for lines in cells for line in lines)
    aligned = tall * sum(w + 2 for w in width) <= MOST_PADDING * (text + 1000)
    for cells in grid:
        lines = []
        for k in range(max(map(len, cells), default=0)):
            if aligned:
                lines.append("  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(cells, width)).rstrip())
            else:
                lines.append("  ".join(c[k] for c in cells if k < len(c)))
        if lines:
            out.put(lines)


def text_of(source: str) -> str:
    """All visible text of a page, laid out."""
    root, styles, deep = build(source, Sheet([]))
    sheet = Sheet(styles)
    if deep and sheet.rules:
        root = build(source, sheet)[0]
    elif deep:
        sheet = Sheet([])
    out = Layout()
    render(root, sheet, out)
    out.end_line()
    return "\n".join(out.lines)


def extract_text(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """One row per page: key and text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames, BATCH_ROWS):
            yield pd.DataFrame({key: pdf[key].astype("Int64"), "text": [text_of(h) if isinstance(h, str) else None for h in pdf["html"]]})

    return pages.select(F.col(key).cast("long"), F.col(source).alias("html")).mapInPandas(run, f"{key} long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
