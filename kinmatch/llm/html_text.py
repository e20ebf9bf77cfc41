"""Text of HTML pages as a reader would see it laid out.

A tree builder fills in the tags that HTML lets authors omit; visibility rules
drop what is not shown; a renderer lays the rest out: blocks on lines of their
own with blank lines where margins are, lists with markers and indentation,
table cells in aligned columns, white space collapsed but in <pre>.
Builder and renderer work with explicit stacks, so depth is no limit.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import given_id, in_batches, plain

# Fixed sets of element names, as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript noembed noframes iframe object audio video canvas datalist meta link base param source track area".split()) | {"svg title", "svg desc", "svg defs", "svg metadata", "svg symbol", "svg clippath", "svg mask", "svg pattern", "svg marker", "math annotation", "math annotation-xml"}
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table ul caption tr td th thead tbody tfoot option xmp mtr".split()) | {"svg text"}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure hr fieldset xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
SCOPE = frozenset("html table td th caption template".split())
#: For an element that starts: what it ends if that is open, and what hides such elements from it.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split()) | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split()) | SCOPE),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("html table template".split())),
    "td": (frozenset("td th caption colgroup".split()), frozenset("html table tr template".split())),
    "th": (frozenset("td th caption colgroup".split()), frozenset("html table tr template".split())),
    "caption": (frozenset("caption".split()), frozenset("html table template".split())),
} | {k: (frozenset("tr td th thead tbody tfoot caption colgroup".split()), frozenset("html table template".split())) for k in ("thead", "tbody", "tfoot")}

#: Elements of drawings and formulas that other rules hold for than for the same names elsewhere.
FOREIGN = {"svg": frozenset("title desc defs metadata symbol clippath mask pattern marker text".split()), "math": frozenset("annotation annotation-xml".split())}
#: HTML elements that end an open drawing or formula, unless they stand in an element that takes HTML.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
TAKES_HTML = frozenset("foreignobject mi mo mn ms mtext".split()) | {"svg desc", "svg title", "math annotation-xml"}
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z|^[^=]*/\Z")

SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th caption".split())
#: For a part of a table that starts: which open parts of the table it may stand in; all else in the table ends.
WITHIN = {k: frozenset() for k in ("caption", "colgroup", *SECTIONS)} | {"col": frozenset(["colgroup"]), "tr": SECTIONS, "td": SECTIONS | {"tr"}, "th": SECTIONS | {"tr"}}
#: Elements that hold parts of a table only: other content goes before the table.
TABLE_ONLY = SECTIONS | {"table", "tr"}

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/=>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
SPACE = re.compile(r"[ \t\n\f\r]+")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text) if text.strip(" \t\n\f\r/") else ():
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds text, start, end."""
    at, last = 0, page.rfind(">")
    drawn = 0  # open drawings
    while at < len(page):
        m = TOKEN.search(page, at) if at <= last or page.startswith("<!--", at) else None
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        name = m[1] or m[3]
        if not name:
            continue  # a comment, doctype or bogus tag
        name = name.lower()
        if m[0][1] == "/":
            drawn -= drawn > 0 and name == "svg"
            yield "end", name, ""
            continue
        rest = m[2] or m[4] or ""
        yield "start", name, rest
        closed = bool(SELF_CLOSED.search(rest))
        drawn += name == "svg" and not closed
        if name in RAW and not (drawn and closed):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            yield "raw", page[at : close.start() if close else len(page)], name
            at = close.end() if close else len(page)
            yield "end", name, ""


def build(page: str) -> Node:
    """The tree of a page, with html and body, and with the elements that start and end tags imply."""
    root, body = Node("html", {}), Node("body", {})
    root.children.append(body)
    open_: list[Node] = [root, body]
    count: Counter[str] = Counter()  # of open elements

    def end(k: int) -> None:
        """End the open elements from the k-th on."""
        for n in open_[k:]:
            count[n.tag] -= 1
        del open_[k:]

    def close(names: frozenset, fence: frozenset) -> None:
        """End the nearest open element of names and all inside it, unless a fence comes first."""
        if not any(count[n] for n in names):
            return
        for k in range(len(open_) - 1, 1, -1):
            if open_[k].tag in names:
                end(k)
                return
            if open_[k].tag in fence:
                return

    def table_at() -> int:
        """Place of the innermost open table; 0 if there is none or a template hides it."""
        if count["table"]:
            for k in range(len(open_) - 1, 1, -1):
                if open_[k].tag in ("table", "template"):
                    return k if open_[k].tag == "table" else 0
        return 0

    def put(child: Node | str, part: bool = False) -> None:
        """Add a child to the open element; what is no part of a table stands before it instead."""
        if not part and open_[-1].tag in TABLE_ONLY and (k := table_at()):
            open_[k - 1].children.insert(len(open_[k - 1].children) - 1, child)
        else:
            open_[-1].children.append(child)

    def start(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        put(node, tag in WITHIN or tag in ("script", "style", "template"))
        if tag not in VOID:
            open_.append(node)
            count[tag] += 1
        return node

    def break_out() -> None:
        """End the open drawings and formulas around this place, up to an element that takes HTML."""
        last = 0
        for k in range(len(open_) - 1, 1, -1):
            if open_[k].tag in TAKES_HTML:
                break
            last = k if open_[k].tag in FOREIGN else last
        if last:
            end(last)

    for kind, name, rest in tokens(page):
        inside = [k for k in FOREIGN if count[k]]
        if inside and kind == "start" and name in BREAKOUT:
            break_out()
        name = next((f"{k} {name}" for k in inside if kind in ("start", "end") and name in FOREIGN[k]), name)
        top = open_[-1]
        if kind == "text":
            text = html.unescape(name) if "&" in name else name
            if top.tag == "head":
                if not text.strip():
                    continue
                end(len(open_) - 1)
            blank = not text.strip()
            if open_[-1].tag == "colgroup" and not blank:
                end(len(open_) - 1)
            put(text, blank)
        elif kind == "raw":
            open_[-1].children.append(html.unescape(name) if rest in ("textarea", "title") else name)
        elif kind == "start":
            if name in ("html", "body"):
                (root if name == "html" else body).attributes.update({k: v for k, v in attributes(rest).items() if k not in (root if name == "html" else body).attributes})
                if name == "body" and top.tag == "head":
                    end(len(open_) - 1)
                continue
            if name == "head":
                if len(open_) == 2 and not any(isinstance(c, Node) and c.tag != "head" for c in body.children):
                    start("head", {})
                continue
            if top.tag == "head" and name not in HEAD_ONLY:
                end(len(open_) - 1)
            if name == "image":
                name = "img"
            if name in CLOSES_P:
                close(frozenset(["p"]), SCOPE | {"button"})
            if name in WITHIN and (k := table_at()):
                while k + 1 < len(open_) and open_[k + 1].tag in WITHIN[name]:
                    k += 1
                end(k + 1)
            elif open_[-1].tag == "colgroup":
                end(len(open_) - 1)
            if name == "table" and (k := table_at()) and not any(n.tag in CELLS for n in open_[k + 1 : k + 4]):
                end(k)
            if name == "form" and open_[-1].tag in TABLE_ONLY and table_at():
                continue  # it ends at once
            if name in IMPLIED_END:
                names, fence = IMPLIED_END[name]
                if name in ("tr", "thead", "tbody", "tfoot"):
                    while any(count[n] for n in names):
                        before = len(open_)
                        if name == "tr" and open_[-1].tag in ("thead", "tbody", "tfoot", "table"):
                            break
                        close(names, fence)
                        if len(open_) == before:
                            break
                else:
                    close(names, fence)
            if len(name) == 2 and name[0] == "h" and name[1] in "123456" and open_[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                end(len(open_) - 1)
            if name in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
                start("tr", {})
            if name == "button" or name == "a":
                close(frozenset([name]), SCOPE)
            if name in ("select", "input", "textarea") and count["select"]:
                close(frozenset(["select"]), SCOPE)
                if name == "select":
                    continue
            if name == "optgroup":
                close(frozenset([name]), frozenset(["select", "datalist"]) | SCOPE)
                close(frozenset(["option"]), frozenset(["select", "datalist"]) | SCOPE)
            node = start(name, attributes(rest))
            if count["svg"] and (node.attributes.get("display") == "none" or node.attributes.get("visibility") in ("hidden", "collapse")):
                node.attributes["hidden"] = ""
            if open_[-1] is node and (inside or name in FOREIGN) and SELF_CLOSED.search(rest):
                end(len(open_) - 1)
        elif name == "br":
            put(Node("br", {}))
        elif name == "p" and not count["p"]:
            put(Node("p", {}))
        elif name not in VOID and name not in ("html", "body"):
            fence = frozenset(["html", "table", "template"]) if name in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else frozenset(["html", "template"]) if name in ("table", "template") else SCOPE
            close(frozenset([name]), fence - {name})
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    a = node.attributes
    if not a:
        return node.tag != "dialog"
    if "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and HIDDEN_STYLE.search(a["style"]))


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n is node or visible(n):
            stack.extend(reversed(n.children))
    return SPACE.sub(" ", "".join(out)).strip(" ")


def shown_options(select: Node) -> list[str]:
    """What a select shows: all of a list, the chosen option of a menu (the last selected one, or the first that can be chosen); other content as it is."""
    options: list[tuple[Node, bool]] = []
    out: list[str] = []
    listed = "multiple" in select.attributes or _number(select.attributes.get("size"), 1) > 1
    stack: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(select.children)]
    while stack:
        node, disabled = stack.pop()
        if isinstance(node, str):
            if node.strip():
                out.append(SPACE.sub(" ", node).strip(" "))
            continue
        disabled = disabled or "disabled" in node.attributes
        if node.tag == "option":
            options.append((node, disabled))
            if listed and visible(node):
                out.append(node.attributes.get("label") or text_of(node))
        elif visible(node):
            if listed and node.tag == "optgroup" and node.attributes.get("label"):
                out.append(node.attributes["label"])
            stack.extend((c, disabled) for c in reversed(node.children))
    if not listed:
        chosen = [n for n, _ in options if "selected" in n.attributes][-1:] or [n for n, disabled in options if not disabled][:1]
        out += [n.attributes.get("label") or text_of(n) for n in chosen]
    return out


class Lines:
    """Lines being written: collapses white space, keeps margins and indentation."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.margin = False
        self.indent, self.marker = "", ""

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.end_line(force=True)
                self._put(line)
            return
        words = SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        trailing = words.endswith(" ")
        if words:
            self._put(words.rstrip(" "))
            self.space = trailing

    def _put(self, words: str) -> None:
        if not words:
            return
        if self.now:
            self.now.append(" " if self.space else "")
        self.space = False
        self.now.append(words)

    def end_line(self, force: bool = False) -> None:
        if self.now or force:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            self.lines.append((self.indent[: len(self.indent) - len(self.marker)] + self.marker + "".join(self.now)).rstrip())
            self.now, self.marker = [], ""
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.margin |= spaced

    def whole(self, lines: list[str]) -> None:
        for line in lines:
            self.now = [line] if line else []
            self.end_line(force=True)

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else default


def rows_of(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """A table's captions and its rows of cells; nested tables belong to their cells."""
    captions, rows, stack = [], [], [iter(table.children)]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
        elif isinstance(node, Node) and visible(node):
            if node.tag == "tr":
                rows.append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)])
            elif node.tag == "caption":
                captions.append(node)
            elif node.tag not in ("table", "td", "th"):
                stack.append(iter(node.children))
    return captions, rows


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns spanned, rows spanned) as lines with columns of one width, two spaces apart."""
    grid, taken = [], {}
    for r, row in enumerate(rows):
        out, c = [], 0
        for lines, wide, tall in row:
            while taken.get((r, c)):
                c += 1
            out.append((c, wide, lines))
            for k in range(1, tall):
                for j in range(wide):
                    taken[r + k, c + j] = True
            c += wide
        grid.append(out)
    widths: dict[int, int] = {}
    for row in grid:
        for c, wide, lines in row:
            if wide == 1:
                widths[c] = max(widths.get(c, 0), max(map(len, lines), default=0))
    starts, at = {}, 0
    for c in range(max((c + wide for row in grid for c, wide, _ in row), default=0)):
        starts[c] = at
        at += widths.get(c, 0) + 2 * (c in widths)
    out = []
    for row in grid:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line = ""
            for c, _, lines in row:
                if k < len(lines) and lines[k]:
                    line = line.ljust(starts[c])
                    line += ("  " if line and not line.endswith("  ") else "") + lines[k]
            out.append(line.rstrip())
    return out


def render(root: Node) -> list[str]:
    """The page's lines. Tables are rendered from the innermost outwards."""
    tables: list[Node] = []
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if visible(node):
            if node.tag == "table":
                tables.append(node)
            stack.extend(c for c in node.children if isinstance(c, Node))
    done: dict[int, list[str]] = {}
    for table in reversed(tables):  # an inner table comes after its outer one
        captions, rows = rows_of(table)
        lines = [line for c in captions for line in flow(c.children, done)]
        cells = [[(flow(c.children, done), max(1, min(1000, _number(c.attributes.get("colspan"), 1))), max(1, min(len(rows), _number(c.attributes.get("rowspan"), 1)))) for c in row] for row in rows]
        done[id(table)] = lines + aligned(cells)
    return flow([root], done)


def flow(children: list[Node | str], tables: dict[int, list[str]]) -> list[str]:
    """Lines of a run of nodes."""
    out = Lines()
    keep = 0
    lists: list[list] = []  # [ordered, next number]
    stack: list[tuple[Iterator, Node | None, str]] = [(iter(children), None, "")]
    while stack:
        nodes, parent, indent = stack[-1]
        node = next(nodes, None)
        if node is None:
            stack.pop()
            if parent is not None:
                if parent.tag in BLOCK:
                    out.block(parent.tag in SPACED and not (parent.tag in ("ul", "ol", "menu") and len(lists) > 1))
                    out.marker = "" if parent.tag == "li" else out.marker
                out.indent = indent
                keep -= parent.tag in ("pre", "xmp", "textarea")
                out.space |= parent.tag in ("textarea", "mtd")
                if parent.tag in ("ul", "ol", "menu"):
                    lists.pop()
            continue
        if isinstance(node, str):
            out.text(node, bool(keep))
            continue
        if not visible(node):
            continue
        tag = node.tag
        if tag == "br":
            out.end_line(force=True)
        elif tag == "wbr" or tag in VOID and tag not in ("hr", "input"):
            continue
        elif tag == "hr":
            out.block(True)
        elif tag == "input":
            if node.attributes.get("type", "").lower() in ("submit", "button", "reset") and node.attributes.get("value"):
                out.text(node.attributes["value"], False)
        elif tag == "select":
            shown = shown_options(node)
            for text in shown:
                if len(shown) > 1:
                    out.block(False)
                out.space = True
                out.text(text, False)
            if len(shown) > 1:
                out.block(False)
            out.space = True
        elif id(node) in tables:
            out.block(True)
            out.whole(tables[id(node)])
            out.block(True)
        else:
            before = out.indent
            out.space |= tag in ("textarea", "mtd") or parent is not None and parent.tag == "mfrac"
            if tag in BLOCK:
                nested = tag in ("ul", "ol", "menu") and bool(lists)
                out.block(tag in SPACED and not nested)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", _number(node.attributes.get("start"), 1)])
            elif tag == "li":
                ordered, number = lists[-1] if lists else (False, 1)
                if lists and ordered:
                    number = _number(node.attributes.get("value"), number)
                    lists[-1][1] = number + 1
                out.marker = f"{number}. " if ordered else "- "
                out.indent += " " * len(out.marker)
            elif tag in ("dd", "blockquote"):
                out.indent += "  "
            keep += tag in ("pre", "xmp", "textarea")
            inner = node.children
            if tag in ("pre", "textarea") and inner and isinstance(inner[0], str) and inner[0].startswith("\n"):
                inner = [inner[0][1:], *inner[1:]]
            stack.append((iter(inner), node, before))
    return out.result()


def page_text(page: str) -> str:
    lines = render(build(page.replace("\x00", "")))
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [page_text(p) for p in part.column("txt").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("did"), pa.array(texts, pa.string())], ["did", "text"])


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: the id (under its own name) and text.

    Null and empty pages, and pages without visible text, have an empty text;
    what is no HTML is text; an empty table gives no rows. Shown are all but
    heads, scripts, styles, templates, embedded objects, the options of a menu that are not chosen, comments
    names, descriptions and definitions within drawings, annotations of formulas,
    and what `hidden`, `display:none` or `visibility:hidden` hides.
    """
    return plain(pages, id_col, html_col).transform(in_batches, _text_rows, "did long, text string").select(given_id().alias(id_col), "text")
