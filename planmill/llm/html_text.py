"""Operator 8, HTML extraction: a tree of the page, rendered as text with its layout."""

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
HIDDEN = {"head", "script", "style", "template", "iframe", "noembed", "noframes", "datalist", "audio", "video",
          "canvas", "object", "annotation", "annotation-xml", "title", "meta", "link", "base"}
SVG_HIDDEN = {"defs", "symbol", "desc", "metadata", "clippath", "mask", "pattern", "marker"}
#: HTML start tags that end an open svg or math, and the elements of these that may hold HTML.
BREAKOUT = {"b", "big", "blockquote", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4",
            "h5", "h6", "hr", "i", "img", "li", "menu", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong",
            "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
HOLDS_HTML = ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "menu", "dl", "table", "blockquote", "pre", "figure", "hr", "fieldset"}
BLOCK = SPACED | {"address", "article", "aside", "body", "center", "dd", "details", "div", "dt", "figcaption", "footer",
                  "form", "header", "html", "legend", "li", "main", "nav", "option", "optgroup", "section", "summary",
                  "caption", "tr", "td", "th"}
ENDS_P = BLOCK - {"li", "dd", "dt", "option", "optgroup", "tr", "td", "th", "caption", "body", "html", "legend"}
#: A start tag (key) ends an open element (first set) that no element of the second set encloses more closely.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
_STOP = re.compile("[>\"']")
_QUOTE = re.compile("[\"']")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_BOX = re.compile(r"(?<![\w-])display\s*:\s*none")
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|initial|hidden|collapse)")


class Tokens:
    """Comments, declarations and tags of a page, in time that grows with its length.

    A tag ends at the first > outside quotes; where there is none, its < is text. What a look ahead has found
    is kept: the next place of each kind, and the quotes from which no tag ends.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.ahead: dict = {}
        self.dead: set[int] = set()
        #: Ends of names in which no quote helps; names looked at later begin further on.
        self.hopeless: set[int] = set()

    def _next(self, pattern, at: int) -> int:
        """The first match of the pattern from `at` on, or the end of the page."""
        known = self.ahead.get(pattern)
        if known is None or not known[0] <= at <= known[1]:
            found = pattern.search(self.page, at)
            known = self.ahead[pattern] = (at, found.start() if found else len(self.page))
        return known[1]

    def _end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at `at`; -1 where there is none."""
        opened = []
        while at <= self.last[">"]:
            stop = self._next(_STOP, at)
            if self.page[stop] == ">":
                return stop
            if stop in self.dead:
                break
            opened.append(stop)
            if stop >= self.last[self.page[stop]]:
                break
            at = self.page.find(self.page[stop], stop + 1) + 1
        self.dead.update(opened)
        return -1

    def tag(self, at: int):
        """(end, slash, name, attributes) of the tag whose < is at `at`, or None."""
        page = self.page
        slash = page.startswith("/", at + 1)
        begin = at + 1 + slash
        if at > self.last[">"] or not ("a" <= page[begin : begin + 1].lower() <= "z") or not page[begin].isascii():
            return None
        name_end = self._next(_NAME_END, begin)
        end = self._end(name_end)
        if end < 0:
            # A quote within the name may open a value instead; the last such one does.
            if name_end in self.hopeless:
                return None
            cuts = [m.start() for m in _QUOTE.finditer(page, begin + 1, name_end)]
            whole, name_end = name_end, -1
            for cut in reversed(cuts):
                if cut not in self.dead and (end := self._end(cut)) >= 0:
                    name_end = cut
                    break
            if name_end < 0:
                self.hopeless.add(whole)
                return None
        return end + 1, slash, page[begin:name_end], page[name_end:end]

    def next(self, at: int):
        """(start, end, declaration or None, slash, name, attributes) of the first token from `at` on, or None."""
        page, n = self.page, len(self.page)
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), at):
                close = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
                found = page.find(close, at + {"-->": 4, "]]>": 9, ">": 2}[close])
                end = n if found < 0 else found + len(close)
                return at, end, page[at:end], False, None, ""
            found = self.tag(at)
            if found is not None:
                end, slash, name, attributes = found
                return at, end, None, slash, name, attributes
            at += 1
        return None


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(source: str) -> dict:
    out = {}
    for name, value in _ATTRIBUTE.findall(source) if source.strip(" /") else ():
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def parse(page: str) -> Node:
    """Tree of a page. Missing end tags are implied, stray ones ignored, comments dropped."""
    root = Node("body")
    open_, counts = [root], Counter()
    at, end = 0, len(page)

    def push(node: Node):
        open_.append(node)
        counts[node.tag] += 1

    def close(tags, within=frozenset()) -> bool:
        if not any(counts[t] for t in tags):
            return False  # without a walk down the open elements
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in tags:
                counts.subtract(n.tag for n in open_[i:])
                del open_[i:]
                return True
            if open_[i].tag in within:
                return False
        return False

    def text(s: str):
        if s:
            if open_[-1].tag == "head" and s.strip():
                close({"head"})
            open_[-1].children.append(html.unescape(s))

    tokens = Tokens(page)
    while at < end:
        m = tokens.next(at)
        if m is None:
            text(page[at:])
            break
        start, after, declaration, slash, name, source = m
        text(page[at:start])
        at = after
        foreign = counts.get("svg") or counts.get("math")
        if declaration is not None:
            if foreign and declaration.startswith("<![CDATA["):
                open_[-1].children.append(declaration[9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        foreign = foreign and not any(counts[t] for t in HOLDS_HTML)
        if slash:
            if tag == "br":
                open_[-1].children.append(Node("br"))
            elif tag == "p" and not counts["p"]:
                open_[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                close({tag}, frozenset() if tag in ("table", "head") else {"table"} if tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption") else {"td", "th", "caption", "table"})
            continue
        if tag in ("html", "body"):
            continue
        if tag not in IN_HEAD and open_[-1].tag == "head":
            close({"head"})
        if foreign and tag in BREAKOUT:
            foreign = False
            while close({"svg", "math"}):
                pass
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "caption", "table", "button", "object"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            open_[-1].children.append(row)
            push(row)
        node = Node(tag, _attributes(source))
        open_[-1].children.append(node)
        if tag in RAW and not (foreign and source.rstrip().endswith("/")):
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            inside = page[at : stop.start()] if stop else page[at:]
            node.children.append(html.unescape(inside) if tag in ("title", "textarea") else inside)
            at = page.find(">", stop.start()) + 1 or end if stop else end
        elif tag not in VOID and not ((foreign or tag in ("svg", "math", "path")) and source.rstrip().endswith("/")):
            push(node)  # a slash at the end means nothing on HTML elements
    return root


def _has_box(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or node.tag == "input" or "hidden" in a:
        return False
    return not ("style" in a and _NO_BOX.search(a["style"].lower()))


def _seen(node: Node, seen: bool) -> bool:
    """Whether an element's own text is seen; visibility is inherited until an element sets it."""
    found = _VISIBILITY.findall(node.attributes["style"].lower()) if "style" in node.attributes else ()
    return found[-1] in ("visible", "initial") if found else seen


class Flow:
    """Lines of a block as they fill: white space collapses, gaps between blocks do not add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap = "", 0
        self.indents: list[str] = []
        self.marker: str | None = None

    def text(self, s: str, keep: bool = False):
        if keep:
            first, *rest = s.split("\n")
            self.line += first
            for more in rest:
                self.put(self.line)
                self.line = more
            return
        s = _SPACE.sub(" ", s)
        if not self.line or self.line.endswith(" "):
            s = s.lstrip(" ")
        self.line += s

    def put(self, line: str):
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = "".join(self.indents)
        if self.marker is not None:
            indent, self.marker = "".join(self.indents[:-1]) + self.marker, None
        self.lines.append((indent + line).rstrip())

    def end_line(self):
        if self.line.strip():
            self.put(self.line.rstrip())
        self.line = ""

    def margin(self, gap: int):
        self.end_line()
        self.gap = max(self.gap, gap)


def _span(node: Node) -> int:
    value = node.attributes.get("colspan", "1").strip()
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() else 1


def _rows(node: Node) -> int:
    """Rows of a cell; 0 means all that follow in the group, which a huge number does as well."""
    value = node.attributes.get("rowspan", "1").strip()
    return (min(int(value[:9]), 65534) or 65534) if value.isascii() and value.isdigit() else 1


def _placed(rows: list[list[tuple[int, int, list[str]]]], groups: list[int]) -> list[list[tuple[int, list[str]]]]:
    """Rows of (columns, lines) from cells (columns, rows, lines): empty cells where one from above stands.

    groups: rows at which a row group begins; no cell reaches across.
    """
    out, taken, starts = [], {}, set(groups)
    for y, row in enumerate(rows):
        if y in starts:
            taken = {}
        at, cells = 0, []
        for span, down, lines in row:
            while taken.get(at, 0) > y:
                cells.append((1, []))
                at += 1
            cells.append((span, lines))
            if down > 1:
                taken.update((c, y + down) for c in range(at, at + span))
            at += span
        out.append(cells)
    return out


def table_lines(rows: list[list[tuple[int, list[str]]]]) -> list[str]:
    """Cells (columns, lines) of each row, set in columns of equal width two spaces apart."""
    widths: dict[int, int] = {}
    for wide in (False, True):  # cells over several columns widen the last of theirs if needed
        for row in rows:
            at = 0
            for span, lines in row:
                size = max(map(len, lines), default=0)
                if (span > 1) == wide:
                    last = at + span - 1
                    others = sum(widths.get(c, 0) + 2 for c in range(at, last))
                    widths[last] = max(widths.get(last, 0), size - others)
                at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            at, line, edge = 0, "", 0
            for span, lines in row:
                line = line.ljust(edge) + (lines[k] if k < len(lines) else "")
                edge += sum(widths.get(c, 0) + 2 for c in range(at, at + span))
                at += span
            out.append(line.rstrip())
    return out


def render(root: Node) -> str:
    """Visible text of a tree, walked with an own stack so that depth has no limit."""
    flows, tables, lists = [Flow()], [], []
    pre = 0
    # seen: by visibility; drawn: None in HTML, in svg whether text is drawn here
    stack: list[tuple] = [(root, False, True, None)]
    while stack:
        node, leaving, seen, drawn = stack.pop()
        if isinstance(node, str):
            if not seen or drawn is False:
                continue
            flow = flows[-1]
            if tables and tables[-1][1] is flow and not node.strip():
                continue
            flow.text(node, keep=pre > 0)
            continue
        tag, flow = node.tag, flows[-1]
        if not leaving:
            if not _has_box(node) or (drawn is not None and tag in SVG_HIDDEN):
                continue
            seen = _seen(node, seen)
            if tag == "svg":
                drawn = False
            elif drawn is False and tag == "text":
                flow.text(" ")  # labels stand apart
                drawn = True
            elif drawn is not None and tag == "foreignobject":
                drawn = None
            if tag == "br" and not seen:
                continue
            if tag == "br":
                flow.put(flow.line.rstrip()) if flow.line else flow.put("")
                flow.line = ""
                continue
            if seen and tag in BLOCK and tag not in ("td", "th"):
                nested = tag in ("ul", "ol", "menu") and lists
                flow.margin(0 if nested or tag not in SPACED else 1)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, 0])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 0]
                kind[1] += 1
                value = node.attributes.get("value", "")
                if kind[0] == "ol" and value.isascii() and value.isdigit():
                    kind[1] = int(value[:9])
                marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                flow.indents.append(" " * len(marker) if seen else "")
                flow.marker = marker if seen else None
            elif tag in ("blockquote", "dd"):
                flow.indents.append("  " if seen else "")
            elif tag == "pre":
                pre += 1
            elif tag == "hr" and seen:
                flow.put("----")
                flow.gap = 1
            elif tag == "table":
                tables.append(([], flow, pre, []))
                pre = 0
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1][3].append(len(tables[-1][0]))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1][0]:
                    tables[-1][0].append([])
                flows.append(Flow())
            stack.append((node, True, seen, drawn))
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            stack.extend((c, False, seen, drawn) for c in reversed(children))
            continue
        if drawn and tag == "text":
            flow.text(" ")
        if tag in ("td", "th") and tables and flow is not tables[-1][1]:
            flow.end_line()
            flows.pop()
            tables[-1][0][-1].append((_span(node), _rows(node), flow.lines))
            continue
        if tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1][3].append(len(tables[-1][0]))
        if tag == "table":
            rows, flow, pre, groups = tables.pop()
            full = [r for r in _placed(rows, groups) if any(lines for _, lines in r)]
            if seen or full:
                flow.margin(1)
            for line in table_lines(full):
                flow.put(line)
            if full:
                flow.margin(1)
        if seen and tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and len(lists) > 1
            flow.margin(0 if nested or tag not in SPACED else 1)
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            flow.indents.pop()
            flow.marker = None
        elif tag == "pre":
            pre -= 1
    flows[0].end_line()
    return "\n".join(flows[0].lines)


def extract(pages: DataFrame) -> DataFrame:
    """Adds `text`, the visible text of `html`, to the page's columns other than html.

    Blocks stand on lines of their own, paragraphs, headings, lists and tables with a blank line
    between; list items are marked and indented by depth; table cells align in columns; pre keeps its
    white space. Formulas give the text of their symbols, drawings that of their labels; cells over several
    rows keep their columns. Not visible: head, scripts, styles, templates, embedded objects, the
    hidden attribute, display:none, visibility:hidden but for descendants that are visible again,
    annotations of formulas, and closed details but for their summary. Null html
    gives null text, empty html an empty text; broken markup never fails. Repeated rows have equal
    texts; a column `text` of the input gives way; an empty table gives no rows.
    """
    pages = pages.drop("text")
    names = [c for c in pages.columns if c != "html"]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = [None if h is None else render(parse(h)) for h in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*names, "text"])

    ordered = pages.select(*[F.col(f"`{c}`") for c in names], "html")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ordered.schema if f.name != "html")
    return ordered.mapInArrow(run, fields + "text string")
