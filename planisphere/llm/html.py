"""Visible text of HTML pages by layout-aware rendering.

A tree builder reads tags, supplies those that HTML lets authors leave out (ends of
paragraphs, list items and cells, rows around cells) and drops what is not shown: scripts, heads,
comments, hidden attributes, and elements that inline styles or simple style-sheet rules
hide; of rules that meet an element the most specific and last one holds, rules for other media than the screen do not
count, and what is made visible again inside a hidden element is shown. The tree is rendered as text: block margins become blank lines, items get bullets
or numbers, cells stand in aligned columns, also those that span columns or rows, preformatted text keeps its spaces.

Defined cases: a null page gives a null text, an empty one an empty text; unclosed and stray
tags never fail: a tag that nothing ends is text, and once a quote is left open the quotes after it
no longer hold ``>`` back; nesting beyond ``DEPTH`` elements is flattened; repeated rows are rendered each;
other columns do not matter. The work of a page grows with its length.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planisphere.llm.common import map_batches, slices

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object svg math datalist audio video canvas".split())
BLOCKS = {
    **dict.fromkeys("address article aside body center details dialog div fieldset figcaption form footer header hgroup html legend main nav search section summary dt dd caption option optgroup".split(), 0),
    **dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul xmp".split(), 1),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre search section summary table ul".split())
#: Blocks whose content stands as it is.
PLAIN = frozenset("address article aside body center dialog div fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend main nav p search section summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the open elements named first, looked for up to those named second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl", "table", "td", "th"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"})),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
}
SCOPE = frozenset("applet caption html table td th marquee object template button".split())
DEPTH = 200
CELL = 80
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: The same where a quote was left open before: the next ``>`` ends the tag.
BROKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: Fixed values of the HTML standard: the most columns and rows of a cell.
COLSPAN, ROWSPAN = 1000, 65534
SIMPLE = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)\Z", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def declared(style: str) -> dict[str, str]:
    """What a style says of display and visibility."""
    return {name.lower(): value.lower() for name, value in DECLARED.findall(style)} if style else {}


def sheet_rules(body: str):
    """(selectors, declarations) of a style sheet that hold on a screen, in order; blocks are told apart by their braces alone."""
    blocks, last = [True], ""  # whether the rules of each open block hold
    for part in re.split(r"([{}])", re.sub(r"/\*.*?(?:\*/|\Z)", "", body, flags=re.S)):
        if part == "{":
            head, last = last.rsplit(";", 1)[-1].strip(), ""
            if head.startswith("@"):
                name, _, query = head[1:].partition(" ")
                holds = name.lower() in ("supports", "layer", "container") or name.lower() == "media" and on_screen(query)
                blocks.append(blocks[-1] and holds)
            else:
                blocks.append(head if blocks[-1] is True else False)
        elif part == "}":
            if len(blocks) > 1:
                head = blocks.pop()
                if isinstance(head, str):
                    yield head, last
            last = ""
        else:
            last = part


def on_screen(query: str) -> bool:
    """Whether one of the media of a list is the screen; conditions on its size count as met."""
    for one in query.lower().split(","):
        words = re.findall(r"[a-z-]+|\(", one.strip())
        negated = words[:1] == ["not"]
        kind = next((w for w in words if w not in ("only", "not")), "all")
        if (kind in ("all", "screen", "(")) != negated:
            return True
    return False


def build(page: str) -> tuple[Node, list]:
    """Root of the tree, and the style-sheet rules as (specificity, tag, names, declarations)."""
    root = Node("html", {})
    stack, rules, at = [root], [], 0
    token, last = TOKEN, page.rfind(">")

    def text(s):
        if s:
            stack[-1].children.append(entities.unescape(s))

    def close(tags, bounds) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return True
            if stack[i].tag in bounds:
                return False
        return False

    def open_tag(tag, attributes):
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
        return node

    while True:
        start = page.find("<", at)
        if start < 0:
            break
        if start > last:  # nothing ends a tag from here on
            end = page.find("<!--", start)
            text(page[at : end if end >= 0 else len(page)])
            at = len(page)
            break
        m = token.match(page, start)
        if not m:
            if token is TOKEN and page[start + 1 : start + 3].lstrip("/")[:1].isalpha():
                token = BROKEN
                continue
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                open_tag("br", {})
            elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                close({tag}, {"table"})
            elif tag == "table":
                close({tag}, ())
            elif tag in BLOCKS or tag == "li":
                close(HEADINGS if tag in HEADINGS else {tag}, {"td", "th", "table", *(("ul", "ol") if tag == "li" else ())})
            else:
                close({tag}, {"td", "th", "table", "p", *BLOCKS})
            continue
        attributes = {}
        for name, a, b, c in ATTRIBUTE.findall(m.group(3)):
            attributes.setdefault(name.lower(), entities.unescape(a or b or c))
        if tag == "html" or tag == "body":
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
            if tag != "head":
                close({"head"}, ())
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_tag("tr", {})
        deep = len(stack)
        node = open_tag(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            at = len(page) if not end else (page.find(">", end.end()) + 1 or len(page))
            if tag == "style" and on_screen(attributes.get("media", "all")):
                for selectors, style in sheet_rules(body):
                    says = declared(style)
                    for one in selectors.split(",") if says else ():
                        found = SIMPLE.match(one.strip())
                        if found and one.strip():
                            names = set(re.findall(r"[.#][\w-]+", found.group(2)))
                            weight = (sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names), bool(found.group(1)), len(rules))
                            rules.append((weight, (found.group(1) or "").lower(), names, says))
            elif tag in ("textarea", "xmp"):
                node.children.append(entities.unescape(body) if tag == "textarea" else body)
            del stack[deep:]
    text(page[at:])
    return root, rules


def styles(node: Node, rules) -> dict[str, str]:
    """Display and visibility of an element: its own style, else of the rules that meet it the most specific and last."""
    found = {}
    if rules:
        a = node.attributes
        names = {"." + c for c in a.get("class", "").split()} | ({"#" + a["id"]} if a.get("id") else set())
        for _, tag, need, says in rules:
            if (not tag or tag == node.tag) and need <= names:
                found |= says
    return found | declared(node.attributes.get("style", ""))


def unseen(node: Node) -> bool:
    """Elements that no style shows."""
    a = node.attributes
    kind = a.get("type", "").lower()
    return node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a or node.tag == "input" and kind in ("hidden", "password", "checkbox", "radio", "file", "image")


def prune(node: Node, rules, visible: bool = True) -> None:
    """Leave only what is shown: no element without display, and no text where the nearest word on visibility hides it."""
    kept = []
    for child in node.children:
        if not isinstance(child, Node):
            if visible:
                kept.append(child)
            continue
        if unseen(child):
            continue
        style = styles(child, rules)
        if style.get("display") == "none":
            continue
        sees = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"), visible)
        if not sees and child.tag in ("input", "hr"):
            continue
        prune(child, rules, sees)
        kept.append(child)
    node.children = kept


class Flow:
    """Lines of a block: runs of inline text and blocks between collapsing margins."""

    def __init__(self):
        self.lines, self.inline, self.margin, self.top = [], [], 0, 0

    def end_run(self):
        run, self.inline = "".join(self.inline), []
        lines = [SPACES.sub(" ", x).strip(" ") for x in run.split("\v")]
        while lines and not lines[-1]:
            lines.pop()
        if any(lines):
            self.put(lines, 0, 0)

    def put(self, lines, above, below):
        """Lines with their margins; neighbouring margins collapse, and the outer ones are the parent's."""
        if lines:
            if self.lines:
                self.lines += [""] * max(self.margin, above)
            else:
                self.top = max(self.top, above)
            self.lines += lines
            self.margin = below
        elif self.lines:
            self.margin = max(self.margin, above, below)

    def add(self, children):
        for child in children:
            if isinstance(child, str):
                self.inline.append(child.replace("\v", " "))
            else:
                self.element(child)

    def element(self, node):
        tag = node.tag
        if tag == "br":
            self.inline.append("\v")
        elif tag == "wbr" or tag == "img":
            return
        elif tag == "input":
            self.inline.append(" " + node.attributes.get("value", "") + " ")
        elif tag == "select":
            options = [n for n in walk(node) if n.tag == "option"]
            chosen = [n for n in options if "selected" in n.attributes] or options[:1]
            self.inline.append(" " + " ".join("".join(x for x in n.children if isinstance(x, str)) for n in chosen) + " ")
        elif tag in BLOCKS or tag in ("li", "tr", "td", "th", "tbody", "thead", "tfoot", "menu"):
            self.end_run()
            if tag in PLAIN:
                inner = Flow()
                inner.add(node.children)
                lines = inner.done()
                self.put(lines, max(BLOCKS.get(tag, 0), inner.top), max(BLOCKS.get(tag, 0), inner.margin))
            else:
                self.put(block(node), BLOCKS.get(tag, 0), BLOCKS.get(tag, 0))
        else:
            self.add(node.children)

    def done(self):
        self.end_run()
        return self.lines


def walk(node):
    line = list(reversed(node.children))
    while line:
        n = line.pop()
        if isinstance(n, Node):
            yield n
            line += reversed(n.children)


def lines_of(children) -> list[str]:
    flow = Flow()
    flow.add(children)
    return flow.done()


def indented(lines, first: str) -> list[str]:
    rest = " " * len(first)
    return [(first if i == 0 else rest) + x if x or i == 0 else "" for i, x in enumerate(lines)]


def block(node) -> list[str]:
    tag = node.tag
    if tag == "hr":
        return ["---"]
    if tag in ("pre", "xmp"):
        raw = "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else preformatted(x) for x in node.children)
        return [x.rstrip() for x in raw.strip("\n").split("\n")] if raw.strip() else []
    if tag in ("ul", "ol", "menu"):
        start = node.attributes.get("start", "1")
        number, out = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                lines = lines_of(child.children)
                if lines:
                    out += indented(lines, f"{number}. " if tag == "ol" else "- ")
                number += 1
            elif isinstance(child, Node) or child.strip():
                out += indented(lines_of([child]), "  ")
        return out
    if tag == "table":
        return table_lines(node)
    if tag == "details" and "open" not in node.attributes:
        return lines_of([c for c in node.children if isinstance(c, Node) and c.tag == "summary"])
    lines = lines_of(node.children)
    if tag == "li":
        return indented(lines, "- ") if lines else []
    if tag == "blockquote":
        return indented(lines, "  ")
    return indented(lines, "    ") if tag == "dd" else lines


def preformatted(node) -> str:
    return "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else preformatted(x) for x in node.children)


def span_of(cell: Node, name: str, most: int) -> int:
    """Columns or rows of a cell; as many as there may be where it says 0 rows."""
    said = cell.attributes.get(name, "1")
    n = min(int(said), most) if re.fullmatch(r"\d{1,9}", said) else 1
    return n or (most if name == "rowspan" else 1)


def table_lines(node) -> list[str]:
    rows, before, extra = [], [], []

    def gather(children):
        for c in children:
            if not isinstance(c, Node):
                if c.strip():
                    extra.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                gather(c.children)
            elif c.tag == "tr":
                rows.append(c)
            elif c.tag == "caption":
                before.extend(lines_of(c.children))
            elif c.tag not in ("colgroup", "col"):
                extra.append(c)

    gather(node.children)
    before += lines_of(extra)
    cells: list[dict[int, list[str]]] = []
    below: dict[int, int] = {}  # column -> rows that a cell above still takes
    for row in rows:
        line: dict[int, list[str]] = {}
        at = 0
        for c in row.children:
            if not isinstance(c, Node) and not c.strip():
                continue
            while below.get(at, 0) > 0:
                at += 1
            if isinstance(c, Node):
                line[at] = lines_of(c.children if c.tag in ("td", "th") else [c])
                wide, tall = (span_of(c, name, most) for name, most in (("colspan", COLSPAN), ("rowspan", ROWSPAN)))
                if at >= COLSPAN:  # spans hold in the first columns, so that a row costs no more than its cells and these
                    wide, tall = 1, 1
                for column in range(at, at + wide if tall > 1 else at):
                    below[column] = tall
                at += wide
            else:
                line[at] = lines_of([c])
                at += 1
        below = {column: left - 1 for column, left in below.items() if left > 1}
        if any(line.values()):
            cells.append(line)
    width: dict[int, int] = {}  # of the columns in which some cell begins
    for line in cells:
        for i, cell in line.items():
            width[i] = max([width.get(i, 0), *(len(x) for x in cell if len(x) <= CELL)])
    columns = sorted(width)
    place = {column: k for k, column in enumerate(columns)}
    out = before
    for line in cells:
        last = place[max(i for i, cell in line.items() if cell)]
        for k in range(max(map(len, line.values()))):
            texts = ((line.get(i) or [], i) for i in columns[: last + 1])
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(width[i]) for cell, i in texts).rstrip())
    return out


def render(page: str | None) -> str | None:
    """Visible text of one page."""
    if page is None:
        return None
    root, rules = build(page)
    prune(root, sorted(rules, key=lambda r: r[0]))
    return "\n".join(lines_of(root.children))


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` of every row."""

    def run(batch):
        for part in slices(batch, "html"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return map_batches(rows, run, "page_id bigint, text string")
