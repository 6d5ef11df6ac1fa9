"""HTML extraction by layout-aware rendering.

A tolerant tokenizer feeds a tree builder that supplies implied end tags; visibility rules drop what a
browser would not show (head matter, scripts, hidden attributes, inline and simple stylesheet rules for
display and visibility, closed details and dialogs, hidden inputs). The renderer writes the visible text of
the tree: blocks on lines of their own, blank lines where browsers leave margins, numbered and bulleted lists
with indentation, preformatted text as it is, and table cells padded to their columns.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._text import lean

COLUMNS = 1000  # the most that the HTML standard lets a cell span
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption td th xmp".split())
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset dir xmp".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist param source track area map".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul summary xmp".split())
HEAD = frozenset("title base link meta style script noscript template".split())
#: start tag: the open elements it ends, and the elements beyond which it doesn't look
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {t: (frozenset(["p"]), frozenset("table td th caption button body html".split())) for t in ENDS_P}
_list, _table = frozenset("ul ol menu dir table td th body html".split()), frozenset(["table", "html"])
ENDS |= {
    "li": (frozenset(["li", "p"]), _list), "dt": (frozenset("dt dd p".split()), frozenset("dl table td th body html".split())), "dd": (frozenset("dt dd p".split()), frozenset("dl table td th body html".split())),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist html".split())), "optgroup": (frozenset(["option", "optgroup"]), frozenset("select html".split())),
    "tr": (frozenset("td th tr caption colgroup".split()), _table), "td": (frozenset(["td", "th", "caption", "colgroup"]), _table | {"tr"}), "th": (frozenset(["td", "th", "caption", "colgroup"]), _table | {"tr"}),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby", "html"])), "rp": (frozenset(["rt", "rp"]), frozenset(["ruby", "html"])),
}
for _t in ("thead", "tbody", "tfoot"):
    ENDS[_t] = (frozenset("td th tr thead tbody tfoot caption colgroup".split()), _table)
_H = frozenset("h1 h2 h3 h4 h5 h6".split())
_tag = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)")
_tag_loose = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)")
_attr = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_space = re.compile(r"[ \t\n\r\f]+")
_close = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
_compound = re.compile(r"(?:[a-z][a-z0-9]*|\*)?(?:[.#][A-Za-z0-9_-]+)*\Z", re.I)
_simple = re.compile(r"[.#]?[A-Za-z0-9_*-]+")
_decl = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*(none|block|inline[a-z-]*|flex|grid|table[a-z-]*|list-item|contents|flow-root|flow|ruby[a-z-]*|visible|hidden|collapse|initial|inherit|unset|revert[a-z-]*)(?![a-z-])[^;!]*(!\s*important)?", re.I)
_feature = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([0-9]*\.?[0-9]+)\s*(px|em|rem)\s*\)\Z")
SCREEN = {"width": 1280, "height": 800}  # px of the page that media queries are asked of
_useful = re.compile(r"hidden|style|class|id|type|open|start|value|reversed|colspan|rowspan|media", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "names")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.names = frozenset([tag, "*", *(f".{c}" for c in attrs.get("class", "").split()), *([f"#{attrs['id']}"] if "id" in attrs else [])]) if attrs else frozenset([tag, "*"])


def parse(doc: str) -> tuple[Node, list[str]]:
    """The element tree (kids are nodes and strings) and the text of its style elements."""
    root = Node("html", {})
    stack, styles, i, n = [root], [], 0, len(doc)
    up = Counter(["html"])  # tags of the open elements: looking for one that isn't open would walk deep stacks in vain

    def close(k: int) -> None:
        up.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def push(node: Node) -> None:
        stack.append(node)
        up[node.tag] += 1

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def ends(what: frozenset[str], stop: frozenset[str]) -> None:
        while any(up[t] for t in what):
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t in what:
                    close(k)
                    break
                if t in stop:
                    return
            else:
                return
            if len(what) <= 2:
                return

    while i < n:
        j = doc.find("<", i)
        if j < 0:
            text(doc[i:])
            break
        if j > i:
            text(doc[i:j])
        if doc.startswith("<!--", j):
            k = doc.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        if doc.startswith(("<!", "<?"), j):
            k = doc.find(">", j)
            i = n if k < 0 else k + 1
            continue
        m = _tag.match(doc, j) or _tag_loose.match(doc, j)
        if not m:
            text("<")
            i = j + 1
            continue
        i = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br", {}))
                continue
            inline = tag not in BLOCK
            if not up[tag] and tag != "p":
                continue
            for k in range(len(stack) - 1, 0, -1) if up[tag] else ():
                t = stack[k].tag
                if t == tag:
                    close(k)
                    break
                if t in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or inline and t in BLOCK:
                    break
            else:
                if tag == "p":
                    stack[-1].kids.append(Node("p", {}))
            continue
        if tag in ("html", "body"):
            if tag == "body":
                for k in range(1, len(stack) if up["head"] else 0):
                    if stack[k].tag == "head":
                        close(k)
                        break
                if not up["body"]:
                    stack[-1].kids.append(b := Node("body", attributes(m[3])))
                    push(b)
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in ENDS:
            ends(*ENDS[tag])
        if tag in _H and stack[-1].tag in _H or tag == "a" and stack[-1].tag == "a":
            close(len(stack) - 1)
        node = Node(tag, attributes(m[3]))
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            e = _close[tag].search(doc, i)
            inner = doc[i : e.start() if e else n]
            i = e.end() if e else n
            if tag == "style":
                styles.append(f"@media {node.attrs['media']}{{{inner}}}" if node.attrs.get("media") else inner)
            node.kids.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            continue
        push(node)
    return root, styles


def attributes(s: str) -> dict[str, str]:
    if not s or not _useful.search(s):
        return {}
    out: dict[str, str] = {}
    for m in _attr.finditer(s):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


#: by the rightmost id, class, tag or *: (rank, property, value, compounds from right to left with how each stands to the next one)
Rules = dict[str, list[tuple[tuple, str, str, list[tuple[str, frozenset[str]]]]]]


def selector(sel: str) -> list[tuple[str, frozenset[str]]] | None:
    """Compounds from right to left, each as (" ", ">" or "" before the first, its simple selectors); None for what isn't read."""
    out: list[tuple[str, frozenset[str]]] = []
    link = ""
    for part in re.sub(r"\s*>\s*", " > ", sel.strip()).split()[::-1]:
        if part == ">":
            if link != " ":
                return None
            link = ">"
        elif _compound.match(part):
            names = frozenset(x if x[0] in ".#" else x.lower() for x in _simple.findall(part))
            out.append((link, names - {"*"} if len(names) > 1 else names))
            link = " "
        else:
            return None
    return out if out and link == " " else None


def declared(css: str) -> dict[str, tuple[bool, str]]:
    """Display and visibility of a declaration block: (important, value), the last of the most important."""
    out: dict[str, tuple[bool, str]] = {}
    for m in _decl.finditer(css):
        k, v = m[1].lower(), (bool(m[3]), m[2].lower())
        if (k == "visibility") == (v[1] in ("none", "block", "flex", "grid", "contents", "list-item", "flow", "flow-root") or v[1].startswith(("inline", "table", "ruby"))) or k == "display" and v[1] in ("visible", "hidden", "collapse"):
            continue
        if k not in out or v[0] >= out[k][0]:
            out[k] = v
    return out


def on_screen(query: str) -> bool:
    """Whether a media query list holds for a screen of SCREEN; features other than widths and heights don't hold."""
    for q in query.lower().split(","):
        parts = [x.strip() for x in re.split(r"\sand\s|\sand(?=\()", " " + q.strip())]
        no, ok = parts[0].startswith("not "), True
        if parts[0] == "":
            parts = parts[1:]
        for x in parts:
            x = re.sub(r"\A(?:not|only)\s+", "", x)
            if m := _feature.match(x):
                px = float(m[3]) * (1 if m[4] == "px" else 16)
                ok &= SCREEN[m[2]] >= px if m[1] == "min" else SCREEN[m[2]] <= px
            elif x not in ("all", "screen"):
                ok &= False
                no &= x in ("print", "speech")  # of what isn't known neither it nor its opposite holds
        if ok != no:
            return True
    return not query.strip()


def hiding(styles: list[str]) -> Rules:
    """Rules for display and visibility with their rank in the cascade. Selectors are tags, classes, ids and * in any compound, with descendant and child combinators."""
    out: Rules = {}
    order = 0

    def read(css: str) -> None:
        nonlocal order
        i, n = 0, len(css)
        while i < n:
            j = css.find("{", i)
            if j < 0:
                return
            head = css[i:j].rsplit(";", 1)[-1].strip()
            depth, k = 1, j + 1
            while k < n and depth:
                depth += (css[k] == "{") - (css[k] == "}")
                k += 1
            body, i = css[j + 1 : k - 1 if not depth else n], k
            name = head[1:].replace("(", " ").split()[:1] if head.startswith("@") else []
            if head.startswith("@"):
                if name in (["layer"], ["supports"]) and " not " not in f" {head[9:].lower()} " or name == ["media"] and on_screen(head[6:]):
                    read(body)
                continue
            order += 1
            for key, (important, value) in declared(body).items():
                for sel in head.split(","):
                    if parts := selector(sel):
                        names = [x for _, p in parts for x in p]
                        rank = (important, sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names), sum(x[0] not in ".#*" for x in names), order)
                        last = min(parts[0][1], key=lambda x: ("#.".find(x[0]) % 3, x))
                        out.setdefault(last, []).append((rank, key, value, parts))

    for css in styles:
        if "display" in css.lower() or "visibility" in css.lower():
            read(re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", "", css, flags=re.S))
    return out


def number(s: str, default: int) -> int:
    return int(s) if re.fullmatch(r"-?[0-9]{1,9}", s.strip()) else default


class Out:
    """Lines of text with collapsed space; `gap` line breaks are due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.indent, self.bullet = 0, False, "", ""

    def open(self) -> None:
        if self.gap and (self.lines or self.line):
            self.flush()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
        self.gap = 0

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def text(self, s: str) -> None:
        s = _space.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s)
            return
        self.open()
        if not self.line:
            self.line.append(self.bullet or self.indent)
            self.bullet = ""
            s = s.lstrip(" ")
        elif self.space and s[0] != " ":
            s = " " + s
        self.space = s[-1] == " "
        self.line.append(s[:-1] if self.space else s)

    def keep(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.brk()
            if part:
                self.open()
                if not self.line:
                    self.line.append(self.bullet or self.indent)
                    self.bullet = ""
                self.line.append(part)

    def brk(self) -> None:
        self.open()
        if self.line:
            self.flush()
        else:
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)
        self.space = False

    def done(self) -> str:
        self.flush()
        return "\n".join(self.lines).strip("\n")


class Renderer:
    def __init__(self, rules: Rules):
        self.rules, self.visible, self.path = rules, True, []  # path: the elements around the one at hand

    def fits(self, parts: list[tuple[str, frozenset[str]]], n: Node) -> bool:
        """Whether a selector matches n. Going outward, the nearest ancestor that fits a compound is taken, and the next one if a child combinator then fails."""
        if not parts[0][1] <= n.names:
            return False

        def outer(i: int, at: int) -> bool:  # compounds from i on, around path[at]
            while i < len(parts):
                link, names = parts[i]
                if link == ">":
                    if at == 0 or not names <= self.path[at - 1].names:
                        return False
                    i, at = i + 1, at - 1
                    continue
                child = any(x == ">" for x, _ in parts[i + 1 :])
                for k in range(at - 1, -1, -1):
                    if names <= self.path[k].names:
                        if not child:
                            i, at = i + 1, k
                            break
                        if outer(i + 1, k):
                            return True
                else:
                    return False
            return True

        return outer(1, len(self.path))

    def style(self, n: Node, key: str) -> str | None:
        """The value that wins the cascade, None where nothing is declared."""
        a, best = n.attrs, None
        if self.rules:
            for name in n.names:
                for rank, k, value, parts in self.rules.get(name, ()):
                    if k == key and (best is None or rank > best[0]) and self.fits(parts, n):
                        best = rank, value
        if "style" in a and (d := declared(a["style"]).get(key)) and (best is None or d[0] >= best[0][0]):
            return d[1]
        return best[1] if best else None

    def seen(self, n: Node) -> bool:
        a = n.attrs
        if n.tag in UNSEEN or n.tag == "input" and a.get("type", "").lower() == "hidden":
            return False
        shown = self.style(n, "display") if a or self.rules else None
        if shown is None or shown.startswith("revert"):
            return not ("hidden" in a and a["hidden"].lower() != "until-found" or n.tag == "dialog" and "open" not in a)
        return shown != "none"

    def enter(self, n: Node) -> bool:
        """Go into n and take its visibility on; the one before is returned, for leave."""
        was = self.visible
        v = self.style(n, "visibility") if n.attrs or self.rules else None
        if v in ("visible", "initial"):
            self.visible = True
        elif v in ("hidden", "collapse"):
            self.visible = False
        self.path.append(n)
        return was

    def leave(self, was: bool) -> None:
        self.visible = was
        self.path.pop()

    def node(self, n: Node, o: Out, pre: bool) -> None:
        if not self.seen(n):
            return
        was = self.enter(n)
        self.inside(n, o, pre)
        self.leave(was)

    def inside(self, n: Node, o: Out, pre: bool) -> None:
        t = n.tag
        if t == "br":
            o.brk()
            return
        if t == "input":
            if n.attrs.get("type", "").lower() in ("submit", "button", "reset", "text", "") and n.attrs.get("value") and self.visible:
                o.text(f" {n.attrs['value']} ")
            return
        if t == "table":
            o.block(2)
            self.table(n, o)
            o.block(2)
            return
        gap = 2 if t in MARGIN else 1 if t in BLOCK else 0
        nested = t in ("ul", "ol", "menu", "dir") and o.indent != ""
        if gap:
            o.block(1 if nested else gap)
        kids = n.kids
        if t == "details" and "open" not in n.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if t in ("ul", "ol", "menu", "dir"):
            self.items(n, o, pre)
        elif t in ("blockquote", "dd"):
            was, o.indent = o.indent, o.indent + "  "
            self.kids(kids, o, pre)
            o.indent = was
        elif t in ("pre", "textarea", "xmp"):
            if kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
                kids = [kids[0][1:], *kids[1:]]
            self.kids(kids, o, True)
        else:
            self.kids(kids, o, pre)
        if gap:
            o.block(1 if nested else gap)

    def kids(self, kids: list, o: Out, pre: bool) -> None:
        for k in kids:
            if isinstance(k, str):
                if self.visible:
                    (o.keep if pre else o.text)(k)
            else:
                self.node(k, o, pre)

    def items(self, n: Node, o: Out, pre: bool) -> None:
        at, step = number(n.attrs.get("start", ""), 1), 1
        if "reversed" in n.attrs:
            at, step = number(n.attrs.get("start", ""), sum(isinstance(k, Node) and k.tag == "li" for k in n.kids)), -1
        for k in n.kids:
            if isinstance(k, Node) and k.tag == "li":
                if not self.seen(k):
                    continue
                at = number(k.attrs.get("value", ""), at)
                mark = f"{at}. " if n.tag == "ol" else "- "
                at += step
                was, seen = o.indent, self.enter(k)
                o.block(1)
                o.bullet, o.indent = was + mark if self.visible else "", was + " " * len(mark)
                self.kids(k.kids, o, pre)
                o.bullet, o.indent = "", was
                self.leave(seen)
                o.block(1)
            elif isinstance(k, str):
                if self.visible:
                    o.text(k)
            else:
                self.node(k, o, pre)

    def table(self, n: Node, o: Out) -> None:
        rows: list[list[tuple[list[str], int, int]]] = []  # lines, columns, the first column
        loose: list = []
        held: list[int] = []  # rows for which each column is still taken from above

        def cell(k: Node) -> list[str]:
            was, sub = self.enter(k), Out()
            self.kids(k.kids, sub, False)
            self.leave(was)
            return sub.done().split("\n")

        def place(cells: list[Node]) -> None:
            row, at, new = [], 0, []
            for k in cells:
                while at < len(held) and held[at]:
                    at += 1
                span, down = min(max(number(k.attrs.get("colspan", ""), 1), 1), COLUMNS), number(k.attrs.get("rowspan", ""), 1)
                row.append((cell(k), span, at))
                new.append((at, span, 65534 if down == 0 else min(max(down, 1), 65534)))
                at += span
            held[:] = [max(h - 1, 0) for h in held]
            for at, span, down in new:
                held.extend([0] * (at + span - len(held)))
                for c in range(at, at + span):
                    held[c] = max(held[c], down - 1)
            if row:
                rows.append(row)

        def walk(kids: list) -> None:
            for k in kids:
                if isinstance(k, str):
                    if k.strip():
                        loose.append(k)
                elif not self.seen(k):
                    continue
                elif k.tag in ("thead", "tbody", "tfoot"):
                    held.clear()  # cells end with their group of rows
                    was = self.enter(k)
                    walk(k.kids)
                    self.leave(was)
                    held.clear()
                elif k.tag == "tr":
                    was, cells = self.enter(k), []
                    for c in k.kids:
                        if isinstance(c, Node) and c.tag in ("td", "th"):
                            if self.seen(c):
                                cells.append(c)
                        elif not isinstance(c, str) or c.strip():
                            if self.visible or not isinstance(c, str):
                                loose.append(c)
                    place(cells)
                    self.leave(was)
                elif k.tag in ("td", "th"):
                    place([k])
                elif k.tag not in ("col", "colgroup"):
                    loose.append(k)

        walk(n.kids)
        for k in loose:  # captions and what stands between cells come first
            self.kids([k], o, False)
            o.block(1)
        width: list[int] = []
        for row in rows:
            for lines, span, at in row:
                width.extend([0] * (at + span - len(width)))
                if span == 1:
                    width[at] = max(width[at], *(len(x) for x in lines))
        left = [0]
        for w in width:
            left.append(left[-1] + w + 2)
        for row in rows:
            for r in range(max(len(lines) for lines, _, _ in row)):
                line = ""
                for lines, span, at in row:
                    line = line.ljust(left[at]) + (lines[r] if r < len(lines) else "").ljust(left[at + span] - left[at] - 2) + "  "
                o.block(1)
                if line.strip():
                    o.keep(line.rstrip())
            o.block(1)


def depth(root: Node) -> int:
    most, todo = 0, [(root, 1)]
    while todo:
        n, d = todo.pop()
        most = max(most, d)
        todo += [(k, d + 1) for k in n.kids if not isinstance(k, str)]
    return most


def render(doc: str) -> str:
    root, styles = parse(doc)
    out = Out()
    # calls nest with the elements; in this interpreter they take heap, not stack
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * depth(root) + 1000))
    Renderer(hiding(styles)).node(root, out, False)
    return out.done()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if t.as_py() is None else render(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_chars", "n_lines"])


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines) for every row.

    Null HTML gives null text; empty or wholly hidden pages give the empty text. Malformed markup never
    fails: what is no tag is text. Rows are independent, so repeats and ties don't matter; other columns of any
    name are ignored.
    """
    ship(df.sparkSession)
    kind = dict(df.select(id_col).dtypes)[id_col]
    return df.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(lean(_run), f"page_id {kind}, text string, n_chars long, n_lines long")
