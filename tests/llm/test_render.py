"""Rendering: expected layouts, and that all visible words come out once and in order."""

import random
import re

import pytest

from strandloom.llm.render import extract, render

CASES = [
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<p>a  b\n c</p><div>d</div><div>e</div>", "a b c\n\nd\ne"),
    ("a<br>b<br/>c</br>d", "a\nb\nc\nd"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"),
    ("<ol start=3><li>x</li><li value='7'>y</li><li>z</li></ol>", "3. x\n7. y\n8. z"),
    ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>long name<td>2</table>", "name       n\na          10\nlong name  2"),
    ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na  b"),
    ("<head><title>t</title><style>.x{display:none}</style><body><p class='x y'>no</p><p>yes", "yes"),
    ("<p hidden>no</p><p style='color:red; display : none'>no</p><script>var a='</p>';</script><p>yes</p><noscript>no</noscript>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
    ("<pre>\n  a\n    b</pre>", "  a\n    b"),
    ("<!-- c --><b>bo</b>ld <i> it </i> x", "bold it x"),
    ("<p>1 < 2 <a href='>'>l</a> <unfinished", "1 < 2 l"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>after", "t\n  d1\n  d2\n\nafter"),
    ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
    ("<h1>h</h1>t<h2>k</h2>", "h\n\nt\n\nk"),
    ("<p><b>open<br><p>next</p>", "open\n\nnext"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<title>t</title>body &lt;b&gt; &nbsp;x", "body <b> \xa0x"),
]


@pytest.mark.parametrize("doc,want", CASES)
def test_layout(doc, want):
    assert render(doc) == want


def test_words_survive_any_markup():
    r = random.Random(5)
    tags = ["p", "div", "b", "li", "ul", "table", "tr", "td", "h2", "span", "dd", "a", "section"]
    for _ in range(300):
        n, parts = 0, []
        for _ in range(r.randrange(1, 60)):
            x = r.random()
            if x < 0.5:
                parts.append(f" w{n} ")
                n += 1
            else:
                parts.append(f"<{'/' if x > 0.8 else ''}{r.choice(tags)}>")
        got = [w for w in render("".join(parts)).split() if w[0] == "w"]
        assert sorted(got) == sorted(f"w{i}" for i in range(n)), "".join(parts)


def test_rows(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [(1, None), (2, ""), (3, "<p>x"), (3, "<p>x"), (None, "<b>y"), (4, deep), (5, "<p>" + "word " * 200_000), (6, "<" * 2000), (7, "<a href=\"" * 500)]
    df = spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, text string")
    got = extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[3].text == "x" and by[None].text == "y" and by[4].text == "deep"
    assert by[5].n_chars == 5 * 200_000 - 1 and by[6].text == "<" * 2000
    assert extract(df.limit(0)).collect() == []


SHOWN = [
    ("<style>@media print{.nav{display:none}}</style><p class=nav>yes", "yes"),
    ("<style>@media (max-width:600px){.m{display:none}} @media screen and (min-width:600px){.n{display:none}}</style><p class=m>yes<p class=n>no", "yes"),
    ("<style media=print>p{display:none}</style><p>yes", "yes"),
    ("<style>@media not print{p{display:none}}</style><p>no<div>yes</div>", "yes"),
    ("<style>@import 'x'; .a{display:none}.a{display:block}</style><p class=a>yes", "yes"),
    ("<style>#i{display:block}.a{display:none}.b{display:none!important}.b{display:block}</style><p class=a id=i>yes<p class=b>no", "yes"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>yes", "yes"),
    ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>", "yes"),
    ("<style>.h{visibility:hidden}.v{visibility:visible}</style><ul class=h><li>no<li class=v>yes</ul>", "- yes"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
]


SHOWN += [
    ("<style>.a .b{display:none}</style><div class=a><p><i class=b>no</i>yes</p></div><p class=b>too", "yes\n\ntoo"),
    ("<style>.a > .b{display:none}</style><div class=a><p class=b>no</p><div><p class=b>yes</p></div></div>", "yes"),
    ("<style>div .a > p.b em{display:none}</style><div><div class=a><div class=a><p class=b><em>no</em>yes</div></div></div><p class=b><em>too</em>", "yes\n\ntoo"),
    ("<style>.a.b{display:none}p#i.c{display:none}* .d{display:none}</style><p class='b a'>no<p class=a>yes<p id=i class=c>no<p><b class=d>no</b>", "yes"),
    ("<style>.x .a{display:none}#o .a{display:block}</style><div id=o class=x><p class=a>yes</div>", "yes"),
    ("<div>" * 400 + "<div hidden>no</div>yes" + "</div>" * 400 + "<p>after", "yes\n\nafter"),
    ("<b>" * 3000 + "<p hidden>no</p>yes", "yes"),
    ("<table><tr>" + "".join(f"<td>{i % 10}" for i in range(301)) + "<tr><td colspan=300>wide<td>z</table>", "  ".join(str(i % 10) for i in range(301)) + "\n" + "wide".ljust(900) + "z"),
]


@pytest.mark.parametrize("doc,want", SHOWN)
def test_cascade_media_and_rowspan(doc, want):
    assert render(doc) == want


# --- a second renderer, from the tree that was written rather than from its markup -----------------------------------------

STYLE = "<style>.n{display:none} .a .m{display:none} div > .k{display:none} .h{visibility:hidden} .v{visibility:visible} .a .n.v{display:block} @media print{.a{display:none}}</style>"
MARGINS = {"div": 1, "p": 2, "h2": 2, "section": 1, "blockquote": 2, "pre": 2}


def tree(r, depth, inside=()):
    """Random kids: words, or (tag, classes, hidden, kids)."""
    out = []
    for _ in range(r.randrange(1, 5)):
        x = r.random()
        classes = tuple(c for c in "namkhv" if r.random() < 0.12)
        hidden = r.random() < 0.06
        if depth == 0 or x < 0.4:
            out.append(r.choice([" ", "", "\n"]) + " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 4))) + r.choice([" ", "", "  "]))
        elif x < 0.47 and "li" not in inside:
            out.append(("br", (), False, []))
        elif x < 0.6:
            out.append((r.choice(["span", "b", "i"]), classes, hidden, [k for k in tree(r, 0, inside)]))
        elif x < 0.7 and "p" not in inside:
            tag = r.choice(["ul", "ol"])
            out.append((tag, classes, hidden, [("li", (), r.random() < 0.1, [f"w{r.randrange(10**6)} ", *tree(r, depth - 1, (*inside, "li"))]) for _ in range(r.randrange(1, 4))]))
        elif x < 0.78 and "p" not in inside:
            rows = [("tr", (), False, [("td", (), r.choice([1, 1, 1, 2]), [f"w{r.randrange(10 ** r.randrange(1, 6))}"]) for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(1, 4))]
            out.append(("table", classes, hidden, rows))
        elif "p" not in inside:
            tag = r.choice(["div", "section", "p", "h2", "blockquote", "pre"])
            kids = ["w1\n  w2 \nw3"] if tag == "pre" else tree(r, depth - 1, (*inside, "p") if tag in ("p", "h2") else inside)
            out.append((tag, classes, hidden, kids))
    return out


def markup(kids):
    parts = []
    for k in kids:
        if isinstance(k, str):
            parts.append(k)
            continue
        tag, classes, hidden, inner = k
        attrs = f' class="{" ".join(classes)}"' if classes else ""
        if tag == "td":
            attrs = f" rowspan={hidden}"
        elif hidden:
            attrs += " hidden"
        parts.append("<br>" if tag == "br" else f"<{tag}{attrs}>{markup(inner)}</{tag}>")
    return "".join(parts)


def gone(k, around):
    tag, c, hidden, _ = k
    below_a = any("a" in x[1] for x in around)
    if below_a and {"n", "v"} <= set(c):
        return False
    rules = []  # (specificity, order, hides)
    if "n" in c:
        rules.append((1, 0))
    if "m" in c and below_a:
        rules.append((2, 1))
    if "k" in c and around and around[-1][0] == "div":
        rules.append((1, 2))
    return bool(rules) or tag != "td" and hidden is True


def seen(c, was):
    return True if "v" in c else False if "h" in c else was


def tokens(kids, around, visible, indent, pre=False):
    """Gaps, text, breaks and whole lines, each with its indent."""
    for n, k in enumerate(kids):
        if isinstance(k, str):
            if visible:
                yield ("pre" if pre else "text", k, indent)
            continue
        tag, c, _, inner = k
        if gone(k, around):
            continue
        now, path = seen(c, visible), (*around, k)
        if tag == "br":
            yield ("break", "", indent)
        elif tag in ("span", "b", "i"):
            yield from tokens(inner, path, now, indent, pre)
        elif tag in ("ul", "ol"):
            gap = 1 if indent else 2
            yield ("gap", gap, indent)
            at = 0
            for li in inner:
                if not gone(li, path):
                    at += 1
                    mark = f"{at}. " if tag == "ol" else "- "
                    yield ("gap", 1, indent)
                    if now:
                        yield ("mark", indent + mark, indent)
                    yield from tokens(li[3], (*path, li), now, indent + " " * len(mark))
                    yield ("unmark", "", indent)
                    yield ("gap", 1, indent)
            yield ("gap", gap, indent)
        elif tag == "table":
            yield ("gap", 2, indent)
            grid = {}
            for y, tr in enumerate(inner):
                x = 0
                for td in tr[3]:
                    while (y, x) in grid:
                        x += 1
                    for d in range(td[2]):
                        grid[y + d, x] = td[3][0] if d == 0 and now else ""
                    x += 1
            width = [max(len(v) for (_, x), v in grid.items() if x == at) for at in range(max(x for _, x in grid) + 1)]
            for y in range(len(inner)):
                line = "  ".join(grid.get((y, x), "").ljust(w) for x, w in enumerate(width)).rstrip()
                if line:
                    yield ("gap", 1, indent)
                    yield ("line", line, indent)
            yield ("gap", 2, indent)
        else:
            yield ("gap", MARGINS[tag], indent)
            yield from tokens(inner, path, now, indent + "  " if tag == "blockquote" else indent, tag == "pre")
            yield ("gap", MARGINS[tag], indent)


def second(kids):
    """Lines from tokens: what stands between gaps is one run, cut at breaks."""
    lines, run, gap, mark = [], [], 0, None

    def put(line):
        nonlocal gap, mark
        if gap > 1 and lines and lines[-1]:
            lines.append("")
        gap = 0
        lines.append(line)

    def finish():
        nonlocal run, mark
        pieces = [[]]
        for kind, s, indent in run:
            if kind == "break":
                pieces.append([])
            elif kind == "pre":
                for j, part in enumerate(s.split("\n")):
                    if j:
                        pieces.append([])
                    pieces[-1].append((part, indent, True))
            else:
                pieces[-1].append((s, indent, False))
        for j, piece in enumerate(pieces):
            kept = any(raw for *_, raw in piece)
            text = "".join(s for s, *_ in piece)
            text = text if kept else re.sub(r"\s+", " ", text).strip(" ")
            if text:
                lead = piece[0][1]
                if mark is not None:
                    lead, mark = mark, None
                put((lead + text).rstrip(" "))
            elif j < len(pieces) - 1:
                put("")
        run = []

    for kind, s, indent in tokens(kids, (), True, ""):
        if kind == "gap":
            finish()
            gap = max(gap, s)
        elif kind == "mark":
            mark = s
        elif kind == "unmark":
            finish()
            mark = None
        elif kind == "line":
            put((mark if mark is not None else indent) + s)
            mark = None
        else:
            run.append((kind, s, indent))
    finish()
    return "\n".join(lines).strip("\n")


def test_against_a_second_renderer():
    r = random.Random(11)
    for n in range(1500):
        kids = tree(r, 3)
        doc = STYLE + markup(kids)
        assert render(doc) == second(kids), (n, doc)
