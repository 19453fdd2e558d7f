"""The one Python stage of the engine: HTML to tagged node rows, parsed once per document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T
from eqloom.sources.durable import spread

SCHEMA = "id long, kind string, ord int, elem_id string, classes array<string>, para_id string, section_id string, text string, latex string, method string, number string, before string, after string, href string, mi array<string>, title string"
TOLD = frozenset({"table", "div", "a", "p", "span"})
KINDS = frozenset({"equation", "fragment", "para", "link", "page_p", "spot", "methods"})
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOTHING, RAW, MANY = frozenset(), {"script", "style"}, 1 << 14
TABLES, SOME, EQUATIONS = 0, 1 << 10, "ltx_eqn_table"  # a key that no attributes have
BLOCKS = {"div", "table", "ul", "ol", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "classes", "facts")

    def __init__(self, tag: str, attrs: dict, up: Node | None, classes: list[str]) -> None:
        self.tag, self.attrs, self.kids, self.up, self.classes = tag, attrs, [], up, classes
        self.facts: tuple | None = None  # what rows found out about the inside of a table

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def has(self, cls: str) -> bool:
        return cls in self.classes

    def under(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def raw(self) -> str:
        """All text inside, as it stands."""
        return "".join(k if isinstance(k, str) else k.raw() for k in self.kids)

    def markup(self) -> str:
        attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in self.attrs.items())
        inside = "".join(escape(k, quote=False) if isinstance(k, str) else k.markup() for k in self.kids)
        return f"<{self.tag}{attrs}/>" if self.tag in VOID else f"<{self.tag}{attrs}>{inside}</{self.tag}>"

    def text(self) -> str:
        if len(self.kids) == 1 and isinstance(self.kids[0], str) and self.tag not in RAW:
            return self.kids[0].strip()
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in RAW:
                stack += reversed(n.kids)
        return " ".join(s for s in (x.strip() for x in out) if s)

    def above(self, test) -> Node | None:
        n = self.up
        while n is not None and not test(n):
            n = n.up
        return n


MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*)>|!--.*?--!?>|![^>]*>|\?[^>]*>)", re.S)
LEAF = re.compile(r"([^<]*)</([a-zA-Z][^\s/>]*)>")
RAW_END = re.compile("</(?:script|style)", re.I)
ATTR = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")


SHUT = {tag: CLOSES.get(tag, NOTHING) | ({"p"} if tag in BLOCKS else NOTHING) for tag in CLOSES.keys() | BLOCKS}


def _attributes(rest: str) -> tuple[dict, list[str]]:
    attrs = {}
    for m in ATTR.finditer(rest):
        v = m[2]
        if v and v[0] in "\"'" and v[-1] == v[0]:
            v = v[1:-1]
        attrs[m[1].lower()] = unescape(v) if v and "&" in v else v
    return attrs, (attrs.get("class") or "").split()


def tree(html: str) -> Node:
    """The root of a page."""
    return in_order(html)[0]


def in_order(html: str, seen: dict | None = None) -> list[Node]:
    """The nodes of a page in document order, its root first.

    Marks are found by one pattern, an element that holds text alone is taken at once; `p`, `li` and table cells end where another begins.
    `seen` has what was read so far: attributes, which pages repeat and nothing changes, and whole tables.  A table that comes again
    word for word takes over the inside of the one before, whose page must be done with; within a page each is read anew.
    """
    root = at = Node("#root", {}, None, [])
    place, find, leaf, order = 0, MARK.search, LEAF.match, [root]
    seen, tables, open_table, used = ({} if seen is None else seen), None if seen is None else seen.setdefault(TABLES, {}), None, set()
    mark = find(html)
    while mark:
        start, after = mark.span()
        if start > place:
            text = html[place:start]
            at.kids.append(unescape(text) if "&" in text else text)
        place = after
        end, name, rest = mark.groups()
        if name is None:  # a comment or a declaration
            mark = find(html, place)
            continue
        tag = name.lower()
        if end:
            n = at
            while n is not None and n.tag != tag:
                n = n.up
            if n is not None and n.up is not None:
                at = n.up
                if open_table and start == open_table[2]:
                    if n is open_table[0]:  # nothing inside has closed what is outside
                        if len(tables) >= SOME:
                            tables.clear()
                        tables[open_table[3]] = order[open_table[1] :]
                    open_table = None
        else:
            if tag in SHUT:
                shut = SHUT[tag]
                while at.tag in shut:
                    at = at.up
            if rest not in seen:
                if len(seen) > MANY:
                    seen.clear()
                    if tables is not None:
                        seen[TABLES] = tables
                seen[rest] = _attributes(rest)
            attrs, classes = seen[rest]
            n = Node(tag, attrs, at, classes)
            at.kids.append(n)
            order.append(n)
            if tables is not None and tag == "table" and EQUATIONS in classes and (close := html.find("</table>", place)) >= 0:
                markup = html[start:close]
                if markup not in used:
                    used.add(markup)
                    if markup in tables:
                        old, *inside = tables[markup]
                        n.kids, n.facts = old.kids, old.facts
                        for k in n.kids:
                            if isinstance(k, Node):
                                k.up = n
                        order += inside
                        tables[markup][0] = n
                        place = close + 8
                        mark = find(html, place)
                        continue
                    open_table = n, len(order) - 1, close, markup
            if tag in RAW and not rest.endswith("/"):
                found = RAW_END.search(html, place)
                close = found.start() if found else len(html)
                n.kids.append(html[place:close])
                place = close
                at = n
            elif tag not in VOID and not rest.endswith("/"):
                if (whole := leaf(html, place)) and whole[2] == name:
                    if text := whole[1]:
                        n.kids.append(unescape(text) if "&" in text else text)
                    place = whole.end()
                else:
                    at = n
        mark = find(html, place)
    if place < len(html):
        at.kids.append(unescape(html[place:]))
    return order


# MathML elements with a place for each child; with fewer children, these are joined by the second string
PLACED = {
    "msup": ("{{{}}}^{{{}}}", ""),
    "msub": ("{{{}}}_{{{}}}", ""),
    "msubsup": ("{{{}}}_{{{}}}^{{{}}}", ""),
    "mfrac": ("\\frac{{{}}}{{{}}}", ""),
    "mroot": ("\\sqrt[{1}]{{{0}}}", " "),
    "munder": ("\\underset{{{1}}}{{{0}}}", " "),
    "munderover": ("{{{}}}_{{{}}}^{{{}}}", " "),
}
PLACES = {"msubsup": 3, "munderover": 3}
NAMED = {c[0]: "\\" + n for n, c in L.GREEK.items()} | L.IDENTIFIERS


def mathml(n: Node | str) -> str:
    """LaTeX of a MathML tree, when it carries neither annotation nor alttext."""
    if isinstance(n, str):
        return L.OPERATORS.get(n.strip(), n.strip())
    tag = n.tag.rpartition(":")[2]
    if tag == "annotation":
        return ""
    if tag in ("mi", "mo", "mn"):
        return {"mi": NAMED, "mo": L.OPERATORS}.get(tag, {}).get(n.raw(), n.raw())
    if tag == "mtext":
        return f"\\text{{{n.raw()}}}"
    if tag == "mspace":
        return "\\,"
    parts = [mathml(k) for k in n.kids if isinstance(k, str) or k.tag != "annotation"]
    if tag == "semantics":
        return " ".join(parts)
    parts = [p for p in parts if p]
    if tag in PLACED:
        shape, joint = PLACED[tag]
        return shape.format(*parts) if len(parts) >= PLACES.get(tag, 2) else joint.join(parts)
    if tag == "mover" and len(parts) >= 2:
        under = n.under()
        return L.ACCENTS.get(under[1].raw() if len(under) > 1 else "", "\\hat") + f"{{{parts[0]}}}"
    inside = {"mtr": " & ", "mtable": " \\\\ "}.get(tag, " ").join(parts)
    return {"msqrt": f"\\sqrt{{{inside}}}", "mtable": f"\\begin{{matrix}} {inside} \\end{{matrix}}"}.get(tag, inside)


def latex(m: Node) -> tuple[str, str]:
    for k in m.walk():
        if k.tag == "annotation" and k.attrs.get("encoding") == "application/x-tex" and k.text().strip():
            raw, how = k.text().strip(), "annotation"
            break
    else:
        alt = (m.attrs.get("alttext") or "").strip()
        raw, how = (alt, "alttext") if alt else (mathml(m), "mathml")
    return clean(raw), how


def clean(raw: str) -> str:
    """LaTeX without one leading display command and without comment breaks."""
    return raw.strip().removeprefix("\\displaystyle").lstrip().replace("%\n", "").strip()


def scope(tag: Node) -> Node | None:
    """What one printed number stands for: its table row, else the nearest equation element."""
    return tag.above(lambda a: a.tag == "tr") or tag.above(lambda a: a.tag in ("table", "div", "span") and any("ltx_equation" in c for c in a.classes))


def identifiers(m: Node) -> list[str]:
    """Names of a formula in order; one with a plain subscript comes as base_subscript, then as its base."""
    out = []
    for n in m.walk():
        if n.tag != "mi":
            continue
        name, kids = n.text(), [k for k in n.up.kids if isinstance(k, Node)]
        if n.up.tag == "msub" and len(kids) > 1 and kids[0] is n and kids[1].text().isalnum():
            out.append(f"{name}_{kids[1].text()}")
        out.append(name)
    return out


def number(s: str) -> str | None:
    return m[1] if (m := re.match(L.EQ_NUMBER, s)) else None


def _facts(n: Node) -> tuple:
    """Of an equation table: its nodes, single tags, tags of a group, formulas, the shown number, and (latex, method, number, mi) of each formula when asked."""
    inside, known, asked = list(n.walk()), [], []
    spans = [s for s in inside if s.tag == "span"]
    tags = [s for s in spans if s.has("ltx_tag_equation")]
    group = [s for s in spans if s.has("ltx_tag_equationgroup")]
    maths = [m for m in inside if m.tag == "math"]

    def found() -> list[tuple]:
        if asked:
            return known
        out = []
        if n.has("ltx_equationgroup") and group:
            parts = [latex(m) for m in maths]
            if parts:
                out.append((group[0], " \\\\\n".join(p for p, _ in parts if p), min((h for _, h in parts), key=("annotation", "alttext", "mathml").index)))
        elif n.has("ltx_equationgroup"):
            last = None
            for tr in (r for r in inside if r.tag == "tr"):
                own = [m for m in tr.walk() if m.tag == "math"]
                t = [s for s in tr.walk() if s.tag == "span" and s.has("ltx_tag_equation")]
                if t and (own or last is not None):
                    out.append((t[0], *latex(own[0] if own else last)))
                last = own[0] if own else last
        elif tags and maths:
            out.append((tags[0], *latex(maths[0])))
        for t, tex, how in out:  # a shared number leaves the identifiers to the LaTeX
            known.append((tex, how, number(t.text()), identifiers(maths[0]) if t in tags else None))
        asked.append(True)
        return known

    return inside, tags, group, maths, tags[0].text().strip("()") if tags else None, found


def rows(doc_id: int, html: str, kinds: frozenset = KINDS, cap: int | None = None, attributes: dict | None = None) -> Iterator[tuple]:
    """Rows of the wanted kinds of a page, in document order.

    equation: a numbered formula.  fragment: an equation table, with the first annotation as latex
    or else the alttext as `before`, its markup as `after`, and method `math` if it has a formula.
    spot: a numbered table inside a paragraph, with the prose of the paragraph before and after
    it, and method `child` if it lies right under the paragraph.  methods: the three ways to the
    LaTeX of a number, annotation as latex, alttext as text, MathML as `before`.  para, page_p and link.
    With `cap`, equations are the first of each of the first `cap` numbers, and spots of later numbers have no prose.
    `attributes` keeps what was read of attributes for the next page.
    """
    seen: set[str] = set()  # numbers of the equations so far
    full = lambda: cap is not None and len(seen) >= cap
    of = lambda n: n.attrs.get("id") if n is not None else None
    boxes, sections = {}, {}  # the paragraph and the section around what is right under a node

    def box_of(n: Node) -> Node | None:
        if n.up not in boxes:
            boxes[n.up] = n.above(lambda a: a.tag == "div" and a.has("ltx_para"))
        return boxes[n.up]

    def section_of(n: Node) -> Node | None:
        if n.up not in sections:
            sections[n.up] = n.above(lambda a: a.tag == "section")
        return sections[n.up]

    said: dict[Node, list] = {}  # prose children of a paragraph with their places, found once

    def prose(box: Node) -> list[tuple[int, str]]:
        if box not in said:
            said[box] = [(i, s) for i, k in enumerate(box.kids) if isinstance(k, Node) and k.tag == "p" and k.has("ltx_p") and (s := k.text())]
        return said[box]

    def place(box: Node, n: Node) -> int:
        while n.up is not box:
            n = n.up
        return next(i for i, k in enumerate(box.kids) if k is n)

    def title(box: Node | None) -> str | None:
        return next((k.text() for k in box.kids if isinstance(k, Node) and k.has("ltx_title")), None) if box is not None else None

    def sides(t: Node) -> tuple[str, str]:
        box = box_of(t) or t.above(lambda a: a.tag == "p") or t.up
        at = place(box, t)

        def two(kids) -> list[str]:
            out = []
            for k in kids:
                if isinstance(k, Node) and (s := k.text()):
                    out.append(s)
                    if len(out) == 2:
                        break
            return out

        return " ".join(two(reversed(box.kids[:at]))[::-1]), " ".join(two(box.kids[at + 1 :]))

    def row(kind, i, n, text=None, latex=None, method=None, number=None, before=None, after=None, href=None, mi=None):
        sec = section_of(n)
        return (doc_id, kind, i, of(n), n.classes, of(n if kind == "para" else box_of(n)), of(sec), text, latex, method, number, before, after, href, mi, title(sec) if kind in ("para", "spot") else None)

    order = in_order(html or "", attributes)
    for i, n in enumerate(order):
        if n.tag not in TOLD:
            continue
        if n.tag == "table" and n.has("ltx_eqn_table") and kinds & {"equation", "fragment", "spot"}:
            if n.facts is None:
                n.facts = _facts(n)
            inside, tags, group, maths, num, found = n.facts
            if "fragment" in kinds:
                tag = (tags or group or [None])[0]
                own = next((a.raw() for a in inside if a.tag == "annotation" and a.attrs.get("encoding") == "application/x-tex"), None)
                alt = (maths[0].attrs.get("alttext") or "").strip()[:120] if maths and own is None else ""
                yield row("fragment", i, n, text=tag.text() if tag else "?", latex=None if own is None else own[:120].strip(), before=alt or None, after=n.markup(), method="math" if maths else None)
            if "spot" in kinds and tags and of(n) and (box := box_of(n)) is not None:
                at = place(box, n)
                near = [] if full() and num not in seen else prose(box)
                yield row("spot", i, n, number=num, method="child" if n.up is box else None, before=" ".join(s for j, s in near if j < at), after=" ".join(s for j, s in near if j > at))
            if "equation" not in kinds or full():
                continue
            before, after = sides(n)
            for k, (tex, how, num, mi) in enumerate(found()):
                if num and not (cap is not None and (full() or num in seen)):
                    seen.add(num)
                    yield row("equation", i * 100 + k, n, latex=tex, method=how, number=num, before=before, after=after, mi=mi)
        elif "para" in kinds and n.tag == "div" and n.has("ltx_para") and of(n):
            yield row("para", i, n, text=" ".join(s for _, s in prose(n)))
        elif "link" in kinds and n.tag == "a" and n.has("ltx_ref") and "#" in (n.attrs.get("href") or ""):
            p = n.above(lambda a: a.tag == "p")
            yield row("link", i, n, text=n.text(), before=p.text() if p is not None else None, href=n.attrs["href"].partition("#")[2])
        elif "page_p" in kinds and n.tag == "p":
            yield row("page_p", i, n, text=n.text())
        elif "methods" in kinds and n.tag == "span" and n.has("ltx_tag_equation") and (num := number(n.text())) and (box := scope(n)):
            if m := next((k for k in box.walk() if k.tag == "math"), None):
                own = next((a.raw().strip() for a in m.walk() if a.tag == "annotation" and a.attrs.get("encoding") == "application/x-tex"), "N/A")
                yield row("methods", i, n, number=num, latex=own, text=(m.attrs.get("alttext") or "").strip() or "N/A", before=mathml(m).strip() or "N/A")
    if attributes is not None:
        for n in order:
            if n.facts is not None:
                n.up = None  # tables that are kept don't keep their page


# what the written papers say of a symbol, before and after it, by k % 7
DEFINED = [
    ("Now let ", " be the phase velocity, as said."),
    ("And where ", " is the mean number, as said."),
    ("Now let ", " be the phase velocity, as said."),
    ("Here ", " denotes the total energy, as said."),
    ("And where ", " is the mean number, as said."),
    ("Then ", ", the outer field, grows."),
    ("Take the spin density ", " now."),
]


def nodes(pages: DataFrame, id_col: str, html_col: str, kinds: frozenset | set = KINDS, cap: int | None = None) -> DataFrame:
    """Node rows of the given kinds of every page; a null or broken page has those that could be read.

    The tree is built once a page, and rows of other kinds are never made; `cap` is as in rows.
    """
    kinds, parse = frozenset(kinds), rows
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        import pyarrow as pa

        text, num = pa.string(), pa.int64()
        types = [num, text, pa.int32(), text, pa.list_(text), *[text] * 9, pa.list_(text), text]
        attributes: dict = {}
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200).to_pydict()
                out = [r for i, h in zip(part["id"], part["html"]) for r in parse(i, h, kinds, cap, attributes)]
                cols = zip(*out) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    src = spread(pages, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).where("id is not null")
    return src.mapInArrow(run, SCHEMA)


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def first_words(c: Column) -> Column:
    """The first three runs of ASCII letters of a sentence, lower-cased."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1), 1, 3), " ")


def templated(docs: DataFrame) -> DataFrame:
    """(id, html): papers written from the sentences of documents (doc_id, text); a null text writes none.

    Sentence i (from 0) is a paragraph; six paragraphs are a section with a title.  Digits and
    brackets of the sentences are dropped, so that nothing but the template cites.  Every
    third paragraph holds formula k, in one of four shapes by k % 4: annotation, alttext alone, MathML
    alone with its number in the next row, and two formulas under one number.  Its symbol is one
    of Q, W, H, defined in one of the five forms (by k % 7); even formulas of one row have J as well.  By k % 3
    it cites the formula before it, or substitutes it.  The paragraph after it links to it.
    """
    s = F.filter(F.transform(T.sentences(F.col("text")), T.strip), lambda x: F.length(x) >= 10)
    of = lambda i, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    p = lambda *parts: F.concat(F.lit('<p class="ltx_p">'), *parts, F.lit("</p>"))
    lit = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def formula(k, n):
        c, even, shape = of(k, "H", "Q", "W"), (k % 2 == 0) & (k % 4 != 0), k % 4
        tree = lit("<mrow><msub><mi>", c, "</mi><mn>", n, "</mn></msub><mo>=</mo><mi>ρ</mi>", F.when(even, "<mo>+</mo><mi>J</mi>").otherwise(""), "</mrow>")
        tex = lit(c, "_{", n, "}=m", F.when(even, "+J").otherwise(""))
        note = lambda x: lit('<annotation encoding="application/x-tex">', x, "</annotation>")
        tag = lambda kind: lit('<span class="ltx_tag ltx_tag_', kind, '">(', n, ")</span>")
        rows = (
            F.when(shape == 1, lit("<tr><td><math><semantics>", tree, note(lit("\\displaystyle ", tex)), "</semantics></math></td><td>", tag("equation"), "</td></tr>"))
            .when(shape == 2, lit('<tr><td><math alttext="', tex, '">', tree, "</math></td><td>", tag("equation"), "</td></tr>"))
            .when(shape == 3, lit("<tr><td><math>", tree, "</math></td></tr><tr><td>", tag("equation"), "</td></tr>"))
            .otherwise(lit("<tr><td>", tag("equationgroup"), "<math>", note(lit("U_{", n, "}")), '</math></td></tr><tr><td><math alttext="V_{', n, '}"></math></td></tr>'))
        )
        kind = F.when(shape.isin(1, 2), "ltx_equation").otherwise("ltx_equationgroup")
        return lit('<table class="', kind, ' ltx_eqn_table" id="S1.E', n, '">', rows, "</table>")

    def told(x, k, n):
        c, before = of(k, "H", "Q", "W"), (k - 1).cast("string")
        means = lit("Equation (", n, ") denotes the density operator of ", first_words(x), ". ")
        form = F.element_at(F.array(*[lit(a, c, b) for a, b in DEFINED]), (k % 7 + 1).cast("int"))
        more = F.when((k % 2 == 0) & (k % 4 != 0), " Also where J is the coupling strength, as said.").otherwise("")
        cited = F.when(k % 3 == 0, p(lit("It is found by (", before, ") at once."))).when(k % 3 == 2, p(lit("Substituting (", before, ") yields it."))).otherwise("")
        return lit(p(means, form, more), cited, formula(k, n), p(F.lit("It ends here.")), p(F.lit("Then more follows.")), p(F.lit("Nobody looks so far.")))

    def para(x, i):
        k, sec = F.floor((i + 1) / 3).cast("int"), (F.floor(i / 6) + 1).cast("int").cast("string")
        n, last = k.cast("string"), F.floor(i / 3).cast("int").cast("string")
        head = F.when(i % 6 == 0, lit(F.when(i > 0, "</section>").otherwise(""), '<section id="S', sec, '"><h2 class="ltx_title">Part ', of(F.floor(i / 6), "One", "Two", "Six", "Ten"), "</h2>")).otherwise("")
        plain = F.array(T.strip(F.regexp_replace(x, "[0-9()]", "")))  # an array, so that it is made once
        words = F.element_at(F.transform(plain, lambda y: _escaped(F.when(y.rlike("[.!?]$"), y).otherwise(F.concat(y, F.lit("."))))), 1)
        link = F.when((i % 3 == 0) & (i > 0), lit(' as in <a class="ltx_ref" href="#S1.E', last, '">(', last, ")</a>")).otherwise("")
        return lit(head, '<div class="ltx_para" id="S', sec, ".p", (i % 6 + 1).cast("string"), '">', p(words, link), F.when(i % 3 == 2, told(x, k, n)).otherwise(""), "</div>")

    page = lit("<html><body>", F.array_join(F.transform(s, para), ""), "</section></body></html>")
    out = spread(docs.select("doc_id", "text").where("text is not null"), "doc_id", 4).select(F.col("doc_id").alias("id"), page.alias("html"))
    out.dealt = True
    return out
