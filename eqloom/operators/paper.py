"""The analysis of one paper at a time: passages, search, meanings, symbols and pairs without a shuffle.

A paper's analysis needs nothing but the paper (at most seven formulas, 42 pairs, its own passages), so a worker
that has parsed the page goes on to the results.  The rules are those of the column expressions in documents,
retrieval, meaning, symbols and relations, which serve tables of any kind; tests hold the two against each other.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from math import log, sqrt
from string import ascii_lowercase, digits

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T
from eqloom.operators import documents as D
from eqloom.operators import meaning as M
from eqloom.operators import relations as E
from eqloom.operators import retrieval as R
from eqloom.operators import symbols as S
from eqloom.sources import html as H
from eqloom.sources.durable import spread

# the columns of each table behind the paper's id
PARTS = {
    "equations": "eq_num string, eq_ord int, equation string, source string, latex_method string, before string, after string, mi array<string>",
    "chunks": "chunk_ord int, chunk_id string, chunk_type string, text string, section_id string, section_title string, para_id string, eq_nums array<string>, char_offset int",
    "xrefs": "ord int, from_para_id string, sentence string, to_eq_num string, source string",
    "places": "eq_num string, section_id string, para_id string",
    "asked": "eq_num string, query string, hits long",
    "meanings": "eq_num string, meaning string, points int, bm25 double, chunk_id string, char_start int, char_end int, signals array<string>",
    "symbols": "eq_num string, ord int, sym string, definition string, pattern string, confidence string, reject_reason string, chunk_id string",
    "relations": "a string, b string, grade string, description string, jaccard double, cosine double, signals array<string>",
}

# --- Java's patterns -------------------------------------------------------------------------------------------

BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # white space of Unicode
# characters of which Python and Java agree whether they belong to words, are blanks, or have another case
COMMON = re.compile("[\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0132-\u017e\u0180-\u024f\u0391-\u03a1\u03a3-\u03c9\u2010-\u2027\u2030-\u203e]*")


def kept(f):
    """f remembers what it gave; a plain dict, since it travels to the workers with what it holds."""
    seen: dict = {}

    def ask(*key):
        if key not in seen:
            if len(seen) > 1 << 14:
                seen.clear()
            seen[key] = f(*key)
        return seen[key]

    return ask


@kept
def _class(kinds: str, more: str) -> str:
    """The characters of some general categories, as the inside of a class."""
    out, start, kinds = [], None, kinds.split()
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i)).startswith(tuple(kinds))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out) + more


def java(pattern: str, unicode: bool, common: bool) -> str:
    """A pattern as Python takes it: `unicode` is Java's (?U); `common` for texts of common characters, where it is faster."""
    space = (r"\s" if common else BLANK) if unicode else r" \t-\r"


    def word() -> str:
        if common or not unicode:
            return r"\w" if unicode else "a-zA-Z0-9_"
        return _class("L M Nd Nl Pc", "\\u200c\\u200d\\u24b6-\\u24e9\\U0001f130-\\U0001f149\\U0001f150-\\U0001f169\\U0001f170-\\U0001f189")

    def edge() -> str:
        side = "" if common else word() if unicode else _class("L Nd", "_")
        return f"(?:(?<![{side}])(?=[{side}])|(?<=[{side}])(?![{side}]))" if side else r"\b"

    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            i += 2
            if n == "x" and pattern[i] == "{":
                end = pattern.index("}", i)
                out.append(f"\\U{int(pattern[i + 1 : end], 16):08x}")
                i = end + 1
            elif n in "swd":
                chars = word() if n == "w" else {"s": space, "d": "0-9"}[n]
                out.append(chars if inside else f"[{chars}]")
            elif n == "S":
                out.append(f"^{space}" if inside else f"[^{space}]")
            elif n == "b":
                out.append(edge())
            else:
                out.append(c + n)
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(c)
        i += 1
    return "".join(out).replace("(?i)", "")


class Pattern:
    """A pattern of Java in both forms; `on` gives the one for a text."""

    def __init__(self, pattern: str, unicode: bool = True, flags: int = 0) -> None:
        self.pattern, self.unicode, self.flags = pattern, unicode, flags
        self.common = re.compile(java(pattern, unicode, True), flags)
        self.exact = None

    def on(self, text: str):
        return self.common if COMMON.fullmatch(text) else self.any()

    def any(self):
        if self.exact is None:
            self.exact = re.compile(java(self.pattern, self.unicode, False), self.flags | (0 if self.unicode else re.A))
        return self.exact


# what a text must hold one of for a pattern to change it; an empty tuple: a character beyond ASCII
ARTIFACT = "italic_", "start_", "end_", "_ARG", "road_", "script", "SCRIPT"
CONTEXT_ARTIFACT = "italic-", "italic_", "start_", "end_", "_ARG", "road_", "caligraphic_", "bold_"
SCRIPT, LATEX = ("_{", "^{"), ("\\",)
CLEANERS = [(Pattern(p), by, holds) for p, by, holds in ((L.ARTIFACTS, " ", ARTIFACT), (L.MATH_LETTERS, " ", ()), (L.ZERO_WIDTH, "", ()), (L.SCRIPTS, "", SCRIPT), (L.RAW_LATEX, "", LATEX), (r"\s+", " ", ("",)))]
GENTLE = [(Pattern(p), "", holds) for p, holds in ((L.CONTEXT_ARTIFACTS, CONTEXT_ARTIFACT), (L.MATH_LETTERS, ()), (L.SCRIPTS, SCRIPT), (L.RAW_LATEX, LATEX))]
SCRIPT_WORDS = Pattern(L.SCRIPT_WORDS.replace("(?i)", ""), flags=re.I)
PLAIN, PLAIN_CONTEXT = (re.compile(f"(?! )[{signs}\xc0-\u024f ]*(?<! )") for signs in (r"!-\[\]`-~", r"!-\[\]`-z|~"))
BOUNDARY = re.compile(f"[.!?][{BLANK}]+(?=[A-Z(])")
TERM, WORD, LETTERS = re.compile("[a-z0-9]{2,}|[0-9]"), re.compile("[^ \t-\r]+"), re.compile("[a-z]+")
GOOD = re.compile("[a-zA-Z][^ \t-\ra-zA-Z]*[a-zA-Z][^ \t-\r]*")
CITATION, BRACKETED, CUE = Pattern(r"\(\s*(\d+[a-z]?(?:\.\d+)?)\s*\)", False, re.I | re.A).any(), Pattern(L.BRACKETED, False, re.A).any(), Pattern(L.DEFINITION_CUE, False, re.I)
PARAGRAPH, SECTION_OF = (re.compile(p.replace(r"\d", "[0-9]")) for p in (L.PARAGRAPH, L.SECTION_OF))
LINK_TARGET, LINK_NUMBER = (re.compile(p.replace(r"\d", "[0-9]")) for p in (L.LINK_TARGET, L.LINK_NUMBER))
NAMES = [n for x in L.GAZETTEER if not any(y.lower() in (n := x.lower()) and y.lower() != n for y in L.GAZETTEER)]
CUES = "define", "describe", "represent", "give", "denote"  # one of them is in any cue
NO_TERM = {*L.RETRIEVAL_STOP, *L.RETRIEVAL_ARTIFACTS}
NO_RUN = NO_TERM | set(ascii_lowercase)  # runs of letters and digits that are no terms
RUNS = bytes(c if chr(c) in ascii_lowercase + digits + "\0" else 32 for c in range(256))
PAIR_STOP, MEANING_STOP, DANGLING, DEFINITION_STOP = map(frozenset, (L.PAIR_STOP, L.MEANING_STOP, L.DANGLING, L.DEFINITION_STOP))
GREEK_NAME = {c: n for n, chars in L.GREEK.items() for c in chars}
SKIP, SKIP_LOWER, SKIP_LETTERS = frozenset(L.SKIP_COMMANDS), frozenset(c.lower() for c in L.SKIP_COMMANDS), frozenset(L.SKIP_LETTERS)
AFTER = r"([^\n\r\x85\u2028\u2029]*)(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
FAR = 1 << 20


def strip(s: str) -> str:
    return s.strip(T.BLANKS)


def cleaned(s: str, cleaners: list) -> str:
    common = COMMON.fullmatch(s) is not None  # and stays so, since hardly more than blanks comes in
    for p, by, holds in cleaners:
        if any([x in s for x in holds]) if holds else not s.isascii():
            s = (p.common if common else p.any()).sub(by, s)
    return s


def clean_text(s: str) -> str:
    if PLAIN.fullmatch(s) and "  " not in s and "script" not in s and "SCRIPT" not in s:
        return s
    return strip(cleaned(s.replace("\xa0", " "), CLEANERS))


def clean_context(s: str) -> str:
    if PLAIN_CONTEXT.fullmatch(s) and "  " not in s and "script" not in s.lower() and "italic" not in s and "caligraphic" not in s and "bold" not in s:
        return s
    s = cleaned(s.replace("\xa0", " "), GENTLE)
    if "script" in s.lower() or not s.isascii():
        s = SCRIPT_WORDS.on(s).sub("", s)
    s = s.replace("{", "").replace("}", "")
    return strip(re.sub(" {2,}", " ", s) if "  " in s else s)


def sentences(s: str) -> list[str]:
    out, at = [], 0
    for m in BOUNDARY.finditer(s):
        out.append(s[at : m.start() + 1])
        at = m.end()
    return [*out, s[at:]]


def pieces(s: str) -> list[str]:
    out, at = [], 0
    for m in BOUNDARY.finditer(s):
        out.append(s[at : m.end()])
        at = m.end()
    out.append(s[at:])
    return [y for x in out for y in x.split("\x1f")] if "\x1f" in s else out


def tokens(s: str) -> list[str]:
    return [t for t in TERM.findall(s.lower()) if t not in NO_TERM]


@kept
def counted(query: str) -> list[tuple[str, int]]:
    """The terms of a query with their numbers."""
    return list(Counter(tokens(query)).items())


def is_prose(s: str) -> bool:
    words = len(s.split()) if s.isascii() and s.isprintable() else len(WORD.findall(s))
    return words >= 3 and len(GOOD.findall(s)) / words >= 0.4


def rounded(x: float) -> float:
    """To six places as Spark rounds: halves of the written number go up."""
    return float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) if abs(x * 1e6 % 1 - 0.5) < 1e-4 else round(x, 6)


def as_int(number: str) -> int | None:
    return int(number) if re.fullmatch("[0-9]+", number) and int(number) < 1 << 31 else None


@kept
def paragraph(para_id: str | None) -> tuple:
    m = PARAGRAPH.search(para_id) if para_id else None
    return (m[1], int(m[2]) if int(m[2]) < 1 << 63 else None) if m else (None, None)


def beside(a: tuple, b: tuple) -> bool:
    """Whether two paragraphs, as paragraph gives them, are next to each other."""
    return a[0] is not None and a[0] == b[0] and a[1] is not None and b[1] is not None and abs(a[1] - b[1]) == 1


def next_to(a: str | None, b: str | None) -> bool:
    return beside(paragraph(a), paragraph(b))


# --- the parts of a paper --------------------------------------------------------------------------------------


class Passage:
    __slots__ = ("kind", "text", "section", "title", "para", "nums", "start", "ord", "paper")

    def __init__(self, kind, text, section, title, para, nums, start) -> None:
        self.kind, self.text, self.section, self.title, self.para, self.nums, self.start = kind, text, section or "", title or "", para or "", nums, start

    @property
    def id(self) -> str:
        return f"{self.paper}:{self.section}:{self.kind}:{self.ord}"


@kept
def shown(s: str) -> tuple | None:
    """(cited, cue, named): what a sentence shows by itself; None if it is no prose."""
    if len(s) <= 10 or not is_prose(s):
        return None
    low = s.lower()
    return [c.lower() for c in BRACKETED.findall(s)] if "(" in s else [], any(map(low.__contains__, CUES)) and CUE.on(s).search(s) is not None, any(map(low.__contains__, NAMES))


def said(text: str, seen: dict) -> list[tuple]:
    """(pos, sentence, place, cited, cue, named) of the prose sentences of the cleaned text; `seen` has the paper's texts and sentences so far."""
    if (text, 0) in seen:
        return seen[text, 0]
    out, at = [], 0
    for i, x in enumerate(pieces(clean_context(text))):
        s = strip(x)
        if s not in seen:
            seen[s] = shown(s)
        if known := seen[s]:
            out.append((i, s, at, *known))
        at += len(x)
    seen[text, 0] = out
    return out


def passages(paper_id: int, paras: list, spots: list, eqs: list) -> list[Passage]:
    """documents.passages; paras and spots are (section, title, para, ...) rows in their order."""
    numbers: dict = {}
    for _, number, child, _, _, _, _, para in spots:
        if child == "child" and para is not None and number not in (own := numbers.setdefault(para, [])):
            own.append(number)
    kept = [(text, sec, title, para, sentences(text)) for _, raw, sec, title, para in paras if (text := clean_text(raw))]
    out = []
    for _, sec, title, para, cut in kept:
        at = 0
        for s in cut:
            if len(t := strip(s)) >= D.SENTENCE:
                out.append(Passage("sentence", t, sec, title, para, numbers.get(para, []), at))
            at += len(s) + 1
    out += [Passage("paragraph", text, sec, title, para, numbers.get(para, []), 0) for text, sec, title, para, _ in kept]
    first: dict = {}
    for x in spots:
        first.setdefault(x[1], x)
    near = [(n is None, n or 0, e[1], e[2], first[e[0]]) for e in eqs if e[0] in first for n in (as_int(e[0]),)]
    for _, _, _, tex, (_, _, _, before, after, sec, title, para) in sorted(near, key=lambda x: x[:4]):
        if text := " ".join(x for x in (title, clean_text(before), tex, clean_text(after)) if x):
            out.append(Passage("equation_neighborhood", text, sec, title, para, numbers.get(para, []), 0))
    for i, p in enumerate(out):
        p.ord, p.paper = i, paper_id
    return out


def cross_references(links: list, spots: list, chunks: list[Passage]) -> list[tuple]:
    known: dict = {}
    for _, number, _, _, _, _, _, _, *elem in spots:
        known.setdefault(elem[0], number)
    out, covered = [], set()
    for at, para, href, text, before in links:
        if para is None or not LINK_TARGET.search(href):
            continue
        number = known.get(href)
        shown = m[1] if number is None and (m := LINK_NUMBER.search(text)) else None
        if (to := number if number is not None else shown) is not None:
            out.append((at, para, clean_text(before or "")[: D.EVIDENCE], to, "structural" if number is not None else "structural_text"))
            covered.add((para, to))
    for c in chunks:
        if c.kind == "sentence" and "(" in c.text:
            for to in CITATION.findall(c.text):
                if (c.para, to) not in covered:
                    covered.add((c.para, to))
                    out.append((c.ord + (1 << 30), c.para, c.text[: D.EVIDENCE], to, "lexical"))
    return out


@kept
def _plain_letters(b: str) -> bool:
    return re.fullmatch("[A-Za-z][A-Za-z0-9]*", b) is not None or b != "" and all(unicodedata.category(c)[0] == "L" for c in b)


def symbols_of(mi: list | None, tex: str) -> list[str]:
    if mi is None:
        found = ((t.removeprefix("\\"), t) for t in re.findall(r"\\[a-zA-Z]+|[A-Za-z]", tex))
        return list(dict.fromkeys(n for n, t in found if (n in L.GREEK if t[0] == "\\" else n not in SKIP_LETTERS)))
    name = lambda x: GREEK_NAME.get(x, x.removeprefix("\\"))
    out = []
    for x in mi:
        base, under = name(x.partition("_")[0]), name(m[1] if (m := re.search("_" + AFTER, x)) else "")
        if base not in SKIP and (len(base) == 1 or base.lower() not in SKIP_LOWER) and _plain_letters(base):
            out.append(f"{base}_{under}" if under else base)
    return list(dict.fromkeys(out))


def forms(sym: str) -> list[str]:
    return [*L.GREEK.get(sym, ""), sym]


@kept
def _definitions(sym: str) -> tuple:
    safe = lambda s: "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else "\\" + c for c in s)
    own = "|".join(map(safe, forms(sym)))
    plain = [f.lower() for f in forms(sym)]
    # symbols of letters and digits alone are found as whole words
    words = plain if all(f.replace("_", "a").isalnum() for f in plain) else None
    there = Pattern(rf"(?:\b|\$\\?)(?:{own})(?:\b|[\s,$]|$)", flags=re.I)
    shapes, out = rf"{own}|\$\\?{safe(sym)}\$", []
    for name, template, confidence in L.DEFINITIONS:
        left, right = template.split("{SYM}")
        first = re.match(r"\\b([a-z]+)", left)
        after = Pattern(re.split(r"\((?!\?)", right)[0], flags=re.I | re.S).common  # what must come right after the symbol
        out.append((first[1] if first else "", name, confidence, Pattern(f"{left}(?:{shapes}){right}", flags=re.I | re.S), left.endswith(r"\s+"), after))
    return plain, there, out, words


def alone(word: str, low: str) -> list[tuple[int, int]]:
    """Where a lower-cased text of common characters holds a word by itself."""
    out, at = [], low.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and ((c := low[at - 1]).isalnum() or c == "_")) and not (end < len(low) and ((c := low[end]).isalnum() or c == "_")):
            out.append((at, end))
        at = low.find(word, at + 1)
    return out


class Context:
    """A text in which phrases are looked for, with what is asked of it again and again."""

    __slots__ = ("text", "low", "common")

    def __init__(self, text: str) -> None:
        self.text, self.low, self.common = text, text.lower(), COMMON.fullmatch(text) is not None

    def search(self, p: Pattern):
        return (p.common if self.common else p.any()).search(self.text)


def find(sym: str, c: Context) -> tuple | None:
    """symbols.find: (definition, pattern, confidence)."""
    plain, there, templates, words = _definitions(sym)
    # µ and ς have another case than Python's lower gives them, and a dollar is part of a symbol's shape
    if words is not None and c.common and not ("$" in c.low or "\xb5" in c.low or "\u03c2" in c.low):
        places = [x for w in words for x in alone(w, c.low)]
        templates = [t for t in templates if any([(at and c.low[at - 1].isspace() or not t[4]) and t[5].match(c.text, end) for at, end in places])] if places else ()
    elif not (any(f in c.low for f in plain) and c.search(there)):
        return None
    for word, name, confidence, p, _, _ in templates:
        if word in c.low and (m := c.search(p)):
            got = strip(m[1] or "")
            if got and len(re.split(f"[{BLANK}]+", got)) <= S.WORDS:
                return got, name, confidence
    return None


def reject_reason(d: str, sym: str, others: list[str]) -> str | None:
    low, d = d.lower(), strip(d)
    words = WORD.findall(d.lower())
    if len(d) <= 1:
        return "single_char_def"
    if d.lower() == sym.lower():
        return "def_equals_symbol"
    if d in others or d.lower() in [x for o in others if (x := o.lower()) != sym.lower()]:
        return "def_equals_other_symbol"
    if words and words[0] in DANGLING:
        return "starts_with_function_word"
    if words and words[-1] in DANGLING:
        return "dangling_function_word"
    if all(w in DEFINITION_STOP for w in words):
        return "stop_words_only"
    if sum(w not in DEFINITION_STOP and len(w) > 1 for w in words) < 2:
        return "too_few_content_words"
    if "SYM" in d:
        return "contains_SYM_placeholder"
    if re.search(r"[\\{}]", d):
        return "contains_latex_fragment"
    return "artifact_chars" if re.search("[\u200b\u200c\u200d\ufeff]", d) else None


class Search:
    """BM25+ within a paper, over its neighbourhoods and sentences; only terms of the queries are looked up."""

    def __init__(self, chunks: list[Passage], queries: list[str]) -> None:
        self.pool = [c for c in chunks if c.kind == "equation_neighborhood"] + [c for c in chunks if c.kind == "sentence"]
        self.where = where = {t: [] for q in queries for t, _ in counted(q)}  # places of a term, one for each time it comes
        self.sizes, self.parts = [], {}
        texts = [c.text for c in self.pool]
        every = " \0 ".join(texts)
        if every.count("\0") >= len(texts):  # a text that holds the end itself
            texts = [x.replace("\0", " ") for x in texts]
            every = " \0 ".join(texts)
        i = n = 0
        for t in every.lower().encode("ascii", "replace").translate(RUNS).decode().split():
            if t in NO_RUN:
                continue
            if t in where:
                where[t].append(i)
            elif t == "\0":
                self.sizes.append(n)
                i, n = i + 1, 0
                continue
            n += 1
        self.sizes.append(n)
        self.avg = max(sum(self.sizes) / len(texts), 1.0) if texts else 1.0

    def part(self, term: str) -> list[tuple[int, float]]:
        if term not in self.parts:
            found, n, out = Counter(self.where[term]), len(self.pool), []
            idf = log((n - len(found) + 0.5) / (len(found) + 0.5) + 1)
            for i, tf in found.items():
                out.append((i, idf * (tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * self.sizes[i] / self.avg)) + R.DELTA)))
            self.parts[term] = out
        return self.parts[term]

    def best(self, query: str, k: int) -> list[tuple[Passage, float]]:
        total: dict[int, float] = {}
        for term, qtf in counted(query):
            for i, s in self.part(term):
                total[i] = total.get(i, 0.0) + qtf * s
        # neighbourhoods come first in the pool, so its order is that of ties
        top = []
        for i, s in total.items():
            if s > 0:
                y = s * 1e6
                whole = int(y + 0.5)  # the score as rounded gives it, in millionths
                if not -0.4999 < y - whole < 0.4999:
                    whole = int(Decimal(repr(rounded(s))).scaleb(6))
                top.append((-whole, i))
        top.sort()
        return [(self.pool[i], -whole / 1e6) for whole, i in top[:k]]


def meaning_query(number: str, tex: str) -> str:
    return " ".join(["equation", number, "eq", number, " ".join(t for t in LETTERS.findall(tex.lower()) if len(t) > 1 and t not in MEANING_STOP)])


def meanings(eqs: list, hits: list, places: dict) -> list[tuple]:
    """meaning.candidates, signals and choose."""
    taken, out, seen, W = set(), [], {}, M.WEIGHTS
    for e, found in sorted(zip(eqs, hits), key=lambda x: (x[0][1], x[0][0])):
        number, before, after = e[0], e[5], e[6]
        sec, para = places.get(number, (None, None))
        home, low = paragraph(para), number.lower()
        cands: dict = {}
        sources = [(rank, c, c.section, score, beside(home, paragraph(c.para)), said(c.text, seen)) for rank, (c, score) in enumerate(found, 1)]
        sources += [(M.DEPTH + 1 + i, None, sec, 0.0, False, said(text, seen)) for i, text in enumerate((after, before)) if text]
        for rank, c, section, score, adjacent, prose in sources:
            there = W["context_window"] * (c is None) + W["para_adj"] * adjacent + W["same_section"] * bool(sec and section == sec) + W["bm25_top1"] * (rank == 1)
            for pos, s, at, cited, cue, named in prose:
                if s not in cands:
                    n = len(s)
                    points = there + W["definitional"] * cue + W["gazetteer"] * named
                    if cited and n > 30 and low in cited and not s.startswith("("):
                        points += W["eq_num"]
                    if not 30 <= n <= 400:
                        points += W["badlen"]
                    cands[s] = (-points, -score, rank, pos, s, at, c, cited, cue, named, adjacent, section)
        free = [x for x in cands.values() if -x[0] / M.MOST >= M.LEAST and x[4] not in taken]
        if free:
            points, score, rank, _, s, at, c, cited, cue, named, adjacent, section = min(free)
            taken.add(s)
            start = at + (0 if c is None else c.start)
            fired = {
                "eq_num": low in cited and len(s) > 30 and not s.startswith("("), "definitional": cue, "gazetteer": named, "context_window": c is None,
                "para_adj": adjacent, "same_section": sec and section == sec, "bm25_top1": rank == 1, "badlen": not 30 <= len(s) <= 400,
            }
            out.append((number, s, -points, 0.0 - score, "context_window" if c is None else c.id, start, start + len(s), [name for name, there in fired.items() if there]))
        else:
            out.append((number, "", None, None, None, None, None, None))
    return out


@kept
def _citing(number: str) -> Pattern:
    safe = re.sub("[^A-Za-z0-9]", lambda m: "\\" + m[0], number)
    return Pattern(f"(?:(?<=[.!?])|^)([^.!?]*?{L.CITED_BEFORE}{safe}{L.CITED_AFTER}[^.!?]*[.!?]?)", flags=re.I | re.S)


def has_cue(s: str) -> bool:
    low = s.lower()
    return any(map(low.__contains__, L.DERIVATION_CUES))


def _vectors(texts: list[str]) -> list[dict]:
    tf = [Counter(t for t in LETTERS.findall(x.lower()) if len(t) > 1 and t not in PAIR_STOP) for x in texts]
    df = Counter(t for c in tf for t in c)
    out = []
    for c in tf:
        w = {t: n * (log((len(texts) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
        size = sqrt(sum(x * x for x in w.values()))
        out.append({t: x / size for t, x in w.items()})
    return out


MARKS = [(Pattern(L.CONTEXT_ARTIFACTS), "", CONTEXT_ARTIFACT), (Pattern(L.RAW_LATEX), "", LATEX)]


def evidence(s: str) -> str:
    """relations.clean"""
    s = cleaned(s, MARKS).replace("{", "").replace("}", "")
    return strip(re.sub(" {2,}", " ", s) if "  " in s else s)[: E.WIDTH]


@kept
def hundredths(x: float) -> str:
    return str(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def graded(a: str, b: str, graph: str | None, cite: str | None, cue: str | None, shared: list[str], j: float, cosine: float | None) -> tuple:
    """A pair with its grade and what it rests on."""
    strong, c = graph or cite or cue, rounded(cosine) if cosine else 0.0
    if strong:
        named = [x for x, there in (("crossref+graph", graph), ("crossref", cite and not graph), ("deriv_cue", cue)) if there]
        return a, b, "strong", evidence(strong), 0.0, 0.0, named
    by_symbols, by_text = j >= E.JACCARD, c >= E.COSINE
    named = [f"jaccard={hundredths(j)}"] * by_symbols + [f"tfidf={hundredths(c)}"] * by_text
    said = f"shares symbols: {', '.join(shared)}" if by_symbols else f"semantically similar (cosine={hundredths(c)})" if by_text else ""
    return a, b, "potential" if named else "none", said, j, c, named


def relations(eqs: list, places: dict, hits: list, refs: list, said: dict, own: dict) -> list[tuple]:
    """relations.graded"""
    side, texts = [], []
    for e, found in zip(eqs, hits):
        local = strip(f"{e[5]} {e[6]}")
        wide = strip(" ".join([local, " ".join(c.text for c, _ in found)])) if found else local
        sec, para = places.get(e[0], (None, None))
        bracketed = lambda s: {x.lower() for x in BRACKETED.findall(s)} if "(" in s else ()
        near = bracketed(local)
        form = lambda s: (lambda p: p.common) if COMMON.fullmatch(s) else Pattern.any
        far = (near if wide == local else bracketed(wide)) if has_cue(wide) else ()
        side.append((e[0], local, wide, near, far, sec or "", para or "", sorted(own.get(e[0], ())), form(local) if near else None, form(wide) if far else None))
        texts.append(strip(said.get(e[0], "")) or local[:500] or " ")
    vectors, to = _vectors(texts), {}
    for r in sorted(refs):
        to.setdefault(r[3], []).append((*r, paragraph(r[1])))
    alike: dict = {}
    for i, x in enumerate(vectors):
        for j in range(i):
            y = vectors[j]
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            common = [w * large[t] for t, w in small.items() if t in large]
            alike[i, j] = alike[j, i] = sum(common) if common else None
    out = []
    for i, (a, local, wide, near, far, sec, para, mine, of_local, of_wide) in enumerate(side):
        home = paragraph(para)
        for j, other in enumerate(side):
            if i == j:
                continue
            b, graph, cite, cue = other[0], None, None, None
            for r in to.get(b, ()):
                if r[1] == para or beside(home, r[5]) if para else sec == "" or ((m := SECTION_OF.search(r[1])) is not None and m[1] == sec):
                    graph = r[2] or None
                    break
            if b.lower() in near and (m := of_local(_citing(b)).search(local)):
                s = strip(m[1])
                cite = s if len(s) > 20 and not s.startswith("(") else None
            if b.lower() in far:
                cue = next((s for x in of_wide(_citing(b)).findall(wide) if has_cue(s := strip(x))), None)
            shared = [s for s in mine if s in other[7]] if mine and other[7] else []
            union = len(mine) + len(other[7]) - len(shared)
            out.append(graded(a, b, graph, cite, cue, shared, len(shared) / union if union else 0.0, alike[i, j]))
    return out


@kept
def _int_first(number: str) -> tuple:
    """documents.order_of"""
    n = as_int(number)
    return n is None, n or 0, number


def tenths(x: float) -> str:
    return str(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def document(found: dict[str, list[tuple]]) -> dict:
    """knowledge.to_document of what study found with every part: numbers to entries, whose audit is that of knowledge.audit."""
    out, symbols, related = {}, {}, {}
    for number, _, *x in found.get("symbols", ()):
        symbols.setdefault(number, []).append(x)
    for r in found.get("relations", ()):
        related.setdefault(r[0], []).append(r)
    meant = {m[0]: m for m in found.get("meanings", ())}
    for e, q in zip(found["equations"], found["asked"]):
        n, tex, m = e[0], e[2], meant[e[0]]
        trail = {"latex_method": f"eq=({n}): method={e[4]} latex='{tex[:60]}'"}
        if m[1]:
            signals = ", ".join([f"'{x}'" for x in m[7]])
            trail["meaning"] = f"eq=({n}): strategy=weighted bm25={tenths(m[3])} score={m[2]}/15 chunk={m[4]} char_span=[{m[5]},{m[6]}] signals=[{signals}] sentence='{m[1][:80]}'"
        else:
            trail["meaning"] = f"eq=({n}): no sentence reaches the threshold"
        defined, i, j, rels = {}, 0, 0, {}
        pairs = related.get(n, ())
        for k, (_, b, grade, _, alike, sim, by) in enumerate(sorted(pairs, key=lambda r: _int_first(r[1]))):
            trail[f"relations_{k}" if k else "relations"] = f"eq=({n})~({b}): grade={grade} signals={','.join(by)} jaccard={hundredths(alike)} sim={hundredths(sim)}"
        for b, grade, said in sorted([r[1:4] for r in pairs]):
            rels[b] = {"grade": grade, "description": said}
        trail["retrieval"] = f"eq=({n}): BM25 query='{q[1][:60]}' hits={q[2]}"
        for sym, means, pattern, confidence, reason, chunk in symbols.get(n, ()):
            told = f"sym={sym} def={means[:60]} confidence={confidence} pattern={pattern} chunk={chunk} reason={reason or '-'}"
            if reason is None:
                defined[sym] = means
                trail[f"symbol_{i}" if i else "symbol"] = told
                i += 1
            else:
                trail[f"symbol_reject_{j}" if j else "symbol_reject"] = told
                j += 1
        out[n] = {"equation": tex, "meaning": m[1], "symbols": dict(sorted(defined.items())), "relations": rels, "audit-trail": dict(sorted(trail.items()))}
    return out


def study(paper_id: int, html: str | None, want: frozenset, cap: int, attributes: dict | None = None) -> dict[str, list[tuple]]:
    """Rows of the wanted parts of one page; `attributes` is as in html.rows."""
    eqs, paras, spots, links = [], [], [], []
    numbers: set = set()
    for _, kind, at, elem, _, para, sec, text, tex, how, number, before, after, href, mi, title in H.rows(paper_id, html, D.PARTS, cap, attributes):
        if kind == "equation":
            if number not in numbers:
                numbers.add(number)
                eqs.append((number, len(eqs) + 1, tex, "html", how, before or "", after or "", mi))
        elif kind == "para":
            paras.append((at, text, sec, title, para))
        elif kind == "spot":
            spots.append((at, number, how, before, after, sec, title, para, elem))
        else:
            links.append((at, para, href, text, before))
    out: dict[str, list[tuple]] = {"equations": eqs}
    if want == {"equations"} or not (paras or spots or eqs):
        return out
    deep = "relations" in want
    if not eqs and not want & {"chunks", "xrefs"}:
        return out
    chunks = passages(paper_id, paras, [x[:8] for x in spots], eqs)
    if "chunks" in want:
        out["chunks"] = [(c.ord, c.id, c.kind, c.text, c.section, c.title, c.para, c.nums, c.start) for c in chunks]
    places: dict = {}
    for c in chunks:
        if c.kind == "equation_neighborhood":
            for n in c.nums:
                places.setdefault(n, (c.section, c.para))
    out["places"] = [(n, *x) for n, x in places.items()]
    if deep or "xrefs" in want:
        out["xrefs"] = cross_references(links, spots, chunks)
    if not eqs or not want & {"asked", "meanings", "symbols", "relations"}:
        return out
    tell, define, chosen, good = deep or bool(want & {"asked", "meanings"}), deep or "symbols" in want, {}, {}
    about = [meaning_query(e[0], e[2]) for e in eqs] if tell else []
    every = [symbols_of(e[7], e[2]) for e in eqs] if define else []
    ask = {sym: " ".join(forms(sym)[:3]) for own in every for sym in own}
    near = [f"equation {e[0]} eq {e[0]} ({e[0]})" for e in eqs] if deep else []
    search = Search(chunks, [*about, *ask.values(), *near])
    if tell:
        hits = [search.best(q, M.DEPTH) for q in about]
        out["asked"] = [(e[0], q, len(h)) for e, q, h in zip(eqs, about, hits)]
        out["meanings"] = meanings(eqs, hits, places)
        chosen = {m[0]: m[1] for m in out["meanings"]}
    if define:
        out["symbols"], met = [], {sym: search.best(q, S.DEPTH) for sym, q in ask.items()}
        for e, syms in zip(eqs, every):
            own = strip(f"{e[5]} {e[6]}")
            bare = Context(own)
            for i, sym in enumerate(syms):
                context = Context(strip(" ".join([" ".join([c.text for c, _ in met[sym]]), own]))) if met[sym] else bare
                if got := find(sym, context):
                    reason = "low_confidence" if got[2] == "low" else reject_reason(got[0], sym, [x for x in syms if x != sym])
                    out["symbols"].append((e[0], i, sym, *got, reason, met[sym][0][0].id if met[sym] else "context_window"))
                    if reason is None:
                        good.setdefault(e[0], set()).add(sym)
    if deep:
        out["relations"] = relations(eqs, places, [search.best(q, E.DEPTH) for q in near], out["xrefs"], chosen, good)
    return out


def studied(pages: DataFrame, id_col: str, html_col: str, want: set[str], cap: int = D.CAP) -> DataFrame:
    """(id, <part>...): a row a page with an array of rows for each wanted part (names of PARTS); ids must not repeat."""
    want = frozenset(want)
    names = [p for p in PARTS if p in want]
    for unicode in (True, False):
        java(r"\w\b", unicode, False)  # what is known of all characters is found out once, here
    schema = "id long, " + ", ".join(f"{p} array<struct<{', '.join(c.replace(' ', ':', 1) for c in PARTS[p].split(', '))}>>" for p in names)

    def run(batches):
        import pyarrow as pa

        text = pa.string()
        types = {"string": text, "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(text)}
        fields = {p: [c.split(" ", 1) for c in PARTS[p].split(", ")] for p in names}
        attributes: dict = {}
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100).to_pydict()
                found = [study(i, h, want, cap, attributes) for i, h in zip(part["id"], part["html"])]
                arrays = [pa.array(part["id"], pa.int64())]
                for p in names:
                    rows, ends = [], [0]
                    for x in found:
                        rows += x.get(p, ())
                        ends.append(len(rows))
                    cols = list(zip(*rows)) if rows else [()] * len(fields[p])
                    flat = pa.StructArray.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(cols, fields[p])], [n for n, _ in fields[p]])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(arrays, ["id", *names])

    src = spread(pages, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).where("id is not null")
    return src.mapInArrow(run, schema)


def documents(pages: DataFrame, id_col: str, html_col: str, cap: int = D.CAP) -> DataFrame:
    """(id, json) of knowledge.to_document for every page with formulas: a worker that has analysed a page writes its entries; ids must not repeat."""
    want = frozenset({"equations", "asked", "meanings", "symbols", "relations"})
    for unicode in (True, False):
        java(r"\w\b", unicode, False)

    def run(batches):
        import pyarrow as pa

        as_text = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode
        attributes: dict = {}
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100).to_pydict()
                found = [(i, study(i, h, want, cap, attributes)) for i, h in zip(part["id"], part["html"])]
                rows = [(i, as_text(document(x))) for i, x in found if x["equations"]]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["id", "json"])

    src = spread(pages, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).where("id is not null")
    return src.mapInArrow(run, "id long, json string")


def part(rows: DataFrame, name: str) -> DataFrame:
    """One part of what studied gives, as a table (id, ...)."""
    return rows.select("id", F.explode(name).alias("x")).select("id", "x.*")
