"""Column expressions over text; each is one built-in expression tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eqloom import lexicon as L

BOUNDARY = "(?U)" + L.SENTENCE_END


# the white space of Unicode
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends (all Unicode white space, not blanks alone)."""
    return F.btrim(c, F.lit(BLANKS))


# texts of letters, digits and plain signs with single blanks, which no cleaner changes; most prose is such
_PLAIN = r"^(?! )(?!.*(?:  |script|SCRIPT{more}))[{signs}\x{{C0}}-\x{{24F}} ]*(?<! )$"
PLAIN = _PLAIN.format(more="", signs=r"!-\[\]`-~")
PLAIN_CONTEXT = _PLAIN.format(more="|Script|italic|caligraphic|bold", signs=r"!-\[\]`-z|~")


def clean_text(c: Column) -> Column:
    """Prose without typesetting artifacts, white space collapsed."""
    full = c
    for pattern, by in ((r"\x{A0}", " "), (L.ARTIFACTS, " "), (L.MATH_LETTERS, " "), (L.ZERO_WIDTH, ""), (L.SCRIPTS, ""), (L.RAW_LATEX, ""), (r"\s+", " ")):
        full = F.regexp_replace(full, "(?U)" + pattern, by)
    return F.when(c.rlike(PLAIN), c).otherwise(strip(full))


def clean_context(c: Column) -> Column:
    """The gentler cleaner of context windows: artifacts go, only double blanks collapse."""
    full = F.regexp_replace(c, r"\x{A0}", " ")
    for pattern in (L.CONTEXT_ARTIFACTS, L.MATH_LETTERS, L.SCRIPTS, L.RAW_LATEX, L.SCRIPT_WORDS, r"[{}]"):
        full = F.regexp_replace(full, "(?U)" + pattern, "")
    return F.when(c.rlike(PLAIN_CONTEXT) & ~F.contains(F.lower(c), F.lit("script")), c).otherwise(strip(F.regexp_replace(full, r" {2,}", " ")))


def sentences(c: Column) -> Column:
    """Array of sentences: cut after . ! ? before a capital or a bracket."""
    return F.split(c, BOUNDARY, -1)


def pieces(c: Column) -> Column:
    """The sentences with the blanks that follow them, so that their lengths add up to the text's."""
    return F.split(F.regexp_replace(c, r"(?U)(?<=[.!?])(\s+)(?=[A-Z(])", "$1\u001f"), "\u001f", -1)


def _token_pattern(stop: list[str]) -> str:
    """Runs of letters and digits that are neither a stop word nor one letter, as one pattern."""
    tails: dict[str, list[str]] = {}
    for w in stop:
        tails.setdefault(w[0], []).append(w[1:])
    words = "|".join(f"{h}(?:{'|'.join(t)})" for h, t in tails.items())
    return rf"(?<![a-z0-9])(?!(?:{words})(?![a-z0-9]))(?:[a-z0-9]{{2,}}|[0-9])"


TOKEN = _token_pattern([*L.RETRIEVAL_STOP, *L.RETRIEVAL_ARTIFACTS])


def tokens(c: Column) -> Column:
    """Index terms: lower-cased runs of letters and digits without stop words; letters need two characters.

    Null for a null text, an empty array for one without terms.
    """
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def is_prose(c: Column) -> Column:
    """At least three words, 40 % of them with two ASCII letters."""
    words = F.regexp_count(c, F.lit(r"\S+"))
    good = F.regexp_count(c, F.lit(r"[a-zA-Z][^\sa-zA-Z]*[a-zA-Z]\S*"))  # from a word's first letter to its end
    return (words >= 3) & (good / F.nullif(words, F.lit(0)) >= 0.4)


def has_gazetteer_name(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for name in L.GAZETTEER:
        out = out | F.contains(low, F.lit(name.lower()))
    return out


def has_cue(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for cue in L.DERIVATION_CUES:
        out = out | F.contains(low, F.lit(cue))
    return out


def cited_numbers(c: Column) -> Column:
    """Equation numbers a text cites, in order."""
    return F.regexp_extract_all(c, F.lit(L.CITATION), 1)


def eq_number(c: Column) -> Column:
    """The number in a tag such as (3) or (A.2), else null."""
    return F.nullif(F.regexp_extract(c, L.EQ_NUMBER, 1), F.lit(""))


def latex_symbols(c: Column) -> Column:
    """Distinct symbols of a formula in order: Greek names and letters that are no indices."""
    greek = F.array(*[F.lit(g) for g in L.GREEK])
    skip = F.array(*[F.lit(s) for s in L.SKIP_LETTERS])
    found = F.regexp_extract_all(c, F.lit(r"(\\[a-zA-Z]+|[A-Za-z])"), 1)
    names = F.transform(found, lambda t: F.regexp_replace(t, r"^\\", ""))
    return F.array_distinct(F.filter(F.arrays_zip(found.alias("t"), names.alias("n")), lambda x: F.when(x["t"].startswith("\\"), F.array_contains(greek, x["n"])).otherwise(~F.array_contains(skip, x["n"])))["n"])


def _is_other(d: Column, symbol: Column, others: Column) -> Column:
    low = F.array_remove(F.transform(others, F.lower), F.lower(symbol))
    return F.array_contains(others, d) | F.array_contains(low, F.lower(d))


def without_math(c: Column) -> Column:
    """Inline formulas replaced by one word."""
    return F.regexp_replace(c, L.INLINE_MATH, "MATHSYM")


def any_cited(c: Column) -> Column:
    """Numbers in brackets that a text may cite, with or without a word for it, in order (the earlier rule)."""
    return F.transform(F.regexp_extract_all(c, F.lit(L.ANY_CITATION), 0), lambda x: F.regexp_extract(x, r"\(\s*([\dA-Za-z]+(?:[.\-][\dA-Za-z]+)*)\s*\)$", 1))


def reject_reason(definition: Column, symbol: Column, others: Column | None = None) -> Column:
    """Why a definition is no definition of the symbol (first rule that holds), else null.

    `others` are the symbols of the formula; the symbol itself among them counts only as it is written.
    """
    d = strip(definition)
    words = F.filter(F.split(F.lower(d), r"\s+"), lambda w: w != "")
    dangling = F.array(*[F.lit(w) for w in L.DANGLING])
    stop = F.array(*[F.lit(w) for w in L.DEFINITION_STOP])
    content = F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))
    return (
        F.when(F.length(d) <= 1, "single_char_def")
        .when(F.lower(d) == F.lower(symbol), "def_equals_symbol")
        .when(_is_other(d, symbol, others) if others is not None else F.lit(False), "def_equals_other_symbol")
        .when(F.array_contains(dangling, F.try_element_at(words, F.lit(1))), "starts_with_function_word")
        .when(F.array_contains(dangling, F.try_element_at(words, F.lit(-1))), "dangling_function_word")
        .when(F.forall(words, lambda w: F.array_contains(stop, w)), "stop_words_only")
        .when(F.size(content) < 2, "too_few_content_words")
        .when(F.contains(d, F.lit("SYM")), "contains_SYM_placeholder")
        .when(d.rlike(r"[\\{}]"), "contains_latex_fragment")
        .when(d.rlike(r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]"), "artifact_chars")
    )
