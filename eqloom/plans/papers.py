"""Queries over whole papers (written from documents, see sources.html.templated), each beside its SQL.

The SQL never parses a page: it derives what the template wrote from the same sentences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.operators import documents as D
from eqloom.operators import knowledge as K
from eqloom.operators import quality as Q
from eqloom.operators import relations as E
from eqloom.operators import symbols as S
from eqloom.plans.catalogue import SENT, TRIM, listed, table
from eqloom.sources import html as H
from eqloom.sources import papers as P
from eqloom.sources.durable import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SHARED: dict[tuple, dict[str, DataFrame]] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _once(spark: SparkSession, sf_dir: str, what: str, make) -> dict[str, DataFrame]:
    """Tables that the queries of a session share: each page is parsed and analysed once."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key].copy()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.templated(table(spark, sf_dir, "documents"))


def analysed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _once(spark, sf_dir, "analysis", lambda: K.analyse(pages(spark, sf_dir), "id", "html"))


def parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes (written once), equations, chunks and xrefs of the written papers, without the analysis."""

    def make():
        nodes = keep(H.nodes(pages(spark, sf_dir), "id", "html", D.PARTS, D.CAP), "nodes")
        eqs = D.equations(nodes)
        chunks = D.passages(nodes, eqs)
        return {"nodes": nodes, "equations": eqs, "chunks": chunks, "xrefs": D.cross_references(nodes, chunks)}

    return _once(spark, sf_dir, "parts", make)


# what the template writes: w has a row for each paragraph, f for each formula, eq for the first seven of a paper
CASES = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{a}' || c || '{b}'" for i, (a, b) in enumerate(H.DEFINED)) + " END"
CLEAN = TRIM.format(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(_, chr(160), ' ', 'g'), '{L.SCRIPTS}', '', 'g'), '{L.RAW_LATEX}', '', 'g'), '\s+', ' ', 'g')")
clean = lambda x: CLEAN.replace("_, chr", f"{x}, chr")
PAPER = SENT + r""",
w0 AS (SELECT doc_id, i, s, (i + 1) // 3 AS k, i // 6 + 1 AS sec, 'Part ' || ['One', 'Two', 'Six', 'Ten'][(i // 6) % 4 + 1] AS title, 'S' || (i // 6 + 1) || '.p' || (i % 6 + 1) AS para_id, """ + TRIM.format("regexp_replace(s, '[0-9()]', '', 'g')") + r""" AS plain FROM sent),
w AS (SELECT *, CASE WHEN regexp_matches(plain, '[.!?]$') THEN plain ELSE plain || '.' END AS words FROM w0),
f0 AS (SELECT *, ['H', 'Q', 'W'][k % 3 + 1] AS c, k % 2 = 0 AND k % 4 <> 0 AS even,
  'Equation (' || k || ') denotes the density operator of ' || array_to_string(regexp_extract_all(lower(s), '[a-z]+')[1:3], ' ') || '.' AS m,
  CASE k % 3 WHEN 0 THEN 'It is found by (' || (k - 1) || ') at once.' WHEN 2 THEN 'Substituting (' || (k - 1) || ') yields it.' ELSE '' END AS x FROM w WHERE i % 3 = 2),
f AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'U_{' || k || '} \\' || chr(10) || 'V_{' || k || '}' WHEN k % 4 = 3 THEN '{' || c || '}_{' || k || '} = \rho'
  ELSE c || '_{' || k || '}=m' || CASE WHEN even THEN '+J' ELSE '' END END AS latex,
  m || ' ' || """ + CASES + r""" || CASE WHEN even THEN ' Also where J is the coupling strength, as said.' ELSE '' END AS told FROM f0),
eq AS MATERIALIZED (SELECT * FROM f WHERE k <= 7),
pair AS (SELECT a.doc_id, a.k AS a, b.k AS b, a.x AS x FROM eq a JOIN eq b ON a.doc_id = b.doc_id AND a.k <> b.k)"""
METHOD = "CASE k % 4 WHEN 2 THEN 'alttext' WHEN 3 THEN 'mathml' ELSE 'annotation' END"
BEFORE = "CASE WHEN x <> '' THEN told || ' ' || x ELSE words || ' ' || told END"
ENDS = "It ends here. Then more follows."
FULL = "words || ' ' || told || CASE WHEN x <> '' THEN ' ' || x ELSE '' END"
PARAS = PAPER + rf""",
p AS (SELECT doc_id, i, para_id, sec, title, {clean(f"words || CASE WHEN i % 3 = 0 AND i > 0 THEN ' as in (' || (i // 3) || ')' ELSE '' END")} AS t, '' AS nums FROM w WHERE i % 3 <> 2
  UNION ALL SELECT doc_id, i, para_id, sec, title, {clean(FULL + " || ' " + ENDS + " Nobody looks so far.'")}, CASE WHEN k % 4 <> 0 THEN CAST(k AS VARCHAR) ELSE '' END FROM f)"""
# symbols with their definitions, as (formula, symbol, phrase, form, confidence)
SYMBOLS = "y(k, sym, definition, pattern, confidence) AS (VALUES (1, 'Q', 'mean number', 'where_is', 'high'), (2, 'W', 'phase velocity', 'let_be', 'high'), (2, 'J', 'coupling strength', 'where_is', 'high'), (3, 'H', 'total energy', 'sym_is', 'high'), (6, 'H', 'spin density', 'the_noun_sym', 'medium'), (6, 'J', 'coupling strength', 'where_is', 'high'), (7, 'Q', 'phase velocity', 'let_be', 'high'))"
GRADES = (
    PAPER
    + f""", {SYMBOLS},
own AS (SELECT k, list(sym ORDER BY sym) AS syms FROM y GROUP BY k),
t AS (SELECT doc_id, k, unnest(list_filter(regexp_extract_all(lower(m), '[a-z]+'), lambda z: length(z) > 1 AND NOT list_contains({listed(L.PAIR_STOP)}, z))) AS term FROM eq),
n AS (SELECT doc_id, count(*) AS n FROM eq GROUP BY 1), tf AS (SELECT doc_id, k, term, count(*) AS tf FROM t GROUP BY 1, 2, 3), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
v AS (SELECT doc_id, k, term, tf * (ln((n + 1) / (df + 1)) + 1) AS v FROM tf JOIN df USING (doc_id, term) JOIN n USING (doc_id)), l AS (SELECT doc_id, k, sqrt(sum(v * v)) AS l FROM v GROUP BY 1, 2),
cs AS (SELECT a.doc_id, a.k AS a, b.k AS b, round(sum(a.v / la.l * b.v / lb.l), 6) AS cosine FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.k <> b.k JOIN l la ON la.doc_id = a.doc_id AND la.k = a.k JOIN l lb ON lb.doc_id = b.doc_id AND lb.k = b.k GROUP BY 1, 2, 3),
g0 AS (SELECT pair.*, cosine, coalesce(oa.syms, []) AS sa, coalesce(ob.syms, []) AS sb, a % 4 = 0 OR (b = a - 1 AND a % 3 <> 1) AS strong
  FROM pair JOIN cs USING (doc_id, a, b) LEFT JOIN own oa ON oa.k = a LEFT JOIN own ob ON ob.k = b),
g1 AS (SELECT *, list_sort(list_intersect(sa, sb)) AS common, CASE WHEN len(sa) + len(sb) > 0 THEN len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))) ELSE 0 END AS j FROM g0),
g AS (SELECT *, CASE WHEN strong THEN 'strong' WHEN j >= 0.3 OR cosine >= 0.6 THEN 'potential' ELSE 'none' END AS grade FROM g1)"""
)
EQ_COLUMNS = f"doc_id, CAST(k AS VARCHAR) AS eq_num, latex AS equation, 'html' AS source, {METHOD} AS latex_method"


def equations_of(spark: SparkSession, sf_dir: str, shapes: list[int]) -> DataFrame:
    e = parts(spark, sf_dir)["equations"].where((F.col("eq_num").cast("int") % 4).isin(shapes))
    return e.select(F.col("id").alias("doc_id"), "eq_num", "equation", "source", "latex_method")


@query(f"WITH {PAPER} SELECT {EQ_COLUMNS} FROM eq WHERE k % 4 IN (1, 2)")
def equations_standalone(spark, sf_dir):
    """A number with its own formula, by annotation or alttext, the first seven of a paper."""
    return equations_of(spark, sf_dir, [1, 2])


@query(f"WITH {PAPER} SELECT {EQ_COLUMNS} FROM eq WHERE k % 4 = 3")
def equations_rows(spark, sf_dir):
    """A numbered row of a group without a formula takes that of the row before, folded from MathML."""
    return equations_of(spark, sf_dir, [3])


@query(f"WITH {PAPER} SELECT {EQ_COLUMNS} FROM eq WHERE k % 4 = 0")
def equations_groups(spark, sf_dir):
    """Two formulas under one number are joined."""
    return equations_of(spark, sf_dir, [0])


@query(f"WITH {PAPER} SELECT {EQ_COLUMNS} FROM eq")
def equations(spark, sf_dir):
    return equations_of(spark, sf_dir, [0, 1, 2, 3])


@query(f"WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, {BEFORE} AS context_before, '{ENDS}' AS context_after FROM eq")
def surrounding_context(spark, sf_dir):
    """The two elements before and after a formula in its paragraph."""
    return parts(spark, sf_dir)["equations"].select(F.col("id").alias("doc_id"), "eq_num", F.col("before").alias("context_before"), F.col("after").alias("context_after"))


@query(rf"""WITH {PAPER} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS table_index, CASE WHEN k % 4 IN (1, 2) THEN 'ltx_equation' ELSE 'ltx_equationgroup' END || ' ltx_eqn_table' AS classes, '(' || k || ')' AS eq_num,
true AS has_math, k % 4 IN (0, 1) AS has_annotation, CASE k % 4 WHEN 1 THEN '\displaystyle ' || latex WHEN 0 THEN 'U_{{' || k || '}}' END AS annotation_preview, CASE WHEN k % 4 = 2 THEN latex END AS alttext_preview, true AS whole FROM f""")
def fragments(spark, sf_dir):
    """Every equation table as a fragment, without a cap."""
    f = D.fragments(H.nodes(pages(spark, sf_dir), "id", "html", {"fragment"}))
    whole = F.col("html").startswith("<table ") & F.col("html").endswith("</table>") & F.contains("html", "eq_num")
    return f.select(F.col("id").alias("doc_id"), F.col("table_index").cast("long").alias("table_index"), F.array_join("classes", " ").alias("classes"), "eq_num", "has_math", "has_annotation", "annotation_preview", "alttext_preview", whole.alias("whole"))


@query(rf"""WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, CASE WHEN k % 4 = 1 THEN '\displaystyle ' || latex ELSE 'N/A' END AS annotation, CASE WHEN k % 4 = 2 THEN latex ELSE 'N/A' END AS alttext,
'{{' || c || '}}_{{' || k || '}} = \rho' || CASE WHEN even THEN ' + J' ELSE '' END AS mathml FROM f WHERE k % 4 IN (1, 2)""")
def latex_methods(spark, sf_dir):
    """The three ways to the LaTeX of a number whose own row has a formula."""
    return D.methods(H.nodes(pages(spark, sf_dir), "id", "html", {"methods"})).select(F.col("id").alias("doc_id"), "eq_num", "annotation", "alttext", "mathml")


@query(f"WITH {PARAS} SELECT doc_id, para_id, 'S' || sec AS section_id, title AS section_title, nums AS eq_nums, t AS text FROM p")
def paragraph_chunks(spark, sf_dir):
    c = parts(spark, sf_dir)["chunks"].where("chunk_type = 'paragraph'")
    return c.select(F.col("id").alias("doc_id"), "para_id", "section_id", "section_title", F.array_join("eq_nums", ",").alias("eq_nums"), "text")


CUT = r"string_split(regexp_replace(t, '([.!?])\s+([A-Z(])', '\1' || chr(30) || '\2', 'g'), chr(30))"


@query(rf"""WITH {PARAS}, q AS (SELECT *, {CUT} AS l FROM p), c0 AS (SELECT doc_id, i, para_id, sec, l, unnest(range(len(l))) AS pos FROM q),
c AS (SELECT *, l[pos + 1] AS s, CASE WHEN pos = 0 THEN 0 ELSE length(array_to_string(l[1:pos], ' ')) + 1 END AS char_offset FROM c0)
SELECT doc_id, para_id, {TRIM.format("s")} AS text, CAST(char_offset AS BIGINT) AS char_offset, doc_id || ':S' || sec || ':sentence:' || (row_number() OVER (PARTITION BY doc_id ORDER BY i, pos) - 1) AS chunk_id FROM c WHERE length({TRIM.format("s")}) >= 10""")
def sentence_chunks(spark, sf_dir):
    """Sentences of the papers, their places, and ids that count through the paper."""
    c = parts(spark, sf_dir)["chunks"].where("chunk_type = 'sentence'")
    return c.select(F.col("id").alias("doc_id"), "para_id", "text", F.col("char_offset").cast("long").alias("char_offset"), "chunk_id")


@query(f"WITH {PAPER} SELECT doc_id, para_id, CAST(k AS VARCHAR) AS eq_nums, title || ' ' || {clean(FULL)} || ' ' || latex || ' {ENDS} Nobody looks so far.' AS text FROM eq WHERE k % 4 <> 0")
def neighborhood_chunks(spark, sf_dir):
    c = parts(spark, sf_dir)["chunks"].where("chunk_type = 'equation_neighborhood'")
    return c.select(F.col("id").alias("doc_id"), "para_id", F.array_join("eq_nums", ",").alias("eq_nums"), "text")


@query(f"WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, para_id, 'S' || sec AS section_id FROM eq WHERE k % 4 <> 0")
def formula_places(spark, sf_dir):
    """The paragraph and section of a formula, by the first neighbourhood that names it."""
    return D.places(parts(spark, sf_dir)["chunks"]).select(F.col("id").alias("doc_id"), "eq_num", "para_id", "section_id")


@query(f"""WITH {PAPER} SELECT doc_id, para_id AS from_para_id, CAST(i // 3 AS VARCHAR) AS to_eq_num, substr({clean("words || ' as in (' || (i // 3) || ')'")}, 1, 300) AS sentence,
CASE WHEN (i // 3) % 4 = 0 THEN 'structural_text' ELSE 'structural' END AS source FROM w WHERE i % 3 = 0 AND i > 0""")
def xrefs_structural(spark, sf_dir):
    """Links, resolved by the id of their target or else by the number they show."""
    x = parts(spark, sf_dir)["xrefs"].where("source <> 'lexical'")
    return x.select(F.col("id").alias("doc_id"), "from_para_id", "to_eq_num", "sentence", "source")


@query(f"WITH {PAPER} SELECT doc_id, para_id AS from_para_id, CAST(k AS VARCHAR) AS to_eq_num, substr({clean('m')}, 1, 300) AS sentence FROM f UNION ALL SELECT doc_id, para_id, CAST(k - 1 AS VARCHAR), x FROM f WHERE x <> ''")
def xrefs_uncovered(spark, sf_dir):
    """Lexical cross references: cited numbers that no link of the paragraph covers."""
    x = parts(spark, sf_dir)["xrefs"].where("source = 'lexical'")
    return x.select(F.col("id").alias("doc_id"), "from_para_id", "to_eq_num", "sentence")


@query(f"WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS a, CAST(k - 1 AS VARCHAR) AS b FROM eq WHERE x <> ''")
def cites(spark, sf_dir):
    return E.cites(parts(spark, sf_dir)["equations"]).select(F.col("id").alias("doc_id"), "a", "b")


@query(f"WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, CASE WHEN k % 4 = 0 THEN 'U V' ELSE c || '_' || k || ' ' || c || ' rho' || CASE WHEN even THEN ' J' ELSE '' END END AS symbols FROM eq")
def formula_symbols(spark, sf_dir):
    """Identifiers of the MathML with their subscripts, or symbols of the LaTeX under a shared number."""
    s = S.of_formulas(parts(spark, sf_dir)["equations"]).groupBy("id", "eq_num").agg(F.array_sort(F.collect_list(F.struct("ord", "sym"))).alias("s"))
    return s.select(F.col("id").alias("doc_id"), "eq_num", F.array_join(F.col("s")["sym"], " ").alias("symbols"))


@query(f"WITH {PAPER}, {SYMBOLS} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, sym, definition, pattern, confidence, 'context_window' AS chunk_id FROM eq JOIN y USING (k)")
def paper_symbols(spark, sf_dir):
    """Definitions that pass the gate, in four of the five forms."""
    s = analysed(spark, sf_dir)["symbols"].where("reject_reason IS NULL")
    return s.select(F.col("id").alias("doc_id"), "eq_num", "sym", "definition", "pattern", "confidence", "chunk_id")


@query(f"WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, 'W' AS sym, 'outer field' AS definition, 'sym_the' AS pattern, 'low_confidence' AS reject_reason FROM eq WHERE k = 5")
def low_confidence_symbols(spark, sf_dir):
    """Definitions of the weakest form are found, but rejected."""
    s = analysed(spark, sf_dir)["symbols"].where("reject_reason IS NOT NULL")
    return s.select(F.col("id").alias("doc_id"), "eq_num", "sym", "definition", "pattern", "reject_reason")


EARLIER = f"{SYMBOLS}, y2 AS (SELECT k, sym, definition, pattern FROM y UNION ALL SELECT 5, 'W', 'outer field', 'sym_the')"


@query(f"WITH {PAPER}, {EARLIER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, sym, definition, pattern FROM eq JOIN y2 USING (k)")
def symbols_earlier(spark, sf_dir):
    """The earlier rule: symbols of the LaTeX, no gate."""
    return S.earlier(parts(spark, sf_dir)["equations"]).select(F.col("id").alias("doc_id"), "eq_num", "sym", "definition", "pattern")


@query(f"WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, 'W' AS sym FROM eq WHERE k = 5")
def symbols_only_earlier(spark, sf_dir):
    """Symbols that only the earlier rule defines."""
    t = analysed(spark, sf_dir)
    return S.new_keys(t["symbols"].where("reject_reason IS NULL"), S.earlier(t["equations"])).select(F.col("id").alias("doc_id"), "eq_num", "sym")


@query(f"WITH {PAPER}, {SYMBOLS}, z AS (SELECT doc_id, k, sym FROM eq JOIN y USING (k)) SELECT a.doc_id, CAST(a.k AS VARCHAR) AS a, CAST(b.k AS VARCHAR) AS b, string_agg(a.sym, ',' ORDER BY a.sym) AS shared FROM z a JOIN z b ON a.doc_id = b.doc_id AND a.sym = b.sym AND a.k <> b.k GROUP BY a.doc_id, a.k, b.k")
def shares_symbols(spark, sf_dir):
    good = analysed(spark, sf_dir)["symbols"].where("reject_reason IS NULL")
    return E.shared_symbols(good).select(F.col("id").alias("doc_id"), "a", "b", F.array_join("shared", ",").alias("shared"))


@query(f"WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, {clean('m')} AS meaning, true AS cited, true AS cue, true AS named, k % 4 <> 0 AS placed, CAST(length({clean('m')}) AS BIGINT) AS span, true AS found FROM eq")
def meaning_greedy(spark, sf_dir):
    """The chosen sentences, the signals that do not hang on ranks, and whether the audited span holds the sentence."""
    t = analysed(spark, sf_dir)
    m = t["meanings"].join(t["chunks"].select("id", "chunk_id", F.col("text").alias("passage"), F.col("char_offset").alias("at")), ["id", "chunk_id"], "left")
    there = F.expr("chunk_id = 'context_window' OR substring(passage, char_start - at + 1, char_end - char_start) = meaning")
    has = lambda x: F.array_contains("signals", x)
    return m.select(F.col("id").alias("doc_id"), "eq_num", "meaning", has("eq_num").alias("cited"), has("definitional").alias("cue"), has("gazetteer").alias("named"), has("same_section").alias("placed"), (F.col("char_end") - F.col("char_start")).cast("long").alias("span"), there.alias("found"))


SIGNALS = """CASE WHEN strong THEN 'crossref+graph' || CASE WHEN b = a - 1 AND a % 3 = 2 AND a % 4 <> 0 THEN ',deriv_cue' ELSE '' END
ELSE array_to_string(list_filter([CASE WHEN j >= 0.3 THEN 'jaccard=' || printf('%.2f', j) END, CASE WHEN cosine >= 0.6 THEN 'tfidf=' || printf('%.2f', cosine) END], lambda z: z IS NOT NULL), ',') END"""


@query(f"WITH {GRADES} SELECT doc_id, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, grade, {SIGNALS} AS signals, CASE WHEN strong THEN 0 ELSE round(j, 6) END AS jaccard, CASE WHEN strong THEN 0 ELSE cosine END AS cosine FROM g")
def relation_grades(spark, sf_dir):
    r = analysed(spark, sf_dir)["relations"]
    return r.select(F.col("id").alias("doc_id"), "a", "b", "grade", F.array_join("signals", ",").alias("signals"), F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {GRADES} SELECT doc_id, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CASE WHEN strong THEN x WHEN j >= 0.3 THEN 'shares symbols: ' || array_to_string(common, ', ')
WHEN cosine >= 0.6 THEN 'semantically similar (cosine=' || printf('%.2f', cosine) || ')' ELSE '' END AS description FROM g WHERE a % 4 <> 0""")
def relation_descriptions(spark, sf_dir):
    """What each grade says, for formulas whose place is known."""
    r = analysed(spark, sf_dir)["relations"].where(F.col("a").cast("int") % 4 != 0)
    return r.select(F.col("id").alias("doc_id"), "a", "b", "description")


@query(f"WITH {GRADES} SELECT grade, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY grade")
def grade_dist(spark, sf_dir):
    return Q.grades(analysed(spark, sf_dir)["relations"])


@query(f"""WITH {GRADES}, d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL), e AS (SELECT d.doc_id, count(eq.k) AS n FROM d LEFT JOIN eq USING (doc_id) GROUP BY 1),
r AS (SELECT eq.doc_id, eq.k, count(*) FILTER (g.grade <> 'none') AS related FROM eq LEFT JOIN g ON g.doc_id = eq.doc_id AND g.a = eq.k GROUP BY 1, 2), tt AS (SELECT count(*) AS t FROM eq),
xx AS (SELECT 'papers_empty' AS metric, count_if(n = 0) AS n, count(*) AS total FROM e UNION ALL SELECT 'equations', t, t FROM tt UNION ALL SELECT 'meaning_empty', 0, t FROM tt
UNION ALL SELECT 'symbols_empty', count_if(k IN (4, 5)), count(*) FROM eq UNION ALL SELECT 'relations_all_none', count_if(related = 0), count(*) FROM r UNION ALL SELECT 'meaning_noise', 0, t FROM tt
UNION ALL SELECT 'pairs_related', count_if(grade <> 'none'), count(*) FROM g UNION ALL SELECT 'symbols_garbage', 0, count(*) FROM eq JOIN y USING (k))
SELECT metric, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, round(n / nullif(total, 0), 6) AS share FROM xx""")
def coverage_rates(spark, sf_dir):
    return Q.coverage(analysed(spark, sf_dir))


@query(f"WITH {PAPER}, d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL), e AS (SELECT d.doc_id, count(eq.k) AS n FROM d LEFT JOIN eq USING (doc_id) GROUP BY 1) SELECT n, count(*) AS papers, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY n")
def eq_histogram(spark, sf_dir):
    """Papers by their number of formulas; those without any count as well."""
    return Q.histogram(pages(spark, sf_dir), parts(spark, sf_dir)["equations"])


@query(f"""WITH {PAPER}, d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL), e AS (SELECT d.doc_id, count(eq.k) AS n, coalesce(string_agg(CAST(k AS VARCHAR), ', ' ORDER BY k), '') AS eq_nums, coalesce(string_agg(DISTINCT {METHOD}, ', ' ORDER BY {METHOD}), '') AS m FROM d LEFT JOIN eq USING (doc_id) GROUP BY 1)
SELECT doc_id, n, CASE WHEN n = 0 THEN 'EMPTY' WHEN n < 7 THEN 'UNDER' ELSE 'FULL' END AS status, eq_nums, CASE WHEN n > 0 THEN m ELSE '' END AS methods, CASE WHEN n > 0 THEN 'html' ELSE '' END AS sources FROM e""")
def status_per_paper(spark, sf_dir):
    return Q.per_paper(pages(spark, sf_dir), parts(spark, sf_dir)["equations"]).withColumnRenamed("id", "doc_id")


@query(f"WITH {PAPER} SELECT {METHOD} AS latex_method, count(*) AS html, CAST(0 AS BIGINT) AS pdf, CAST(0 AS BIGINT) AS none FROM eq GROUP BY 1")
def source_by_method(spark, sf_dir):
    return Q.breakdown(parts(spark, sf_dir)["equations"])


@query(f"WITH {PAPER} SELECT 'weighted' AS strategy, count(*) AS n, CAST(1 AS DOUBLE) AS share FROM eq HAVING count(*) > 0")
def strategy_dist(spark, sf_dir):
    return Q.strategies(K.audit(analysed(spark, sf_dir), ("meanings",)))


@query(rf"""WITH {PAPER} SELECT doc_id, CAST(k AS VARCHAR) AS eq_num, 'latex_method' AS key, 'eq=(' || k || '): method=' || {METHOD} || ' latex=''' || substr(latex, 1, 60) || '''' AS detail FROM eq
UNION ALL SELECT doc_id, CAST(k AS VARCHAR), 'symbol_reject', 'sym=W def=outer field confidence=low pattern=sym_the chunk=context_window reason=low_confidence' FROM eq WHERE k = 5
UNION ALL SELECT a.doc_id, CAST(a.k AS VARCHAR), CASE WHEN row_number() OVER (PARTITION BY a.doc_id, a.k ORDER BY b.k) = 1 THEN 'relations' ELSE 'relations_' || (row_number() OVER (PARTITION BY a.doc_id, a.k ORDER BY b.k) - 1) END, 'with (' || b.k || ')' FROM eq a JOIN eq b ON a.doc_id = b.doc_id AND a.k <> b.k""")
def audit_trail(spark, sf_dir):
    """How each LaTeX came about, rejected symbols, and the numbered keys of the pairs."""
    t = analysed(spark, sf_dir)
    t["relations"]  # first, since one search then answers for all
    a = K.audit(t, ("equations", "symbols", "relations")).where("method IN ('latex_method', 'symbol_reject', 'relations')")
    pair = F.concat(F.lit("with ("), F.regexp_extract("detail", r"~\((\w+)\)", 1), F.lit(")"))
    return a.select(F.col("id").alias("doc_id"), "eq_num", "key", F.when(F.col("method") == "relations", pair).otherwise(F.col("detail")).alias("detail"))


def exported(t: dict[str, DataFrame], doc: DataFrame | None = None) -> DataFrame:
    doc = K.to_document(K.entries(t)) if doc is None else doc
    return doc.select(F.concat(F.lit('{"'), F.col("id").cast("string"), F.lit('":'), "json", F.lit("}")).alias("value"))


@query(f"WITH {PAPER} SELECT CAST(doc_id AS VARCHAR) AS paper, CAST(a AS VARCHAR) AS eq_num, 'no relation to ' || b AS problem FROM pair WHERE (a + b) % 5 = 0")
def missing_pairs(spark, sf_dir):
    """Validation of the exported JSON from which some relations are left out."""
    t = analysed(spark, sf_dir)
    t["relations"] = t["relations"].where((F.col("a").cast("int") + F.col("b").cast("int")) % 5 != 0)
    return K.violations(K.read_document(exported(t)))


@query(f"WITH {PAPER} SELECT CAST(doc_id AS VARCHAR) AS paper, CAST(a AS VARCHAR) AS eq_num, 'bad relation to ' || b AS problem FROM pair WHERE a < b")
def grade_domain(spark, sf_dir):
    """Validation of the exported JSON with an unknown grade in half of the pairs."""
    t = analysed(spark, sf_dir)
    t["relations"] = t["relations"].withColumn("grade", F.when(F.col("a").cast("int") < F.col("b").cast("int"), "odd").otherwise(F.col("grade")))
    return K.violations(K.read_document(exported(t)))


@query(f"""WITH {GRADES}, z AS (SELECT CAST(doc_id AS VARCHAR) AS paper, CAST(k AS VARCHAR) AS eq_num, k FROM eq)
SELECT paper, eq_num, 'meaning without audit' AS problem FROM z WHERE k = 2 UNION ALL SELECT paper, eq_num, 'symbols without audit' FROM z WHERE k = 2
UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), CAST(a AS VARCHAR), 'relations without audit' FROM g WHERE a = 2 AND grade <> 'none'""")
def audit_coverage(spark, sf_dir):
    """Validation of the exported JSON without the audit of formula 2."""
    t = analysed(spark, sf_dir)
    t["audit"] = t["audit"].where("eq_num <> '2'")
    return K.violations(K.read_document(exported(t)))


@query(f"""WITH {PAPER}, z AS (SELECT CAST(doc_id AS VARCHAR) AS paper, CAST(k AS VARCHAR) AS eq_num, k FROM eq)
SELECT paper, eq_num, 'symbols/Q is no text' AS problem FROM z WHERE k = 1 UNION ALL SELECT paper, eq_num, 'missing field meaning' FROM z WHERE k = 2
UNION ALL SELECT paper, eq_num, 'private field _audit' FROM z WHERE k = 3 UNION ALL SELECT paper, eq_num, 'symbols is no object' FROM z WHERE k = 4""")
def entry_violations(spark, sf_dir):
    """Validation of the exported JSON with a number for a text, a missing and a private field, and a list for an object."""
    e = K.entries(analysed(spark, sf_dir))
    k = F.col("eq_num")
    e = e.withColumn("symbols", F.when(k == "1", '{"Q":5}').when(k == "4", "[]").otherwise(F.col("symbols")))
    doc = K.to_document(e).select(F.concat(F.lit('{"'), F.col("id").cast("string"), F.lit('":'), "json", F.lit("}")).alias("value"))
    read = K.read_document(doc)
    entry = F.when(F.col("eq_num") == "2", F.map_filter("entry", lambda f, v: f != "meaning")).when(F.col("eq_num") == "3", F.map_concat("entry", F.create_map(F.lit("_audit"), F.lit("x")))).otherwise(F.col("entry"))
    return K.violations(read.withColumn("entry", entry))


@query(f"WITH {PAPER} SELECT (SELECT count(*) FROM pair) AS valid, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS missing")
def relation_validity(spark, sf_dir):
    t = analysed(spark, sf_dir)
    return Q.relation_validity(t["relations"], t["equations"], K.GRADES)


@query(f"WITH {PAPER} SELECT (SELECT count(*) FROM pair) AS relations_new, CAST(0 AS BIGINT) AS relations_old, (SELECT count(*) FROM eq) AS strategy_weighted, CAST(0 AS BIGINT) AS strategy_old, (SELECT count(*) FROM eq WHERE k = 5) AS symbol_reject_logged, CAST(0 AS BIGINT) AS symbol_source_mathml, 'PASS' AS verdict")
def format_verdict(spark, sf_dir):
    t = analysed(spark, sf_dir)
    return Q.formats(K.read_document(exported(t, t["document"])))


@query(f"WITH {PAPER} SELECT doc_id, string_agg(CAST(k AS VARCHAR) || '|' || {METHOD} || '|' || replace(latex, chr(10), '') || '|' || length({BEFORE}), ';' ORDER BY k) AS entries FROM eq GROUP BY 1")
def stage_two(spark, sf_dir):
    """The JSON of the extracted formulas, read back."""
    doc = P.to_document(parts(spark, sf_dir)["equations"])
    e = F.map_entries(F.from_json("json", "map<string,map<string,string>>"))
    text = F.transform(e, lambda x: F.concat_ws("|", x["key"], F.element_at(x["value"], "latex_method"), F.replace(F.element_at(x["value"], "equation"), F.lit("\n"), F.lit("")), F.length(F.element_at(x["value"], "context_before"))))
    return doc.select(F.col("id").alias("doc_id"), F.array_join(text, ";").alias("entries"))


@query(f"WITH {PAPER}, d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL) SELECT d.doc_id, 'html' AS source, count(f.k) AS fragments, coalesce(string_agg('(' || f.k || ')', '' ORDER BY f.k), '') AS eq_nums FROM d LEFT JOIN f USING (doc_id) GROUP BY 1")
def stage_one(spark, sf_dir):
    """The JSON of all fragments of each paper, read back."""
    src = pages(spark, sf_dir)
    doc = P.fragments_document(src.select("id", F.lit("html").alias("source")), D.fragments(H.nodes(src, "id", "html", {"fragment"})))
    x = F.from_json("json", "source string, fragments array<struct<eq_num: string>>")
    return doc.select(F.col("id").alias("doc_id"), x["source"].alias("source"), F.size(x["fragments"]).cast("long").alias("fragments"), F.array_join(x["fragments"]["eq_num"], "").alias("eq_nums"))
