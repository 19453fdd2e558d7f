"""The engine's own queries, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T
from eqloom.operators import documents as D
from eqloom.operators import knowledge as K
from eqloom.operators import meaning as M
from eqloom.operators import quality as Q
from eqloom.operators import relations as E
from eqloom.operators import retrieval as R
from eqloom.operators import symbols as S
from eqloom.sources import fetch
from eqloom.sources import html as H
from eqloom.sources import papers as P
from eqloom.sources.durable import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP_SQL = listed([*L.RETRIEVAL_STOP, *L.RETRIEVAL_ARTIFACTS])
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains({STOP_SQL}, t) AND (regexp_full_match(t, '[0-9]+') OR length(t) >= 2))"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SENT = rf"""raw AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS l FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS s FROM raw),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i, {TRIM.format("s")} AS s FROM every WHERE length({TRIM.format("s")}) >= 10)"""
POST = f"""tok AS (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
post AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
st AS (SELECT count(*) AS n, avg(coalesce(len({TOKENS}), 0)) AS avgdl FROM documents),
qt AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2)"""
BM25 = f"""{POST},
sc AS (SELECT qid, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) + 1.0)) AS score,
  string_agg(post.term, ' ' ORDER BY post.term) AS matched FROM post JOIN qt ON qt.term = post.term JOIN df ON df.term = post.term CROSS JOIN st GROUP BY 1, 2),
hit AS (SELECT * FROM (SELECT qid, doc_id, round(score, 6) AS score, matched, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) WHERE rank <= 5)"""


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, s): sentences of at least ten characters, numbered from 0."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), "doc_id")
    kept = F.filter(F.transform(T.sentences(F.col("text")), T.strip), lambda x: F.length(x) >= 10)
    return d.select("doc_id", F.posexplode(kept).alias("i", "s"))


@query(f"WITH {BM25} SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, score FROM hit")
def bm25_topk(spark, sf_dir):
    hits = R.top_k(R.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")), 5)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT qid, doc_id, matched FROM hit")
def bm25_matched_terms(spark, sf_dir):
    hits = R.top_k(R.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")), 5)
    return hits.select("qid", F.col("id").alias("doc_id"), F.array_join(F.array_sort("matched"), " ").alias("matched"))


@query(f"""WITH {POST}, sc AS (SELECT qid, post.doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) + 1.0)) AS score
FROM post JOIN qt ON qt.term = post.term JOIN df ON df.term = post.term JOIN documents d ON d.doc_id = post.doc_id AND d.lang = 'en' AND d.source IN ('src1', 'src2', 'src3') CROSS JOIN st GROUP BY 1, 2)
SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""")
def bm25_filtered(spark, sf_dir):
    where = (F.col("lang") == "en") & F.col("source").isin("src1", "src2", "src3")
    hits = R.top_k(R.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), where=where), 5)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT qid, string_agg(d.text, ' ' ORDER BY rank) AS text FROM hit JOIN documents d USING (doc_id) GROUP BY qid")
def retrieve_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.retrieve_text(R.top_k(R.bm25(table(spark, sf_dir, "benchmark"), docs), 5), docs)


@query(f"""WITH {POST}, idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df CROSS JOIN st),
d AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM post JOIN idf USING (term)), dl AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM d GROUP BY 1),
q AS (SELECT qid, term, (1 + ln(qtf)) * idf AS w FROM qt JOIN idf USING (term)), ql AS (SELECT qid, sqrt(sum(w * w)) AS len FROM q GROUP BY 1),
dot AS (SELECT qid, doc_id, sum(d.w * q.w) AS dot FROM d JOIN q USING (term) GROUP BY 1, 2)
SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (SELECT qid, doc_id, round(dot / (dl.len * ql.len), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(dot / (dl.len * ql.len), 6) DESC, doc_id) AS rank FROM dot JOIN dl USING (doc_id) JOIN ql USING (qid)) WHERE rank <= 5""")
def tfidf_topk(spark, sf_dir):
    hits = R.top_k(R.tfidf(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")), 5)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT label AS qid, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, embedding FROM embeddings),
q AS (SELECT qid, embedding AS qv FROM h WHERE rank = 1), c AS (SELECT h.qid, id, rank, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS cosine FROM h JOIN q ON q.qid = h.qid)
SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, rank) AS new_rank FROM c""")
def vector_rerank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = e.select(F.col("label").alias("qid"), F.col("vec_id").alias("id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"), "embedding")
    out = R.rerank(hits.drop("embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), hits.where("rank = 1").select("qid", "embedding"))
    return out.select("qid", "id", F.round("cosine", 6).alias("cosine"), F.col("new_rank").cast("long").alias("new_rank"))


@query(f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {POST} SELECT term, df FROM df")
def term_df(spark, sf_dir):
    return R.term_df(R.postings(table(spark, sf_dir, "documents")))


@query(f"WITH {POST} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, sf_dir):
    return R.corpus_stats(table(spark, sf_dir, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT paper_id, min(conv_id * 1000 + turn) AS ord, row_number() OVER (ORDER BY min(conv_id * 1000 + turn)) AS place FROM (SELECT *, regexp_replace(trim(t, ' ' || chr(9)), '^(?i)arxiv:', '') AS paper_id FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' arXiv:' WHEN 1 THEN 'ARXIV:' ELSE '' END || conv_id || '.' || (turn // 2) || chr(9) AS t FROM conversations)) WHERE paper_id <> '' GROUP BY 1")
def paper_list_dedupe(spark, sf_dir):
    """Ids with prefixes and blanks, each at its first place, numbered through the list."""
    head = F.when(F.col("turn") % 3 == 0, " arXiv:").when(F.col("turn") % 3 == 1, "ARXIV:").otherwise("")
    c = table(spark, sf_dir, "conversations").select(F.concat(head, F.col("conv_id").cast("string"), F.lit("."), F.floor(F.col("turn") / 2).cast("string"), F.lit("\t")).alias("t"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    ids = P.numbered_papers(c, F.col("t"), "o").withColumn("one", F.lit(1))
    return D.running_before(ids, "ord", "one").select("paper_id", "ord", (F.col("before") + 1).alias("place"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 3 <> 1 AND d.text IS NOT NULL THEN 'html' WHEN l.doc_id IS NOT NULL THEN 'pdf' ELSE 'none' END AS source, CASE WHEN d.doc_id % 3 <> 1 AND d.text IS NOT NULL THEN strlen(d.text) WHEN l.doc_id IS NOT NULL THEN 2 END AS size FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def source_resolution(spark, sf_dir):
    """The page of a document as HTML if it was read, else a PDF if it has a label, else none."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    page = lambda df, kind, content, status: df.select(F.col("doc_id").alias("paper_id"), F.lit(kind).alias("endpoint"), content.cast("binary").alias("content"), status.alias("status"))
    html = page(d, "html", F.col("text"), F.when(F.col("doc_id") % 3 == 1, 404).when(F.col("doc_id") % 3 == 0, 200).otherwise(fetch.CACHED))
    got = html.unionByName(page(lab, "pdf", F.lit("%P"), F.lit(200)))
    return fetch.resolve(got).join(d.select(F.col("doc_id").alias("paper_id")), "paper_id", "left_semi").select(F.col("paper_id").alias("doc_id"), "source", F.length("content").cast("long").alias("size"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT conv_id, n, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT conv_id, n, CAST(before AS BIGINT) AS before FROM r WHERE before < 350""")
def stop_rule(spark, sf_dir):
    """Conversations as papers and turns as formulas, until 350 of them are reached."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return D.until(c.distinct().withColumn("ord", F.col("id")), c).select(F.col("id").alias("conv_id"), "n", "before")


@query("SELECT conv_id, turn, number, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS eq_ord FROM (SELECT conv_id, CAST(turn // 2 AS VARCHAR) AS number, min(turn) AS turn FROM conversations GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 7")
def cap_first_k(spark, sf_dir):
    """The first row of each repeated number, seven numbers a paper."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.floor(F.col("turn") / 2).cast("string").alias("number"))
    return D.first_numbers(c, "turn", 7).select(F.col("id").alias("conv_id"), "turn", "number", F.col("eq_ord").cast("long").alias("eq_ord"))


@query("""WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS o FROM conversations)
SELECT conv_id, turn, CASE WHEN o = 1 THEN role ELSE role || '_' || CAST(o - 1 AS VARCHAR) END AS key FROM k""")
def audit_keys(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("1").alias("eq_num"), F.col("turn").alias("seq"), F.col("role").alias("method"))
    return K.keyed(c).select(F.col("id").alias("conv_id"), F.col("seq").alias("turn"), "key")


@query(r"""WITH p AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
q AS (SELECT doc_id, i, CASE WHEN i % 5 = 3 THEN t || '  ( A.' || (i // 10) || ' )' ELSE t END AS t FROM p),
n AS (SELECT *, CASE WHEN len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) >= 4 THEN regexp_replace(t, '^\s+|\s+$', '', 'g') END AS prose FROM q),
c AS (SELECT *, last_value(prose IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before, first_value(prose IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS after,
  regexp_extract(t, '^(.*?)\s{2,}\(\s*([\dA-Za-z]+(?:[.\-][\dA-Za-z]+)*)\s*\)\s*$', ['eq', 'num']) AS m FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, m.num ORDER BY i) AS k FROM c WHERE m.num <> ''), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS eq_ord FROM o WHERE k = 1)
SELECT doc_id, m.num AS eq_num, eq_ord, regexp_replace(m.eq, '^\s+|\s+$', '', 'g') AS equation, 'pdf_text' AS latex_method, coalesce(before, '') AS context_before, coalesce(after, '') AS context_after FROM z WHERE eq_ord <= 7""")
def nearest_prose_line(spark, sf_dir):
    """Lines of documents as those of PDFs, every fifth one ending in a spaced number; contexts from the nearest prose."""
    p = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "t"))
    tag = F.concat(F.lit("  ( A."), F.floor(F.col("line_no") / 10).cast("string"), F.lit(" )"))
    lines = p.select("id", F.lit(1).alias("page"), "line_no", F.when(F.col("line_no") % 5 == 3, F.concat("t", tag)).otherwise(F.col("t")).alias("line"))
    return D.pdf_equations(lines).select(F.col("id").alias("doc_id"), "eq_num", F.col("eq_ord").cast("long").alias("eq_ord"), "equation", "latex_method", F.col("before").alias("context_before"), F.col("after").alias("context_after"))


_DIRTY = r"text || ' italic_x start_ROW tail road_ab _{0} \rho{t} \mathcal  superscript ' || chr(160) || 'end_ARRAY'"


@query(rf"""SELECT doc_id, {TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _DIRTY + rf", chr(160), ' ', 'g'), '{L.ARTIFACTS}', ' ', 'g'), '{L.SCRIPTS}', '', 'g'), '{L.RAW_LATEX}', '', 'g'), '\s+', ' ', 'g')")} AS clean FROM documents""")
def clean_text(spark, sf_dir):
    dirty = F.concat("text", F.lit(r" italic_x start_ROW tail road_ab _{0} \rho{t} \mathcal  superscript " + " end_ARRAY"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.clean_text(dirty).alias("clean"))


_DIRTY2 = r"text || ' a  b ital italic_x, start_ROW tail caligraphic_H bold_q road_ab _{0} \rho{t}  Superscript }{ ' || chr(160) || 'end_ARRAY'".replace("\\\\", "\\")
_STEPS = [L.CONTEXT_ARTIFACTS, L.SCRIPTS, L.RAW_LATEX, L.SCRIPT_WORDS, "[{}]"]


def _nested(x: str, steps: list[str]) -> str:
    for p in steps:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


@query(f"SELECT doc_id, {TRIM.format(f"regexp_replace({_nested(f'replace({_DIRTY2}, chr(160), chr(32))', _STEPS)}, ' {{2,}}', ' ', 'g')")} AS clean FROM documents")
def clean_context(spark, sf_dir):
    """The gentler cleaner: artifacts go without a blank, line ends stay."""
    dirty = F.concat("text", F.lit(" a  b ital italic_x, start_ROW tail caligraphic_H bold_q road_ab _{0} \\rho{t}  Superscript }{ \u00a0end_ARRAY"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.clean_context(dirty).alias("clean"))


@query(rf"""WITH {SENT}, w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS ws FROM sent)
SELECT doc_id, i, len(ws) >= 3 AND len(list_filter(ws, lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 2)) / len(ws) >= 0.4 AS prose FROM w""")
def is_prose(spark, sf_dir):
    return sentence_rows(spark, sf_dir).select("doc_id", F.col("i").cast("long").alias("i"), T.is_prose(F.col("s")).alias("prose"))


@query("""WITH s AS (SELECT doc_id, 'S' || (doc_id % 7) || '.' AS sec, CAST(doc_id // 7 AS BIGINT) AS p FROM documents)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.sec = b.sec AND abs(a.p - b.p) = 1""")
def adjacent_paragraphs(spark, sf_dir):
    """Paragraph ids that are neighbours, by an equi-join."""
    pid = F.concat(F.lit("S"), (F.col("doc_id") % 7).cast("string"), F.lit(".p"), F.floor(F.col("doc_id") / 7).cast("string"))
    s = table(spark, sf_dir, "documents").select("doc_id", pid.alias("para_id"))
    near = D.next_to(s, s)
    # the column form says the same of each pair
    return near.where(D.adjacent(F.col("para_id"), F.col("para_id_b"))).select(F.col("doc_id").alias("doc_a"), F.col("doc_id_b").alias("doc_b"))


@query(f"SELECT doc_id, {' OR '.join('contains(low, ' + repr(g.lower()) + ')' if chr(39) not in g else 'contains(low, ' + chr(39) + g.lower().replace(chr(39), chr(39) * 2) + chr(39) + ')' for g in L.GAZETTEER)} AS named FROM (SELECT doc_id, lower(text || CASE WHEN doc_id % 5 = 0 THEN ' The Density Matrix.' ELSE '' END) AS low FROM documents)")
def gazetteer_match(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " The Density Matrix.").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.has_gazetteer_name(t).alias("named"))


NUMBERS = "CASE turn % 4 WHEN 0 THEN CAST(turn AS VARCHAR) WHEN 1 THEN 'A.' || turn WHEN 2 THEN (10 - turn) || 'a' ELSE CAST(30 - turn AS VARCHAR) END"


def numbers(turn: Column) -> Column:
    n = turn.cast("string")
    return F.when(turn % 4 == 0, n).when(turn % 4 == 1, F.concat(F.lit("A."), n)).when(turn % 4 == 2, F.concat((10 - turn).cast("string"), F.lit("a"))).otherwise((30 - turn).cast("string"))


@query(f"WITH n AS (SELECT DISTINCT conv_id, {NUMBERS} AS eq FROM conversations) SELECT conv_id, eq, row_number() OVER (PARTITION BY conv_id ORDER BY try_cast(eq AS INT) IS NULL, try_cast(eq AS INT), eq) AS place FROM n")
def eq_sort(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").select("conv_id", numbers(F.col("turn")).alias("eq")).distinct()
    return n.select("conv_id", "eq", F.row_number().over(Window.partitionBy("conv_id").orderBy(*D.order_of(F.col("eq")))).cast("long").alias("place"))


@query(rf"""WITH t AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN '(' || n || ')' WHEN 1 THEN ' ( ' || n || ' ) ' WHEN 2 THEN '(' || n || chr(39) || ')' WHEN 3 THEN n ELSE '(S1-' || n || ')' END AS tag FROM (SELECT *, {NUMBERS} AS n FROM conversations))
SELECT conv_id, turn, tag, nullif(regexp_extract(tag, '{L.EQ_NUMBER}', 1), '') AS number FROM t""")
def eq_number_parse(spark, sf_dir):
    n, c = numbers(F.col("turn")), F.col("conv_id") % 5
    tag = F.when(c == 0, F.concat(F.lit("("), n, F.lit(")"))).when(c == 1, F.concat(F.lit(" ( "), n, F.lit(" ) "))).when(c == 2, F.concat(F.lit("("), n, F.lit("')"))).when(c == 3, n).otherwise(F.concat(F.lit("(S1-"), n, F.lit(")")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tag.alias("tag")).withColumn("number", T.eq_number(F.col("tag")))


@query("SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 + (length(html) - length(replace(html, '<p ', ''))) / 3 AS BIGINT) AS paragraphs FROM pages WHERE html IS NOT NULL AND regexp_matches(html, '<p[ >]')")
def page_paragraphs(spark, sf_dir):
    n = H.nodes(table(spark, sf_dir, "pages"), "page_id", "html", {"page_p"})
    return n.groupBy(F.col("id").alias("page_id")).agg(F.count(F.lit(1)).alias("paragraphs"))


@query(f"""WITH {SENT}, c AS (SELECT doc_id, i, s || CASE WHEN i % 4 = 1 THEN ' (see Eq. (2) and (3a))' ELSE '' END AS s FROM sent),
n AS (SELECT doc_id, i, unnest(regexp_extract_all(s, '(?i)(?:eq(?:uation)?s?\\.?\\s*)?\\(\\s*(\\d+[a-z]?(?:\\.\\d+)?)\\s*\\)', 1)) AS num FROM c)
SELECT DISTINCT doc_id, i, num FROM n""".replace("\\\\", "\\"))
def xrefs_lexical(spark, sf_dir):
    s = sentence_rows(spark, sf_dir).withColumn("s", F.concat("s", F.when(F.col("i") % 4 == 1, " (see Eq. (2) and (3a))").otherwise("")))
    return s.select("doc_id", F.col("i").cast("long").alias("i"), F.explode(T.cited_numbers(F.col("s"))).alias("num")).distinct()


@query(rf"""WITH {SENT}, c AS (SELECT doc_id, i, {TRIM.format("regexp_replace(s, '[()]', '', 'g')")} AS t, i % 4 AS r FROM sent),
x AS (SELECT doc_id, i, CASE r WHEN 1 THEN 'By ( 2 ) it stands. Substituting Eq. (2) ' WHEN 2 THEN 'By (2) this yields ' WHEN 3 THEN 'Substituting it here! So (2) ' ELSE '' END || t AS whole, r FROM c)
SELECT doc_id, i, CASE r WHEN 1 THEN regexp_extract(whole, 'Substituting Eq\. \(2\)[^.!?]*[.!?]?') WHEN 2 THEN regexp_extract(whole, 'By \(2\)[^.!?]*[.!?]?')
  WHEN 3 THEN CASE WHEN {' OR '.join(f"contains(lower(regexp_extract(whole, 'So .2.[^.!?]*')), '{c}')" for c in L.DERIVATION_CUES)} THEN regexp_extract(whole, 'So \(2\)[^.!?]*[.!?]?') END END AS cue FROM x""")
def derivation_cues(spark, sf_dir):
    """The first sentence that cites formula 2 and holds a cue of a derivation."""
    lead = F.when(F.col("i") % 4 == 1, "By ( 2 ) it stands. Substituting Eq. (2) ").when(F.col("i") % 4 == 2, "By (2) this yields ").when(F.col("i") % 4 == 3, "Substituting it here! So (2) ").otherwise("")
    s = sentence_rows(spark, sf_dir).withColumn("s", F.concat(lead, T.strip(F.translate("s", "()", ""))))
    return s.select("doc_id", F.col("i").cast("long").alias("i"), E.cue_sentence(F.lit("2"), F.col("s")).alias("cue"))


# formulas written from the turns of conversations: a Greek letter, two initials, commands and indices
FORMULAS = rf"""g AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS l FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, '\' || ['alpha', 'rho', 'Gamma', 'hbar', 'infty'][conv_id % 5 + 1] || ' ' || upper(coalesce(l[1][1], '')) || '_{{i}}=\frac{{' || upper(coalesce(l[2][1], '')) || 'x}}{{m}}+\mathrm{{d}}\psi' AS latex FROM g),
t AS (SELECT conv_id, turn, unnest(regexp_extract_all(latex, '\\[a-zA-Z]+|[A-Za-z]')) AS t, unnest(range(len(regexp_extract_all(latex, '\\[a-zA-Z]+|[A-Za-z]')))) AS o FROM f),
sym AS (SELECT conv_id, turn, ltrim(t, '\') AS sym, min(o) AS o FROM t WHERE (t[1] = '\' AND list_contains({listed(list(L.GREEK))}, ltrim(t, '\'))) OR (t[1] <> '\' AND NOT list_contains({listed(L.SKIP_LETTERS)}, t)) GROUP BY 1, 2, 3)"""


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    word = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    first = lambda n: F.upper(F.substring(F.coalesce(F.try_element_at(word, F.lit(n)), F.lit("")), 1, 1))
    greek = F.element_at(F.array(*[F.lit(x) for x in ("alpha", "rho", "Gamma", "hbar", "infty")]), (F.col("conv_id") % 5 + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(F.lit("\\"), greek, F.lit(" "), first(1), F.lit(r"_{i}=\frac{"), first(2), F.lit(r"x}{m}+\mathrm{d}\psi")).alias("latex"))


@query(f"WITH {FORMULAS} SELECT conv_id, turn, string_agg(sym, ' ' ORDER BY o) AS symbols FROM sym GROUP BY 1, 2")
def latex_symbols(spark, sf_dir):
    return formulas(spark, sf_dir).select("conv_id", "turn", F.array_join(T.latex_symbols(F.col("latex")), " ").alias("symbols"))


@query(f"""WITH {FORMULAS}, l AS (SELECT conv_id, turn, list(sym) AS s FROM sym GROUP BY 1, 2), j AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.turn <> b.turn)
SELECT conv_id, a, b, round(j, 6) AS jaccard, j >= 0.3 AS potential FROM j""")
def jaccard_pairs(spark, sf_dir):
    f = formulas(spark, sf_dir).select(F.col("conv_id").alias("id"), F.col("turn").alias("eq_num"), T.latex_symbols(F.col("latex")).alias("s"))
    p = E.pairs(f).join(f.withColumnsRenamed({"eq_num": "a", "s": "sa"}), ["id", "a"]).join(f.withColumnsRenamed({"eq_num": "b", "s": "sb"}), ["id", "b"])
    j = E.jaccard(F.col("sa"), F.col("sb"))
    return p.select(F.col("id").alias("conv_id"), "a", "b", F.round(j, 6).alias("jaccard"), (j >= E.JACCARD).alias("potential"))


# three words of a sentence, and what is said of the symbol psi with them
_W3 = "array_to_string(regexp_extract_all(lower(s), '[a-z]+')[1:3], ' ')"
_SAID = [("where_is", "So where ψ stands for the {w}, all is said.", "high"), ("let_be", "Now Let $\\psi$ be {w}; it holds.", "high"), ("sym_is", "here psi denotes {w}. End", "high"), ("the_noun_sym", "take, the field {w} ψ!", "medium"), ("sym_the", "with Psi, the {w}; so", "low"), (None, "a word on psis and {w}", None)]


@query(rf"""WITH {SENT}, w AS (SELECT doc_id, i, {_W3} AS w, i % 6 AS r FROM sent WHERE len(regexp_extract_all(lower(s), '[a-z]+')) >= 3)
SELECT doc_id, i, CASE WHEN r = 0 THEN regexp_replace(w, '^(.+?) and .*$', '\1') WHEN r = 3 THEN 'field ' || w WHEN r = 5 THEN NULL WHEN r = 4 THEN w ELSE regexp_replace(w, '^the (.)', '\1') END AS definition,
CASE r {' '.join(f"WHEN {n} THEN '{p}'" for n, (p, _, _) in enumerate(_SAID) if p)} END AS pattern, CASE r {' '.join(f"WHEN {n} THEN '{c}'" for n, (p, _, c) in enumerate(_SAID) if p)} END AS confidence FROM w WHERE NOT (r = 0 AND regexp_matches(w, '^the |^and | and$'))""")
def symbol_definitions(spark, sf_dir):
    """All five forms of a definition of psi, by its name or its letter, and none."""
    s = sentence_rows(spark, sf_dir).select("doc_id", F.col("i").cast("long").alias("i"), F.regexp_extract_all(F.lower("s"), F.lit("([a-z]+)"), 1).alias("l")).where("size(l) >= 3")
    w = F.array_join(F.slice("l", 1, 3), " ")
    r = F.col("i") % 6
    said = [F.replace(F.lit(t), F.lit("{w}"), w) for _, t, _ in _SAID]
    context = F.element_at(F.array(*said), (r + 1).cast("int"))
    found = s.where(~((r == 0) & w.rlike("^the |^and | and$"))).withColumn("x", S.find(F.lit("psi"), context))
    return found.select("doc_id", "i", "x.definition", "x.pattern", "x.confidence")


_REJECTED = ["'H'", "'psi'", "'the ' || w", "w || ' of'", "'of the'", "split_part(w, ' ', 1)", "'SYM ' || w || ' energy level'", "w || ' energy \\rho'", "w || ' energy' || chr(8203)", "substr(w, 1, 1)"]


@query(rf"""WITH {SENT}, p AS (SELECT doc_id, i, {_W3} AS w FROM sent), d AS (SELECT doc_id, i, CASE i % 12 {' '.join(f"WHEN {n} THEN {x}" for n, x in enumerate(_REJECTED))} ELSE w END AS d FROM p), w AS (SELECT *, list_filter(regexp_split_to_array(lower(d), '\s+'), lambda z: z <> '') AS w FROM d)
SELECT doc_id, i, d AS definition, CASE WHEN length(d) <= 1 THEN 'single_char_def' WHEN lower(d) = 'hh' THEN 'def_equals_symbol' WHEN lower(d) = 'psi' OR d = 'Rho' THEN 'def_equals_other_symbol' WHEN list_contains({listed(L.DANGLING)}, w[1]) THEN 'starts_with_function_word'
 WHEN list_contains({listed(L.DANGLING)}, w[-1]) THEN 'dangling_function_word' WHEN len(list_filter(w, lambda x: NOT list_contains({listed(L.DEFINITION_STOP)}, x))) = 0 THEN 'stop_words_only'
 WHEN len(list_filter(w, lambda x: NOT list_contains({listed(L.DEFINITION_STOP)}, x) AND length(x) > 1)) < 2 THEN 'too_few_content_words' WHEN contains(d, 'SYM') THEN 'contains_SYM_placeholder'
 WHEN contains(d, '\') OR contains(d, '{{') OR contains(d, '}}') THEN 'contains_latex_fragment' WHEN contains(d, chr(8203)) THEN 'artifact_chars' END AS reason FROM w""")
def symbol_rejects(spark, sf_dir):
    """Definitions made from every sentence, and why they are none of the symbol HH beside Psi."""
    w = F.array_join(F.slice(F.regexp_extract_all(F.lower("s"), F.lit("([a-z]+)"), 1), 1, 3), " ")
    made = [F.lit("H"), F.lit("psi"), F.concat(F.lit("the "), w), F.concat(w, F.lit(" of")), F.lit("of the"), F.split_part(w, F.lit(" "), F.lit(1)), F.concat(F.lit("SYM "), w, F.lit(" energy level")), F.concat(w, F.lit(" energy \\rho")), F.concat(w, F.lit(" energy​")), F.substring(w, 1, 1), w, w]
    d = sentence_rows(spark, sf_dir).select("doc_id", F.col("i").cast("long").alias("i"), F.element_at(F.array(*made), (F.col("i") % 12 + 1).cast("int")).alias("definition"))
    return d.withColumn("reason", T.reject_reason(F.col("definition"), F.lit("HH"), F.array(F.lit("HH"), F.lit("Psi"))))


@query(rf"""SELECT source, count_if(regexp_matches(text, '{L.GARBAGE}')) AS garbage, count_if(regexp_matches(text, '{L.NOISE}')) AS noise, count(text) AS total, round(count_if(regexp_matches(text, '{L.NOISE}')) / nullif(count(text), 0), 6) AS share
FROM (SELECT source, CASE doc_id % 9 WHEN 0 THEN text || ' x_{{0}}' WHEN 1 THEN 'H' WHEN 2 THEN '\rho is' WHEN 3 THEN text || ' road_x' WHEN 4 THEN '{{}}' ELSE text END AS text FROM documents) GROUP BY 1""")
def garbage_and_noise_rates(spark, sf_dir):
    t, r = F.col("text"), F.col("doc_id") % 9
    made = F.when(r == 0, F.concat(t, F.lit(" x_{0}"))).when(r == 1, "H").when(r == 2, "\\rho is").when(r == 3, F.concat(t, F.lit(" road_x"))).when(r == 4, "{}").otherwise(t)
    d = table(spark, sf_dir, "documents").select("source", made.alias("text"))
    garbage = Q.rates(d, "text", L.GARBAGE, ["source"]).select("source", F.col("n").alias("garbage"))
    return Q.rates(d, "text", L.NOISE, ["source"]).withColumnRenamed("n", "noise").join(garbage, "source").select("source", "garbage", "noise", "total", "share")


@query("SELECT substr(text, 1, 60) AS head, count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 GROUP BY 1 ORDER BY n DESC, head LIMIT 8")
def duplicate_desc(spark, sf_dir):
    """The commonest beginnings of descriptions of strong relations (texts of documents here)."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.when(F.col("doc_id") % 3 == 0, "none").otherwise("strong").alias("grade"), F.col("text").alias("description"))
    return Q.common_descriptions(d)


@query("""WITH m AS (SELECT source, lang FROM documents) SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS paper, count_if(lang = 'de') AS de, count_if(lang = 'en') AS en, count_if(lang IS NULL) AS none, count(*) AS total FROM m GROUP BY ROLLUP (source)
UNION ALL SELECT 'nobody', 0, 0, 0, 0""")
def status_rollup(spark, sf_dir):
    """Strategies of each paper's choices and a row of totals (sources and languages here, and a paper without any)."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.lit("1").alias("eq_num"), F.col("lang").alias("strategy"))
    papers = d.select("id").distinct().unionByName(spark.range(1).select(F.lit("nobody").alias("id")))
    return Q.strategy_pivot(papers, d, ["de", "en"])


@query(f"""WITH {SENT}, t AS (SELECT doc_id, i, s, unnest(list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda x: length(x) > 1 AND NOT list_contains({listed(L.MEANING_STOP)}, x))) AS term FROM sent),
f AS (SELECT term, ln((nd + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, count(DISTINCT (doc_id, i)) AS df FROM t GROUP BY 1) CROSS JOIN (SELECT count(*) AS nd FROM sent)),
m AS (SELECT doc_id, i, round(avg(idf), 6) AS score FROM t JOIN f USING (term) GROUP BY 1, 2)
SELECT doc_id, i, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS o FROM m) WHERE o = 1""")
def idf_mean_rank(spark, sf_dir):
    """The sentence of each document with the rarest words on average."""
    s = sentence_rows(spark, sf_dir).select("doc_id", F.col("i").cast("long").alias("i"), "s")
    m = M.mean_idf(s, M.idf(s, "s"), ["doc_id", "i"]).withColumn("score", F.round("score", 6))
    return m.withColumn("o", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "i"))).where("o = 1").drop("o")


@query(rf"""WITH {SENT}, a AS (SELECT doc_id, max(s) FILTER (i = 0) AS s0, max(s) FILTER (i = 1) AS s1, max(s) FILTER (i = 2) AS s2 FROM sent GROUP BY 1),
e AS (SELECT doc_id, coalesce(s0, '') || ' ' || coalesce(s1, '') AS before, coalesce(s2, '') || CASE doc_id % 3 WHEN 0 THEN ' All rests on Eq. ( 1 ) now.' WHEN 1 THEN ' A Master Equation rules it.' ELSE '' END AS after FROM a),
x AS (SELECT doc_id, 0 AS side, before AS t FROM e UNION ALL SELECT doc_id, 1, after FROM e),
p AS (SELECT doc_id, side, unnest(l) AS s, unnest(range(len(l))) AS o FROM (SELECT doc_id, side, string_split(regexp_replace({TRIM.format("t")}, '([.!?])\s+([A-Z(])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS l FROM x)),
u AS (SELECT doc_id, {TRIM.format("s")} AS s, min(side * 1000 + o) AS o FROM p WHERE length({TRIM.format("s")}) > 10 GROUP BY 1, 2),
wd AS (SELECT doc_id, s, o, unnest(list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda z: length(z) > 1 AND NOT list_contains({listed(L.MEANING_STOP)}, z))) AS term FROM u),
dfs AS (SELECT term, count(DISTINCT (doc_id, side)) AS df FROM (SELECT doc_id, side, unnest(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda z: length(z) > 1 AND NOT list_contains({listed(L.MEANING_STOP)}, z))) AS term FROM x) GROUP BY 1),
sc AS (SELECT doc_id, o, round(avg(coalesce(ln((n + 1) / (df + 1)) + 1, 0)), 6) AS score FROM wd LEFT JOIN dfs USING (term) CROSS JOIN (SELECT count(*) AS n FROM x) GROUP BY 1, 2),
st AS (SELECT u.*, score, CASE WHEN regexp_matches(s, '\(\s*1\s*\)') THEN 1 WHEN {' OR '.join("contains(lower(s), '" + g.lower().replace("'", "''") + "')" for g in L.GAZETTEER)} THEN 2 WHEN score IS NOT NULL THEN 3 END AS step FROM u LEFT JOIN sc USING (doc_id, o)),
b AS (SELECT * FROM st WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step, CASE WHEN step = 3 THEN -score ELSE 0 END, o) = 1)
SELECT e.doc_id, coalesce(b.s, '') AS meaning, CASE step WHEN 1 THEN 'citation_match' WHEN 2 THEN 'gazetteer_match' WHEN 3 THEN 'tfidf_rank' END AS strategy, CASE WHEN step = 3 THEN score END AS score FROM e LEFT JOIN b USING (doc_id)""")
def meaning_cascade(spark, sf_dir):
    """The earlier rule of choosing a meaning, from the first sentences of each document."""
    s = sentence_rows(spark, sf_dir).where("i < 3").groupBy("doc_id").pivot("i", [0, 1, 2]).agg(F.first("s"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    tail = F.when(F.col("doc_id") % 3 == 0, " All rests on Eq. ( 1 ) now.").when(F.col("doc_id") % 3 == 1, " A Master Equation rules it.").otherwise("")
    e = s.select(F.col("doc_id").alias("id"), F.lit("1").alias("eq_num"), F.concat(none("0"), F.lit(" "), none("1")).alias("before"), F.concat(none("2"), tail).alias("after"))
    return M.cascade(e).select(F.col("id").alias("doc_id"), "meaning", "strategy", "score")


@query(f"""WITH {SENT}, c AS (SELECT doc_id, i, {TRIM.format("regexp_replace(s, '[()]', '', 'g')")} AS t FROM sent), x AS (SELECT doc_id, i, CASE i % 5 WHEN 1 THEN 'Equation (3A) denotes the density operator. ' WHEN 2 THEN 'This describes ' WHEN 3 THEN '(3a) of ' ELSE '' END || t AS s FROM c),
z AS (SELECT *, i % 7 = 0 AS ctx, i % 7 <> 0 AND i % 4 IN (1, 3) AS adj, i % 7 = 0 OR i % 3 = 1 AS sec, i = 4 AS top, length(s) < 30 OR length(s) > 400 AS bad, i % 5 = 1 AND length(s) > 30 AS cite, regexp_matches(s, '{L.DEFINITION_CUE}') AS cue,
  {' OR '.join("contains(lower(s), '" + g.lower().replace("'", "''") + "')" for g in L.GAZETTEER)} AS named FROM x)
SELECT doc_id, i, 5 * cite::INT + 3 * cue::INT + 3 * named::INT + 2 * ctx::INT + 2 * adj::INT + sec::INT + top::INT - bad::INT AS points,
  array_to_string(list_filter([CASE WHEN cite THEN 'eq_num' END, CASE WHEN cue THEN 'definitional' END, CASE WHEN named THEN 'gazetteer' END, CASE WHEN ctx THEN 'context_window' END, CASE WHEN adj THEN 'para_adj' END, CASE WHEN sec THEN 'same_section' END, CASE WHEN top THEN 'bm25_top1' END, CASE WHEN bad THEN 'badlen' END], lambda q: q IS NOT NULL), ',') AS signals FROM z""")
def meaning_scores(spark, sf_dir):
    """All eight signals and their points, on every sentence as a candidate for formula 3a."""
    lead = F.when(F.col("i") % 5 == 1, "Equation (3A) denotes the density operator. ").when(F.col("i") % 5 == 2, "This describes ").when(F.col("i") % 5 == 3, "(3a) of ").otherwise("")
    s = sentence_rows(spark, sf_dir).select("doc_id", F.col("i").cast("long").alias("i"), F.concat(lead, T.strip(F.translate("s", "()", ""))).alias("s"))
    i = F.col("i")
    para = F.concat(F.lit("S1.p"), (F.lit(5) + F.element_at(F.array(*[F.lit(x) for x in (0, 1, 3, -1)]), (i % 4 + 1).cast("int"))).cast("string"))
    cands = s.select(F.col("doc_id").alias("id"), F.lit("3a").alias("eq_num"), "i", "s", (i % 7 == 0).alias("context"), F.when(i % 3 == 1, "S1").otherwise("S2").alias("section_id"), para.alias("para_id"), F.when(i == 4, 1).otherwise(2).alias("rank"))
    places = s.select(F.col("doc_id").alias("id")).distinct().select("id", F.lit("3a").alias("eq_num"), F.lit("S1").alias("section_id"), F.lit("S1.p5").alias("para_id"))
    return M.signals(cands, places).select(F.col("id").alias("doc_id"), "i", "points", F.array_join("signals", ",").alias("signals"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn % 3 AS e, split_part(coalesce(text, ''), ' ', 1) AS s, (length(coalesce(text, '')) + turn) % 9 AS points, CAST(length(coalesce(text, '')) % 3 AS DOUBLE) AS score, turn FROM conversations),
l AS (SELECT conv_id, e, list({'s': s, 'p': points} ORDER BY points DESC, score DESC, turn, s) FILTER (points >= 3) AS l FROM c GROUP BY 1, 2),
r(conv_id, e, taken, pick) AS (SELECT conv_id, -1, [''][1:0], NULL::STRUCT(s VARCHAR, p BIGINT) FROM c GROUP BY 1
  UNION ALL SELECT conv_id, e, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.s) END, pick FROM (SELECT r.conv_id, r.e + 1 AS e, r.taken, list_filter(l.l, lambda x: NOT list_contains(r.taken, x.s))[1] AS pick FROM r LEFT JOIN l ON l.conv_id = r.conv_id AND l.e = r.e + 1 WHERE r.e < 2))
SELECT r.conv_id, CAST(r.e AS VARCHAR) AS eq_num, coalesce(pick.s, '') AS meaning, pick.p AS points FROM r JOIN l ON l.conv_id = r.conv_id AND l.e = r.e""")
def meaning_choices(spark, sf_dir):
    """Formulas of a paper choose in turn, each the best sentence that none before it took (first words of turns here)."""
    t = F.coalesce("text", F.lit(""))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), (F.col("turn") % 3).cast("string").alias("eq_num"), F.split_part(t, F.lit(" "), F.lit(1)).alias("s"), ((F.length(t) + F.col("turn")) % 9).cast("int").alias("points"), (F.length(t) % 3).cast("double").alias("score"), F.col("turn").cast("int").alias("rank"))
    c = c.select("*", F.lit(0).alias("pos"), F.lit("c").alias("chunk_id"), F.lit(0).alias("char_offset"), F.array(F.lit("x")).alias("signals"))
    e = c.select("id", "eq_num").distinct().withColumn("eq_ord", F.col("eq_num").cast("int"))
    return M.choose(c, e).select(F.col("id").alias("conv_id"), "eq_num", "meaning", F.col("points").cast("long").alias("points"))


@query(r"""SELECT item_id, 'Eq ' || n || ' Equation ' || n || ' describes represents gives defines called known as' || CASE WHEN item_id % 2 = 0 THEN ' H E' ELSE '' END AS meaning, f || ' where denotes represents is defined as called corresponds to' AS symbol,
'Eq ' || n || ' Eq ' || (n + 1) || ' using substituting inserting follows from derived from yields equivalent special case' AS relation FROM (SELECT item_id, item_id % 9 AS n, ['alpha α', 'gamma Γ', 'epsilon varepsilon ε', 'H', '\Xi', 'phi φ'][item_id % 6 + 1] AS f FROM benchmark)""")
def query_templates(spark, sf_dir):
    """The fixed texts that ask for meanings, symbols and relations."""
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 9).cast("string").alias("n"), (F.col("item_id") % 9 + 1).cast("string").alias("m"))
    sym = F.element_at(F.array(*[F.lit(x) for x in (r"\alpha", r"\Gamma", r"\varepsilon", "H", r"\Xi", r"\phi")]), (F.col("item_id") % 6 + 1).cast("int"))
    more = F.when(F.col("item_id") % 2 == 0, "H E ").otherwise(" ")
    return b.select("item_id", R.meaning_query(F.col("n"), more).alias("meaning"), R.symbol_query(sym).alias("symbol"), R.relation_query(F.col("n"), F.col("m")).alias("relation"))


@query(f"""WITH tok AS (SELECT conv_id, turn, t FROM (SELECT conv_id, turn, {TOKENS} AS t FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))), st AS (SELECT conv_id, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY 1),
post AS (SELECT conv_id, turn, term, count(*) AS tf, max(dl) AS dl FROM (SELECT conv_id, turn, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2, 3), df AS (SELECT conv_id, term, count(*) AS df FROM post GROUP BY 1, 2), q AS (SELECT conv_id, term, tf AS qtf FROM post WHERE turn = 0),
ok AS (SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND turn % 3 = 1 AND (turn % 4 IN (1, 3))),
sc AS (SELECT post.conv_id, post.turn, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0))) + 1.0)), 6) AS score FROM post JOIN q USING (conv_id, term) JOIN df USING (conv_id, term) JOIN st USING (conv_id) JOIN ok ON ok.conv_id = post.conv_id AND ok.turn = post.turn GROUP BY 1, 2)
SELECT conv_id, turn, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM sc) WHERE rank <= 3""")
def passages_filtered(spark, sf_dir):
    """Passages of a paper (turns here) like its first, of given types, in one section, near given formulas."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("chunk_ord"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("chunk_type"), F.concat(F.lit("S"), (F.col("turn") % 3).cast("string")).alias("section_id"), F.array((F.col("turn") % 4).cast("string")).alias("eq_nums"))
    ask = c.where("chunk_ord = 0").select("id", F.lit("q").alias("qid"), "text")
    hits = R.within_papers(R.paper_postings(c), ask, 3, c.where(R.matching(["user", "assistant"], "S1", ["1", "3"])))
    return hits.select(F.col("id").alias("conv_id"), F.col("chunk_ord").alias("turn"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(r"SELECT conv_id, turn, regexp_replace(text || ' with $x^2$ and \(y_1\) or \rho{t}.', '\$[^$]+\$|\\\([^)]+\\\)|\\[a-zA-Z]+\{[^}]*\}', 'MATHSYM', 'g') AS plain FROM conversations")
def inline_math(spark, sf_dir):
    """Inline formulas replaced by a word."""
    t = F.concat("text", F.lit(r" with $x^2$ and \(y_1\) or \rho{t}."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_math(t).alias("plain"))


@query(f"WITH {SENT} SELECT doc_id, i FROM sent WHERE contains(s, 'and the') OR contains(s, 'The')")
def symbol_view(spark, sf_dir):
    """Passages that hold a form of a symbol, as it is written."""
    s = sentence_rows(spark, sf_dir).withColumnRenamed("s", "text")
    return D.naming(s, ["and the", "The"]).select("doc_id", F.col("i").cast("long").alias("i"))


@query(f"""WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 1 AND NOT list_contains({listed(L.PAIR_STOP)}, x))) AS term FROM conversations),
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM t GROUP BY 1, 2, 3),
df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY 1, 2), w AS (SELECT conv_id, turn, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (conv_id, term) JOIN n USING (conv_id)),
l AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS l FROM w GROUP BY 1, 2)
SELECT a.conv_id, a.turn AS a, b.turn AS b, round(sum(a.w / la.l * b.w / lb.l), 6) AS cosine FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn <> b.turn
JOIN l la ON la.conv_id = a.conv_id AND la.turn = a.turn JOIN l lb ON lb.conv_id = b.conv_id AND lb.turn = b.turn GROUP BY 1, 2, 3""")
def tfidf_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("eq_num"), "text")
    return E.cosines(c).select(F.col("id").alias("conv_id"), "a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH c AS (SELECT conv_id, turn, {TRIM.format("regexp_extract(text || ' and by Eq. ( 3A ) so it goes. More (3a).', '(?is)([^.!?]*?(?:eq(?:uation)?s?\\.?\\s*)?\\(\\s*3a\\s*\\)[^.!?]*[.!?]?)', 1)")} AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN length(s) > 20 AND s[1] <> '(' THEN s END AS sentence FROM c""")
def citation_sentences(spark, sf_dir):
    text = F.concat("text", F.lit(" and by Eq. ( 3A ) so it goes. More (3a)."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.citation_sentence(F.lit("3a"), text).alias("sentence"))


@query("SELECT conv_id, turn, conv_id || '_' || turn || CASE turn % 3 WHEN 0 THEN '_abs.html' WHEN 1 THEN '_html.html' ELSE '_pdf.pdf' END AS name FROM conversations")
def cache_names(spark, sf_dir):
    """File names of pages in the cache, of ids with a slash."""
    c = table(spark, sf_dir, "conversations")
    paper = F.concat_ws("/", "conv_id", "turn")
    name = F.when(F.col("turn") % 3 == 0, fetch.cache_name(paper, "abs")).when(F.col("turn") % 3 == 1, fetch.cache_name(paper, "html")).otherwise(fetch.cache_name(paper, "pdf"))
    return c.select("conv_id", "turn", name.alias("name"))
