"""Retrieval: postings, BM25+ and TF-IDF scores, filters, top-k, vector re-ranking.

All queries of a batch are answered by one plan: their terms join the postings, scores are
summed with map-side combine, and a window ranks each query's hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eqloom import lexicon as L
from eqloom.functions import text as T
from eqloom.sources.durable import spread

K1, B, DELTA = 1.5, 0.75, 1.0


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, t): the array of terms of each document and its length; a null text has none."""
    src = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")), "text")
    return src.select("id", T.tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("dl"), "t")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl): a row for each term of each document; of the terms in `wanted` only, if it is given.

    A null or empty text has no rows, nor has a document without an id; rows that repeat an id are one document.
    """
    rows = terms(docs.where(F.col(id_col).isNotNull()), id_col, text_col).select("id", "dl", F.explode("t").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def term_df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, avgdl) over all documents, those without terms included: one row."""
    one = docs.select(F.lit(0).alias("i"), F.col(text_col).alias("t"))
    return terms(one, "i", "t").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, qtf): repeated terms keep their count."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(T.tokens(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def meaning_query(number: Column, symbols: Column | None = None) -> Column:
    """Text that looks for the sentence that says what a formula is."""
    base = F.concat(F.lit("Eq "), number, F.lit(" Equation "), number, F.lit(" describes represents gives defines called known as"))
    return base if symbols is None else F.rtrim(F.concat_ws(" ", base, F.nullif(T.strip(symbols), F.lit(""))))


def symbol_query(symbol: Column, surface: Column | None = None) -> Column:
    """Text that looks for a symbol's definition, by its name in prose and its character (four forms at most)."""
    known = F.create_map(*[F.lit(x) for name, c in L.GREEK.items() if name not in L.NO_QUERY_FORMS for x in ("\\" + name, f"{name.lower()}\0{c[0]}")], *[F.lit(x) for k, v in L.QUERY_FORMS.items() for x in (k, "\0".join(v))])
    found = surface if surface is not None else F.coalesce(F.split(F.try_element_at(known, symbol), "\0"), F.array(symbol))
    return F.concat(F.array_join(F.slice(found, 1, 4), " "), F.lit(" where denotes represents is defined as called corresponds to"))


def relation_query(a: Column, b: Column) -> Column:
    """Text that looks for what ties two formulas together."""
    return F.concat(F.lit("Eq "), a, F.lit(" Eq "), b, F.lit(" using substituting inserting follows from derived from yields equivalent special case"))


def matching(chunk_type: str | list[str] | None = None, section_id: str | None = None, eq_nums: list[str] | None = None) -> Column:
    """Condition on passages: of one of the types, in the section, near any of the formulas; all that are given."""
    out = F.lit(True)
    if chunk_type is not None:
        out = out & F.col("chunk_type").isin([chunk_type] if isinstance(chunk_type, str) else list(chunk_type))
    if section_id is not None:
        out = out & (F.col("section_id") == section_id)
    if eq_nums:  # no numbers ask for nothing
        out = out & F.arrays_overlap("eq_nums", F.array(*[F.lit(n) for n in eq_nums]))
    return out


def bm25(queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text", where: Column | None = None) -> DataFrame:
    """(qid, id, score, matched): BM25+ of each query and document that share a term.

    `where` filters candidates on the columns of docs; document counts and lengths stay
    those of the whole corpus.  Only the queries' terms leave the documents.  Null texts on either
    side share no term; documents without an id count, but are no hits.
    """
    q = query_terms(queries, query_id, query_text)
    posts = postings(docs, wanted=q)
    df = term_df(posts)
    if where is not None:
        posts = posts.join(docs.where(where).select(F.col("doc_id").alias("id")), "id", "left_semi")
    stats = corpus_stats(docs)  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))
    part = F.col("qtf") * idf * (F.col("tf") * (K1 + 1) / norm + DELTA)
    weighed = q.join(df, "term").crossJoin(F.broadcast(stats))
    return posts.join(weighed, "term").groupBy("qid", "id").agg(F.sum(part).alias("score"), F.collect_set("term").alias("matched"))


def top_k(scores: DataFrame, k: int, by: str = "score", ties: str = "id") -> DataFrame:
    """Rows ranked 1..k of each query: rounded score, then the smaller id."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round(by, 6)), ties))
    return scores.where(F.col(by) > 0).withColumn("rank", rank).where(F.col("rank") <= k)


def tfidf(queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(qid, id, score): cosine of sublinear TF-IDF vectors with smoothed idf."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    posts = postings(docs)
    idf = term_df(posts).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    unit = lambda rows, key, tf: rows.join(idf, "term").withColumn("w", (1 + F.log(F.col(tf))) * F.col("idf"))
    d = unit(posts, "id", "tf")
    length = d.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    q = unit(query_terms(queries, query_id, query_text), "qid", "qtf")
    qlen = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qlen"))
    dot = d.select("id", "term", "w").join(q.select("qid", "term", F.col("w").alias("qw")), "term").groupBy("qid", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dot.join(length, "id").join(qlen, "qid").select("qid", "id", (F.col("dot") / (F.col("len") * F.col("qlen"))).alias("score"))


def retrieve_text(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, text): the texts of a query's hits in rank order, joined by a blank."""
    t = hits.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return t.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("text"))


def rerank(hits: DataFrame, vectors: DataFrame, query_vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """hits with cosine and new_rank, from supplied vectors (id, vec) and (qid, vec)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    j = hits.join(vectors.select("id", F.col(vec).alias("dv")), "id").join(query_vectors.select("qid", F.col(vec).alias("qv")), "qid")
    j = j.withColumn("cosine", dot(F.col("dv"), F.col("qv")) / F.sqrt(dot(F.col("dv"), F.col("dv")) * dot(F.col("qv"), F.col("qv"))))
    return j.drop("dv", "qv").withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("cosine", 6)), "rank")))


def paper_postings(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(id, chunk_ord, term, tf, dl, n, avgdl, df) of passages (id, chunk_ord, text); counts are those of the paper.

    With `asked` (id, terms), an array of terms a paper, only those terms are rows; all passages count.
    """
    paper = Window.partitionBy("id")
    tok = chunks.select("id", "chunk_ord", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    if asked is not None:  # the one shuffle; what follows stays within the papers
        tok = tok.join(asked.select("id", "terms"), "id")
    tok = tok.withColumns({"n": F.count(F.lit(1)).over(paper), "avgdl": F.avg("dl").over(paper)})
    if asked is not None:
        found = tok.select("id", "chunk_ord", "t", "dl", "n", "avgdl", F.explode(F.array_intersect("terms", "t")).alias("term"))
        posts = found.select("id", "chunk_ord", "term", (F.size("t") - F.size(F.array_remove("t", F.col("term")))).alias("tf"), "dl", "n", "avgdl")
    else:
        posts = tok.select("id", "chunk_ord", "dl", "n", "avgdl", F.explode("t").alias("term")).groupBy("id", "chunk_ord", "term").agg(F.count(F.lit(1)).alias("tf"), *[F.first(c).alias(c) for c in ("dl", "n", "avgdl")])
    return posts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("id", "term")))


def search_papers(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, qid, rank, chunk_ord, score): the k best passages of each query's own paper, all queries in one plan."""
    terms = queries.select("id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("id").agg(F.collect_set("term").alias("terms"))
    return within_papers(paper_postings(chunks, terms), queries, k)


def within_papers(posts: DataFrame, queries: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """(id, qid, rank, chunk_ord, score): the k best passages of a query's own paper.

    `posts` is as paper_postings gives it, `queries` (id, qid, text).  Ties go to the smaller chunk_ord.
    `only` (id, chunk_ord), such as passages filtered by `matching`, limits the candidates, not the counts.
    """
    q = queries.select("id", "qid", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("id", "qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1.0)))
    if only is not None:
        posts = posts.join(only.select("id", "chunk_ord"), ["id", "chunk_ord"], "left_semi")
    score = q.join(posts, ["id", "term"]).groupBy("id", "qid", "chunk_ord").agg(F.sum(F.col("qtf") * idf * (F.col("tf") * (K1 + 1) / norm + DELTA)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("id", "qid").orderBy(F.desc(F.round("score", 6)), "chunk_ord"))
    return score.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
