"""Sources of papers: id lists and the download cache; and the JSON exports of the first two stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eqloom.functions import text as T


def paper_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, paper_id): ids of a text file, one a line, prefix dropped, each at its first place."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n", -1)).alias("ord", "line"))
    return numbered_papers(lines, F.col("line"), "ord").select("ord", "paper_id")


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, source, content): the HTML of each cached paper, else its PDF; empty files don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_{html,pdf}.*").load(folder).where("length > 0")
    name = r"([^/]+)_(html|pdf)\.[a-z]+$"
    files = files.select(F.regexp_extract("path", name, 1).alias("paper_id"), F.regexp_extract("path", name, 2).alias("source"), "content").where("paper_id <> ''")
    first = files.groupBy("paper_id").agg(F.min("source").alias("source"))  # html before pdf
    return files.join(first, ["paper_id", "source"]).select("paper_id", "source", "content")


def numbered_papers(rows: DataFrame, text: Column, order: str) -> DataFrame:
    """(paper_id, ord): paper ids from a column of text, prefix dropped, each at its first place; blanks are none."""
    ids = rows.select(F.regexp_replace(T.strip(text), "(?i)^arxiv:", "").alias("paper_id"), F.col(order).cast("long").alias("ord")).where("paper_id <> ''")
    return ids.groupBy("paper_id").agg(F.min("ord").alias("ord"))


def to_document(equations: DataFrame) -> DataFrame:
    """(id, json): the formulas of each paper as one JSON object, keyed by number, private columns dropped."""
    c = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    public = equations.select("id", "eq_ord", "eq_num", c("equation"), c("source"), c("latex_method"), F.coalesce("before", F.lit("")).alias("context_before"), F.coalesce("after", F.lit("")).alias("context_after"))
    entry = F.struct("eq_ord", "eq_num", F.struct("equation", "source", "latex_method", "context_before", "context_after").alias("entry"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["eq_num"].alias("key"), x["entry"].alias("value")))
    return public.groupBy("id").agg(F.to_json(F.map_from_entries(ordered)).alias("json"))


def fragments_document(papers: DataFrame, fragments: DataFrame) -> DataFrame:
    """(id, json): the source of each paper (id, source) and its fragments in order, an empty list where it has none."""
    cols = [c for c in fragments.columns if c not in ("id", "table_index")]
    lists = fragments.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("table_index", *cols))).alias("fragments"))
    out = papers.join(lists, "id", "left")
    return out.select("id", F.to_json(F.struct("source", F.coalesce("fragments", F.array().cast(lists.schema["fragments"].dataType)).alias("fragments")), {"ignoreNullFields": "false"}).alias("json"))


def export(documents: DataFrame, path: str) -> None:
    """Write (id, json) as lines {id: json} in UTF-8, a file a task; read_document reads them back."""
    key = F.to_json(F.struct(F.col("id").cast("string").alias("k")))
    line = F.concat(F.lit("{"), F.regexp_extract(key, r"(?s)^\{\"k\":(.*)\}$", 1), F.lit(":"), "json", F.lit("}"))
    documents.select(line.alias("value")).write.mode("overwrite").text(path)
