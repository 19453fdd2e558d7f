"""Formulas of papers as they arrive in the download cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eqloom.operators import documents as D
from eqloom.sources import html as H

FILES = "path string, modificationTime timestamp, length long, content binary"
NAME = r"([^/]+)_html\.html$"


def pages(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Stream of (id, html, paper_id) of the HTML files of a folder; empty files are skipped."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*_html.html").option("maxFilesPerTrigger", per_batch).load(folder)
    paper = F.regexp_extract("path", NAME, 1)
    return files.where("length > 0").select(F.xxhash64(paper).alias("id"), F.expr("decode(content, 'UTF-8')").alias("html"), paper.alias("paper_id")).where("paper_id <> ''")


def collect_formulas(spark: SparkSession, folder: str, out: str, checkpoint: str, cap: int = 7) -> StreamingQuery:
    """Write the formulas of every new paper under out/batch=N and stop when no file is left.

    A batch that is run again after a failure overwrites its own folder, so no row comes twice.
    The choice of first formulas needs a whole page, which one file is; so each batch is exact.
    """

    def write(batch: DataFrame, n: int) -> None:
        eqs = D.equations(H.nodes(batch, "id", "html", {"equation"}), cap)
        names = batch.select("id", "paper_id")
        eqs.join(names, "id").select("paper_id", "eq_num", "eq_ord", "equation", "latex_method", "before", "after").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return pages(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
