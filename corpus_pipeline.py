"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqloom.llm import decontam, line_dedup, minhash, packing, toxicity
from eqloom.llm.common import materialize, unused


def _columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    """Only the columns of documents; the count of characters follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score 0.5 or more go; a text without words has the score of the bias, and stays unless most labels are toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    return toxicity.keep(docs, model, 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of a line of any length go, its earliest copy stays; documents all stay, null texts as they are."""
    return _columns(docs, line_dedup.dedup_lines(docs, exact_chars=1))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is none of ids (one column, null included)."""
    (gone,) = unused(docs.columns, "_gone")
    ids = ids.toDF(gone).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup on five-word shingles at a similarity of 0.8: the least doc_id of a group stays.

    Of rows that repeat id and text one stays.  A null doc_id is linked with nothing; null, empty and blank texts stay.
    """
    near = minhash.near_duplicates(docs, k=5, percent=80).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return _without(docs, near.where("not kept").select("doc_id")).dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go; null, empty and blank texts stay."""
    return _without(docs, decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: a row for each piece of a document in a training sequence, with its ids; a null text is empty, which is the closing id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", to_sequences)]

# Learned scores and tokenizer ids can't be had in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
