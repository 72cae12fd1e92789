"""A corpus cleaned and packed: toxicity, near duplicates, benchmark passages, personal data, sequences.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept as it was written to Parquet, and works on all of it. All
but the last return the columns of docs, whatever they are (doc_id and text are needed).

Null and empty texts pass the filters (they are not toxic, link with nothing, hold no benchmark item and no personal data)
and become sequences of an end id; copies of a row are one group of near duplicates; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import pii
from rastermill.llm.decontamination import without_contaminated
from rastermill.llm.ngram_join import ngram_jaccard_join
from rastermill.llm.packing import pack_sequences
from rastermill.llm.shared import free_name, saved, stable_rows
from rastermill.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal model accepts."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links by 0.8 or more on five-word shingles: the smallest doc_id."""
    row = free_name(docs, "row_id")
    rows = stable_rows(docs, row)
    kept = ngram_jaccard_join(rows, n=5, threshold=80, row_col=row).where("kept").select(F.col("row_id").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each span of personal data replaced by its kind; n_chars, if there, is counted anew."""
    null = free_name(docs, "no_text")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others, F.col("text").isNull().alias(null)).alias("row"), F.col("text").alias("words"))
    found = pii.personal_data(rows, id_col="row", text_col="words").withColumn("masked", F.when(~F.col("id")[null], pii.masked()))
    new = {"text": F.col("masked"), "n_chars": F.coalesce(F.char_length("masked"), F.col("id")["n_chars"]).cast("long") if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col("id")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as best-fit finds."""
    placed = pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]
#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
