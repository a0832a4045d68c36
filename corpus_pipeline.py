"""A training corpus from raw documents: quality filter, line dedup, near-duplicate removal, redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. run() writes
each stage's result as Parquet in the shared checkpoint folder and reads it again for the next, so a lost executor costs the
stage it was in and nothing before it; what a stage has read is deleted once its own result is written, and the last
stage's input stays for the result to read.

Stages take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of any name. Rows
repeated with one id go through quality and pii as they are; of equal and near lines the earliest stays, so line_dedup
drops the lines of all but one of them; near_duplicates takes rows of one id for one document.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm.common import ensure_checkpoint_dir
from revlake.llm.jaccard_join import jaccard_components
from revlake.llm.line_dedup import dedup_lines
from revlake.llm.packing import pack_documents
from revlake.llm.pii import fit_pii, redact_pii
from revlake.llm.quality import fit_quality, keep_quality


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents and keeps those whose score is at least 0.7.

    A null text scores as an empty one. Equal texts have equal scores, so ties and repeated rows stay or go together. Without labels of
    both classes every score is the prior. An empty table stays empty.
    """
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops equal and near lines but the earliest; a document whose every line was dropped goes.

    A null text stays null, an empty one empty: they have no lines to drop. Of lines equal in id and place (repeated rows) one row's stay. An
    empty table stays empty.
    """
    found = dedup_lines(docs).where(~((F.size("dropped") > 0) & (F.size("dropped") == F.col("n_lines"))) | F.col("dropped").isNull())
    return _measured(found.select(F.col("row").withField("text", F.col("deduped_text")).alias("row")).select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard similarity the one with the smallest id stays.

    Documents without words and null texts link with nothing and stay, as do null ids; all rows of an id that stays, stay. An empty table
    stays empty.
    """
    others = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets. Null and empty texts and repeated rows stay as they are; an empty table stays empty."""
    return _measured(redact_pii(docs, fit_pii(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096. A null text has the end id alone; repeated rows are packed each; no documents, no pieces."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]

#: The classifier's fit, the labelers' EM and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if read:
                _delete(spark, read)
            read = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
