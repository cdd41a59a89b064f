"""Corpus pipeline: language ID, near-dedup, decontamination, secret scan, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All stages but the last return the columns of ``docs``.

Defined cases: an empty table goes through as an empty table; null texts have no
language and leave at the first stage; repeated rows are near copies, of which
one stays; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import common as C
from caseflow.llm import lang_cnn, secret_owners, simhash_blocks, winnow
from caseflow.llm.queries import packing_rows

#: Texts whose best language is less likely than this are rejected, as are texts without letters.
MIN_LANG_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the network can tell."""
    model = lang_cnn.train(docs.where(~C.held_out(F.col("doc_id"))))
    out = lang_cnn.identify(docs, model)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANG_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints: the one with the smallest id."""
    return simhash_blocks.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return winnow.drop_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its credentials replaced by a mark (``n_chars`` follows)."""
    out = secret_owners.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the packed sequences."""
    return packing_rows(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("secret_scan", secret_scan), ("packing", packing)]

#: The network and the 64-bit fingerprints are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
