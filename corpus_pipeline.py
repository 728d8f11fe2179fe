"""A cleaning and packing pipeline over documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionlens.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from sectionlens.llm._shared import work_dir, written
from sectionlens.llm.queries import BYTE_BPE, documents


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the count of the new text's characters."""
    counted = F.char_length("text").cast("long").alias("n_chars")
    return rows.select(*(counted if c == "n_chars" else F.col(c) for c in columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (op 4) keep."""
    return quality_rules.quality(docs, carry=tuple(docs.columns)).where("kept").select("carried.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (op 2), that of least id."""
    return ngram_join.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier 100-byte string (op 6).

    A character of which a byte goes, goes; a document of which nothing but white space is
    left, goes.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.dedup(docs, with_text=True, carry=others)
    rows = cut.select("doc_id", F.col("kept_text").alias("text"), *(F.col("carried")[c].alias(c) for c in others))
    return _with_text(rows.where(F.btrim("text", F.lit(quality_rules.SPACE)) != ""), docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret (op 10) replaced by a mark."""
    found = secret_scan.scan(docs, carry=tuple(docs.columns))
    text = secret_scan.redact(F.col("carried.text"), F.col("found")).alias("text")
    return _with_text(found.select(*(text if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of at most 2048 tokens (op 3)."""
    return packing.pack_documents(docs, BYTE_BPE, with_ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", hide_secrets),
    ("packing", pack),
]
#: SQL can't express the last stage's tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are a written table."""
    folder = work_dir(spark, "pipeline")
    rows = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k + 1 < len(STAGES):
            rows = written(rows, f"{folder}/{k}")
    return rows
