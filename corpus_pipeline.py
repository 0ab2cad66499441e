"""Corpus pipeline: quality, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet under the shared folder and hands the reread table to the next stage.  All but the
last return the columns of documents.

Cases.  Null and empty texts, and texts of white space, are rejected by the quality stage.
Rows are told by doc_id and text, so a null doc_id, and an identifier that comes with
several texts, pass like others; of rows alike in both, and of equal texts, one passes the
exact stage, and later stages see each text once.  Ties go to the largest doc_id in the exact
stage, to the smallest in the near one.  Very long texts pass whole.  Extra columns stay until
packing, whatever their names.  An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import common, exact_dedup, mixing, near_dedup, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest doc_id."""
    groups = common.materialise(exact_dedup.exact_groups(docs, keep="largest").select("doc_id", "kept", "text_sha256"), "exact-groups")
    # An id may be repeated with other texts: the row to keep is told by id and text.
    kept_id, kept_sha = common.free_names(docs, "_kept_id", "_kept_sha")
    kept = groups.where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    sha = F.sha2(common.text_bytes(), 256)
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (sha == F.col(kept_sha))
    one = docs.join(kept, here, "left_semi")
    return one.dropDuplicates(["doc_id", "text"]) if _repeats(groups) else one


def _repeats(groups: DataFrame) -> bool:
    """Whether some identifier comes twice with one text (such rows are told apart by nothing)."""
    return not groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: documents that are not taken go, repeats come again.

    A document without words has nothing to give and goes.
    """
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece with its tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: EM, alignment and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.freed(spark):  # a stage's own tables go once its output is written
            docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
    return docs
