"""The training-corpus pipeline: five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the
columns of documents. Rows are never matched by doc_id, which may repeat or be null: documents travel as one
struct, or under the name of a row that stays the same however often it is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import bpe, decontamination, jaccard_join, language_model, quality_classifier, quality_rules
from sondage.llm._common import written
from sondage.llm.bloom import build_bloom
from sondage.llm.registry import TOKENIZER_DIR, table

MIN_SCORE = 0.3
#: Near copies: sets of five-word shingles at a Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_THRESHOLD = 5, (80, 100)
#: Bounds of the filter that names the surplus: four bytes for each row, so far as the upper bound allows.
SURPLUS_BYTES = (1 << 16, 1 << 26)


def _carried(docs: DataFrame) -> DataFrame:
    """The whole document as the struct `__doc`, and its text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text"))


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge_documents(_carried(docs), keep=["__doc"]).where("kept").select("__doc.*")


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score MIN_SCORE or more. The model learns from all labelled documents of the corpus,
    as few rejected ones are left among those that arrive here."""
    corpus = table(spark, sf_dir, "documents").select("doc_id", "text").where(~language_model.is_fold("doc_id", 5, 0))
    learned = written(quality_classifier.with_features(corpus).drop("text"), "quality-features")
    model = quality_classifier.fit(learned, table(spark, sf_dir, "labels"))
    return quality_classifier.with_features(_carried(docs)).where(model.score() >= MIN_SCORE).select("__doc.*")


def _placed(docs: DataFrame) -> DataFrame:
    """`__doc` and `row`, a name of each row that stays the same: file and place where docs is a Parquet table, else a stored number."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns and docs.inputFiles():
        place = F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0")
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.concat_ws(":", "_metadata.file_path", place).alias("row"))
    return written(_carried(docs).select("__doc", F.monotonically_increasing_id().alias("row")), "numbered")


def _without(placed: DataFrame, surplus: DataFrame) -> DataFrame:
    """The rows of `placed` that `surplus` does not name.

    A filter of the names tells most rows that stay. Of the others, names are compared, and only those few that the filter took wrongly are
    joined to their documents, so that documents are not shuffled for a surplus that is too large to broadcast.
    """
    n_bytes, count = SURPLUS_BYTES[0], surplus.count()
    while n_bytes < min(SURPLUS_BYTES[1], 4 * count):
        n_bytes *= 2
    named = placed.sparkSession.sparkContext.broadcast(build_bloom(surplus.select(F.xxhash64("row").alias("h")), n_bytes))

    @F.pandas_udf("boolean")
    def may_be_named(h: pd.Series) -> pd.Series:
        return pd.Series(named.value.contains(h.to_numpy().view(np.uint64)))

    held = may_be_named(F.xxhash64("row"))
    wrong = written(placed.select("row").where(held).join(surplus, "row", "left_anti"), "not-surplus")
    return placed.where(~held).unionByName(placed.where(held).join(wrong, "row", "left_semi"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of linked ones."""
    placed = _placed(docs)
    groups = jaccard_join.join_documents(placed.select("row", "__doc.text"), id_col="row", size=NEAR_WORDS, threshold=NEAR_THRESHOLD)
    surplus = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("row")), "surplus")
    return _without(placed, surplus).select("__doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_documents(docs, f"{TOKENIZER_DIR}/byte_bpe_50k.json")


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None  # no SQL for the EM, the discriminant, or BPE; tests/llm/test_pipeline.py has a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
