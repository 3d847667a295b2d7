"""Item banks, answer logs and recorded distributions from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import read_records

KINDS = ("likert5", "binary")
_ITEM = "item_id string, type string, text string, options array<struct<value:string>>"


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, kind, text, options) of a bank: one JSON document, a list of items or an object with such a list as `items`.

    An item of another kind than KINDS fails the query that reads it.
    """
    fields = ", ".join(f"{f.split()[0]}:{f.split(maxsplit=1)[1]}" for f in ("item_id string", "type string", "text string", "options array<struct<value:string>>"))
    raw = spark.read.schema(f"{_ITEM}, items array<struct<{fields.replace(', ', ',')}>>").option("multiLine", True).json(path)
    single = F.struct("item_id", "type", "text", "options")
    items = raw.select(F.explode(F.coalesce("items", F.array(single))).alias("i")).select("i.*")
    kind = F.when(F.col("type").isin(*KINDS), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown type of item "), F.coalesce("item_id", F.lit("null")))))
    return items.select("item_id", kind.alias("kind"), "text", F.transform("options", lambda o: o["value"]).alias("options"))


def position() -> Column:
    """A row's place in its file: rows compare by it as they stand there, whatever the splits."""
    return F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))


def read_answer_log(spark: SparkSession, path: str, *, default_round: str | None = "main") -> DataFrame:
    """(pid, item_id, round, answer, logprobs, position) of a log of JSON lines. Blank lines are none; no other field is read.

    A null round becomes `default_round`; with None it stays as it was read, and what it means is up to the operators.
    """
    schema = "pid string, item_id string, round string, answer string, logprobs map<string,double>"
    rows = read_records(spark, path, schema)
    at = position() if rows.inputFiles() else F.struct(F.lit("").alias("file_name"), F.lit(0).cast("long").alias("file_block_start"), F.lit(0).cast("long").alias("row"))
    return rows.select("pid", "item_id", F.coalesce("round", F.lit(default_round).cast("string")).alias("round"), "answer", "logprobs", at.alias("position"))


def recorded_distributions(log: DataFrame, items: list[str] | None = None, rounds: list[str] | None = None) -> DataFrame:
    """(pid, item_id, round, logprobs): the last log-value map of each cell, of the given items and rounds (all, if None); empty maps do not count.

    The filters reach the scan as pushed predicates.
    """
    rows = log.where(F.size(F.coalesce("logprobs", F.create_map().cast("map<string,double>"))) > 0)
    for column, wanted in (("item_id", items), ("round", rounds)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows.groupBy("pid", "item_id", "round").agg(F.max_by("logprobs", "position").alias("logprobs"))  # maps do not compare
