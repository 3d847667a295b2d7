"""The answer-log, choice and trajectory views of the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import answers as A


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an answer: who, which item (day of the month), what, a code 0-4, and the second of the day."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("pid"),
        F.dayofmonth("ts").alias("item_id"),
        F.when(F.dayofmonth("ts") % 3 == 0, "binary").otherwise("likert5").alias("kind"),
        F.col("event_type").alias("answer"),
        "value",
        F.least(F.lit(4), F.floor(F.col("value") / 25)).cast("int").alias("code"),
        seconds.cast("int").alias("second"),
    )


def main_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_wins(log(spark, sf_dir), ["pid", "item_id"], ["seq"])


def retest_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of the cells with more than one."""
    rows = log(spark, sf_dir)
    again = A.duplicated(rows, ["pid", "item_id"])
    return A.last_wins(rows, ["pid", "item_id"], ["seq"]).join(again, ["pid", "item_id"], "left_semi")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip for each person and day: route, departure and travel minutes."""
    return main_round(spark, sf_dir).select(
        "pid",
        F.col("item_id").alias("day"),
        F.when(F.col("answer").isin("click", "view"), "A").otherwise("B").alias("route"),
        (F.col("second") / 60.0).alias("dep"),
        (F.col("value") / 10.0).alias("travel"),
    )


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as the options of a choice set."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10000).alias("cost")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels with the smoothed rate of each document's language and source as the prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"))
    marked = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("t")).join(docs, "doc_id")
    rate = marked.groupBy("lang", "source").agg(((F.sum("t") + 0.5) / (F.count("*") + 1)).alias("p"))
    return marked.join(rate, ["lang", "source"]).select(F.col("doc_id").alias("cell"), "lang", "source", "p", "t")


SQL = """WITH ev AS (
  SELECT event_id AS seq, user_id AS pid, CAST(day(ts) AS INTEGER) AS item_id,
         CASE WHEN day(ts) % 3 = 0 THEN 'binary' ELSE 'likert5' END AS kind, event_type AS answer, value,
         CAST(least(4, floor(value / 25)) AS INTEGER) AS code,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS second
  FROM events),
main AS (
  SELECT pid, item_id, arg_min(kind, seq) AS kind, arg_min(answer, seq) AS answer, arg_min(value, seq) AS value,
         arg_min(code, seq) AS code, arg_min(second, seq) AS second, min(seq) AS seq
  FROM ev GROUP BY pid, item_id),
retest AS (
  SELECT pid, item_id, arg_max(answer, seq) AS answer, arg_max(code, seq) AS code
  FROM ev GROUP BY pid, item_id HAVING count(*) > 1),
trips AS (
  SELECT pid, item_id AS day, CASE WHEN answer IN ('click', 'view') THEN 'A' ELSE 'B' END AS route,
         second / 60.0::DOUBLE AS dep, value / 10.0::DOUBLE AS travel FROM main),
options AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice * (1 - l_discount) / 10000 AS cost FROM lineitem),
marked AS (
  SELECT l.doc_id AS cell, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, CAST(l.quality AS DOUBLE) AS t
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL),
predictions AS (
  SELECT cell, lang, source, (sum(t) OVER w + 0.5) / (count(*) OVER w + 1) AS p, t FROM marked WINDOW w AS (PARTITION BY lang, source))
"""
