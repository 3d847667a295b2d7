"""Tables that are replaced as a whole: written beside the old version, then published.

A version is a folder of tables. It counts once its mark has been put into `published`; readers take the highest one. A writer that
fails leaves the version before as it was, and a new writer never reads files that it overwrites. Writers of one
path must take turns; of two that publish the same number the second fails.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import text as T
from sondage.sources.stored import drop, stored


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, rising."""
    files, where = _folder(spark, f"{path}/published")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n) for n in names if re.fullmatch(r"\d+", n))


def read_version(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the highest version; an empty one before the first."""
    versions = published(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{versions[-1]}/{name}") if versions else spark.createDataFrame([], schema)


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], *, keep: int = 2) -> int:
    """Writes all tables as the next version, publishes it, and drops versions before the last `keep`."""
    versions = published(spark, path)
    number = versions[-1] + 1 if versions else 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{number}/{name}")  # what a failed writer left of this number goes
    files, mark = _folder(spark, f"{path}/published/{number}")
    files.create(mark, False).close()
    for old in versions[: max(0, len(versions) + 1 - keep)]:
        for name in (f"{path}/published/{old}", f"{path}/{old}"):
            where = _folder(spark, name)[1]
            files.delete(where, True)
    return number


ANSWERS = "pid string, item_id string, round string, answer string, raw string"
REJECTS = "pid string, item_id string, round string, raw string, reason string"
_LINE = "pid string, item_id string, round string, completion string, _corrupt string"
_KEY = ["pid", "item_id", "round"]


def parsed_lines(lines: DataFrame, bank: DataFrame) -> DataFrame:
    """(pid, item_id, round, position, raw, answer, reason) of lines (line, position): blank ones are none, a line that is no JSON has no key.

    `bank` has item_id and kind. A missing round is `main`; `raw` is the completion, or the first 200 characters of a line that is no JSON.
    """
    record = F.from_json("line", _LINE, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(T.stripped(F.col("line")) != "").select("line", "position", record.alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    keyed = rows.select(
        "position",
        broken.alias("broken"),
        *[F.when(~broken, F.col(f"r.{k}")).alias(k) for k in ("pid", "item_id")],
        F.when(~broken, F.coalesce("r.round", F.lit("main"))).alias("round"),
        F.when(broken, F.substring("line", 1, 200)).otherwise(F.coalesce("r.completion", F.lit(""))).alias("raw"),
    )
    known = keyed.join(bank.select("item_id", "kind"), "item_id", "left").withColumn("got", T.normalize_answer(F.col("raw"), F.col("kind")))
    reason = F.when(F.col("broken"), "not JSON").when(F.col("kind").isNull(), "item not in bank").otherwise(F.col("got.reason"))
    return known.select(*_KEY, "position", "raw", F.when(reason.isNull(), F.col("got.answer")).alias("answer"), reason.alias("reason"))


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join by key in which nulls are equal."""
    on = F.lit(True)
    for k in _KEY:
        on = on & left[k].eqNullSafe(right[k])
    return left.join(right, on, how)


def ingest(spark: SparkSession, path: str, lines: DataFrame, bank: DataFrame) -> dict[str, int]:
    """Parses a batch of completions into the stored answers and rejects; returns kept, rejected, duplicates and outstanding.

    The first answer of a key counts, in this batch and over all; a line whose key is answered before it is a duplicate and neither kept nor rejected.
    Rejects hold what is still to be asked: the last reject of each key without an answer. A batch that changes nothing publishes nothing.
    """
    answers, rejects = read_version(spark, path, "answers", ANSWERS), read_version(spark, path, "rejects", REJECTS)
    parsed = stored(parsed_lines(lines, bank), "parsed")  # four results come from it
    rows = _same(parsed, answers.select(*_KEY).distinct().withColumns({k: F.col(k) for k in _KEY}), "left_anti")
    total = lines.where(T.stripped(F.col("line")) != "").count()
    first = rows.where("answer IS NOT NULL").groupBy(*_KEY).agg(F.min("position").alias("first"), F.min_by(F.struct("answer", "raw"), "position").alias("a"))
    new = first.select(*_KEY, "a.answer", "a.raw")
    open_ = rows.where("answer IS NULL").alias("r")
    late = first.select(*[F.col(k).alias(f"__{k}") for k in _KEY], "first")
    on = F.col("first") < F.col("position")
    for k in _KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    refused = open_.join(late, on, "left_anti")
    last = refused.groupBy(*_KEY).agg(F.max_by(F.struct("raw", "reason"), "position").alias("a")).select(*_KEY, "a.raw", "a.reason")
    kept, rejected = new.count(), refused.count()
    outstanding = last.unionByName(_same(rejects, last.select(*_KEY), "left_anti"))
    outstanding = _same(outstanding, new.select(*_KEY), "left_anti")
    if kept or rejected:
        commit(spark, path, {"answers": answers.unionByName(new), "rejects": outstanding})
    drop(parsed)
    return {"kept": kept, "rejected": rejected, "duplicates": total - kept - rejected, "outstanding": read_version(spark, path, "rejects", REJECTS).count()}
