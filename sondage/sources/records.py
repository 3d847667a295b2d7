"""JSON lines in and out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; none where nothing is there. Lines that are no JSON are in `_corrupt`, if the schema has it."""
    try:
        return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
