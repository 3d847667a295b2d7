"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_KEPT_WORDS = 200_000
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="sondage-"))
        where = _OWN[0]
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/sondage/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path, schema = shared_path(spark, name), df.schema
    # once more for the step before, which Spark's listeners may still have held when it was let go
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    del df  # so that its shuffle files go as well
    # Spark removes shuffle files and broadcasts of finished steps when the driver collects garbage, which a large idle heap puts off
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a written table that nothing reads any more, so that the shared folder holds one state only."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/sondage/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def values(column: pa.Array, step: int = 256) -> Iterator:
    """The Python values of a column, a few rows at a time."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash. It forgets all words once it holds many, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the A-Z lower-cased words of a whole text, in order."""
        if not text:
            return np.empty(0, np.uint64)
        # bytes.split() without arguments splits at exactly \x20 and \x09-\x0D
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        if len(self) > _KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order-dependent 64-bit hash of pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = left * np.uint64(0x9E3779B97F4A7C15)
        h ^= (right + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h
