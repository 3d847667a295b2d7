"""Operator 1, token counts through a digest cache.

Each text is normalised and digested on the JVM, and the digests are joined to the stored
counts of one tokenizer version. Only distinct digests without a stored count are encoded; their
counts are appended to the cache, which later runs share.

Defined results: a null text counts as the empty text; an empty table gives an empty result;
repeated rows each keep their row; extra columns are left alone and may have any name, as the
operator only takes `id_col` and `text_col` along. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
_BATCH_CHARS = 1 << 22


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file and its library: `sentencepiece` for .model, `tokenizers` for .json."""

    path: str

    def version(self) -> str:
        """Digest of the library's name and the file: counts of another version are never reused."""
        kind = os.path.splitext(self.path)[1]
        with open(self.path, "rb") as file:
            return hashlib.sha256(kind.encode() + file.read()).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        if self.path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        library = Library.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]


def null_as_empty(text: Column) -> Column:
    """The normalisation that leaves every count as the library gives it."""
    return F.coalesce(text, F.lit(""))


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version, one row for each digest; None before the first append."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    mine = cache.where(F.col("tokenizer") == version)
    # two writers may have appended the same digest; both have the same count
    return mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.counter()
        for batch in batches:
            texts, out, group, size = batch.column("text").to_pylist(), [], [], 0
            for text in texts:
                group.append(text)
                size += len(text)
                if size > _BATCH_CHARS:
                    out += count(group)
                    group, size = [], 0
            out += count(group) if group else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(counts, "digest binary, n_tokens long")


def count_tokens(
    docs: DataFrame,
    tokenizer: Tokenizer,
    cache_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    normalise: Callable[[Column], Column] = null_as_empty,
) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_tokens, over_limit (n_tokens > limit), digest.

    `normalise` must keep counts as they are. Misses are appended to `cache_path` when this is
    called. Copies cost one encoding: the distinct step combines them on the map side, so a
    hot text reaches the shuffle once from each map task.
    """
    spark, version = docs.sparkSession, tokenizer.version()
    text = normalise(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    known = stored_counts(spark, cache_path, version)
    missing = keyed.select("digest", "text")
    if known is not None:
        missing = missing.join(known.select("digest"), "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.max("text").alias("text"))
    new = encode_misses(distinct, tokenizer).withColumn("tokenizer", F.lit(version))
    new.write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    slim = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    counts = stored_counts(spark, cache_path, version)
    if counts is None:
        counts = spark.createDataFrame([], "digest binary, n_tokens long")
    return slim.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("digest").alias("digest")
    )
