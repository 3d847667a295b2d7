"""Operator 5, language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of the lower-cased letters of a whole text, weighted by tf-idf: a
gram's share of the text times its inverse document frequency. The weights are trained with
follow-the-regularised-leader and an elastic-net penalty, in parallel: every epoch each shard of the
sample goes on from the broadcast state and the shards' states are averaged. A temperature, chosen on
sample rows that training leaves out, calibrates the probabilities.

The sample is bounded by `rows_a_language` for each language, drawn by a hash of text and id over all
labelled rows; whole texts are used. Scoring covers every row and every text whole.

Defined results: a null text, or one without letters, is `und` with score 0; without labelled rows
everything is `und`; of equal probabilities the first language in alphabetical order wins; repeated rows
get equal results; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

ORDERS = 3
BITS = 16
ROWS_A_LANGUAGE = 1200
SHARDS, EPOCHS = 4, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
SCALE = 30.0
UNKNOWN = "und"
_BATCH_CHARS = 400_000
_SIZE = ORDERS << BITS
_TEMPERATURES = np.geomspace(0.05, 5.0, 41)


@cache
def letter_table() -> np.ndarray:
    """Whether each code point of all planes is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def _codes(text: str, letters: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters[codes], codes, 32).astype(np.uint32)


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of the 1-grams, 2-grams and 3-grams, one array for each order."""
    h = codes * np.uint32(2654435761)
    for order in range(ORDERS):
        if order:
            h = (h[:-1] * np.uint32(2246822519)) ^ (codes[order:] * np.uint32(2654435761))
            h ^= h >> np.uint32(15)
        yield (h >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(order << BITS)


def text_features(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and each one's share of its order's grams."""
    codes = np.concatenate([np.full(2, 32, np.uint32), _codes(text, letters), np.full(2, 32, np.uint32)])
    ids, shares = [], []
    for g in grams(codes):
        f, n = np.unique(g, return_counts=True)
        ids.append(f)
        shares.append(n / len(g))
    return np.concatenate(ids), np.concatenate(shares)


def ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights: zero where the sum of gradients stays under L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_step(z: np.ndarray, n: np.ndarray, ids: np.ndarray, x: np.ndarray, label: int) -> None:
    """One example: z and n (features x languages) change in place, in the rows `ids`."""
    w = ftrl_weights(z[ids], n[ids])
    logits = x @ w
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1.0
    g = x[:, None] * p
    n_new = n[ids] + g * g
    z[ids] += g - (np.sqrt(n_new) - np.sqrt(n[ids])) / ALPHA * w
    n[ids] = n_new


@dataclass
class LanguageId:
    languages: list[str]
    weights: np.ndarray  # float32, features x languages; idf and SCALE are multiplied in
    temperature: float


def _sample(labelled: DataFrame, rows_a_language: int) -> DataFrame:
    """At most about `rows_a_language` rows of each language, by hash, and all of a rare one."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("text", "id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(F.broadcast(counts), "lang").where(draw < rows_a_language / F.col("n")).select("lang", "text", F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(SHARDS + 1)).cast("int").alias("shard"))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_a_language: int = ROWS_A_LANGUAGE) -> LanguageId:
    """Fit on the rows of `labelled` with a language. Shard SHARDS of the sample only calibrates."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL")
    sample = written(_sample(rows, rows_a_language), "language-sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    n_lang = len(languages)
    if not n_lang:
        return LanguageId([], np.zeros((_SIZE, 0), np.float32), 1.0)

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df = letter_table(), np.zeros(_SIZE, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df[text_features(text, letters)[0]] += 1
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(df[f])], ["f", "df"])

    found = sample.mapInArrow(document_frequency, "f int, df long").groupBy("f").agg(F.sum("df").alias("df")).toArrow()  # _SIZE rows at most
    idf = np.zeros(_SIZE)
    idf[found.column("f").to_numpy()] = np.log((1 + sample.count()) / (1 + found.column("df").to_numpy())) + 1

    number = {lang: i for i, lang in enumerate(languages)}
    state = (np.zeros((_SIZE, n_lang)), np.zeros((_SIZE, n_lang)))
    training = sample.where(F.col("shard") < SHARDS)

    def epoch(shared) -> DataFrame:
        def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            letters, (z, n, idf) = letter_table(), shared.value
            z, n = z.copy(), n.copy()
            table = pa.Table.from_batches(groups).sort_by([("text", "ascending"), ("lang", "ascending")])
            order = np.random.default_rng(0).permutation(len(table))
            texts, langs = table.column("text").to_pylist(), table.column("lang").to_pylist()
            for i in order.tolist():
                ids, share = text_features(texts[i], letters)
                ftrl_step(z, n, ids, SCALE * share * idf[ids], number[langs[i]])
            f = np.flatnonzero(n.any(axis=1))
            blob = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a[f].ravel()), n_lang).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), blob(z), blob(n)], ["f", "z", "n"])

        return training.groupBy("shard").applyInArrow(run, "f int, z array<double>, n array<double>")

    n_shards = max(training.select("shard").distinct().count(), 1)
    for _ in range(EPOCHS):
        shared = spark.sparkContext.broadcast((*state, idf))
        sums = [np.zeros_like(s) for s in state]
        table = epoch(shared).toArrow()  # SHARDS times the features that occur
        f = table.column("f").to_numpy()
        for total, name in zip(sums, ("z", "n"), strict=True):
            np.add.at(total, f, table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, n_lang))
        state = tuple(s / n_shards for s in sums)
        shared.unpersist()

    weights = (ftrl_weights(*state) * idf[:, None] * SCALE).astype(np.float32)
    model = LanguageId(languages, weights, 1.0)
    held = sample.where(F.col("shard") == SHARDS).select("lang", "text")
    logits = _logits(held, model, "lang", "string").where("has_letters").toArrow()  # bounded by the sample
    if len(logits):
        raw = np.array(logits.column("logits").to_pylist())
        truth = np.array([number[x] for x in logits.column("lang").to_pylist()])
        model.temperature = min(_TEMPERATURES, key=lambda t: _loss(raw / t, truth))
    return model


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(truth)), truth]).mean())


def _logits(docs: DataFrame, model: LanguageId, key: str, key_type: str) -> DataFrame:
    """(key, has_letters, logits) of every row's whole `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    n_lang = len(model.languages)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, weights, gap = letter_table(), shared.value, np.full(2, 32, np.uint32)
        columns = [np.ascontiguousarray(weights[:, i]) for i in range(n_lang)]
        for batch in batches:
            texts, parts, has, logits = batch.column("text").to_pylist(), [], [], []
            held = 0

            def flush() -> None:
                if not parts:
                    return
                ends = np.cumsum([len(p) for p in parts])
                codes = np.concatenate([*parts, gap])
                starts = ends - np.array([len(p) for p in parts])
                out = np.zeros((len(parts), n_lang))
                for order, g in enumerate(grams(codes)):
                    # a text's grams: those that begin in it, in the two blanks before it and after it
                    sizes = ends - starts + 2 - order
                    for i in range(n_lang):
                        sums = np.concatenate([[0.0], np.cumsum(columns[i][g], dtype=np.float64)])
                        out[:, i] += (sums[starts + sizes] - sums[starts]) / sizes
                logits.append(out)
                parts.clear()

            for text in texts:
                codes = _codes(text or "", letters)
                has.append(bool((codes != 32).any()))
                parts.append(np.concatenate([gap, codes]))
                held += len(codes) + 2
                if held > _BATCH_CHARS:
                    flush()
                    held = 0
            flush()
            flat = np.concatenate(logits).ravel() if logits else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n_lang), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(has), lists], [key, "has_letters", "logits"])

    return docs.mapInArrow(scored, f"{key} {key_type}, has_letters boolean, logits array<double>")


def predict(docs: DataFrame, model: LanguageId, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the calibrated probability) of every row."""
    if not model.languages:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    id_type = dict(docs.dtypes)[id_col]
    raw = _logits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "doc_id", id_type)
    top = F.array_max("logits")
    share = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x - top) / model.temperature))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.element_at(names, F.array_position("logits", top).cast("int"))
    return raw.select(
        "doc_id",
        F.when(F.col("has_letters"), best).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("has_letters"), 1 / share).otherwise(0.0).alias("score"),
    )
