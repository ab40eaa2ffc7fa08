"""Pluggable model surfaces: embeddings, pair scores, generated text.

Each takes a factory that runs once in a worker process and returns the model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


def hash_embedding(text: str | None, width: int = 512) -> np.ndarray:
    """Deterministic unit vector of a text's words, for use without a model."""
    v = np.zeros(width)
    for i, w in enumerate(re.findall(r"\w+", (text or "").lower())):
        h = zlib.crc32(w.encode())
        v[h % width] += 1
        v[zlib.crc32(f"{h * 31 + i}".encode()) % width] += 0.5
    n = np.sqrt(v @ v)
    return (v / n if n > 1e-12 else v).astype(np.float32)


def embedding_udf(factory: Callable[[], Callable[[list[str]], np.ndarray]], width: int):
    """Scalar-iterator UDF ``text -> array<float>``; the width is checked."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            v = np.asarray(model([t or "" for t in s]), np.float32)
            if v.shape != (len(s), width):
                raise ValueError(f"expected vectors of width {width}, got {v.shape}")
            yield pd.Series(list(v))

    return embed


def hash_embedder(width: int = 512):
    return embedding_udf(lambda: lambda texts: np.stack([hash_embedding(t, width) for t in texts]) if texts else np.empty((0, width)), width)


def hash_embedding_of(width: int):
    return lambda texts: np.stack([hash_embedding(t, width) for t in texts])


def failing_on_length(n: int, width: int):
    """Stand-in for a remote model: it fails on texts whose length ``n`` divides."""

    def factory():
        def model(texts: list[str]) -> np.ndarray:
            if any(len(t) % n == 0 for t in texts):
                raise ConnectionError("no answer")
            return np.stack([hash_embedding(t, width) for t in texts])

        return model

    return factory


def for_retrieval(factory, prefix: str = "Represent this sentence for searching relevant passages: ", words: int = 512):
    """A model for questions: every text gets the prefix, and is cut to the model's window of ``words``."""

    def make():
        model = factory()
        return lambda texts: model([" ".join((prefix + t).split()[:words]) for t in texts])

    return make


def with_fallback(df: DataFrame, text: str, primary: Callable[[], Callable[[list[str]], np.ndarray]], backup: Callable[[], Callable[[list[str]], np.ndarray]], width: int, batch: int = 32) -> DataFrame:
    """Adds ``embedding`` and its ``source``: ``primary``, or ``fallback`` for texts that the first model fails on.

    A failing batch is tried text by text, so that one text doesn't take others with it.
    """
    schema = StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("source", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, spare = primary(), backup()

        def one(texts: list[str]) -> list[tuple[np.ndarray, str]]:
            try:
                v = np.asarray(model(texts), np.float32)
            except Exception:
                if len(texts) > 1:
                    return [x for t in texts for x in one([t])]
                return [(np.asarray(spare(texts), np.float32)[0], "fallback")]
            if v.shape != (len(texts), width):
                raise ValueError(f"expected vectors of width {width}, got {v.shape}")
            return [(x, "primary") for x in v]

        for b in batches:
            texts = [t or "" for t in b[text]]
            out = [x for lo in range(0, len(texts), batch) for x in one(texts[lo : lo + batch])]
            yield b.assign(embedding=[x.tolist() for x, _ in out], source=[s for _, s in out])

    return df.mapInPandas(run, schema)


def pair_scores(df: DataFrame, query: str, document: str, factory: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 16) -> DataFrame:
    """Adds ``pair_score``, computed in batches; a score that isn't finite fails the query."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in batches:
            out: list[float] = []
            for lo in range(0, len(q), batch):
                part = list(model(q.iloc[lo : lo + batch].tolist(), t.iloc[lo : lo + batch].tolist()))
                if len(part) != len(q.iloc[lo : lo + batch]) or not np.isfinite(part).all():
                    raise ValueError("the scorer must return one finite score for each pair")
                out += part
            yield pd.Series(out, dtype="float64")

    return df.withColumn("pair_score", score(F.coalesce(query, F.lit("")), F.coalesce(document, F.lit(""))))


def rerank(df: DataFrame, group: str, baseline: str, query: str, document: str, factory: Callable[[], Callable[[list[str], list[str]], list[float]]], pool: int = 40) -> DataFrame:
    """The first ``pool`` of each group by ``baseline`` rank, reordered by pair score, then baseline."""
    scored = pair_scores(df.where(F.col(baseline) <= pool), query, document, factory)
    w = Window.partitionBy(group).orderBy(F.col("pair_score").desc(), baseline)
    return scored.withColumn("reranked", F.row_number().over(w))


def generated(df: DataFrame, prompt: str, factory: Callable[[], Callable[[str], str]], attempts: int = 3) -> DataFrame:
    """Adds ``answer`` and ``error``; a failing prompt is tried again, then its error is kept."""
    schema = df.drop("answer", "error").schema
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            answers, errors = [], []
            for p in b[prompt]:
                for left in reversed(range(attempts)):
                    try:
                        answers.append(model(p))
                        errors.append(None)
                        break
                    except Exception as e:
                        if not left:
                            answers.append(None)
                            errors.append(type(e).__name__)
            yield b[names].assign(answer=answers, error=errors)

    return df.select(*names).mapInPandas(run, f"{schema.toDDL()}, answer string, error string")


def overlap_scorer() -> Callable[[list[str], list[str]], list[float]]:
    """Share of the query's words found in the document; a scorer without a model."""

    def score(queries: list[str], documents: list[str]) -> list[float]:
        out = []
        for q, d in zip(queries, documents):
            a, b = set(re.findall(r"\w+", q.lower())), set(re.findall(r"\w+", d.lower()))
            out.append(len(a & b) / len(a) if a else 0.0)
        return out

    return score
