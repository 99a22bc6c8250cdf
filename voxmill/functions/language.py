"""Which language a text is in, by a ladder of evidence, and plug-in models with plain local stand-ins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CONFIDENCE, LEAST_CORROBORATED, LEAST_CHARS = 0.9, 0.5, 20


def resolve(text: Column, candidate: Column, confidence: Column, hint: Column, default: Column) -> Column:
    """struct<language, source>: detected if sure, or half sure and the store or market says the same; then hint, default.

    A text under 20 signs is not detected.
    """
    long_enough = F.length(text) >= LEAST_CHARS
    sure = long_enough & (confidence >= LEAST_CONFIDENCE)
    agreed = long_enough & (confidence >= LEAST_CORROBORATED) & (candidate.eqNullSafe(hint) | candidate.eqNullSafe(default)) & candidate.isNotNull()
    detected = F.coalesce(sure | agreed, F.lit(False)) & candidate.isNotNull()
    language = F.when(detected, candidate).otherwise(F.coalesce(hint, default))
    source = F.when(detected, "detected").when(hint.isNotNull(), "store_hint").when(default.isNotNull(), "market_default").otherwise("unknown")
    return F.struct(language.alias("language"), source.alias("source"))


def market_defaults(markets: DataFrame) -> DataFrame:
    """country and its language, for countries with exactly one."""
    return markets.groupBy("country").agg(F.min("language").alias("language"), F.count_distinct("language").alias("n")).where("n = 1").select("country", "language")


class Detector(Protocol):
    def detect(self, texts: pd.Series) -> pd.DataFrame:
        """Columns candidate and confidence."""


class Embedder(Protocol):
    model_name: str
    dimension: int

    def embed(self, texts: pd.Series) -> list[list[float]]: ...


class Translator(Protocol):
    model_name: str

    def supports(self, language: str) -> bool: ...

    def translate(self, texts: pd.Series, source: str, target: str) -> pd.Series: ...


class NgramDetector:
    """Naive Bayes on hashed byte n-grams of one to four bytes, with normalised probabilities."""

    SIZES, SPACE = (1, 2, 3, 4), 1 << 14

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray):
        self.languages, self.weights, self.prior = languages, weights, prior

    @classmethod
    def grams(cls, text: str) -> np.ndarray:
        """Counts of the hashed n-grams of a whole text."""
        signs = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode(), np.uint8).astype(np.uint32)
        found = []
        for size in cls.SIZES:
            value = np.full(max(0, len(signs) - size + 1), size, np.uint32)
            for j in range(size):
                value = value * np.uint32(16777619) ^ signs[j : len(signs) - size + 1 + j]
            found.append((value ^ value >> np.uint32(15)) % np.uint32(cls.SPACE))
        return np.bincount(np.concatenate(found), minlength=cls.SPACE)

    @classmethod
    def fit(cls, texts: DataFrame, text_column: str = "text", language_column: str = "lang") -> NgramDetector:
        """From texts with a language: what comes to the driver is a table of n-gram counts of each language."""

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                for language, text in zip(batch["language"], batch["text"], strict=True):
                    # a text counts by its shares, so that long ones do not drown the rest
                    grams = cls.grams(text)
                    held[language] = held.get(language, np.zeros(cls.SPACE)) + grams / max(grams.sum(), 1) * min(grams.sum(), 2000)
            yield pd.DataFrame([(k, v.tolist()) for k, v in held.items()], columns=["language", "counts"])

        rows = texts.where(F.col(language_column).isNotNull() & (F.length(text_column) > 0)).select(F.col(language_column).alias("language"), F.col(text_column).alias("text"))
        sums = rows.mapInPandas(counted, "language string, counts array<double>").select("language", F.posexplode("counts").alias("gram", "n")).where("n > 0")
        table = sums.groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas()
        languages = sorted(table["language"].unique())
        counts = np.full((len(languages), cls.SPACE), 0.05)
        counts[[languages.index(x) for x in table["language"]], table["gram"]] += table["n"]
        return cls(languages, np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(np.full(len(languages), 1 / max(len(languages), 1))))

    def detect(self, texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            grams = self.grams(text)
            # n-grams of a text are not independent: their evidence counts by its square root
            odds = self.prior + self.weights @ grams / np.sqrt(max(grams.sum(), 1))
            p = np.exp(odds - odds.max())
            p /= p.sum()
            out.append((self.languages[int(p.argmax())], float(p.max())) if len(p) and text else (None, None))
        return pd.DataFrame(out, columns=["candidate", "confidence"])


def detected(detector: Detector):
    """A function of a text column: struct<candidate, confidence>, in Arrow batches."""

    @F.pandas_udf("candidate string, confidence double")
    def told(batch: pd.Series) -> pd.DataFrame:
        return detector.detect(batch)

    return told


class HashingEmbedder:
    """A unit vector of hashed words: a stand-in without a model, with prefixes for documents and for queries."""

    DOCUMENT, QUERY = "passage: ", "query: "

    def __init__(self, dimension: int = 64):
        self.model_name, self.dimension = f"hashing-{dimension}", dimension

    def embed(self, texts: pd.Series, prefix: str = DOCUMENT) -> list[list[float]]:
        """The prefix is a word like others here; a model tells documents and queries apart by it."""
        out = np.zeros((len(texts), self.dimension))
        for k, text in enumerate(texts):
            words = (prefix + ("" if pd.isna(text) else text)).lower().split()
            out[k] = np.bincount([zlib.crc32(word.encode()) % self.dimension for word in words], minlength=self.dimension)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(length > 0, length, 1)).tolist()

    def embed_query(self, text: str) -> list[float]:
        return self.embed(pd.Series([text]), self.QUERY)[0]


#: Texts that an embedder gets at once: what it holds beside them does not grow with Spark's batches.
_AT_ONCE = 256


def in_parts(embedder: Embedder, batch: pd.Series) -> list[list[float]]:
    return [v for k in range(0, len(batch), _AT_ONCE) for v in embedder.embed(batch.iloc[k : k + _AT_ONCE])]


def embedded(texts: DataFrame, embedder: Embedder, text_column: str = "text") -> DataFrame:
    """texts with the embedder's vectors, in Arrow batches, of which the embedder gets a bounded number of texts at once."""

    @F.pandas_udf("array<float>")
    def vector(batch: pd.Series) -> pd.Series:
        return pd.Series(in_parts(embedder, batch))

    return texts.withColumn("embedding", vector(text_column)).withColumn("model", F.lit(embedder.model_name))
