"""Embeddings of different texts, fetched once and kept in a cache table."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetcher = Callable[[list[str]], list[list[float]]]


def hashing_embedder(texts: list[str], size: int = 64) -> list[list[float]]:
    """A deterministic local embedder: signed counts of hashed words, of unit length (zero without words)."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in re.findall(r"[a-z]+|\d+", t.lower()):
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[h[0] % size] += 1.0 if h[1] & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


class within:  # noqa: N801 (used as a function; an object so that it can be sent to workers)
    """fetch called with these environment variables set, and, where single, with one text at a time."""

    def __init__(self, fetch: Fetcher, environment: dict[str, str], single: bool = False):
        self.fetch, self.environment, self.single = fetch, dict(environment), single

    def __call__(self, texts: list[str]) -> list[list[float]]:
        before = {k: os.environ.get(k) for k in self.environment}
        os.environ.update(self.environment)
        try:
            if not self.single:
                return self.fetch(texts)
            out = []
            for t in texts:
                got = self.fetch([t])
                if len(got) != 1:
                    raise ValueError("the number of embeddings differs from the number of texts")
                out += got
            return out
        finally:
            for k, v in before.items():
                if v is None:
                    os.environ.pop(k, None)
                else:
                    os.environ[k] = v


def numbers(vector) -> list[float]:
    """A vector's values as floats; numbers and numeric strings are taken, anything else is an error."""
    if not isinstance(vector, (list, tuple)) or any(isinstance(x, bool) or not isinstance(x, (int, float, str)) for x in vector):
        raise ValueError("an embedding must be a list of numbers")
    return [float(x) for x in vector]


def misses(texts: DataFrame, cache: DataFrame, key: str = "text_sha") -> DataFrame:
    """Different texts that the cache lacks."""
    return texts.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def fetched(missing: DataFrame, fetch: Fetcher, batch: int = 64, key: str = "text_sha", text: str = "text") -> DataFrame:
    """(key, vector) of the missing texts, fetched in batches by the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                got = fetch(part[text].tolist())
                if len(got) != len(part):
                    raise ValueError("the number of embeddings differs from the number of texts")
                yield pd.DataFrame({key: part[key].values, "vector": [numbers(v) for v in got]})

    return missing.select(key, text).mapInPandas(run, f"{key} string, vector array<double>")


def embedded(texts: DataFrame, cache: DataFrame, fetch: Fetcher, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(texts with their vectors, rows new to the cache). texts(text, ...): rows of equal text share one fetch."""
    keyed = texts.withColumn("text_sha", F.sha2(F.col("text").cast("binary"), 256))
    new = fetched(misses(keyed, cache), fetch, batch)
    return keyed.join(cache.select("text_sha", "vector").unionByName(new), "text_sha"), new
