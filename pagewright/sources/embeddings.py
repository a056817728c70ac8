"""Embedding vectors from a pluggable provider, in batches, with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import embed_text

Provider = Callable[[list[str]], list[list[float]]]


def http_provider(url: str, model: str, api_key: str = "", timeout: float = 60, attempts: int = 3, pause: float = 0.5) -> Provider:
    """POST of a batch to an /embeddings endpoint; only network errors and 5xx are tried again."""

    def call(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        for n in range(1, attempts + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as r:
                    data = json.load(r)["data"]
                return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
            except urllib.error.HTTPError as e:
                if e.code < 500 or n == attempts:
                    raise
            except OSError:
                if n == attempts:
                    raise
            time.sleep(pause * n)
        raise AssertionError

    return call


def unit(v: list[float]) -> list[float]:
    x = np.asarray(v, np.float64)
    n = np.sqrt((x * x).sum())
    return (x / n if n else x).astype(np.float32).tolist()


def embed(pages: DataFrame, provider: Provider | None, batch: int = 16, limit: int = 4000, degrade: bool = False) -> DataFrame:
    """(wiki, slug, embedding) of pages without a vector; without a provider, semantic search is not configured.

    With degrade, the pages of a batch that the provider fails on get null vectors.
    """
    if provider is None:
        raise ValueError("semantic search not configured: no embedding provider")
    rows = pages.filter(F.col("embedding").isNull()) if "embedding" in pages.columns else pages
    rows = rows.select("wiki", "slug", embed_text(limit).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), batch):
                some = p.iloc[at : at + batch]
                try:
                    vectors = [unit(v) for v in provider(some["text"].tolist())]
                except Exception:
                    if not degrade:
                        raise
                    vectors = [None] * len(some)
                yield pd.DataFrame({"wiki": some["wiki"], "slug": some["slug"], "embedding": vectors})

    return rows.mapInPandas(run, "wiki string, slug string, embedding array<float>")
