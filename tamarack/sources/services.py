"""Outside services behind protocols, with offline doubles that always give the same: embedder, namer, transport, retries."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Namer(Protocol):
    def name_cluster(self, titles: list[str]) -> tuple[str, str]: ...
    def split(self, sizes: list[int]) -> list[int]: ...
    def same(self, a: str, b: str) -> bool: ...


class HashEmbedder:
    """A unit vector from the words: each word seeds a Gaussian vector, a text is their sum. Blank texts stand for one word."""

    def __init__(self, dim: int = K.EMBEDDING_DIM) -> None:
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            words = re.findall(r"\w+", (t or "").lower()) or ["__empty__"]
            v = sum(np.random.default_rng(int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")).standard_normal(self.dim) for w in words)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


class RuleNamer:
    """Names AutoCat-i; splits into the clusters of five or more if there are two, four at most; merges nothing."""

    def __init__(self) -> None:
        self.n = 0

    def name_cluster(self, titles: list[str]) -> tuple[str, str]:
        self.n += 1
        return f"AutoCat-{self.n}", f"{len(titles)} members"

    def split(self, sizes: list[int]) -> list[int]:
        big = [i for i, s in enumerate(sizes) if s >= 5]
        return big[:4] if len(big) >= 2 else []

    def same(self, a: str, b: str) -> bool:
        return False


def embed(df: DataFrame, text: str, make: Callable[[], Embedder] = HashEmbedder, out: str = "v") -> DataFrame:
    """Adds the vector of a text column. Equal texts are embedded once, and joined back."""

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(make().embed_batch(t.fillna("").tolist()))

    key = F.coalesce(F.col(text), F.lit(""))
    once = df.select(key.alias("_t")).distinct().withColumn(out, run("_t"))
    return df.withColumn("_t", key).join(once, "_t").drop("_t")


def with_retries(call: Callable[[], tuple[int, dict, object]], attempts: int = 3, most_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Calls until a status that isn't worth another try; waits as told by Retry-After, else longer each time, with jitter."""
    waited = 0.0
    for n in range(attempts + 1):
        status, headers, body = call()
        if status not in K.RETRY_STATUS:
            return body
        wait = min(float(headers.get("Retry-After", 0) or random.uniform(0, 2.0**n)), most_wait - waited)
        if n == attempts or wait <= 0 and waited >= most_wait:
            break
        sleep(wait)
        waited += wait
    return None


class Token:
    """A token that is fetched anew a minute before it runs out."""

    def __init__(self, fetch: Callable[[], tuple[str, float]], clock: Callable[[], float] = time.time) -> None:
        self.fetch, self.clock, self.value, self.until = fetch, clock, "", 0.0

    def get(self) -> str:
        if self.clock() >= self.until - 60:
            self.value, lasts = self.fetch()
            self.until = self.clock() + lasts
        return self.value
