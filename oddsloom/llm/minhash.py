"""MinHash bands over padded q-grams of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.plans.joins import BROADCAST_ROWS
from oddsloom.plans.materialize import table as stored

Q = 3
MOST_HASHES = 256
#: Buckets with more rows than this are spread over several tasks.
HOT = 300
#: Words whose hashes a worker keeps.
KEPT_WORDS = 50_000


def bands_for(at: float, recall: float, most: int = MOST_HASHES, background: float = 0.05) -> tuple[int, int]:
    """(bands, rows a band): the collision curve 1-(1-s^r)^b reaches `recall` at s = `at` and is least at the background's similarity."""
    best = None
    for r in range(1, 9):
        b = int(np.ceil(np.log(1 - recall) / np.log(1 - at**r)))
        if b * r <= most:
            noise = 1 - (1 - background**r) ** b
            best = min(best or (2.0, 0, 0), (noise, b, r))
    return best[1], best[2]


def grams(words: Iterable[str], q: int = Q) -> set[int]:
    pad = "#" * (q - 1)
    return {zlib.crc32((p := f"{pad}{w}{pad}")[i : i + q].encode()) for w in words for i in range(len(w) + q - 1)}


class Bands:
    """One fixed family of hash functions: the 64-bit hash of each band of a set of grams."""

    def __init__(self, n_bands: int, n_rows: int):
        rng = np.random.default_rng(7)
        self.shape = n_bands, n_rows
        self.mul = (rng.integers(1, 2**31 - 1, n_bands * n_rows).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 2**31 - 1, n_bands * n_rows).astype(np.uint64)
        self.mix = rng.integers(1, 2**62, n_rows).astype(np.uint64) | np.uint64(1)
        self.known: dict[str, np.ndarray] = {}

    def least(self, of: set[int]) -> np.ndarray:
        h = np.fromiter(of, dtype=np.uint64, count=len(of))
        return ((h[:, None] * self.mul + self.add) >> np.uint64(7) & np.uint64(0xFFFFFFFF)).min(axis=0)

    def banded(self, low: np.ndarray) -> np.ndarray:
        return (low.reshape(self.shape) * self.mix).sum(axis=1, dtype=np.uint64).view(np.int64)

    def __call__(self, of: set[int]) -> np.ndarray:
        return self.banded(self.least(of))

    def of_words(self, words: Iterable[str]) -> np.ndarray:
        """The bands of the grams of all words: the least hash of a union is the least of the words' least."""
        low = None
        for w in words:
            if (own := self.known.get(w)) is None:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                own = self.known[w] = self.least(grams([w]))
            low = own if low is None else np.minimum(low, own)
        return self.banded(low)

    def rows(self, batch: pd.DataFrame, words: list[list[str]]) -> pd.DataFrame:
        """The batch with each row once a band: columns band and h."""
        n = self.shape[0]
        out = batch.iloc[np.repeat(np.arange(len(batch)), n)]
        return out.assign(band=np.tile(np.arange(n, dtype=np.int32), len(batch)), h=np.concatenate([self.of_words(w) for w in words]) if words else np.zeros(0, dtype=np.int64))


def meet(left: DataFrame, right: DataFrame, on: list[str], split: str) -> DataFrame:
    """Inner join of two tables of bucket rows. A bucket with more than HOT rows on the left is cut by a hash of the left's column
    `split` into parts, each of which meets the whole bucket of the right in a task of its own. Equal columns of the sides besides `on` are not allowed."""
    hot = stored(left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(*on, F.ceil(F.col("_n") / HOT).cast("int").alias("_parts")))
    if (n := hot.count()) == 0:
        return left.join(right, on)
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    cut = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(split), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")).drop("_parts")
    full = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return cut.join(full, [*on, "_part"]).drop("_part")
