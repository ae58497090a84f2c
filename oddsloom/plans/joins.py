"""Lookups whose physical form is chosen from a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dimension of at most this many (narrow) rows may be broadcast.
BROADCAST_ROWS = 500_000
SALTS = 16


def lookup(big: DataFrame, dim: DataFrame, on: list[str], *, how: str = "left", salt_from: str, rows: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join of a large, possibly skewed table with a dimension that is unique on the keys.

    The dimension is counted (or its row count given): up to `broadcast_rows` it is broadcast; beyond that both sides
    are shuffled on the keys and a salt taken from `salt_from`, the dimension once per salt, so that one hot key is
    spread over SALTS tasks. Null keys match nothing. Only inner and left joins keep their meaning under salting."""
    if how not in ("left", "inner"):
        raise ValueError(how)
    if (dim.count() if rows is None else rows) <= broadcast_rows:
        return big.join(F.broadcast(dim), on, how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")
