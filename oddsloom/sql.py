"""The engine from SQL: tables as views, its functions by name."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from oddsloom.functions import odds, text
from oddsloom.sources.tables import table


def register(spark: SparkSession, folder: str | None = None) -> list[str]:
    """Registers the Arrow functions, and the tables of a local folder as views; returns the names of the functions."""
    functions = {
        "shin_three_way": odds.shin_three_way, "shin_model": odds.shin_model, "power_three_way": odds.power_three_way, "normal_team": text.normal_team, "normal_player_name": text.normal_player_name, "token_set_ratio": text.token_set_ratio,
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    if folder:
        for f in os.listdir(folder):
            if f.endswith(".parquet"):
                table(spark, folder, f[:-8]).createOrReplaceTempView(f[:-8])
    return list(functions)
