import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsloom.llm.matching import REACH, candidates, describe, prepared, weak_label

D = os.environ.get("RECALL_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_candidates_hold_the_sure_pairs(spark):
    """Against all pairs of records of two sources, one mark and near times: those that the rules are sure of must be candidates."""
    events = spark.read.parquet(f"{D}/book_events.parquet").withColumnsRenamed({"event_id": "id", "book": "source", "sport": "domain"})
    r = prepared(events, ["tennis"])
    got = {(x.id_a, x.id_b) for x in candidates(r).select("id_a", "id_b").collect()}
    side = lambda s: r.select(F.col("domain"), F.col("mark"), *[F.col(c).alias(f"{n}{s}") for c, n in (("id", "i"), ("source", "src"), ("at", "at"), ("home", "h"), ("away", "a"), ("league", "l"), ("t", "t"), ("s", "s"))])
    near = side("a").join(side("b"), ["domain", "mark"]).where((F.col("ia") < F.col("ib")) & (F.col("srca") != F.col("srcb")) & (F.abs(F.col("ata") - F.col("atb")) <= REACH)).toPandas()
    sure = pd.Series(weak_label(describe(near, ["tennis"])), index=near.index) == 1
    want = set(zip(near.loc[sure, "ia"], near.loc[sure, "ib"]))
    found = len(want & got) / max(len(want), 1)
    print(f"candidates {len(got)} of {len(near)} near pairs, {len(want)} sure pairs, recall {found:.5f}")
    assert want and found >= 0.98
