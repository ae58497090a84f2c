"""Filling containers of fixed capacity: bulk-synchronous best fit (problem 7).

Documents and the gaps of open containers are rows. A superstep range-sorts both by size, a document before a gap of its size,
and sweeps every range for successors: the documents not yet placed lie on a stack, and a gap takes the largest of them, which is the
last one passed, and more of them while they fit. So of all documents that want a gap, the one of the highest rank gets it. What a
range cannot settle by itself, documents that found no gap above them and gaps that found no document below, is settled between the
ranges: by the counts and the extreme sizes of the leftovers, a few numbers a range, the gaps of one range are given the documents
of the nearest range below that has some left, by rank from the largest down. Then the gaps are updated and the next superstep
begins, with as many ranges as its rows need. When no gap holds any document that is left, as many containers are opened as the
tokens left need at least. Every superstep shrinks to the documents left, of which the first ones, the large ones, are the most."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.plans.materialize import table as stored
from oddsloom.plans.ranges import ranks

CAPACITY = 2048
#: Documents and gaps in one range of a superstep.
ROWS_PER_RANGE = 200_000
DOC, GAP = 0, 1
#: Places within a range are packed with its number into one key.
_PLACES = 2**32


def sweep(size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """One sorted range: for each row the row of its gap (or -1), the sizes with the gaps updated, and the rows of the documents left
    (largest first) and of the gaps that took nothing (smallest first)."""
    to, room = np.full(len(size), -1), size.copy()
    stack: list[int] = []
    bare: list[int] = []
    sizes, kinds = size.tolist(), kind.tolist()
    for at, (v, k) in enumerate(zip(sizes, kinds)):
        if k == DOC:
            stack.append(at)
            continue
        if not stack:
            bare.append(at)
            continue
        while stack and sizes[stack[-1]] <= v:
            to[stack[-1]] = at
            v -= sizes[stack.pop()]
        room[at] = v
    return to, room, stack[::-1], bare


def between(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Leftovers of the ranges, in order (range, documents, largest, gaps, smallest), to moves (range of the documents, first place,
    documents, range and first place of the gaps, documents a gap as one number): (docs_range, from, count, gap_key, each)."""
    moves: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []  # range, places used, documents, largest
    for pid, docs, largest, gaps, smallest in ranges:
        at, room = 0, smallest
        while at < gaps and stack and room >= stack[-1][3]:
            below = stack[-1]
            each = room // below[3]
            left = below[2] - below[1]
            full = min(gaps - at, left // each) if room == smallest else 0
            if full:
                moves.append((below[0], below[1], full * each, pid * _PLACES + at, each))
                below[1], at = below[1] + full * each, at + full
            else:  # one gap takes what is left of a range, or tops up from the next one
                n = min(left, each)
                moves.append((below[0], below[1], n, pid * _PLACES + at, n))
                below[1], room = below[1] + n, room - n * below[3]
            if below[1] == below[2]:
                stack.pop()
            if not full and (not stack or room < stack[-1][3]):
                at, room = at + 1, smallest
        if docs:
            stack.append([pid, 0, docs, largest])
    return moves


def _superstep(docs: DataFrame, gaps: DataFrame, kind: str, ranges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed: i, n, c), the documents and the gaps left."""
    rows = docs.select(F.lit(DOC).alias("k"), "n", "i", F.lit(None).cast("long").alias("c"), F.xxhash64("i").alias("tie")).unionByName(gaps.select(F.lit(GAP).alias("k"), F.col("g").alias("n"), F.lit(None).cast(kind).alias("i"), "c", F.col("c").alias("tie")))
    sorted_ = rows.repartitionByRange(ranges, "n", "k", "tie").sortWithinPartitions("n", "k", "tie").withColumn("pid", F.spark_partition_id()).drop("tie")

    def swept(batches):
        if not (own := [b for b in batches if len(b)]):
            return
        b = own[0] if len(own) == 1 else pd.concat(own, ignore_index=True)
        to, room, stack, bare = sweep(b["n"].to_numpy(np.int64), b["k"].to_numpy())
        hit, c = to >= 0, b["c"].to_numpy(np.float64)
        place = np.full(len(b), -1, dtype=np.int64)
        place[stack], place[bare] = np.arange(len(stack)), np.arange(len(bare))
        b["c"] = pd.array(np.where(hit, c[to], c), dtype="Float64").astype("Int64")
        b["n"] = np.where(b["k"] == GAP, room, b["n"])
        yield b.assign(place=place, done=hit | ((b["k"] == GAP) & (place < 0)))

    told = stored(sorted_.mapInPandas(swept, f"k int, n long, i {kind}, c long, pid int, place long, done boolean"))
    left = told.where("NOT done")
    counted = left.groupBy("pid").agg(F.sum((F.col("k") == DOC).cast("long")).alias("docs"), F.max(F.when(F.col("k") == DOC, F.col("n"))).alias("largest"), F.sum((F.col("k") == GAP).cast("long")).alias("gaps"), F.min(F.when(F.col("k") == GAP, F.col("n"))).alias("smallest"))
    moves = between([(r["pid"], r["docs"], r["largest"] or 0, r["gaps"], r["smallest"] or 0) for r in counted.orderBy("pid").collect()])  # a row a range
    placed, gaps_left, docs_left = told.where(f"k = {DOC} AND done").select("i", "n", "c"), told.where(f"k = {GAP}").select("c", F.col("n").alias("g")), left.where(f"k = {DOC}").select("i", "n")
    if not moves:
        return placed, docs_left, gaps_left
    by: dict[int, list] = {}
    for m in moves:
        by.setdefault(m[0], []).append(m)
    shared = docs.sparkSession.sparkContext.broadcast(by)  # a few numbers a range

    def keyed(batches):
        for b in batches:
            keys = np.full(len(b), -1, dtype=np.int64)
            for at, (p, r) in enumerate(zip(b["pid"].tolist(), b["place"].tolist())):
                own = shared.value.get(p, [])
                j = bisect.bisect_right(own, r, key=lambda m: m[1]) - 1
                if j >= 0 and r < own[j][1] + own[j][2]:
                    keys[at] = own[j][3] + (r - own[j][1]) // own[j][4]
            yield b[["i", "n"]].assign(key=keys)

    keyed_docs = stored(left.where(f"k = {DOC}").select("i", "n", "pid", "place").mapInPandas(keyed, f"i {kind}, n long, key long"))
    keyed_gaps = left.where(f"k = {GAP}").select((F.col("pid").cast("long") * _PLACES + F.col("place")).alias("key"), "c")
    crossed = stored(keyed_docs.where("key >= 0").join(keyed_gaps, "key").select("i", "n", "c"))
    taken = crossed.groupBy("c").agg(F.sum("n").alias("taken"))
    gaps_left = gaps_left.join(taken, "c", "left").select("c", (F.col("g") - F.coalesce("taken", F.lit(0))).alias("g"))
    return placed.unionByName(crossed), keyed_docs.where("key < 0").select("i", "n"), gaps_left


def pack(sized: DataFrame, *, ident: str, size: str, capacity: int = CAPACITY, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """ident, piece, from_token, n_tokens, container, offset: each document, cut into pieces of the capacity only if it is larger.

    Full pieces fill a container each; the rest and all smaller documents are placed by best fit. A document of size 0 (null
    sizes count as 0) takes no room in container 0. ident must be unique; rows without it are left out. Repeated sizes are told apart by a
    hash of ident. An empty table gives an empty result; containers are numbered without holes, those of full pieces after the others.
    The result may differ with the number of ranges; each is a packing."""
    spark = sized.sparkSession
    kind = dict(sized.dtypes)[ident]
    base = stored(sized.select(F.col(ident).alias("i"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")).where("i IS NOT NULL"))
    rest = base.withColumns({"rest": F.col("n") % capacity, "fulls": F.floor(F.col("n") / capacity)})
    docs = rest.where("rest > 0").select("i", F.col("rest").alias("n"))
    gaps = spark.createDataFrame([], "c long, g long")
    opened, step, placed = 0, 0, None
    while True:
        now = docs.agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.sum("n").alias("tokens")).first()
        if not now["rows"]:
            break
        gaps = gaps.where(F.col("g") >= now["least"])
        if not (open_ := gaps.count()):
            open_ = -(-now["tokens"] // capacity)
            gaps = spark.range(opened, opened + open_).select(F.col("id").alias("c"), F.lit(capacity).cast("long").alias("g"))
            opened += open_
        hits, docs, gaps = _superstep(docs, gaps, kind, -(-(now["rows"] + open_) // rows_per_range))
        hits, step = hits.withColumn("step", F.lit(step)), step + 1
        placed = hits if placed is None else placed.unionByName(hits)
    fulls = rest.where("fulls > 0").select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fulls") - 1)).alias("piece"))
    n_fulls = rest.agg(F.coalesce(F.sum("fulls"), F.lit(0)).alias("n")).first()["n"]
    numbered = ranks(fulls.select(F.lit("full").alias("g"), F.col("piece").cast("double").alias("v"), "i"), "g", "v", "i", rows=n_fulls)
    long = lambda n: F.lit(n).cast("long")
    whole = numbered.select("i", F.col("v").cast("long").alias("piece"), (F.col("v").cast("long") * capacity).alias("from_token"), long(capacity).alias("n_tokens"), (F.col("nth") + max(opened, 1)).alias("container"), long(0).alias("offset"))
    nothing = rest.where("n = 0").select("i", *[long(0).alias(c) for c in ("piece", "from_token", "n_tokens", "container", "offset")])
    out = whole.unionByName(nothing)
    if placed is not None:
        # a container holds at most as many documents as tokens
        before = Window.partitionBy("c").orderBy("step", F.col("n").desc(), "i").rowsBetween(Window.unboundedPreceding, -1)
        small = placed.withColumn("offset", F.coalesce(F.sum("n").over(before), long(0))).join(rest.select("i", "fulls"), "i")
        out = out.unionByName(small.select("i", F.col("fulls").alias("piece"), (F.col("fulls") * capacity).alias("from_token"), F.col("n").alias("n_tokens"), F.col("c").alias("container"), "offset"))
    return out.withColumnRenamed("i", ident)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, least_containers (tokens over capacity, rounded up), fill (share of the room that is used), fullest."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    total = by.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"), "fullest")
