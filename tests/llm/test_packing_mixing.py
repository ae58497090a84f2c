import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.llm.mixing import encoded, memberships, mixture, posteriors, share_report
from oddsloom.llm.packing import DOC, GAP, between, fill_report, pack, sweep
from oddsloom.llm.tokens import encoding, with_tokens


@pytest.mark.parametrize("seed", range(25))
def test_a_gap_takes_the_largest_documents_below_it(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(1, 60), rng.choice([DOC, GAP])) for _ in range(rng.randrange(1, 200)))
    to, room, left, bare = sweep(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    free = set()
    for at, (v, k) in enumerate(rows):
        if k == DOC:
            free.add(at)
            continue
        took = []
        while free and rows[max(free)][0] <= v:
            took.append(max(free))
            v -= rows[took[-1]][0]
            free.discard(took[-1])
        assert [i for i in np.flatnonzero(to == at)[::-1]] == took and room[at] == v and (at in bare) == (not took)
    assert left == sorted(free, reverse=True)


@pytest.mark.parametrize("seed", range(25))
def test_leftovers_meet_between_ranges(seed):
    """Every document goes to one gap above its range, and no gap is overfilled even if all documents were as large as the largest."""
    rng = random.Random(seed)
    ranges, size = [], 1
    for pid in range(rng.randrange(1, 12)):
        low, size = size, size + rng.randrange(1, 30)
        ranges.append((pid, rng.randrange(0, 9), size - 1, rng.randrange(0, 5), low))
    by = {r[0]: r for r in ranges}
    given, used = defaultdict(set), defaultdict(int)
    for docs, start, n, gap, each in between(ranges):
        for r in range(start, start + n):
            assert r not in given[docs] and r < by[docs][1]
            given[docs].add(r)
            g = gap + (r - start) // each
            assert docs < g >> 32 and g % 2**32 < by[g >> 32][3]
            used[g] += by[docs][2]
    assert all(u <= by[g >> 32][4] for g, u in used.items())
    # a range whose documents are all below a range of gaps has none left while such a gap stayed bare
    for pid, _, _, gaps, _ in ranges:
        if any(pid * 2**32 + g not in used for g in range(gaps)):
            assert all(len(given[j]) == by[j][1] for j in range(pid) if by[j][1])


@pytest.mark.parametrize("rows_per_range", [200_000, 40])
def test_packing_leaves_little_room(spark, rows_per_range):
    rng = random.Random(5)
    sizes = [min(2048, 1 + int(rng.expovariate(1 / 300))) for _ in range(900)]
    packed = pack(spark.createDataFrame(list(enumerate(sizes)), "doc int, n int"), ident="doc", size="n", rows_per_range=rows_per_range)
    rep = fill_report(packed).first()
    assert rep.tokens == sum(sizes) and rep.fullest <= 2048 and rep.containers <= rep.least_containers + 3


def test_packing_is_whole_and_without_overlap(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 7, 100, 100, 100, 2048, 2049, 5000, rng.randrange(1, 3000), None]), "x") for i in range(1200)] + [(None, 5, "x")]
    got = pack(spark.createDataFrame(rows, "doc long, n int, container string").repartition(5), ident="doc", size="n").collect()
    docs, used = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc].append((r.piece, r.from_token, r.n_tokens))
        if r.n_tokens:
            used[r.container].append((r.offset, r.n_tokens))
    for i, n, _ in rows[:-1]:
        pieces = sorted(docs[i])
        assert sum(p[2] for p in pieces) == (n or 0) and len(pieces) == max(1, -(-(n or 0) // 2048)) and [p[0] for p in pieces] == list(range(len(pieces)))
        assert all(p[1] == 2048 * p[0] for p in pieces)
    assert None not in docs
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    rep = fill_report(spark.createDataFrame(got)).first()
    assert rep.fill > 0.97 and sorted(used) == list(range(len(used)))


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], "doc long, n int"), ident="doc", size="n").count() == 0


def test_tokens_round_trip(spark):
    texts = [None, "", "a b", "Überraschung! 北京 \n\t", "x" * 30_000]
    enc = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken")
    got = {r.i: r.n_tokens for r in with_tokens(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ident="i", text="t").collect()}
    assert all(got[i] == len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)) and enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def corpus(spark, unknown=0.0):
    rng = random.Random(3)
    words = {"a": "goal match keeper league", "b": "price stake margin odds", "c": "serve racket court set"}
    rows = []
    for i in range(3000):
        s = rng.choice("aaaaaabbc")
        rows.append((i, None if rng.random() < unknown else s, " ".join(rng.choice(words[s].split()) for _ in range(rng.randrange(5, 60))), s, 1))
    return spark.createDataFrame(rows, "i long, source string, text string, really string, copies int").repartition(4)


TARGETS = [("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 4), ("none", 0.0, 1)]
ON = {"ident": "i", "text": "text", "source": "source"}


def test_shares_caps_and_report(spark):
    df, targets = corpus(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    m = memberships(df, targets, **ON)
    rep = {r.domain: r for r in share_report(m, targets).collect()}
    for s, share, cap in TARGETS:
        assert abs(rep[s].actual_share - share) < 0.002 and rep[s].most_copies <= cap
        assert abs(rep[s].expected_share - share) < 0.02
    out = m.collect()
    assert len({r.i for r in out}) == len(out) and all(r.copies >= 1 for r in out)
    small = mixture(df, targets, **ON, total_tokens=5000.0)
    total = small.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert abs(total - 5000) < 60


def test_every_document_has_a_posterior_and_expected_totals_meet_the_targets(spark):
    df, targets = corpus(spark, 0.2), spark.createDataFrame(TARGETS[:3], "source string, target_share double, max_repeats long")
    p = posteriors(encoded(df, **ON), ["a", "b", "c"]).join(df.select("i", "really"), "i").collect()
    assert len(p) == 3000 and all(abs(sum(r.p) - 1) < 1e-9 for r in p)
    unknown = [r for r in p if r.source is None]
    assert sum("abc"[max(range(3), key=lambda k: r.p[k])] == r.really for r in unknown) > 0.97 * len(unknown)
    m = memberships(df, targets, **ON, total_tokens=30_000.0)
    rep = {r.domain: r for r in share_report(m, targets).collect()}
    assert all(abs(rep[s].actual_share - share) < 0.02 and abs(rep[s].expected_share - share) < 0.02 for s, share, _ in TARGETS[:3])


def test_a_source_without_documents_is_met_by_soft_members(spark):
    rows = [(i, "a" if i % 2 else None, "goal match keeper") for i in range(400)] + [(400 + i, "b", "price stake odds") for i in range(400)]
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2)], "source string, target_share double, max_repeats long")
    m = memberships(spark.createDataFrame(rows, "i long, source string, text string"), targets, **ON, total_tokens=2_000.0)
    rep = {r.domain: r for r in share_report(m, targets).collect()}
    assert m.where("source IS NULL").count() > 0 and abs(rep["a"].expected_share - 0.7) < 0.02


def test_mixing_nothing(spark):
    empty = spark.createDataFrame([], "i long, source string, text string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    assert mixture(empty, targets, **ON).count() == 0
    some = spark.createDataFrame([(1, "a", "x y"), (2, None, None), (None, "b", "z")], "i long, source string, text string")
    assert mixture(some, targets.limit(0), **ON).count() == 0
    assert [r.i for r in mixture(some, targets, **ON).collect()] == [1]
