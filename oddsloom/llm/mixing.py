"""Mixing sources to target shares of the tokens: soft membership and fitted document rates (problem 8).

A classifier trained on the documents whose source the targets name gives every document its probabilities of the domains, the soft
membership: by its text, at a temperature that is fitted on held-out documents, and, where the table names its source, by that label, of
which a stated share is trusted. The rates of the documents (copies, not yet whole) are fitted by projected gradient on the least squares of two sets of
totals: the tokens expected in each domain by the memberships, and the tokens of each source as the table names it, both against the
targets. A document's rate is kept between nil and its source's cap. The projection is lazy: a document's rate follows from the sum of
all steps so far, one number a domain and source, so a round is one pass over the documents that returns a few dozen sums; the step is
scaled by the normal matrix of the documents whose rates are free, which one pass returns, too, and damped while it overshoots. Rates become whole copies by
sequential Poisson sampling: the part beyond the whole copies goes to the documents of a source in the order of a hash over that part,
up to the tokens the source still lacks. The sources therefore meet their targets to within a document, the expected totals as nearly
as that allows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.tokens import VOCABULARY, encoding
from oddsloom.plans.materialize import table as stored

BUCKETS = 4096
#: Temperatures tried: the mean log-likelihood of a text's tokens counts as so many tokens, or as many as the text has.
TEMPERATURES = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
#: The temperature is judged by at most about so many documents, drawn by a hash of the identifier.
JUDGED = 20_000
#: How often the source that the table names is the domain.
TRUST = 0.98
#: Tokens of texts scored at a time in a task.
CHUNK = 200_000
#: Rounds of the fit at most, and the residual, as a share of the mixture, at which it ends.
ROUNDS, TOLERANCE = 25, 1e-6
#: Weight of the totals by source against those expected, and of staying near equal rates.
BY_SOURCE, INERTIA = 3.0, 1e-5
SLOTS = 4096
#: How often the room that is left in a source is offered to smaller documents.
FILLS = 3
#: The targets are a small table that goes to every executor; a longer one is an error.
MOST_TARGETS = 1_000


def encoded(documents: DataFrame, *, ident: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """i, source, n_tokens and b, the bucket of every token of the whole text; null and empty texts have none."""
    kind = dict(documents.dtypes)[ident]

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            tokens = [enc.encode_to_numpy(t or "", disallowed_special=()) for t in b.column("t").to_pylist()]
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            flat = (np.concatenate(tokens) % BUCKETS).astype(np.int16) if sizes.sum() else np.zeros(0, dtype=np.int16)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("source"), pa.array(sizes), _lists(flat, sizes)], names=["i", "source", "n_tokens", "b"])

    work = documents.where(F.col(ident).isNotNull()).select(F.col(ident).alias("i"), F.col(source).alias("source"), F.col(text).alias("t"))
    return work.mapInArrow(run, f"i {kind}, source string, n_tokens long, b array<smallint>")


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _likelihoods(like: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean log-likelihood of the tokens of each text under each domain; about CHUNK tokens at a time, a longer text piece by piece."""
    total = np.zeros((len(sizes), len(like)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(flat), CHUNK):
        own, at = flat[lo : lo + CHUNK].astype(np.int64), row[lo : lo + CHUNK]
        for k in range(len(like)):
            total[at[0] : at[-1] + 1, k] += np.bincount(at - at[0], weights=like[k, own])
    return total / np.maximum(sizes, 1)[:, None]


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _model(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = n[:, :BUCKETS] + 0.5
    return np.log(words / words.sum(axis=1, keepdims=True)), np.log((n[:, BUCKETS] + 1) / (n[:, BUCKETS] + 1).sum())


def posteriors(told: DataFrame, domains: list[str], trust: float = TRUST) -> DataFrame:
    """told (columns i, source, n_tokens and b) without b and with p, the probabilities of the domains in the order given, and k, the number of
    the named source or -1, for every document.

    Multinomial Bayes over token buckets with counts from all documents of a named source (the model has len(domains) * BUCKETS numbers);
    priors are the domains' numbers of documents. The temperature is the one at which the model of one half of those documents gives the
    other half's sources the highest likelihood. Documents without tokens have the priors for a text."""
    spark, size = told.sparkSession, len(domains)
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("source"))
    told = told.withColumns({"k": F.coalesce(number - 1, F.lit(-1)).cast("int"), "half": F.pmod(F.xxhash64(F.lit(11), "i"), F.lit(2)).cast("int")})
    known = told.where("k >= 0").select("k", "half", "n_tokens", "b")

    def count(batches):
        tokens, texts = np.zeros(2 * size * BUCKETS, dtype=np.int64), np.zeros(2 * size, dtype=np.int64)
        for b in batches:
            group = b.column("k").to_numpy().astype(np.int64) * 2 + b.column("half").to_numpy()
            tokens += np.bincount(np.repeat(group, b.column("n_tokens").to_numpy()) * BUCKETS + _flat(b.column("b")), minlength=len(tokens))
            texts += np.bincount(group, minlength=len(texts))
        sums = np.column_stack([tokens.reshape(2 * size, BUCKETS), texts])
        g, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[g, bucket])], names=["g", "bucket", "n"])

    counted = known.mapInArrow(count, "g int, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2 * size, BUCKETS + 1))
    n[counted["g"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"]
    first = spark.sparkContext.broadcast(_model(n[0::2]))
    scale = lambda sizes, t: np.minimum(sizes, t)[:, None]

    def judge(batches):
        like, prior = first.value
        for b in batches:
            sizes, k = b.column("n_tokens").to_numpy(), b.column("k").to_numpy()
            mean = _likelihoods(like, _flat(b.column("b")), sizes)
            got = [float(np.log(_softmax(prior + mean * scale(sizes, t))[np.arange(len(k)), k] + 1e-12).sum()) for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([pa.array(TEMPERATURES, pa.float64()), pa.array(got, pa.float64())], names=["t", "v"])

    other = float(n[1::2, BUCKETS].sum())
    drawn = told.where((F.col("k") >= 0) & (F.col("half") == 1) & (F.pmod(F.xxhash64(F.lit(12), "i"), F.lit(max(1, int(other // JUDGED)))) == 0))
    judged = drawn.select("k", "n_tokens", "b").mapInArrow(judge, "t double, v double").groupBy("t").agg(F.sum("v").alias("v")).toPandas().sort_values("t")
    heat = float(judged["t"].iloc[judged["v"].argmax()]) if len(judged) else 0.0
    model = spark.sparkContext.broadcast(_model(n[0::2] + n[1::2]))

    def predict(batches):
        like, prior = model.value
        for b in batches:
            sizes, k = b.column("n_tokens").to_numpy(), b.column("k").to_numpy()
            p = _softmax(prior + _likelihoods(like, _flat(b.column("b")), sizes) * scale(sizes, heat))
            if size > 1:
                named = k >= 0
                label = np.full((int(named.sum()), size), (1 - trust) / (size - 1))
                label[np.arange(len(label)), k[named]] = trust
                p[named] = p[named] * label / (p[named] * label).sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("i", "source", "n_tokens", "k")], _lists(p.ravel(), np.full(len(p), size))], names=["i", "source", "n_tokens", "k", "p"])

    return told.drop("half").mapInArrow(predict, f"i {dict(told.dtypes)['i']}, source string, n_tokens long, k int, p array<double>")


def rates(own: np.ndarray, k: np.ndarray, dual: np.ndarray, start: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates of documents by the sum of the steps so far: (rows of the totals each document enters, rate, whether it is free).

    own: memberships; k: number of the source, -1 if unknown; start: the rate of departure by source, the last for unknown ones."""
    size = own.shape[1]
    rows = np.zeros((len(own), 2 * size))
    rows[:, :size] = own
    named = np.flatnonzero(k >= 0)
    rows[named, size + k[named]] = BY_SOURCE
    cap = np.where(k >= 0, caps[k], caps[own.argmax(axis=1)])
    want = np.minimum(start[k], cap) + rows @ dual
    rate = np.clip(want, 0.0, cap)
    return rows, rate, (want > 0) & (want < cap)


def fit_rates(told: DataFrame, targets: np.ndarray, caps: np.ndarray, start: np.ndarray, total: float) -> np.ndarray:
    """The sum of the projected gradient's steps, one number for each domain's expected tokens and each source's tokens.

    told: n_tokens, k, p. Least squares of the totals' shares off the targets, and INERTIA times that of the rates off their start."""
    size = len(targets)
    goal = np.concatenate([targets, BY_SOURCE * targets])
    dual = np.zeros(2 * size)
    context = told.sparkSession.sparkContext

    def look(dual: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        at = context.broadcast(dual)

        def add(batches):
            out = np.zeros((2 * size, 2 * size + 1))
            for b in batches:
                if not len(b):
                    continue
                rows, rate, free = rates(_flat(b.column("p")).reshape(-1, size), b.column("k").to_numpy().astype(np.int64), at.value, start, caps)
                n = b.column("n_tokens").to_numpy() / total
                out[:, 0] += rows.T @ (n * rate)
                out[:, 1:] += (rows * (n * free)[:, None]).T @ rows
            i, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], names=["i", "j", "v"])

        got = told.select("n_tokens", "k", "p").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((2 * size, 2 * size + 1))
        out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"]
        off = goal - out[:, 0] - INERTIA * dual
        return off, out[:, 1:], float((off**2).sum())

    off, normal, error = look(dual)
    damp = 0.01
    for _ in range(ROUNDS):
        if np.abs(off).max() <= TOLERANCE or damp > 1e3:
            break
        step = np.linalg.solve(normal + (INERTIA + damp) * np.eye(2 * size), off)
        now = look(dual + step)
        if now[2] >= error:  # documents reached their bounds on the way
            damp *= 8
            continue
        done = now[2] > error * (1 - 1e-2)
        dual, damp, (off, normal, error) = dual + step, damp / 8, now
        if done:
            break
    return dual


def memberships(documents: DataFrame, targets: DataFrame, *, ident: str, text: str, source: str, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """mixture(), with p, the probabilities of the domains in the order of their names."""
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").limit(MOST_TARGETS + 1).toPandas()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources in the targets")
    domains = wanted["source"].tolist()
    size = len(domains)
    share = wanted["share"].fillna(0).clip(lower=0).to_numpy(np.float64)
    share = share / max(share.sum(), 1e-12)
    caps = wanted["cap"].fillna(0).clip(lower=0).to_numpy(np.float64)
    kind = dict(documents.dtypes)[ident]
    empty = documents.sparkSession.createDataFrame([], f"`{ident}` {kind}, source string, domain string, n_tokens long, copies int, p array<double>")
    if not size:
        return empty
    labels = F.array(*[F.lit(d) for d in domains])
    coded = stored(encoded(documents, ident=ident, text=text, source=source, vocabulary=vocabulary).where("n_tokens > 0"))
    told = stored(posteriors(coded, domains))
    sums = {r["k"]: float(r["n"]) for r in told.groupBy("k").agg(F.sum("n_tokens").alias("n")).collect()}
    own = np.array([sums.get(k, 0.0) for k in range(size)])
    reach = [caps[k] * own[k] / share[k] for k in range(size) if share[k] > 0 and own[k] > 0]
    total = float(total_tokens if total_tokens is not None else min(reach, default=0.0))
    if total <= 0:
        return empty
    start = np.append(np.minimum(caps, np.where(own > 0, share * total / np.maximum(own, 1.0), 0.0)), 0.0)
    dual = fit_rates(told, share, caps, start, total)
    shared = told.sparkSession.sparkContext.broadcast(dual)

    def rated(batches):
        for b in batches:
            p, k = _flat(b.column("p")).reshape(-1, size), b.column("k").to_numpy().astype(np.int64)
            rate = rates(p, k, shared.value, start, caps)[1] if len(k) else np.zeros(0)
            top = p.argmax(axis=1)
            more = [pa.array(rate), pa.array(np.where(k >= 0, caps[k], caps[top]).astype(np.int64)), pa.array(np.where(k >= 0, k, top).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "rate", "cap", "domain"])

    schema = ", ".join(f"{c} {t}" for c, t in told.dtypes)
    found = stored(told.mapInArrow(rated, f"{schema}, rate double, cap long, domain int"))

    # sequential Poisson sampling: of each source, and of those of unknown source together, the documents with the least quotient of hash
    # and open part get a copy more, as far as the tokens go that the source still lacks; what room is then left goes the same way to
    # documents that still fit in. Each time two passes over a histogram of bounded size.
    whole = F.floor(F.col("rate") + 1e-9).cast("long")
    part = F.greatest(F.col("rate") - F.floor(F.col("rate") + 1e-9), F.lit(0.0))
    chance = (F.pmod(F.xxhash64(F.lit(20_250_101), "i"), F.lit(2**31 - 1)) + 1) / F.lit(float(2**31))
    place = F.least(F.floor(chance / (chance + part) * SLOTS * SLOTS), F.lit(SLOTS * SLOTS - 1)).cast("long")
    hashed = found.withColumns({"whole": whole, "s1": F.floor(place / SLOTS).cast("int"), "s2": (place % SLOTS).cast("int")})
    base = {r["k"]: (float(r["w"]), float(r["e"])) for r in hashed.groupBy("k").agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("w"), F.sum(F.col("n_tokens") * F.col("rate")).alias("e")).collect()}
    # a source with soft members beside it asks for what its rates say, else for its share of the whole
    alone = -1 not in base or base[-1][1] < 1
    need = {k: max(0.0, (share[k] * total if alone and k >= 0 else e) - w) for k, (w, e) in base.items()}
    pick = lambda values, none=-1: F.coalesce(F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), int(v))])[F.col("k")], F.lit(none)) if values else F.lit(none)
    extra = F.lit(False)
    for _ in range(FILLS):
        fits = ~extra & (F.col("whole") < F.col("cap")) & (F.col("n_tokens") <= pick(need))
        edge1, edge2, left = {}, {}, {}
        first = hashed.where(fits).groupBy("k", "s1").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values(["k", "s1"])
        for k, g in first.groupby("k"):
            cum = g["n"].cumsum().to_numpy()
            i = int(np.searchsorted(cum, need[int(k)], side="right"))
            edge1[int(k)] = int(g["s1"].iloc[i]) if i < len(g) else SLOTS
            left[int(k)] = need[int(k)] - (cum[i - 1] if i else 0.0)
        second = hashed.where(fits & (F.col("s1") == pick(edge1))).groupBy("k", "s2").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values(["k", "s2"])
        for k, g in second.groupby("k"):
            cum = g["n"].cumsum().to_numpy()
            i = int(np.searchsorted(cum, left[int(k)], side="right"))
            edge2[int(k)] = int(g["s2"].iloc[i]) if i < len(g) else SLOTS
            left[int(k)] -= cum[i - 1] if i else 0.0
        extra = extra | (fits & ((F.col("s1") < pick(edge1)) | ((F.col("s1") == pick(edge1)) & (F.col("s2") < pick(edge2)))))
        need = {k: left.get(k, need[k]) for k in need}
    copies = (F.col("whole") + extra.cast("long")).cast("int")
    return hashed.select(F.col("i").alias(ident), "source", F.get(labels, F.col("domain")).alias("domain"), "n_tokens", copies.alias("copies"), "p").where("copies > 0")


def mixture(documents: DataFrame, targets: DataFrame, *, ident: str, text: str, source: str, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """ident, source (as given), domain (the named source, else the likeliest), n_tokens, copies: documents of the mixture, copies >= 1.

    targets: source, target_share (not negative; taken relative to their sum), max_repeats; of repeated sources the largest
    values hold. total_tokens: size of the mixture; by default the largest at which every source with documents can meet its share within
    its cap. A source without documents gets what soft members give it. A document appears at most max_repeats times, one of unknown
    source (null, or without target) at most as often as its likeliest domain allows. Documents without tokens are left out, so are rows without
    ident; ident must be unique. No documents or no targets give an empty result. Other columns are ignored."""
    return memberships(documents, targets, ident=ident, text=text, source=source, total_tokens=total_tokens, vocabulary=vocabulary).drop("p")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """domain, target_share, documents, tokens (of all copies), actual_share, expected_share (by the memberships p), most_copies, for every
    source of the targets. mixed: the result of memberships()."""
    n = F.col("n_tokens") * F.col("copies")
    by = mixed.groupBy("domain").agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"), F.max("copies").alias("most_copies"))
    names = F.array_sort(F.collect_set("source"))
    order = targets.where("source IS NOT NULL").agg(names.alias("names"))  # one row
    softly = mixed.select(F.posexplode(F.transform("p", lambda q: q * n)).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("expected"))
    soft = softly.crossJoin(F.broadcast(order)).select(F.get("names", F.col("k")).alias("domain"), "expected")
    total = by.agg(F.sum("tokens").alias("all_tokens"))  # one row
    rows = targets.select(F.col("source").alias("domain"), "target_share").join(by, "domain", "left").join(soft, "domain", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c: F.coalesce(F.col(c) / F.col("all_tokens"), F.lit(0.0))
    return rows.select("domain", "target_share", zero(F.col("documents")).alias("documents"), zero(F.col("tokens")).alias("tokens"), share("tokens").alias("actual_share"), share("expected").alias("expected_share"), zero(F.col("most_copies")).alias("most_copies"))
