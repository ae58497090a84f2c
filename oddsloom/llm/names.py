"""Linking the spellings of one name (problem 4).

Spellings are first brought to a key (folded, affixes and marks of the side taken off, words sorted). MinHash over the padded
q-grams of the words that tell names apart, cut into bands, gives the candidate pairs of keys; the number of bands and their
width come from the collision curve. Candidates are verified by Monge-Elkan likeness and clustered into stars: the fullest
spelling with the most links in a neighbourhood is a centre, what is linked to it is its satellite. A spelling that would fit two
centres alike (a name without its second word, say) is left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.minhash import Bands, bands_for, meet
from oddsloom.llm.nametext import monge_elkan, parse
from oddsloom.plans.materialize import table as stored

#: Words in more than this share of the keys of a domain (and at least COMMON_LEAST of them) are common. So at most
#: words-per-key / COMMON_SHARE words of a domain are common, which bounds what is broadcast.
COMMON_SHARE = 0.004
COMMON_LEAST = 40
#: The words beside a common word begin in at least so many ways (the effective number of their first two letters), so that the many
#: spellings of one name do not make its own words common.
COMMON_PARTNERS = 12.0
#: Bands are tuned to find pairs of this q-gram similarity with this probability.
TUNE_AT, RECALL = 0.4, 0.97
#: Names of one centre are paired in parts of about so many.
PAIRED = 2_000
LIKE = 0.8
#: A spelling short of words must fit its centre by so much better than any other.
MARGIN = 0.04


def keyed(names: DataFrame, people: list[str]) -> DataFrame:
    """Adds side (mark) and key to (domain, name)."""

    def run(batches):
        for b in batches:
            parsed = [parse(n, d in people) for d, n in zip(b["domain"], b["name"])]
            yield b.assign(side=[p[0] for p in parsed], key=[" ".join(sorted(p[1])) for p in parsed])

    return names.mapInPandas(run, "domain string, name string, n long, side string, key string").where("key <> ''")


def common_words(keys: DataFrame) -> dict[str, frozenset]:
    """The common words of each domain, by the distinct keys (domain, key) that hold them and the words beside them."""
    sizes = keys.groupBy("domain").agg(F.count("*").alias("size"))
    words = keys.select("domain", F.array_distinct(F.split("key", " ")).alias("ws")).select("domain", "ws", F.explode("ws").alias("w"))
    frequent = words.groupBy("domain", "w").count().join(sizes, "domain").where((F.col("count") > COMMON_SHARE * F.col("size")) & (F.col("count") > COMMON_LEAST)).select("domain", "w")
    beside = words.join(frequent, ["domain", "w"]).select("domain", "w", F.explode("ws").alias("o")).where("o <> w").groupBy("domain", "w", F.substring("o", 1, 2).alias("o")).count()
    # the effective number is exp(entropy) = exp(ln N - sum(n ln n) / N)
    total = beside.groupBy("domain", "w").agg(F.exp(F.ln(F.sum("count")) - F.sum(F.col("count") * F.ln("count")) / F.sum("count")).alias("ways"))
    common: dict[str, frozenset] = {}
    for r in total.where(F.col("ways") >= COMMON_PARTNERS).select("domain", "w").collect():
        common[r["domain"]] = common.get(r["domain"], frozenset()) | {r["w"]}
    return common


def candidates(keys: DataFrame, common: dict[str, frozenset]) -> DataFrame:
    """Pairs a < b of keys of one domain and side that share a band."""
    bands = Bands(*bands_for(TUNE_AT, RECALL))
    shared = keys.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for b in batches:
            split = [(k.split(" "), shared.value.get(d, frozenset())) for d, k in zip(b["domain"], b["key"])]
            yield bands.rows(b, [[w for w in words if w not in usual and len(w) > 1] or words for words, usual in split])

    signed = keys.select("domain", "side", "key").mapInPandas(run, "domain string, side string, key string, band int, h long")
    signed = stored(signed.withColumn("bucket", F.xxhash64("domain", "side", "band", "h")).drop("band", "h"))
    left, right = signed.withColumnRenamed("key", "a"), signed.select("bucket", F.col("domain").alias("d"), F.col("side").alias("s"), F.col("key").alias("b"))
    return meet(left, right, ["bucket"], "a").where("a < b AND domain = d AND side = s").select("domain", "side", "a", "b").distinct()


def verified(pairs: DataFrame, common: dict[str, frozenset]) -> DataFrame:
    """(domain, side, a, b, like, short): pairs that Monge-Elkan accepts; short: words that one of the two lacks."""
    shared = pairs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for b in batches:
            got = [monge_elkan(tuple(x.split(" ")), tuple(y.split(" ")), shared.value.get(d, frozenset())) for d, x, y in zip(b["domain"], b["a"], b["b"])]
            b = b.assign(like=[g[0] for g in got], short=[g[1] for g in got])
            yield b[b["like"] >= LIKE]

    return pairs.mapInPandas(run, "domain string, side string, a string, b string, like double, short int")


def stars(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, side, key, centre) of every key. keys carries rank: a struct whose order says which of two is the better centre.

    Each round, keys that outrank all their undecided neighbours become centres and their neighbours satellites; the rounds
    end when no undecided edge is left. A satellite that is linked to several centres goes to the likeliest; one that lacks
    words or has one as an initial, and fits two of them alike within MARGIN, is its own centre."""
    v = ["domain", "side"]
    both = edges.unionByName(edges.select(*v, F.col("b").alias("a"), F.col("a").alias("b"), "like", "short"))
    ranks = keys.select(*v, F.col("key"), "rank")
    both = stored(both.join(ranks.select(*v, F.col("key").alias("a"), F.col("rank").alias("ra")), [*v, "a"]).join(ranks.select(*v, F.col("key").alias("b"), F.col("rank").alias("rb")), [*v, "b"]))
    open_, centres = both, None
    while True:
        top = open_.groupBy(*v, "a", "ra").agg(F.max("rb").alias("best")).where("ra > best").select(*v, F.col("a").alias("centre"))
        top = stored(top)
        centres = top if centres is None else centres.unionByName(top)
        done = stored(open_.join(top.withColumnRenamed("centre", "a"), [*v, "a"], "left_semi").select(*v, F.col("b").alias("key")).unionByName(top.withColumnRenamed("centre", "key")).distinct())
        open_ = stored(open_.join(done.withColumnRenamed("key", "a"), [*v, "a"], "left_anti").join(done.withColumnRenamed("key", "b"), [*v, "b"], "left_anti"))
        if open_.isEmpty():
            break
    to = both.join(centres.withColumnRenamed("centre", "b"), [*v, "b"], "left_semi").join(centres.withColumnRenamed("centre", "a"), [*v, "a"], "left_anti")
    choice = to.groupBy(*v, "a").agg(F.array_sort(F.collect_list(F.struct((-F.col("like")).alias("l"), "short", "rb", "b")), lambda x, y: F.when(x["l"] + x["short"] * 0.02 < y["l"] + y["short"] * 0.02, -1).when(x["l"] + x["short"] * 0.02 > y["l"] + y["short"] * 0.02, 1).when(x["rb"] > y["rb"], -1).otherwise(1)).alias("c"))
    first, second = F.col("c")[0], F.try_element_at("c", F.lit(2))
    vague = F.col("a").rlike("(^| )[^ ]( |$)") | ((first["short"] > 0) & (second["short"] > 0))
    alike = second.isNotNull() & vague & (second["l"] - first["l"] < MARGIN)
    chosen = choice.select(*v, F.col("a").alias("key"), F.when(alike, F.col("a")).otherwise(first["b"]).alias("centre"))
    return keys.select(*v, "key").join(chosen, [*v, "key"], "left").withColumn("centre", F.coalesce("centre", "key"))


def link_names(names: DataFrame, *, people: list[str]) -> DataFrame:
    """(domain, name, side, key, centre) of every distinct name: names of one domain, side and centre mean the same.

    names: domain, name; repeated rows count as use. people: the domains whose names are those of persons. Null names and
    domains take no part, nor do names without a letter or digit. An empty table gives an empty result."""
    used = names.where("domain IS NOT NULL AND name IS NOT NULL").groupBy("domain", "name").agg(F.count("*").alias("n"))
    full = stored(keyed(used.repartition("name"), people))
    keys = full.groupBy("domain", "side", "key").agg(F.sum("n").alias("n"))
    longer = lambda least: F.size(F.filter(F.split("key", " "), lambda w: F.length(w) >= least))
    common = common_words(keys)
    keys = stored(keys.repartition("key"))
    edges = stored(verified(candidates(keys, common), common))
    v = ["domain", "side", "key"]
    degree = edges.select("domain", "side", F.explode(F.array("a", "b")).alias("key")).groupBy(v).agg(F.count("*").alias("degree"))
    keys = stored(keys.join(degree, v, "left").withColumn("rank", F.struct(longer(3).alias("r0"), longer(5).alias("r1"), F.coalesce("degree", F.lit(0)).alias("r2"), F.length("key").alias("r3"), F.col("n").alias("r4"), F.col("key").alias("r5"))))
    return full.join(stars(keys, edges), ["domain", "side", "key"])


def linked_pairs(links: DataFrame) -> DataFrame:
    """(domain, name_a, name_b), name_a < name_b by code points, of every two names of one centre.

    The pairs grow with the square of a centre's names; links themselves do not. A centre of many names is cut into parts, each of which meets the whole."""
    on = ["domain", "side", "centre"]
    hot = links.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > PAIRED).select(*on, F.ceil(F.col("_n") / PAIRED).cast("int").alias("_parts"))
    a, b = (links.select(*on, F.col("name").alias(n)).join(hot, on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for n in ("name_a", "name_b"))
    a = a.withColumn("_part", F.pmod(F.xxhash64("name_a"), F.col("_parts").cast("long")).cast("int")).drop("_parts")
    b = b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return a.join(b, [*on, "_part"]).where("name_a < name_b").select("domain", "name_a", "name_b")
