"""Quality of texts: statistics of each document and how far out they lie among the texts of its language (problem 9).

One pass over the whole texts gives the statistics. Each is ranked exactly within its language (range-partitioned sort with
partition offsets), which gives its empirical tail probability on the side where lists, tables and junk lie. The negative
logarithms of the tails are joined to one outlier score by weights of the language, fitted to weak labels: the texts in which
the share of running sentences is beyond doubt. The score decides. A rank alone cannot, as the tail of a text depends on how much
junk its language holds, and on copies: the weights and the intercept take that up.

The score of a text is positive where it is no prose. A language whose labels are all of one kind is of that kind throughout."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.logistic import fit_logistic
from oddsloom.plans.materialize import table as stored
from oddsloom.plans.ranges import ranks

#: The statistics and the side on which junk lies.
SIDES = {"words": "low", "mean_word": "both", "symbols": "high", "digits": "high", "ended_lines": "low", "common": "low", "running": "low"}
#: Least share of common words in a running sentence, where the list of the language has about 40 words; of Russian, which
#: inflects and has no articles, such a list covers less.
LEAST_COMMON, LEAST_COMMON_OF = 0.12, {"ru": 0.07}
#: A line or piece of running text consists of letters at least to this share (blanks aside), and of digits at most to that.
LEAST_LETTERS, MOST_DIGITS = 0.7, 0.15
PIECE = 240
#: Weak labels: a share of running characters below the first is no prose, above the second prose, between them unknown.
LABELS = 0.35, 0.65
#: The weights are fitted to at most about so many labelled texts of each kind and language, drawn by a hash of the identifier.
LABELLED = 4_000
#: The list of common words goes to every executor; a longer one is an error.
MOST_COMMON_WORDS = 100_000
#: Cells of a table hold at most so many words on average.
MOST_CELL_WORDS = 3.5

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LETTERS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")
_ENDED = re.compile(r"[.!?…:;。！？][\"'”»)\]]*\s*$")
_CELL = re.compile(r"\t+|\s{2,}|\s*\|\s*|\s*;\s*|,(?=\S)")
_ITEM = re.compile(r"\s*(?:[-*•·–]|\(?\d{1,4}[.)])\s+")
_RECORD = re.compile(r"\s*[\w ]{1,20}:\s*\S*(?:\s+\S+){0,3}\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…;])\s+")


def _pieces(paragraph: str):
    """A paragraph in pieces of about a sentence or two, so that a long one is judged part by part."""
    held = ""
    for part in _SENTENCE.split(paragraph):
        if held and len(held) + len(part) > PIECE:
            yield held
            held = ""
        while len(part) > PIECE:
            cut = part.rfind(" ", PIECE // 2, PIECE)
            cut = cut if cut > 0 else PIECE
            yield part[:cut]
            part = part[cut:]
        held = f"{held} {part}" if held else part
    if held:
        yield held


def _tabular(line: str) -> bool:
    """At least three cells of few words each."""
    cells = [c for c in _CELL.split(line) if c.strip()]
    return len(cells) >= 3 and len(line.split()) <= MOST_CELL_WORDS * len(cells)


def _paragraphs(text: str):
    """Lines that follow each other without a blank one, joined. Lines of tables and records are left out, so are items of
    lists that are no whole sentences, and groups of lines that are neither wrapped nor end like sentences."""
    held: list[str] = []
    for line in [*text.split("\n"), ""]:
        item = _ITEM.match(line)
        if line.strip() and not item and not _RECORD.match(line) and not _tabular(line.strip()):
            held.append(line)
            continue
        if held and not _listed(held):
            yield " ".join(held)
        held = []
        if item and _ENDED.search(line) and line[item.end() :][:1].isupper():
            yield line[item.end() :]


def _listed(lines: list[str]) -> bool:
    """Many short lines of uneven length, hardly one of which ends a sentence: a list without marks."""
    sizes = sorted(len(x.strip()) for x in lines)
    if len(lines) < 4 or sizes[len(sizes) // 2] > 50 or sizes[-1] > 90:
        return False
    even = sum(n >= 0.75 * max(sizes) for n in sizes)
    return even < 0.6 * len(lines) and sum(bool(_ENDED.search(x)) for x in lines) < 0.2 * len(lines)


def running_characters(text: str, own: frozenset, least: float, share: float) -> int:
    """Characters, blanks aside, in running sentences: pieces of letters that hold enough common words, or that have a sentence's
    shape in a text that speaks the language (share: of common words in the whole text), or that end a sentence begun before."""
    total = 0
    for paragraph in _paragraphs(text):
        before = carried = False
        for piece in _pieces(paragraph):
            n = sum(map(len, piece.split()))
            raw = _WORD.findall(piece)
            size, words = sum(map(len, raw)), len(raw)
            if not n or words < 3 and not before or size < LEAST_LETTERS * n or len(_DIGIT.findall(piece)) > MOST_DIGITS * n:
                before = False
                continue
            hits = [w for x in raw if (w := x.lower()) in own]
            long_hits, ended = sum(len(w) > 1 for w in hits), bool(_ENDED.search(piece))
            good = len(hits) >= least * words and (long_hits >= 2 or long_hits == 1 and (words <= 8 and ended or least < LEAST_COMMON))
            shape = ended and words >= 4 and share >= least / 2 and sum(x.islower() for x in raw) >= 0.6 * words
            carried = not (good or shape) and before and not carried and words <= 8
            good = good or shape or carried
            total += n * good
            before = good and not ended
    return total


def languages_of(common: dict[str, frozenset]) -> dict[str, tuple[str, ...]]:
    """Of each common word the languages that list it."""
    out: dict[str, tuple[str, ...]] = {}
    for lang in sorted(common):
        for w in common[lang]:
            out[w] = (*out.get(w, ()), lang)
    return out


def text_statistics(text: str | None, common: dict[str, frozenset], index: dict[str, tuple[str, ...]] | None = None) -> tuple:
    """(language by its common words or 'und', words, mean_word, symbols, digits, ended_lines, common, running). index: languages_of(common)."""
    text = text or ""
    solid = sum(map(len, text.split()))
    if not solid:
        return "und", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    index = languages_of(common) if index is None else index
    bare = _TAG.sub(" ", text)
    words = _WORD.findall(bare.lower())
    hits: dict[str, int] = {}
    for w in words:
        for lang in index.get(w, ()):
            hits[lang] = hits.get(lang, 0) + 1
    lang = max(sorted(hits), key=hits.get) if hits else "und"
    letters, digits = sum(map(len, _LETTERS.findall(text))), len(_DIGIT.findall(text))
    least = LEAST_COMMON_OF.get(lang, LEAST_COMMON)
    lines = [x for x in text.split("\n") if x.strip()]
    share = hits.get(lang, 0) / max(len(words), 1)
    running = running_characters(bare, common.get(lang, frozenset()), least, share)
    return (
        lang, float(len(words)), sum(map(len, words)) / max(len(words), 1), (solid - letters - digits) / solid, digits / solid,
        sum(bool(_ENDED.search(x)) for x in lines) / max(len(lines), 1), share, min(1.0, running / solid),
    )


def quality(documents: DataFrame, common_words: DataFrame, *, ident: str, text: str, lang: str) -> DataFrame:
    """ident, spoken (language by the common words, else the row's lang in lower case, else 'und'), the seven statistics, tail_sum, the
    sum over the statistics of -ln(tail probability within the language), and score, the same with fitted weights and an intercept:
    positive where the text is no prose. A text in none of the listed languages is judged among those of the most frequent one.

    words: number of words. mean_word: their mean length. symbols, digits: shares of the characters that are not blank.
    ended_lines: share of lines that end in a sentence's punctuation. common: share of common words. running: share of the
    characters, blanks aside, in running sentences. Null and blank texts have 0 throughout. Repeated rows are ranked as rows;
    ties share their rank. ident must be unique; rows without it are left out. Other columns are ignored."""
    lists: dict[str, set] = {}
    # a fixed list of a few dozen words a language
    listed = common_words.select("lang", "word").where("lang IS NOT NULL AND word IS NOT NULL").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(listed) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    for r in listed:
        lists.setdefault(r["lang"].lower(), set()).add(r["word"].lower())
    shared = documents.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in lists.items()})
    kind = dict(documents.dtypes)[ident]
    names = list(SIDES)

    def run(batches):
        index = languages_of(shared.value)
        for b in batches:
            rows = [text_statistics(t, shared.value, index) for t in b["t"]]
            out = pd.DataFrame(rows, columns=["spoken", *names])
            said = b["l"].fillna("und").str.lower().to_numpy()
            out["spoken"] = np.where(out["spoken"] == "und", said, out["spoken"])
            out.insert(0, "i", b["i"].to_numpy())
            yield out

    work = documents.select(F.col(ident).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("i IS NOT NULL")
    told = stored(work.mapInPandas(run, f"i {kind}, spoken string, " + ", ".join(f"{c} double" for c in names)))
    sizes = {r["spoken"]: r["count"] for r in told.where(F.col("spoken").isin(sorted(lists))).groupBy("spoken").count().collect()}  # a row a listed language
    usual = min(sizes, key=lambda k: (-sizes[k], k), default="und")
    judged = F.when(F.col("spoken").isin(sorted(lists)), F.col("spoken")).otherwise(F.lit(usual))
    told = told.withColumn("judged", judged)
    long = told.select("i", F.explode(F.array(*[F.struct(F.concat_ws("|", F.lit(c), "judged").alias("g"), F.col(c).alias("v")) for c in names])).alias("s")).select("i", "s.g", "s.v")
    ranked = ranks(long, "g", "v", "i", rows=told.count() * len(names))
    low, high = F.col("upto") / F.col("total"), (F.col("total") - F.col("lower")) / F.col("total")
    side = F.split("g", "\\|")[0]
    tail = F.lit(1.0)
    for c, s in SIDES.items():
        tail = F.when(side == c, low if s == "low" else high if s == "high" else F.least(F.lit(1.0), 2 * F.least(low, high))).otherwise(tail)
    far = ranked.select("i", side.alias("c"), (-F.ln(tail)).alias("far")).groupBy("i").agg(*[F.sum(F.when(F.col("c") == c, F.col("far"))).alias(f"far_{c}") for c in names])
    label = F.when(F.col("running") < LABELS[0], 1).when(F.col("running") > LABELS[1], 0)
    both = stored(told.join(far, "i").withColumn("label", label))
    weights = _weights(both, names)
    b = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w[-1]))]) if weights else None
    score = F.lit(-1.0) if b is None else F.coalesce(b[F.col("judged")], F.lit(-1.0))
    for j, c in enumerate(names):
        if weights:
            score = score + F.coalesce(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w[j]))])[F.col("judged")], F.lit(0.0)) * F.col(f"far_{c}")
    total = sum((F.col(f"far_{c}") for c in names), F.lit(0.0))
    return both.select(F.col("i").alias(ident), "spoken", *names, total.alias("tail_sum"), score.alias("score"))


def _weights(both: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """By language the weight of each statistic's tail and the intercept."""
    n = {(r["judged"], r["label"]): r["count"] for r in both.where("label IS NOT NULL").groupBy("judged", "label").count().collect()}
    if not n:
        return {}
    step = F.create_map(*[F.lit(x) for (k, v), m in n.items() for x in (f"{k}|{v}", max(1, m // LABELLED))])
    known = both.where("label IS NOT NULL").where(F.pmod(F.xxhash64("i"), step[F.concat_ws("|", "judged", "label")].cast("long")) == 0)
    known = known.select("i", "judged", "label", *[f"far_{c}" for c in names]).toPandas().sort_values("i", ignore_index=True)
    out = {}
    for lang in sorted({k for k, _ in n}):
        if (lang, 0) not in n or (lang, 1) not in n:
            out[lang] = np.append(np.zeros(len(names)), 1.0 if (lang, 1) in n else -1.0)
            continue
        own = known[known["judged"] == lang]
        if own["label"].nunique() < 2:  # so few of one kind that the draw by hash held none: all of them are taken
            own = both.where((F.col("judged") == lang) & F.col("label").isNotNull()).select("i", "label", *[f"far_{c}" for c in names])
            own = pd.concat([own.where(F.col("label") == v).orderBy(F.xxhash64("i"), "i").limit(LABELLED).toPandas() for v in (0, 1)])
        x, y = own[[f"far_{c}" for c in names]].to_numpy(np.float64), own["label"].to_numpy(np.float64)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        w = fit_logistic((x - mean) / scale, y, ridge=0.01, rounds=100, balanced=False)
        out[lang] = np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())
    return out


def not_prose(scored: DataFrame) -> DataFrame:
    """The documents whose outlier score is positive."""
    return scored.where(F.col("score") > 0)
