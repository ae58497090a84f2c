"""All pairs of two sources' fixtures within blocks, without a row a pair: bounds on the likeness of names rule pairs out by whole arrays.

The bounds are never below the likeness, so no pair is lost that could be accepted; those left are scored as arrays, too."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.text import token_set

#: Rows of the first side in a block, pairs held at once, parts of the second side where kickoffs are unknown.
BLOCK_ROWS, PAIRS_AT_ONCE, UNTIMED_PARTS = 2000, 400_000, 8
_SYMBOLS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 /")}
_PAD, _LONGEST, _WORDS = len(_SYMBOLS), 63, 8
BLOCK = ["_kind", "sport", "_bk", "_part"]


@lru_cache(200_000)
def _text(norm: str) -> str:
    return " ".join(sorted(set(norm.split())))


class Names:
    """Distinct names, as sets of words, in arrays: length, bag (bits of first and second letters, one of anything else), bits of the words, whether a name
    may be an initialism, whether symbols hold all of it, symbols and their masks, the words' numbers, lengths and places. bound(), sharper() and likeness()
    take arrays of their numbers."""

    def __init__(self, norms: list[str]) -> None:
        self.norms = norms
        text = np.array([_text(n) for n in norms], dtype=str)
        wide = max(1, text.dtype.itemsize // 4)
        code = text.view(np.uint32).reshape(len(text), wide).T
        one, n = np.uint64(1), len(text)
        self.size = (code > 0).sum(axis=0)
        self.bag, self.words, self.masks = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64), np.zeros((n, _PAD + 1), dtype=np.uint64)
        self.symbols, spaces, odd = np.full((n, _LONGEST), _PAD, dtype=np.uint8), np.zeros(n, dtype=int), np.zeros(n, dtype=bool)
        word, table, every = np.zeros(n, dtype=np.uint64), np.full(128, _PAD, dtype=np.uint8), np.arange(n)
        for c, k in _SYMBOLS.items():
            table[ord(c)] = k
        for at in range(wide + 1):
            c = code[at] if at < wide else np.zeros(n, dtype=np.uint32)
            inside, known = c > 0, table[np.minimum(c, 127)]
            letter = known < 26
            bit = one << known.astype(np.uint64)
            again = (self.bag & bit) != 0
            self.bag |= np.where(letter, np.where(again, bit << np.uint64(26), bit), np.where(inside, one << np.where(c == 32, 62, np.where((c >= 48) & (c <= 57), c + 4, 63)).astype(np.uint64), 0))
            end = ((c == 32) | ~inside) & (word > 0)
            self.words |= np.where(end, one << (word >> np.uint64(40) & np.uint64(63)), 0)
            word = np.where(end | ~inside, 0, (word + c + one) * np.uint64(0x9E3779B97F4A7C15))
            spaces += c == 32
            odd |= inside & (known == _PAD)
            if at < min(wide, _LONGEST):
                self.symbols[:, at] = known
                self.masks[every, known] |= one << np.uint64(at)
        self.masks[:, _PAD] = 0
        self.short, self.fits = (spaces == 0) & (self.size >= 2) & (self.size <= 4), (self.size <= _LONGEST) & ~odd & (spaces < _WORDS)
        self._place_words(text)

    def _place_words(self, text: np.ndarray) -> None:
        """Of each word of the names that fit: its number (or -1), its length, the bits of its place with the blank before it, and that blank's bit alone."""
        known: dict[str, int] = {}
        said = [t.split() if fit else [] for t, fit in zip(text.tolist(), self.fits)]
        wide = max([1, *map(len, said)])
        self.word, self.long = np.full((wide, len(said)), -1), np.zeros((wide, len(said)), dtype=int)
        for n, words in enumerate(said):
            for k, w in enumerate(words):
                self.word[k, n], self.long[k, n] = known.setdefault(w, len(known)), len(w)
        one, begin = np.uint64(1), np.zeros(len(said), dtype=np.uint64)
        self.place, self.blank = np.zeros(self.word.shape, dtype=np.uint64), np.zeros(self.word.shape, dtype=np.uint64)
        for k in range(wide):
            there = self.word[k] >= 0
            self.blank[k] = np.where(there & (k > 0), one << begin, 0)
            after = np.where(there, begin + self.long[k].astype(np.uint64) + np.uint64(k > 0), begin)
            self.place[k] = (one << after) - (one << begin)
            begin = after

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At least the likeness: letters that only one name has are no common ones, and what both names say in whole words is in both bags."""
        x, y, a, b = self.bag[i], self.bag[j], self.size[i], self.size[j]
        only_x, only_y = np.bitwise_count(x & ~y).astype(np.int64), np.bitwise_count(y & ~x).astype(np.int64)
        best = 100.0 * (a + b - only_x - only_y) / np.maximum(a + b, 1)
        both = np.minimum(a - only_x, b - only_y)
        whole = 200.0 * both / np.maximum(both + np.minimum(a, b), 1)
        return np.where((a == 0) | (b == 0), 0.0, np.where(self.words[i] & self.words[j] != 0, np.maximum(best, whole), best))

    def sharper(self, i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The likeness itself where symbols hold both names; else the bound."""
        at = np.flatnonzero(self.fits[i] & self.fits[j] & (bound > 0))
        out = bound.copy()
        out[at] = self.likeness(i[at], j[at])
        return out

    def likeness(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """token_set() of all pairs at once; one by one where symbols do not hold a name."""
        pairs, again = np.unique(i.astype(np.int64) * len(self.size) + j, return_inverse=True)
        i, j = np.divmod(pairs, len(self.size))
        out, fit = np.zeros(len(pairs)), self.fits[i] & self.fits[j]
        shared = self.words[i] & self.words[j] != 0
        for lo in range(0, len(pairs), PAIRS_AT_ONCE):
            part = np.arange(lo, min(lo + PAIRS_AT_ONCE, len(pairs)))
            apart, alike = part[fit[part] & ~shared[part]], part[fit[part] & shared[part]]
            x, y = i[apart], j[apart]
            out[apart] = np.where((self.size[x] == 0) | (self.size[y] == 0), 0.0, 200.0 * self._common(x, y) / np.maximum(self.size[x] + self.size[y], 1))
            out[alike] = self._with_shared_words(i[alike], j[alike])
        for k in np.flatnonzero(~fit):
            out[k] = token_set(self.norms[i[k]], self.norms[j[k]])
        return out[again]

    def _common(self, i: np.ndarray, j: np.ndarray, own: np.ndarray | None = None, other: np.ndarray | None = None) -> np.ndarray:
        """Lengths of the longest common subsequences; own and other: bits of the places that count. A place that does not count is one that is never met."""
        full = (np.uint64(1) << self.size[i].astype(np.uint64)) - np.uint64(1)
        s = full.copy()
        for k in range(int(self.size[j].max(initial=0))):
            u = self.masks[i, self.symbols[j, k]]
            if own is not None:
                u = np.where(other >> np.uint64(k) & np.uint64(1) != 0, u & own, 0)
            u &= s
            s = (s + u) | (s - u)
        return self.size[i] - np.bitwise_count(s & full).astype(np.int64)

    def _with_shared_words(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """token_set() where words may be shared. They stand before the rest in both texts compared, so they are common in full."""
        wide = len(self.word)
        of = lambda x: ([self.word[k][x] for k in range(wide)], [np.zeros(len(x), dtype=bool) for _ in range(wide)])
        (a, in_b), (b, in_a) = of(i), of(j)
        for p in range(wide):
            for q in range(wide):
                same = (a[p] == b[q]) & (a[p] >= 0)
                in_b[p] |= same
                in_a[q] |= same
        both, rests, places = np.full(len(i), -1), [], []
        for x, words, met in ((i, a, in_b), (j, b, in_a)):
            rest, place = np.full(len(x), -1), np.zeros(len(x), dtype=np.uint64)
            for k in range(wide):
                long, left = self.long[k][x], (words[k] >= 0) & ~met[k]
                place |= np.where(left, np.where(rest < 0, self.place[k][x] & ~self.blank[k][x], self.place[k][x]), 0)
                rest += np.where(left, long + 1, 0)
                if x is i:
                    both += np.where(met[k], long + 1, 0)
            rests.append(np.maximum(rest, 0))
            places.append(place)
        (x, y), common = rests, self._common(i, j, *places)
        none, both = both < 0, np.maximum(both, 0)
        held = np.where(none, 0, both + 1)  # the shared words and the blank after them
        best = 200.0 * (held + common) / np.maximum(2 * held + x + y, 1)
        best = np.maximum(best, np.maximum(200.0 * both / np.maximum(both + held + x, 1), 200.0 * both / np.maximum(both + held + y, 1)))
        return np.where(~none & ((x == 0) | (y == 0)), 100.0, best)


def blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b (id, sport, start, win, ...), _side 0 and 1, in numbered blocks such that rows of the two sides meet in exactly one block if their
    kickoffs may be compatible: by the window's buckets, or, where one is unknown, everything of the sport."""
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    bucket = F.floor(F.col("start") / F.col("win"))
    timed = a.where("start IS NOT NULL").withColumn("_bk", bucket)
    sizes = timed.groupBy("sport", "_bk").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_n"))
    out = [
        timed.join(sizes, ["sport", "_bk"]).withColumns({"_kind": F.lit(0), "_part": part(F.col("_n")), "_side": F.lit(0)}).drop("_n"),
        b.where("start IS NOT NULL").withColumn("_bk", F.explode(F.array(*[bucket + k for k in (-1, 0, 1)]))).join(sizes, ["sport", "_bk"]).withColumns({"_kind": F.lit(0), "_part": all_of(F.col("_n")), "_side": F.lit(1)}).drop("_n"),
    ]
    for kind, few, many, side in ((1, a.where("start IS NULL"), b, 0), (2, b.where("start IS NULL"), a.where("start IS NOT NULL"), 1)):
        sizes = few.groupBy("sport").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_n"))
        for rows, own, other, at in ((few, part, all_of, side), (many, all_of, part, 1 - side)):
            rows = rows.join(F.broadcast(sizes), "sport").withColumn("_one", own(F.col("_n"))).withColumn("_bk", other(F.lit(UNTIMED_PARTS)))
            out.append(rows.withColumns({"_kind": F.lit(kind), "_part": F.col("_one"), "_side": F.lit(at)}).drop("_n", "_one"))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def _half_bounds(names: Names, us: np.ndarray, vs: np.ndarray, lifted: float) -> np.ndarray:
    """Halves (so that sums fit a byte) of bound() of all names us with all vs, of short names at least `lifted`. What the bound is made of, besides the letters
    in common, are few kinds of names, so it is looked up in a table of kinds by letters in common."""
    bags = lambda x: np.bitwise_count(names.bag[x]).astype(np.int64)
    kinds = lambda x: np.unique(np.stack([names.size[x], bags(x), names.short[x]]), axis=1, return_inverse=True)
    (ku, of_u), (kv, of_v) = kinds(us), kinds(vs)
    letters = int(bags(us).max(initial=0)) + 1
    bag, words, row = names.bag[vs], names.words[vs], (of_v.ravel() * (2 * letters)).astype(np.int32)
    c, (b, more_b, short_b) = np.arange(letters)[None, :], (x[:, None] for x in kv)
    m = np.empty((len(us), len(vs)), dtype=np.uint8)
    for k, (a, more_a, short_a) in enumerate(ku.T):
        best = 100.0 * (a + b - more_a - more_b + 2 * c) / np.maximum(a + b, 1)
        both = np.minimum(a - more_a + c, b - more_b + c)
        whole = np.maximum(best, 200.0 * both / np.maximum(both + np.minimum(a, b), 1))
        said = np.where(((a == 0) | (b == 0))[..., None], 0.0, np.stack([best, whole], axis=-1))
        said = np.ceil(np.maximum(said, np.where(short_b | short_a, lifted, 0)[..., None]).clip(0, 200))
        table = (said.astype(np.uint8) // 2).ravel()
        for n in np.flatnonzero(of_u.ravel() == k):
            u = us[n]
            at = np.bitwise_count(bag & names.bag[u]) << np.uint8(1) | (words & names.words[u] != 0)
            np.take(table, row + at, out=m[n])
    return m


def _all_pairs(names: Names, home: np.ndarray, away: np.ndarray, a: np.ndarray, b: np.ndarray, floor: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows a and b whose bounds reach floor (the mean as they are, with the sides changed, and what a short name is lifted to), by a matrix of
    the bounds of all names of a with all of b."""
    us, at = np.unique(np.concatenate([home[a], away[a]]), return_inverse=True)
    vs, bt = np.unique(np.concatenate([home[b], away[b]]), return_inverse=True)
    if len(us) > len(vs):
        j, i = _all_pairs(names, home, away, b, a, floor)
        return i, j
    ah, aa, bh, ba = at[: len(a)], at[len(a) :], bt[: len(b)], bt[len(b) :]
    m = _half_bounds(names, us, vs, floor[2])
    out: tuple[list, list] = ([], [])
    for lo in range(0, len(a), 64):
        h, w = m[ah[lo : lo + 64]], m[aa[lo : lo + 64]]
        same, turned = np.take(h, bh, axis=1), np.take(h, ba, axis=1)
        same += np.take(w, ba, axis=1)
        turned += np.take(w, bh, axis=1)
        i, j = np.nonzero((same >= floor[0] - 2) | (turned >= floor[1] - 2))
        out[0].append(a[lo + i])
        out[1].append(b[j])
    return np.concatenate(out[0]), np.concatenate(out[1])


def candidates(f: pd.DataFrame, keep: Callable[[Names, tuple, np.ndarray], tuple[np.ndarray, ...]], floor: tuple[float, float, float]) -> tuple[np.ndarray, ...]:
    """Row numbers of the pairs of whole blocks (sorted by BLOCK and _side) that are left by keep() and, where a kickoff is unknown, before it by floor; then what
    else keep() says of them."""
    codes, flat = pd.factorize(np.concatenate([f["n_home"].fillna("").to_numpy(object), f["n_away"].fillna("").to_numpy(object)]))
    names, home, away = Names(list(flat)), codes[: len(f)], codes[len(f) :]
    kind, start, win, side = f["_kind"].to_numpy(), f["start"].to_numpy(float), f["win"].to_numpy(float), f["_side"].to_numpy()
    group = f.groupby(BLOCK, sort=False).ngroup().to_numpy()
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    none = np.zeros(0, dtype=int)
    left, right, held, took = [none], [none], 0, []

    def sift() -> None:
        i, j = np.concatenate(left), np.concatenate(right)
        near = (kind[i] > 0) | (np.abs(start[i] - start[j]) <= win[i])
        i, j = i[near], j[near]
        ok, *said = keep(names, (home[i], away[i], home[j], away[j]), kind[i] > 0)
        took.append((i[ok], j[ok], *said))

    for at, end in zip(edges, [*edges[1:], len(f)]):
        cut = at + int((side[at:end] == 0).sum())
        if at < cut < end and kind[at] > 0:
            i, j = _all_pairs(names, home, away, np.arange(at, cut), np.arange(cut, end), floor)
            for lo in range(0, len(i), PAIRS_AT_ONCE):
                left, right, held = [*left, i[lo : lo + PAIRS_AT_ONCE]], [*right, j[lo : lo + PAIRS_AT_ONCE]], held + min(PAIRS_AT_ONCE, len(i) - lo)
                if held >= PAIRS_AT_ONCE:
                    sift()
                    left, right, held = [none], [none], 0
        elif at < cut < end:
            step = max(1, PAIRS_AT_ONCE // (end - cut))
            for lo in range(at, cut, step):
                hi = min(lo + step, cut)
                left.append(np.repeat(np.arange(lo, hi), end - cut))
                right.append(np.tile(np.arange(cut, end), hi - lo))
                held += len(left[-1])
                if held >= PAIRS_AT_ONCE:
                    sift()
                    left, right, held = [none], [none], 0
    if held or not took:
        sift()
    return tuple(np.concatenate(t) for t in zip(*took))


def whole_blocks(batches):
    """The rows of sorted batches, cut only between blocks."""
    rest = None
    for f in batches:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        last = (f[BLOCK] == f[BLOCK].iloc[-1]).all(axis=1).to_numpy()
        if last.all():
            rest = f
            continue
        yield f[~last].reset_index(drop=True)
        rest = f[last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest
