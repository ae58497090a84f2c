"""What is known about the writing of names of teams and people: folding, marks of a side, likeness of words and names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Words and letters around a club's name that do not tell clubs apart.
AFFIXES = frozenset("fc sc ac sk cf afc bc bk kk club basket bball basketball fk nk if".split())
#: Marks of women's and reserve sides.
WOMEN = frozenset("w women woman womens ladies lady fem femenino feminine frauen dames".split())
RESERVES = frozenset("ii b res reserve reserves".split())
#: Abbreviations that begin like more than one common word of club names.
SHORT = {"un": "union", "utd": "united"}
#: Everyday forms of given names.
NICKNAMES = {
    "alexander": "alex sandy sasha xander lex al", "alexandra": "alex sandra sasha lexi", "andrew": "andy drew", "anthony": "tony ant", "antonia": "toni", "barbara": "barb babs",
    "benjamin": "ben benny benji", "catherine": "cathy kate katie kathy cat", "charles": "charlie chuck chas", "christopher": "chris kit topher", "christina": "chris tina chrissy",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dorothy": "dot dolly dottie", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie bess lisa",
    "eugenia": "zhenya genia", "eugene": "gene", "frances": "fran fanny", "francesca": "fran chesca frankie", "francis": "frank fran", "frederick": "fred freddie", "gabriel": "gabe gab",
    "george": "georgie", "gregory": "greg", "hannah": "anna hanna annie", "harold": "harry hal", "henry": "harry hank", "isabella": "bella izzy isa belle", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "john": "jack johnny jon", "jonathan": "jon jonny", "joseph": "joe joey jo", "joshua": "josh", "katherine": "kate kathy katie kat kitty", "kenneth": "ken kenny", "lawrence": "larry",
    "leonard": "leo len lenny", "margaret": "maggie peggy meg marge greta", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nat nate", "nicholas": "nick nico nicky", "oliver": "ollie olly",
    "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron",
    "samuel": "sam", "stephen": "steve", "susan": "sue susie", "theodore": "ted theo teddy", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "valentina": "valya tina", "veronica": "nika ronnie vera",
    "victoria": "vicky tori vic", "vincent": "vince", "william": "bill will billy willy liam", "yevgenia": "zhenya genia", "yevgeny": "zhenya", "zachary": "zach zack zac",
}
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})
_SOUNDS = [("kh", "h"), ("ph", "f"), ("c", "k"), ("y", "j"), ("w", "v"), ("q", "k")]


def fold(text: str) -> str:
    """Lower case without accents; words run together at a capital are parted; dotted letters become one word."""
    text = re.sub(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", " ", unicodedata.normalize("NFC", text))
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().translate(_LETTERS)
    return re.sub(r"\b([a-z])\.\s?([a-z])\.(?![a-z])", r"\1\2 ", text)


@lru_cache(200_000)
def sound(word: str) -> str:
    """One spelling for letters that stand for each other in transliterations."""
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return word


_NICK: dict[str, frozenset] = {}
for _full, _short in NICKNAMES.items():
    for _w in [_full, *_short.split()]:
        _NICK[sound(_w)] = _NICK.get(sound(_w), frozenset()) | {_full}


@lru_cache(200_000)
def parse(name: str, person: bool) -> tuple[str, tuple[str, ...]]:
    """(mark of the side, words in one spelling). Marks: '' or a combination of w, r and u with the age. A person has no mark."""
    words = re.findall(r"[^\W_]+", fold(name))
    if person:
        return "", tuple(sound(w) for w in words)
    mark, rest, i = set(), [], 0
    while i < len(words):
        w = words[i]
        if m := re.fullmatch(r"(?:u|under)(\d\d)", w):
            mark.add("u" + m[1])
        elif w in ("u", "under") and i + 1 < len(words) and re.fullmatch(r"\d\d", words[i + 1]):
            mark.add("u" + words[i + 1])
            i += 1
        elif w in WOMEN and len(words) > 1:
            mark.add("w")
        elif w in RESERVES and len(words) > 1:
            mark.add("r")
        else:
            rest.append(w)
        i += 1
    core = [w for w in rest if w not in AFFIXES] or rest
    return "".join(sorted(mark)), tuple(sound(SHORT.get(w, w)) for w in core)


def side_marks(league: str | None) -> str:
    """Marks that a league's name puts on the sides that play in it."""
    if not league:
        return ""
    mark = set()
    words = re.findall(r"[^\W_]+", fold(league))
    for i, w in enumerate(words):
        if m := re.fullmatch(r"(?:u|under)(\d\d)", w):
            mark.add("u" + m[1])
        elif w in ("u", "under") and i + 1 < len(words) and re.fullmatch(r"\d\d", words[i + 1]):
            mark.add("u" + words[i + 1])
        elif w in WOMEN:
            mark.add("w")
        elif w in ("reserves", "reserve", "res"):
            mark.add("r")
    return "".join(sorted(mark))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


@lru_cache(1_000_000)
def word_likeness(a: str, b: str) -> float:
    """0 (another word) to 1; typos by edits allowed for the length, abbreviations, initials and nicknames."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.9 if b[0] == a else (0.85 if any(full[0] == a or sound(full)[0] == a for full in _NICK.get(b, ())) else 0.0)
    if _NICK.get(a, frozenset()) & _NICK.get(b, frozenset()):
        return 0.95
    if len(a) >= 3 and b.startswith(a):
        return 0.93
    if len(a) <= 5 and a[0] == b[0] and len(a) < len(b) and not re.search("[aeiou]", a[1:]):
        it = iter(b)
        if all(ch in it for ch in a):
            return 0.93
    most = 2 if len(b) >= 8 else 1 if len(b) >= 4 else 0
    if most and len(a) >= 3 and (d := edits(a, b, most)) <= most:
        return 1 - d / (2 * len(b)) - 0.03 * d
    if len(a) >= 5 and len(b) - len(a) >= 2 and edits(a, b[: len(a)], 1) <= 1:
        return 0.75
    return 0.0


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...], common: frozenset | set = frozenset()) -> tuple[float, int]:
    """(likeness, unmatched words of the longer name). The mean over the words of the shorter name of its best partner, each
    partner used once; 0 if one of its words has none, or if no word that is not common was matched beyond its initial."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0, len(b)
    free = list(b)
    total, telling, missing = 0.0, False, 0
    for x in sorted(a, key=len, reverse=True):
        best, at = 0.0, -1
        for i, y in enumerate(free):
            if (s := word_likeness(x, y)) > best:
                best, at = s, i
        if at < 0 and len(x) >= 8 and len(free) > 1:
            for i in range(len(free)):
                for j in range(len(free)):
                    if i != j and (s := word_likeness(x, free[i] + free[j])) >= 0.8:
                        best, at = s, (i, j)
        if at == -1:
            return 0.0, len(free)
        used = [free[i] for i in (at if isinstance(at, tuple) else (at,))]
        for y in used:
            free.remove(y)
        telling |= len(x) >= 3 and x not in common and not all(y in common for y in used)
        total += best
    return (total / len(a) if telling else 0.0), len(free) + missing
