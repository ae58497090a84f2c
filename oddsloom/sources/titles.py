"""Titles of markets, as people write them, to market, period, rank and side, as columns: ordered rules, the first that fits holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OT = r"[\s(]+incl(?:uding)?\.?\s*overtime"
_HANDICAP = r"(?:asian\s+)?handicap"
#: How titles name the parts of a game.
_HALVES, _QUARTERS = {"H1": r"1st\.?\s*half", "H2": r"2nd\.?\s*half"}, {"Q1": r"1st\.?\s*quarter", "Q2": r"2nd\.?\s*quarter", "Q3": r"3rd\.?\s*quarter", "Q4": r"4(?:th|rt)\.?\s*quarter"}
#: Titles of two-way sports that are no plain market.
TWO_WAY_SKIPPED = [
    r"1x2", r"over-exact-under", r"odd[/\s]?even", r"home\s*team\s*total", r"away\s*team\s*total", r"hometeam\s*total", r"awayteam\s*total", r"\bplayer\b", r"assists\b", r"rebounds\b", r"\bsteals\b", r"\bblocks\b", r"3-point field goals",
    r"double double", r"triple double", r"first point scorer", r"race to \d+", r"lead by \d+", r"competitor [12] to lead", r"winning margin", r"halftime\s*/\s*fulltime", r"will there be overtime", r"highest scoring quarter",
    r"lowest scoring quarter", r"win all quarters", r"win both halves", r"to win 1st (?:half|quarter) and", r"^draw no bet$", r"&\s*(?:total|handicap|1st (?:half|quarter) total|1x2)", r"last point", r"first free throw", r"point range",
    r"max(?:imum)? consecutive points", r"\{?\$competitor",
]
#: The same of soccer, where asterisks tell markets apart.
SOCCER_SKIPPED = [
    r"\*\*\*$", r"^handicap\(1x2\)$", r"^2nd\s*half", r"^second\s*half", r"^2nd\.\s*half", r"^draw no bet", r"^double chance", r"^both teams to score", r"^correct score", r"^halftime", r"halftime\s*/\s*fulltime", r"^matchbet", r"\s&\s", r"\sand\s",
    r"\sor\s", r"\s/\s", r"\bgoalscorer\b", r"clean\s+sheet", r"\b(?:assists|shots|passes|tackles|saves|cards)\b", r"\bbookings?\b", r"\b(?:exact|odd[/\s]?even)\b", r"multigoals", r"\brange\b", r"who\s+scores", r"\d+\s*minutes",
    r"^cornerbet", r"corner\s*matchbet", r"\bfirst\s*corner\b|\blast\s*corner\b", r"1st\.?\s*corner", r"\{?\$competitor",
]


def _two_way_rules() -> list[tuple]:
    """(pattern, market, period, rank, ways, submarket, team): with overtime before without it; the latter is second choice where both exist."""
    rules = [
        (r"^winner\s*\(incl\.?\s*overtime\)", "moneyline", "FT", 0), (rf"^total points{_OT}", "total", "FT", 0), (rf"^{_HANDICAP}{_OT}", "spread", "FT", 0), (r"^total points\s*\(regular time\)$", "total", "FT", 1),
    ]
    for period, part in (_HALVES | _QUARTERS).items():
        late = period == "H2"
        if late:
            rules += [(rf"^{part}\s*-\s*draw no bet\s*\(ot\)", "moneyline", period, 0), (rf"^{part}\s*-\s*{_HANDICAP}{_OT}", "spread", period, 0), (rf"^{part}\s*-\s*total\s*\(incl\.?\s*overtime\)", "total", period, 0)]
        rank, end = (1, r"\s*$") if late else (0, "")
        total = r"total\s*points" if period.startswith("Q") else "total"
        rules += [(rf"^{part}\s*-\s*draw no bet{end}", "moneyline", period, rank), (rf"^{part}\s*-\s*{_HANDICAP}\s*$", "spread", period, rank), (rf"^{part}\s*-\s*{total}{end}", "total", period, rank)]
    return [(*r, 2, None, None) for r in rules]


def _soccer_rules() -> list[tuple]:
    out = [(r"^(?:1x2|main result)$", "moneyline", "FT", 0, 3, None, None), (r"^1st half result$", "moneyline", "H1", 0, 3, None, None)]
    for period, lead, total in (("FT", "", "total goals"), ("H1", r"1st\s*half\s*-\s*", r"1st\.?\s*half\s+total\s+goals")):
        out += [(f"^{lead}handicap$", "spread", period, 0, 2, None, None), (f"^{total}$", "total", period, 0, 2, None, None), (rf"^{lead}total corners\*$", "total", period, 0, 2, "corners", None)]
        out += [(f"^{lead}{side} team total$", "team_total", period, 0, 2, None, side) for side in ("home", "away")]
    return [*out, (r"^handicap of corner\*$", "spread", "FT", 0, 2, "corners", None), (r"^1st\s*half\s*-\s*corner\s*handicap\s+hcp=[+-]?\d+(?:\.\d+)?$", "spread", "H1", 0, 2, "corners", None)]


def _class(market: Column | str, period: Column | str, rank: Column | int = 0, ways: Column | int = 2, submarket: str | None = None, team: str | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(market).alias("market_type"), lit(period).alias("period"), lit(rank).alias("rank"), lit(ways).alias("n_way"), F.lit(submarket).cast("string").alias("submarket"), F.lit(team).cast("string").alias("team_side"))


def _chain(cases: list[tuple[Column, Column]]) -> Column:
    """One CASE over the pairs of condition and value; null if none holds."""
    out = F
    for cond, value in cases:
        out = out.when(cond, value)
    return out


def _bound(norm: Column, f) -> Column:
    """f(norm) with the text worked out once, not once a rule."""
    return F.transform(F.array(norm), f)[0]


def _first(norm: Column, skipped: list[str], rules: list[tuple]) -> Column:
    plain = ~norm.rlike("|".join(f"(?:{s})" for s in skipped))
    return _bound(norm, lambda n: F.when(n.isNotNull(), _chain([(n.rlike(pattern), _class(market, period, rank, ways, submarket, team)) for pattern, market, period, rank, ways, submarket, team in rules]))) if not skipped else F.when(plain, _first(norm, [], rules))


def normal_title(title: Column, *, keep_asterisks: bool = False) -> Column:
    t = F.regexp_replace(F.trim(F.lower(title)), r"\s+", " ")
    return t if keep_asterisks else F.trim(F.regexp_replace(t, r"\*", ""))


def strict_class(title: Column, sport: Column) -> Column:
    """Class of a detail page's title (market_type, period, rank, n_way, submarket, team_side), or null: out of scope. Tennis has no such pages."""
    two = _first(normal_title(title), TWO_WAY_SKIPPED, _two_way_rules())
    return F.when(sport == "soccer", _first(normal_title(title, keep_asterisks=True), SOCCER_SKIPPED, _soccer_rules())).when(sport == "basketball", two)


def period_of(norm: Column) -> Column:
    """Period by the words of a title, quarters before halves and the second before the first; else the whole game."""
    t = F.regexp_replace(norm, "[^a-z0-9]+", " ")
    rules = [(rf"\b(?:{n})\b.*\bquarter\b|\b{q.lower()}\b", q) for q, n in (("Q4", "4th|4rt|fourth"), ("Q3", "3rd|third"), ("Q2", "2nd|second"), ("Q1", "1st|first|1"))]
    rules += [(rf"\b(?:{n})\b.*\b(?:half|period)\b", h) for h, n in (("H2", "2nd|second"), ("H1", "1st|first|1"))] + [(r"\bhalf ?time\b", "H1")]
    return _bound(t, lambda x: F.coalesce(_chain([(x.rlike(pattern), F.lit(period)) for pattern, period in rules]), F.lit("FT")))


def permissive_class(title: Column, sport: Column) -> Column:
    """The same for the search for anomalies: any handicap, total or winner of a two-way sport, plain 1x2, and half/full combos."""
    norm = normal_title(title)
    combo = lambda more: norm.rlike(r"^(?:half\s*time\s*/\s*full\s*time|ht\s*/\s*ft)\b") & ~norm.rlike(rf"\band\b|&|correct|exact|\btotal\b|score{more}")
    period, rank = period_of(norm), F.when(norm.contains("regular time"), 1).otherwise(0)
    skipped = norm.rlike("|".join(f"(?:{s})" for s in TWO_WAY_SKIPPED))
    two = (
        F.when(combo(""), _class("htft", "FT")).when(norm.contains("1x2") & ~norm.rlike(r"handicap|&|\band\b|correct|total"), _class("moneyline", period, 0, 3)).when(skipped, F.lit(None))
        .when(norm.contains("handicap"), _class("spread", period, rank)).when(norm.contains("total"), _class("total", period, rank)).when(norm.rlike("winner|draw no bet|moneyline"), _class("moneyline", period, rank))
    )
    return F.when(sport == "soccer", F.when(combo("|goals"), _class("htft", "FT")).otherwise(strict_class(title, sport))).when(sport == "basketball", two)


def named_market(name: Column) -> Column:
    """Class (market_type, n_way) of a feed's market name, whole games only: names are told without circled and small figures."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, "[①-⓿⁰-ₜ⅐-↏]", ""))), r"\s+", " "))
    row = lambda m, n: F.struct(F.lit(m).alias("market_type"), F.lit(n).alias("n_way"))
    return (
        F.when(t.rlike("half|quarter| set|\\{"), F.lit(None)).when(t == "full time result", row("moneyline", 3)).when(t.isin("winner", "winner (ot)", "match winner", "money line", "result"), row("moneyline", 2))
        .when(t.isin("total", "total (ot)", "total games"), row("total", 2)).when(t.isin("handicap", "handicap (ot)", "asian handicap"), row("spread", 2))
    )


#: Parts of names that make a market a combination or another one.
COMBINED = ["exact", "correct", " or ", "both", "goals", "score", "/1st", "- 1st", "handicap", "total", "team"]


def _plain(name: Column) -> tuple[Column, Column]:
    n = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    mixed = F.lit(False)
    for word in COMBINED:
        mixed = mixed | n.contains(word)
    return n, mixed


def half_full_name(name: Column) -> Column:
    n, mixed = _plain(name)
    return ~mixed & ((n.contains("half") & n.contains("time") & n.contains("full")) | n.contains("halftime/fulltime") | n.startswith("ht/ft"))


def first_half_name(name: Column) -> Column:
    n, mixed = _plain(name)
    half = n.rlike("1st half|first half|half time|halftime|1st period")
    return ~mixed & ~n.contains("full") & ~n.contains("/") & half & (n.rlike("result|1x2|winner") | n.isin("12 halftime", "1x2 halftime"))
