"""Times as people and feeds write them, as one instant each (problem 3).

A text is brought to its parts by one of a few patterns; numbers are counts since an epoch, told apart by their size. A time
that names its zone or offset is an instant at once. Any other is wall time in its source's home zone: an as-of join against
the zone's offset intervals, kept in local time and exploded by year, finds the intervals that hold it. One interval gives the
offset; two mean that the time occurs twice, and the earlier instant is taken; none means that it was skipped, and the offset
before the change is used."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes east of UTC of the zone abbreviations that are understood.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "GET": 240,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
#: The first three letters of the months.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Years whose offset intervals are tabulated; wall times of other years are no instants.
YEARS = range(1900, 2101)

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?:Uhr|hrs?|h))?\s*(Z|z|[A-Za-z]{2,4}|(?:UTC|GMT)?[+-]\d{2}:?\d{0,2})?"
_DAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
#: Patterns and the order of their groups: a, b, c are the all-digit date's parts in the order written; n is a month's name.
PATTERNS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|,?\s+){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|ymd"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?(){_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|ymd"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}),?\s+{_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|two"),
    (rf"^{_DAY}(\d{{1,2}})\.?[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|ymd"),
    (rf"^{_DAY}([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_CLOCK}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|ymd"),
    (rf"^{_CLOCK}\s+{_DAY}(\d{{1,2}})\.?\s+([A-Za-z]{{3,9}})\.?\s+(\d{{4}}){_ZONE}$", "$8|$7|$6|$1|$2|$3|$4|$5|$9|ymd"),
]
NUMBER = r"^[+-]?\d+(?:\.\d*)?(?:[eE][+]?\d{1,2})?$"
WRAPPED = r"^/Date\((-?\d+)(?:[+-]\d{4})?\)/$"


def offset_intervals(zone: str) -> list[tuple[int, int, int]]:
    """(start, end, offset) in seconds, start and end in local time since 1970, of a zone over the tabulated years."""
    tz = ZoneInfo(zone)
    at = lambda s: int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)).astimezone(tz).utcoffset().total_seconds())
    first = int((datetime(YEARS[0], 1, 1) - datetime(1970, 1, 1)).total_seconds()) - 2 * 86400
    last = int((datetime(YEARS[-1], 12, 31) - datetime(1970, 1, 1)).total_seconds()) + 2 * 86400
    out, start, off = [], first, at(first)
    for s in range(first, last, 5 * 86400):
        if (now := at(s)) != off:
            lo, hi = s - 5 * 86400, s
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == off else (lo, mid)
            out.append((start + off, hi + off, off))
            start, off = hi, now
    return [*out, (start + off, last + off, off)]


#: There are a few hundred zones in the world; more names than this are no zones, and an error.
MOST_ZONES = 2_000


def zone_table(zones: DataFrame, zone: str) -> DataFrame:
    """(zone, year, spans): the offset intervals of each zone that touch a year. At most one row a zone and year, so its
    size is bounded by the number of zones in the world."""
    spark = zones.sparkSession
    names = [r[0] for r in zones.select(zone).where(F.col(zone).isNotNull()).distinct().limit(MOST_ZONES + 1).collect()]
    if len(names) > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} names of zones")
    rows = []
    for name in names:
        try:
            spans = offset_intervals(name)
        except (KeyError, ValueError, OSError):
            continue
        for year in YEARS:
            a, b = ((datetime(y, 1, 1) - datetime(1970, 1, 1)).total_seconds() for y in (year, year + 1))
            rows.append((name, year, [s for s in spans if s[1] > a - 2 * 86400 and s[0] < b + 2 * 86400]))
    return spark.createDataFrame(rows, f"`{zone}` string, _year int, _spans array<struct<s:long,e:long,o:long>>")


def _try_int(c: Column) -> Column:
    return c.try_cast("int")


def with_instants(df: DataFrame, *, text: str, zone: str, day_first: str, zones: DataFrame | None = None) -> DataFrame:
    """Adds utc_ms (long) and time_status to each row: 'epoch' (a count), 'zoned' (named its zone), 'unique', 'ambiguous',
    'skipped' (wall times), or null with a null utc_ms where the text names no instant: null, empty, a placeholder, not a
    date, a time alone, a date alone, or wall time without a known zone. day_first says how all-digit dates that do not begin with the year are
    written (null: month first). Fractions beyond milliseconds are cut. Two-digit years are of this century.
    Columns named utc_ms or time_status are replaced. zones: a table whose column of that name holds every zone of df, if there is one
    smaller than df.
    A count is seconds, milli-, micro-, nanoseconds since 1970 or 100 ns since year 1 by its size; below 1e8 it is a placeholder."""
    # the row is set aside, so that none of its names can clash with those used here
    kept = [c for c in df.columns if c not in ("utc_ms", "time_status")]
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(text).alias("_text"), F.col(zone).alias("_zone"), F.col(day_first).cast("boolean").alias("_first"))
    t = F.trim(F.regexp_replace(F.col("_text"), "[\\s\u00a0\u202f]+", " "))
    canon = F.lit(None).cast("string")
    for pattern, order in reversed(PATTERNS):
        canon = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, order)).otherwise(canon)
    number = F.when(t.rlike(WRAPPED), F.regexp_extract(t, WRAPPED, 1)).when(t.rlike(NUMBER) & ~canon.isNotNull(), t).try_cast("decimal(38,9)")
    df = df.withColumns({"_c": F.split(canon, "\\|"), "_n": number})
    n = F.col("_n")
    epoch = (
        F.when(n < F.lit(10**8), None).when(n < F.lit(10**11), F.floor(n * 1000)).when(n < F.lit(10**14), F.floor(n))
        .when(n < F.lit(10**17), F.floor(n / 1000)).when(n < F.lit(10**18), F.floor((n - F.lit(621355968000000000).cast("decimal(20,0)")) / 10_000)).when(n < F.lit("10000000000000000000").cast("decimal(20,0)"), F.floor(n / 1_000_000))
    ).cast("long")
    c = lambda i: F.get(F.col("_c"), F.lit(i))
    two = c(9) == "two"
    first = F.coalesce(F.col("_first"), F.lit(False))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(c(1), 1, 3))).cast("int")
    year = F.when(two, _try_int(c(2)) + F.when(F.length(c(2)) == 2, 2000).otherwise(0)).otherwise(_try_int(c(0)))
    month = F.when(two, F.when(first, _try_int(c(1))).otherwise(_try_int(c(0)))).when(named > 0, named).otherwise(_try_int(c(1)))
    day = F.when(two, F.when(first, _try_int(c(0))).otherwise(_try_int(c(1)))).otherwise(_try_int(c(2)))
    half = F.lower(F.substring(c(7), 1, 1))
    h = _try_int(c(3))
    hour = F.when(half.isin("a", "p"), F.when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(h)
    second = F.coalesce(_try_int(c(5)), F.lit(0))
    millis = F.coalesce(_try_int(F.substring(F.rpad(c(6), 3, "0"), 1, 3)), F.lit(0))
    local = F.when(second < 60, F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_make_timestamp_ntz(_y, _mo, _d, _h, _mi, _s))"))
    z = F.upper(c(8))
    digits = F.regexp_replace(F.regexp_replace(z, "^(UTC|GMT)(?=[+-])", ""), ":", "")
    minutes = F.when(digits.rlike("^[+-][0-9]{2,4}$"), (_try_int(F.substring(digits, 2, 2)) * 60 + F.coalesce(_try_int(F.substring(digits, 4, 2)), F.lit(0))) * F.when(digits.startswith("-"), -1).otherwise(1))
    names = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    df = df.withColumns({"_y": year, "_mo": month, "_d": day, "_h": hour, "_mi": _try_int(c(4)), "_s": second.cast("decimal(8,6)"), "_ms": millis, "_off": F.coalesce(minutes, F.try_element_at(names, z)), "_named": F.coalesce(F.length(z) > 0, F.lit(False)), "_year": year, "_epoch": epoch})
    df = df.withColumn("_l", local)
    # the table is bounded by the number of zones and years
    df = df.join(F.broadcast(zone_table(df if zones is None else zones.select(F.col(zone).alias("_zone")), "_zone")), ["_zone", "_year"], "left")
    holding = F.filter("_spans", lambda s: (s["s"] <= F.col("_l")) & (F.col("_l") < s["e"]))
    earlier = F.filter("_spans", lambda s: s["e"] <= F.col("_l"))
    wall = F.when(F.size(holding) >= 1, F.array_max(F.transform(holding, lambda s: s["o"]))).when(F.size(earlier) >= 1, F.element_at(F.array_sort(earlier, lambda a, b: (a["e"] - b["e"]).cast("int")), -1)["o"])
    df = df.withColumn("_wall", wall).withColumn("_hits", F.size(holding))
    zoned = F.col("_named") & F.col("_off").isNotNull() & F.col("_l").isNotNull()
    floating = ~F.col("_named") & F.col("_wall").isNotNull() & F.col("_l").isNotNull()
    utc = F.coalesce(F.col("_epoch"), F.when(zoned, (F.col("_l") - F.col("_off") * 60) * 1000 + F.col("_ms")), F.when(floating, (F.col("_l") - F.col("_wall")) * 1000 + F.col("_ms")))
    status = F.when(F.col("_epoch").isNotNull(), "epoch").when(zoned, "zoned").when(floating, F.when(F.col("_hits") == 1, "unique").when(F.col("_hits") > 1, "ambiguous").otherwise("skipped"))
    return df.select("_row.*", utc.alias("utc_ms"), status.alias("time_status"))
