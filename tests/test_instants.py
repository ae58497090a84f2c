from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from oddsloom.operators.instants import offset_intervals, with_instants

U = timezone.utc
ms = lambda *a: int(datetime(*a, tzinfo=U).timestamp() * 1000)
CASES = [
    ("2025-09-01T13:55:00Z", "UTC", False, ms(2025, 9, 1, 13, 55), "zoned"),
    ("2025-09-01T13:55:00.123456+00:00", "UTC", False, ms(2025, 9, 1, 13, 55) + 123, "zoned"),
    ("20250901T135500Z", None, False, ms(2025, 9, 1, 13, 55), "zoned"),
    ("2025-09-03T03:30:00+09:30", "UTC", False, ms(2025, 9, 2, 18), "zoned"),
    ("2025-09-01T16:15:00+0200", "UTC", False, ms(2025, 9, 1, 14, 15), "zoned"),
    ("2025-09-01 13:55:00 UTC", "Europe/Berlin", True, ms(2025, 9, 1, 13, 55), "zoned"),
    ("2025-09-01 21:00 BST", "Europe/London", False, ms(2025, 9, 1, 20), "zoned"),
    ("01/02/2026 08:30 PM EST", "America/New_York", False, ms(2026, 1, 3, 1, 30), "zoned"),
    ("Fri, 01 May 2026 13:30:00 GMT", "America/New_York", False, ms(2026, 5, 1, 13, 30), "zoned"),
    ("03.09.2025 20:30", "Europe/Berlin", True, ms(2025, 9, 3, 18, 30), "unique"),
    ("01.01.2026 19:00:00 Uhr", "Europe/Berlin", True, ms(2026, 1, 1, 18), "unique"),
    ("01/02/26 11:40", "Asia/Tbilisi", True, ms(2026, 2, 1, 7, 40), "unique"),
    ("01/02/2026 11:40", "America/New_York", False, ms(2026, 1, 2, 16, 40), "unique"),
    ("1 Apr 2026, 15:05", "Asia/Tbilisi", True, ms(2026, 4, 1, 11, 5), "unique"),
    ("Apr 2, 2026 12:45 AM", "America/New_York", False, ms(2026, 4, 2, 4, 45), "unique"),
    ("00:00 Fri 26 Jun 2026", "Europe/London", False, ms(2026, 6, 25, 23), "unique"),
    ("1756734900", "UTC", False, 1756734900000, "epoch"),
    ("1756742400.5", "UTC", False, 1756742400500, "epoch"),
    ("1756736100000", "UTC", False, 1756736100000, "epoch"),
    ("1756742400000000", "UTC", False, 1756742400000, "epoch"),
    ("638923317000000000", "UTC", False, ms(2025, 9, 1, 13, 55), "epoch"),
    ("/Date(1756742400000)/", "UTC", False, 1756742400000, "epoch"),
    ("26.10.2025 02:45", "Europe/Berlin", True, ms(2025, 10, 26, 0, 45), "ambiguous"),
    ("03/08/2026 02:30 AM", "America/New_York", False, ms(2026, 3, 8, 7, 30), "skipped"),
    ("2025-09-01 13:55", None, False, None, None),
    ("2025-09-01 13:55", "No/Where", False, None, None),
] + [(x, "UTC", True, None, None) for x in (None, "", " ", "0", "-1", "TBD", "tba", "null", "N/A", "18:30", "00/00/0000 00:00", "31/02/2026 18:00", "2026-13-05T10:00:00Z", "tomorrow", "2026-01-01", "2026-01-01 25:00", "2026-01-01 10:00 XYZ", "x" * 100_000)]


def test_every_form(spark):
    rows = [(i, t, z, d, "clash", 1) for i, (t, z, d, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, said string, home_zone string, day_first boolean, _l string, utc_ms int")
    got = {r.i: r for r in with_instants(df, text="said", zone="home_zone", day_first="day_first").collect()}
    assert len(got) == len(CASES) and got[0]["_l"] == "clash"
    for i, (t, _, _, want, status) in enumerate(CASES):
        assert (got[i].utc_ms, got[i].time_status) == (want, status), t


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Tbilisi", "Australia/Lord_Howe"])
def test_intervals_agree_with_the_zone(zone):
    spans, tz = offset_intervals(zone), ZoneInfo(zone)
    for k in range(0, 40_000, 7):
        t = datetime(1995, 1, 1, tzinfo=U) + timedelta(hours=7 * k)
        off = int(t.astimezone(tz).utcoffset().total_seconds())
        local = int(t.timestamp()) + off
        assert any(s <= local < e and o == off for s, e, o in spans)


def test_nothing(spark):
    df = spark.createDataFrame([], "said string, z string, d boolean")
    assert with_instants(df, text="said", zone="z", day_first="d").count() == 0
