import datetime as dt
import random

import pytest

from docweave.operators import history as H

SCHEMA = "notice_id long, law_id string, law_name string, category string, revision_date string, effective_date string, revision_number string, received_at timestamp"


def notice(i, law, rev, eff, num, day, name="이름", category="규정"):
    return (i, law, name, category, rev, eff, num, dt.datetime(2020, 1, 1) + dt.timedelta(days=day))


def history(spark, rows):
    out = H.law_history(spark.createDataFrame(rows, SCHEMA))
    return sorted((r.law_id, r.revision_number, r.valid_from, r.valid_to) for r in out.collect())


def brute(rows):
    clean = []
    for i, law, _, _, rev, eff, num, at in rows:
        digits = lambda s: "".join(c if c.isdigit() else " " for c in s or "").split()
        clean.append(("".join((law or "").split()).upper(), rev, eff, int(digits(num)[0]) if digits(num) else None, at, i))
    numbers = {}
    for law, rev, _, num, *_ in clean:
        if num is not None and rev:
            numbers[law, rev] = min(num, numbers.get((law, rev), num))
    last = {}
    for law, rev, eff, num, at, i in sorted(clean, key=lambda r: r[4:]):
        num = numbers.get((law, rev)) if num is None else num
        if law and num is not None:
            d = last.setdefault((law, num), {})
            d |= {k: v for k, v in (("rev", rev), ("eff", eff)) if v}
    starts = {}
    for (law, num), d in last.items():
        if d:
            starts.setdefault(law, []).append((d.get("eff") or d.get("rev"), num))
    out = []
    for law, s in starts.items():
        s.sort()
        out += [(law, num, a, s[k + 1][0] if k + 1 < len(s) else H.END_OF_TIME) for k, (a, num) in enumerate(s)]
    return sorted(out)


def test_spellings_late_and_missing(spark):
    rows = [
        notice(1, "LR-1", "2001-01-05", "2001. 2. 1.", "제1차", 0),
        notice(2, " lr-1 ", "2001년 1월 5일", None, None, 5),
        notice(3, "LR-1", "20010105", "2001.03.01", None, 6),
        notice(4, "LR-1", "2002-01-01", None, "002", 7),
        notice(5, "LR-1", "1999-09-09", "1999-10-10", None, 8),
        notice(6, "LR-1", None, None, "3차", 9),
        notice(7, None, "2002-01-01", None, "1", 9),
        notice(8, "", "2002-01-01", None, "1", 9),
    ]
    assert history(spark, rows) == [("LR-1", 1, "2001-03-01", "2002-01-01"), ("LR-1", 2, "2002-01-01", "9999-12-31")]


def test_ties_go_to_the_greater_notice(spark):
    rows = [notice(2, "A", "2001-01-01", "2001-05-05", "1", 0), notice(1, "A", "2001-01-01", "2001-04-04", "1", 0), notice(2, "A", "2001-01-01", "2001-05-05", "1", 0)]
    assert history(spark, rows) == [("A", 1, "2001-05-05", "9999-12-31")]


def test_empty_feed(spark):
    assert history(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    day = lambda: f"{rng.randint(1998, 2006)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    dates = {}
    rows = []
    for i in range(400):
        law, num = ("HOT" if i % 3 == 0 else f"L{rng.randint(1, 12)}"), rng.randint(1, 9)
        rev = dates.setdefault((law, num), day())
        if list(dates.values()).count(rev) > 1:
            rev = dates[law, num] = f"19{60 + len(dates) % 40}-01-{num:02d}"
        rows.append(notice(i, law, rng.choice([rev, rev, None]), rng.choice([None, day()]), rng.choice([str(num), None]), rng.randint(0, 50)))
    assert history(spark, rows) == brute(rows)


def test_versions_close_on_payload_change_only(spark):
    rows = spark.createDataFrame([("a", "2001-01-01", 1, "x"), ("a", "2002-01-01", 2, "x"), ("a", "2003-01-01", 3, None), ("a", "2003-06-01", 4, None), ("b", None, 1, "x")], "e string, d string, n long, p string")
    got = sorted((r.e, r.d, r.p, r.valid_to) for r in H.close_versions(rows, "e", "d", "n", ["p"]).collect())
    assert got == [("a", "2001-01-01", "x", "2003-01-01"), ("a", "2003-01-01", None, "9999-12-31")]


def test_versions_across_partitions(spark):
    """A payload that goes on over several partitions closes once, and one entity spreads over all of them."""
    days = [f"20{y:02d}-{m:02d}-01" for y in range(20) for m in range(1, 13)]
    payload = ["x" if 30 <= i < 200 else str(i % 3) for i in range(len(days))]
    rows = [("hot", d, i, p) for i, (d, p) in enumerate(zip(days, payload, strict=True))] * 2 + [("z", days[0], 1, None)]
    out = H.close_versions(spark.createDataFrame(rows, "e string, d string, n long, p string"), "e", "d", "n", ["p"]).collect()
    want, last = [], None
    for d, p in zip(days, payload, strict=True):
        if p != last:
            want.append([d, p, None])
            if len(want) > 1:
                want[-2][2] = d
        last = p
    want[-1][2] = H.END_OF_TIME
    assert sorted([r.d, r.p, r.valid_to] for r in out if r.e == "hot") == want
    assert [(r.p, r.valid_to) for r in out if r.e == "z"] == [(None, H.END_OF_TIME)]


def test_a_revision_is_stated_again_with_equal_attributes(spark):
    rows = [notice(i, "A", "2001-01-01", "2001-05-05", str(1 + i % 2), i) for i in range(6)]
    assert history(spark, rows) == [("A", 1, "2001-05-05", "2001-05-05"), ("A", 2, "2001-05-05", "9999-12-31")]
