import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyforge.operators.trailing import latest_rebuild, trailing_totals

SCHEMA = "who string, day date, amount double"
END = date(2026, 3, 31)


def run(spark, rows, windows=(7, 30)):
    df = trailing_totals(spark.createDataFrame(rows, SCHEMA), ["who"], "day", "amount", windows, F.lit(END))
    return {(r.who, r.day): r for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), date(2026, 1, 1) + timedelta(rng.randrange(80)), rng.choice([None, 0.0, round(rng.random() * 9, 6)])) for _ in range(90)]
    got = run(spark, rows)
    seen = 0
    for who in {r[0] for r in rows}:
        d0 = min(r[1] for r in rows if r[0] == who)
        best = None
        day = d0
        while day <= END:
            t7, t30 = (round(sum(r[2] or 0 for r in rows if r[0] == who and day - timedelta(n - 1) <= r[1] <= day), 6) for n in (7, 30))
            r = got[who, day]
            assert abs(r.total_7 - t7) < 1e-9 and abs(r.total_30 - t30) < 1e-9 and abs(r.avg_7 - t7 / 7) < 1e-6
            assert r.new_high_7 == (best is not None and t7 > best)
            best = t7 if best is None else max(best, t7)
            day += timedelta(1)
            seen += 1
    assert seen == len(got)


def test_emptied_window_is_exactly_zero(spark):
    got = run(spark, [("a", date(2026, 1, 1), 0.1), ("a", date(2026, 1, 2), 0.2), ("a", date(2026, 1, 3), 0.3)])
    assert got["a", date(2026, 1, 10)].total_7 == 0.0 and got["a", date(2026, 1, 10)].total_30 == 0.6


def test_nulls_late_rows_and_empty(spark):
    assert run(spark, []) == {}
    rows = [("a", None, 1.0), (None, date(2026, 3, 1), 1.0), ("a", date(2026, 4, 2), 1.0), ("b", date(2026, 3, 31), None)]
    got = run(spark, rows)
    assert list(got) == [("b", END)] and got["b", END].total_7 == 0


def test_latest_rebuild(spark):
    df = spark.createDataFrame([("a", None, 1, 5.0), ("a", None, 2, 3.0), ("a", None, 2, 3.0), ("b", "x", 1, None)], "k string, p string, rebuild_no int, cost double")
    got = sorted((r.k, r.p or "", r.cost) for r in latest_rebuild(df, ["k", "p"]).collect())
    assert got == [("a", "", 3.0), ("b", "x", None)]
