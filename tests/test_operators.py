import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.endpoints import normal_endpoint, with_endpoint
from tallyforge.operators import asof, merge, ordered, series
from tallyforge.operators import sessions as H
from tallyforge.operators.filters import Filter, parse_time


def test_time_grammar():
    now = datetime(2026, 3, 31, 15, 30, tzinfo=timezone.utc)
    day = lambda *a: datetime(*a, tzinfo=timezone.utc)
    cases = {"today": day(2026, 3, 31), "yesterday": day(2026, 3, 30), "week": day(2026, 3, 30), "month": day(2026, 3, 1), "7d": now - timedelta(days=7), "90s": now - timedelta(seconds=90), "2w": now - timedelta(days=14),
             "1m": day(2026, 2, 28, 15, 30), "2026-01-05": day(2026, 1, 5), "2026-01-05T10:00:00+02:00": day(2026, 1, 5, 8)}
    for text, want in cases.items():
        assert parse_time(text, now) == want, text
    with pytest.raises(ValueError):
        parse_time("soon", now)
    assert parse_time("today", now, ZoneInfo("Asia/Tokyo")) == datetime(2026, 4, 1, tzinfo=ZoneInfo("Asia/Tokyo"))


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/usage_events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    f = Filter(datetime(2026, 4, 1, tzinfo=timezone.utc), datetime(2026, 5, 1, tzinfo=timezone.utc), harnesses=("codex",), project="x")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = df.where(f.pushed()).select("input")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(harness,codex)" in plan and "EqualTo(project,x)" in plan and "GreaterThanOrEqual(ts" in plan and "git_branch" not in plan


ENDPOINTS = {
    "HTTPS://API.x.test:443/v1/": "https://api.x.test/v1", "http://x.test:80": "http://x.test", "http://x.test:8080/a//": "http://x.test:8080/a//", "https://1.2.3.4/v1": "https://1.2.3.4/v1", "https://[2001:DB8::1]:8443": "https://[2001:db8::1]:8443",
    "ftp://x.test": None, "https://u:p@x.test": None, "https://x.test/?q": None, "https://x.test/#f": None, "http://localhost:1": None, "http://a.localhost": None, "http://127.0.0.1:80": None, "https://[::1]": None, "http://0x7f": None,
    "https://x.test/../y": None, "https://x..test": None, "https://-x.test": None, "https://x.test:": None, "https://x.test:0": None, "https://x.test:99999": None, "": None, None: None, "https://x.5": None, "https://bücher.test": None,
}


def test_endpoints(spark):
    for raw, want in ENDPOINTS.items():
        assert normal_endpoint(raw) == want, raw
    df = spark.createDataFrame([(u, "mine") for u in ENDPOINTS], "base_url string, _url string")
    out = {r.base_url: r for r in with_endpoint(df, "base_url").collect()}
    assert len(out) == len(ENDPOINTS) and out["HTTPS://API.x.test:443/v1/"].endpoint_id.startswith("endpoint:v1:") and out[None].endpoint_id is None and out[""]._url == "mine"


def test_provider_scalars(spark):
    rows = [("custom", "https://Relay.test:8443/v1", "gpt-5", "relay.test:8443"), ("", "http://127.0.0.1:9", "x/claude-1", "anthropic"), ("named", "https://r.test", "m", "named"), (None, None, None, "unknown"), ("proxy", "nonsense", "o3-mini", "openai")]
    got = spark.createDataFrame(rows, "p string, u string, m string, want string").select(S.resolved_provider("p", "u", "m").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    url = spark.createDataFrame([("https://api.openai.com/v1",), ("https://openai.com.evil.test",), ("https://x.openrouter.ai:1/",)], "u string").select(S.provider_of_url("u").alias("p")).collect()
    assert [r.p for r in url] == ["openai", "openai.com.evil.test", "openrouter"]
    name = spark.createDataFrame([("vendor/Claude-3.5-sonnet-20241022",), ("x:latest",), ("q-latest",), ("m-preview-2",)], "n string").select(S.normal_model("n").alias("a"), S.search_name("n").alias("b")).collect()
    assert [r.a for r in name] == ["claude-3-5-sonnet", "x", "q", "m-preview-2"] and name[3].b == "m"


def test_saturating_sum(spark):
    df = spark.createDataFrame([(2**63 - 1,), (5,)], "x bigint")
    assert df.agg(S.saturating_sum("x")).first()[0] == 2**63 - 1 and df.where("false").agg(S.saturating_sum("x")).first()[0] is None


def test_upsert_owner_and_sticky_fields(spark):
    base = dict(harness="h", instance_id="i", dedup_key="k", parent_id="", input=1, request_id="", boundary="", bill_amount=None, bill_unit="")
    schema = "harness string, instance_id string, dedup_key string, session_id string, parent_id string, input int, request_id string, boundary string, bill_amount double, bill_unit string, seq int"

    def run(*rows):
        df = spark.createDataFrame([tuple({**base, "seq": n, **r}[c.split()[0]] for c in schema.split(", ")) for n, r in enumerate(rows)], schema)
        return merge.upsert_facts(df, "seq").collect()[0]

    r = run(dict(session_id="child", parent_id="root", input=5), dict(session_id="root", input=7, request_id="q", bill_amount=2.0, bill_unit="c"), dict(session_id="child", parent_id="root", input=9), dict(session_id="root", input=8))
    assert (r.session_id, r.input, r.request_id, r.bill_amount, r.bill_unit) == ("root", 8, "q", 2.0, "c")
    r = run(dict(session_id="c1", parent_id="p", input=1), dict(session_id="c2", parent_id="p", input=2))
    assert (r.session_id, r.input) == ("c1", 1)


def test_asof_blocks_and_nulls(spark):
    rng = random.Random(1)
    t = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    left = [(i, rng.choice("ab"), t(rng.randrange(5000))) for i in range(200)] + [(900, "a", None), (901, None, t(5))]
    right = [(rng.choice("ab"), t(rng.randrange(5000)), n) for n in range(30)] + [("a", None, 99)]
    out = asof.asof_backward(spark.createDataFrame(left, "id int, k string, at timestamp"), spark.createDataFrame(right, "k string, since timestamp, v int"), ["k"], "at", "since", ["v"], block_s=300)
    got = {r.id: r.v for r in out.collect()}
    for i, k, at in left:
        fit = [(s, v) for rk, s, v in right if rk == k and s and at and s <= at]
        assert got[i] == (max(fit)[1] if fit else None)


def test_nearest_and_rules(spark):
    t = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    left = spark.createDataFrame([(1, "k", t(100)), (2, "k", t(500)), (3, "z", t(100)), (4, None, None)], "id int, k string, at timestamp")
    right = spark.createDataFrame([("k", t(90), 1, "a"), ("k", t(110), 2, "b"), ("k", t(300), 3, "c")], "k string, at2 timestamp, n int, v string")
    got = {r.id: r.v for r in asof.nearest_within(left, right, ["k"], "at", "at2", 120, "id", "n", ["v"]).collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None}
    assert {r.id for r in asof.interval_anti(left, right, ["k"], "at", "at2", 10).collect()} == {2, 3, 4}
    rules = [{"o": 1, "v": "x"}, {"o": 2, "v": "y"}, {"o": 3, "v": "z"}]
    fits = lambda r: F.col("id") % 2 == r["o"] % 2
    assert {r.id: r.v for r in asof.first_matching_rule(left, rules, fits, "v", "v").collect()} == {1: "x", 2: "y", 3: "x", 4: "y"}
    assert {r.v for r in asof.first_matching_rule(left, [], fits, "v", "v").collect()} == {None}
    with pytest.raises(ValueError):
        asof.first_matching_rule(left, rules, fits, "v", "v", bound=1)


def test_carried_blocks_equal_plain_windows(spark):
    from pyspark.sql import Window

    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), datetime(2026, 1, 1) + timedelta(hours=rng.randrange(300)), i, rng.choice([None, *range(9)])) for i in range(300)] + [("a", None, 900, 3), ("a", None, 901, None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, v int").withColumn("_val", F.lit("mine"))
    w = Window.partitionBy("k").orderBy("ts", "id")
    up, past, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    plain = {"sum": F.sum("v").over(up), "max_before": F.max("v").over(past), "last": F.last("v", True).over(up), "next": F.first("v", True).over(on), "lag": F.lag("v").over(w)}
    for how, c in plain.items():
        want = {r.id: r.x for r in df.withColumn("x", c).collect()}
        out = ordered.carried(df, ["k"], ["ts", "id"], F.col("v"), how, "x", size=0.3)
        assert out.columns == [*df.columns, "x"]
        assert {r.id: r.x for r in out.collect()} == want, how
    assert ordered.carried(df.where("false"), ["k"], ["ts", "id"], F.col("v"), "sum", "x").count() == 0


def test_dense_days_across_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp'2026-03-07 23:30:00' as ts, 1 as n union all select timestamp'2026-03-09 00:10:00', 2")
        out = series.dense(df, "ts", ["n"]).orderBy("bucket").selectExpr("cast(bucket as string) as b", "n").collect()
        assert [(r.b, r.n) for r in out] == [("2026-03-07 00:00:00", 1), ("2026-03-08 00:00:00", 0), ("2026-03-09 00:00:00", 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert series.dense(df.where("false"), "ts", ["n"]).count() == 0


def test_streaks_and_heat(spark):
    rows = [(datetime(2026, 1, 1).date() + timedelta(days=i), n, float(n)) for i, n in enumerate([1, 2, 0, 5, 6, 7, 0])]
    d = spark.createDataFrame(rows, "day date, tokens int, cost double")
    got = sorted((r.length, r.current) for r in series.streaks(d, "day", F.col("tokens") > 0).collect())
    assert got == [(2, False), (3, True)]
    assert [r.level for r in series.heat_levels(d, "cost", "tokens").orderBy("day").collect()] == [1, 1, 0, 2, 3, 4, 0]


def test_pending_boundary(spark):
    rows = [(1, "compact", ""), (2, "", "k1"), (3, "", "k1"), (4, "clear", ""), (5, "", "k1"), (6, "", "k2"), (7, "", "k3")]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, n int, mark string, key string")
    got = {r.n: r.applied for r in ordered.pending_boundary(df, ["f"], ["n"], "mark", "key").collect()}
    assert got[2] == "compact" and got[6] == "clear" and all(got[n] == "" for n in (1, 3, 4, 5, 7))


def test_output_rate_rules(spark):
    now = datetime(2026, 1, 1, 12)
    ev = lambda sid, ago, out, dec=0: (sid, now - timedelta(seconds=ago), f"{sid}{ago}", out, 0, dec)
    rows = [ev("a", 100, 5), ev("a", 60, 600), ev("a", 50, 300), ev("b", 80, 9), ev("b", 70, 100, 2000), ev("c", 10, 5), ev("d", 500, 1), ev("d", 400, 10)]
    got = {r.sid: (r.requests, r.rate) for r in ordered.output_rate(spark.createDataFrame(rows, "sid string, ts timestamp, dedup_key string, output int, reasoning int, decode_ms int"), ["sid"], F.lit(now)).collect()}
    assert got == {"a": (2, 18.0), "b": (1, 50.0), "d": (1, 0.0)}


def test_balances(spark):
    t = lambda d, h: datetime(2026, 1, d, h)
    rows = [("x", t(1, 1), 10.0), ("x", t(1, 9), 8.0), ("x", t(2, 1), 7.0), ("x", t(2, 9), 20.0), ("x", t(3, 1), 20.0)]
    out = ordered.balance_use(spark.createDataFrame(rows, "a string, at timestamp, b double"), ["a"], "at", "b").orderBy("day").collect()
    assert [r.used for r in out] == [2.0, 1.0, 0.0]


def test_session_example(spark):
    """Three requests, a parent and a child session."""
    schema = "harness string, instance_id string, session_id string, dedup_key string, ts timestamp, resolved_provider string, model string, input bigint, output bigint, cache_read bigint, cache_write bigint, reasoning bigint, cost double, priced boolean"
    t = datetime(2026, 1, 1)
    ev = spark.createDataFrame([("h", "i", "p", "1", t, "x", "m", 100, 10, 50, 10, 0, 1.0, True), ("h", "i", "c", "2", t, "x", "m", 40, 10, 0, 0, 0, 0.5, True), ("h", "i", "q", "3", t, "x", "m", 10, 0, 0, 0, 0, 0.0, False)], schema)
    meta = spark.createDataFrame([("h", "i", "p", "", "T", "pr", t, t), ("h", "i", "c", "p", "", "", t, t), ("h", "i", "q", "", "", "", t, t)], "harness string, instance_id string, session_id string, parent_id string, title string, project string, started_at timestamp, updated_at timestamp")
    from tallyforge.operators.aggregates import totals

    r = totals(ev, H.session_tree(meta)).collect()[0]
    assert (r.requests, r.sessions, r.input + r.output + r.cache_read + r.cache_write, r.unpriced) == (3, 2, 230, 1) and r.cache_hit == round(50 / 210, 6)
    rows = {x.session_id: x for x in H.session_rows(ev, meta).collect()}
    assert rows["p"].total == 220 and rows["p"].children == 1 and rows["c"].total == 50
    assert [x.session_id for x in H.page(H.session_rows(ev, meta), "tokens", 1, 0).collect()] == ["p"] and H.page(H.session_rows(ev, meta), "tokens", 0, 9).count() == 0
    wide, kids, own = H.detail(ev, meta, "h", "p")
    assert wide.collect()[0].total == 220 and [k.session_id for k in kids.collect()] == ["c"] and own.count() == 1
    twice = meta.unionByName(meta.withColumn("instance_id", F.lit("j")))
    with pytest.raises(ValueError):
        H.detail(ev, twice, "h", "p")


def test_empty_facts(spark):
    from tallyforge import adapters
    from tallyforge.operators.aggregates import ranking, totals

    empty = adapters.facts(spark, "/root/testdata/sf0.001").where("false")
    tree = H.session_tree(adapters.sessions(spark, "/root/testdata/sf0.001").where("false"))
    assert totals(empty, tree).collect()[0].requests == 0 and ranking(empty, tree, "model").count() == 0


def test_periods_in_every_kind_of_zone(spark):
    from datetime import date

    from tallyforge.operators import periods as P

    for zone in map(ZoneInfo, ("UTC", "America/Sao_Paulo", "Asia/Kathmandu", "Australia/Lord_Howe", "Africa/Cairo", "Asia/Beirut")):
        day = date(2018, 1, 1)
        while day < date(2019, 1, 1):
            start = P.day_start(day, zone)
            assert start.astimezone(zone).date() == day and (start - timedelta(minutes=1)).astimezone(zone).date() < day
            day += timedelta(days=1)
    p = P.period("day", date(2018, 11, 4), ZoneInfo("America/Sao_Paulo"))
    assert p.end - p.start == timedelta(hours=23)
    utc = timezone.utc
    month = P.period("month", date(2026, 3, 31), utc)
    assert (month.first, month.last) == (date(2026, 3, 1), date(2026, 4, 1)) and P.period("week", date(2026, 3, 1), utc).first == date(2026, 2, 23)
    a, b = P.comparison("month", month, datetime(2026, 3, 30, tzinfo=utc), utc)
    assert (a, b) == (datetime(2026, 2, 1, tzinfo=utc), datetime(2026, 3, 1, tzinfo=utc))
    df = spark.createDataFrame([(100.0, 99.7), (2.0, 1.0), (1.0, 0.0)], "a double, b double").select(P.delta(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in df.collect()] == [0.0, 1.0, None]


def test_sinks_and_overlay(spark, tmp_path):
    from tallyforge.functions.endpoints import provider_id
    from tallyforge.sources import sinks

    outcomes = spark.createDataFrame([("h", "a", "1", "ok"), ("h", "a", "2", "locked"), ("h", "b", "1", "ok"), ("h", "b", "2", "empty"), ("h", "c", "1", "empty"), ("h", "d", "1", "odd")], "harness string, instance_id string, source_path string, reason string")
    assert {r.instance_id: r.reason for r in sinks.diagnose(outcomes).collect()} == {"a": "locked", "b": "ok", "c": "empty", "d": "read_error"}
    base, new = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 2)], [("b", 9), ("c", 3)]))
    assert {(r.k, r.v) for r in merge.overlay(new, base, ["k"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    ids = spark.createDataFrame([("h", "i", "p<&", "", None), ("h", "i", "p", "", "endpoint:v1:x")], "harness string, instance_id string, resolved_provider string, base_url string, endpoint_id string").select(provider_id().alias("i")).collect()
    import hashlib

    assert ids[1].i == "endpoint:v1:x" and ids[0].i == "unresolved:v1:" + hashlib.sha256(b'["h","i","p\\u003c\\u0026",""]').hexdigest()
    t = datetime(2026, 1, 1)
    rows = spark.createDataFrame([("h", "i", "s", "", 'a "b", c', "p", t, t, 1, 2, 3, 4, 5, 0.5)], "harness string, instance_id string, session_id string, parent_id string, title string, project string, started_at timestamp, updated_at timestamp, requests int, input int, output int, cache_read int, cache_write int, cost double")
    models = spark.createDataFrame([("h", "i", "s", "m2"), ("h", "i", "s", "m1")], "harness string, instance_id string, session_id string, model string")
    sinks.write_csv(sinks.session_export(rows, models), str(tmp_path / "out"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out")).collect()[0]
    assert back.title == 'a "b", c' and back.models == "m1 m2" and back.started_at == "2026-01-01T00:00:00Z" and len(back) == 14
