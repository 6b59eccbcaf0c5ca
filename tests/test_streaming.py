import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyforge.adapters import deliveries
from tallyforge.operators.merge import upsert_facts
from tallyforge.streaming.ingest import FactStore, eligible, run_ingest
from tallyforge.streaming.rate import LIMIT, NEVER, Tracker, persisted_signal, streaming_rate, trailing_rate

SF = "/root/testdata/sf0.001"


def test_trailing_rate_against_brute_force(spark):
    rng = random.Random(4)
    t0 = datetime(2026, 1, 1)
    rows = [(i, t0 + timedelta(seconds=rng.randrange(9000)), rng.randrange(50)) for i in range(400)]
    got = {r.id: r.rate for r in trailing_rate(spark.createDataFrame(rows, "id int, at timestamp, n int"), "at", "n", 60, 600).collect()}
    for i, at, _ in rows:
        want = sum(n for _, a, n in rows if at - timedelta(seconds=60) < a <= at) / 60
        assert abs(got[i] - want) < 1e-6


def test_registered_trailing_rate_covers_all_deliveries(spark):
    from tallyforge.plans.registry import queries

    rows = deliveries(spark, SF).where("received_at is not null").select("delivery_id", "received_at", "output").collect()
    got = {r.delivery_id: r.rate for r in queries()["trailing_rate_batch"](spark, SF).collect()}
    assert set(got) == {r.delivery_id for r in rows} and min(r.received_at for r in rows) < datetime(2026, 8, 24)
    for r in rows[::40]:
        want = sum(x.output for x in rows if r.received_at - timedelta(seconds=60) < x.received_at <= r.received_at) / 60
        assert abs(got[r.delivery_id] - want) < 1e-5


def test_tracker_model():
    """Random steps against a window recomputed from scratch."""
    rng = random.Random(9)
    tracker, kept, present = Tracker(), [], NEVER
    for _ in range(800):
        at = max(present, 0) + rng.randrange(-5, 40) * 1_000_000
        n, kind = rng.randrange(100), rng.choice(["live", "live", "backfill", "unknown"])
        refused = tracker.observe(at, n, kind)
        assert refused == ("out_of_order" if kind == "live" and at < present else "")
        if kind == "live" and at >= present:
            present = at
            kept.append((at, n))
        tracker = Tracker(state=tracker.state())
        if kept:
            now = present + rng.choice([0, 0, 7_000_000])
            present = now
            want = sum(n for a, n in kept if a > now - 60_000_000)
            fresh = now - kept[-1][0] <= 60_000_000
            assert tracker.snapshot(now) == ((want, want / 60, "ok") if fresh else (0, 0.0, "stale_telemetry"))


def test_full_window_refuses_and_recovers():
    tracker = Tracker(capacity=4)
    assert [tracker.observe(i, 1, "live") for i in (0, 1, 2, 3)] == [""] * 4
    assert tracker.observe(4, 0, "live") == "" and tracker.snapshot(4) == (4, 4 / 60, "ok")  # a sign of life takes no place
    assert tracker.observe(4, 1, "live") == "capacity_exceeded" and len(tracker.kept) == 4
    assert tracker.snapshot(4)[2] == "capacity_exceeded"
    assert tracker.observe(60_000_003, 0, "live") == "" and tracker.snapshot(60_000_003) == (0, 0.0, "capacity_exceeded")
    assert tracker.observe(60_000_004, 0, "live") == "" and tracker.snapshot(60_000_004) == (0, 0.0, "ok")
    again = Tracker(capacity=4)
    for i in range(4):
        again.observe(i, 1, "live")
    assert again.observe(60_000_003, 5, "live") == "" and again.snapshot(60_000_003) == (5, 5 / 60, "ok")  # places are free again
    same = Tracker(capacity=2)
    assert all(same.observe(7, 1, "live") == "" for _ in range(10)) and same.snapshot(7)[0] == 10


def test_refusals_and_reasons():
    tracker = Tracker()
    assert tracker.snapshot(5)[2] == "no_live_signal" and tracker.snapshot(4)[2] == "clock_regression"
    for args, why in (((None, 1, "live"), "invalid_time"), ((9, -1, "live"), "negative_delta"), ((9, 1, "other"), "invalid_class"), ((1, 1, "live"), "out_of_order")):
        before = tracker.state()
        assert tracker.observe(*args) == why and tracker.state() == before
    assert tracker.observe(10, 6, "live") == "" and tracker.snapshot(60_000_011)[2] == "stale_telemetry"
    full = Tracker()
    assert full.observe(1, LIMIT, "live") == "" and full.observe(1, 5, "live") == "counter_overflow"
    assert full.observe(10**9, 1, "live") == "counter_overflow" and full.snapshot(10**9)[2] == "counter_overflow"
    wide = Tracker()
    assert wide.observe(1, LIMIT, "live") == wide.observe(2, 5, "live") == "" and wide.snapshot(2)[2] == "counter_overflow" == wide.snapshot(10**9)[2]


def test_streaming_rate(spark, tmp_path):
    schema = "key string, seq bigint, at_us bigint, tokens bigint, kind string"
    rows = [("a", 1, 1_000_000, 60, "live"), ("a", 2, 30_000_000, 60, "live"), ("a", 3, 31_000_000, 600, "backfill"), ("a", 4, 29_000_000, 1, "live"), ("b", 5, 5, 6, "live"),
            ("c", 6, 5, 6, "live"), ("c", 7, 61_000_000, None, "now"), ("d", 9, 1, 4, "live"), ("d", 8, 2, 4, "live"), ("e", 1, 1, 1, "unknown")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming_rate(stream).writeStream.format("memory").queryName("rates").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {r.key: (r.rate, r.status, r.refused) for r in spark.table("rates").collect()}
    assert got == {"a": (2.0, "ok", 1), "b": (0.1, "ok", 0), "c": (0.0, "stale_telemetry", 0), "d": (4 / 60, "ok", 1), "e": (0.0, "no_live_signal", 0)}


def test_persisted_signal(spark):
    now = datetime(2026, 1, 1, 12)
    us = int((now - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    rows = [("ok", us - 60_000_000, 60, 1.0, "ok"), ("old", us - 60_000_001, 60, 1.0, "ok"), ("early", us + 1, 60, 1.0, "ok"), ("odd", us, 60, 2.0, "ok"), ("none", None, 60, 1.0, "ok"), ("full", us, 0, 0.0, "capacity_exceeded")]
    df = persisted_signal(spark.createDataFrame(rows, "key string, at_us bigint, tokens bigint, rate double, status string"), F.lit(now))
    assert {r.key: (r.shown, r.reason) for r in df.collect()} == {
        "ok": (1.0, ""), "old": (None, "stale_telemetry"), "early": (None, "clock_regression"), "odd": (None, "invalid"), "none": (None, "invalid"), "full": (None, "capacity_exceeded")}


def test_ingest_in_any_split_gives_the_same_facts(spark, tmp_path):
    d = deliveries(spark, SF).drop("received_at")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    store = FactStore(spark, str(tmp_path / "facts"))
    heard = []
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        q = run_ingest(stream, store, str(tmp_path / "chk"), lambda b, n: heard.append((b, n)))
        q.awaitTermination()
    got, want = store.current(), upsert_facts(d, "delivery_id")
    key = ["harness", "instance_id", "dedup_key"]
    assert got.count() == want.count() == sum(n for _, n in heard)
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
    assert len(heard) == 3
    store.compact()
    assert store.current().count() == want.count() and len(store._pointer()["parts"]) == 1
    before = store.current().count()
    assert store.commit(d, 0) == 0 and store.current().count() == before  # a batch delivered again


def test_eligible(spark):
    now = datetime(2026, 1, 1, 12)
    df = spark.createDataFrame([(now - timedelta(seconds=s),) for s in (-1, 0, 59, 60)], "ts timestamp")
    assert eligible(df, F.lit(now)).count() == 2
