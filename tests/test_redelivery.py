import random

from tallyforge.operators.redelivery import dropped_deliveries, keep_once, merge_deliveries

SCHEMA = "delivery_id bigint, harness string, instance_id string, dedup_key string, request_id string, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    """Union-find over the definition, pair by pair."""
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    norm = lambda x: (x or "").strip().lower() or None
    inst = lambda x: (x or "").strip() or "default"
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if (a[1], inst(a[2])) != (b[1], inst(b[2])):
                continue
            ka, kb, ra, rb = norm(a[3]), norm(b[3]), norm(a[4]), norm(b[4])
            if (ka and ka == kb) or ((not ka or not kb) and ra and ra == rb):
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return {d for g in groups.values() for d in g if d != min(g)}


def test_chains_blanks_and_case(spark):
    rows = [
        (1, "a", "", " K1 ", "r1", "x"), (2, "a", "default", "k1\n", None, "y"), (3, "a", None, None, "R1", "z"),  # 3 ties r1 to k1
        (4, "a", "", "k2", "r1", ""), (5, "a", "", "k3", "r9", ""), (6, "a", "", "k4", "r9", ""),  # r9 has no keyless row: no tie
        (7, "a", "", "", "", ""), (8, "a", "", None, None, ""), (9, "b", "", "k1", "r1", ""), (10, "a", "other", "k1", "r1", ""),
        (11, "a", "", "", "solo", ""), (12, "a", "", " ", "SOLO", ""),
    ]
    got = {r[0] for r in dropped_deliveries(frame(spark, rows)).collect()}
    assert got == brute(rows) == {2, 3, 4, 12}
    kept = keep_once(frame(spark, rows))
    assert {r.delivery_id for r in kept.collect()} == {r[0] for r in rows} - got
    assert kept.columns == ["delivery_id", "harness", "instance_id", "dedup_key", "request_id", "note"]


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = [(i, rng.choice("ab"), rng.choice(["", "x", None]), rng.choice([None, "", *(f"k{n}" for n in range(40))]), rng.choice([None, " ", *(f"r{n}" for n in range(60))]), "")
                for i in range(120)]
        rng.shuffle(rows)
        assert {r[0] for r in dropped_deliveries(frame(spark, rows)).collect()} == brute(rows)
        assert {r[0] for r in dropped_deliveries(frame(spark, rows), broadcast_keys=0).collect()} == brute(rows)


def test_hot_key_and_repeated_rows(spark):
    rows = [(i, "a", "", "hot", "r", "") for i in range(300)] + [(5, "a", "", "hot", "r", "")] * 3 + [(1000, "a", "", "cold", "r", "")] * 2
    df = frame(spark, rows)
    for keys in (10, 0):
        assert {r[0] for r in dropped_deliveries(df, broadcast_keys=keys).collect()} == set(range(1, 300))
    assert sorted(r.delivery_id for r in keep_once(df).collect()) == [0, 1000]


def test_null_order_and_empty(spark):
    rows = [(None, "a", "", "k", "r", "n"), (3, "a", "", "k", "r", "m"), (None, None, None, None, None, None)]
    assert dropped_deliveries(frame(spark, rows)).count() == 0
    assert keep_once(frame(spark, rows)).count() == 3
    assert dropped_deliveries(frame(spark, [])).count() == 0
    assert keep_once(frame(spark, [])).count() == 0


def test_new_batch_keeps_stored_copy(spark):
    stored = frame(spark, [(10, "a", "", "k1", "r1", "old")])
    new = frame(spark, [(2, "a", "", "K1", "r1", "new"), (11, "a", "", "k2", "r2", "new"), (12, "a", "", "k2", "r2", "again")])
    out = {(r.delivery_id, r.note) for r in merge_deliveries(stored, new).collect()}
    assert out == {(10, "old"), (11, "new")}


def test_clashing_columns(spark):
    df = frame(spark, [(1, "a", "", "k", "r", "x"), (2, "a", "", "k", "r", "y")]).withColumn("ord", __import__("pyspark").sql.functions.lit(0)).withColumn("_new", __import__("pyspark").sql.functions.lit("q"))
    assert keep_once(df).collect()[0].delivery_id == 1
    assert merge_deliveries(df, df).columns == df.columns
