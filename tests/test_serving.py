from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyforge.adapters import facts, sessions
from tallyforge.operators import aggregates as A
from tallyforge.operators import sessions as H
from tallyforge.plans.serving import Serving, one_stage

SF = "/root/testdata/sf0.001"
UTC = timezone.utc


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("serving"))
    Serving.build(facts(spark, SF), sessions(spark, SF), folder)
    return Serving(spark, folder)


@pytest.mark.parametrize("start, end", [
    (datetime(2026, 5, 1, tzinfo=UTC), datetime(2026, 8, 1, tzinfo=UTC)), (datetime(2026, 5, 1, 7, 30, tzinfo=UTC), datetime(2026, 8, 9, 13, 0, 1, tzinfo=UTC)),
    (datetime(2026, 6, 3, 5, tzinfo=UTC), datetime(2026, 6, 3, 21, tzinfo=UTC)), (datetime(2020, 1, 1, tzinfo=UTC), datetime(2020, 2, 1, tzinfo=UTC))])
def test_reads_equal_sums_of_facts(spark, store, start, end):
    events, meta = facts(spark, SF), sessions(spark, SF)
    rows, tree = events.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).cache(), H.session_tree(meta).cache()
    same = lambda a, b: [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in a.collect()] == [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in b.select(*a.columns).collect()]
    with one_stage(spark):
        assert same(store.totals(start, end), A.totals(rows, tree))
        for key in ("harness", "model", "resolved_provider", "project"):
            assert same(store.ranking(start, end, key), A.ranking(rows, tree, key))
        days = rows.groupBy(F.to_date("ts").alias("day")).agg(*A.measures()).orderBy("day")
        assert same(days, store.daily(start, end))
        want = H.rolled_up(rows, tree).join(meta.where("parent_id = ''").select("harness", "instance_id", "session_id", "updated_at"), ["harness", "instance_id", "session_id"]).where("requests > 0")
        want = want.orderBy(F.desc("updated_at"), "harness", "session_id", "instance_id").limit(50).drop("updated_at")
        assert same(want, store.sessions(start, end))
