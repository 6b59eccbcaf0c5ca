"""Registered queries of the usage operators, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.adapters import deliveries, facts, sessions
from tallyforge.functions import scalars as S
from tallyforge.functions.endpoints import provider_id, with_endpoint
from tallyforge.operators import aggregates as A
from tallyforge.operators import asof, merge, ordered, series
from tallyforge.operators import sessions as H
from tallyforge.operators.filters import Filter, search, starts_with, with_aliases
from tallyforge.runtime import cut, table
from tallyforge.schema import KEY, SESSION_KEY, TOKENS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2026-08-30 22:00:00"

_D = r"""
d as (
  select delivery_id, received_at, coalesce(harness, '') as harness, coalesce(nullif(trim(instance_id), ''), 'default') as instance_id, coalesce(dedup_key, '') as dedup_key,
         coalesce(session_id, '') as session_id, coalesce(trim(parent_id), '') as parent_id, coalesce(project, '') as project, ts, coalesce(model, '') as model,
         coalesce(provider, '') as provider, coalesce(base_url, '') as base_url, coalesce(input, 0) as input, coalesce(output, 0) as output, coalesce(cache_read, 0) as cache_read,
         coalesce(cache_write, 0) as cache_write, coalesce(reasoning, 0) as reasoning, coalesce(decode_ms, 0) as decode_ms, log_cost,
         coalesce(request_id, '') as request_id, coalesce(boundary, '') as boundary, bill_amount, coalesce(bill_unit, '') as bill_unit, coalesce(git_branch, '') as git_branch
  from usage_events)"""
_FACTS = _D + r""",
per as (
  select harness, instance_id, dedup_key, session_id, max(delivery_id) as delivery_id, min(delivery_id) filter (where parent_id = '') as as_root, min(delivery_id) as first_id,
         coalesce(max_by(request_id, delivery_id) filter (where request_id <> ''), '') as request_id, coalesce(max_by(boundary, delivery_id) filter (where boundary <> ''), '') as boundary,
         max_by(bill_amount, delivery_id) filter (where bill_amount is not null) as bill_amount
  from d where dedup_key <> '' and session_id <> '' group by 1, 2, 3, 4),
own as (select *, row_number() over (partition by harness, instance_id, dedup_key order by as_root is null, coalesce(as_root, first_id)) as rn from per),
host as (
  select *, lower(regexp_extract(base_url, '(?i)^https?://([^/:?#@]+)', 1)) as h, regexp_extract(base_url, '(?i)^https?://[^/:?#@]+:(\d+)', 1) as port,
         lower(regexp_extract(base_url, '(?i)^(https?)://', 1)) as scheme from d),
facts as (
  select o.harness, o.instance_id, o.dedup_key, o.session_id, d.parent_id, d.project, d.ts, d.model, d.provider, d.base_url, d.input, d.output, d.cache_read, d.cache_write, d.reasoning,
         d.decode_ms, d.log_cost, o.request_id, o.boundary, o.bill_amount, d.git_branch, coalesce(d.log_cost, 0.0) as cost, d.log_cost is not null as priced, o.delivery_id,
         case when lower(trim(d.provider)) not in ('', 'custom', 'openai-compatible', 'default', 'proxy') then d.provider
              when d.h <> '' and d.h <> 'localhost' and d.h not like '127.%' then d.h || case when d.port = '' or (d.scheme = 'https' and d.port = '443') or (d.scheme = 'http' and d.port = '80') then '' else ':' || d.port end
              else 'unknown' end as resolved_provider
  from own o join host d on d.delivery_id = o.delivery_id where o.rn = 1)"""
_META = r""",
evs as (
  select harness, instance_id, session_id, coalesce(max_by(parent_id, delivery_id) filter (where parent_id <> ''), '') as parent_id, '' as title,
         coalesce(max_by(project, delivery_id) filter (where project <> ''), '') as project, min(ts) as started_at, max(ts) as updated_at from d where session_id <> '' group by 1, 2, 3),
sm as (select coalesce(harness, '') as harness, coalesce(nullif(trim(instance_id), ''), 'default') as instance_id, session_id, coalesce(trim(parent_id), '') as parent_id, coalesce(title, '') as title,
              coalesce(project, '') as project, started_at, updated_at from session_meta where coalesce(session_id, '') <> ''),
sms as (
  select harness, instance_id, session_id, coalesce(arg_max(parent_id, (updated_at, parent_id)) filter (where trim(parent_id) <> ''), '') as parent_id,
         coalesce(arg_max(title, (updated_at, title)) filter (where trim(title) <> ''), '') as title, coalesce(arg_max(project, (updated_at, project)) filter (where trim(project) <> ''), '') as project,
         min(started_at) as started_at, max(updated_at) as updated_at from sm group by 1, 2, 3),
stubs as (select harness, instance_id, parent_id as session_id from evs where parent_id <> '' union select harness, instance_id, parent_id from sms where parent_id <> ''),
meta as (
  select k.harness, k.instance_id, k.session_id, coalesce(nullif(s.parent_id, ''), e.parent_id, '') as parent_id, coalesce(s.title, '') as title,
         coalesce(nullif(s.project, ''), e.project, '') as project, least(s.started_at, e.started_at) as started_at, greatest(s.updated_at, e.updated_at) as updated_at
  from (select harness, instance_id, session_id from evs union select harness, instance_id, session_id from sms union select * from stubs) k
  left join sms s using (harness, instance_id, session_id) left join evs e using (harness, instance_id, session_id)),
up as (
  select harness, instance_id, session_id, session_id as top, 0 as depth from meta
  union all
  select u.harness, u.instance_id, u.session_id, m.parent_id, u.depth + 1 from up u join meta m on m.harness = u.harness and m.instance_id = u.instance_id and m.session_id = u.top
  where m.parent_id <> '' and u.depth < 200),
far as (select harness, instance_id, session_id, max(depth) as depth, max_by(top, depth) as top from up group by 1, 2, 3),
tree as (select harness, instance_id, session_id, case when depth >= 200 then session_id else top end as root_id, case when depth >= 200 then -1 else depth end as depth from far),
closure as (select u.harness, u.instance_id, u.session_id, u.top as ancestor from up u join tree t using (harness, instance_id, session_id) where t.depth >= 0
            union all select harness, instance_id, session_id, session_id from tree where depth < 0),
rooted as (select f.*, coalesce(t.root_id, f.session_id) as root_id from facts f left join tree t using (harness, instance_id, session_id))"""
_SUMS = """cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, cast(sum(cache_read) as bigint) as cache_read, cast(sum(cache_write) as bigint) as cache_write,
 cast(sum(reasoning) as bigint) as reasoning, round(sum(cost), 6) as cost"""
_MEASURES = _SUMS + ", count(*) as requests, count(*) filter (where not priced) as unpriced"
_TOTAL = "(input + output + cache_read + cache_write + reasoning)"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its oracle if SQL can express it."""
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return put


def _with(body: str, *, meta: bool = False, only_d: bool = False) -> str:
    return "with recursive" + (_D if only_d else _FACTS + (_META if meta else "")) + "\n" + body


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return H.session_tree(sessions(spark, sf))


# ---- totals and rankings

@query(_with(f"select {_MEASURES}, count(distinct (harness, instance_id, root_id)) as sessions, round(sum(cache_read) / sum(input + cache_read + cache_write), 6) as cache_hit from rooted", meta=True))
def totals(spark, sf):
    return A.totals(facts(spark, sf), _tree(spark, sf))


def _ranking(name: str, keys: str) -> None:
    cols = [k.strip() for k in keys.split(",")]

    @query(_with(f"select {keys}, {_MEASURES}, count(distinct (harness, instance_id, root_id)) as sessions, cast(sum({_TOTAL}) as bigint) as total from rooted group by {keys}", meta=True), name=name)
    def run(spark, sf):
        return A.ranking(facts(spark, sf), _tree(spark, sf), *cols)


for _name, _keys in (("by_harness", "harness"), ("by_model", "model"), ("by_provider", "resolved_provider"), ("by_project", "project")):
    _ranking(_name, _keys)


@query(_with(f"""select project, coalesce(b.branch, '') as branch, {_MEASURES} from facts f left join (
 select harness, instance_id, dedup_key, case when min(git_branch) = max(git_branch) then min(git_branch) else '' end as branch from d where git_branch <> '' and dedup_key <> '' group by 1, 2, 3) b
 using (harness, instance_id, dedup_key) group by 1, 2"""))
def by_branch(spark, sf):
    branch = merge.branch_evidence(deliveries(spark, sf).where("dedup_key <> ''"))
    joined = facts(spark, sf).join(branch, list(KEY), "left").withColumn("branch", F.coalesce("branch", F.lit("")))
    return joined.groupBy("project", "branch").agg(*A.measures())


@query(_with(f"select {_MEASURES} from facts where ts >= timestamp '2026-05-01' and ts < timestamp '2026-06-01' and harness in ('claude-code', 'codex') and instance_id in ('default', 'work') and resolved_provider in ('larkworks', 'relay-one')"))
def totals_filtered(spark, sf):
    from datetime import datetime, timezone

    f = Filter(datetime(2026, 5, 1, tzinfo=timezone.utc), datetime(2026, 6, 1, tzinfo=timezone.utc), ("claude-code", "codex"), ("default", "work"), ("larkworks", "relay-one"))
    return facts(spark, sf).where(f.pushed()).where(f.derived()).agg(*A.measures())


@query(_with(f"""select model, {_MEASURES} from (select * exclude (model), case when model = 'opal-mini' and resolved_provider = 'opalhost' then 'opal-max' when model in ('Opal-Mini', 'opal-mini') then 'mini' else model end as model from facts)
 where model in ('opal-max', 'mini') group by 1"""))
def model_filter_after_alias(spark, sf):
    alias = spark.createDataFrame([("opal-mini", "opal-max", "opalhost"), ("opal-mini", "mini", ""), ("Opal-Mini", "mini", "")], "source string, target string, provider string")
    return with_aliases(facts(spark, sf), alias).where(Filter(models=("opal-max", "mini")).derived()).groupBy("model").agg(*A.measures())


def _hourly(unit: str) -> str:
    return _with(f"select date_trunc('{unit}', ts) as bucket, harness, model, resolved_provider, {_MEASURES} from facts group by 1, 2, 3, 4").replace("date_trunc('day', ts)", "cast(date_trunc('day', ts) as timestamp)")


@query(_hourly("day"))
def usage_daily(spark, sf):
    return A.usage(facts(spark, sf), "DAY")


@query(_hourly("hour"))
def usage_hourly(spark, sf):
    return A.usage(facts(spark, sf), "HOUR")


@query(_with("select count(distinct resolved_provider) as providers, max(ts) as newest, count(*) as events from facts"))
def freshness(spark, sf):
    return facts(spark, sf).agg(F.count_distinct("resolved_provider").alias("providers"), F.max("ts").alias("newest"), F.count(F.lit(1)).alias("events"))


@query(_with("select distinct resolved_provider from facts"))
def distinct_providers(spark, sf):
    return facts(spark, sf).select("resolved_provider").distinct()


@query(_with(f"select model, resolved_provider, count(*) as requests, cast(sum{_TOTAL} as bigint) as tokens from facts where not priced group by 1, 2"))
def unpriced_models(spark, sf):
    return A.unpriced_models(facts(spark, sf))


@query(_with("select harness, count(*) as deliveries, count(distinct session_id) as sessions from d group by 1", only_d=True))
def event_counts(spark, sf):
    return deliveries(spark, sf).groupBy("harness").agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("session_id").alias("sessions"))


@query(_with("""select harness, cast(least(sum(cast(delivery_id as hugeint) * 1000000000000000), 9223372036854775807) as bigint) as big from (select * from d where delivery_id < 9000) group by 1""", only_d=True).replace(" where delivery_id < 9000", ""))
def saturating_sum(spark, sf):
    wide = deliveries(spark, sf).withColumn("x", F.least(F.col("delivery_id").cast("decimal(38,0)") * F.lit(10).cast("decimal(2,0)") ** 0 * F.lit(1_000_000_000_000_000), F.lit(S.LONG_MAX)).cast("bigint"))
    return wide.groupBy("harness").agg(S.saturating_sum("x").alias("big"))


@query(_with("""select provider_id, count(*) as requests, string_agg(distinct member, ', ' order by member) as members from (
  select resolved_provider || ' ' || base_url as member,
   case when h <> '' and h not like '127.%' and h <> 'localhost' then 'endpoint:v1:' || sha256('provider-endpoint:v1:' || scheme || '://' || h || case when port = '' or (scheme = 'https' and port = '443') then '' else ':' || port end
        || regexp_replace(regexp_extract(base_url, '(?i)^https?://[^/]+(.*)$', 1), '/$', '')) else resolved_provider end as provider_id
  from (select f.resolved_provider, f.base_url, h.h, h.port, h.scheme from facts f join host h on h.delivery_id = f.delivery_id)) group by 1"""))
def endpoint_groups(spark, sf):
    known = with_endpoint(facts(spark, sf), "base_url").withColumn("provider_id", F.coalesce("endpoint_id", "resolved_provider"))
    return A.provider_groups(known).select("provider_id", "requests", "members")


_ID = """case when h <> '' and h not like '127.%' and h <> 'localhost' then 'endpoint:v1:' || sha256('provider-endpoint:v1:' || scheme || '://' || h || case when port = '' or (scheme = 'https' and port = '443') then '' else ':' || port end
        || regexp_replace(regexp_extract(base_url, '(?i)^https?://[^/]+(.*)$', 1), '/$', ''))
       else 'unresolved:v1:' || sha256('["' || harness || '","' || instance_id || '","' || resolved_provider || '","' || base_url || '"]') end"""
_IDENTIFIED = f"(select f.*, {_ID.replace('base_url', 'f.base_url').replace('harness', 'f.harness').replace('instance_id', 'f.instance_id').replace('resolved_provider', 'f.resolved_provider')} as provider_id from facts f join host h on h.delivery_id = f.delivery_id)"


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    return with_endpoint(facts(spark, sf), "base_url").withColumn("provider_id", provider_id())


@query(_with(f"select distinct harness, instance_id, resolved_provider, base_url, provider_id from {_IDENTIFIED}"))
def provider_identity(spark, sf):
    return _identified(spark, sf).select("harness", "instance_id", "resolved_provider", "base_url", "provider_id").distinct()


@query(_with(f"select {_MEASURES} from {_IDENTIFIED} where provider_id = 'endpoint:v1:' || sha256('provider-endpoint:v1:https://api.larkworks.test/v1')"))
def provider_id_filter(spark, sf):
    import hashlib

    wanted = "endpoint:v1:" + hashlib.sha256(b"provider-endpoint:v1:https://api.larkworks.test/v1").hexdigest()
    return _identified(spark, sf).where(Filter(provider_ids=(wanted,)).derived()).agg(*A.measures())


@query(_with(f"""select * from (
 select null as harness, null as model, {_MEASURES}, 3 as "grouping", max(ts) as freshest from facts union all
 select harness, null, {_MEASURES}, 2, max(ts) from facts group by harness union all
 select null, model, {_MEASURES}, 1, max(ts) from facts group by model)"""))
def envelope_groups(spark, sf):
    return A.envelope(facts(spark, sf), "harness", "model")


# ---- series

_AXIS = "select cast(unnest(generate_series({lo}, {hi}, interval 1 {unit})) as timestamp) as bucket"


@query(_with(f"""select a.bucket, coalesce(s.input, 0) as input, coalesce(s.output, 0) as output from ({_AXIS.format(lo="timestamp '2026-02-20'", hi="timestamp '2026-09-09'", unit='day')}) a left join (
 select cast(date_trunc('day', ts) as timestamp) as bucket, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output from facts group by 1) s using (bucket)"""))
def daily_zero_fill(spark, sf):
    return series.dense(facts(spark, sf), "ts", ("input", "output"), "DAY", F.lit("2026-02-20").cast("timestamp"), F.lit("2026-09-10").cast("timestamp"))


@query(_with(f"""select a.bucket, coalesce(s.output, 0) as output from ({_AXIS.format(lo="(select date_trunc('hour', min(ts)) from facts)", hi="(select date_trunc('hour', max(ts)) from facts)", unit='hour')}) a left join (
 select date_trunc('hour', ts) as bucket, cast(sum(output) as bigint) as output from facts group by 1) s using (bucket)"""))
def hourly_zero_fill(spark, sf):
    return series.dense(facts(spark, sf), "ts", ("output",), "HOUR")


def _daily_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts(spark, sf).withColumn("tokens", S.total()).withColumn("micro", F.round(F.col("cost") * 1_000_000).cast("bigint"))
    return series.dense(rows, "ts", ("tokens", "micro"), "DAY").select(F.col("bucket").cast("date").alias("day"), "tokens", "micro")


_DAYS = f"""days as (select cast(a.bucket as date) as day, coalesce(s.tokens, 0) as tokens, coalesce(s.micro, 0) as micro from (
 {_AXIS.format(lo="(select date_trunc('day', min(ts)) from facts)", hi="(select date_trunc('day', max(ts)) from facts)", unit='day')}) a left join (
 select cast(date_trunc('day', ts) as timestamp) as bucket, cast(sum({_TOTAL}) as bigint) as tokens, cast(sum(cast(round(cost * 1000000) as bigint)) as bigint) as micro from facts group by 1) s using (bucket))"""


@query(_with("select 1").replace("\nselect 1", f""", {_DAYS}, ax as (select cast(unnest(generate_series(timestamp '2025-08-25', timestamp '2026-08-30', interval 1 day)) as date) as day)
 select ax.day, coalesce(days.tokens, 0) as tokens from ax left join days using (day)"""))
def year_grid(spark, sf):
    end = F.lit("2026-08-30").cast("date")
    monday = F.date_sub(F.date_sub(end, 364), (F.dayofweek(F.date_sub(end, 364)) + 5) % 7)
    rows = facts(spark, sf).withColumn("tokens", S.total())
    return series.dense(rows, "ts", ("tokens",), "DAY", monday.cast("timestamp"), F.lit("2026-08-31").cast("timestamp")).select(F.col("bucket").cast("date").alias("day"), "tokens")


@query(_with("select 1").replace("\nselect 1", f""", {_DAYS}
 select 'week' as unit, min(day) as first_day, max(day) as last_day, cast(sum(tokens) as bigint) as tokens from days, (select max(day) as last from days) group by (last - day) // 7"""))
def fold_weeks(spark, sf):
    return series.fold_bars(_daily_cost(spark, sf).select("day", "tokens"), "day", "tokens", daily_max=30)


@query(_with("select 1").replace("\nselect 1", f""", {_DAYS}
 select 'month' as unit, min(day) as first_day, max(day) as last_day, cast(sum(tokens) as bigint) as tokens from days group by date_trunc('month', day)"""))
def fold_months(spark, sf):
    return series.fold_bars(_daily_cost(spark, sf).select("day", "tokens"), "day", "tokens", daily_max=30, weekly_max=60)


@query(_with("select 1").replace("\nselect 1", f""", {_DAYS}
 select day, cast(sum(micro) over (partition by date_trunc('month', day) order by day) as bigint) as running from days"""))
def month_to_date_cumulative(spark, sf):
    months = _daily_cost(spark, sf).withColumn("month", F.trunc("day", "MONTH"))
    return series.cumulative(months, "day", "micro", ["month"]).select("day", F.col("running").cast("bigint").alias("running"))


def _strip_sql(bucket: str, key: str, k: int, where: str) -> str:
    return _with(f"""select {bucket} as bucket, case when {key} in (select {key} from facts where {where} group by 1 order by sum(output) desc, {key} limit {k}) then {key} else 'other' end as {key},
 cast(sum(output) as bigint) as output from facts where {where} group by 1, 2""")


@query(_strip_sql("cast(hour(ts) as integer)", "harness", 4, "ts >= timestamp '2026-08-01'"))
def hour_strip_top4(spark, sf):
    return series.strip(facts(spark, sf).where("ts >= timestamp '2026-08-01'"), F.hour("ts"), "harness", "output", 4)


@query(_strip_sql("cast(ts as date)", "harness", 5, "ts >= timestamp '2026-06-01'"))
def ninety_day_top5(spark, sf):
    return series.strip(facts(spark, sf).where("ts >= timestamp '2026-06-01'"), F.to_date("ts"), "harness", "output", 5)


@query(_with("select 1").replace("\nselect 1", f""", {_DAYS}, act as (select day, day - cast(row_number() over (order by day) as integer) as g from days where tokens > 0)
 select min(day) as first_day, max(day) as last_day, count(*) as length, (select max(day) from days) - max(day) <= 1 as "current" from act group by g"""))
def usage_streaks(spark, sf):
    return series.streaks(_daily_cost(spark, sf), "day", F.col("tokens") > 0)


@query(_with("select 1").replace("\nselect 1", f""", {_DAYS}, q as (select list(micro order by micro) filter (where micro > 0) as a from days)
 select day, tokens, micro, case when micro <= 0 and tokens = 0 then 0 when micro <= a[least(cast(floor(len(a) * 0.25) as integer), len(a) - 1) + 1] then 1
  when micro <= a[least(cast(floor(len(a) * 0.5) as integer), len(a) - 1) + 1] then 2 when micro <= a[least(cast(floor(len(a) * 0.75) as integer), len(a) - 1) + 1] then 3 else 4 end as level from days, q"""))
def heat_levels(spark, sf):
    return series.heat_levels(_daily_cost(spark, sf), "micro", "tokens")


# ---- rollups

_RK = "harness, instance_id, session_id, resolved_provider, model, project"


@query(_with(f"select model, {_MEASURES} from facts group by 1"))
def rollup_equals_facts(spark, sf):
    return A.from_rollup(A.day_rollup(facts(spark, sf)), "model")


@query(_with(f"select base_url, cast(ts as date) as day, {_MEASURES} from facts group by 1, 2"))
def endpoint_rollup(spark, sf):
    return A.from_rollup(A.day_rollup(facts(spark, sf), "base_url"), "base_url", "day")


@query(_with(f"select harness, {_MEASURES} from facts where ts >= timestamp '2026-04-10 13:30:00' and ts < timestamp '2026-06-20 07:15:00' group by 1"))
def rollup_union_edges(spark, sf):
    ev = facts(spark, sf)
    return A.from_rollup(A.rollup_with_edges(A.day_rollup(ev), ev, F.lit("2026-04-10 13:30:00").cast("timestamp"), F.lit("2026-06-20 07:15:00").cast("timestamp")), "harness")


@query(_with(f"select cast(ts as date) as day, {_MEASURES} from facts group by 1"))
def rollup_refresh(spark, sf):
    ev = facts(spark, sf)
    old = A.day_rollup(ev.where("delivery_id % 3 <> 0"))
    touched = ev.where("delivery_id % 3 = 0").select(F.to_date("ts").alias("day"))
    return A.from_rollup(A.refresh_days(old, ev, touched), "day")


@query("""with best as (select day, harness, arg_max(input, (rebuild_no, input, output, requests)) as input, arg_max(output, (rebuild_no, input, output, requests)) as output,
 arg_max(requests, (rebuild_no, input, output, requests)) as requests from daily_usage group by day, harness, instance_id, session_id, resolved_provider, model, project, attrib)
 select day, harness, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, cast(sum(requests) as bigint) as requests from best group by 1, 2""")
def stored_rollup_by_day(spark, sf):
    from tallyforge.operators.trailing import latest_rebuild

    key = ["day", "harness", "instance_id", "session_id", "resolved_provider", "model", "project", "attrib"]
    best = latest_rebuild(table(spark, sf, "daily_usage").select(*key, "rebuild_no", "input", "output", "requests"), key)
    return best.groupBy("day", "harness").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("requests").alias("requests"))


# ---- merges

@query("select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2")
def max_merge_dedup(spark, sf):
    return merge.max_merge(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


@query(_with("select harness, instance_id, dedup_key, delivery_id, input, output from (select *, row_number() over (partition by harness, instance_id, dedup_key order by delivery_id desc) as rn from d) where rn = 1", only_d=True))
def last_write_wins(spark, sf):
    return merge.last_write_wins(deliveries(spark, sf).select(*KEY, "delivery_id", "input", "output"), KEY, "delivery_id")


@query(_with("select harness, instance_id, dedup_key, session_id, parent_id, input, output, request_id, boundary, bill_amount, delivery_id from facts"))
def root_owner_upsert(spark, sf):
    return facts(spark, sf).select(*KEY, "session_id", "parent_id", "input", "output", "request_id", "boundary", "bill_amount", "delivery_id")


@query(_with("select harness, instance_id, session_id, parent_id, title, project, started_at, updated_at from meta", meta=True))
def session_fold(spark, sf):
    return sessions(spark, sf)


@query(_with("select distinct harness, instance_id, parent_id as session_id from d where parent_id <> ''", only_d=True))
def parent_stubs(spark, sf):
    return merge.parent_stubs(deliveries(spark, sf))


_CUT = "2026-07-01 00:00:00"


@query(_with(f"""select harness, count(*) as new_keys from (select distinct harness, instance_id, dedup_key from d where received_at >= timestamp '{_CUT}'
 except select harness, instance_id, dedup_key from d where received_at < timestamp '{_CUT}') group by 1""", only_d=True))
def first_insert_report(spark, sf):
    d = deliveries(spark, sf)
    old, new = d.where(F.col("received_at") < F.lit(_CUT).cast("timestamp")), d.where(F.col("received_at") >= F.lit(_CUT).cast("timestamp"))
    return merge.first_inserts(new, old).groupBy("harness").agg(F.count(F.lit(1)).alias("new_keys"))


@query(_with("select harness, instance_id, dedup_key, case when min(git_branch) = max(git_branch) then min(git_branch) else '' end as branch from d where git_branch <> '' group by 1, 2, 3", only_d=True))
def branch_evidence(spark, sf):
    return merge.branch_evidence(deliveries(spark, sf))


@query(_with("select distinct s.harness, s.instance_id, s.session_id from sms s where not exists (select 1 from facts f where f.harness = s.harness and f.instance_id = s.instance_id and f.session_id = s.session_id)", meta=True))
def orphan_prune(spark, sf):
    raw = table(spark, sf, "session_meta")
    side = merge.fold_sessions(raw, "updated_at").select(F.coalesce("harness", F.lit("")).alias("harness"), F.coalesce(F.nullif(F.trim("instance_id"), F.lit("")), F.lit("default")).alias("instance_id"), "session_id").distinct()
    return merge.prune_orphans(side, facts(spark, sf), SESSION_KEY)[1]


@query(_with("select harness, count(*) as rows_kept, cast(sum(input) as bigint) as input from facts group by 1"))
def scoped_reingest(spark, sf):
    ev = facts(spark, sf)
    scope = ev.where("harness = 'codex'")
    out = merge.replace_sessions(ev, scope, scope)
    return out.groupBy("harness").agg(F.count(F.lit(1)).alias("rows_kept"), F.sum("input").alias("input"))


# ---- ordered analytics

@query("""select user_id, event_id, greatest(v - coalesce(max(v) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0), 0) as delta
 from (select user_id, event_id, ts, cast(floor(value) as bigint) as v from events)""")
def cumulative_delta(spark, sf):
    ev = table(spark, sf, "events").withColumn("v", F.floor("value").cast("bigint"))
    return ordered.cumulative_delta(ev, ["user_id"], ["ts", "event_id"], "v").select("user_id", "event_id", "delta")


@query("""select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p, row_number() over (partition by user_id order by ts, event_id) as rn from events)
 where rn = 1 or p is distinct from event_type""")
def snapshot_suppress(spark, sf):
    ev = table(spark, sf, "events")
    first = ordered.suppress_repeats(ev, ["user_id"], ["ts", "event_id"], ["event_type"])
    return first.select("event_id")


@query("""select event_id, coalesce(v < lag(v) over (partition by user_id order by ts, event_id) // 2, false) as compacted from (select event_id, user_id, ts, cast(floor(value) as bigint) as v from events)""")
def compaction_infer(spark, sf):
    ev = table(spark, sf, "events").withColumn("v", F.floor("value").cast("bigint"))
    return ordered.inferred_compaction(ev, ["user_id"], ["ts", "event_id"], "v").select("event_id", "compacted")


@query(_with("""select delivery_id, last_value(nullif(git_branch, '') ignore nulls) over (partition by harness, instance_id, session_id order by ts, delivery_id rows between unbounded preceding and current row) as branch from facts"""))
def forward_fill(spark, sf):
    return ordered.forward_fill(facts(spark, sf), SESSION_KEY, ["ts", "delivery_id"], "git_branch", "branch").select("delivery_id", "branch")


@query(_with("""select delivery_id, first_value(nullif(git_branch, '') ignore nulls) over (partition by harness, instance_id, session_id order by ts, delivery_id rows between current row and unbounded following) as branch from facts"""))
def back_fill(spark, sf):
    return ordered.back_fill(facts(spark, sf), SESSION_KEY, ["ts", "delivery_id"], "git_branch", "branch").select("delivery_id", "branch")


@query(_with("""select delivery_id, round(sum(cost) over (partition by harness, instance_id, session_id order by ts, dedup_key rows between unbounded preceding and current row), 6) as running from facts"""))
def running_cost(spark, sf):
    return ordered.running_sum(facts(spark, sf), SESSION_KEY, ["ts", "dedup_key"], "cost", "running").select("delivery_id", "running")


def _rate_sql(tail: str) -> str:
    return _with(f"""select 1""").replace("\nselect 1", f""", g as (
 select *, (epoch_us(timestamp '{NOW}') - epoch_us(ts)) / 1000000.0 as age, (epoch_us(ts) - epoch_us(lag(ts) over (partition by harness, instance_id, session_id order by ts, dedup_key))) / 1000000.0 as gap from facts),
r as (select harness, instance_id, session_id, count(*) as requests, sum(output) filter (where age <= 90 and decode_ms > 0) as t_out, sum(decode_ms) filter (where age <= 90 and decode_ms > 0) as t_ms,
 sum(output + reasoning) filter (where age <= 90 and decode_ms = 0 and gap <= 90) as o, sum(greatest(gap, (output + reasoning) / 300.0)) filter (where age <= 90 and decode_ms = 0 and gap <= 90) as secs
 from g where gap is not null and age <= 600 group by 1, 2, 3)
{tail}""")


@query(_rate_sql("select harness, instance_id, session_id, requests, round(case when t_ms > 0 and t_out > 0 then t_out / (t_ms / 1000.0) when secs >= 1 and o > 0 then o / secs else 0.0 end, 6) as rate from r").replace("age <= 90", "age <= 86400").replace("gap <= 90", "gap <= 3600").replace("age <= 600", "age <= 864000"))
def output_rate(spark, sf):
    out = ordered.output_rate(facts(spark, sf), SESSION_KEY, F.lit(NOW).cast("timestamp"), live_s=86_400, count_s=864_000)
    return out


ORACLE["output_rate"] = ORACLE["output_rate"].replace("gap <= 3600", "gap <= 86400")


@query(_with(f"""select harness, instance_id, session_id, max(ts) as newest, arg_max(model, (ts, dedup_key)) as model, round(sum(cost) filter (where ts > timestamp '2026-08-29 22:00:00'), 6) as day_cost
 from facts where ts > timestamp '2026-08-23 22:00:00' group by 1, 2, 3 order by newest desc, harness, session_id limit 12"""))
def active_sessions(spark, sf):
    ev = facts(spark, sf).where("ts > timestamp '2026-08-23 22:00:00'")
    return ev.groupBy(*SESSION_KEY).agg(
        F.max("ts").alias("newest"), F.max_by("model", F.struct("ts", "dedup_key")).alias("model"),
        F.round(F.sum(F.when(F.col("ts") > F.lit("2026-08-29 22:00:00").cast("timestamp"), F.col("cost"))), 6).alias("day_cost")).orderBy(F.desc("newest"), "harness", "session_id").limit(12)


@query("""with day as (select o_custkey, cast(o_orderdate as date) as day, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as f, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as l from orders group by 1, 2)
 select o_custkey, day, round(greatest(f - l, 0) + greatest(coalesce(lag(l) over (partition by o_custkey order by day) - f, 0), 0), 6) as used from day""")
def balance_daily_use(spark, sf):
    o = table(spark, sf, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey")).withColumn("bal", F.col("o_totalprice"))
    day = o.withColumn("day_at", F.col("o_orderdate"))
    first = day.groupBy("o_custkey", F.to_date("day_at").alias("d")).agg(F.min_by("bal", "at").alias("f"), F.max_by("bal", "at").alias("l"))
    two = first.select("o_custkey", F.explode(F.array(F.struct(F.col("d").cast("timestamp").alias("at"), F.col("f").alias("b")),
                                                      F.struct((F.col("d").cast("timestamp") + F.expr("interval 1 hour")).alias("at"), F.col("l").alias("b")))).alias("x")).select("o_custkey", "x.at", "x.b")
    return ordered.balance_use(two, ["o_custkey"], "at", "b").select("o_custkey", "day", "used")


# ---- session trees

@query(_with("select harness, instance_id, session_id, root_id, depth from tree", meta=True))
def session_roots(spark, sf):
    return H.session_tree(sessions(spark, sf)).select(*SESSION_KEY, "root_id", "depth")


_ROWS = f""", sums as (select c.harness, c.instance_id, c.ancestor as session_id, {_MEASURES} from facts f join closure c using (harness, instance_id, session_id) group by 1, 2, 3),
 kids as (select harness, instance_id, parent_id as session_id, count(*) as children from meta where parent_id <> '' group by 1, 2, 3),
 srow as (select m.*, coalesce(input, 0) as input, coalesce(output, 0) as output, coalesce(cost, 0) as cost, coalesce(requests, 0) as requests, coalesce(children, 0) as children,
   coalesce({_TOTAL}, 0) as total from meta m left join sums using (harness, instance_id, session_id) left join kids using (harness, instance_id, session_id))"""


@query(_with("select 1", meta=True).replace("\nselect 1", _ROWS + " select harness, instance_id, session_id, input, output, cost, requests, children, total from srow"))
def session_rollup(spark, sf):
    return H.session_rows(facts(spark, sf), sessions(spark, sf)).select(*SESSION_KEY, "input", "output", "cost", "requests", "children", "total")


def _page(name: str, order: str, sql_order: str) -> None:
    @query(_with("select 1", meta=True).replace("\nselect 1", _ROWS + f""" select harness, instance_id, session_id, title, cost, requests, total, (select count(*) from srow where parent_id = '' and requests > 0) as of_total
     from srow where parent_id = '' and requests > 0 order by {sql_order} desc, harness, session_id, instance_id limit 20 offset 10"""), name=name)
    def run(spark, sf):
        rows = H.session_rows(facts(spark, sf), sessions(spark, sf))
        return H.page(rows, order, 20, 10).select(*SESSION_KEY, "title", "cost", "requests", "total", "of_total")


for _name, _order, _sql in (("session_page_recent", "recent", "updated_at"), ("session_page_tokens", "tokens", "total"), ("session_page_cost", "cost", "cost")):
    _page(_name, _order, _sql)


@query(_with(f"select c.harness, c.instance_id, c.ancestor as session_id, resolved_provider, model, {_SUMS}, count(*) as requests, cast(sum{_TOTAL} as bigint) as total from facts f join closure c using (harness, instance_id, session_id) group by 1, 2, 3, 4, 5", meta=True))
def session_breakdown(spark, sf):
    return H.breakdown(facts(spark, sf), cut(H.session_tree(sessions(spark, sf))))


_HOT = "0f0e5c1a-7d11-4b8e-9c3d-aa10c0ffee01"


@query(_with(f"select dedup_key, ts, model, input, output, cost from facts where harness = 'claude-code' and instance_id = 'default' and session_id = '{_HOT}'"))
def session_events(spark, sf):
    ev = facts(spark, sf).where("harness = 'claude-code' and instance_id = 'default'")
    meta = sessions(spark, sf).where("harness = 'claude-code' and instance_id = 'default'")
    return H.detail(ev, meta, "claude-code", _HOT)[2].select("dedup_key", "ts", "model", "input", "output", "cost")


@query(_with("select 1", meta=True).replace("\nselect 1", _ROWS + f" select session_id, least(started_at, (select min(ts) from facts f where f.harness = 'claude-code' and f.instance_id = 'default' and f.session_id = '{_HOT}')) as started_at, greatest(updated_at, (select max(ts) from facts f where f.harness = 'claude-code' and f.instance_id = 'default' and f.session_id = '{_HOT}')) as updated_at, requests, total, children from srow where harness = 'claude-code' and instance_id = 'default' and session_id = '{_HOT}'"))
def session_detail(spark, sf):
    ev = facts(spark, sf).where("harness = 'claude-code' and instance_id = 'default'")
    meta = sessions(spark, sf).where("harness = 'claude-code' and instance_id = 'default'")
    return H.detail(ev, meta, "claude-code", _HOT)[0].select("session_id", "started_at", "updated_at", "requests", "total", "children")


@query(_with(f"select harness, instance_id, session_id, max(ts) as newest, {_MEASURES} from facts where ts > timestamp '2026-08-29 22:00:00' and ts <= timestamp '{NOW}' group by 1, 2, 3 order by newest desc, harness, session_id limit 1"))
def statusline(spark, sf):
    ev = facts(spark, sf).where(f"ts > timestamp '2026-08-29 22:00:00' and ts <= timestamp '{NOW}'")
    return ev.groupBy(*SESSION_KEY).agg(F.max("ts").alias("newest"), *A.measures()).orderBy(F.desc("newest"), "harness", "session_id").limit(1)


@query(_with("select harness, instance_id, session_id, title from meta where lower(title || ' ' || project || ' ' || harness || ' ' || session_id) like '%fix%' and lower(title || ' ' || project || ' ' || harness || ' ' || session_id) like '%reader%'", meta=True))
def session_search(spark, sf):
    return search(sessions(spark, sf), "Fix READER", ("title", "project", "harness", "session_id")).select(*SESSION_KEY, "title")


@query(_with("select model, count(*) as n from facts where starts_with(model, 'opal-m') group by 1"))
def prefix_filter(spark, sf):
    return facts(spark, sf).where(starts_with("model", "opal-m")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


# ---- temporal and ordered joins

@query("""select event_id, o.o_orderkey from events e asof left join (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by 1, 2) o on o.o_custkey = e.user_id and o.o_orderdate <= e.ts""")
def config_timeline_asof(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return asof.asof_backward(ev, right, ["user_id"], "ts", "o_orderdate", ["o_orderkey"], block_s=30 * 86_400).select("event_id", "o_orderkey")


@query("""with e as (select event_id, event_type, user_id, ts from events)
 select a.event_id, (select b.event_id from e b where b.user_id = a.user_id and b.event_type = 'purchase' and abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 3600000000 order by abs(epoch_us(b.ts) - epoch_us(a.ts)), b.event_id limit 1) as match
 from e a where a.event_type = 'click'""")
def nearest_request_match(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts")
    right = ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("match"))
    return asof.nearest_within(ev.where("event_type = 'click'"), right, ["user_id"], "ts", "at", 3600, "event_id", "match", ["match"]).select("event_id", "match")


_RULES = [(1, "codex", "", "rule-a"), (2, "", "opal-max", "rule-b"), (3, "codex", "opal-max", "rule-c"), (4, "gemini", "", "rule-d")]


@query(_with(f"""select delivery_id, (select p from (values {', '.join(map(str, _RULES))}) r(o, h, m, p) where (h = '' or h = f.harness) and (m = '' or m = f.model) order by o limit 1) as picked from facts f"""))
def rule_first_match(spark, sf):
    rules = [dict(zip(("harness", "model", "picked"), r[1:])) for r in _RULES]

    def fits(r: dict):
        return (F.lit(r["harness"] == "") | (F.col("harness") == r["harness"])) & (F.lit(r["model"] == "") | (F.col("model") == r["model"]))

    return asof.first_matching_rule(facts(spark, sf), rules, fits, "picked", "picked").select("delivery_id", "picked")


@query("""select event_id from events a where event_type = 'view' and not exists (select 1 from events b where b.event_type = 'click' and b.user_id = a.user_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000)""")
def interval_anti(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts")
    return asof.interval_anti(ev.where("event_type = 'view'"), ev.where("event_type = 'click'").select("user_id", F.col("ts").alias("at")), ["user_id"], "ts", "at", 3600).select("event_id")


# ---- scalars

@query(_with("""select distinct model, replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(model, '^.*/', ''))), ':latest$', ''), '-latest$', ''), '[-:]\\d{4}-?\\d{2}-?\\d{2}$', ''), '.', '-') as normal from d""", only_d=True))
def normalize_model_name(spark, sf):
    return deliveries(spark, sf).select("model").distinct().withColumn("normal", S.normal_model("model"))


@query("""select p_name, case when n = 'part1' then 0 when contains(n, 'part1') then 1 else levenshtein('part1', n) * 4 end as score from (
 select distinct p_name, regexp_replace(replace(replace(regexp_replace(lower(trim(p_name)), '[-:]\\d{4}-?\\d{2}-?\\d{2}$', ''), '.', '-'), '-', ''), '[_:]', '', 'g') as n from part) order by score, p_name limit 25""")
def catalog_search(spark, sf):
    n = S.search_name("p_name")
    score = F.when(n == "part1", 0).when(n.contains("part1"), 1).otherwise(F.levenshtein(n, F.lit("part1")) * 4)
    return table(spark, sf, "part").select("p_name").distinct().withColumn("score", score.cast("bigint")).orderBy("score", "p_name").limit(25)


@query("""select brand, p_name from (select upper(p_brand) as brand, p_name, row_number() over (partition by upper(p_brand) order by p_size, p_name, p_partkey) as rn from part) where rn = 1""")
def best_spelling(spark, sf):
    parts = table(spark, sf, "part").select(F.upper("p_brand").alias("brand"), "p_name", "p_size", "p_partkey")
    return merge.best_spelling(parts, "brand", ["p_size", "p_name", "p_partkey"]).select("brand", "p_name")


@query(_with("""select distinct provider, base_url, resolved_provider from facts"""))
def provider_resolution(spark, sf):
    return facts(spark, sf).select("provider", "base_url", "resolved_provider").distinct()


@query(_with("""select delivery_id, greatest(0, least(cache_read, input)) as cached, case when cache_read > 0 and output = input + reasoning then greatest(input - cache_read, 0) else input end as fresh,
 greatest(output - (input + reasoning), 0) as remainder, round(case when input + cache_read + cache_write > 0 then cache_read / (input + cache_read + cache_write) else 0 end, 6) as hit,
 case when log_cost is not null then 'log' when priced then 'estimate' else 'unpriced' end as cost_source from facts"""))
def token_algebra(spark, sf):
    c = F.col
    return facts(spark, sf).select(
        "delivery_id", S.clamp_subset(c("cache_read"), c("input")).alias("cached"), S.subtract_if_proved(c("input"), c("cache_read"), c("output"), c("reasoning")).alias("fresh"),
        F.greatest(c("output") - (c("input") + c("reasoning")), F.lit(0)).alias("remainder"),
        F.round(S.hit_rate(c("cache_read"), c("input"), c("cache_write")), 6).alias("hit"), S.cost_source(c("log_cost"), c("priced")).alias("cost_source"))


@query("select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 60) as title, cast(ceil(length(text) / 4.0) as bigint) as estimate, starts_with(ltrim(text), '<') or starts_with(ltrim(text), 'Caveat:') or starts_with(ltrim(text), '# AGENTS.md') as wrapper from documents")
def titles_and_estimates(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.title("text").alias("title"), F.ceil(F.char_length("text") / 4.0).cast("bigint").alias("estimate"), S.is_wrapper("text").alias("wrapper"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def props_json_decode(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def _chat_sql() -> str:
    from tallyforge.operators.drift import USAGE_NAMES

    def num(path: str) -> str:
        return f"try_cast(json_extract_string(body, '$.{path}') as double)"

    def first(at: str, q: str) -> str:
        return f"greatest(cast(trunc(coalesce({', '.join(num(f'{at}.{n}') for n in USAGE_NAMES[q])}, 0)) as bigint), 0)"

    cols = []
    for i, at in enumerate(("metadata.usage", "metadata.codebuff.usage")):
        alone = f"{num(at + '.inputTokens')} is null and {num(at + '.input_tokens')} is not null"
        inp, out, read, write = (first(at, q) for q in ("input", "output", "cache_read", "cache_write"))
        cols.append(f"case when {alone} then {inp} else greatest({inp} - {read} - {write}, 0) end as i{i}, {out} as o{i}, {read} as r{i}, {write} as w{i}")
    pick = ", ".join(f"case when i0 + o0 + r0 + w0 > 0 then {c}0 else {c}1 end as {n}" for c, n in zip("iorw", ("input", "output", "cache_read", "cache_write")))
    return f"""with u as (select 'codebuff:' || replace(source_path, '/', '_') || ':' || json_extract_string(body, '$.id') as dedup_key, lower(coalesce(nullif(json_extract_string(body, '$.variant'), ''), json_extract_string(body, '$.role'))) as kind,
      greatest(try_cast(json_extract_string(body, '$.credits') as double), 0) as credit, {', '.join(cols)} from chat_lines where coalesce(json_extract_string(body, '$.timestamp'), json_extract_string(body, '$.metadata.timestamp')) is not null),
     p as (select dedup_key, kind, credit, {pick} from u)
     select dedup_key, max(input) as input, max(output) as output, max(cache_read) as cache_read, max(cache_write) as cache_write from p
     where kind in ('ai', 'agent', 'assistant') and (input + output + cache_read + cache_write > 0 or credit is not null) group by 1"""


@query(_chat_sql())
def reader_codebuff(spark, sf):
    """The chat reader over all chat lines, each line a message of the document it was written to."""
    from tallyforge.sources.dialects import READERS

    lines = table(spark, sf, "chat_lines").where("body is not null").select(
        F.concat(F.translate("source_path", "/", "_"), F.lit("/chat")).alias("source_path"), F.concat(F.lit("["), "body", F.lit("]")).alias("line"))
    return READERS["codebuff"](lines).select("dedup_key", "input", "output", "cache_read", "cache_write")


# ---- reporting periods

def _sum_if(cond: str) -> str:
    return f"coalesce(cast(sum(cast(round(cost * 1000000) as bigint)) filter (where {cond}) as bigint), 0)"


_PERIODS = {"today": ("2026-08-30", "2026-08-31"), "yesterday": ("2026-08-29", "2026-08-30"), "month": ("2026-08-01", "2026-09-01"), "last_month": ("2026-07-01", "2026-08-01"),
            "d7": ("2026-08-24", "2026-08-31"), "d30": ("2026-08-01", "2026-08-31"), "d90": ("2026-06-02", "2026-08-31")}


@query(_with("select " + ", ".join(_sum_if(f"ts >= timestamp '{a}' and ts < timestamp '{b}'") + f" as {n}" for n, (a, b) in _PERIODS.items()) + " from facts"))
def overview_sums(spark, sf):
    from datetime import date, timedelta, timezone

    from tallyforge.operators import periods as P

    today, utc = date(2026, 8, 30), timezone.utc
    day, month = P.period("day", today, utc), P.period("month", today, utc)
    spans = {"today": day, "yesterday": P.previous("day", day, utc), "month": month, "last_month": P.previous("month", month, utc)}
    spans |= {f"d{n}": (P.day_start(today - timedelta(days=n - 1), utc), day.end) for n in (7, 30, 90)}
    return P.period_sums(facts(spark, sf), spans, F.round(F.col("cost") * 1_000_000).cast("bigint"))


@query(_with("select round((m + w / 7.0 * 1) / 1000000, 4) as forecast, round(m / lm - 1, 6) as delta from (select " + _sum_if("ts >= timestamp '2026-08-01'") + " as m, " + _sum_if("ts >= timestamp '2026-08-23' and ts < timestamp '2026-08-30'") + " as w, " + _sum_if("ts >= timestamp '2026-07-01' and ts < timestamp '2026-08-01'") + " as lm from facts)"))
def forecast_and_delta(spark, sf):
    from datetime import date, timedelta, timezone

    from tallyforge.operators import periods as P

    today, utc = date(2026, 8, 30), timezone.utc
    month = P.period("month", today, utc)
    spans = {"m": month, "lm": P.previous("month", month, utc), "w": (P.day_start(today - timedelta(days=7), utc), P.day_start(today, utc))}
    sums = P.period_sums(facts(spark, sf), spans, F.round(F.col("cost") * 1_000_000).cast("bigint"))
    left = (month.last - today).days - 1
    return sums.select(F.round((F.col("m") + F.col("w") / 7.0 * left) / 1_000_000, 4).alias("forecast"), F.round(P.delta(F.col("m"), F.col("lm")), 6).alias("delta"))


@query("""with d as (select o_custkey, cast(o_orderdate as date) as day, sum(o_totalprice) as used from orders group by 1, 2), r as (select *, row_number() over (partition by o_custkey order by day desc) as rn from d)
 select o_custkey, round(100000 / avg(used), 4) as runway from r where rn <= 7 group by 1""")
def runway(spark, sf):
    from pyspark.sql import Window

    day = table(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("used"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("day"))
    return day.withColumn("rn", F.row_number().over(w)).where("rn <= 7").groupBy("o_custkey").agg(F.round(100_000 / F.avg("used"), 4).alias("runway"))


# the window is (at - 60 s, at], so the frame ends a microsecond before the minute
@query(_with("""select delivery_id, round(sum(output) over (order by received_at range between interval 59999999 microsecond preceding and current row) / 60.0, 6) as rate
 from d where received_at is not null""", only_d=True))
def trailing_rate_batch(spark, sf):
    """Trailing rate of every delivery that has an arrival."""
    from tallyforge.streaming.rate import trailing_rate

    return trailing_rate(deliveries(spark, sf).select("delivery_id", "received_at", "output"), "received_at", "output", 60).select("delivery_id", "rate")
