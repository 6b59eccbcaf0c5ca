"""Registered queries of the general data-preparation problems (p1 to p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import drift, flatten, hierarchy, redelivery, timestamps, trailing
from tallyforge.runtime import blank_to_null, table

#: last day of the calendars of the day rollup
CALENDAR_END = "2026-08-31"
#: arrival from which deliveries are new to the store
_NEW_SINCE = "2026-06-15"
_DAILY_KEY = ["day", "harness", "instance_id", "session_id", "resolved_provider", "model", "project", "attrib"]
_CHAT = {"columns": ["record_id", "stream_id", "file_no", "body"]}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries that repeat an earlier delivery of the same request."""
    return redelivery.dropped_deliveries(table(spark, sf, "usage_events"))


def p1_once(spark: SparkSession, sf: str) -> DataFrame:
    """Totals per harness over one delivery of each request."""
    kept = redelivery.keep_once(table(spark, sf, "usage_events").select(
        "delivery_id", "harness", "instance_id", "dedup_key", "request_id", "input", "output"))
    return kept.groupBy("harness").agg(F.count(F.lit(1)).alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def p1_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Stored deliveries (those that came first) merged with new ones: what stays of either, per harness."""
    rows = table(spark, sf, "usage_events").select("delivery_id", "harness", "instance_id", "dedup_key", "request_id", "received_at")
    new = F.col("received_at") >= F.lit(_NEW_SINCE).cast("timestamp")
    both = redelivery.merge_deliveries(rows.where(~new), rows.where(new))
    return both.groupBy("harness").agg(F.count_if(~new).alias("stored"), F.count_if(new).alias("added"))


def _project_days(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "daily_usage").select(*_DAILY_KEY, "rebuild_no", "cost")
    daily = daily.where(blank_to_null("project").isNotNull())
    return trailing.latest_rebuild(daily, _DAILY_KEY)


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return trailing.trailing_totals(_project_days(spark, sf), ["instance_id", "project"], "day", "cost", (7, 30), F.lit(CALENDAR_END).cast("date"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Quiet days (nothing in 7 days, something in 30) and days with a new peak of the 7-day total."""
    kinds = F.array_compact(F.array(
        F.when((F.col("total_7") == 0) & (F.col("total_30") > 0), "quiet"), F.when(F.col("new_high_7"), "peak")))
    return _totals(spark, sf).select("instance_id", "project", F.date_format("day", "yyyy-MM-dd").alias("day_key"), F.explode(kinds).alias("kind"))


def p2_trailing(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing totals and averages of every project of every instance and day."""
    return _totals(spark, sf).select("instance_id", "project", F.date_format("day", "yyyy-MM-dd").alias("day_key"), "total_7", "avg_7", "total_30", "avg_30")


_LINE_ORDER = ["line_no", "record_id"]


def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps whose zone nobody states take the estimated offset; it has to be that of UTC, which is checked."""
    lines = timestamps.line_stamps(table(spark, sf, "log_lines"), "line_no")
    return timestamps.normalise_stamps(lines, "raw", "host_tz", unknown_zone="estimate", order=_LINE_ORDER, rule_s=0)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The instant of every stamp that names exactly one."""
    return _stamps(spark, sf).where("utc_us is not null").select("record_id", "utc_us")


def p3_notes(spark: SparkSession, sf: str) -> DataFrame:
    """How many stamps were read in which way, or why not."""
    return _stamps(spark, sf).groupBy("stamp_note").agg(F.count(F.lit(1)).alias("lines"))


def p3_zone_history(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets estimated from arrival times for wall-clock stamps of machines with a known zone."""
    lines = timestamps.line_stamps(table(spark, sf, "log_lines"))
    stamps = timestamps.with_wall_clock(lines, "raw", "_local").where("_local is not null")
    return timestamps.zone_history(stamps.withColumn("_zone", F.coalesce("host_tz", F.lit(""))), "_zone", "received_at", "_local")


def p3_zone_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets estimated from arrival and sequence against those of the zones that machines state, per zone."""
    stamps = timestamps.line_stamps(table(spark, sf, "log_lines"), "line_no").withColumn("zone", blank_to_null("host_tz")).where("zone is not null")
    return timestamps.zone_accuracy(stamps, "zone", "raw", "host_tz", "received_at", "source_path", _LINE_ORDER).withColumnRenamed("source", "host_tz")


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    return drift.ingest(table(spark, sf, "chat_lines").select(*_CHAT["columns"]), "body", drift.CHAT_FIELDS, drift.CHAT_TYPES)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of schema between a file and the file before it."""
    return drift.drift_report(table(spark, sf, "chat_lines"), "stream_id", "file_no", "body").select(
        "stream_id", F.col("file_no").cast("int").alias("file_no"), "kind", "old_path", "new_path")


def p4_typed(spark: SparkSession, sf: str) -> DataFrame:
    """The one consistent table of all chat lines, with credits promoted from the rescue column."""
    typed = drift.promote(_chats(spark, sf), "credits", ("credits",), "double")
    return typed.select("record_id", "stream_id", "file_no", "input", "output", "cache_read", "cache_write", "model", "stamp", "credits", "rescued")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with an id and usage, with the nearest object around them that has an id."""
    return flatten.usage_nodes(table(spark, sf, "session_files"))


def p5_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of all objects: how many hang on which member, and how many have an id."""
    return flatten.flat_objects(table(spark, sf, "session_files")).groupBy("member").agg(
        F.count(F.lit(1)).alias("objects"), F.count("node_id").alias("with_id"), F.count("parent_node_id").alias("under_id"))


def p5_members(spark: SparkSession, sf: str) -> DataFrame:
    """Flat table of all scalar members and elements of arrays, counted by name and kind."""
    return flatten.flat_members(table(spark, sf, "session_files")).groupBy("name", "kind").agg(F.count(F.lit(1)).alias("members"))


def p5_linked(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables joined by their keys: scalars by the member their object hangs on, with the objects and records they are in."""
    files = table(spark, sf, "session_files").select("record_id", "body")
    objects = flatten.flat_objects(files).select("record_id", "node", "member", F.col("parent_node").isNotNull().alias("nested"))
    held = flatten.flat_members(files).select("record_id", "node", "name", "kind", F.col("position").isNotNull().alias("element"))
    per = held.groupBy("record_id", "node", "name", "kind", "element").agg(F.count(F.lit(1)).alias("n"))
    return per.join(objects, ["record_id", "node"]).groupBy("member", "nested", "name", "kind", "element").agg(F.sum("n").alias("scalars"), F.count(F.lit(1)).alias("objects"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every session that states a parent."""
    return hierarchy.session_hierarchy(table(spark, sf, "usage_events")).where("parent_id is not null").select(
        "harness", "instance_id", "session_id", "root_id", "depth")


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Number of descendants and of levels below every session of a tree that has any; ``p6_closure`` lists them."""
    tree = hierarchy.hierarchy(hierarchy.session_links(table(spark, sf, "usage_events")))
    return tree.where("descendants > 0").select("scope", F.col("node").alias("ancestor"), F.col("descendants").alias("below"), F.col("height").alias("levels"))


def p6_closure(spark: SparkSession, sf: str) -> DataFrame:
    """The descendants of every session, those on loops or leading into one too, with the number of links between."""
    tree = hierarchy.hierarchy(hierarchy.session_links(table(spark, sf, "usage_events")), paths=True)
    return hierarchy.closure(tree).select("scope", "ancestor", F.col("node").alias("descendant"), "distance")


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path of every session of a tree, and whether rows state several parents for it."""
    tree = hierarchy.hierarchy(hierarchy.session_links(table(spark, sf, "usage_events")), paths=True)
    return tree.where("depth >= 0").select("scope", "node", F.array_join("path", " > ").alias("way"), "conflict")


def p6_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions on loops, and which of them closes its loop."""
    return hierarchy.session_hierarchy(table(spark, sf, "usage_events")).where("in_cycle").select("harness", "instance_id", "session_id", "parent_id", "closes_cycle")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_once, p1_merge, p2_found, p2_trailing, p3_found, p3_notes, p3_zone_history, p3_zone_accuracy, p4_found, p4_typed, p5_found, p5_objects, p5_members, p5_linked, p6_found, p6_descendants, p6_closure, p6_paths, p6_cycles)}

_P1_CTE = r"""
with recursive n as (
  select delivery_id, received_at, input, output, harness, coalesce(harness, '') || chr(31) || coalesce(nullif(trim(instance_id, e' \t\r\n'), ''), 'default') as scope,
         lower(nullif(trim(dedup_key, e' \t\r\n'), '')) as dk, lower(nullif(trim(request_id, e' \t\r\n'), '')) as rid
  from usage_events),
p as (select *, coalesce('k' || dk, 'r' || rid) as pid from n),
bridge as (select distinct scope, rid from n where dk is null and rid is not null),
ties as (select distinct p.scope, 'k' || p.dk as pid, 'r' || p.rid as hub from p join bridge b on p.scope = b.scope and p.rid = b.rid where p.dk is not null),
links as (select scope, pid as a, hub as b from ties union select scope, hub, pid from ties),
reach as (select scope, a, a as b from links union select r.scope, r.a, l.b from reach r join links l on r.scope = l.scope and r.b = l.a),
label as (select scope, a as pid, min(b) as request from reach group by 1, 2),
named as (select p.*, coalesce(l.request, p.pid, 'd' || p.delivery_id) as request from p left join label l on p.scope = l.scope and p.pid = l.pid),
ranked as (select *, min(delivery_id) over (partition by scope, request) as first_id from named)
"""
_P2_CTE = """
with best as (
  select distinct d.* exclude (rebuild_no) from (
    select day, harness, instance_id, session_id, resolved_provider, model, project, attrib, rebuild_no, cost,
           max(rebuild_no) over (partition by day, harness, instance_id, session_id, resolved_provider, model, project, attrib) as top
    from daily_usage where trim(coalesce(project, '')) <> '') d where rebuild_no = top),
perday as (select instance_id, project, day, coalesce(sum(cast(cost as decimal(38,12))), 0) as amount from best group by 1, 2, 3),
cal as (select instance_id, project, cast(unnest(generate_series(min(day), date '2026-08-31', interval 1 day)) as date) as day from perday group by 1, 2),
dense as (select c.instance_id, c.project, c.day, coalesce(p.amount, 0) as amount from cal c left join perday p using (instance_id, project, day)),
roll as (select *, round(sum(amount) over w7, 6) as t7, round(sum(amount) over w30, 6) as t30, sum(amount) over w7 as s7, sum(amount) over w30 as s30 from dense
  window w7 as (partition by instance_id, project order by day rows between 6 preceding and current row),
         w30 as (partition by instance_id, project order by day rows between 29 preceding and current row)),
peaks as (select *, max(t7) over (partition by instance_id, project order by day rows between unbounded preceding and 1 preceding) as before from roll)
"""


def _p4_sql() -> str:
    """Changes between files by comparing their member paths pair by pair."""
    known = ", ".join(f"('{q}', {k}, '{p}')" for q, paths in drift.CHAT_FIELDS.items() for k, p in enumerate(paths))
    return f"""
with leaf as (
  select stream_id, file_no, substr(t.fullkey, 3) as path, case t.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'number' end as kind
  from chat_lines, json_tree(body) t where t.type not in ('OBJECT', 'NULL') and t.fullkey <> '$' and not contains(t.fullkey, '[')),
per as (select stream_id, file_no, path, string_agg(distinct kind, '+' order by kind) as kind from leaf group by 1, 2, 3),
pair as (select stream_id, file_no, lag(file_no) over (partition by stream_id order by file_no) as before from (select distinct stream_id, file_no from chat_lines)),
old as (select pair.stream_id, pair.file_no, per.path, per.kind from pair join per on per.stream_id = pair.stream_id and per.file_no = pair.before),
new as (select pair.stream_id, pair.file_no, per.path, per.kind from pair join per on per.stream_id = pair.stream_id and per.file_no = pair.file_no where pair.before is not null),
gone as (select * from old anti join new using (stream_id, file_no, path)), came as (select * from new anti join old using (stream_id, file_no, path)),
known(quantity, ord, path) as (values {known}),
g as (select *, row_number() over (partition by stream_id, file_no, quantity order by ord) as k from gone join known using (path)),
c as (select *, row_number() over (partition by stream_id, file_no, quantity order by ord) as k from came join known using (path)),
moved as (select g.stream_id, g.file_no, g.path as old_path, c.path as new_path from g join c using (stream_id, file_no, quantity, k))
select stream_id, file_no, 'retyped' as kind, path as old_path, path as new_path from old join new using (stream_id, file_no, path) where old.kind <> new.kind
union all select stream_id, file_no, 'renamed', old_path, new_path from moved
union all select stream_id, file_no, 'removed', path, '' from gone anti join moved on moved.stream_id = gone.stream_id and moved.file_no = gone.file_no and moved.old_path = gone.path
union all select stream_id, file_no, 'added', '', path from came anti join moved on moved.stream_id = came.stream_id and moved.file_no = came.file_no and moved.new_path = came.path"""


#: all JSON values of session files; strings of two members that hold an object are opened in turn. ``spot`` places a value, ``up`` the one around it
_P5_CTE = r"""
with recursive docs as (
  select record_id, body::json as doc, '' as spot, null::varchar as member from session_files where json_valid(body)
  union all
  select d.record_id, (t.value ->> '$')::json, d.spot || t.fullkey, t.key from docs d, json_tree(d.doc) t
  where t.key in ('message', 'providerData') and t.type = 'VARCHAR' and case when json_valid(t.value ->> '$') then json_type((t.value ->> '$')::json) = 'OBJECT' else false end),
vals as (
  select d.record_id, t.type, t.value, d.spot || t.fullkey as spot, case when t.fullkey = '$' then d.member else nullif(regexp_extract(t.fullkey, '\.([^.\[\]]+)(\[[0-9]+\])*$', 1), '') end as name,
         ends_with(t.fullkey, ']') as element, t.fullkey = '$' and d.spot <> '' as opened from docs d, json_tree(d.doc) t),
objs as (select * from vals where type = 'OBJECT'),
-- the object around: the place without its last member and the positions behind it
own as (select *, case when spot = '$' then null when opened then regexp_replace(spot, '(\.[^.\[\]]+)?(\[[0-9]+\])*\$$', '') else regexp_replace(spot, '(\.[^.\[\]]+)?(\[[0-9]+\])*$', '') end as up from vals),
ids as (select record_id, up as spot, value ->> '$' as id from own where name = 'id' and not element and type in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')),
walk as (select record_id, spot, up as here from own where type = 'OBJECT' and up is not null
  union all select w.record_id, w.spot, o.up from walk w left join ids i on i.record_id = w.record_id and i.spot = w.here
  join own o on o.record_id = w.record_id and o.spot = w.here and o.type = 'OBJECT' where i.id is null and o.up is not null),
around as (select w.record_id, w.spot, i.id from walk w join ids i on i.record_id = w.record_id and i.spot = w.here)
"""
ORACLE = {
    "p1_found": _P1_CTE + "select distinct delivery_id from ranked where delivery_id <> first_id",
    "p1_once": _P1_CTE + "select harness, count(*) as requests, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output from ranked where delivery_id = first_id group by 1",
    "p1_merge": _P1_CTE + f"""
select harness, count_if(received_at < timestamp '{_NEW_SINCE}') as stored, count_if(received_at >= timestamp '{_NEW_SINCE}') as added
from (select *, row_number() over (partition by scope, request order by received_at >= timestamp '{_NEW_SINCE}', delivery_id) as place from named) where place = 1 group by 1""",
    "p2_found": _P2_CTE + """
select instance_id, project, strftime(day, '%Y-%m-%d') as day_key, 'quiet' as kind from peaks where t7 = 0 and t30 > 0
union all select instance_id, project, strftime(day, '%Y-%m-%d'), 'peak' from peaks where t7 > before""",
    "p2_trailing": _P2_CTE + """
select instance_id, project, strftime(day, '%Y-%m-%d') as day_key, cast(t7 as double) as total_7, cast(round(cast(s7 / 7 as decimal(38,16)), 6) as double) as avg_7,
       cast(t30 as double) as total_30, cast(round(cast(s30 / 30 as decimal(38,16)), 6) as double) as avg_30 from peaks""",
    "p4_found": _p4_sql(),
    "p6_descendants": """
with recursive p as (
  select '["' || coalesce(harness, '') || '","' || coalesce(nullif(trim(instance_id), ''), 'default') || '"]' as scope, session_id, min(nullif(trim(parent_id), '')) as parent_id
  from usage_events where trim(coalesce(session_id, '')) <> '' group by 1, 2),
up as (
  select scope, session_id, parent_id as top, 1 as depth from p where parent_id is not null
  union all select u.scope, u.session_id, p.parent_id, u.depth + 1 from up u join p on p.scope = u.scope and p.session_id = u.top and p.parent_id is not null where u.depth < 2000),
lost as (select scope, session_id from up where depth >= 2000)
select scope, top as ancestor, count(*) as below, cast(max(depth) as integer) as levels from up anti join lost using (scope, session_id) group by 1, 2""",
    "p6_closure": """
with recursive p as (
  select '["' || coalesce(harness, '') || '","' || coalesce(nullif(trim(instance_id), ''), 'default') || '"]' as scope, session_id, min(nullif(trim(parent_id), '')) as parent_id
  from usage_events where trim(coalesce(session_id, '')) <> '' group by 1, 2),
up as (
  select scope, session_id, parent_id as top, [session_id, parent_id] as way from p where parent_id <> session_id
  union all select u.scope, u.session_id, p.parent_id, list_append(u.way, p.parent_id) from up u
  join p on p.scope = u.scope and p.session_id = u.top where p.parent_id is not null and not list_contains(u.way, p.parent_id))
select scope, top as ancestor, session_id as descendant, cast(len(way) - 1 as integer) as distance from up""",
    "p5_found": _P5_CTE + """
, counted as (select record_id, up, name from own where not element and name in ('cacheRead', 'prompt_tokens') and (type in ('BIGINT', 'UBIGINT', 'DOUBLE') or type = 'VARCHAR' and regexp_full_match(value ->> '$', '[0-9]+'))),
hit as (select distinct c.record_id, m.up as spot from counted c
  join own u on u.record_id = c.record_id and u.spot = c.up and u.type = 'OBJECT' and not u.element
  join own m on m.record_id = u.record_id and m.spot = u.up and m.type = 'OBJECT' and not m.element
  where (m.name, u.name, c.name) in (('message', 'usage', 'cacheRead'), ('providerData', 'rawUsage', 'prompt_tokens')))
select record_id, i.id as node_id, a.id as parent_node_id from hit join ids i using (record_id, spot) left join around a using (record_id, spot)""",
    "p5_objects": _P5_CTE + """
select o.name as member, count(*) as objects, count(i.id) as with_id, count(a.id) as under_id from objs o left join ids i using (record_id, spot) left join around a using (record_id, spot) group by 1""",
    "p5_members": _P5_CTE + """
select name, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind, count(*) as members
from vals where type not in ('OBJECT', 'ARRAY') group by 1, 2""",
    "p5_linked": _P5_CTE + """
, one as (select o.name as member, o.spot <> '$' as nested, v.name, case v.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind, v.element,
                 v.record_id, o.spot, count(*) as n
          from own v join objs o on o.record_id = v.record_id and o.spot = v.up where v.type not in ('OBJECT', 'ARRAY') group by all)
select member, nested, name, kind, element, cast(sum(n) as bigint) as scalars, count(*) as objects from one group by all""",
    "p6_paths": """
with recursive p as (
  select '["' || coalesce(harness, '') || '","' || coalesce(nullif(trim(instance_id), ''), 'default') || '"]' as scope, session_id as node, min(nullif(trim(parent_id), '')) as parent,
         count(distinct nullif(trim(parent_id), '')) > 1 as conflict
  from usage_events where trim(coalesce(session_id, '')) <> '' group by 1, 2),
alls as (select * from p union all select distinct scope, parent, null, false from p where parent is not null and (scope, parent) not in (select scope, node from p)),
walk as (select scope, node, node as way, conflict from alls where parent is null
  union all select a.scope, a.node, w.way || ' > ' || a.node, a.conflict from walk w join alls a on a.scope = w.scope and a.parent = w.node)
select * from walk""",
    "p6_cycles": """
with recursive p as (
  select harness, coalesce(nullif(trim(instance_id), ''), 'default') as instance_id, session_id, min(nullif(trim(parent_id), '')) as parent_id
  from usage_events where trim(coalesce(session_id, '')) <> '' group by 1, 2, 3),
walk as (select harness, instance_id, session_id, parent_id as up from p where parent_id is not null
  union select w.harness, w.instance_id, w.session_id, p.parent_id from walk w
  join p on p.harness is not distinct from w.harness and p.instance_id = w.instance_id and p.session_id = w.up and p.parent_id is not null),
ring as (select harness, instance_id, session_id from walk where up = session_id)
select p.harness, p.instance_id, p.session_id, p.parent_id,
       p.session_id = (select max(w.up) from walk w where w.harness is not distinct from p.harness and w.instance_id = p.instance_id and w.session_id = p.session_id) as closes_cycle
from p join ring r on r.harness is not distinct from p.harness and r.instance_id = p.instance_id and r.session_id = p.session_id""",
    "p6_found": """
with recursive p as (
  select harness, coalesce(nullif(trim(instance_id), ''), 'default') as instance_id, session_id, min(nullif(trim(parent_id), '')) as parent_id
  from usage_events where trim(coalesce(session_id, '')) <> '' group by 1, 2, 3),
up as (
  select harness, instance_id, session_id, parent_id as top, 1 as depth from p where parent_id is not null
  union all
  select u.harness, u.instance_id, u.session_id, p.parent_id, u.depth + 1 from up u
  join p on p.harness = u.harness and p.instance_id = u.instance_id and p.session_id = u.top and p.parent_id is not null where u.depth < 2000),
far as (select harness, instance_id, session_id, max(depth) as depth, max_by(top, depth) as root_id from up group by 1, 2, 3)
select harness, instance_id, session_id, case when depth >= 2000 then '(cycle)' else root_id end as root_id,
       cast(case when depth >= 2000 then -1 else depth end as integer) as depth from far""",
}
