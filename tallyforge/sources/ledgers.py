"""SQLite ledgers, blobs and the remaining layouts to canonical events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalars import clamp_subset
from tallyforge.sources.dialects import READERS, _at, _first, _has, _message_log, _num, _parsed, _text, _zero, emit, merge_copies, session_of_path, stamp
from tallyforge.sources.files import inflate, read_sqlite

LEDGERS: dict = {}


def _ledger(name: str):
    def put(f):
        LEDGERS[name] = f
        return f

    return put


def _row_order() -> Column:
    return F.struct("source_path", "rowid")


def _count(c: str) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)).cast("bigint"), _zero())


def _s(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def _epoch(c: str) -> Column:
    return stamp(F.col(c).cast("string"))


def _split(inp: Column, out: Column, read: Column, write: Column, think: Column | None = None) -> dict[str, Column]:
    """Inclusive counters to disjoint classes, every part clamped to what is left of the whole."""
    r = clamp_subset(read, inp)
    w = clamp_subset(write, inp - r)
    t = clamp_subset(think, out) if think is not None else _zero()
    return {"input": inp - r - w, "output": out - t, "cache_read": r, "cache_write": w, "reasoning": t}


def _message_store(spark: SparkSession, path, harness: str, prefix: str, base_only: bool, glob: str | None) -> DataFrame:
    """Messages as JSON beside their session; every field stands for itself, so a bad one costs only itself."""
    msg = read_sqlite(spark, path, "message", {"id": "string", "session_id": "string", "time_updated": "bigint", "data": "string"}, glob)
    ses = read_sqlite(spark, path, "session", {"id": "string", "parent_id": "string", "directory": "string"}, glob)
    ses = ses.select("source_path", F.col("id").alias("session_id"), "parent_id", "directory").dropDuplicates(["source_path", "session_id"])
    df = msg.join(ses, ["source_path", "session_id"], "left").withColumn("v", F.try_parse_json("data")).where("v is not null and id <> ''")
    cost = F.try_variant_get("v", "$.cost", "double")
    t = "tokens."
    used = (_num(t + "input") + _num(t + "output") + _num(t + "reasoning") + _num(t + "cache.read") + _num(t + "cache.write")) > 0
    place = _s("directory")
    mark = F.coalesce(F.try_variant_get("v", "$.summary", "boolean"), F.lit(False)) | (_text("mode") == "compaction")
    w = Window.partitionBy("source_path", "session_id").orderBy("at", "id")
    df = df.where(_has("tokens") & (used | (cost > 0))).withColumn("at", F.coalesce(_at("time.created"), stamp(F.col("time_updated").cast("string")))).withColumn("_mark", mark)
    df = df.withColumn("_after", F.coalesce(F.lag("_mark").over(w), F.lit(False)) & ~F.col("_mark"))
    return merge_copies(emit(
        df, harness, _row_order(), dedup_key=F.concat(F.lit(prefix), "id"), session_id=F.col("session_id"), parent_id=_s("parent_id"), project=F.substring_index(place, "/", -1) if base_only else place, ts=F.col("at"),
        model=_first(_text("modelID"), _text("model.modelID")), provider=_first(_text("providerID"), _text("model.providerID")), input=_num(t + "input"), output=_num(t + "output"), reasoning=_num(t + "reasoning"),
        cache_read=_num(t + "cache.read"), cache_write=_num(t + "cache.write"), log_cost=F.when((cost > 0) & ~F.isnan(cost), cost), boundary=F.when(F.col("_after"), "compact").otherwise("")))


@_ledger("opencode")
def opencode(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    return _message_store(spark, path, "opencode", "opencode:", False, glob)


@_ledger("mimo-code")
def mimo_code(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    return _message_store(spark, path, "mimo-code", "mimo-code:", True, glob)


def _grown(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Increments of cumulative columns over the snapshots of a session, in the order of their files."""
    w = Window.partitionBy(by).orderBy("at", "source_path").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"d_{c}": F.greatest(F.col(c) - F.coalesce(F.max(c).over(w), F.lit(0)), F.lit(0)) for c in columns})


@_ledger("crush")
def crush(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Cumulative counters per session; growth of the cost alone has a key of its own."""
    ses = read_sqlite(spark, path, "sessions", {"id": "string", "parent_session_id": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint", "cost": "double", "created_at": "bigint", "updated_at": "bigint"}, glob)
    msg = read_sqlite(spark, path, "messages", {"session_id": "string", "model": "string", "provider": "string"}, glob)
    named = msg.where("coalesce(model, '') <> ''").groupBy("source_path", F.col("session_id").alias("id")).agg(F.max_by("model", "rowid").alias("model"), F.max_by("provider", "rowid").alias("provider"))
    df = ses.join(named, ["source_path", "id"], "left").withColumns({"p": _count("prompt_tokens"), "c": _count("completion_tokens"), "at": F.coalesce(_epoch("updated_at"), _epoch("created_at"))})
    df = _grown(df.withColumn("cost", F.when(F.col("cost") > 0, F.col("cost")).otherwise(0.0)), "id", ["p", "c", "cost"])
    plain = F.concat_ws(":", F.lit("crush"), "id", F.col("p").cast("string"), F.col("c").cast("string"))
    key = F.when((F.col("d_p") == 0) & (F.col("d_c") == 0), F.concat(plain, F.lit(":cost:"), F.col("cost").cast("string"))).otherwise(plain)
    out = emit(df.withColumn("bill", F.lit(0.0)).where("d_p > 0 or d_c > 0 or d_cost > 0"), "crush", _row_order(), dedup_key=key, session_id=F.col("id"), parent_id=_s("parent_session_id"), ts=F.col("at"), model=_s("model"), provider=_s("provider"),
               input=F.col("d_p"), output=F.col("d_c"), log_cost=F.when(F.col("d_cost") > 0, F.col("d_cost")), bill_amount=F.when((F.col("d_p") == 0) & (F.col("d_c") == 0), F.lit(0.0)))
    return merge_copies(out.withColumn("bill_amount", F.lit(None).cast("double")))


@_ledger("goose")
def goose(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    cols = {"id": "string", "working_dir": "string", "created_at": "string", "updated_at": "string", "accumulated_input_tokens": "bigint", "accumulated_output_tokens": "bigint", "provider_name": "string", "model_config_json": "string"}
    df = read_sqlite(spark, path, "sessions", cols, glob).withColumns({
        "i": _count("accumulated_input_tokens"), "o": _count("accumulated_output_tokens"), "at": F.coalesce(stamp(F.col("updated_at")), stamp(F.col("created_at"))), "v": F.try_parse_json("model_config_json")})
    df = _grown(df, "id", ["i", "o"])
    key = F.concat_ws(":", F.lit("goose"), "id", F.col("i").cast("string"), F.col("o").cast("string"))
    return merge_copies(emit(df, "goose", _row_order(), dedup_key=key, session_id=F.col("id"), project=_s("working_dir"), ts=F.col("at"), model=_text("model_name"), provider=_s("provider_name"), input=F.col("d_i"), output=F.col("d_o")))


_FIVE = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write": "cache_write_tokens", "reasoning": "reasoning_tokens"}


@_ledger("hermes")
def hermes(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Snapshots per session, model and task; session totals only where there is no such row. The latest snapshot counts."""
    money = {"actual_cost_usd": "double", "estimated_cost_usd": "double"}
    common = {"model": "string", "billing_provider": "string", "billing_base_url": "string", **dict.fromkeys(_FIVE.values(), "bigint"), **money}
    ses = read_sqlite(spark, path, "sessions", {"id": "string", "parent_session_id": "string", "cwd": "string", "started_at": "double", **common}, glob)
    per = read_sqlite(spark, path, "session_model_usage", {"session_id": "string", "task": "string", "first_seen": "double", "last_seen": "double", **common}, glob)
    info = ses.select("source_path", F.col("id").alias("session_id"), "parent_session_id", "cwd", "started_at", F.col("model").alias("s_model"), F.col("billing_provider").alias("s_provider"), F.col("billing_base_url").alias("s_url"))
    one = per.join(info, ["source_path", "session_id"], "left").withColumn("seen", F.coalesce(F.nullif("last_seen", F.lit(0.0)), F.nullif("first_seen", F.lit(0.0)), "started_at"))
    two = ses.withColumnRenamed("id", "session_id").join(per.select("source_path", "session_id").distinct(), ["source_path", "session_id"], "left_anti").withColumn("seen", F.col("started_at"))
    both = one.unionByName(two, allowMissingColumns=True)
    cost = F.coalesce(F.nullif("actual_cost_usd", F.lit(0.0)), F.nullif("estimated_cost_usd", F.lit(0.0)))
    model = _first(_s("model"), _s("s_model"), F.lit("unknown"))
    key = F.concat_ws(":", F.lit("hermes"), "session_id", model, _s("task"))
    out = emit(both, "hermes", F.struct("source_path", "rowid"), dedup_key=key, session_id=F.col("session_id"), parent_id=_s("parent_session_id"), project=_s("cwd"), ts=F.timestamp_micros((F.col("seen") * 1e6).cast("bigint")), model=model,
               provider=_first(_s("billing_provider"), _s("s_provider")), base_url=_first(_s("billing_base_url"), _s("s_url")), log_cost=F.when(cost > 0, cost), **{k: _count(c) for k, c in _FIVE.items()})
    from tallyforge.operators.merge import last_write_wins
    from tallyforge.schema import EVENT, KEY

    return last_write_wins(out.withColumn("_seq", F.struct("ts", "_order")).drop("_order"), KEY, "_seq").select(*[f.name for f in EVENT.fields])


@_ledger("forge")
def forge(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Messages inside a JSON column; only actual (not estimated) counts; all events of a row share its time."""
    df = read_sqlite(spark, path, "conversations", {"conversation_id": "string", "context": "string", "created_at": "string", "updated_at": "string"}, glob)
    df = df.select("*", F.posexplode(F.try_variant_get(F.try_parse_json("context"), "$.messages", "array<variant>")).alias("at", "v"))
    u = lambda n: _num(f"usage.{n}.actual")
    call = F.coalesce(F.try_variant_get("v", "$.message.text.tool_calls[0].call_id", "string"), F.lit(""))
    model, fresh = _text("message.text.model"), F.greatest(u("prompt_tokens") - u("cached_tokens"), _zero())
    key = F.concat_ws(":", F.lit("forge"), "conversation_id", F.when(call != "", call).otherwise(F.concat_ws(":", model, u("prompt_tokens").cast("string"), u("completion_tokens").cast("string"), F.col("at").cast("string"))))
    ts = F.coalesce(stamp(F.col("updated_at")), stamp(F.col("created_at")))
    return merge_copies(emit(
        df.where((F.lower(_text("message.text.role")) == "assistant") & ts.isNotNull()), "forge", F.struct("source_path", "rowid", "at"), dedup_key=key, session_id=F.col("conversation_id"), ts=ts, model=model, request_id=call,
        input=fresh, output=u("completion_tokens"), cache_read=u("cached_tokens")))


@_ledger("zcode")
def zcode(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Finished requests only; inclusive input."""
    reads, writes = ("cache_read_input_tokens", "cache_read_tokens", "cache_read"), ("cache_creation_input_tokens", "cache_write_tokens", "cache_write")
    cols = {"id": "string", "session_id": "string", "started_at": "bigint", "model_id": "string", "status": "string", "input_tokens": "bigint", "output_tokens": "bigint", "provider": "string", **dict.fromkeys((*reads, *writes), "bigint")}
    df = read_sqlite(spark, path, "model_usage", cols, glob).where("status = 'completed'")
    row = F.substring(F.sha2(F.concat_ws("\0", "session_id", F.coalesce("started_at", F.lit(0)).cast("string"), F.col("rowid").cast("string")), 256), 1, 16)
    key = F.when(_s("id") != "", F.concat(F.lit("zcode:"), "id")).otherwise(F.concat(F.lit("zcode:row:"), row))
    return merge_copies(emit(
        df, "zcode", _row_order(), dedup_key=key, session_id=F.col("session_id"), ts=_epoch("started_at"), model=_s("model_id"), provider=_s("provider"),
        **_split(_count("input_tokens"), _count("output_tokens"), F.greatest(F.coalesce(*reads, F.lit(0)), _zero()), F.greatest(F.coalesce(*writes, F.lit(0)), _zero()))))


@_ledger("minimax-code")
def minimax(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """A cost of 0 is a real price here; null, negative and NaN are none."""
    cols = {"id": "bigint", "session_id": "string", "ts": "bigint", "model": "string", "cost_usd": "double", **dict.fromkeys(_FIVE.values(), "bigint")}
    df = read_sqlite(spark, path, "local_runtime_token_usage", cols, glob)
    sid = _s("session_id")
    return merge_copies(emit(
        df, "minimax-code", _row_order(), dedup_key=F.when(sid != "", F.concat_ws(":", F.lit("minimax-code"), sid, F.col("id").cast("string"))), session_id=sid, ts=_epoch("ts"), model=_s("model"),
        log_cost=F.when((F.col("cost_usd") >= 0) & ~F.isnan("cost_usd"), F.col("cost_usd")), **{k: _count(c) for k, c in _FIVE.items()}))


@_ledger("trae")
def trae(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Turns of a decrypted database that are not deleted; inclusive prompt and completion."""
    turn = read_sqlite(spark, path, "chat_turn", {"turn_id": "string", "session_id": "string", "created_at": "bigint", "deleted_at": "bigint", "context": "string"}, glob)
    ses = read_sqlite(spark, path, "chat_session", {"session_id": "string", "project_id": "string", "deleted_at": "bigint"}, glob).where("deleted_at = 0")
    pro = read_sqlite(spark, path, "project", {"project_id": "string", "absolute_path": "string"}, glob)
    place = ses.join(pro.select("source_path", "project_id", "absolute_path"), ["source_path", "project_id"], "left").select("source_path", "session_id", "absolute_path")
    df = turn.where("deleted_at = 0 and turn_id <> ''").withColumn("v", F.try_parse_json("context")).where(_has("token_usage")).join(place, ["source_path", "session_id"], "left")
    t, m = "token_usage.", "persist_user_message_context.model_info."
    return merge_copies(emit(
        df, "trae", _row_order(), dedup_key=F.concat(F.lit("trae:"), "turn_id"), session_id=F.col("session_id"), project=_s("absolute_path"), ts=F.coalesce(_at("chat_start_time"), _epoch("created_at")),
        model=_first(_text(m + "config_name"), _text(m + "model_name"), _text(m + "display_model_name")),
        **_split(_num(t + "prompt_tokens"), _num(t + "completion_tokens"), _num(t + "cache_read_input_tokens"), _num(t + "cache_creation_input_tokens"), _num(t + "reasoning_tokens"))))


@_ledger("zed")
def zed(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """One event per request of a thread, and one for what the cumulative usage has beyond them."""
    raw = read_sqlite(spark, path, "threads", {"id": "string", "parent_id": "string", "created_at": "string", "updated_at": "string", "data": "binary"}, glob)

    @F.pandas_udf("string")
    def opened(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: inflate(bytes(b)).decode("utf-8", "replace") if b is not None else None)

    df = raw.withColumn("line", opened("data")).withColumn("v", F.try_parse_json("line")).where("v is not null")
    names = {"input": "input_tokens", "output": "output_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens"}
    per = F.map_entries(F.try_variant_get("v", "$.request_token_usage", "map<string, variant>"))
    one = df.select("source_path", "rowid", "id", "parent_id", "created_at", "updated_at", "v", F.explode(per).alias("e")).withColumn("u", F.col("e.value")).withColumn("part", F.substring(F.sha1("e.key"), 1, 16))
    one = one.select("*", *[_num(n, "u").alias(c) for c, n in names.items()])
    sums = one.groupBy("source_path", "rowid").agg(*[F.sum(c).alias(f"s_{c}") for c in names])
    rest = df.join(sums, ["source_path", "rowid"], "left").where(_has("cumulative_token_usage")).withColumn("part", F.lit("remainder"))
    rest = rest.select("*", *[F.greatest(_num(f"cumulative_token_usage.{n}") - F.coalesce(f"s_{c}", _zero()), _zero()).alias(c) for c, n in names.items()])
    keep = ["source_path", "rowid", "id", "parent_id", "created_at", "updated_at", "v", "part", *names]
    both = one.select(*keep).unionByName(rest.select(*keep))
    return merge_copies(emit(
        both, "zed", F.struct("source_path", "rowid", "part"), dedup_key=F.concat_ws(":", F.lit("zed"), "id", "part"), session_id=F.col("id"), parent_id=_s("parent_id"), ts=F.coalesce(stamp(F.col("updated_at")), stamp(F.col("created_at"))),
        model=_first(_text("model.model"), F.lit("unknown")), provider=_text("model.provider"), **{c: F.col(c) for c in names}))


def wire_fields(data: bytes) -> dict[int, object]:
    """First value of every field of a protocol-buffer message: integers, or bytes for length-delimited ones."""
    out: dict[int, object] = {}
    i = 0

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[i]
            n |= (b & 127) << shift
            i += 1
            shift += 7
            if b < 128:
                return n, i

    try:
        while i < len(data):
            tag, i = varint(i)
            kind, no = tag & 7, tag >> 3
            if kind == 0:
                v, i = varint(i)
            elif kind == 2:
                n, i = varint(i)
                v, i = data[i:i + n], i + n
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
                v, i = int.from_bytes(data[i:i + n], "little"), i + n
            else:
                break
            out.setdefault(no, v)
    except IndexError:
        pass
    return out


# fixed values: numbers of the usage fields within the message
_WIRE = {"input": 2, "total": 3, "cache_write": 4, "cache_read": 5, "thinking": 9, "response": 10}


@_ledger("antigravity")
def antigravity(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """Protocol-buffer blobs: usage is field 4 of field 1; the response is what the total leaves beside thinking."""
    raw = read_sqlite(spark, path, "gen_metadata", {"idx": "bigint", "data": "binary"}, glob)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, idx, blob in zip(f["source_path"], f["idx"], f["data"]):
                chat = wire_fields(bytes(wire_fields(bytes(blob or b"")).get(1, b"") or b"") if isinstance(wire_fields(bytes(blob or b"")).get(1), bytes) else b"")
                use = wire_fields(chat[4]) if isinstance(chat.get(4), bytes) else {}
                if not use:
                    continue
                got = {k: int(use[n]) if isinstance(use.get(n), int) and use[n] < 2**62 else 0 for k, n in _WIRE.items()}
                rid = use[11].decode("utf-8", "replace") if isinstance(use.get(11), bytes) else ""
                made = wire_fields(chat[9]) if isinstance(chat.get(9), bytes) else {}
                rows.append((p, int(idx), rid, int(made.get(1, 0)) if isinstance(made.get(1, 0), int) else 0, *got.values()))
            yield pd.DataFrame(rows, columns=["source_path", "idx", "rid", "made_s", *_WIRE])

    df = raw.mapInPandas(run, "source_path string, idx bigint, rid string, made_s bigint, " + ", ".join(f"`{k}` bigint" for k in _WIRE))
    c = F.col
    response = F.when((c("response") == 0) & (c("thinking") == 0), c("total")).when((c("total") > 0) & (c("response") + c("thinking") != c("total")) & (c("total") >= c("thinking")), c("total") - c("thinking")).otherwise(c("response"))
    rid = F.when((c("rid") == "") | c("rid").rlike(r"\s"), c("idx").cast("string")).otherwise(c("rid"))
    sid = F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return merge_copies(emit(
        df.where("input > 0 or total > 0"), "antigravity", F.struct("source_path", "idx"), dedup_key=F.concat_ws(":", F.lit("antigravity"), sid, rid), session_id=sid, ts=F.when(c("made_s") > 0, F.timestamp_seconds("made_s")),
        input=c("input"), output=response, cache_read=c("cache_read"), cache_write=c("cache_write"), reasoning=c("thinking")))


# ---- estimates and double bookkeeping

def _chars(*paths: str) -> Column:
    return sum((F.coalesce(F.char_length(F.try_variant_get("v", f"$.{p}", "string")), F.lit(0)) for p in paths[1:]), F.coalesce(F.char_length(F.try_variant_get("v", f"$.{paths[0]}", "string")), F.lit(0)))


def kiro(lines: DataFrame) -> DataFrame:
    """Turns between prompts; tokens are estimated as a quarter of the characters, rounded up. A turn counts once it has assistant text."""
    df = _parsed(lines)
    kind = _text("kind")
    content = F.try_variant_get("v", "$.data.content", "array<variant>")
    size = F.aggregate(F.coalesce(content, F.array().cast("array<variant>")), F.lit(0), lambda n, c: n + F.coalesce(F.char_length(F.try_variant_get(c, "$.data", "string")), F.lit(0)))
    w = Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("source_path", "line_no", kind.alias("kind"), size.alias("n"), F.coalesce(_at("data.meta.timestamp"), _at("timestamp")).alias("at"))
    df = df.withColumn("turn", F.sum((F.col("kind") == "Prompt").cast("int")).over(w)).where("turn > 0")
    turns = df.groupBy("source_path", "turn").agg(
        F.min("at").alias("at"), F.sum(F.when(F.col("kind").isin("Prompt", "ToolResults"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("kind") == "AssistantMessage", F.col("n")).otherwise(0)).alias("o"))
    told = turns.where("o > 0")
    told = told.withColumn("nth", F.row_number().over(Window.partitionBy("source_path").orderBy("turn")) - 1)
    sid = session_of_path()
    return merge_copies(emit(
        told, "kiro", F.struct("source_path", "turn"), dedup_key=F.concat_ws(":", F.lit("kiro-cli"), sid, F.col("nth").cast("string")), session_id=sid, ts=F.col("at"), input=F.ceil(F.col("i") / 4).cast("bigint"), output=F.ceil(F.col("o") / 4).cast("bigint")))


READERS["kiro"] = kiro


def claude_desktop(transcripts: DataFrame, ledger: DataFrame, within_s: float = 5.0) -> DataFrame:
    """Transcripts and the ledger beside them: a ledger turn gives way to its session's transcript, a transcript request to an
    identical ledger request within ``within_s`` seconds."""
    from tallyforge.operators.asof import interval_anti

    tr = _message_log(transcripts, "claude-desktop", "claude", None)
    df = _parsed(ledger).withColumn("origin", _first(_text("origin"), F.lit("turn"))).withColumn("at", _at("ts"))
    per = F.map_entries(F.try_variant_get("v", "$.models", "map<string, variant>"))
    df = df.where(_text("surface").isin("cowork", "code") & (_text("sessionId") != "") & F.col("at").isNotNull()).select("source_path", "line_no", "v", "origin", "at", F.explode(per).alias("e")).withColumn("u", F.col("e.value"))
    cost = F.try_variant_get("u", "$.cost.usd", "double")
    key = F.concat_ws(":", F.lit("ledger"), _text("sessionId"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("line_no").cast("string"), F.col("e.key"))
    one = emit(
        df, "claude-desktop", F.struct("source_path", "line_no"), dedup_key=key, session_id=_text("sessionId"), ts=F.col("at"), model=F.col("e.key"), input=_num("inputTokens", "u"), output=_num("outputTokens", "u"),
        cache_read=_num("cacheReadTokens", "u"), cache_write=_num("cacheWriteTokens", "u"), log_cost=F.when(cost > 0, cost), request_id=F.col("origin"))
    told = tr.select("session_id").distinct()
    turns = one.where("request_id = 'turn'").join(told, "session_id", "left_anti").select(*one.columns)
    requests = one.where("request_id <> 'turn'")
    same = ["input", "output", "cache_read", "cache_write"]
    fresh = interval_anti(tr, requests.select(*same, F.col("ts").alias("_at")), same, "ts", "_at", within_s)
    return merge_copies(fresh.withColumn("_order", F.struct(F.lit("transcript").alias("a"), F.lit(0).cast("bigint").alias("b"))).unionByName(
        turns.unionByName(requests).withColumn("_order", F.struct(F.col("_order.source_path").alias("a"), F.col("_order.line_no").alias("b")))))
