"""Log dialects to canonical events: one function per dialect over raw lines, documents or tables.

Records are parsed once into a variant; fields are read one by one, so a field of the wrong type never
drops the record. Where a log's meaning depends on the order of its lines, that is a window over the file.
Every reader ends in ``merge_copies``: the copies of one request become one row with its largest counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalars import clamp_subset
from tallyforge.operators.ordered import pending_boundary, suppress_repeats
from tallyforge.schema import EVENT

_COUNTS = ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning")
READERS: dict[str, Callable[..., DataFrame]] = {}


def _reader(name: str):
    def put(f):
        READERS[name] = f
        return f

    return put


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.try_parse_json("line")).where("v is not null")


def _text(path: str, v: Column | str = "v") -> Column:
    return F.coalesce(F.trim(F.try_variant_get(v, f"$.{path}", "string")), F.lit(""))


def _num(path: str, v: Column | str = "v") -> Column:
    """A counter: number or quoted number, missing or negative is 0."""
    return F.greatest(F.coalesce(F.try_variant_get(v, f"$.{path}", "double"), F.lit(0.0)).cast("bigint"), _zero())


def _first_num(prefix: str, *names: str, v: Column | str = "v") -> Column:
    """The first alias that holds a number."""
    return F.greatest(F.coalesce(*[F.try_variant_get(v, f"$.{prefix}{n}", "double") for n in names], F.lit(0.0)).cast("bigint"), _zero())


def _money(path: str, v: Column | str = "v") -> Column:
    return F.try_variant_get(v, f"$.{path}", "double")


def _has(path: str, v: Column | str = "v") -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()


def _first(*c: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))


def stamp(text: Column) -> Column:
    """Instant of an ISO text or an epoch number (milliseconds; seconds below 10^11); null if there is none."""
    n = text.try_cast("double")
    ms = F.when(F.abs(n) < 1e11, n * 1000).otherwise(n)
    return F.when(n > 0, F.timestamp_micros((ms * 1000).cast("bigint"))).when(n.isNull(), text.try_cast("timestamp"))


def _at(path: str, v: Column | str = "v") -> Column:
    return stamp(_text(path, v))


def session_of_path(path: Column | str = "source_path") -> Column:
    """File name without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl?)?(?:\.zst)?$", 1)


def emit(df: DataFrame, harness: str, order: Column, **made: Column) -> DataFrame:
    """Canonical columns from the given ones, defaults for the rest, plus ``_order`` (position in the log); empty usage is left out."""
    cols = []
    for field in EVENT.fields:
        c = made.get(field.name)
        if c is None:
            c = F.lit(harness) if field.name == "harness" else F.lit("default") if field.name == "instance_id" else (
                _zero() if field.name in (*_COUNTS, "decode_ms") else F.lit("") if field.dataType.simpleString() == "string" else F.lit(None))
        cols.append(c.cast(field.dataType).alias(field.name))
    out = df.select(*cols, order.alias("_order"))
    used = F.lit(False)
    for c in ("input", "output", "cache_read", "cache_write", "reasoning"):
        used = used | (F.col(c) > 0)
    return out.where((used | F.col("bill_amount").isNotNull()) & (F.coalesce("dedup_key", F.lit("")) != "") & (F.coalesce("session_id", F.lit("")) != ""))


def merge_copies(events: DataFrame) -> DataFrame:
    """One row per key: largest counters, latest time, everything else from the first copy; branch and boundary from the first that states one."""
    key = ("harness", "instance_id", "dedup_key")
    rest = [f.name for f in EVENT.fields if f.name not in (*key, *_COUNTS, "ts", "git_branch", "boundary", "decode_ms")]
    stated = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("_order"))), F.lit("")).alias(c)
    out = events.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in (*_COUNTS, "ts", "decode_ms")], F.min_by(F.struct(*rest), "_order").alias("_rest"), stated("git_branch"), stated("boundary"))
    return out.select(*key, *[F.col(f"_rest.{c}").alias(c) for c in rest], *_COUNTS, "ts", "decode_ms", "git_branch", "boundary").select(*[f.name for f in EVENT.fields])


def _line_order() -> Column:
    return F.struct("source_path", "line_no")


def _filled(name: str, source: Column, by: str = "source_path") -> Column:
    """The last stated value up to each line of a file."""
    w = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.nullif(source, F.lit("")), ignorenulls=True).over(w), F.lit("")).alias(name)


# ---- JSON lines

def _message_log(lines: DataFrame, harness: str, prefix: str, provider: Column | None) -> DataFrame:
    """Transcripts with ``message.usage``: streamed copies, thinking inside output, one-hour share of cache writes, sidechains."""
    df = _parsed(lines).withColumn("_file", session_of_path())
    parent = F.regexp_extract("source_path", r"/([^/]+)/subagents/", 1)
    agent, side = _text("agentId"), F.coalesce(F.try_variant_get("v", "$.isSidechain", "boolean"), F.lit(False))
    sid = F.when((parent != "") & (agent != ""), agent).when((parent == "") & side & (agent != ""), agent).when((parent == "") & ~side & (_text("sessionId") != ""), _text("sessionId")).otherwise(F.col("_file"))
    mid, rid, uid = _text("message.id"), _text("requestId"), _text("uuid")
    key = F.when(mid == "", F.when(uid != "", F.concat(F.lit(f"{prefix}:uuid:"), uid)).otherwise("")).when(rid != "", F.concat_ws(":", F.lit(prefix), mid, rid)).otherwise(F.concat(F.lit(f"{prefix}:message:"), mid))
    model = _text("message.model")
    counted = (_text("type") == "assistant") & _has("message.usage") & (model != "") & ~model.startswith("<")
    df = df.select(
        "source_path", "line_no", "v", sid.alias("sid"), F.when(parent != "", parent).when(sid != F.col("_file"), F.when(side, F.col("_file")).otherwise("")).otherwise("").alias("pid"),
        _filled("branch", _text("gitBranch")), _filled("cwd", _text("cwd")), F.when(counted, key).otherwise("").alias("key"),
        F.when((_text("type") == "system") & (_text("subtype") == "compact_boundary"), "compact").otherwise("").alias("mark"))
    df = pending_boundary(df, ["source_path", "sid"], ["line_no"], "mark", "key", "bound").where("key <> ''")
    u = "message.usage."
    out, write = _num(u + "output_tokens"), _num(u + "cache_creation_input_tokens")
    think = F.least(_num(u + "output_tokens_details.thinking_tokens"), out)
    return merge_copies(emit(
        df, harness, _line_order(), dedup_key=F.col("key"), session_id=F.col("sid"), parent_id=F.col("pid"), project=F.col("cwd"), ts=_at("timestamp"), model=_text("message.model"),
        provider=provider if provider is not None else _first(_text("provider"), _text("providerId"), _text("provider_id")), input=_num(u + "input_tokens"), output=out - think, cache_read=_num(u + "cache_read_input_tokens"),
        cache_write=write, cache_write_1h=clamp_subset(_num(u + "cache_creation.ephemeral_1h_input_tokens"), write), reasoning=think,
        request_id=_first(_text("requestId"), _text("message.id")), boundary=F.col("bound"), git_branch=F.col("branch")))


@_reader("claude-code")
def claude_code(lines: DataFrame) -> DataFrame:
    return _message_log(lines, "claude-code", "claude", None)


@_reader("openclaude")
def openclaude(lines: DataFrame) -> DataFrame:
    return _message_log(lines, "openclaude", "openclaude", F.lit("openclaude"))


@_reader("codex")
def codex(lines: DataFrame) -> DataFrame:
    """Token counts come with the session's cumulative snapshot; a snapshot equal to the one before is a replay."""
    df = _parsed(lines)
    p = "payload."
    meta = _text("type") == "session_meta"
    w = Window.partitionBy("source_path").orderBy("line_no")
    after = w.rowsBetween(0, Window.unboundedFollowing)
    named = F.nullif(F.when(_text("type") == "turn_context", _text(p + "model")), F.lit(""))
    df = df.select(
        "source_path", "line_no", "v", _filled("sid", F.when(meta, _text(p + "id"))), _filled("pid", F.when(meta, _first(_text(p + "forked_from_id"), _text(p + "parent_thread_id")))),
        _filled("cwd", _text(p + "cwd")), _filled("provider", F.when(meta, _text(p + "model_provider"))), _filled("branch", F.when(meta, _text(p + "git.branch"))),
        F.coalesce(F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(named, ignorenulls=True).over(after), F.lit("")).alias("model"),
        F.when((_text("type") == "compacted"), "compact").otherwise("").alias("mark"))
    total, last = p + "info.total_token_usage.", p + "info.last_token_usage."
    fields = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
    counted = (_text("type") == "event_msg") & (_text(p + "type") == "token_count") & _has(total[:-1]) & _has(last[:-1])
    key = F.concat(F.lit("codex:"), _first(F.col("pid"), F.col("sid")), F.lit(":"), F.concat_ws("-", *[_num(total + f).cast("string") for f in fields]))
    df = pending_boundary(df.withColumn("key", F.when(counted, key).otherwise("")), ["source_path"], ["line_no"], "mark", "key", "bound").where("key <> ''")
    df = suppress_repeats(df.withColumn("snap", F.regexp_extract("key", r"([^:]*)$", 1)), ["source_path"], ["line_no"], ["snap"])
    inp, out = _num(last + "input_tokens"), _num(last + "output_tokens")
    cached = clamp_subset(F.greatest(_num(last + "cached_input_tokens"), _num(last + "cache_read_input_tokens")), inp)
    write = clamp_subset(_num(last + "cache_write_input_tokens"), inp - cached)
    think = clamp_subset(_num(last + "reasoning_output_tokens"), out)
    return merge_copies(emit(
        df, "codex", _line_order(), dedup_key=F.col("key"), session_id=F.col("sid"), parent_id=F.col("pid"), project=F.col("cwd"), ts=_at("timestamp"), model=F.col("model"), provider=F.col("provider"),
        input=inp - cached - write, output=out - think, cache_read=cached, cache_write=write, reasoning=think, boundary=F.col("bound"), git_branch=F.col("branch")))


def _session_log(lines: DataFrame, harness: str, think_inside: bool) -> DataFrame:
    df = _parsed(lines)
    head = _text("type") == "session"
    df = df.select("source_path", "line_no", "v", _filled("sid", F.when(head, _text("id"))), _filled("cwd", F.when(head, _text("cwd"))), _filled("up", F.when(head, _text("parentSession"))),
                   F.when(_text("type") == "compaction", "compact").otherwise("").alias("mark"), _filled("model", _text("message.model")))
    msg = _has("message.usage")
    num = lambda n: F.when(msg, _num(f"message.usage.{n}")).otherwise(_num(f"usage.{n}"))
    sid = _first(F.col("sid"), session_of_path())
    rec = _first(_text("message.responseId"), _text("id"), F.concat(sid, F.lit("#"), _text("timestamp")))
    counted = (_has("message.usage") & (_text("message.role") == "assistant")) | (_has("usage") & _text("type").isin("compaction", "branch_summary", "message"))
    df = df.withColumn("key", F.when(counted, F.concat(F.lit(f"{harness}:"), rec)).otherwise(""))
    df = pending_boundary(df, ["source_path"], ["line_no"], "mark", "key", "bound").where("key <> ''")
    out, write = num("output"), num("cacheWrite")
    think = F.least(num("reasoning"), out) if think_inside else num("reasoning")
    cost = F.when(msg, _money("message.usage.cost.total")).otherwise(_money("usage.cost.total"))
    return merge_copies(emit(
        df, harness, _line_order(), dedup_key=F.col("key"), session_id=sid, parent_id=session_of_path(F.col("up")), project=F.col("cwd"), ts=_at("timestamp"),
        model=_first(_text("message.responseModel"), _text("message.model"), F.col("model")), provider=_text("message.provider"), input=num("input"), output=out - think if think_inside else out,
        cache_read=num("cacheRead"), cache_write=write, cache_write_1h=clamp_subset(num("cacheWrite1h"), write), reasoning=think, log_cost=F.nullif(cost, F.lit(0.0)),
        request_id=_text("message.responseId"), boundary=F.col("bound")))


@_reader("pi")
def pi(lines: DataFrame) -> DataFrame:
    return _session_log(lines, "pi", False)


@_reader("step-code")
def step_code(lines: DataFrame) -> DataFrame:
    return _session_log(lines, "step-code", True)


@_reader("dsh")
def dsh(lines: DataFrame) -> DataFrame:
    """Already disjoint classes; the last copy of a message wins by its sequence."""
    df = _parsed(lines)
    df = df.select("source_path", "line_no", "v", _filled("sid", F.when(_text("type") == "session", _text("id"))), _filled("cwd", _text("cwd")), _filled("up", _text("parentSession")))
    u = "data.usage."
    sid = _first(F.col("sid"), session_of_path())
    key = F.concat(F.lit("dsh:"), _first(_text("data.message.id"), _text("data.responseId"), _text("data.compactionId"), F.concat(sid, F.lit("#"), _text("seq"))))
    return merge_copies(emit(
        df.where(_has("data.usage")), "dsh", _line_order(), dedup_key=key, session_id=sid, parent_id=F.col("up"), project=F.col("cwd"), ts=_at("time"),
        model=_first(_text("data.message.model"), _text("data.model")), input=_num(u + "inputTokens"), output=_num(u + "outputTokens"), cache_read=_num(u + "cacheReadTokens"), cache_write=_num(u + "cacheWriteTokens"),
        reasoning=_num(u + "reasoningTokens"), decode_ms=_num("data.stream.decodeMs"), boundary=F.when(_has("data.compactionId"), "compact").otherwise("")))


@_reader("gemini")
def gemini(lines: DataFrame) -> DataFrame:
    """Cached tokens are taken out of the input only if the total proves that they are inside; tool tokens are input."""
    df = _parsed(lines).select("source_path", "line_no", "v", _filled("sid", _text("sessionId")), _filled("cwd", _text("projectHash")))
    t = "tokens."
    inp = _first_num(t, "input", "prompt", "prompt_tokens", "promptTokenCount")
    cached = _first_num(t, "cached", "cached_tokens", "cachedContentTokenCount")
    out = _first_num(t, "output", "candidates", "output_tokens", "candidatesTokenCount")
    think = _first_num(t, "thoughts", "reasoning", "thoughts_tokens", "thoughtsTokenCount")
    tool = _first_num(t, "tool", "tool_tokens", "toolUsePromptTokenCount")
    total = _first_num(t, "total", "total_tokens", "totalTokenCount")
    fresh = F.when((cached > 0) & (total == inp + out + think + tool), inp - F.least(cached, inp)).otherwise(inp)
    sid = _first(F.col("sid"), session_of_path())
    return merge_copies(emit(
        df.where(_has("tokens")), "gemini", _line_order(), dedup_key=F.concat_ws(":", F.lit("gemini"), sid, _text("id")), session_id=sid, ts=_at("timestamp"), model=_text("model"), provider=F.lit("google"),
        input=fresh + tool, output=out, cache_read=cached, reasoning=think, project=F.col("cwd")))


@_reader("qwen")
def qwen(lines: DataFrame) -> DataFrame:
    df = _parsed(lines).withColumn("cwd", _filled("cwd", _text("cwd")))
    u = "usageMetadata."
    inp, out, think, cached, total = (_num(u + n) for n in ("promptTokenCount", "candidatesTokenCount", "thoughtsTokenCount", "cachedContentTokenCount", "totalTokenCount"))
    sid = _first(_text("sessionId"), session_of_path())
    fresh = F.when((cached > 0) & (total == inp + out + think), F.greatest(inp - cached, _zero())).otherwise(inp)
    return merge_copies(emit(
        df.where((_text("type") == "assistant") & _has("usageMetadata")), "qwen", _line_order(), dedup_key=F.concat_ws(":", F.lit("qwen"), sid, _first(_text("uuid"), F.concat_ws(":", _text("timestamp"), _text("model")))),
        session_id=sid, project=F.col("cwd"), ts=_at("timestamp"), model=_first(_text("model"), F.lit("qwen-auto")), provider=F.lit("qwen"), input=fresh, output=out, cache_read=cached, reasoning=think, request_id=_text("uuid")))


@_reader("kimi")
def kimi(lines: DataFrame) -> DataFrame:
    """Two protocols: status updates with a message id or running index, usage records keyed by the hash of their line."""
    df = _parsed(lines).withColumn("sid", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1))
    s = "payload.token_usage."
    w = Window.partitionBy("source_path").orderBy("line_no")
    status = (_text("type") == "StatusUpdate") & _has("payload.token_usage")
    record = (_text("type") == "usage.record") & _has("payload.usage") & _text("payload.usageScope").isin("", "turn", "session")
    df = df.withColumns({"is_s": status, "is_r": record}).withColumn("n", F.sum(F.col("is_s").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("h", F.substring(F.sha1("line"), 1, 16)).withColumn("rep", F.row_number().over(Window.partitionBy("source_path", "h").orderBy("line_no")) - 1)
    read, write = _first_num(s, "input_cache_read", "cache_read_input_tokens", "cached_input_tokens"), _first_num(s, "input_cache_creation", "cache_creation_input_tokens")
    other = _first_num(s, "input_other", "input_tokens")
    inp = F.when(other > 0, other).otherwise(F.greatest(_num(s + "input") - read - write, _zero()))
    timed = F.coalesce(F.try_variant_get("v", "$.timestamp", "double") >= 1e11, F.lit(False))
    rkey = F.concat(F.lit("u"), F.col("h"), F.when((F.col("rep") > 0) & ~timed, F.concat(F.lit("#"), F.col("rep").cast("string"))).otherwise(""))
    key = F.concat_ws(":", F.lit("kimi"), F.col("sid"), F.when(F.col("is_s"), _first(_text("payload.message_id"), F.coalesce(F.col("n"), F.lit(0)).cast("string"))).otherwise(rkey))
    r = "payload.usage."
    pick = lambda a, b: F.when(F.col("is_s"), a).otherwise(b)
    return merge_copies(emit(
        df.where("is_s or is_r"), "kimi", _line_order(), dedup_key=key, session_id=F.col("sid"), ts=_at("timestamp"), model=_first(_text("payload.model"), _text("payload.model_name")), provider=F.lit("moonshot"),
        input=pick(inp, _num(r + "inputOther")), output=pick(_first_num(s, "output", "output_tokens"), _num(r + "output")), cache_read=pick(read, _num(r + "inputCacheRead")),
        cache_write=pick(write, _num(r + "inputCacheCreation")), request_id=F.when(F.col("is_s"), _text("payload.message_id")).otherwise("")))


def _credit_log(lines: DataFrame, harness: str) -> DataFrame:
    df = _parsed(lines)
    df = df.select("source_path", "line_no", "v", _filled("sid", _text("sessionId")), _filled("cwd", _text("cwd")), F.when(F.try_variant_get("v", "$.isCompactSummary", "boolean"), "compact").otherwise("").alias("mark"),
                   F.when(_has("message.usage"), _first(_text("providerData.messageId"), _text("id"))).otherwise("").alias("key"))
    df = pending_boundary(df, ["source_path"], ["line_no"], "mark", "key", "bound").where("key <> ''")
    u, r = "message.usage.", "providerData.rawUsage."
    inp = F.when(_num(r + "prompt_tokens") > 0, _num(r + "prompt_tokens")).otherwise(_num(u + "input_tokens"))
    out = F.when(_num(r + "completion_tokens") > 0, _num(r + "completion_tokens")).otherwise(_num(u + "output_tokens"))
    read = clamp_subset(F.greatest(_num(r + "cache_read_input_tokens"), _num(r + "prompt_cache_hit_tokens"), _num(r + "cached_tokens"), _num(u + "cache_read_input_tokens")), inp)
    write = clamp_subset(F.greatest(_num(r + "cache_creation_input_tokens"), _num(r + "prompt_cache_write_tokens")), inp - read)
    think = clamp_subset(_num(r + "completion_thinking_tokens"), out)
    credit = F.nullif(_money(r + "credit"), F.lit(0.0))
    return merge_copies(emit(
        df, harness, _line_order(), dedup_key=F.col("key"), session_id=_first(F.col("sid"), session_of_path()), project=F.col("cwd"), ts=_at("timestamp"), model=_text("providerData.model"), input=inp - read - write,
        output=out - think, cache_read=read, cache_write=write, reasoning=think, request_id=_text("providerData.conversationRequestId"), bill_amount=credit, bill_unit=F.when(credit.isNotNull(), "credit").otherwise(""), boundary=F.col("bound")))


@_reader("workbuddy")
def workbuddy(lines: DataFrame) -> DataFrame:
    return _credit_log(lines, "workbuddy")


@_reader("codebuddy")
def codebuddy(lines: DataFrame) -> DataFrame:
    return _credit_log(lines, "codebuddy")


@_reader("grok")
def grok(lines: DataFrame) -> DataFrame:
    """The unified log of finished inferences and the turns of session files; a shrinking context marks a compaction."""
    df = _parsed(lines)
    c = "ctx."
    loop = F.greatest(_num(c + "loop_index"), F.lit(1))
    one = emit(
        df.where((_text("msg") == "shell.turn.inference_done") & (_text("sid") != "") & _at("ts").isNotNull()), "grok", _line_order(),
        dedup_key=F.concat_ws(":", F.lit("grok:unified"), _text("sid"), _text("ts"), loop.cast("string")), session_id=_text("sid"), ts=_at("ts"), model=_first(_text(c + "current_model_id"), F.lit("grok")), provider=F.lit("xai"),
        input=F.greatest(_num(c + "prompt_tokens") - _num(c + "cached_prompt_tokens"), _zero()), output=F.greatest(_num(c + "completion_tokens") - _num(c + "reasoning_tokens"), _zero()), cache_read=_num(c + "cached_prompt_tokens"),
        reasoning=F.least(_num(c + "reasoning_tokens"), _num(c + "completion_tokens")))
    u = "params.update."
    sid = F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1)
    size = F.try_variant_get("v", "$.params._meta.totalTokens", "bigint")
    w = Window.partitionBy("source_path").orderBy("line_no")
    turn = _text(u + "sessionUpdate") == "turn_completed"
    seq = df.where(_has("params")).select("source_path", "line_no", "v", size.alias("size"), turn.alias("turn"))
    known = F.last("size", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seq = seq.withColumn("mark", F.when(F.col("size") < F.floor(known / 2), "compact").otherwise("")).withColumn("nth", F.sum(F.col("turn").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prompt = _first(_text(u + "promptId"), _text("params._meta.promptId"), F.concat(F.lit("turn-"), F.col("nth").cast("string")))
    seq = seq.withColumn("key", F.when(F.col("turn") & _has(u + "usage"), F.concat_ws(":", F.lit("grok"), sid, prompt)).otherwise(""))
    seq = pending_boundary(seq, ["source_path"], ["line_no"], "mark", "key", "bound").where("key <> ''")
    g = u + "usage."
    read, write, out = _num(g + "cachedReadTokens"), _num(g + "cacheCreationTokens"), _num(g + "outputTokens")
    two = emit(
        seq, "grok", _line_order(), dedup_key=F.col("key"), session_id=sid, ts=F.coalesce(_at("timestamp"), _at(u + "timestamp")), model=_first(_text(g + "model"), F.lit("grok")), provider=F.lit("xai"),
        input=F.greatest(_num(g + "inputTokens") - read - write, _zero()), output=F.greatest(out - _num(g + "reasoningTokens"), _zero()), cache_read=read, cache_write=write,
        reasoning=F.least(_num(g + "reasoningTokens"), out), boundary=F.col("bound"), request_id=_first(_text(u + "promptId"), _text("params._meta.promptId")))
    # the unified log supersedes the session files of the sessions it covers
    return merge_copies(one.unionByName(two.join(one.select("session_id").distinct(), "session_id", "left_anti").select(*two.columns)))


@_reader("mux")
def mux(lines: DataFrame) -> DataFrame:
    df = _parsed(lines)
    u = "metadata.usage."
    inp = _first_num(u, "inputTokens", "input_tokens", "promptTokens", "prompt_tokens")
    out = _first_num(u, "outputTokens", "output_tokens", "completionTokens", "completion_tokens")
    read = _first_num(u, "cachedInputTokens", "cached_input_tokens", "cacheReadInputTokens", "cache_read_input_tokens")
    think = _first_num(u, "reasoningTokens", "reasoning_tokens")
    write = _num("metadata.providerMetadata.anthropic.cacheCreationInputTokens")
    named, sid = _text("metadata.model"), F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1)
    at = F.instr(named, ":")
    model = F.when(named == "", "unknown").when(at > 0, F.nullif(F.trim(F.expr("substring(_m, instr(_m, ':') + 1)")), F.lit(""))).otherwise(named)
    ts = F.coalesce(_at("metadata.timestamp"), _at("createdAt"))
    df = df.withColumn("_m", named).where((F.lower(_text("role")) == "assistant") & _has("metadata.usage") & ts.isNotNull())
    return merge_copies(emit(
        df, "mux", _line_order(), dedup_key=F.concat_ws(":", F.lit("mux"), sid, _first(_text("id"), F.concat(F.lit("h"), F.substring(F.sha1("line"), 1, 16)))), session_id=sid, ts=ts,
        model=F.coalesce(model, F.lit("unknown")), provider=F.when(at > 0, F.substring_index(named, ":", 1)).otherwise(""), input=F.greatest(inp - read - write, _zero()), output=F.greatest(out - think, _zero()),
        cache_read=read, cache_write=write, reasoning=F.least(think, out), parent_id=F.regexp_extract("source_path", r"/([^/]+)/subagents/", 1)))


@_reader("droid")
def droid(lines: DataFrame) -> DataFrame:
    """Settings snapshots hold cumulative counters: each class counts what it exceeds its own high-water mark by."""
    df = _parsed(lines).where(_has("tokenUsage")).withColumn("sid", session_of_path(F.regexp_replace("source_path", r"\.settings", "")))
    names = {"input": "inputTokens", "output": "outputTokens", "cache_write": "cacheCreationTokens", "cache_read": "cacheReadTokens", "reasoning": "thinkingTokens"}
    df = df.select("source_path", "line_no", "v", "sid", *[_num(f"tokenUsage.{n}").alias(c) for c, n in names.items()])
    w = Window.partitionBy("sid").orderBy("source_path", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    step = {c: F.greatest(F.col(c) - F.coalesce(F.max(c).over(w), _zero()), _zero()) for c in names}
    df = df.select("*", *[d.alias(f"d_{c}") for c, d in step.items()])
    key = F.concat_ws(":", F.lit("droid"), "sid", *[F.col(c).cast("string") for c in names])
    return merge_copies(emit(df.where(_at("timestamp").isNotNull()), "droid", _line_order(), dedup_key=key, session_id=F.col("sid"), ts=_at("timestamp"), model=_text("model"), **{c: F.col(f"d_{c}") for c in names}))


@_reader("openclaw")
def openclaw(lines: DataFrame) -> DataFrame:
    df = _parsed(lines).where(_has("message.usage")).withColumn("h", F.substring(F.sha1("line"), 1, 16))
    df = df.withColumn("rep", F.row_number().over(Window.partitionBy("source_path", "h").orderBy("line_no")) - 1)
    u, sid = "message.usage.", session_of_path()
    key = F.concat_ws(":", F.lit("openclaw"), sid, _first(_text("id"), F.concat(F.lit("h:"), F.col("h"), F.lit(":"), F.col("rep").cast("string"))))
    cost = _money(u + "cost.total")
    return merge_copies(emit(
        df, "openclaw", _line_order(), dedup_key=key, session_id=sid, ts=_at("timestamp"), model=_text("message.model"), provider=_text("message.provider"), input=_num(u + "input"), output=_num(u + "output"),
        cache_read=_num(u + "cacheRead"), cache_write=_num(u + "cacheWrite"), log_cost=F.when(cost > 0, cost)))


# ---- JSON documents

def _elements(docs: DataFrame, path: str = "$") -> DataFrame:
    """Elements of an array of objects with their position, as variants."""
    got = F.try_variant_get(F.try_parse_json("line"), path, "array<variant>")
    return docs.select("source_path", F.posexplode(got).alias("line_no", "v"))


def _task_log(docs: DataFrame, harness: str, inside: Callable[[Column, Column, Column], Column]) -> DataFrame:
    df = _elements(docs).where((_text("type") == "say") & _text("say").isin("api_req_started", "subagent_usage", "deleted_api_reqs"))
    df = df.withColumn("p", F.try_parse_json(_text("text"))).withColumn("task", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1))
    names = ("tokensIn", "tokensOut", "cacheReads", "cacheWrites")
    some = F.lit(False)
    for n in names:
        some = some | F.try_variant_get("p", f"$.{n}", "double").isNotNull()
    ts = _at("ts")
    sub = _text("say") == "subagent_usage"
    sid = F.when(sub, F.concat(F.col("task"), F.lit("-subagents"))).otherwise(F.col("task"))
    inp, out, read, write = (_num(n, "p") for n in names)
    protocol, provider, model = _text("apiProtocol", "p"), _text("modelInfo.providerId"), _text("modelInfo.modelId")
    fresh = F.when(inside(protocol, provider, model), F.greatest(inp - read - write, _zero())).otherwise(inp)
    return merge_copies(emit(
        df.where(some & ts.isNotNull()), harness, F.struct("source_path", "line_no"), dedup_key=F.concat_ws(":", F.lit(harness), sid, F.unix_millis(ts).cast("string")), session_id=sid, parent_id=F.when(sub, F.col("task")).otherwise(""),
        ts=ts, model=model, provider=_first(protocol, provider), input=fresh, output=out, cache_read=read, cache_write=write, log_cost=_money("cost", "p")))


@_reader("cline")
def cline(docs: DataFrame) -> DataFrame:
    def inside(protocol: Column, provider: Column, model: Column) -> Column:
        own = provider.isin("anthropic", "bedrock", "minimax") | ((provider == "vertex") & F.lower(model).contains("claude")) | ((provider == "vercel-ai-gateway") & model.startswith("anthropic/"))
        return F.when(protocol == "anthropic", False).when(protocol == "openai", True).otherwise(~own)

    return _task_log(docs, "cline", inside)


@_reader("roo")
def roo(docs: DataFrame) -> DataFrame:
    return _task_log(docs, "roo", lambda *_: F.lit(True))


@_reader("kilo")
def kilo(docs: DataFrame) -> DataFrame:
    return _task_log(docs, "kilo", lambda *_: F.lit(True))


@_reader("amp")
def amp(docs: DataFrame) -> DataFrame:
    """Ledger entries with the cache tokens of the message they point to; what the total exceeds the parts by is output.
    Threads without usable entries fall back to the usage of their messages."""
    d = docs.withColumn("v", F.try_parse_json("line")).withColumn("sid", _text("id")).where("sid <> ''")
    explode = lambda path: F.posexplode(F.try_variant_get("v", path, "array<variant>"))
    ledger = d.select("source_path", "sid", explode("$.usageLedger.events").alias("line_no", "e")).where((_text("timestamp", "e") != "") & (_text("model", "e") != "") & _has("tokens", "e"))
    msgs = d.select("source_path", "sid", explode("$.messages").alias("line_no", "m")).where((_text("role", "m") == "assistant") & _has("usage", "m"))
    cache = msgs.select("sid", F.try_variant_get("m", "$.messageId", "bigint").alias("mid"), _num("usage.cacheReadInputTokens", "m").alias("r"), _num("usage.cacheCreationInputTokens", "m").alias("w")).where("mid is not null").dropDuplicates(["sid", "mid"])
    le = ledger.withColumn("mid", F.try_variant_get("e", "$.toMessageId", "bigint")).join(cache, ["sid", "mid"], "left").fillna(0, ["r", "w"])
    inp, out = _num("tokens.input", "e"), _num("tokens.output", "e")
    rest = F.greatest(_num("tokens.total", "e") - (inp + out + F.col("r") + F.col("w")), _zero())
    key = lambda eid, t, m, i, o: F.concat(F.lit("amp:"), F.col("sid"), F.lit(":"), F.when(eid != "", eid).otherwise(F.concat(t, F.lit(":"), m, F.lit(":"), i.cast("string"), F.lit("x"), o.cast("string"))))
    credit = _money("credits", "e")
    one = emit(
        le.where(_at("timestamp", "e").isNotNull()), "amp", F.struct("source_path", "line_no"), dedup_key=key(_text("id", "e"), _text("timestamp", "e"), _text("model", "e"), inp, out + rest), session_id=F.col("sid"), ts=_at("timestamp", "e"),
        model=_text("model", "e"), provider=F.lit("amp"), input=inp, output=out + rest, cache_read=F.col("r"), cache_write=F.col("w"), bill_amount=F.when(credit > 0, credit), bill_unit=F.when(credit > 0, "credits").otherwise(""))
    ts, model = _first(_text("usage.timestamp", "m"), _text("timestamp", "m")), _first(_text("usage.model", "m"), _text("model", "m"))
    mi, mo, mr, mw = (_num(f"usage.{n}", "m") for n in ("inputTokens", "outputTokens", "cacheReadInputTokens", "cacheCreationInputTokens"))
    mo = F.when((mi + mo + mr + mw) == 0, _num("usage.totalTokens", "m")).otherwise(mo)
    two = emit(
        msgs.join(ledger.select("sid").distinct(), "sid", "left_anti").where((ts != "") & (model != "") & stamp(ts).isNotNull()), "amp", F.struct("source_path", "line_no"), dedup_key=key(F.lit(""), ts, model, mi, mo), session_id=F.col("sid"),
        ts=stamp(ts), model=model, provider=F.lit("amp"), input=mi, output=mo, cache_read=mr, cache_write=mw)
    return merge_copies(one.unionByName(two))


@_reader("codebuff")
def codebuff(docs: DataFrame) -> DataFrame:
    """Usage at the message, else in its provider block, else on the last history entry that has any; rows with credits alone stay."""
    from tallyforge.operators.drift import USAGE_NAMES

    df = _elements(docs).withColumn("sid", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1))
    kind = F.lower(_first(_text("variant"), _text("role")))
    hist = F.filter(F.try_variant_get("v", "$.metadata.runState.sessionState.mainAgentState.messageHistory", "array<variant>"),
                    lambda h: (F.lower(_text("role", h)) == "assistant") & F.try_variant_get(h, "$.providerOptions.codebuff.usage", "variant").isNotNull())
    df = df.where(kind.isin("ai", "agent", "assistant")).withColumn("h", F.get(hist, F.size(hist) - 1))
    places = (("v", "metadata.usage."), ("v", "metadata.codebuff.usage."), ("h", "providerOptions.codebuff.usage."))

    def classes(v: str, p: str) -> Column:
        inp, out, read, write = (_first_num(p, *USAGE_NAMES[q], v=v) for q in ("input", "output", "cache_read", "cache_write"))
        alone = F.try_variant_get(v, f"$.{p}inputTokens", "double").isNull() & F.try_variant_get(v, f"$.{p}input_tokens", "double").isNotNull()
        return F.struct(F.when(alone, inp).otherwise(F.greatest(inp - read - write, _zero())).alias("i"), out.alias("o"), read.alias("r"), write.alias("w"))

    def used(c: Column) -> Column:
        return c["i"] + c["o"] + c["r"] + c["w"] > 0

    got = None
    for v, p in reversed(places):
        c = classes(v, p)
        got = c if got is None else F.when(used(c), c).otherwise(got)
    df = df.withColumn("u", got).withColumn("ts", F.coalesce(_at("timestamp"), _at("metadata.timestamp")))
    credit = F.greatest(F.try_variant_get("v", "$.credits", "double"), F.lit(0.0))
    return merge_copies(emit(
        df.where("ts is not null"), "codebuff", F.struct("source_path", "line_no"), dedup_key=F.concat_ws(":", F.lit("codebuff"), "sid", _first(_text("id"), F.col("line_no").cast("string"))), session_id=F.col("sid"), ts=F.col("ts"),
        model=_first(_text("metadata.model"), _text("metadata.modelId"), _text("metadata.codebuff.model"), _text("providerOptions.codebuff.model", "h")), project=_text("metadata.runState.cwd"),
        input=F.col("u.i"), output=F.col("u.o"), cache_read=F.col("u.r"), cache_write=F.col("u.w"), bill_amount=credit, bill_unit=F.when(credit.isNotNull(), "credits").otherwise("")))
