import json
import os
import sqlite3

import pytest

from tallyforge.schema import EVENT
from tallyforge.sources.dialects import READERS
from tallyforge.sources.files import read_documents, read_lines, read_sqlite, sqlite_outcomes
from tallyforge.sources.ledgers import LEDGERS, claude_desktop, wire_fields

CLASSES = ("input", "output", "cache_read", "cache_write", "reasoning")


def write(folder, name, *records, tail="\n"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + tail)
    return str(folder)


def rows(df):
    assert df.columns == [f.name for f in EVENT.fields]
    return {r.dedup_key: r for r in df.collect()}


def classes(r):
    return tuple(r[c] for c in CLASSES)


def lines(spark, folder, harness):
    return rows(READERS[harness](read_lines(spark, str(folder))))


def documents(spark, folder, harness):
    return rows(READERS[harness](read_documents(spark, str(folder))))


def test_lines_tail_and_zstd(spark, tmp_path):
    import zstandard

    write(tmp_path, "a.jsonl", '{"a": 1}', '{"b": 2}', tail='\n{"half')
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"c": 3}\r\n'))
    (tmp_path / "c.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"d": 4}\n' * 50)[:-3])
    got = [(os.path.basename(r.source_path), r.line_no, r.line) for r in read_lines(spark, str(tmp_path)).collect()]
    assert sorted(x for x in got if x[0] != "c.jsonl.zst") == [("a.jsonl", 1, '{"a": 1}'), ("a.jsonl", 2, '{"b": 2}'), ("b.jsonl.zst", 1, '{"c": 3}')]


def test_claude_code(spark, tmp_path):
    use = {"input_tokens": 5, "output_tokens": 10, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 4, "cache_creation": {"ephemeral_1h_input_tokens": 9}, "output_tokens_details": {"thinking_tokens": 3}}
    a = {"type": "assistant", "timestamp": "2026-01-02T03:04:05Z", "sessionId": "s1", "requestId": "r1", "cwd": "/p", "gitBranch": "dev", "message": {"id": "m1", "model": "claude-x", "usage": use}}
    more = json.loads(json.dumps(a))
    more["message"]["usage"]["output_tokens"] = 20
    more["timestamp"] = "2026-01-02T03:04:09Z"
    folder = write(tmp_path, "s1.jsonl", {"type": "system", "subtype": "compact_boundary"}, a, more, "{broken", {"type": "assistant", "uuid": "u", "message": {"model": "<synthetic>", "usage": use}},
                   {"type": "assistant", "uuid": "u2", "isSidechain": True, "agentId": "ag", "timestamp": "2026-01-02T03:05:05Z", "message": {"model": "claude-x", "usage": {"input_tokens": "8", "output_tokens": [1]}}})
    got = lines(spark, folder, "claude-code")
    assert set(got) == {"claude:m1:r1", "claude:uuid:u2"}
    r = got["claude:m1:r1"]
    assert classes(r) == (5, 17, 7, 4, 3) and r.cache_write_1h == 4 and r.boundary == "compact" and r.git_branch == "dev" and r.project == "/p" and str(r.ts).endswith("03:04:09")
    assert got["claude:uuid:u2"].session_id == "ag" and got["claude:uuid:u2"].parent_id == "s1" and got["claude:uuid:u2"].input == 8
    assert set(lines(spark, folder, "openclaude")) == {"openclaude:m1:r1", "openclaude:uuid:u2"}


def test_codex(spark, tmp_path):
    def count(total, last):
        return {"type": "event_msg", "timestamp": "2026-01-02T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": total, "last_token_usage": last}}}

    t1 = {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 5, "reasoning_output_tokens": 2, "total_tokens": 15}
    t2 = {"input_tokens": 30, "cached_input_tokens": 4, "output_tokens": 9, "reasoning_output_tokens": 2, "total_tokens": 39}
    folder = write(tmp_path, "r.jsonl", {"type": "session_meta", "payload": {"id": "s", "cwd": "/w", "model_provider": "p", "git": {"branch": "b"}}}, count(t1, t1), count(t1, t1), {"type": "turn_context", "payload": {"model": "gpt-x"}},
                   count(t2, {"input_tokens": 20, "output_tokens": 4, "cached_input_tokens": 99}))
    got = lines(spark, folder, "codex")
    assert {classes(r) for r in got.values()} == {(6, 3, 4, 0, 2), (0, 4, 20, 0, 0)}
    assert {r.model for r in got.values()} == {"gpt-x"} and {r.session_id for r in got.values()} == {"s"} and "codex:s:10-4-0-5-2-15" in got


def test_session_logs(spark, tmp_path):
    use = {"input": 1, "output": 9, "cacheRead": 2, "cacheWrite": 3, "cacheWrite1h": 8, "reasoning": 4, "cost": {"total": 0}}
    folder = write(tmp_path, "x.jsonl", {"type": "session", "id": "S", "cwd": "/c"}, {"type": "message", "id": "m", "timestamp": 1767323045000, "message": {"role": "assistant", "model": "mm", "responseId": "re", "usage": use}},
                   {"type": "compaction", "id": "k", "timestamp": 1767323046000, "usage": {"input": 5}})
    got = lines(spark, folder, "pi")
    assert classes(got["pi:re"]) == (1, 9, 2, 3, 4) and got["pi:re"].log_cost is None and got["pi:re"].cache_write_1h == 3 and got["pi:k"].model == "mm" and got["pi:k"].input == 5
    assert classes(lines(spark, folder, "step-code")["step-code:re"]) == (1, 5, 2, 3, 4)


def test_gemini_qwen_proof_of_inclusion(spark, tmp_path):
    folder = write(tmp_path / "g", "g.jsonl", {"sessionId": "G"}, {"id": "1", "timestamp": "2026-01-01T00:00:00Z", "model": "gem", "tokens": {"input": 10, "cached": 4, "output": 3, "thoughts": 2, "tool": 1, "total": 16}},
                   {"id": "2", "timestamp": "2026-01-01T00:00:00Z", "tokens": {"promptTokenCount": 10, "cached": 4, "candidates": 3, "total": 17}})
    got = lines(spark, folder, "gemini")
    assert classes(got["gemini:G:1"]) == (7, 3, 4, 0, 2) and classes(got["gemini:G:2"]) == (10, 3, 4, 0, 0)
    q = write(tmp_path / "q", "q.jsonl", {"type": "assistant", "uuid": "u", "timestamp": "2026-01-01T00:00:00Z", "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 2, "cachedContentTokenCount": 4, "totalTokenCount": 12}})
    assert classes(lines(spark, q, "qwen")["qwen:q:u"]) == (6, 2, 4, 0, 0)


def test_kimi_mux_droid_grok_openclaw_dsh_credit(spark, tmp_path):
    k = write(tmp_path / "k", "sess/w.jsonl", {"type": "StatusUpdate", "timestamp": 1767323045, "payload": {"token_usage": {"input": 10, "input_cache_read": 3, "output": 2}}},
              {"type": "usage.record", "payload": {"usageScope": "turn", "usage": {"inputOther": 4, "output": 1}}}, {"type": "usage.record", "payload": {"usageScope": "turn", "usage": {"inputOther": 4, "output": 1}}},
              {"type": "usage.record", "payload": {"usageScope": "other", "usage": {"inputOther": 4}}})
    got = lines(spark, k, "kimi")
    assert len(got) == 3 and classes(got["kimi:sess:0"]) == (7, 2, 3, 0, 0) and sum(x.endswith("#1") for x in got) == 1
    m = write(tmp_path / "m", "ws/c.jsonl", {"role": "assistant", "id": "i", "createdAt": "2026-01-01T00:00:00Z", "metadata": {"model": "anthropic:cl", "usage": {"inputTokens": 10, "outputTokens": 5, "reasoningTokens": 9, "cachedInputTokens": 4}, "providerMetadata": {"anthropic": {"cacheCreationInputTokens": 2}}}})
    r = lines(spark, m, "mux")["mux:ws:i"]
    assert classes(r) == (4, 0, 4, 2, 5) and (r.provider, r.model) == ("anthropic", "cl")
    snap = lambda i, o: {"timestamp": "2026-01-01T00:00:00Z", "model": "d", "tokenUsage": {"inputTokens": i, "outputTokens": o}}
    d = write(tmp_path / "d", "z.settings.jsonl", snap(10, 5), snap(8, 9), snap(12, 9))
    assert sorted(classes(r)[:2] for r in lines(spark, d, "droid").values()) == [(0, 4), (2, 0), (10, 5)]
    g = write(tmp_path / "gr", "S1/u.jsonl", {"msg": "shell.turn.inference_done", "sid": "A", "ts": "2026-01-01T00:00:00Z", "ctx": {"prompt_tokens": 10, "cached_prompt_tokens": 4, "completion_tokens": 6, "reasoning_tokens": 2}},
              {"timestamp": "2026-01-01T00:00:00Z", "params": {"_meta": {"totalTokens": 100}}}, {"timestamp": "2026-01-01T00:00:00Z", "params": {"_meta": {"totalTokens": 20}, "update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 9, "outputTokens": 3, "cachedReadTokens": 2}}}})
    got = lines(spark, g, "grok")
    assert classes(got["grok:unified:A:2026-01-01T00:00:00Z:1"]) == (6, 4, 4, 0, 2) and got["grok:S1:turn-1"].boundary == "compact" and classes(got["grok:S1:turn-1"]) == (7, 3, 2, 0, 0)
    o = write(tmp_path / "o", "oc.jsonl", *[{"message": {"model": "x", "usage": {"input": 3, "cost": {"total": 0.5}}}}] * 2)
    assert len(lines(spark, o, "openclaw")) == 2
    h = write(tmp_path / "h", "h.jsonl", {"type": "session", "id": "H"}, {"seq": 4, "time": 1767323045000, "data": {"usage": {"inputTokens": 3, "reasoningTokens": 1}}})
    assert classes(lines(spark, h, "dsh")["dsh:H#4"]) == (3, 0, 0, 0, 1)
    w = write(tmp_path / "w", "w.jsonl", {"id": "1", "sessionId": "W", "timestamp": 1767323045000, "message": {"usage": {"input_tokens": 10, "output_tokens": 4}}, "providerData": {"messageId": "mm", "model": "q", "rawUsage": {"prompt_tokens": 12, "cached_tokens": 20, "completion_thinking_tokens": 1, "credit": 0.4}}})
    r = lines(spark, w, "workbuddy")["mm"]
    assert classes(r) == (0, 3, 12, 0, 1) and (r.bill_amount, r.bill_unit) == (0.4, "credit") and lines(spark, w, "codebuddy")["mm"].harness == "codebuddy"


def test_kiro(spark, tmp_path):
    text = lambda kind, s: {"kind": kind, "timestamp": "2026-01-01T00:00:00Z", "data": {"content": [{"kind": "text", "data": s}]}}
    f = write(tmp_path, "k.jsonl", text("Prompt", "12345"), text("AssistantMessage", "123456789"), text("ToolResults", "123"), text("Prompt", "no answer"), text("Prompt", "1"), text("AssistantMessage", "1"))
    got = lines(spark, f, "kiro")
    assert {k: classes(r)[:2] for k, r in got.items()} == {"kiro-cli:k:0": (2, 3), "kiro-cli:k:1": (1, 1)}


def test_documents(spark, tmp_path):
    say = lambda **p: {"ts": 1767323045000, "type": "say", "say": "api_req_started", "text": json.dumps(p), "modelInfo": {"providerId": "openai", "modelId": "m"}}
    c = write(tmp_path / "c", "task1/ui.json", json.dumps([say(tokensIn=10, tokensOut=2, cacheReads=4, cacheWrites=1, cost=0.0), {**say(tokensIn=7), "say": "subagent_usage"}, {"type": "ask"}, {**say(), "ts": 5}]))
    got = documents(spark, c, "cline")
    assert classes(got["cline:task1:1767323045000"])[:4] == (5, 2, 4, 1) and got["cline:task1:1767323045000"].log_cost == 0.0 and got["cline:task1-subagents:1767323045000"].parent_id == "task1"
    assert set(documents(spark, c, "roo")) == {"roo:task1:1767323045000", "roo:task1-subagents:1767323045000"} and len(documents(spark, c, "kilo")) == 2
    a = write(tmp_path / "a", "t.json", json.dumps({"id": "T", "messages": [{"role": "assistant", "messageId": 3, "usage": {"cacheReadInputTokens": 5}}], "usageLedger": {"events": [{"id": "e", "timestamp": "2026-01-01T00:00:00Z", "model": "m", "toMessageId": 3, "credits": 2, "tokens": {"input": 1, "output": 2, "total": 20}}]}}),)
    r = documents(spark, a, "amp")["amp:T:e"]
    assert classes(r) == (1, 14, 5, 0, 0) and r.bill_amount == 2
    u = {"inputTokens": 10, "cacheReadInputTokens": 4, "outputTokens": 3}
    b = write(tmp_path / "b", "chat/m.json", json.dumps([{"id": "1", "role": "assistant", "timestamp": 1767323045000, "metadata": {"usage": u, "model": "q"}}, {"id": "2", "variant": "ai", "timestamp": "2026-01-01T00:00:00Z", "credits": "3", "metadata": {}},
                                                   {"id": "3", "role": "assistant", "timestamp": 1767323045000, "metadata": {"runState": {"sessionState": {"mainAgentState": {"messageHistory": [{"role": "assistant", "providerOptions": {"codebuff": {"model": "hm", "usage": {"input_tokens": 9, "cache_read_input_tokens": 4}}}}]}}}}}]))
    got = documents(spark, b, "codebuff")
    assert classes(got["codebuff:chat:1"]) == (6, 3, 4, 0, 0) and got["codebuff:chat:2"].bill_amount == 3 and classes(got["codebuff:chat:3"]) == (9, 0, 4, 0, 0) and got["codebuff:chat:3"].model == "hm"


WRITERS = []  # connections that keep their rows in the write-ahead log


def db(folder, name, script, *params):
    os.makedirs(folder, exist_ok=True)
    con = sqlite3.connect(os.path.join(folder, name))
    if WRITERS:
        assert con.execute("pragma journal_mode=wal").fetchone() == ("wal",)
        con.execute("pragma wal_autocheckpoint=0")
    con.executescript(script)
    for sql, args in params:
        con.execute(sql, args)
    con.commit()
    if WRITERS:
        WRITERS.append(con)
        assert os.path.getsize(os.path.join(folder, name + "-wal")) > 0
    else:
        con.close()
    return str(folder)


@pytest.fixture(params=["plain", "wal"])
def journal(request):
    if request.param == "wal":
        WRITERS.append(None)
    yield
    while WRITERS:
        if con := WRITERS.pop():
            con.close()


def test_write_ahead_log(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("pragma journal_mode=wal")
    con.execute("pragma wal_autocheckpoint=0")
    con.execute("create table t (x, y)")
    con.executemany("insert into t values (?, ?)", [(i, "é" * 300) for i in range(500)])
    con.commit()
    con.execute("pragma wal_checkpoint(truncate)")
    con.execute("update t set y = 'new' where x < 10")
    con.execute("delete from t where x >= 450")
    con.commit()
    con.execute("pragma cache_size=1")
    con.execute("update t set y = 'open'")  # written to the log, not committed
    read = lambda path: sorted((r.x, r.y) for r in read_sqlite(spark, str(path), "t", {"x": "bigint", "y": "string"}).collect())
    want = [(i, "new" if i < 10 else "é" * 300) for i in range(450)]
    assert read(tmp_path) == want and read(tmp_path / "a.db") == want
    log = (tmp_path / "a.db-wal").read_bytes()
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy" / "a.db").write_bytes((tmp_path / "a.db").read_bytes())
    (tmp_path / "copy" / "a.db-wal").write_bytes(log[:32] + b"\0" * 24 + log[56:])  # a torn first frame: the state before
    assert read(tmp_path / "copy") == [(i, "é" * 300) for i in range(500)]
    con.close()


def test_outcomes_of_databases(spark, tmp_path):
    db(tmp_path, "a.db", "create table t (x); insert into t values (1);")
    db(tmp_path, "b.db", "create table t (x);")
    db(tmp_path, "c.db", "create table u (x);")
    (tmp_path / "d.db").write_text("no database at all, but long enough to be looked at")
    got = {r.source_path[-4:]: (r.reason, r.rows) for r in sqlite_outcomes(spark, str(tmp_path), "t").collect()}
    assert got == {"a.db": ("ok", 1), "b.db": ("empty", 0), "c.db": ("unsupported_schema", 0), "d.db": ("corrupt", 0)}


def test_sqlite_reader_is_lenient(spark, tmp_path):
    db(tmp_path, "a.db", "create table t (x, y); insert into t values ('7', 'b'), ('z', null);")
    (tmp_path / "b.db").write_text("no database")
    got = [(r.x, r.y, r.w) for r in read_sqlite(spark, str(tmp_path), "t", {"x": "bigint", "y": "string", "w": "double"}).orderBy("rowid").collect()]
    assert got == [(7, "b", None), (None, None, None)]
    assert read_sqlite(spark, str(tmp_path), "none", {"x": "bigint"}).count() == 0


def test_ledgers(spark, journal, tmp_path):
    data = json.dumps({"role": "assistant", "modelID": "m", "providerID": "p", "cost": "0.5", "time": {"created": 1767323045000}, "tokens": {"input": 3, "output": 2, "cache": {"read": 1}}})
    o = db(tmp_path / "o", "o.db", "create table message (id, session_id, time_updated, data); create table session (id, parent_id, directory); insert into session values ('s', 'up', '/a/b');", ("insert into message values ('x','s',1767323045000,?)", (data,)), ("insert into message values ('y','s',1,?)", ("null",)))
    r = rows(LEDGERS["opencode"](spark, o))["opencode:x"]
    assert classes(r) == (3, 2, 1, 0, 0) and r.parent_id == "up" and r.log_cost == 0.5 and rows(LEDGERS["mimo-code"](spark, o))["mimo-code:x"].project == "b"
    c = tmp_path / "c"
    mk = "create table sessions (id, parent_session_id, prompt_tokens, completion_tokens, cost, created_at, updated_at); create table messages (session_id, model, provider);"
    db(c, "1.db", mk + "insert into sessions values ('s', null, 10, 5, 0.1, 1767323045, 1767323045);")
    db(c, "2.db", mk + "insert into sessions values ('s', null, 8, 9, 0.1, 1767323045, 1767323145);")
    assert {k: classes(r)[:2] for k, r in rows(LEDGERS["crush"](spark, str(c))).items()} == {"crush:s:10:5": (10, 5), "crush:s:8:9": (0, 4)}
    g = db(tmp_path / "g", "g.db", "create table sessions (id, working_dir, created_at, updated_at, accumulated_input_tokens, accumulated_output_tokens, provider_name, model_config_json); insert into sessions values ('s','/w','2026-01-01 00:00:00','2026-01-01 01:00:00',5,6,'p','{\"model_name\": \"mm\"}');")
    assert rows(LEDGERS["goose"](spark, g))["goose:s:5:6"].model == "mm"
    five = "input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, actual_cost_usd"
    h = db(tmp_path / "h", "h.db", f"create table sessions (id, model, started_at, {five}); create table session_model_usage (session_id, model, task, last_seen, {five}); insert into sessions values ('a','m',1767323045,9,9,0,0,0,0.0),('b','m',1767323045,4,0,0,0,0,0.2); insert into session_model_usage values ('a','m2','t',1767323046,1,2,3,4,5,0.0);")
    got = rows(LEDGERS["hermes"](spark, h))
    assert classes(got["hermes:a:m2:t"]) == (1, 2, 3, 4, 5) and got["hermes:b:m:"].log_cost == 0.2 and len(got) == 2
    ctx = json.dumps({"messages": [{"message": {"text": {"role": "Assistant", "model": "m", "tool_calls": [{"call_id": "c9"}]}}, "usage": {"prompt_tokens": {"actual": 9}, "cached_tokens": {"actual": 4}, "completion_tokens": {"actual": 2}}}, {"message": {"text": {"role": "user"}}}]})
    f = db(tmp_path / "f", "f.db", "create table conversations (conversation_id, context, created_at, updated_at);", ("insert into conversations values ('k', ?, '2026-01-01 00:00:00', null)", (ctx,)))
    assert classes(rows(LEDGERS["forge"](spark, f))["forge:k:c9"]) == (5, 2, 4, 0, 0)
    z = db(tmp_path / "z", "z.db", "create table model_usage (id, session_id, started_at, model_id, status, input_tokens, output_tokens, cache_read_tokens); insert into model_usage values ('1','s',1767323045,'m','completed',10,2,40),('2','s',1,'m','running',1,1,1);")
    assert {k: classes(r) for k, r in rows(LEDGERS["zcode"](spark, z)).items()} == {"zcode:1": (0, 2, 10, 0, 0)}
    m = db(tmp_path / "m", "m.db", "create table local_runtime_token_usage (id integer, session_id, ts, input_tokens, output_tokens, model, cost_usd); insert into local_runtime_token_usage values (1,'s',1767323045000,-5,2,'m',0),(2,'s',1767323045000,1,2,'m',-1),(3,' ',1,1,1,'m',1);")
    assert {k: (r.input, r.log_cost) for k, r in rows(LEDGERS["minimax-code"](spark, m)).items()} == {"minimax-code:s:1": (0, 0.0), "minimax-code:s:2": (1, None)}
    tc = json.dumps({"token_usage": {"prompt_tokens": 10, "completion_tokens": 5, "reasoning_tokens": 9, "cache_read_input_tokens": 4}, "persist_user_message_context": {"model_info": {"model_name": "tm"}}})
    t = db(tmp_path / "t", "t.db", "create table chat_turn (turn_id, session_id, created_at, deleted_at, context); create table chat_session (session_id, project_id, deleted_at); create table project (project_id, absolute_path); insert into chat_session values ('s','p',0); insert into project values ('p','/abs');",
           ("insert into chat_turn values ('t1','s',1767323045000,0,?)", (tc,)), ("insert into chat_turn values ('t2','s',1,5,?)", (tc,)))
    got = rows(LEDGERS["trae"](spark, t))
    assert classes(got["trae:t1"]) == (6, 0, 4, 0, 5) and got["trae:t1"].project == "/abs" and len(got) == 1


def test_zed_and_antigravity(spark, journal, tmp_path):
    import zstandard

    doc = json.dumps({"model": {"provider": "p", "model": "m"}, "request_token_usage": {"q1": {"input_tokens": 3, "output_tokens": 1}}, "cumulative_token_usage": {"input_tokens": 10, "output_tokens": 1}})
    z = db(tmp_path / "z", "z.db", "create table threads (id, parent_id, created_at, updated_at, data);", ("insert into threads values ('t', null, '2026-01-01T00:00:00Z', '2026-01-01T00:00:00Z', ?)", (zstandard.ZstdCompressor().compress(doc.encode()),)))
    got = rows(LEDGERS["zed"](spark, z))
    assert got["zed:t:remainder"].input == 7 and sum(r.input for r in got.values()) == 10 and len(got) == 2

    def field(no, v):
        return bytes([no << 3 | (2 if isinstance(v, bytes) else 0)]) + (bytes([len(v)]) + v if isinstance(v, bytes) else bytes([v]))

    use = field(2, 9) + field(3, 8) + field(5, 4) + field(9, 3) + field(10, 2) + field(11, b"resp")
    assert wire_fields(use)[11] == b"resp"
    a = db(tmp_path / "a", "cas.db", "create table gen_metadata (idx, data);", ("insert into gen_metadata values (0, ?)", (field(1, field(4, use)),)), ("insert into gen_metadata values (1, ?)", (b"\xff\xff",)))
    got = rows(LEDGERS["antigravity"](spark, a))
    assert {k: classes(r) for k, r in got.items()} == {"antigravity:cas:resp": (9, 5, 4, 0, 3)}


def test_claude_desktop(spark, tmp_path):
    use = {"input_tokens": 5, "output_tokens": 10}
    t = write(tmp_path / "t", "S.jsonl", *[{"type": "assistant", "timestamp": f"2026-01-02T03:04:0{k}Z", "requestId": f"r{k}", "message": {"id": f"m{k}", "model": "c", "usage": {**use, "input_tokens": 5 + k}}} for k in (1, 2)])
    led = write(tmp_path / "l", "u.ndjson", {"surface": "cowork", "origin": "request", "sessionId": "D", "ts": "2026-01-02T03:04:04Z", "models": {"c": {"inputTokens": 6, "outputTokens": 10, "cost": {"usd": 0.1}}}},
                {"surface": "cowork", "sessionId": "S", "ts": "2026-01-02T03:04:04Z", "models": {"c": {"inputTokens": 99}}})
    got = rows(claude_desktop(read_lines(spark, t), read_lines(spark, led)))
    assert sorted(r.input for r in got.values()) == [6, 7] and "claude:m1:r1" not in got


@pytest.mark.parametrize("harness", sorted(READERS))
def test_missing_root_and_junk(spark, tmp_path, harness):
    write(tmp_path, "x/junk.jsonl", "", "null", "[]", "[1]", '"text"', "{}", '{"message": 5, "type": "assistant"}')
    assert READERS[harness](read_lines(spark, str(tmp_path))).count() == 0
