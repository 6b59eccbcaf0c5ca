import json

from pyspark.sql import functions as F

from tallyforge.operators.drift import CHAT_FIELDS, CHAT_TYPES, drift_report, ingest, promote, with_previous

SCHEMA = "stream_id string, file_no int, body string"


def chats(spark, rows):
    return spark.createDataFrame([(s, n, b if isinstance(b, (str, type(None))) else json.dumps(b)) for s, n, b in rows], SCHEMA)


def report(spark, rows):
    both = (drift_report(ingest(chats(spark, rows), "body", CHAT_FIELDS, CHAT_TYPES), "stream_id", "file_no"), drift_report(chats(spark, rows), "stream_id", "file_no", "body"))
    first, second = (sorted((r.stream_id, r.file_no, r.kind, r.old_path, r.new_path) for r in out.collect()) for out in both)
    assert first == second
    return first


def test_all_kinds(spark):
    a = {"id": "m", "metadata": {"usage": {"inputTokens": 1}, "model": "x"}, "credits": 1, "steps": [], "gone": None, "o": {}}
    b = {"id": "m", "metadata": {"usage": {"input_tokens": "1"}, "codebuff": {"model": "x"}}, "credits": "1", "fresh": True, "gone": None}
    assert report(spark, [("s", 1, a), ("s", 3, b), ("s", 3, b), ("t", 9, a)]) == [
        ("s", 3, "added", "", "fresh"), ("s", 3, "removed", "steps", ""), ("s", 3, "renamed", "metadata.model", "metadata.codebuff.model"),
        ("s", 3, "renamed", "metadata.usage.inputTokens", "metadata.usage.input_tokens"), ("s", 3, "retyped", "credits", "credits")]


def test_usage_moves_between_places_and_stamp(spark):
    a = {"metadata": {"usage": {"promptTokens": 1}, "timestamp": 5}}
    b = {"metadata": {"codebuff": {"usage": {"inputTokens": 1}}}, "timestamp": "5"}
    assert report(spark, [("s", 1, a), ("s", 2, b)]) == [
        ("s", 2, "renamed", "metadata.timestamp", "timestamp"), ("s", 2, "renamed", "metadata.usage.promptTokens", "metadata.codebuff.usage.inputTokens")]


def test_broken_lines_and_empty(spark):
    assert report(spark, [("s", 1, {"a": 1}), ("s", 2, "{oops"), ("s", 3, None), ("s", 4, "[1]"), ("s", 5, {"a": 2}), (None, 6, {"b": 1}), ("s", None, {"b": 1})]) == []
    assert report(spark, []) == []
    assert report(spark, [("s", 1, {"a": 1}), ("s", 2, {})]) == [("s", 2, "removed", "a", "")]


def test_rescue_and_promotion(spark):
    rows = [("s", 1, {"metadata": {"usage": {"inputTokens": "7", "outputTokens": 2.5}}, "credits": "3.5", "x": [1]}), ("s", 2, {"credits": "many"}), ("s", 3, "{oops"), ("s", 4, None)]
    df = ingest(chats(spark, rows), "body", CHAT_FIELDS, CHAT_TYPES)
    got = {r.file_no: r for r in df.collect()}
    assert got[1].input == 7 and got[1].output is None
    assert json.loads(got[1].rescued) == {"credits": "3.5", "metadata.usage.outputTokens": 2.5, "x": [1]}
    assert json.loads(got[3].rescued) == {"": "{oops"} and got[4].rescued is None and got[3]["shape"] is None
    after = {r.file_no: r for r in promote(df, "credits", ["credits"], "double").collect()}
    assert after[1].credits == 3.5 and "credits" not in json.loads(after[1].rescued)
    assert after[2].credits is None and json.loads(after[2].rescued) == {"credits": "many"}
    again = {r.file_no: r.input for r in promote(df, "input", ["x"], "bigint").collect()}
    assert again[1] == 7


def test_clashing_names_step_aside(spark):
    df = chats(spark, [("s", 1, {"a": 1})]).withColumn("model", F.lit("mine")).withColumn("shape", F.lit("round"))
    out = ingest(df, "body", CHAT_FIELDS, CHAT_TYPES).collect()[0]
    assert out.model == "mine" and out["shape"] == "round" and out._model is None and out._shape == "a:number"


def test_previous_across_blocks(spark):
    df = spark.createDataFrame([("s", n, n * 10) for n in (1, 2, 4, 5, 9, 30)] + [("t", 7, 1)], "s string, n int, v int")
    got = {(r.s, r.n): r.previous for r in with_previous(df, "s", "n", "v", block=4).collect()}
    assert got == {("s", 1): None, ("s", 2): 10, ("s", 4): 20, ("s", 5): 40, ("s", 9): 50, ("s", 30): 90, ("t", 7): None}


def test_long_text(spark):
    assert report(spark, [("s", 1, {"a": "x" * 300_000}), ("s", 2, {"a": 1})]) == [("s", 2, "retyped", "a", "a")]
