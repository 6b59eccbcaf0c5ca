import json
import random

from tallyforge.operators.flatten import flat_members, flat_objects, usage_nodes

SCHEMA = "record_id bigint, body string"


def unwrap(v):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        return w if isinstance(w, dict) else v
    return v


def number(v):
    return (isinstance(v, (int, float)) and not isinstance(v, bool)) or (isinstance(v, str) and v != "" and all(c in "0123456789" for c in v))


def brute(rid, o, near=None):
    out = []
    if isinstance(o, dict):
        o = {k: unwrap(v) if k in ("message", "providerData") else v for k, v in o.items()}
        i = o.get("id")
        has = isinstance(i, (str, int, float)) and not isinstance(i, bool)
        hit = any(isinstance(o.get(a), dict) and isinstance(o[a].get(b), dict) and number(o[a][b].get(c)) for a, b, c in (("message", "usage", "cacheRead"), ("providerData", "rawUsage", "prompt_tokens")))
        if has and hit:
            out.append((rid, str(i), near))
        for v in o.values():
            out += brute(rid, v, str(i) if has else near)
    elif isinstance(o, list):
        for v in o:
            out += brute(rid, v, near)
    return out


def made(rng, depth=0):
    o = {}
    if rng.random() < 0.5:
        outer, inner, counter = rng.choice([("message", "usage", "cacheRead"), ("providerData", "rawUsage", "prompt_tokens")])
        held = {inner: {counter: rng.choice([0, 3, "12", "x", None, -1.5])}, "more": made(rng, depth + 1) if depth < 4 else None}
        o = {"id": rng.choice([1, "a", None, "", 22]), outer: json.dumps(held) if rng.random() < 0.3 else held}
    for _ in range(rng.randrange(1, 5)):
        k = rng.choice(["id", "message", "providerData", "usage", "rawUsage", "cacheRead", "prompt_tokens", "content", "text", "we\"ird\\", "é"])
        kind = rng.randrange(8)
        if kind < 3 and depth < 5:
            o[k] = made(rng, depth + 1)
        elif kind == 3 and depth < 5:
            o[k] = [made(rng, depth + 1) if rng.random() < 0.7 else rng.choice([1, "x", None, [], {}]) for _ in range(rng.randrange(3))]
        elif kind == 4 and depth < 5:
            o[k] = json.dumps(made(rng, depth + 1))
        else:
            o[k] = rng.choice([0, 7, -1, 2.5, "12", "", "n/a", None, True, "{\"id\": 1", "back\\slash \"quoted\" {[", "[{}]", "中文"])
    return o


def key(r):
    return tuple(str(x) for x in r)


def test_random_documents(spark):
    rng = random.Random(11)
    docs = [made(rng) for _ in range(400)]
    rows = [(i, json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))) for i, d in enumerate(docs)]
    want = sorted((x for i, d in enumerate(docs) for x in brute(i, d)), key=key)
    got = sorted((tuple(r) for r in usage_nodes(spark.createDataFrame(rows, SCHEMA)).collect()), key=key)
    assert want and got == want


def test_planted(spark):
    body = {"id": "root", "entries": {"id": 7, "message": json.dumps({"usage": {"cacheRead": 0}, "content": [{"id": "in", "providerData": {"rawUsage": {"prompt_tokens": "5"}}}]}),
                                      "text": json.dumps({"id": "no", "message": {"usage": {"cacheRead": 1}}})}}
    got = {tuple(r) for r in usage_nodes(spark.createDataFrame([(1, json.dumps(body))], SCHEMA)).collect()}
    assert got == {(1, "7", "root"), (1, "in", "7")}


def test_broken_null_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, '{"id": "x}'), (5, "[1, 2"), (6, '{"a": ]}'), (7, "5"), (8, '{"id": 1, "message": {"usage": {"cacheRead": 3}}}'), (None, '{"id": 2, "message": {"usage": {"cacheRead": 3}}}')]
    got = {tuple(r) for r in usage_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(8, "1", None), (None, "2", None)}
    assert usage_nodes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_members_and_long_text(spark):
    body = '{"id": 1, "id": 2, "message": {"usage": {"cacheRead": 1}}, "pad": "' + "x" * 5_000_000 + '"}'
    dead = '{"id": "a", "message": {"usage": {"cacheRead": 1}}, "message": {"usage": {}}}'
    got = {tuple(r) for r in usage_nodes(spark.createDataFrame([(1, body), (2, dead), (2, dead)], SCHEMA)).collect()}
    assert got == {(1, "2", None)}


def test_flat_tables_join(spark):
    body = json.dumps({"id": "r", "items": [{"id": 1, "v": None}, {"w": True, "x": "a\\b"}], "n": 1.5})
    df = spark.createDataFrame([(9, body)], SCHEMA)
    objects, members = flat_objects(df), flat_members(df)
    assert [(r.member, r.node_id, r.parent_node_id) for r in objects.orderBy("node").collect()] == [(None, "r", None), ("items", "1", "r"), ("items", None, "r")]
    joined = members.join(objects, ["record_id", "node"]).select("member", "name", "kind", "value")
    assert {tuple(r) for r in joined.collect()} == {(None, "id", "string", "r"), (None, "n", "number", "1.5"), ("items", "id", "number", "1"), ("items", "v", "null", None), ("items", "w", "boolean", "true"), ("items", "x", "string", "a\\b")}


def scalars(o, name=None, place=None, held=False):
    """Counter keys (name, kind, value, place) of all scalar members and elements."""
    if isinstance(o, dict):
        o = {k: unwrap(v) if k in ("message", "providerData") else v for k, v in o.items()}
        for k, v in o.items():
            yield from scalars(v, k, None, True)
    elif isinstance(o, list):
        for i, v in enumerate(o):
            yield from scalars(v, name, (*(place or ()), i), True)
    elif held:
        kind = "null" if o is None else "boolean" if isinstance(o, bool) else "string" if isinstance(o, str) else "number"
        yield name, kind, None if o is None else o if kind == "string" else json.dumps(o), place


def test_elements_of_arrays(spark):
    rng = random.Random(12)
    docs = [made(rng) for _ in range(300)] + [{"flags": ["a", "b,]", 3, True, None, "", {"x": [1]}, [[2, []], ["q"]], []], "n": [ ]}, [1, ["two"], {"k": [None]}], 5, []]
    rows = [(i, json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))) for i, d in enumerate(docs)]
    rows += [(1000, '{"a": [1, 2], "a": [3]}'), (1001, "[1, 2")]
    got = [(r.record_id, r.name, r.kind, r.value, r.position and tuple(r.position)) for r in flat_members(spark.createDataFrame(rows, SCHEMA)).collect()]
    # an embedded object is read as an object; its text stays a member, too
    got = [g for g in got if not (g[1] in ("message", "providerData") and g[2] == "string" and g[4] is None and isinstance(unwrap(g[3]), dict))]
    want = [(i, *x) for i, d in enumerate(docs) for x in scalars(d)] + [(1000, "a", "number", "3", (0,))]
    assert sorted(got, key=key) == sorted(want, key=key)
    places = {(r.node_id, r.position and tuple(r.position)) for r in flat_objects(spark.createDataFrame([(1, '{"id": 0, "a": [7, {"id": 1}, [{"id": 2}]]}')], SCHEMA)).collect()}
    assert places == {("0", None), ("1", (1,)), ("2", (2, 0))}


def test_nodes_do_not_depend_on_batches(spark):
    rng = random.Random(13)
    rows = [(i, json.dumps(made(rng))) for i in range(60)] + [(60, '{"id": 1, "tags": ["a", {"id": 2, "x": [1, 2]}], "message": "{\\"k\\": {\\"v\\": 1}}"}')]
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    many = spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    for f in (flat_objects, flat_members):
        assert sorted(map(str, f(one).collect())) == sorted(map(str, f(many).collect()))
    last = flat_objects(one).where("record_id = 60").select("node", "parent_node", "member").orderBy("node").collect()
    assert [tuple(r) for r in last] == [(0, None, None), (1, 0, "tags"), (2, 0, "message"), (3, 2, "k")]
