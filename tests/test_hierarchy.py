import random
import tracemalloc

import pyarrow as pa
import pytest

from tallyforge.operators.components import connected_components
from tallyforge.operators.hierarchy import closure, descendants, hierarchy, session_hierarchy, traverse
from tallyforge.plans import registry

SCHEMA = "scope string, node string, parent string"


def brute(rows):
    up = {}
    for s, n, p in rows:
        if n is None:
            continue
        p = (p or "").strip() or None
        have = up.get((s, n))
        up[s, n] = min(x for x in (have, p) if x) if have or p else None
    out = {}
    for (s, n) in list(up) + [(s, p) for (s, _), p in up.items() if p and (s, p) not in up]:
        path, at = [n], n
        while up.get((s, at)) and up[s, at] not in path:
            at = up[s, at]
            path.append(at)
        out[s, n] = ("(cycle)", -1, None) if up.get((s, at)) else (at, len(path) - 1, path[::-1])
    return out


def result(df):
    return {(r.scope, r.node): (r.root, r.depth, r.path) for r in df.collect()}


@pytest.mark.parametrize("limit", [500_000, 3])
def test_random_forests(spark, limit):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), f"n{i}", rng.choice([None, "", f"n{rng.randrange(40)}"])) for i in range(40)] + [("x", "n3", None)] * 3
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), limit, paths=True).cache()
    assert result(tree) == brute(rows)
    want = brute(rows)
    below = {}
    for (s, n), (_, _, path) in want.items():
        for a in (path or [])[:-1]:
            below[s, a] = below.get((s, a), 0) + 1
    for r in tree.collect():
        if r.depth >= 0:
            assert r.descendants == below.get((r.scope, r.node), 0)
    rows = tree.collect()
    for r in rows:  # descendants by the pre-order
        if r.depth >= 0:
            inside = {x.node for x in rows if (x.scope, x.root) == (r.scope, r.root) and r.enter < x.enter <= r.enter + r.descendants}
            deep = [(x.node, x.depth) for x in rows if x.scope == r.scope and x.path and r.node in x.path[:-1]]
            assert inside == {n for n, _ in deep} and r.height == max([d - r.depth for _, d in deep], default=0)
    got = {}
    for r in descendants(tree).collect():
        got[r.scope, r.ancestor] = got.get((r.scope, r.ancestor), 0) + 1
    assert got == below


def test_cycles_are_marked(spark):
    rows = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "d", "a"), ("s", "e", "e"), ("s", "f", "g")]
    got = {r.node: r for r in hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {n for n, r in got.items() if r.in_cycle} == {"a", "b", "c", "e"}
    assert sum(r.closes_cycle for r in got.values()) == 2
    assert got["d"].root == "(cycle)" and got["d"].depth == -1 and got["f"].root == "g" and not got["g"].stated
    big = {r.node: r for r in hierarchy(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert {n for n, r in big.items() if r.in_cycle} == {"a", "b", "c", "e"} and big["d"].depth == -1


def test_back_edges_of_large_components(spark):
    rows = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "d", "a"), ("s", "e", "e"), ("s", "f", "g"), ("t", "a", "c"), ("t", "c", "a")]
    rows += [("u", f"{i:02d}", f"{(i + 1) % 11:02d}") for i in range(11)] + [("u", "x", "03"), ("u", "zz", "x")]
    for limit in (500_000, 1):
        out = hierarchy(spark.createDataFrame(rows, SCHEMA), limit).collect()
        assert {(r.scope, r.node) for r in out if r.closes_cycle} == {("s", "c"), ("s", "e"), ("t", "c"), ("u", "10")}
        assert all(r.in_cycle for r in out if r.closes_cycle)


def test_long_chain_and_empty(spark):
    rows = [("s", f"{i:05d}", f"{i - 1:05d}" if i else None) for i in range(600)]
    got = result(hierarchy(spark.createDataFrame(rows, SCHEMA), paths=True))
    assert got["s", "00599"][:2] == ("00000", 599)
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hierarchy(spark.createDataFrame([("s", None, "x"), (None, None, None)], SCHEMA)).count() == 0


def test_deep_chain_holds_no_paths():
    n = 100_000
    names = pa.array([f"{i:06d}" for i in range(n)])
    rows = pa.table({"scope": pa.array(["s"] * n), "node": names, "parent": pa.concat_arrays([pa.array([None], pa.string()), names[:-1]]), "conflict": pa.array([False] * n)})
    tracemalloc.start()
    out = pa.Table.from_batches(traverse(rows))
    assert tracemalloc.get_traced_memory()[1] < 200 * 2**20
    tracemalloc.stop()
    last = out.slice(n - 1).to_pylist()[0]
    assert (last["node"], last["root"], last["depth"], last["descendants"]) == ("099999", "000000", n - 1, 0) and out.column("descendants")[0].as_py() == n - 1


def test_both_plans_give_the_same_rows(spark):
    rng = random.Random(11)
    rows = [("s", f"n{i}", f"n{rng.randrange(i)}" if i else None) for i in range(150)] + [("t", f"m{i}", f"m{(i * 7 + 1) % 60}") for i in range(60)]
    rows += [("s", "n9", "n2"), ("s", "n9", "n1"), ("s", "n70", " "), ("u", "hub", "")] + [("u", f"h{i}", "hub") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, split = hierarchy(df, paths=True), hierarchy(df, 1, paths=True)
    assert whole.columns == split.columns and sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
    assert [r.node for r in whole.where("conflict").collect()] == ["n9"]


def test_sessions_of_instances_stay_apart(spark):
    rows = [("h", "", "a", None, 1), ("h", None, "b", "a", 2), ("h", "default", "b", "", 3), ("h", "other", "b", "a", 4), (None, "", "", "a", 5)]
    ev = spark.createDataFrame(rows, "harness string, instance_id string, session_id string, parent_id string, scope int")
    got = {(r.instance_id, r.session_id): (r.root_id, r.depth, r.stated) for r in session_hierarchy(ev).collect()}
    assert got == {("default", "a"): ("a", 0, True), ("default", "b"): ("a", 1, True), ("other", "a"): ("a", 0, False), ("other", "b"): ("a", 1, True)}


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (7, 7), (None, 4), (5, 6), (6, 5), (10, 3)], "src int, dst int")
    assert {r.node: r.component for r in connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 8: 8, 9: 8, 7: 7, 5: 5, 6: 5}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src int, dst int")
    assert connected_components(chain).select("component").distinct().count() == 1
    assert connected_components(links.where("src > 100")).count() == 0


def test_deep_trees_beside_loops(spark):
    """One node far below the others, and loops that stay open: neither is taken for the other."""
    for depth in (9, 17, 40):
        rows = [("s", f"{i:02d}", f"{i - 1:02d}" if i else None) for i in range(depth + 1)] + [("s", "x", "y"), ("s", "y", "x"), ("s", "z", "x")]
        got = result(hierarchy(spark.createDataFrame(rows, SCHEMA), paths=True))
        assert got == brute(rows) and got["s", f"{depth:02d}"][:2] == ("00", depth)


def walked(up):
    """(scope, ancestor, node, distance) by following every node's links until one repeats."""
    out = []
    for s, n in up:
        way = [n]
        while (p := up.get((s, way[-1]))) and p not in way:
            way.append(p)
        out += [(s, a, n, k) for k, a in enumerate(way) if k]
    return sorted(out)


@pytest.mark.parametrize("limit", [500_000, 3])
def test_closure_of_trees_and_loops(spark, limit):
    rng = random.Random(7)
    rows = [(s, f"n{i}", rng.choice([None, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}"])) for s in "xyz" for i in range(30)]
    rows += [("u", f"{i:02d}", f"{(i + 1) % 11:02d}") for i in range(11)] + [("u", "v", "03"), ("u", "w", "v"), ("u", "self", "self"), ("u", "under", "self")]
    got = closure(hierarchy(spark.createDataFrame(rows, SCHEMA), limit, paths=True)).collect()
    assert sorted((r.scope, r.ancestor, r.node, r.distance) for r in got) == walked({(s, n): p for s, n, p in rows})


def test_query_lists_descendants(spark, tmp_path):
    rows = [("h", "", "b", "a"), ("h", None, "c", "b"), ("h", "", "c", None), ("h", "i", "c", "b"), ("h", "", "x", "y"), ("h", "", "y", "x"), ("h", "", "d", "x"), ("h", "", "e", "d")]
    spark.createDataFrame(rows, "harness string, instance_id string, session_id string, parent_id string").write.parquet(str(tmp_path / "usage_events.parquet"))
    got = sorted((r.scope[6:-2], r.ancestor, r.descendant, r.distance) for r in registry.queries()["p6_closure"](spark, str(tmp_path)).collect())
    loop = [("x", "y", 1), ("y", "x", 1), ("x", "d", 1), ("y", "d", 2), ("d", "e", 1), ("x", "e", 2), ("y", "e", 3)]
    assert got == sorted([("default", *p) for p in [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), *loop]] + [("i", "b", "c", 1)])
    counted = registry.queries()["p6_descendants"](spark, str(tmp_path)).collect()
    assert {(r.scope[6:-2], r.ancestor, r.below, r.levels) for r in counted} == {("default", "a", 2, 2), ("default", "b", 1, 1), ("i", "b", 1, 1)}


def test_small_components_stay_whole_beside_large(spark):
    """Joins that adaptive execution turns into broadcasts read their shuffles in place, which must not scatter components."""
    rows = [("s", f"{i:03d}", f"{i - 1:03d}" if i else None) for i in range(60)] + [("t", f"h{i}", "hub") for i in range(300)]
    names = {"spark.sql.autoBroadcastJoinThreshold": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = hierarchy(spark.createDataFrame(rows, SCHEMA).repartition(4), 100).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {r.node: (r.depth, r.descendants) for r in got if r.scope == "s"} == {f"{i:03d}": (i, 59 - i) for i in range(60)}
    assert len(got) == 361 and sum(r.descendants for r in got if r.scope == "t") == 300
