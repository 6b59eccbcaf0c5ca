"""Problem 6: parent-child links to full hierarchies.

Method: connected components of the links (pointer doubling, as a node has one parent), every component co-located in one task, then an
iterative depth-first traversal with node colouring that yields depth, root, number of descendants, height,
place in the pre-order and the back edges that close loops.

Links are aggregated to one row per node first, so a session with a third of all event rows is one
row here. The traversal holds a few numbers per node and no paths; paths are only made where they are asked for, one
node at a time while the walk stands on it. A component of more than ``task_nodes`` nodes does not fit one task
and is resolved by distributed pointer doubling, in as many rounds as its depth has binary digits, with
the same rows: the bound chooses the plan, not the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordered import carried
from tallyforge.runtime import blank_to_null, cut, instance_or_default

CYCLE = "(cycle)"
#: nodes of a component that one task walks (a few hundred bytes each)
TASK_NODES = 500_000
_ROWS = 50_000  # nodes of whole components that are walked at once
_PATH_NAMES = 200_000  # names in the paths of one batch
_FIELDS = {
    "scope": pa.string(), "node": pa.string(), "parent": pa.string(), "conflict": pa.bool_(), "stated": pa.bool_(), "root": pa.string(), "depth": pa.int32(),
    "descendants": pa.int64(), "height": pa.int32(), "enter": pa.int64(), "in_cycle": pa.bool_(), "closes_cycle": pa.bool_()}
OUT = ("scope string, node string, parent string, conflict boolean, stated boolean, root string, depth int, "
       "descendants bigint, height int, enter bigint, in_cycle boolean, closes_cycle boolean")


def _numbered(rows: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(parent number per node or -1, scopes, names): the rows' nodes first, then parents that have no row."""
    scope, node, parent = (rows.column(c).combine_chunks() for c in ("scope", "node", "parent"))
    key = pc.binary_join_element_wise(scope, node, "\x1f")
    above = pc.binary_join_element_wise(scope, parent, "\x1f")
    codes = pc.dictionary_encode(pa.chunked_array([key, above])).combine_chunks().indices
    up = np.asarray(pc.fill_null(codes, -1)).astype(np.int64)[len(rows):]
    new, first = np.unique(up, return_index=True)
    first = pa.array(first[new >= len(rows)])
    return (np.concatenate([up, np.full(len(first), -1, np.int64)]), pa.concat_arrays([scope, scope.take(first)]), pa.concat_arrays([node, parent.take(first)]))


def traverse(rows: pa.Table, paths: bool = False) -> Iterator[pa.RecordBatch]:
    """Depth-first traversal of whole components, given as unique ``(scope, node, parent, conflict)`` in the order of siblings.

    White nodes are unvisited, grey ones are on the current way, black ones are finished. Reaching a
    grey node again is a back edge: the nodes of that loop and all that lead into it have no root.
    """
    up, scopes, names = _numbered(rows)
    n = len(up)
    by_parent = np.argsort(up, kind="stable")
    starts = np.searchsorted(up[by_parent], np.arange(n + 1)).tolist()
    kids, above = by_parent.tolist(), up.tolist()
    root, depth, enter = [-1] * n, [-1] * n, [-1] * n
    order: list[int] = []
    for top in kids[: starts[0]]:
        stack, first = [top], len(order)
        while stack:
            at = stack.pop()
            enter[at], root[at] = len(order) - first, top
            depth[at] = depth[above[at]] + 1 if at != top else 0
            order.append(at)
            stack.extend(kids[starts[at]:starts[at + 1]][::-1])
    below, height = [0] * n, [0] * n
    for at in reversed(order):
        if depth[at]:
            below[above[at]] += below[at] + 1
            height[above[at]] = max(height[above[at]], height[at] + 1)
    on_loop, closes = np.zeros(n, bool), np.zeros(n, bool)
    grey, black, lost = 1, 2, [i for i in range(n) if root[i] < 0]
    colour = dict.fromkeys(lost, 0)
    for at in lost:
        way = []
        while colour[at] == 0:
            colour[at] = grey
            way.append(at)
            at = above[at]
        if colour[at] == grey:  # a back edge; any link of the loop can be it, and the greatest node depends on no order
            loop = way[way.index(at):]
            on_loop[loop] = True
            closes[max(loop, key=lambda i: names[i].as_py())] = True
        for one in way:
            colour[one] = black
    rank = np.array(order + lost, np.int64)
    fine = np.arange(n) < len(order)
    roots = np.array(root, np.int64)[rank]
    conflict = pa.concat_arrays([rows.column("conflict").combine_chunks(), pa.array([False] * (n - len(rows)), pa.bool_())])
    values = [
        scopes.take(pa.array(rank)), names.take(pa.array(rank)), names.take(pa.array(up[rank], mask=up[rank] < 0)), conflict.take(pa.array(rank)), pa.array(rank < len(rows)),
        pc.if_else(pa.array(fine), names.take(pa.array(roots, mask=~fine)), CYCLE), pa.array(np.array(depth, np.int32)[rank]),
        *[pa.array(np.array(x, np.int64)[rank], mask=~fine).cast(t) for x, t in ((below, pa.int64()), (height, pa.int32()), (enter, pa.int64()))],
        pa.array(on_loop[rank]), pa.array(closes[rank])]
    table = pa.table(values, schema=pa.schema(list(_FIELDS.items())))
    if not paths:
        yield from table.to_batches(20_000)
        return
    trail: list[str] = []
    held: list[list[str] | None] = []
    size = 0
    for k, at in enumerate(rank.tolist()):
        if k < len(order):
            trail[depth[at]:] = [names[at].as_py()]
            held.append(trail.copy())
            size += len(trail)
        else:
            held.append(None)
        if size >= _PATH_NAMES or len(held) == 20_000 or k + 1 == n:
            yield from table.slice(k + 1 - len(held), len(held)).append_column("path", pa.array(held, pa.list_(pa.string()))).combine_chunks().to_batches()
            held, size = [], 0


def _by_component(paths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < _ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = np.searchsorted(np.asarray(rows.column("component")), rows.column("component")[-1].as_py())
            if last:  # the component that the rows end with may go on
                yield from traverse(rows.slice(0, last), paths)
                held = rows.slice(last).to_batches()
        if held:
            yield from traverse(pa.Table.from_batches(held), paths)

    return run


def _doubling(links: DataFrame, paths: bool) -> DataFrame:
    """The rows of ``traverse`` for components too large for one task, by pointer doubling.

    After round k every node knows its ancestor 2^k above, and sums over the nodes less than 2^k below it; a round adds
    what the nodes exactly 2^k below have found. Nodes that still have such an ancestor when 2^k exceeds the
    number of nodes lead into a loop.
    """
    ends = links.where("parent is not null").select("scope", F.col("parent").alias("node")).distinct()
    absent = ends.join(links, ["scope", "node"], "left_anti").select("scope", "node", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("conflict"), F.lit(False).alias("stated"))
    alls = cut(links.select("scope", "node", "parent", "conflict", F.lit(True).alias("stated")).unionByName(absent))
    count = alls.count()
    state = alls.select("scope", "node", F.col("parent").alias("anc"), F.coalesce("parent", "node").alias("top"), F.col("parent").isNotNull().cast("bigint").alias("depth"),
                        F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("height"))
    reach = 1
    while True:
        gains = state.where("anc is not null").groupBy("scope", F.col("anc").alias("node")).agg(F.sum("size").alias("more"), (F.max("height") + reach).alias("deeper"))
        far = state.select("scope", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        state = cut(state.join(far, ["scope", "anc"], "left").join(gains, ["scope", "node"], "left").select(
            "scope", "node", F.col("anc2").alias("anc"), F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.greatest("height", "deeper").alias("height")))
        reach *= 2
        if reach >= 2 * count or not state.where("anc is not null").limit(1).count():
            break
    fine = cut(alls.join(state.where("anc is null").select("scope", "node", F.col("top").alias("root"), "depth", (F.col("size") - 1).alias("descendants"), "height"), ["scope", "node"]))
    sizes = fine.select("scope", "node", "parent", F.xxhash64("node").alias("at"), (F.col("descendants") + 1).alias("size"))
    # places in the pre-order: a child follows its parent and the subtrees of its earlier siblings
    before = carried(sizes.where("parent is not null"), ["scope", "parent"], ["at", "node"], F.col("size"), "sum", "upto", 2.0**52 / 100_000)
    step = before.select("scope", "node", F.col("parent").alias("anc"), (1 + F.col("upto") - F.col("size")).alias("enter")).unionByName(
        sizes.where("parent is null").select("scope", "node", F.col("parent").alias("anc"), F.lit(0).cast("bigint").alias("enter")))
    if paths:
        step = step.withColumn("path", F.array("node"))
    while step.where("anc is not null").limit(1).count():
        far = step.select("scope", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("enter").alias("enter2"), *([F.col("path").alias("head")] if paths else []))
        step = cut(step.join(far, ["scope", "anc"], "left").select(
            "scope", "node", F.col("anc2").alias("anc"), (F.col("enter") + F.coalesce("enter2", F.lit(0))).alias("enter"),
            *([F.concat(F.coalesce("head", F.array().cast("array<string>")), "path").alias("path")] if paths else [])))
    no = F.lit(False)
    good = fine.join(step.drop("anc"), ["scope", "node"]).withColumns({"in_cycle": no, "closes_cycle": no})
    lost = cut(alls.join(state.where("anc is not null").select("scope", "node", "anc"), ["scope", "node"]))
    ring, step = lost.select("scope", F.col("anc").alias("node")).distinct(), lost.select("scope", "node", F.col("parent").alias("to"))
    seen = -1
    while seen != (seen := ring.count()):  # walking on from a node of a loop marks the whole loop
        ring = cut(ring.join(step, ["scope", "node"]).select("scope", F.explode(F.array("node", "to")).alias("node")).distinct())
        far = step.select("scope", F.col("node").alias("to"), F.col("to").alias("to2"))
        step = cut(step.join(far, ["scope", "to"]).select("scope", "node", F.col("to2").alias("to")))
    # the greatest node of every loop, by doubling around it
    loops = cut(lost.join(ring, ["scope", "node"], "left_semi").select("scope", "node", F.col("parent").alias("to"), F.col("node").alias("closer")))
    for _ in range(math.ceil(math.log2(max(2, seen)))):
        far = loops.select("scope", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("closer").alias("closer2"))
        loops = cut(loops.join(far, ["scope", "to"]).select("scope", "node", F.col("to2").alias("to"), F.greatest("closer", "closer2").alias("closer")))
    bad = lost.join(loops.drop("to"), ["scope", "node"], "left").withColumns({
        "root": F.lit(CYCLE), "depth": F.lit(-1), "in_cycle": F.col("closer").isNotNull(), "closes_cycle": F.coalesce(F.col("node") == F.col("closer"), no)})
    names = [*(f.split()[0] for f in OUT.split(", ")), *(["path"] if paths else [])]
    types = dict(f.split() for f in OUT.split(", ")) | {"path": "array<string>"}
    shaped = [d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast(types[c]).alias(c) for c in names]) for d in (good, bad)]
    return shaped[0].unionByName(shaped[1])


def _tops(links: DataFrame) -> DataFrame:
    """Connected components of links ``(id, up)`` with one row per id: ``(id, component)``, named by the top of the tree or, where
    the links run into a loop, by the smallest id of the loop. Tops themselves are not listed.

    A node has one parent, so following the links twice as far each round finds the top in as many rounds as the depth has
    binary digits; two lists of neighbours are never needed.
    """
    state = links.select("id", F.col("up").alias("ptr"), F.col("id").alias("low"))
    reach, open_ = 1, None
    while True:
        far = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        state = cut(state.join(far, "ptr", "left").select(
            "id", F.coalesce("ptr2", "ptr").alias("ptr"), F.least("low", "low2").alias("low"), F.col("ptr2").isNotNull().alias("open")))
        reach *= 2
        before, open_ = open_, state.where("open").count()
        # in a tree some node comes to its top in every round; if none did, only loops are left, which have to be gone around
        if not open_ or open_ == before and reach >= open_:
            break
    if not open_:
        return state.select("id", F.col("ptr").alias("component"))
    # what is still open has gone around a loop at least once, and stands on it
    loops = state.where("open").select(F.col("id").alias("ptr"), F.col("low").alias("component"))
    return state.where("not open").select("id", F.col("ptr").alias("component")).unionByName(state.where("open").join(loops, "ptr").select("id", "component"))


def hierarchy(links: DataFrame, task_nodes: int = TASK_NODES, paths: bool = False) -> DataFrame:
    """Full hierarchies of ``(scope, node, parent)``: the columns of ``OUT``, one row per node, with ``paths`` also ``path``.

    * ``root`` and ``depth``: a node without parent is a root of depth 0, also one that is only named as
      a parent (``stated`` is then false). Nodes on a loop or leading into one have root ``(cycle)``,
      depth -1 and neither descendants nor path; ``in_cycle`` marks the loop itself and ``closes_cycle``
      the node whose link is the back edge: the greatest of each loop.
    * ``descendants`` is their number, ``height`` the levels below. ``enter`` numbers the nodes of a tree in pre-order (siblings in
      a fixed order): the descendants of a node are those of its root whose ``enter`` is in ``enter + 1 .. enter + descendants``.
    * ``path`` leads from the root to the node, both included.
    * a node with several rows has one parent: the smallest that any row states, and ``conflict`` if rows state
      several; repeated rows and rows without parent do not matter. Rows with a null node are ignored.
      Empty input gives an empty result.
    """
    one = cut(links.select("scope", "node", blank_to_null("parent").alias("parent")).where("node is not null").groupBy("scope", "node").agg(
        F.min("parent").alias("parent"), F.coalesce(F.min("parent") != F.max("parent"), F.lit(False)).alias("conflict")))
    key = lambda c: F.xxhash64("scope", c)  # noqa: E731 - only places nodes; a clash puts two trees in one task
    # a clash makes the links of one id two, which only places more together; the smaller one is followed
    ties = one.where("parent is not null").groupBy(key("node").alias("id")).agg(F.min(key("parent")).alias("up"))
    labels = cut(_tops(ties).withColumnRenamed("id", "_id"))
    # a node without parent is the top of its component
    placed = one.withColumn("_id", key("node")).join(labels, "_id", "left").select(F.coalesce("component", "_id").alias("component"), "scope", "node", "parent", "conflict")
    big = labels.groupBy("component").count().where(F.col("count") > task_nodes).select("component")
    any_big = big.limit(1).count() > 0
    small = placed.join(big, "component", "left_anti") if any_big else placed
    schema = OUT + (", path array<string>" if paths else "")
    # repartitioned by the column of the join above, adaptive execution takes the join's own shuffle instead, and when it then
    # broadcasts ``big`` it reads that shuffle in place, which scatters components; a hash of the column is never left out
    out = small.repartition(F.xxhash64("component")).sortWithinPartitions("component", F.xxhash64("node"), "node").mapInArrow(_by_component(paths), schema)
    return out.unionByName(_doubling(placed.join(big, "component", "left_semi").drop("component"), paths)) if any_big else out


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs ``(scope, ancestor, node, distance)`` of a ``hierarchy`` result with paths, loops left out."""
    return (
        tree.where("path is not null").select("scope", "node", "depth", F.posexplode("path").alias("at", "ancestor"))
        .where("at < depth").select("scope", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
    )


def _around(lost: DataFrame) -> DataFrame:
    """Pairs as in ``descendants`` for ``(scope, node, parent)`` on loops or leading into them: each once, by the shortest way.

    After round k the pairs reach 2^k links up and ``step`` leads exactly that far, which always exists here. The
    first visits of a walk come before all its repeats, so a round without new pairs is the last.
    """
    step = cut(lost.select("scope", "node", F.col("parent").alias("to")))
    pairs = cut(step.where("node <> to").select("scope", F.col("to").alias("ancestor"), "node", F.lit(1).alias("distance")))
    reach, seen = 1, 0
    while seen != (seen := pairs.count()):
        far = pairs.select("scope", F.col("node").alias("to"), "ancestor", (F.col("distance") + reach).alias("distance"))
        more = step.join(far, ["scope", "to"]).where("node <> ancestor").select("scope", "ancestor", "node", "distance")
        pairs = cut(pairs.unionByName(more).groupBy("scope", "ancestor", "node").agg(F.min("distance").alias("distance")))
        on = step.select("scope", F.col("node").alias("to"), F.col("to").alias("to2"))
        step = cut(step.join(on, ["scope", "to"]).select("scope", "node", F.col("to2").alias("to")))
        reach *= 2
    return pairs


def closure(tree: DataFrame) -> DataFrame:
    """``descendants`` of a ``hierarchy`` result with paths, with loops: a node is below all others that its links lead to."""
    whole = cut(tree.select("scope", "node", "parent", "depth", "path"))
    return descendants(whole).unionByName(_around(whole.where("depth < 0")))


def session_links(events: DataFrame) -> DataFrame:
    """``(scope, node, parent)`` of usage events; scope is harness and instance (blank: ``default``)."""
    return events.select(
        F.to_json(F.array(F.coalesce("harness", F.lit("")), instance_or_default())).alias("scope"),
        F.when(blank_to_null("session_id").isNotNull(), F.col("session_id")).alias("node"), F.col("parent_id").alias("parent"),
    )


def session_hierarchy(events: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """``hierarchy`` of the sessions in usage events, with harness and instance as columns again."""
    part = F.from_json("scope", "array<string>")
    return hierarchy(session_links(events), task_nodes).select(
        part[0].alias("harness"), part[1].alias("instance_id"), F.col("node").alias("session_id"), F.col("parent").alias("parent_id"), "conflict", "stated",
        F.col("root").alias("root_id"), "depth", "descendants", "height", "enter", "in_cycle", "closes_cycle")
