"""Problem 5: deeply nested records to related flat tables.

Method: Arrow-buffer flattening. The JSON of a whole Arrow batch is one byte buffer with list offsets;
numpy kernels find its strings, brackets and colons at once, give every bracket its parent by one
binary search over (level, position), and emit child rows by taking keys through the parent index.
No record is parsed on its own. Strings that hold a JSON object where an object is meant become the
buffer of a further pass whose roots hang under the object they came from.

A document whose quotes or brackets do not pair gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_CHUNK = 4_000_000  # bytes of JSON that one pass holds; a longer document is a chunk of its own
_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COLON, _COMMA, _QUOTE, _BACK = (ord(c) for c in '{}[]:,"\\')
_STRUCT = np.zeros(256, bool)
_STRUCT[[_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COLON, _COMMA]] = True


@dataclass
class Tables:
    """Flat tables of one batch; indices point into the arrays, ``record`` into the batch."""

    record: np.ndarray  # per object: row of the batch
    parent: np.ndarray  # per object: nearest object around it, -1 if none
    direct: np.ndarray  # per object: it is the value of a member itself, not an element of an array
    member: pa.Array  # per object: name of the member it sits under (through arrays), null at the root
    m_object: np.ndarray  # per scalar member: its object
    m_name: pa.Array
    m_kind: np.ndarray  # per scalar member: s, n, b or z (string, number, boolean, null)
    m_text: pa.Array
    place: pa.Array  # per object: its positions in the arrays between it and its member, outermost first; null if none
    e_record: np.ndarray  # per scalar element of an array: row of the batch
    e_object: np.ndarray  # nearest object around it, -1 if none
    e_name: pa.Array  # member that the outermost array around it, below that object, is the value of
    e_place: pa.Array
    e_kind: np.ndarray
    e_text: pa.Array


def _places(bracket: np.ndarray, at: np.ndarray, o_parent: np.ndarray, o_at: np.ndarray) -> pa.Array:
    """Positions through nested arrays: ``at`` within ``bracket``, then that bracket's own position, and so on."""
    layers = [at]
    while (layers[-1] >= 0).any():
        on = layers[-1] >= 0
        layers.append(np.where(on & (bracket >= 0), o_at[np.maximum(bracket, 0)], -1))
        bracket = np.where(bracket >= 0, o_parent[np.maximum(bracket, 0)], -1)
    grid = np.stack(layers[::-1], axis=1)
    off = np.concatenate([[0], (grid >= 0).sum(axis=1).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(grid[grid >= 0].astype(np.int32)), mask=pa.array(at < 0))


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of the buffer as one Arrow array, by one gather."""
    n = np.maximum(end - start, 0)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.repeat(start - off[:-1], n) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off.tobytes()), pa.py_buffer(data[at].tobytes()))


def _unescaped(texts: pa.Array, escaped: np.ndarray) -> pa.Array:
    """JSON string contents decoded where they hold a backslash."""
    hit = np.flatnonzero(escaped)
    if not len(hit):
        return texts
    out = []
    for t in texts.take(pa.array(hit)).to_pylist():
        try:
            out.append(json.loads(f'"{t}"', strict=False).encode("utf-8", "replace").decode())
        except ValueError:
            out.append(t)
    return pc.replace_with_mask(texts, pa.array(escaped), pa.array(out, pa.large_string()))


def _pass(data: np.ndarray, bounds: np.ndarray) -> dict:
    """Structure of the documents ``data[bounds[i]:bounds[i + 1]]``."""
    n_docs = len(bounds) - 1
    quotes = np.flatnonzero(data == _QUOTE)
    doubt = quotes[(quotes > 0) & (data[np.maximum(quotes - 1, 0)] == _BACK)]
    run = np.zeros(len(doubt), np.int64)
    going = np.ones(len(doubt), bool)
    while going.any():  # as many rounds as the longest run of backslashes before a quote
        at = doubt - run - 1
        going &= at >= 0
        going[going] = data[at[going]] == _BACK
        run += going
    quotes = quotes[~np.isin(quotes, doubt[run % 2 == 1], assume_unique=True)]
    bad = np.zeros(n_docs, bool)
    q_doc = np.searchsorted(bounds, quotes, "right") - 1
    bad |= np.bincount(q_doc, minlength=n_docs)[:n_docs] % 2 == 1
    quotes = quotes[~bad[q_doc]]
    s0, s1 = quotes[0::2], quotes[1::2]

    marks = np.flatnonzero(_STRUCT[data])
    m_doc = np.searchsorted(bounds, marks, "right") - 1
    inside = np.searchsorted(s0, marks) - 1
    free = ~bad[m_doc] & ~((inside >= 0) & (marks < s1[np.maximum(inside, 0)] if len(s0) else np.zeros(len(marks), bool)))
    marks, m_doc = marks[free], m_doc[free]
    kind = data[marks]
    opens, closes = (kind == _OPEN_O) | (kind == _OPEN_A), (kind == _CLOSE_O) | (kind == _CLOSE_A)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    first = np.searchsorted(m_doc, np.arange(n_docs))
    before = np.concatenate([[0], depth])[first]
    last = np.concatenate([[0], depth])[np.searchsorted(m_doc, np.arange(n_docs), "right")]
    bad |= last != before
    depth -= before[m_doc] if len(marks) else 0
    bad[m_doc[depth < 0]] = True
    level = depth + closes
    br = np.flatnonzero(opens | closes)
    order = br[np.argsort(level[br] + m_doc[br] * (int(level.max(initial=0)) + 2), kind="stable")]
    # within a level of a document brackets alternate between an open and its close
    good_docs = ~bad[m_doc[order]]
    order = order[good_docs]
    if len(order) % 2 == 0:
        a, b = kind[order[0::2]], kind[order[1::2]]
        bad[m_doc[order[0::2]][~(((a == _OPEN_O) & (b == _CLOSE_O)) | ((a == _OPEN_A) & (b == _CLOSE_A)))]] = True
    keep = ~bad[m_doc]
    marks, m_doc, kind, depth, opens, level = (x[keep] for x in (marks, m_doc, kind, depth, opens, level))
    return {"marks": marks, "doc": m_doc, "kind": kind, "depth": depth, "opens": opens, "s0": s0, "s1": s1, "bad": bad}


def _shred(data: np.ndarray, bounds: np.ndarray, record: np.ndarray, above: np.ndarray, under: list[str | None], base: int) -> Tables:
    p = _pass(data, bounds)
    marks, doc, kind, depth, s0, s1 = p["marks"], p["doc"], p["kind"], p["depth"], p["s0"], p["s1"]
    size = int(bounds[-1]) + 1
    at_open = np.flatnonzero(p["opens"])
    o_pos, o_level, o_doc, o_obj = marks[at_open], depth[at_open], doc[at_open], kind[at_open] == _OPEN_O
    by_level = np.argsort(o_level * size + o_pos, kind="stable")
    o_key = (o_level * size + o_pos)[by_level]

    def around(level: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The bracket of that level that is open at that position; -1 for level 0."""
        k = np.searchsorted(o_key, level * size + pos, "right") - 1
        return np.where(level > 0, by_level[np.maximum(k, 0)] if len(by_level) else -1, -1)

    o_parent = around(o_level - 1, o_pos)
    colon = np.flatnonzero(kind == _COLON)
    c_pos, c_in = marks[colon], around(depth[colon], marks[colon])
    nxt = np.minimum(colon + 1, max(len(marks) - 1, 0))
    n_pos, n_open = marks[nxt], p["opens"][nxt]
    k = np.maximum(np.searchsorted(s0, c_pos) - 1, 0)
    backs = np.flatnonzero(data == _BACK)
    has_back = lambda a, b: np.searchsorted(backs, a) < np.searchsorted(backs, b)
    fine = (c_in >= 0) & (len(s0) > 0)
    colon, c_pos, c_in, nxt, n_pos, n_open, k = (x[fine] for x in (colon, c_pos, c_in, nxt, n_pos, n_open, k))
    name = _unescaped(_texts(data, s0[k] + 1, s1[k]), has_back(s0[k], s1[k])) if len(k) else pa.array([], pa.large_string())

    # a repeated member name counts once, with its last value
    live = np.ones(len(k), bool)
    if len(k):
        code = name.dictionary_encode().indices.to_numpy().astype(np.int64)
        pair = c_in.astype(np.int64) * (int(code.max()) + 1) + code
        live[:] = False
        _, lastat = np.unique(pair[::-1], return_index=True)
        live[len(k) - 1 - lastat] = True
    mark_to_open = np.full(len(marks) + 1, -1)
    mark_to_open[at_open] = np.arange(len(at_open))
    value_open = np.where(n_open, mark_to_open[nxt], -1)
    o_colon = np.full(len(at_open), -1)
    o_colon[value_open[value_open >= 0]] = np.flatnonzero(value_open >= 0)
    alive = (o_colon < 0) | live[np.maximum(o_colon, 0)] if len(k) else np.ones(len(at_open), bool)
    if not alive.all():
        for lv in range(2, int(o_level.max()) + 1):
            sel = np.flatnonzero(o_level == lv)
            alive[sel] &= alive[o_parent[sel]]

    # the object around a bracket, and the member it hangs on, looked up through the arrays between
    up, via = o_parent.copy(), o_colon.copy()
    while True:
        through = (up >= 0) & ~o_obj[np.maximum(up, 0)] if len(up) else np.zeros(0, bool)
        if not through.any():
            break
        via = np.where(through & (via < 0), o_colon[np.maximum(up, 0)], via)
        up = np.where(through, o_parent[np.maximum(up, 0)], up)
    objs = np.flatnonzero(o_obj & alive) if len(o_obj) else np.zeros(0, int)
    number = np.full(len(o_obj) + 1, -1)
    number[objs] = np.arange(len(objs)) + base
    o_up = up[objs]
    root = o_up < 0
    parent = np.where(root, above[o_doc[objs]], number[o_up])
    names = name.take(pa.array(np.where(via[objs] >= 0, via[objs], 0), mask=via[objs] < 0)) if len(name) else pa.nulls(len(objs), pa.large_string())
    direct = (o_colon[objs] >= 0)
    hang = np.flatnonzero(root & (above[o_doc[objs]] >= 0) & (o_level[objs] == 1))
    if len(hang):
        mask = np.zeros(len(objs), bool)
        mask[hang] = True
        names = pc.replace_with_mask(names, pa.array(mask), pa.array([under[o_doc[objs][h]] for h in hang], pa.large_string()))
        direct[hang] = True

    def scalars(after: np.ndarray, until: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(text, kind, is a string) of the scalars between pairs of marks."""
        if not len(after):
            return pa.array([], pa.large_string()), np.zeros(0, "U1"), np.zeros(0, bool)
        v = np.searchsorted(s0, after, "right") if len(s0) else np.zeros(len(after), int)
        v_ok = np.minimum(v, max(len(s0) - 1, 0))
        is_str = (v < len(s0)) & (s0[v_ok] < until) if len(s0) else np.zeros(len(after), bool)
        start = np.where(is_str, s0[v_ok] + 1, after + 1) if len(s0) else after + 1
        end = np.where(is_str, s1[v_ok], until) if len(s0) else until
        text = _unescaped(_texts(data, start, end), is_str & has_back(start, end))
        text = pc.if_else(pa.array(is_str), text, pc.utf8_trim_whitespace(text))
        lead = pc.utf8_slice_codeunits(text, 0, 1)
        digit = pc.match_substring_regex(text, r"^-?[0-9]").to_numpy(zero_copy_only=False)
        null = pc.equal(lead, "n").to_numpy(zero_copy_only=False)
        return text, np.where(is_str, "s", np.where(digit, "n", np.where(null, "z", "b"))), is_str

    sc = np.flatnonzero(live & ~n_open & (number[c_in] >= 0)) if len(k) else np.zeros(0, int)
    text, kinds, _ = scalars(c_pos[sc], n_pos[sc])

    # elements begin after the bracket of an array and after each comma right within it
    comma = np.flatnonzero(kind == _COMMA)
    begin = np.concatenate([at_open[~o_obj], comma])
    inside = np.concatenate([np.flatnonzero(~o_obj), around(depth[comma], marks[comma])])
    listed = (inside >= 0) & ~o_obj[np.maximum(inside, 0)] if len(o_obj) else np.zeros(0, bool)
    begin, inside = begin[listed] if len(listed) else begin[:0], inside[listed] if len(listed) else inside[:0]
    order = np.lexsort((begin, inside))
    begin, inside = begin[order], inside[order]
    place = np.arange(len(begin)) - np.searchsorted(inside, inside)
    o_at = np.full(len(at_open), -1)
    held = mark_to_open[begin + 1]
    o_at[held[held >= 0]] = place[held >= 0]
    el = np.flatnonzero((held < 0) & np.isin(kind[np.minimum(begin + 1, max(len(kind) - 1, 0))], (_COMMA, _CLOSE_A)) & alive[inside]) if len(begin) else np.zeros(0, int)
    e_text, e_kinds, e_str = scalars(marks[begin[el]], marks[begin[el] + 1])
    real = e_str | (pc.binary_length(e_text).to_numpy(zero_copy_only=False) > 0) if len(el) else np.zeros(0, bool)
    el, e_text, e_kinds = el[real], e_text.filter(pa.array(real, pa.bool_())), e_kinds[real]
    e_in = inside[el]
    e_up, e_via = up[e_in], via[e_in]
    e_name = name.take(pa.array(np.maximum(e_via, 0), mask=e_via < 0)) if len(name) else pa.nulls(len(el), pa.large_string())
    return Tables(record[o_doc[objs]], parent, direct, names, number[c_in[sc]] if len(sc) else np.zeros(0, int), name.take(pa.array(sc)), kinds, text,
                  _places(o_parent[objs], o_at[objs], o_parent, o_at), record[o_doc[e_in]], np.where(e_up >= 0, number[e_up], -1), e_name,
                  _places(e_in, place[el], o_parent, o_at), e_kinds, e_text)


def _join(parts: list[Tables]) -> Tables:
    cat = np.concatenate
    texts = lambda f: pa.chunked_array([getattr(t, f) for t in parts], pa.large_string()).combine_chunks()
    places = lambda f: pa.chunked_array([getattr(t, f) for t in parts], pa.list_(pa.int32())).combine_chunks()
    return Tables(cat([t.record for t in parts]), cat([t.parent for t in parts]), cat([t.direct for t in parts]), texts("member"),
                  cat([t.m_object for t in parts]), texts("m_name"), cat([t.m_kind for t in parts]), texts("m_text"),
                  places("place"), cat([t.e_record for t in parts]), cat([t.e_object for t in parts]), texts("e_name"), places("e_place"), cat([t.e_kind for t in parts]), texts("e_text"))


def shred(bodies: pa.Array, embedded: Sequence[str] = ()) -> Tables:
    """Flat tables of an Arrow array of JSON documents.

    ``embedded`` names members whose string value counts as an object if it holds one, at any depth.
    """
    bodies = bodies.cast(pa.large_string()) if not pa.types.is_large_string(bodies.type) else bodies
    rows = np.flatnonzero(bodies.is_valid().to_numpy(zero_copy_only=False))
    docs = bodies.take(pa.array(rows)) if len(rows) < len(bodies) else bodies
    above, under = np.full(len(rows), -1), [None] * len(rows)
    parts, base = [], 0
    while True:
        off = np.frombuffer(docs.buffers()[1], np.int64)[docs.offset : docs.offset + len(docs) + 1] if len(docs) else np.zeros(1, np.int64)
        data = np.frombuffer(docs.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(docs) else np.zeros(0, np.uint8)
        part = _shred(data, off - off[0], rows, above, under, base)
        parts.append(part)
        base += len(part.record)
        wanted = pc.is_in(part.m_name, pa.array(list(embedded), pa.large_string())).to_numpy(zero_copy_only=False) if embedded else np.zeros(0, bool)
        holds = np.flatnonzero(wanted & (part.m_kind == "s") & pc.match_substring_regex(part.m_text, r"^\s*\{").to_numpy(zero_copy_only=False)) if wanted.any() else []
        if not len(holds):
            return _join(parts)
        first = base - len(part.record)
        docs = part.m_text.take(pa.array(holds))
        above, under = part.m_object[holds], part.m_name.take(pa.array(holds)).to_pylist()
        rows = part.record[above - first]


def _ids(t: Tables) -> tuple[np.ndarray, pa.Array]:
    """(index of the id, or -1, per object; the id texts)."""
    at = np.flatnonzero(pc.equal(t.m_name, "id").to_numpy(zero_copy_only=False) & np.isin(t.m_kind, ["s", "n"])) if len(t.m_kind) else np.zeros(0, int)
    own = np.full(len(t.record), -1)
    own[t.m_object[at]] = at
    return own, t.m_text


def _named_around(t: Tables, own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Nearest object around each that has an id, -1 if none; as many rounds as the nesting is deep."""
    up = t.parent[of]
    while True:
        go = (up >= 0) & (own[np.maximum(up, 0)] < 0) if len(up) else np.zeros(0, bool)
        if not go.any():
            return up
        up = np.where(go, t.parent[np.maximum(up, 0)], up)


def _nodes(t: Tables) -> np.ndarray:
    """Number of every object within its record, whatever batch it came in: objects of the text first, in their order, then
    those of embedded texts."""
    order = np.argsort(t.record, kind="stable")
    held = t.record[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.searchsorted(held, held)
    return out


def _take(texts: pa.Array, at: np.ndarray) -> pa.Array:
    return texts.take(pa.array(np.maximum(at, 0), mask=at < 0)).cast(pa.string()) if len(texts) else pa.nulls(len(at), pa.string())


def _over_chunks(df: DataFrame, key: str, body: str, make: Callable[[pa.Array, Tables], pa.RecordBatch], schema: str, embedded: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHUNK, "right")))
                yield make(batch.column(0).slice(at, to - at), shred(texts.slice(at, to - at), embedded))
                at = to

    return df.select(key, body).where(df[body].isNotNull()).mapInArrow(run, schema)


EMBEDDED = ("message", "providerData")
# fixed values: the usage members that mark a model request, as (object, usage object, counter)
USAGE = (("message", "usage", "cacheRead"), ("providerData", "rawUsage", "prompt_tokens"))


def flat_objects(df: DataFrame, key: str = "record_id", body: str = "body", embedded: Sequence[str] = EMBEDDED) -> DataFrame:
    """One row per JSON object: ``(key, node, parent_node, member, node_id, parent_node_id, position)``.

    ``node`` numbers the objects of a record from 0, ``member`` is the name it hangs on (through arrays), the ids are
    those of the object itself and of the nearest object around it that has one (string or number; null if none).
    ``position`` holds the places, from 0, in the arrays between the object and its member (null if none).
    """
    kind = dict(df.dtypes)[key]

    def make(keys: pa.Array, t: Tables) -> pa.RecordBatch:
        own, texts = _ids(t)
        every, node = np.arange(len(t.record)), _nodes(t)
        around = _named_around(t, own, every)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(t.record)), pa.array(node), pa.array(node[np.maximum(t.parent, 0)] if len(node) else t.parent, mask=t.parent < 0), t.member.cast(pa.string()),
             _take(texts, own), _take(texts, np.where(around >= 0, own[np.maximum(around, 0)], -1)), t.place],
            names=[key, "node", "parent_node", "member", "node_id", "parent_node_id", "position"])

    return _over_chunks(df, key, body, make, f"`{key}` {kind}, node bigint, parent_node bigint, member string, node_id string, parent_node_id string, position array<int>", embedded)


def flat_members(df: DataFrame, key: str = "record_id", body: str = "body", embedded: Sequence[str] = EMBEDDED) -> DataFrame:
    """One row per scalar member and per scalar element of an array: ``(key, node, name, kind, value, position)``.

    ``node`` is as in ``flat_objects``, kinds are ``string number boolean null``, ``value`` is the decoded text (null for
    null). An element has the name of its array's member and ``position``, its places from 0 in the arrays it is in,
    outermost first; members have none. Elements with no object around them have neither node nor name.
    """
    kind = dict(df.dtypes)[key]
    words = {"s": "string", "n": "number", "b": "boolean", "z": "null"}

    def make(keys: pa.Array, t: Tables) -> pa.RecordBatch:
        both = lambda a, b: pa.chunked_array([a, b]).combine_chunks()
        kinds, holder, nodes = np.concatenate([t.m_kind, t.e_kind]), np.concatenate([t.m_object, t.e_object]), _nodes(t)
        node = np.where(holder >= 0, nodes[np.maximum(holder, 0)], -1) if len(nodes) else holder
        value = pc.if_else(pa.array(kinds == "z", pa.bool_()), pa.scalar(None, pa.string()), both(t.m_text, t.e_text).cast(pa.string()))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(np.concatenate([t.record[t.m_object], t.e_record]))), pa.array(node, mask=node < 0), both(t.m_name, t.e_name).cast(pa.string()),
             pa.array([words[k] for k in kinds], pa.string()), value, both(pa.nulls(len(t.m_kind), t.e_place.type), t.e_place)],
            names=[key, "node", "name", "kind", "value", "position"])

    return _over_chunks(df, key, body, make, f"`{key}` {kind}, node bigint, name string, kind string, value string, position array<int>", embedded)


def usage_nodes(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """Objects with an id and a numeric usage counter: ``(key, node_id, parent_node_id)``.

    A counter is a JSON number or a string of digits. The parent is the nearest object around that has an id
    (null if none). A null, empty or broken body gives no rows.
    """
    kind = dict(df.dtypes)[key]

    def make(keys: pa.Array, t: Tables) -> pa.RecordBatch:
        own, texts = _ids(t)
        n = len(t.record)
        hit = np.zeros(n, bool)
        numeric = (t.m_kind == "n") | ((t.m_kind == "s") & pc.match_substring_regex(t.m_text, r"^[0-9]+$").to_numpy(zero_copy_only=False)) if len(t.m_kind) else np.zeros(0, bool)
        for outer, inner, counter in USAGE:
            is_c = pc.equal(t.m_name, counter).to_numpy(zero_copy_only=False) if len(t.m_name) else np.zeros(0, bool)
            u = t.m_object[numeric & is_c]
            named = lambda w: pc.fill_null(pc.equal(t.member, w), False).to_numpy(zero_copy_only=False) & t.direct  # noqa: E731,B023
            u = u[named(inner)[u]] if n else u
            m = t.parent[u]
            m = m[m >= 0]
            m = m[named(outer)[m]] if n else m
            x = t.parent[m]
            hit[x[x >= 0]] = True
        x = np.flatnonzero(hit & (own >= 0))
        around = _named_around(t, own, x)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(t.record[x])), _take(texts, own[x]), _take(texts, np.where(around >= 0, own[np.maximum(around, 0)], -1))],
            names=[key, "node_id", "parent_node_id"])

    return _over_chunks(df, key, body, make, f"`{key}` {kind}, node_id string, parent_node_id string", EMBEDDED)
