"""Problem 4: schemas that drift between files.

Method: rescue-column ingestion. A target schema is enforced on every record: fields it names are
cast into typed columns, whatever is unknown or cannot be cast is kept as JSON in a rescue column,
fields approved later are promoted and replayed from the rescue column into typed columns. The same
pass notes which fields with which types a record carries; the notes of a file are what the drift
report compares. ``file_notes`` is that pass without the columns the report does not read: it merges the notes of a batch by file
before anything is shuffled, so the shuffle is bounded by files and fields, not by records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.runtime import cut, fresh

_GLUE = "\x1f"

# fixed values: the places at which a chat log may hold each quantity, in order of preference
USAGE_PLACES = ("metadata.usage", "metadata.codebuff.usage")
USAGE_NAMES = {
    "input": ("inputTokens", "input_tokens", "promptTokens", "prompt_tokens"),
    "output": ("outputTokens", "output_tokens", "completionTokens", "completion_tokens"),
    "cache_read": ("cacheReadInputTokens", "cache_read_input_tokens", "promptTokensDetails.cachedTokens", "prompt_tokens_details.cached_tokens"),
    "cache_write": ("cacheCreationInputTokens", "cache_creation_input_tokens"),
}
CHAT_FIELDS: dict[str, tuple[str, ...]] = {
    **{q: tuple(f"{at}.{n}" for at in USAGE_PLACES for n in names) for q, names in USAGE_NAMES.items()},
    "model": ("metadata.model", "metadata.modelId", "metadata.codebuff.model"),
    "stamp": ("timestamp", "metadata.timestamp"),
}
CHAT_TYPES = {"input": "bigint", "output": "bigint", "cache_read": "bigint", "cache_write": "bigint", "model": "string", "stamp": "string"}


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, str, object]]:
    """(dotted path, type, value) of every member that is neither an object nor null."""
    todo = [(prefix, value)]
    while todo:
        head, at = todo.pop()
        for k, v in at.items():
            path = f"{head}.{k}" if head else k
            if isinstance(v, dict):
                todo.append((path, v))
            elif v is not None:
                kind = "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "number"
                yield path, kind, v


def _cast(value: object, kind: str) -> object:
    """The value as the target type, or None if that would change it."""
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if kind == "boolean":
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else None
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        if kind == "bigint":
            if isinstance(value, float) and not value.is_integer():
                return None
            n = int(value)
            return n if -(2**63) <= n < 2**63 else None
        return float(value)
    except (ValueError, OverflowError):
        return None


_SPARK = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _flat(text: str | None) -> dict[str, tuple[str, object]] | None:
    try:
        doc = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return {p: (k, v) for p, k, v in leaves(doc)} if isinstance(doc, dict) else None


def ingest(df: DataFrame, body: str, fields: Mapping[str, Sequence[str]], types: Mapping[str, str]) -> DataFrame:
    """The rows of ``df`` without ``body``, with a typed column per field, ``rescued`` and ``shape``.

    ``fields`` names the paths at which each target column may be found: the first one with a value that
    casts is taken. ``rescued`` is a JSON object (path to value) of all that is in no typed column: unknown
    fields, further aliases, values that do not cast; null if there are none. ``shape`` lists the paths and types
    of the record. A body that is null, blank, broken or no object gives null fields, its raw text under
    ``""`` in ``rescued`` and a null ``shape``. Columns of ``df`` keep their names, typed ones step aside.
    """
    keep = [c for c in df.columns if c != body]
    names = fresh(df.select(*keep), *fields, "rescued", "shape") if keep else [*fields, "rescued", "shape"]
    spec = [(tuple(paths), types[c]) for c, paths in fields.items()]
    added = pa.schema([*(pa.field(n, _ARROW[types[c]]) for n, c in zip(names, fields)), pa.field(names[-2], pa.string()), pa.field(names[-1], pa.string())])
    at = df.columns.index(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in added]
            for text in batch.column(at).to_pylist():
                flat = _flat(text)
                if flat is None:
                    for c in cols[:-2]:
                        c.append(None)
                    cols[-2].append(json.dumps({"": text}, ensure_ascii=False) if text is not None else None)
                    cols[-1].append(None)
                    continue
                used = set()
                for c, (paths, kind) in zip(cols, spec):
                    got = None
                    for p in paths:
                        if p in flat and (got := _cast(flat[p][1], kind)) is not None:
                            used.add(p)
                            break
                    c.append(got)
                left = {p: v for p, (_, v) in sorted(flat.items()) if p not in used}
                cols[-2].append(json.dumps(left, ensure_ascii=False) if left else None)
                cols[-1].append(_GLUE.join(sorted(f"{p}:{k}" for p, (k, _) in flat.items())))
            kept = [batch.column(k) for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, f.type) for c, f in zip(cols, added))],
                names=[*keep, *added.names])

    schema = df.select(*keep).schema
    for n, c in zip(names, fields):
        schema = schema.add(n, _SPARK[types[c]])
    return df.mapInArrow(run, schema.add(names[-2], T.StringType()).add(names[-1], T.StringType()))


def promote(ingested: DataFrame, column: str, paths: Sequence[str], kind: str, rescued: str = "rescued") -> DataFrame:
    """Replays rescued values of newly approved paths into a typed column and takes them out of ``rescued``.

    An existing ``column`` is only filled where it is null. Values that do not cast stay rescued.
    """
    name = column if column in ingested.columns else fresh(ingested, column)[0]
    schema = ingested.schema if name in ingested.columns else T.StructType([*ingested.schema.fields, T.StructField(name, _SPARK[kind])])
    at, to = ingested.columns.index(rescued), ingested.columns.index(name) if name in ingested.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = batch.column(to).to_pylist() if to is not None else [None] * batch.num_rows
            left = batch.column(at).to_pylist()
            for i, text in enumerate(left):
                if text is None or have[i] is not None:
                    continue
                rest = json.loads(text)
                for p in paths:
                    if p in rest and (got := _cast(rest[p], kind)) is not None:
                        have[i] = got
                        del rest[p]
                        left[i] = json.dumps(rest, ensure_ascii=False) if rest else None
                        break
            arrays = [batch.column(k) for k in range(batch.num_columns)]
            arrays[at] = pa.array(left, pa.string())
            if to is None:
                arrays.append(pa.array(have, _ARROW[kind]))
            else:
                arrays[to] = pa.array(have, _ARROW[kind])
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ingested.mapInArrow(run, schema)


def with_previous(files: DataFrame, stream: str, order: str, value: str, block: int = 4096) -> DataFrame:
    """Adds ``previous``: the ``value`` of the row before in its stream (null on the first); ``(stream, order)`` is unique.

    The order is cut into blocks, so a stream of any length is never one task: a block looks at its own
    rows, its first row at the last of the block before.
    """
    blocked = files.withColumn("_block", F.floor(F.col(order) / block))
    inner = Window.partitionBy(stream, "_block").orderBy(order)
    ends = blocked.groupBy(stream, "_block").agg(F.max_by(value, order).alias("_last"))
    outer = Window.partitionBy(stream).orderBy("_block")
    ends = ends.select(stream, "_block", F.lag("_last").over(outer).alias("_before"))
    return (
        blocked.withColumn("_lag", F.lag(value).over(inner)).join(ends, [stream, "_block"], "left")
        .select(*files.columns, F.coalesce("_lag", "_before").alias("previous"))
    )


def file_notes(df: DataFrame, body: str, stream: str, order: str) -> DataFrame:
    """``(stream, order, path, kind)`` of the fields that the records of a file carry, once per batch; a file whose only readable
    records are empty objects has an empty path. Records that ``ingest`` cannot read have no notes."""
    known = df.where(F.col(stream).isNotNull() & F.col(order).isNotNull() & F.col(body).isNotNull()).select(stream, order, body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[tuple, int] = {}
            notes: dict[tuple, None] = {}
            for i, (s, o, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                try:
                    doc = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                if isinstance(doc, dict):
                    at = first.setdefault((s, o), i)
                    notes[at, "", ""] = None
                    for path, kind, _ in leaves(doc):
                        notes[at, path, kind] = None
            at, paths, kinds = zip(*notes) if notes else ((), (), ())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(paths, pa.string()), pa.array(kinds, pa.string())], names=[stream, order, "path", "kind"])

    return known.mapInArrow(run, known.drop(body).schema.add("path", T.StringType()).add("kind", T.StringType()))


def _shape_notes(ingested: DataFrame, stream: str, order: str, shape: str) -> DataFrame:
    """The notes of a table that is ingested already, from its shapes."""
    shapes = ingested.where(F.col(shape).isNotNull() & F.col(stream).isNotNull() & F.col(order).isNotNull()).select(stream, order, shape).distinct()
    return shapes.select(stream, order, F.explode(F.split(shape, _GLUE)).alias("_f")).select(
        stream, order, F.regexp_extract("_f", r"(?s)^(.*):\w*$", 1).alias("path"), F.regexp_extract("_f", r":(\w*)$", 1).alias("kind"))


_KINDS = ("array", "boolean", "number", "string")  # in alphabetical order


def file_shapes(notes: DataFrame, stream: str, order: str) -> DataFrame:
    """``(stream, order, fields)``: a map from path to type of every file with notes.

    A path with several types within one file has them joined by ``+`` in alphabetical order.
    """
    bit = sum((F.when(F.col("kind") == k, 1 << i).otherwise(0) for i, k in enumerate(_KINDS)), F.lit(0))
    per = notes.groupBy(stream, order, "path").agg(F.bit_or(bit).alias("bits"))
    names = F.array(*[F.lit("+".join(k for i, k in enumerate(_KINDS) if n & (1 << i))) for n in range(1 << len(_KINDS))])
    per = per.select(stream, order, F.when(F.col("path") != "", F.struct("path", F.get(names, F.col("bits")).alias("kind"))).alias("f"))
    return per.groupBy(stream, order).agg(F.map_from_entries(F.array_sort(F.collect_list("f"))).alias("fields"))


def drift_report(table: DataFrame, stream: str, order: str, body: str | None = None, shape: str = "shape", fields: Mapping[str, Sequence[str]] = CHAT_FIELDS) -> DataFrame:
    """All changes between a file and the file before it: ``(stream, order, kind, old_path, new_path, old_type, new_type)``.

    The table is one that ``ingest`` made, or with ``body`` one that is yet to be ingested. ``retyped``: in both with another type. ``renamed``: gone, while another path of the same target column
    is new; with several on either side the k-th gone path goes with the k-th new one in the order of
    ``fields``. ``removed`` and ``added``: all others gone or new. The first file of a stream changes nothing.
    """
    notes = file_notes(table, body, stream, order) if body else _shape_notes(table, stream, order, shape)
    pairs = with_previous(cut(file_shapes(notes, stream, order)), stream, order, "fields").where(F.col("previous").isNotNull())
    now, old = F.col("fields"), F.col("previous")
    pairs = pairs.select(stream, order, "fields", "previous", F.array_except(F.map_keys(old), F.map_keys(now)).alias("gone"),
                         F.array_except(F.map_keys(now), F.map_keys(old)).alias("came"))

    def ranked(side: str, paths: Sequence[str]) -> Column:
        return F.filter(F.array(*[F.lit(p) for p in paths]), lambda p: F.array_contains(F.col(side), p))

    entry = lambda kind, a, b, x, y: F.struct(F.lit(kind).alias("kind"), a.alias("old_path"), b.alias("new_path"), x.alias("old_type"), y.alias("new_type"))
    moves = F.concat(*[
        F.filter(F.zip_with(ranked("gone", paths), ranked("came", paths), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                 lambda m: m["a"].isNotNull() & m["b"].isNotNull()) for paths in fields.values()])
    pairs = pairs.withColumn("moves", moves)
    none = F.lit("")
    gone = F.array_except("gone", F.transform("moves", lambda m: m["a"]))
    came = F.array_except("came", F.transform("moves", lambda m: m["b"]))
    both = F.filter(F.map_keys(now), lambda p: F.map_contains_key(old, p) & (F.element_at(old, p) != F.element_at(now, p)))
    rows = F.concat(
        F.transform(both, lambda p: entry("retyped", p, p, F.element_at(old, p), F.element_at(now, p))),
        F.transform("moves", lambda m: entry("renamed", m["a"], m["b"], F.element_at(old, m["a"]), F.element_at(now, m["b"]))),
        F.transform(gone, lambda p: entry("removed", p, none, F.element_at(old, p), none)),
        F.transform(came, lambda p: entry("added", none, p, none, F.element_at(now, p))))
    return pairs.select(stream, order, F.explode(rows).alias("r")).select(stream, order, "r.*")
