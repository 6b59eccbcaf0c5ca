"""Problem 8: mixing sources to target weights.

Method: hierarchical budgeting. The budget of a mix goes down a tree of three levels by weight: the sources that the
targets name, the languages within each, and the origins (tools) within each language. Weights of the first level are
those of the targets; below it a node weighs its tokens to the power ``TEMPER``, so rare languages get more than
their share of the text and may run dry. A leaf can take at most
its tokens times its allowed repeats, and what it cannot take goes to its siblings first and only then
to the siblings of its ancestors. Every leaf then takes whole passes over its documents and a token
prefix of one more pass, each pass in its own seeded order.

Trees are as large as the table of targets, not as the data, and are solved per mix. Prefixes over the
documents of a leaf are found in two steps, sums per bucket of the order and rows of the one bucket
that the cut falls into, so that no leaf, however large, is ordered in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # ranks file of a public byte-level BPE
# fixed value: pattern that cuts text into pieces for that vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
TEMPER = 0.7  # exponent that flattens the weights of languages and origins (1: in proportion to their tokens)
LEVELS = ("source_label", "lang", "origin")
_PIECE = 200_000  # characters that are encoded at once, at least
#: places where the pattern always parts: after a letter that no letter follows
_PARTS = regex.compile(r"(?<=\p{L})(?=\P{L})")


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a text; a very long one is encoded in pieces that end where the tokenizer parts the text anyway."""
    enc = _encoder(path)
    total, at = 0, 0
    while at < len(text):
        place = _PARTS.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        to = place.start() if place else len(text)
        total += len(enc.encode_ordinary(text[at:to]))
        at = to
    return total


def with_tokens(documents: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "source", "lang", "harness"), path: str = TOKENIZER) -> DataFrame:
    """The kept columns (those the table has) and ``tokens`` of every document; null and empty texts have none."""
    keep = [c for c in keep if c in documents.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t, path) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    slim = documents.select(*keep, F.col(text).alias("_text"))
    return slim.mapInArrow(run, slim.drop("_text").schema.add("tokens", T.LongType()))


def source_key(c: Column | str) -> Column:
    """Labels that differ only in case, outer blanks, or hyphen, blank and underscore are one; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(c), r"(?U)[\s\p{Z}_\-‐‑]+", ""), F.lit(""))


def _water(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of a budget by weight under caps; what a capped one leaves goes to the others by weight."""
    got = [0.0] * len(caps)
    open_ = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if got[i] + left * weights[i] / total >= caps[i] - 1e-9]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            break
        for i in full:
            left -= caps[i] - got[i]
            got[i] = caps[i]
        open_ = [i for i in open_ if i not in full]
    return got


def solve_tree(budget: float, leaves: pd.DataFrame, levels: Sequence[str]) -> pd.DataFrame:
    """``leaf_budget`` of every leaf and, per level, ``wanted_<level>``: what its node would get by weight alone, before
    shortages are redistributed, and ``capacity_<level>``, what the node can take.

    ``leaves`` has a column per level (outermost first), ``weight_<level>`` for the weight of
    its node among its siblings, and ``capacity``. Siblings take over a shortage before ancestors pass it on."""
    if not levels:
        share = leaves["capacity"] / max(leaves["capacity"].sum(), 1e-12)
        return pd.DataFrame({"leaf_budget": share * min(budget, leaves["capacity"].sum())})
    level = levels[0]
    groups = list(leaves.groupby(level, sort=True, dropna=False))
    weights = [float(g[f"weight_{level}"].max()) for _, g in groups]
    caps = [float(g["capacity"].sum()) for _, g in groups]
    parts = []
    for b, w, c, (_, g) in zip(_water(budget, weights, caps), weights, caps, groups):
        part = solve_tree(b, g, levels[1:])
        part[f"wanted_{level}"] = budget * w / sum(weights) if sum(weights) > 0 else 0.0
        part[f"capacity_{level}"] = c
        parts.append(part)
    return pd.concat(parts)


_PLAN = ("mix_id int, source_label string, source_key string, lang string, origin string, weight_share double, budget double, wanted double, available double, "
         "short boolean, tokens double, max_repeats int, entitled double, leaf_budget double")


def plan(targets: DataFrame, sizes: DataFrame, temper: float = TEMPER) -> DataFrame:
    """Budgets of the leaves (source, language, origin) of every mix.

    ``targets``: ``mix_id, source_label, weight, max_repeats, budget_ratio``; ``sizes``: ``source_key, lang, origin, tokens, docs`` of all
    documents that state a source. Result per leaf: ``mix_id, source_label, source_key, lang, origin, weight_share,
    budget`` (of the mix), ``wanted`` (of the source by weight, before redistribution), ``available`` (tokens of the source),
    ``short`` (all its documents used ``max_repeats`` times give less than wanted), ``tokens, max_repeats, entitled`` (of the leaf by
    the weights of all levels alone), ``leaf_budget``. A source without documents has one leaf of zero
    tokens, so has a null or blank label. Null weights and repeats count as zero; a mix whose weights sum to zero wants
    nothing; a label that a mix repeats exactly counts once.
    """
    t = targets.select("mix_id", "source_label", source_key("source_label").alias("source_key"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
                       F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("budget_ratio", F.lit(0.0)).alias("budget_ratio"))
    joined = t.join(sizes, "source_key", "left").withColumn("all_tokens", sizes.agg(F.sum("tokens")).scalar())

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source_label", "lang", "origin"], na_position="first").reset_index(drop=True)
        pdf = pdf.fillna({"tokens": 0, "lang": "", "origin": ""})
        leaves = pdf.assign(source_label=pdf["source_label"].fillna("\0")).drop_duplicates(list(LEVELS))
        leaves["capacity"] = leaves["tokens"] * leaves["max_repeats"]
        leaves["weight_source_label"] = leaves["weight"]
        leaves["weight_lang"] = leaves.groupby(["source_label", "lang"])["tokens"].transform("sum") ** temper
        leaves["weight_origin"] = leaves["tokens"] ** temper
        budget = float(pdf["budget_ratio"].max()) * float(pdf["all_tokens"].fillna(0).max())
        solved = solve_tree(budget, leaves, LEVELS)
        weights = leaves.drop_duplicates("source_label")["weight"].sum()
        pdf["weight_share"] = pdf["weight"] / weights if weights > 0 else 0.0
        pdf["budget"] = budget
        pdf = pdf.join(solved, how="inner")
        pdf["wanted"] = pdf["wanted_source_label"]
        pdf["available"] = leaves.groupby("source_label")["tokens"].transform("sum")
        pdf["short"] = pdf["capacity_source_label"] < pdf["wanted"]
        pdf["entitled"] = pdf["wanted"]
        for k in (1, 2):
            above, name = list(LEVELS[:k]), f"weight_{LEVELS[k]}"
            nodes = leaves.drop_duplicates(list(LEVELS[:k + 1])).groupby(above, as_index=False)[name].sum().rename(columns={name: "_sum"})
            sums = leaves[above].merge(nodes, on=above, how="left")["_sum"].set_axis(leaves.index)
            pdf["entitled"] = pdf["entitled"] * leaves[name] / sums.where(sums > 0, 1.0)
        return pdf[[f.split()[0] for f in _PLAN.split(", ")]]

    return joined.groupBy("mix_id").applyInPandas(solve, _PLAN)


_ORIGIN = ("harness",)


def _placed(counted: DataFrame) -> list[Column]:
    """Source key, language and origin of documents; a table without a column for the origin has one origin."""
    origin = F.coalesce(F.lower(F.trim(*_ORIGIN)), F.lit("")) if _ORIGIN[0] in counted.columns else F.lit("")
    return [source_key("source").alias("source_key"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), origin.alias("origin")]


def leaf_sizes(counted: DataFrame) -> DataFrame:
    """Tokens and documents per source, language and origin of the documents that state a source."""
    return counted.select(*_placed(counted), "tokens").where("source_key is not null").groupBy("source_key", "lang", "origin").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def select_documents(counted: DataFrame, planned: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``(mix_id, source_label, key, tokens, copies)`` of the documents that each mix takes.

    A leaf of T tokens and budget B takes every document floor(B / T) times and once more those whose tokens, summed up in
    the seeded order of the last pass, stay within the rest; what the leaves of a source cannot use of their rests goes to the
    next documents of some of them. Ties of the order go by key; documents without tokens follow the passes.
    """
    docs = counted.select(F.col(key).alias("k"), *_placed(counted), "tokens").where("source_key is not null")
    leaf = planned.where("tokens > 0 and leaf_budget > 0").select(
        "mix_id", "source_label", "source_key", "lang", "origin", "max_repeats", F.floor(F.col("leaf_budget") / F.col("tokens") + 1e-12).cast("int").alias("passes"),
        (F.col("leaf_budget") - F.floor(F.col("leaf_budget") / F.col("tokens") + 1e-12) * F.col("tokens")).alias("rest"))
    both = docs.join(leaf, ["source_key", "lang", "origin"]).withColumn("ord", F.xxhash64("k", F.lit(seed), "mix_id", "passes"))
    both = both.withColumn("bucket", F.pmod(F.shiftright("ord", 52), F.lit(BUCKETS)).cast("int"))
    ends = both.groupBy("mix_id", "source_label", "lang", "origin", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    over = Window.partitionBy("mix_id", "source_label", "lang", "origin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("in_bucket").over(over), F.lit(0)))
    placed = both.join(ends, ["mix_id", "source_label", "lang", "origin", "bucket"])
    whole = placed.where("before + in_bucket <= rest").withColumn("more", F.lit(1))
    none = placed.where("before >= rest and before + in_bucket > rest").withColumn("more", F.lit(0))
    row = Window.partitionBy("mix_id", "source_label", "lang", "origin", "bucket").orderBy("ord", "k").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where("before < rest and before + in_bucket > rest").withColumn("to", F.col("before") + F.sum("tokens").over(row))
    cut = cut.withColumn("straddles", (F.col("to") > F.col("rest")) & (F.col("to") - F.col("tokens") <= F.col("rest")))
    inner = cut.where("not straddles").withColumn("more", (F.col("to") <= F.col("rest")).cast("int")).drop("to", "straddles")
    # one document of a leaf at most lies across its cut; what the leaves of a source leave open together is filled with those that fit
    source = Window.partitionBy("mix_id", "source_label")
    left_open = F.sum(F.col("rest") - F.col("to") + F.col("tokens")).over(source)
    upto = F.sum("tokens").over(source.orderBy("ord", "k", "lang", "origin").rowsBetween(Window.unboundedPreceding, 0))
    across = cut.where("straddles").withColumn("more", ((upto <= left_open) & (F.col("passes") < F.col("max_repeats"))).cast("int")).drop("to", "straddles")
    every = whole.unionByName(none).unionByName(inner).unionByName(across)
    return every.select("mix_id", "source_label", F.col("k").alias(key), "tokens", (F.col("passes") + F.col("more")).alias("copies")).where("copies > 0")


def mix_report(planned: DataFrame, selected: DataFrame) -> DataFrame:
    """Per mix and source: share wanted and reached, tokens wanted, planned and taken, most copies of a document, and
    ``moved_tokens``, what its leaves took over from languages and origins that ran short or from other sources."""
    want = planned.groupBy("mix_id", "source_label").agg(
        F.max("weight_share").alias("target_share"), F.max("wanted").alias("wanted_tokens"), F.sum("leaf_budget").alias("planned_tokens"),
        F.max("available").alias("available_tokens"), F.max("short").alias("short"),
        F.sum(F.greatest(F.col("leaf_budget") - F.col("entitled"), F.lit(0.0))).alias("moved_tokens"))
    got = selected.groupBy("mix_id", "source_label").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"))
    out = want.join(got, ["mix_id", "source_label"], "left").fillna({"taken_tokens": 0, "most_copies": 0})
    w = Window.partitionBy("mix_id")
    return out.withColumn("actual_share", F.coalesce(F.try_divide("taken_tokens", F.sum("taken_tokens").over(w)), F.lit(0.0)))
