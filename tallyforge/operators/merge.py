"""Keyed merges: upserts without a table format, as aggregations with an explicit sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.schema import KEY, SESSION_KEY, TOKENS


def max_merge(df: DataFrame, key: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Streamed copies of one request: every counter at its largest."""
    return df.groupBy(*key).agg(*[F.max(m).alias(m) for m in measures])


def last_write_wins(df: DataFrame, key: Sequence[str], sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` of every key; equal sequences are settled by the other columns."""
    rest = [c for c in df.columns if c not in key and c != sequence]
    top = df.groupBy(*key).agg(F.max(F.struct(sequence, *rest)).alias("_r"))
    return top.select(*key, *[F.col(f"_r.{c}").alias(c) for c in (sequence, *rest)])


#: a row without key or session is no event
VALID = "coalesce(dedup_key, '') <> '' and coalesce(session_id, '') <> ''"


def upsert_facts(rows: DataFrame, sequence: str) -> DataFrame:
    """Canonical events, one per key, with the owner rule of replays.

    A key belongs to one session: the first one that delivered it as a root, else the first one at all. Rows
    of other sessions are ignored. Within the owner the last row counts, but request id, boundary and bill
    keep the last value that was stated. Rows without key or session are rejected.
    """
    fine = rows.where(VALID)
    sticky = ("request_id", "boundary")
    plain = [c for c in rows.columns if c not in (*KEY, "session_id", *sticky, "bill_amount", "bill_unit", sequence)]
    root = F.coalesce("parent_id", F.lit("")) == ""
    per = fine.groupBy(*KEY, "session_id").agg(
        F.max_by(F.struct(*plain), sequence).alias("last"),
        *[F.coalesce(F.max_by(s, F.when(F.coalesce(s, F.lit("")) != "", F.col(sequence))), F.lit("")).alias(s) for s in sticky],
        F.max_by(F.struct("bill_amount", "bill_unit"), F.when(F.col("bill_amount").isNotNull(), F.col(sequence))).alias("bill"),
        F.min(F.when(root, F.col(sequence))).alias("as_root"), F.min(sequence).alias("first"), F.max(sequence).alias(sequence))
    order = F.struct(F.col("as_root").isNull(), F.coalesce("as_root", "first"))
    own = per.groupBy(*KEY).agg(F.min_by(F.struct("session_id", "last", *sticky, "bill", sequence), order).alias("o"))
    return own.select(*KEY, "o.session_id", *[F.col(f"o.last.{c}").alias(c) for c in plain], *[F.col(f"o.{s}").alias(s) for s in sticky],
                      F.col("o.bill.bill_amount").alias("bill_amount"), F.coalesce("o.bill.bill_unit", F.lit("")).alias("bill_unit"), F.col(f"o.{sequence}").alias(sequence))


def parent_stubs(events: DataFrame) -> DataFrame:
    """A session row for every parent that events name."""
    return events.where("coalesce(parent_id, '') <> ''").select("harness", "instance_id", F.col("parent_id").alias("session_id")).distinct()


def fold_sessions(meta: DataFrame, sequence: str) -> DataFrame:
    """One row per session: last stated parent, title and project, earliest start, latest update; blank text is not stated."""
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct(sequence, c))), F.lit("")).alias(c)
    return meta.where("coalesce(session_id, '') <> ''").groupBy(*SESSION_KEY).agg(
        last("parent_id"), last("title"), last("project"), F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at"))


def first_inserts(new: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of a batch whose key is not stored yet, one per key."""
    return new.join(stored.select(*key), list(key), "left_anti").dropDuplicates(list(key))


def branch_evidence(df: DataFrame, key: Sequence[str] = KEY, branch: str = "git_branch") -> DataFrame:
    """Branch per key: '' once two rows contradict each other; unusable text (control characters, over 256 bytes) is no evidence."""
    usable = (F.col(branch) != "") & (F.octet_length(branch) <= 256) & ~F.col(branch).rlike(r"\p{Cntrl}")
    seen = df.where(usable).groupBy(*key).agg(F.min(branch).alias("lo"), F.max(branch).alias("hi"))
    return seen.select(*key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("branch"))


def prune_orphans(side: DataFrame, facts: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(rows of a side table that still have their fact, rows that lost it)."""
    ids = facts.select(*key).distinct()
    return side.join(ids, list(key), "left_semi"), side.join(ids, list(key), "left_anti")


def replace_sessions(stored: DataFrame, reread: DataFrame, scope: DataFrame) -> DataFrame:
    """Scoped delete and reingest: stored rows of the sessions in ``scope`` give way to what was read again."""
    return stored.join(scope.select(*SESSION_KEY).distinct(), list(SESSION_KEY), "left_anti").unionByName(reread, allowMissingColumns=True)


def overlay(fresh: DataFrame, base: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` and those of ``base`` whose key it does not have."""
    return fresh.unionByName(base.join(fresh.select(*key).distinct(), list(key), "left_anti").select(*base.columns), allowMissingColumns=True)


def best_spelling(df: DataFrame, key: str, rank: Sequence[str]) -> DataFrame:
    """One row per key: the one that is smallest by ``rank``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def fold_tokens(*extra: str) -> list:
    """Sums of all token classes for use in ``agg``."""
    return [F.sum(t).alias(t) for t in (*TOKENS, *extra)]
