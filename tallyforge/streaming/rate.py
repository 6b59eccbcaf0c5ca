"""Trailing output rate: batch form over ordered buckets, streaming form with explicit lateness."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trailing_rate(df: DataFrame, at: str, tokens: str, span_s: int = 60, block_s: int = 3600) -> DataFrame:
    """Adds ``rate``: tokens of the rows in (at - span, at] divided by the span.

    Time is cut into blocks and every row is also copied to the block after its own if it can reach it, so
    no window spans the whole table.
    """
    us, span = F.unix_micros(at), int(span_s * 1_000_000)
    block = F.floor(us / (block_s * 1_000_000))
    reach = F.floor((us + span - 1) / (block_s * 1_000_000))
    copies = df.select("*", us.alias("_us"), F.explode(F.array_distinct(F.array(block, reach))).alias("_block"), block.alias("_home"))
    w = Window.partitionBy("_block").orderBy("_us").rangeBetween(-span + 1, 0)
    return copies.withColumn("rate", F.round(F.sum(tokens).over(w) / float(span_s), 6)).where("_block = _home").select(*df.columns, "rate")


STATE = "present bigint, last_live bigint, lost_at bigint, ats array<bigint>, tokens array<bigint>, overflow boolean"
OUT = "key string, at_us bigint, tokens bigint, rate double, status string, refused bigint"
LIMIT = 2**63 - 1
CAPACITY = 4096  # distinct times with tokens in the window of a key; one more is refused, and the rate is unknown until it has left the window
FRESHNESS_US = 60_000_000
NEVER = -(2**62)


class Tracker:
    """Output tokens of one key over the trailing window ``(now - span, now]``.

    ``observe`` returns why an observation was not counted, or an empty text. Observations of history (``backfill``, ``unknown``) are
    ignored. Time never goes back: an observation before the newest known time is refused and changes nothing. A
    delta of zero shows that the key is alive and takes no place. An observation that finds all places taken is refused
    and nothing is dropped for it; a sum that no 64-bit number holds makes the key unavailable for good.
    """

    def __init__(self, span_us: int = 60_000_000, capacity: int = CAPACITY, freshness_us: int = FRESHNESS_US, state: tuple | None = None) -> None:
        self.span, self.capacity, self.freshness = span_us, capacity, freshness_us
        self.present, self.last_live, self.lost_at, ats, tokens, self.overflow = state or (NEVER, NEVER, NEVER, (), (), False)
        self.kept = deque([int(a), int(n)] for a, n in zip(ats, tokens))
        self.total = sum(n for _, n in self.kept)

    def state(self) -> tuple:
        return self.present, self.last_live, self.lost_at, [a for a, _ in self.kept], [n for _, n in self.kept], self.overflow

    def _leave(self, now: int) -> None:
        while self.kept and self.kept[0][0] <= now - self.span:
            self.total -= self.kept.popleft()[1]

    def observe(self, at: int | None, delta: int | None, kind: str | None) -> str:
        if kind in ("backfill", "unknown"):
            return ""
        if kind != "live":
            return "invalid_class"
        if at is None:
            return "invalid_time"
        if delta is None or delta < 0:
            return "negative_delta"
        if self.overflow:
            return "counter_overflow"
        if at < self.present:
            return "out_of_order"
        same = bool(self.kept) and self.kept[-1][0] == at
        # places that are still taken at that time; a refused observation does not move the window
        if delta and not same and len(self.kept) >= self.capacity and self.kept[len(self.kept) - self.capacity][0] > at - self.span:
            self.lost_at = max(self.lost_at, at)
            return "capacity_exceeded"
        self._leave(at)
        if delta and (self.kept[-1][1] if same else 0) + delta > LIMIT:
            self.overflow = True
            return "counter_overflow"
        if delta and same:
            self.kept[-1][1] += delta
        elif delta:
            self.kept.append([at, delta])
        self.total += delta
        self.present = self.last_live = at
        return ""

    def snapshot(self, now: int) -> tuple[int, float, str]:
        """(tokens, rate, status) of the window that ends now; tokens and rate are 0 unless the status is ``ok``."""
        if not self.overflow and now >= self.present:
            self.present = now
            self._leave(now)
            self.overflow = self.last_live != NEVER and now - self.last_live <= self.freshness and now >= self.lost_at + self.span and self.total > LIMIT
        status = (
            "counter_overflow" if self.overflow else "clock_regression" if now < self.present else "no_live_signal" if self.last_live == NEVER
            else "stale_telemetry" if now - self.last_live > self.freshness else "capacity_exceeded" if now < self.lost_at + self.span else "ok")
        tokens = self.total if status == "ok" else 0
        return tokens, tokens / (self.span / 1_000_000), status


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tracker = Tracker(state=tuple(state.get) if state.exists else None)
    none = lambda x: None if pd.isna(x) else int(x)
    rows = sorted(((none(q), none(a), none(n), k) for f in frames for q, a, n, k in zip(f["seq"], f["at_us"], f["tokens"], f["kind"])), key=lambda r: (r[0] is None, r[0] or 0))
    refused, now, out = 0, None, None
    for _, at, n, kind in rows:
        if kind == "now":
            now, out = at, tracker.snapshot(at)
        else:
            refused += tracker.observe(at, n, kind) != ""
            out = None
    if out is None:
        now = tracker.present
        out = tracker.snapshot(now)
    state.update(tracker.state())
    yield pd.DataFrame({"key": [key[0]], "at_us": [now], "tokens": [out[0]], "rate": [out[1]], "status": [out[2]], "refused": [refused]})


def streaming_rate(stream: DataFrame) -> DataFrame:
    """Rate per key after every micro-batch; the stream has ``key, seq, at_us, tokens, kind``.

    Observations count in the order of ``seq`` (their arrival), not of their times, so disorder is seen and refused. A row of kind
    ``now`` asks for the rate at its time, which is how silence becomes ``stale_telemetry``; without one the rate is that of the newest known time.
    """
    return stream.groupBy("key").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def persisted_signal(signals: DataFrame, now: Column, freshness_s: int = 60) -> DataFrame:
    """Checks stored rates ``(key, at_us, tokens, rate, status)`` before they are shown: adds ``shown`` and ``reason``.

    A rate is shown if its status is ``ok``, its numbers fit each other, it is not of the future and at most ``freshness_s`` old.
    """
    age = F.unix_micros(now) - F.col("at_us")
    sound = F.col("at_us").isNotNull() & (F.col("tokens") >= 0) & (F.abs(F.col("rate") - F.col("tokens") / 60.0) < 1e-6)
    reason = (
        F.when(F.col("status") != "ok", F.col("status")).when(~F.coalesce(sound, F.lit(False)), "invalid").when(age < 0, "clock_regression")
        .when(age > freshness_s * 1_000_000, "stale_telemetry").otherwise("")
    )
    return signals.withColumns({"reason": reason, "shown": F.when(reason == "", F.col("rate"))})
