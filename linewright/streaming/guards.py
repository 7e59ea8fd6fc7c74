"""Per-key guards with state: login blocks, circuit breakers, slow-response alerts.

Each is a fold over a key's events in time order. The state is a few numbers;
one micro-batch of a key is sorted in memory, so the trigger size bounds it.
Times are seconds since the epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def _guard(
    events: DataFrame, key: str, at: str, flag, value_columns: str, state_columns: str, start: tuple,
    step: Callable[[tuple, float, bool], tuple[tuple, tuple | None]],
) -> DataFrame:
    names = [c.split()[0] for c in value_columns.split(", ")]

    def fold(group, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current = state.get if state.exists else start
        rows = []
        for at_, hit in pd.concat(list(batches)).sort_values(["_at", "_tie"])[["_at", "_hit"]].itertuples(index=False):
            current, out = step(current, float(at_), bool(hit))
            if out is not None:
                rows.append((group[0], float(at_), *out))
        state.update(current)
        yield pd.DataFrame(rows, columns=["key", "at", *names])

    slim = events.select(
        F.col(key).cast("string").alias("key"),
        (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_at"),
        F.coalesce(flag, F.lit(False)).alias("_hit"),
        F.xxhash64(*events.columns).alias("_tie"),
    )
    return slim.groupBy("key").applyInPandasWithState(
        fold, f"key string, at double, {value_columns}", state_columns, "append", GroupStateTimeout.NoTimeout
    )


def login_blocks(
    events: DataFrame, key: str, at: str, failed, max_attempts: int = 5, window: float = 60.0, block: float = 300.0
) -> DataFrame:
    """Attempts that were refused, or that started a block: ``(key, at, outcome, blocked_until)``.

    Failures count in a window that starts with the first one. Reaching the
    maximum blocks the key; a success clears the count.
    """

    def step(state, now, hit):
        count, window_end, blocked_until = state
        if now < blocked_until:
            return state, ("refused", blocked_until)
        if not hit:
            return (0, 0.0, 0.0), None
        if now >= window_end:
            count, window_end = 0, now + window
        count += 1
        if count >= max_attempts:
            return (count, window_end, now + block), ("blocked", now + block)
        return (count, window_end, blocked_until), None

    return _guard(
        events, key, at, failed, "outcome string, blocked_until double",
        "count int, window_end double, blocked_until double", (0, 0.0, 0.0), step,
    )


def circuit_openings(events: DataFrame, key: str, at: str, failed, threshold: int = 5, open_seconds: float = 60.0) -> DataFrame:
    """Failures that opened a provider's circuit or kept it open: ``(key, at, failures, open_until)``."""

    def step(state, now, hit):
        failures = state[0] + 1 if hit else 0
        out = (failures, now + open_seconds) if hit and failures >= threshold else None
        return (failures,), out

    return _guard(events, key, at, failed, "failures int, open_until double", "failures int", (0,), step)


def slow_alerts(events: DataFrame, key: str, at: str, slow, trigger: int = 3, cooldown: float = 600.0) -> DataFrame:
    """Alerts for rows of slow responses, at most one per cooldown: ``(key, at, responses)``."""

    def step(state, now, hit):
        run, last = state
        run = run + 1 if hit else 0
        if run >= trigger and now - last >= cooldown:
            return (run, now), (run,)
        return (run, last), None

    return _guard(events, key, at, slow, "responses int", "run int, last_alert double", (0, -1e18), step)
