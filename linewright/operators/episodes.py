"""Runs of consecutive events over a whole log, for keys of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.operators.scans import running_position, running_sum
from linewright.session import materialize


def with_run_position(log: DataFrame, key: str, at: str, hit: Column, ties: list[str]) -> DataFrame:
    """The hits of a log with ``run`` and ``position``: the how-manieth hit in a row.

    A run ends at the next event of the key that is no hit.
    """
    marked = log.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    runs = running_sum(marked, [key], at, {"run": F.when(F.col("_hit"), 0).otherwise(1)}, ties)
    hits = runs.filter("_hit").drop("_hit")
    return running_position(hits, [key, "run"], at, "position", ties)


def failure_openings(
    log: DataFrame, provider: str, at: str, failed: Column, ties: list[str], threshold: int = 5, open_seconds: int = 60
) -> DataFrame:
    """Failures with their place in the row of failures; from the threshold on each keeps the circuit open."""
    rows = with_run_position(log, provider, at, failed, ties)
    opens = F.col("position") >= threshold
    until = F.col(at) + F.make_dt_interval(secs=F.lit(float(open_seconds)))
    return rows.withColumn("opens", opens).withColumn("open_until", F.when(opens, until))


def failure_episodes(
    log: DataFrame, provider: str, at: str, failed: Column, ties: list[str], threshold: int = 5, open_seconds: int = 60
) -> DataFrame:
    """One row per row of failures that opened the circuit."""
    rows = failure_openings(log, provider, at, failed, ties, threshold, open_seconds)
    return (
        rows.groupBy(provider, "run")
        .agg(
            F.count("*").alias("failures"),
            F.min(at).alias("first_failure"),
            F.min(F.when(F.col("opens"), F.col(at))).alias("opened_at"),
            F.max("open_until").alias("open_until"),
        )
        .filter(F.col("failures") >= threshold)
    )


def slow_runs(
    log: DataFrame, target: str, at: str, seconds: Column, ties: list[str], slow: float = 5.0, trigger: int = 3
) -> DataFrame:
    """One row per run of at least ``trigger`` slow responses."""
    rows = with_run_position(log, target, at, seconds > slow, ties)
    return (
        rows.groupBy(target, "run")
        .agg(
            F.count("*").alias("responses"),
            F.min(F.when(F.col("position") == trigger, F.col(at))).alias("alerted_at"),
            F.max(at).alias("last_at"),
        )
        .filter(F.col("responses") >= trigger)
    )


def _chained(rows: DataFrame, key: str, first: str, next_: str) -> DataFrame:
    """The rows reached from each key's row with ``first`` over ``next_`` (a place in ``place``).

    Each round doubles the steps that every link jumps and adds the rows that
    the known ones reach, so a chain of n links takes log n rounds of joins,
    whichever key holds it.
    """
    links = materialize(rows.select(key, "place", F.col(next_).alias("to")), "links")
    known = materialize(rows.filter(first).select(key, "place"), "chain")
    while True:
        hop = links.select(F.col(key).alias("_k"), F.col("place").alias("_p"), "to").filter("to is not null")
        reached = known.join(hop, (known[key] == hop["_k"]) & (known["place"] == hop["_p"])).select(key, F.col("to").alias("place"))
        fresh = materialize(reached.join(known, [key, "place"], "left_anti"), "chain")
        if fresh.isEmpty():
            return rows.join(known, [key, "place"], "left_semi")
        known = materialize(known.unionByName(fresh), "chain")
        second = links.select(F.col(key).alias("_k"), F.col("place").alias("_p"), F.col("to").alias("_to"))
        links = materialize(
            links.join(second, (links[key] == second["_k"]) & (links["to"] == second["_p"]), "left").select(key, "place", F.col("_to").alias("to")),
            "links",
        )


def _first_at_or_after(rows: DataFrame, key: str, wanted: Column, at: Column, tag: str) -> DataFrame:
    """Adds ``tag``: the place of the key's first row at or after the moment ``wanted``.

    Moments and rows are put in one order; the next row's place is the number
    of rows before the moment, plus one.
    """
    points = rows.select(key, at.alias("_t"), F.lit(1).alias("_is_row"), F.lit(None).cast("long").alias("_from"))
    asks = rows.select(key, wanted.alias("_t"), F.lit(0).alias("_is_row"), F.col("place").alias("_from")).filter("_t is not null")
    # at equal times a moment comes before the rows
    counted = running_sum(points.unionByName(asks), [key], "_t", {"_before": F.col("_is_row")}, ["_is_row", "_from"])
    found = counted.filter("_is_row = 0").select(F.col(key).alias("_k"), "_from", (F.col("_before") + 1).alias(tag))
    sizes = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    found = found.join(sizes, "_k").withColumn(tag, F.when(F.col(tag) <= F.col("_n"), F.col(tag)))
    joined = rows.join(found, (rows[key] == found["_k"]) & (rows["place"] == found["_from"]), "left")
    return joined.select(*rows.columns, tag)


def slow_alerts(
    log: DataFrame, target: str, at: str, seconds: Column, ties: list[str], slow: float = 5.0, trigger: int = 3, cooldown: int = 600
) -> DataFrame:
    """The slow responses that raise an alert: in a run of at least ``trigger``, and ``cooldown`` seconds after the last alert.

    An alert's successor is the first due response after its cooldown, a link
    that does not depend on the alerts before; the alerts are the chain from
    each target's first due response.
    """
    due = with_run_position(log, target, at, seconds > slow, ties).filter(F.col("position") >= trigger)
    due = materialize(running_position(due, [target], at, "place", ties), "due")
    again = F.unix_micros(at) + cooldown * 1_000_000
    linked = materialize(_first_at_or_after(due, target, again, F.unix_micros(at), "next"), "due")
    return _chained(linked, target, "place = 1", "next").drop("place", "next", "run")


def login_blocks(
    log: DataFrame, key: str, at: str, failed: Column, ties: list[str], max_attempts: int = 5, window: int = 60, block: int = 300
) -> DataFrame:
    """Attempts that were refused or that started a block, with ``outcome`` and ``blocked_until``.

    Failures count in a window that starts with the first one; a success ends
    it. What follows a window's first failure does not depend on the past, so
    windows are a chain over the failures of a key. A block must not be shorter
    than a window.
    """
    if block < window:
        raise ValueError("a block must not be shorter than a window")
    rows = materialize(log.withColumn("_hit", F.coalesce(failed, F.lit(False))), "attempts")
    fails = with_run_position(rows, key, at, F.col("_hit"), ties)
    fails = materialize(running_position(fails, [key], at, "place", ties), "failures")
    micros = F.unix_micros(at)
    last = fails.select(F.col(key).alias("_k"), F.col("place").alias("_p"), F.col("run").alias("_run"), F.col(at).alias("_last_at"))
    reach = (fails[key] == last["_k"]) & (fails["place"] + (max_attempts - 1) == last["_p"]) & (fails["run"] == last["_run"])
    starts = fails.join(last, reach, "left").drop("_k", "_p", "_run")
    blocks = F.unix_micros("_last_at") < micros + window * 1_000_000
    starts = starts.withColumn("blocked_at", F.when(blocks, F.col("_last_at"))).drop("_last_at")
    resume = F.coalesce(F.unix_micros("blocked_at") + block * 1_000_000, micros + window * 1_000_000)
    starts = _first_at_or_after(materialize(starts, "windows"), key, resume, micros, "later")
    # without a block a success may end the window sooner
    first_of_run = fails.filter("position = 1").select(F.col(key).alias("_k"), F.col("run").alias("_run"), F.col("place").alias("run_place"))
    runs = running_position(first_of_run, ["_k"], "run_place", "_nth")
    following = runs.select("_k", (F.col("_nth") - 1).alias("_nth"), F.col("run_place").alias("next_run"))
    runs = runs.join(following, ["_k", "_nth"], "left").select("_k", "_run", "next_run")
    starts = starts.join(runs, (starts[key] == runs["_k"]) & (starts["run"] == runs["_run"]), "left")
    next_ = F.when(F.col("blocked_at").isNotNull(), F.col("later")).otherwise(F.least("later", "next_run"))
    linked = materialize(starts.select(key, "place", "blocked_at", next_.alias("next")), "windows")
    chain = _chained(linked, key, "place = 1", "next").filter("blocked_at is not null")
    begun = chain.select(F.col(key).alias("_k"), (F.col("place") + (max_attempts - 1)).alias("_p"))
    begun = fails.join(begun, (fails[key] == begun["_k"]) & (fails["place"] == begun["_p"]), "left_semi").select(key, at, *ties)
    begun = begun.withColumn("_begins", F.lit(1))
    marked = rows.join(begun, [key, at, *ties], "left")
    counted = materialize(running_sum(marked, [key], at, {"_block": F.coalesce("_begins", F.lit(0))}, ties), "attempts")
    until = F.col(at) + F.make_dt_interval(secs=F.lit(float(block)))
    ends = counted.filter("_begins = 1").select(F.col(key).alias("_k"), F.col("_block").alias("_b"), until.alias("blocked_until"))
    inside = counted.join(ends, (counted[key] == ends["_k"]) & (counted["_block"] == ends["_b"]))
    inside = inside.filter((F.col("_begins") == 1) | (F.col(at) < F.col("blocked_until")))
    outcome = F.when(F.col("_begins") == 1, "blocked").otherwise("refused")
    return inside.select(*log.columns, outcome.alias("outcome"), "blocked_until")
