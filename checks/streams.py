"""H: streams over the driver tables, and the same work as batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import CATALOG, ITEMS, LOG, catalog, items, log, query, table, text, with_sql
from checks.matching import LEX, MATCH, MATCH_OPTIONS, QUERIES_SQL
from checks.reports import COUNTERS
from linewright.operators import episodes as E
from linewright.plans.batch_match import MatchInputs
from linewright.session import scratch_path
from linewright.streaming import guards, matching, runs, windows


def _stream(spark, sf, name):
    return runs.parquet_stream(spark, sf, f"{name}.parquet", table(spark, sf, name).schema)


@query("H1_match_stream", with_sql(CATALOG, QUERIES_SQL, *LEX, MATCH, body="""
SELECT status, count(*) AS lines, round(avg(confidence), 6) AS mean_confidence FROM (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, status, confidence FROM (
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.status, round(o.confidence, 6) AS confidence FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN outcome o ON q = p_name || ' ' || p_size AND cat = p_type)) GROUP BY 1"""))
def h1(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", F.upper("p_name"), text("p_size")).alias("raw_text"), F.col("p_type").alias("category_hint")
    )
    key = F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    lines = _stream(spark, sf, "lineitem").select(key.alias("request_item_id"), "l_partkey").join(part, "l_partkey")
    path = scratch_path(spark, "matched")
    matching.match_stream(
        lines, MatchInputs(catalog(spark, sf)), path, scratch_path(spark, "match-state"), MATCH_OPTIONS, available_now=True
    ).awaitTermination()
    return spark.read.parquet(path).groupBy("status").agg(
        F.count("*").alias("lines"), F.round(F.avg(F.round("confidence", 6)), 6).alias("mean_confidence")
    )


@query("H2_running_counters", with_sql(ITEMS, body=COUNTERS))
def h2(spark, sf):
    flag = F.col("l_returnflag")
    rows = _stream(spark, sf, "lineitem").select(
        F.concat(F.lit("R"), text("l_orderkey")).alias("request_id"),
        F.when(flag == "A", "auto_match").when(flag == "R", "review_needed").otherwise("no_match").alias("status"),
    )
    return runs.drain_updated(matching.request_counters(rows), ["request_id"], "counters")


BREACHES = """SELECT event_type, epoch_us(time_bucket(INTERVAL '60 minutes', CAST(ts AS TIMESTAMP))) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 4"""


@query("H3_rate_breaches", BREACHES)
def h3(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows.rate_breaches(events, "event_type", "ts", 4, 3600)
    return found.withColumn("window_start", F.unix_micros("window_start"))


@query("H3_rate_breaches_stream", BREACHES)
def h3_stream(spark, sf):
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = runs.drain_updated(windows.rate_breaches(events, "event_type", "ts", 4, 3600), ["event_type", "window_start"], "breaches")
    return found.withColumn("window_start", F.unix_micros("window_start"))


BLOCKS = """e AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS at_, event_type IN ('error', 'click', 'view') AS failed,
  row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP), event_id) AS i FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS window_end, CAST(0 AS DOUBLE) AS blocked_until, CAST(0 AS DOUBLE) AS at_, '' AS outcome
    FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, i, CASE WHEN refused THEN n WHEN failed THEN fresh ELSE 0 END, CASE WHEN refused THEN window_end WHEN failed THEN ending ELSE 0 END,
    CASE WHEN refused THEN blocked_until WHEN NOT failed THEN 0 WHEN fresh >= 5 THEN at_ + 604800 ELSE blocked_until END, at_,
    CASE WHEN refused THEN 'refused' WHEN failed AND fresh >= 5 THEN 'blocked' ELSE '' END
  FROM (SELECT s.user_id, e.i, s.n, s.window_end, s.blocked_until, e.at_, e.failed, e.at_ < s.blocked_until AS refused,
      CASE WHEN e.at_ >= s.window_end THEN 1 ELSE s.n + 1 END AS fresh, CASE WHEN e.at_ >= s.window_end THEN e.at_ + 86400 ELSE s.window_end END AS ending
    FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))"""


@query("H4_login_blocks_stream", f"""WITH RECURSIVE {BLOCKS}
SELECT CAST(user_id AS VARCHAR) AS key, CAST(round(at_ * 1e6) AS BIGINT) AS at_us, outcome, CAST(round(blocked_until * 1e6) AS BIGINT) AS until_us FROM s WHERE outcome <> ''""")
def h4(spark, sf):
    events = _stream(spark, sf, "events")
    failed = F.col("event_type").isin("error", "click", "view")
    found = runs.drain_appended(guards.login_blocks(events, "user_id", "ts", failed, 5, 86400.0, 7 * 86400.0), "blocks")
    micros = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    return found.select("key", micros("at").alias("at_us"), "outcome", micros("blocked_until").alias("until_us"))


@query("H4_login_blocks", f"""WITH RECURSIVE {BLOCKS}
SELECT user_id, CAST(round(at_ * 1e6) AS BIGINT) AS at_us, outcome, CAST(round(blocked_until * 1e6) AS BIGINT) AS until_us FROM s WHERE outcome <> ''""")
def h4_batch(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    failed = F.col("event_type").isin("error", "click", "view")
    found = E.login_blocks(events, "user_id", "ts", failed, ["event_id"], 5, 86400, 7 * 86400)
    return found.select("user_id", F.unix_micros("ts").alias("at_us"), "outcome", F.unix_micros("blocked_until").alias("until_us"))


EPISODES = """e AS (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS at_, event_type <> 'purchase' AS failed FROM events),
r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY at_, event_id) AS run FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY at_, event_id) AS position FROM r WHERE failed)"""


@query("H5_failure_openings", with_sql(EPISODES, body="SELECT user_id, event_id, position, position >= 5 AS opens, epoch_us(at_) + 60000000 AS open_until FROM p WHERE position >= 5"))
def h5(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = E.failure_openings(events, "user_id", "ts", F.col("event_type") != "purchase", ["event_id"]).filter("opens")
    return rows.select("user_id", "event_id", "position", "opens", F.unix_micros("open_until").alias("open_until"))


@query("H5_failure_episodes", with_sql(EPISODES, body="""
SELECT user_id, count(*) AS failures, epoch_us(min(at_)) AS first_failure, epoch_us(min(at_) FILTER (position >= 5)) AS opened_at, epoch_us(max(at_)) + 60000000 AS open_until FROM p GROUP BY user_id, run HAVING count(*) >= 5"""))
def h5_episodes(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = E.failure_episodes(events, "user_id", "ts", F.col("event_type") != "purchase", ["event_id"])
    return rows.select("user_id", "failures", *[F.unix_micros(c).alias(c) for c in ("first_failure", "opened_at", "open_until")])


@query("H5_circuit_openings_stream", with_sql(EPISODES, body="SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(at_) AS at_us, CAST(position AS INTEGER) AS failures FROM p WHERE position >= 5"))
def h5_stream(spark, sf):
    rows = guards.circuit_openings(_stream(spark, sf, "events"), "user_id", "ts", F.col("event_type") != "purchase")
    out = runs.drain_appended(rows, "openings")
    return out.select("key", F.round(F.col("at") * 1e6).cast("bigint").alias("at_us"), "failures")


@query("H6_slow_runs", """
WITH e AS (SELECT event_type, event_id, CAST(ts AS TIMESTAMP) AS at_, value > 5 AS slow FROM events),
r AS (SELECT *, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY at_, event_id) AS run FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY at_, event_id) AS position FROM r WHERE slow)
SELECT event_type, count(*) AS responses, epoch_us(min(at_) FILTER (position = 3)) AS alerted_at, epoch_us(max(at_)) AS last_at FROM p GROUP BY event_type, run HAVING count(*) >= 3""")
def h6(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = E.slow_runs(events, "event_type", "ts", F.col("value"), ["event_id"])
    return rows.select("event_type", "responses", F.unix_micros("alerted_at").alias("alerted_at"), F.unix_micros("last_at").alias("last_at"))


ALERTS = """e AS (SELECT event_type, event_id, CAST(ts AS TIMESTAMP) AS at_, value > 5 AS slow FROM events),
r AS (SELECT *, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY at_, event_id) AS run FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY at_, event_id) AS position FROM r WHERE slow),
d AS (SELECT event_type, epoch_us(at_) AS at_us, position, row_number() OVER (PARTITION BY event_type ORDER BY at_, event_id) AS i FROM p WHERE position >= 3),
a AS (SELECT event_type, at_us, position, i FROM d WHERE i = 1
  UNION ALL SELECT n.* FROM a, LATERAL (SELECT event_type, at_us, position, i FROM d WHERE d.event_type = a.event_type AND d.at_us >= a.at_us + 86400000000 AND d.i > a.i ORDER BY d.i LIMIT 1) n)"""


@query("H6_slow_alerts_stream", f"WITH RECURSIVE {ALERTS} SELECT event_type AS key, at_us, CAST(position AS INTEGER) AS responses FROM a")
def h6_stream(spark, sf):
    slow = guards.slow_alerts(_stream(spark, sf, "events"), "event_type", "ts", F.col("value") > 5.0, cooldown=86400.0)
    return runs.drain_appended(slow, "alerts").select("key", F.round(F.col("at") * 1e6).cast("bigint").alias("at_us"), "responses")


@query("H6_slow_alerts", f"WITH RECURSIVE {ALERTS} SELECT event_type, at_us, position FROM a")
def h6_alerts(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = E.slow_alerts(events, "event_type", "ts", F.col("value"), ["event_id"], cooldown=86400)
    return found.select("event_type", F.unix_micros("ts").alias("at_us"), "position")


@query("H7_daily_usage", with_sql(LOG, body="""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost_usd), 6) AS cost_usd, count(*) AS calls FROM log GROUP BY 1"""))
def h7(spark, sf):
    daily = windows.daily_usage(log(spark, sf))
    return daily.withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn("cost_usd", F.round("cost_usd", 6))


@query("H7_daily_usage_stream", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_tokens, round(sum(value / 1000), 6) AS cost_usd, count(*) AS calls FROM events GROUP BY 1""")
def h7_stream(spark, sf):
    rows = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"), F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens"),
        (F.col("value") / 1000).alias("estimated_cost_usd"),
    )
    daily = runs.drain_updated(windows.daily_usage(rows), ["date"], "usage")
    return daily.withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn("cost_usd", F.round("cost_usd", 6))


@query("I3_run_options", with_sql(ITEMS, body="""
SELECT request_item_id, CASE WHEN confidence >= 0.8 THEN 'auto_match' WHEN confidence >= 0.6 THEN 'review_needed' ELSE 'no_match' END AS status FROM items"""))
def i3(spark, sf):
    from linewright.functions.scoring import status_of
    from linewright.options import MatchOptions

    options = MatchOptions(auto_threshold=0.8, review_threshold=0.6)
    status = status_of(F.col("confidence"), F.lit(False), F.lit(options.auto_threshold), F.lit(options.review_threshold))
    return items(spark, sf).select("request_item_id", status.alias("status"))
