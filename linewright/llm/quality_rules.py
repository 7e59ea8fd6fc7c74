"""Quality rules: documents are judged alone and by the record of their host.

Every document gets rule counts from its whole text. Failures are summed by
host, the failure rate of a host is shrunk with a beta prior that the hosts
themselves give (method of moments), and documents of hosts whose shrunk rate
is too high are rejected with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.session import materialize

WHITE = " \t\n\x0b\f\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host whose shrunk failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.5
#: The prior weighs at most as much as this many documents.
MAX_PRIOR = 1e6

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LOW_HALF, HIGH_HALF = 0xFFFFFFFF, -0x100000000


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+", -1))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``words``.

    Windows are sorted by half a hash with their place in the other half, as
    plain longs. Windows that share the half hash with a neighbour go on to a
    sort by their words, which decides; equal windows always do go on. So the
    count is exact, and a text of n words costs n log n.
    """
    windows = F.transform(
        F.expr("slice(words, 1, greatest(size(words) - 2, 0))"),
        lambda _, i: F.xxhash64(*_window(F.col("words"), i)).bitwiseAND(F.lit(HIGH_HALF)).bitwiseOR(i.cast("long")),
    )
    rows = rows.withColumn("places", F.sort_array(windows))
    rows = rows.withColumn("places", F.filter("places", lambda x, i: _same_half(x, i - 1) | _same_half(x, i + 1)))
    grams = F.transform("places", lambda x: _gram(x.bitwiseAND(F.lit(LOW_HALF)).cast("int")))
    rows = rows.withColumn("grams", F.sort_array(grams))
    rows = rows.withColumn("grams", F.filter("grams", lambda x, i: _same_gram(x, i - 1) | _same_gram(x, i + 1)))
    rows = rows.withColumn("starts", F.sort_array(F.transform("grams", lambda x: x["i"])))
    covered = F.transform(
        "starts", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - x, F.lit(3))).cast("long")
    )
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x))


def _same_half(x: Column, i: Column) -> Column:
    other = F.when(i >= 0, F.get("places", i))
    return F.coalesce(F.shiftright(other, 32) == F.shiftright(x, 32), F.lit(False))


def _gram(i: Column) -> Column:
    return F.struct(F.concat_ws(" ", *_window(F.col("words"), i)).alias("gram"), i.alias("i"))


def _same_gram(x: Column, i: Column) -> Column:
    other = F.when(i >= 0, F.get("grams", i))
    return F.coalesce(other["gram"] == x["gram"], F.lit(False))


def rule_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts, ``base_failed`` and ``rule_failed``, and drops the text.

    A null text counts as an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    out = rows.withColumns(
        {
            "words": _words(whole),
            "lines": lines,
            "word_chars": F.length(F.regexp_replace(whole, "[ \t-\r]+", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long"),
        }
    ).drop(text)
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_lines": F.size("lines"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines")
    out = _with_repeats(out)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    noisy = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")
    copied = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    kept = [c for c in rows.columns if c != text]
    return out.select(*kept, *COUNTS, base.alias("base_failed"), (base | noisy | copied).alias("rule_failed"))


def host_verdicts(judged: DataFrame, host: str = "host", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, n, failed, rate, rejected)`` from documents with ``rule_failed``.

    The prior is the beta law whose mean is the pooled failure rate and whose
    spread is the variance between hosts beyond what chance alone would give.
    Without such variance (or with one host) the prior is as strong as allowed.
    Documents without a host belong to none and are not counted.
    """
    hosts = (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    )
    total = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n").cast("double").alias("n_all"),
        F.sum("failed").cast("double").alias("failed_all"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n_squares"),
        F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("rate_squares"),
    )
    total = total.selectExpr(
        "failed_all / n_all AS mean",
        "rate_squares - failed_all * failed_all / n_all AS spread",
        "(failed_all / n_all) * (1 - failed_all / n_all) AS chance",
        "hosts - 1 AS free",
        "n_all - n_squares / n_all AS scale",
    )
    overlap = F.expr("try_divide(spread - chance * free, chance * (scale - free))")
    strength = F.least(F.lit(MAX_PRIOR), F.coalesce(F.when(overlap > 0, 1 / overlap - 1), F.lit(MAX_PRIOR)))
    prior = total.select("mean", F.greatest(F.lit(0.0), strength).alias("strength"))
    # one row, so each task gets it whole
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    rated = hosts.join(F.broadcast(prior)).select("host", "n", "failed", rate.alias("rate"))
    return rated.withColumn("rejected", F.col("rate") > max_rate)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host)``.

    One row per document, repeated rows included. Texts are read once; only
    the counts are written between the two passes. The rejected hosts are
    written too, so that the join with them knows their size: few are sent to
    every task, many meet the counts by host, where a hot one can be split.
    Other columns are not looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    judged = materialize(rule_counts(rows), "rule-counts")
    bad = materialize(host_verdicts(judged).where("rejected").select(F.col("host").alias("bad_host")), "bad-hosts")
    joined = judged.join(bad, judged.host == bad.bad_host, "left")
    kept = ~F.col("base_failed") & F.col("bad_host").isNull()
    return joined.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "host")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    judged = rule_counts(rows).select("host", "rule_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row"))
    judged = materialize(judged, "rule-rows")
    bad = materialize(host_verdicts(judged).where("rejected").select(F.col("host").alias("bad_host")), "bad-hosts")
    good = judged.where(F.col("row").isNotNull())
    return good.join(bad, good.host == bad.bad_host, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host")


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), grams AS (
  SELECT rid, unnest(range(0, len(words) - 2)) AS i, words FROM docs WHERE len(words) >= 3
), named AS (
  SELECT rid, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS gram FROM grams
), found AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS times FROM named
), starts AS (
  SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS covered FROM found WHERE times > 1
), repeats AS (
  SELECT rid, sum(covered)::BIGINT AS n_repeat_words FROM starts GROUP BY rid
), lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs
), counted AS (
  SELECT d.rid, d.doc_id, d.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs d JOIN lines USING (rid) LEFT JOIN repeats USING (rid)
), based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
), ruled AS (
  SELECT *, base_failed OR 100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars
    OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines AS rule_failed FROM based
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (rule_failed)::DOUBLE AS failed
  FROM ruled WHERE source IS NOT NULL GROUP BY source
), total AS (
  SELECT count(*) - 1 AS free, sum(n) AS n_all, sum(failed) AS f_all, sum(n * n) AS nn, sum(failed * failed / n) AS ff FROM hosts
), parts AS (
  SELECT f_all / n_all AS mean, ff - f_all * f_all / n_all AS spread, (f_all / n_all) * (1 - f_all / n_all) AS chance,
    free, n_all - nn / n_all AS scale FROM total
), lapped AS (
  SELECT mean, (spread - chance * free) / nullif(chance * (scale - free), 0) AS overlap FROM parts
), prior AS (
  SELECT mean, greatest(0, least({MAX_PRIOR}, coalesce(CASE WHEN overlap > 0 THEN 1 / overlap - 1 END, {MAX_PRIOR}))) AS strength
  FROM lapped
), bad AS (
  SELECT source FROM hosts, prior WHERE (failed + mean * strength) / (n + strength) > {MAX_HOST_RATE}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM ruled
"""
