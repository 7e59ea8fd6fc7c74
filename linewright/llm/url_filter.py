"""URL filters: rules by host and path, and block decisions that reach aliases.

Each url gets the longest rule that fits its host and path. Pages that redirect
to each other or name each other as canonical are one group, found as connected
components. If a group holds a blocked url, its urls without a rule of their
own are blocked too; an explicit allow always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.components import connected_components
from linewright.session import materialize

#: (verdict, rule): a host, with its subdomains, and the start of a path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_BASE = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; without one empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """The url with scheme and host in lower case and without a fragment: urls with one key are one page."""
    whole = F.regexp_replace(url, r"(?s)#.*$", "")
    start = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*", 0)
    lower = F.translate(start, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(lower, F.substring(whole, F.length(start) + 1, F.length(whole)))


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    dots = F.array(F.lit("."), F.lit(".."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)),
        start,
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1)))
        .when(part == ".", done)
        .otherwise(F.array_append(done, part)),
    )
    kept = F.when(F.array_contains(dots, last), F.array_append(kept, F.lit(""))).otherwise(kept)
    plain = ~path.rlike(r"(?:^|/)\.\.?(?:/|$)")
    return F.when(plain, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def resolved(base: Column, target: Column) -> Column:
    """The url that a link names on a page with the url ``base``; null if it names none, or only a place on the page."""
    start = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path, query = path_of(base), F.regexp_extract(target, r"(?s)^[^?]*(\?.*)$", 1)
    target_path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    merged = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), target_path)
    own_host = F.regexp_extract(target, r"(?s)^(?:[^:/?#]+:)?//[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"^[^:/?#]+:", 0)
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(own_host, _without_dots(path_of(target)), query))
        .when(target.rlike(_SCHEME), None)
        .when(start == "", None)
        .when(target.startswith("//"), F.concat(scheme, own_host, _without_dots(path_of(F.concat(F.lit("x:"), target))), query))
        .when(target.startswith("/"), F.concat(start, _without_dots(target_path), query))
        .when(target.startswith("?"), F.concat(start, path, target))
        .otherwise(F.concat(start, _without_dots(merged), query))
    )


def _href(tag: Column) -> Column:
    href = F.concat(*[F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)])
    return F.replace(F.btrim(href, F.lit(" \t\n\f\r")), F.lit("&amp;"), F.lit("&"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, target)`` for canonical links and refresh redirects in the markup.

    Relative targets are resolved against the first ``<base href>``, else the
    page's own url, and lose their dot segments; a target with a scheme but no
    ``://``, or that is only a fragment, names no url and is left out.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(_TAG), 0)
    tags = F.filter(tags, lambda tag: tag.rlike(_CANONICAL) | tag.rlike(_REFRESH))
    found = pages.where(F.col(url).isNotNull() & F.col(html).rlike(f"{_CANONICAL}|{_REFRESH}"))
    found = found.select(F.col(url).alias("url"), _href(F.regexp_extract(html, _BASE, 0)).alias("base"), F.explode(tags).alias("tag"))
    refresh = F.replace(F.regexp_extract("tag", _TARGET, 1), F.lit("&amp;"), F.lit("&"))
    target = F.when(F.col("tag").rlike(_CANONICAL), _href(F.col("tag"))).otherwise(refresh)
    # written between the steps, as Catalyst would set one long expression into the other many times over
    found = materialize(found.select("url", "base", target.alias("target")), "raw-links")
    found = materialize(found.select("url", F.coalesce(resolved(F.col("url"), F.col("base")), "url").alias("base"), "target"), "based-links")
    found = materialize(found.select("url", resolved(F.col("base"), F.col("target")).alias("target")), "resolved-links")
    return found.where(F.col("target").isNotNull() & (alias_key(F.col("target")) != alias_key(F.col("url"))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(verdict, rule, rule_host, rule_path)``; the host ends at the first slash."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])))
    host = F.substring_index("rule", "/", 1)
    return rows.select("verdict", "rule", F.lower(host).alias("rule_host"), F.expr("substr(rule, instr(rule, '/'))").alias("rule_path"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(rule_for, fits)``: the rules of each host that has any, its own and its parent domains', best first.

    A host is looked up under each of its parent domains by equality. The
    longest rule is best, of two as long the one with the longer host, then block.
    """
    labels = F.split("host", r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    asked = hosts.select("host").where("host <> ''").distinct().select("host", F.explode(parents).alias("parent"))
    fits = asked.join(rules, asked.parent == rules.rule_host)
    fit = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("n_host"), "verdict", "rule", "rule_path")
    best_first = F.sort_array(F.collect_list(fit), asc=False)
    return fits.groupBy(F.col("host").alias("rule_for")).agg(best_first.alias("fits"))


def with_rule(places: DataFrame, by_host: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``verdict`` to rows with ``host`` and ``path``; null where no rule fits."""
    path = F.col("path")
    best = F.get(F.filter("fits", lambda r: path.startswith(r["rule_path"])), F.lit(0))
    joined = places.join(by_host, places.host == by_host.rule_for, "left").withColumn("best", best)
    return joined.select(*places.columns, "best.rule", "best.verdict")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    links: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    default: str = "allow",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per page, repeated rows included.

    ``links`` is an optional table ``(url, target)`` of more redirects, such as
    those seen while fetching. A target that is no page itself still ties its
    group together, and its own rule counts. Urls that differ only in the letter
    case of scheme and host or in the fragment are aliases too. A null url, or
    one without ``://``, has an empty host and path, no rule and the default verdict. Other
    columns are not looked at. An empty table gives no rows.
    """
    found = page_links(pages, url, html)
    if links is not None:
        found = found.unionByName(links.select("url", "target"))
    found = found.select(alias_key(F.col("url")).alias("url"), alias_key(F.col("target")).alias("target"))
    found = materialize(found.distinct(), "url-links")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = found.select("url").union(found.select("target")).where("url IS NOT NULL").distinct()
    named = named.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_host = materialize(rules_by_host(rows.select("host").union(named.select("host")), rules), "host-rules")

    groups = connected_components(found, "url", "target").withColumnRenamed("node", "url")
    decided = with_rule(named, by_host).join(groups, "url")
    bad = decided.where("verdict = 'block'").select("component").distinct()
    spread = decided.join(bad, "component", "left_semi").select(F.col("url").alias("bad_url")).distinct()
    spread = materialize(spread, "bad-urls")

    ruled = with_rule(rows, by_host)
    ruled = ruled.join(spread, alias_key(ruled.url) == spread.bad_url, "left")
    verdict = F.coalesce("verdict", F.when(F.col("bad_url").isNotNull(), F.lit("block")), F.lit(default))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


_RULES = ", ".join(f"('{v}', '{r}')" for v, r in RULES)
SQL = rf"""
WITH RECURSIVE rules AS (
  SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path
  FROM (VALUES {_RULES}) AS r(verdict, rule)
), placed AS (
  SELECT row_number() OVER () AS rid, page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM placed WHERE url IS NOT NULL
), links AS (
  SELECT DISTINCT url, target FROM (
    SELECT url, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
      THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]*)', 1)
      WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')
      THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1) END AS target FROM tags)
  WHERE target LIKE '%://%' AND target <> url
), named AS (
  SELECT DISTINCT url FROM (SELECT url FROM links UNION ALL SELECT target FROM links)
), reach AS (
  SELECT url, url AS other FROM named
  UNION SELECT r.url, CASE WHEN l.url = r.other THEN l.target ELSE l.url END
  FROM reach r JOIN links l ON l.url = r.other OR l.target = r.other
), urls AS (
  SELECT rid, url, host, path FROM placed
  UNION ALL SELECT -row_number() OVER (), url,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) FROM named
), ruled AS (
  SELECT u.rid, u.url, u.host, u.path, max_by({{'rule': r.rule, 'verdict': r.verdict}}, length(r.rule)) AS best
  FROM urls u JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
  GROUP BY u.rid, u.url, u.host, u.path
), bad AS (
  SELECT DISTINCT reach.url FROM reach JOIN ruled ON ruled.url = reach.other WHERE best.verdict = 'block'
)
SELECT p.page_id, p.host, p.path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN bad.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM placed p LEFT JOIN ruled USING (rid) LEFT JOIN bad ON bad.url = p.url
"""
