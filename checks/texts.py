"""B and I: normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import query, table, text
from linewright.functions import dictionaries as D
from linewright.functions import text as T
from linewright.operators import normalize as N
from linewright.plans.batch_match import MatchInputs, prepare_items
from linewright.session import spread

CLEAN = """trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'), '[\\s\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g'))"""


@query("B1_unicode_cleanup", f"""
SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace({CLEAN}, '–', '-'), '—', '-'), '‐', '-'), '«', ''), '»', ''), '"', ''), chr(39), '') AS clean FROM conversations""")
def b1(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.clean_unicode(F.col("text")).alias("clean"))


@query("B2_multiplier_sign", """
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS VARCHAR) || 'x' || CAST(l_quantity AS BIGINT) || ' x ab' AS fixed FROM lineitem""")
def b2(spark, sf):
    sign = F.element_at(F.array(F.lit("х"), F.lit(" Х "), F.lit(" ×"), F.lit("X ")), (F.col("l_partkey") % 4 + 1).cast("int"))
    size = F.concat(text("l_linenumber"), sign, F.col("l_quantity").cast("bigint").cast("string"), F.lit(" x ab"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", T.multiplication_sign(size).alias("fixed"))


# Latin names with some letters typed on a Cyrillic keyboard
@query("B3_script_repair", """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest([1, 2]) AS n FROM part),
m AS (SELECT *, translate(word, 'aeo', 'аео') AS mixed FROM w),
c AS (SELECT *, length(regexp_replace(mixed, '[^Ѐ-ӿ]', '', 'g')) AS cyr, length(regexp_replace(mixed, '[^a-zA-Z]', '', 'g')) AS lat FROM m)
SELECT p_partkey, string_agg(CASE WHEN cyr = 0 OR lat = 0 THEN mixed WHEN cyr >= lat THEN translate(mixed, 'aceopxykhtbm', 'асеорхукнтвм') ELSE translate(mixed, 'асеорхукнтвм', 'aceopxykhtbm') END, ' ' ORDER BY n) AS repaired
FROM c GROUP BY 1""")
def b3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.repair_scripts(F.translate("p_name", "aeo", "аео")).alias("repaired"))



def _sized(spark, sf):
    """Part names with one or two size groups."""
    n, q = text("l_linenumber"), F.regexp_replace(text("l_quantity"), r"\.0$", "")
    line = F.concat(F.lit("плита 1х2,5 "), n, F.lit(" x "), q, F.lit(",5"), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("*"), n)).otherwise(""), F.lit(" бел."))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))


@query("B4_dimensions", """
SELECT l_orderkey, l_partkey, l_linenumber || '|' || CAST(l_quantity AS BIGINT) || '.5' || CASE WHEN l_tax > 0.04 THEN '|' || l_linenumber ELSE '' END AS dims FROM lineitem""")
def b4(spark, sf):
    return _sized(spark, sf).select("l_orderkey", "l_partkey", F.array_join(T.last_dimensions(F.col("line")), "|").alias("dims"))


@query("B5_numbers", """
SELECT doc_id, CAST(len(ns) AS BIGINT) AS n, round(coalesce(list_sum(list_transform(ns, lambda x: least(CAST(x AS DOUBLE), 1e6))), 0), 3) AS total
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(\\d),(\\d)', '\\1.\\2', 'g'), '\\d+(?:\\.\\d+)?') AS ns FROM documents)""")
def b5(spark, sf):
    found = T.numbers(T.dot_decimals(F.col("text")))
    total = F.aggregate("ns", F.lit(0.0), lambda acc, x: acc + F.least(x, F.lit(1e6)))
    return table(spark, sf, "documents").select("doc_id", found.alias("ns")).select("doc_id", F.size("ns").cast("bigint").alias("n"), F.round(total, 3).alias("total"))


UNIT_LINES = ["труба {n} мм", "клей {n} кг. 2 кг", "провод {n}м бухта", "дюбель {n} шт", "пена {n} мл в упак"]
UNIT_WANTED = [("труба {n} mm", None), ("клей {n} kg. 2 kg", "kg"), ("провод {n} m бухта", "m"), ("дюбель {n} pcs", "pcs"), ("пена {n} ml v упак", "ml")]


def _cases(columns):
    lines = [c.replace("{n}", "' || (s_suppkey + 2) || '") for c in columns]
    return "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{line}'" for i, line in enumerate(lines)) + " END"


@query("B6_B7_units", f"""
SELECT s_suppkey, {_cases([t for t, _ in UNIT_WANTED])} AS text, CASE s_suppkey % 5 WHEN 1 THEN 'kg' WHEN 2 THEN 'm' WHEN 3 THEN 'pcs' WHEN 4 THEN 'ml' END AS unit FROM supplier""")
def b6(spark, sf):
    pick = F.element_at(F.array(*[F.lit(line) for line in UNIT_LINES]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    line = F.replace(pick, F.lit("{n}"), (F.col("s_suppkey") + 2).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", T.canonical_units(line).alias("u")).select("s_suppkey", "u.text", "u.unit")


@query("B8_abbreviations", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'труба полиэтилен низкого давления ' || p_name WHEN 'SMALL' THEN 'провод ввг нержавеющая сталь ' || p_name ELSE 'пндх стст ' || p_name END AS text FROM part""")
def b8(spark, sf):
    kind = F.col("p_type")
    line = F.concat(F.when(kind == "PROMO", "труба ПНД ").when(kind == "SMALL", "ввг нерж. ").otherwise("пндх стст "), "p_name")
    return table(spark, sf, "part").select("p_partkey", T.replace_bounded(line, D.ABBREVIATIONS).alias("text"))


@query("B9_packaging", """
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN p_name || ' упаковка банка' WHEN 'SMALL' THEN 'рулон ' || p_name ELSE 'банан ' || p_name END AS text,
  CASE p_type WHEN 'PROMO' THEN 'упаковка' WHEN 'SMALL' THEN 'рулон' END AS packaging FROM part""")
def b9(spark, sf):
    kind = F.col("p_type")
    line = F.when(kind == "PROMO", F.concat("p_name", F.lit(" уп. бан."))).when(kind == "SMALL", F.concat(F.lit("рул "), "p_name")).otherwise(F.concat(F.lit("банан "), "p_name"))
    rows = table(spark, sf, "part").select("p_partkey", line.alias("n_text"))
    return N.normalize_packaging(rows).select("p_partkey", F.col("n_text").alias("text"), F.col("n_packaging").alias("packaging"))


@query("B10_brand_detection", """
SELECT p_partkey, 'maker ' || substr(p_brand, 7) AS brand, 'a maker ' || substr(p_brand, 7) || ' ' || p_name AS text FROM part""")
def b10(spark, sf):
    makers = {f"brand#{i}": f"maker {i}" for i in range(1, 100)}
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("A "), "p_brand", F.lit(" "), "p_name").alias("n_text"))
    return N.detect_brand(rows, makers).select("p_partkey", F.col("n_brand").alias("brand"), F.col("n_text").alias("text"))


SHORT = "['the', 'of', 'de', 'la', 'und', 'in']"


@query("B11_stopwords", f"""
SELECT doc_id, md5(list_aggregate(list_filter(string_split_regex(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+'), lambda w: w <> '' AND NOT list_contains({SHORT}, lower(w))), 'string_agg', ' ')) AS digest FROM documents""")
def b11(spark, sf):
    kept = T.drop_words(F.col("text"), ["the", "of", "de", "la", "und", "in"])
    return table(spark, sf, "documents").select("doc_id", F.md5(kept).alias("digest"))


@query("B12_tokens", """
SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, md5(list_aggregate(ts, 'string_agg', ' ')) AS digest FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[,;:!?()\\[\\]{}]', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+'), lambda w: w <> '') AS ts FROM documents)""")
def b12(spark, sf):
    rows = N.tokenize(table(spark, sf, "documents").withColumn("n_text", F.col("text")))
    return rows.select("doc_id", F.size("n_tokens").cast("bigint").alias("n"), F.md5("n_text").alias("digest"))


@query("B13_pipeline_parts", """
SELECT p_partkey, lower(p_name) || ' ' || p_size || ' ' || lower(p_brand) AS text, CAST(p_size AS VARCHAR) || '|' || substr(p_brand, 7) AS numbers FROM part""")
def b13(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.upper("p_name"), text("p_size"), F.concat(F.lit("("), "p_brand", F.lit(")"))).alias("raw_text"))
    out = N.normalize(rows)
    numbers = F.array_join(F.transform("n_numbers", lambda n: n.cast("bigint").cast("string")), "|")
    return out.select("p_partkey", F.col("n_text").alias("text"), numbers.alias("numbers"))


@query("B13_pipeline_documents")
def b13_documents(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw_text"))
    return N.normalize(spread(lines, "doc_id", "line")).select("doc_id", "line", "n_text", "n_brand", "n_unit", F.size("n_numbers").alias("numbers"))


# brands as synonyms: global ones, and own words of some suppliers
SYNONYMS = """syn AS (SELECT p_partkey AS synonym_id, NULL AS supplier_id, string_split(p_name, ' ')[2] AS source, 'new ' || string_split(p_name, ' ')[2] AS target, p_size <> 7 AS is_active FROM part
UNION ALL SELECT p_partkey + 1000000, 'S' || (p_partkey % 10), string_split(p_name, ' ')[2], 'own' || (p_partkey % 10) || ' ' || string_split(p_name, ' ')[2], p_size < 30 FROM part),
entry AS (SELECT supplier_id, source, arg_max(target, synonym_id) AS target FROM syn WHERE is_active GROUP BY 1, 2)"""


def _synonyms(spark, sf):
    part = table(spark, sf, "part")
    noun = F.element_at(F.split("p_name", " "), 2)
    shared = part.select(
        F.col("p_partkey").alias("synonym_id"), F.lit(None).cast("string").alias("supplier_id"), noun.alias("normalized_source_text"),
        F.concat(F.lit("new "), noun).alias("target_text"), (F.col("p_size") != 7).alias("is_active"),
    )
    digit = (F.col("p_partkey") % 10).cast("string")
    own = part.select(
        (F.col("p_partkey") + 1000000).alias("synonym_id"), F.concat(F.lit("S"), digit).alias("supplier_id"), noun.alias("normalized_source_text"),
        F.concat(F.lit("own"), digit, F.lit(" "), noun).alias("target_text"), (F.col("p_size") < 30).alias("is_active"),
    )
    return shared.union(own)


@query("B14_synonym_map", f"""
WITH {SYNONYMS} SELECT coalesce(s.source, g.source) AS source, coalesce(s.target, g.target) AS target
FROM (SELECT * FROM entry WHERE supplier_id IS NULL) g FULL JOIN (SELECT * FROM entry WHERE supplier_id = 'S3') s ON s.source = g.source""")
def b14(spark, sf):
    return N.synonym_map(_synonyms(spark, sf), "S3")


@query("B15_apply_synonyms", f"""
WITH {SYNONYMS}, l AS (SELECT l_orderkey, l_partkey, l_suppkey, 'S' || l_suppkey AS supplier_id, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_partkey, a || ' ' || coalesce(s.target, g.target, b) AS text, coalesce(b || '->' || coalesce(s.target, g.target), '') AS applied
FROM l LEFT JOIN entry s ON s.supplier_id = l.supplier_id AND s.source = b LEFT JOIN entry g ON g.supplier_id IS NULL AND g.source = b""")
def b15(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("n_text"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.concat(F.lit("S"), text("l_suppkey")).alias("supplier_id")).join(part, "l_partkey")
    return N.apply_synonyms(lines, _synonyms(spark, sf)).select("l_orderkey", "l_partkey", F.col("n_text").alias("text"), F.array_join("n_synonyms", "|").alias("applied"))


def _articles(spark, sf):
    l = table(spark, sf, "lineitem")
    code = F.lpad(text("l_partkey"), 6, "0")
    kind = F.col("l_returnflag")
    line = F.when(kind == "A", F.concat(F.lit("Насос 999999 арт."), code)).when(kind == "R", F.concat(F.lit("болт 12345 "), code, F.lit(" рулон"))).otherwise("Болт М12 1234 Банка")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", line.alias("raw_text"))


@query("B16_article_code", """
SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag <> 'N' THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0') END AS article FROM lineitem""")
def b16(spark, sf):
    tokens = T.tokens(F.lower("raw_text"))
    return _articles(spark, sf).select("l_orderkey", "l_partkey", T.article_code(tokens).alias("article"))


@query("B17_packaging_token", """
SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'R' THEN 'рулон' WHEN 'N' THEN 'банка' END AS packaging FROM lineitem""")
def b17(spark, sf):
    return _articles(spark, sf).select("l_orderkey", "l_partkey", T.packaging_token(T.tokens(F.col("raw_text"))).alias("packaging"))


@query("B18_candidate_numbers", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS BIGINT) AS n FROM documents""")
def b18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.numbers(F.col("text"))).cast("bigint").alias("n"))


@query("B19_decompose", """
SELECT p_partkey, lower(p_name) || ' ' || p_size || ' ' || lower(p_brand) AS normalized_text, 4 AS tokens, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 3)[1] AS category_word FROM part""")
def b19(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", text("p_size"), "p_brand").alias("raw_text"))
    out = N.decompose(rows)
    return out.select("p_partkey", "normalized_text", F.size("tokens").alias("tokens"), "category_word")


@query("B20_batch_normalization", """
SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'насос 999999 арт.' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') WHEN 'R' THEN 'болт 12345 ' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || ' рулон' ELSE 'болт м12 1234 банка' END AS text,
  CASE WHEN l_returnflag <> 'N' THEN lpad(CAST(l_partkey AS VARCHAR), 6, '0') END AS article, CASE l_returnflag WHEN 'R' THEN 'рулон' WHEN 'N' THEN 'банка' END AS packaging FROM lineitem""")
def b20(spark, sf):
    rows = _articles(spark, sf)
    texts = prepare_items(rows.select("raw_text").distinct(), MatchInputs(rows))
    return rows.join(texts, "raw_text").select("l_orderkey", "l_partkey", F.col("n_text").alias("text"), "article", "packaging")


@query("I1_custom_steps", "SELECT p_partkey, upper(p_name) || '!' AS text FROM part")
def i1(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("raw_text"))
    loud = lambda df: df.withColumn("n_text", F.concat(F.upper("n_text"), F.lit("!")))
    return N.normalize(rows, steps=[N.clean_unicode, N.tokenize, loud]).select("p_partkey", F.col("n_text").alias("text"))
