"""Column expressions over product text.

Java regular expressions are ASCII-only by default; every pattern here carries
``(?U)`` so that Cyrillic letters count as word characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from linewright.functions import dictionaries as D

# --- fixed values: the patterns of the reference behavior ---
NUMBER = r"(?U)\d+(?:\.\d+)?"
DIMENSION = (
    r"(?U)(\d+(?:[.,]\d+)?)\s*[xхXХ*×]\s*(\d+(?:[.,]\d+)?)(?:\s*[xхXХ*×]\s*(\d+(?:[.,]\d+)?))?"
)
ARTICLE_PREFIXED = r"(?iu)^(?:арт\.?|art\.?)(\d{6,})$"
ARTICLE_PLAIN = r"(?U)^\d{6,}$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
# --- end of fixed values ---


@pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def java_replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def bounded(key: str) -> str:
    """Pattern for ``key`` standing on its own, any letter case."""
    return r"(?iuU)(?<!\w)" + re.escape(key) + r"(?!\w)"


def quote_pattern(text: Column) -> Column:
    """Escape a text column for use inside a pattern."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}_])", r"\\$1")


def words(text: Column) -> Column:
    """Whitespace-separated parts, empty ones left out."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _entries(rows: list[dict[str, str]]) -> Column:
    """A dictionary as one constant array of structs; Catalyst folds it at planning time."""
    fields = ", ".join(f"{name}: string" for name in rows[0])
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{fields}>>")


def _letter_runs(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


def _by_run(rows: list[dict[str, str]]) -> dict[str, list[dict[str, str]]]:
    """Entries to try for each run of letters a text holds.

    A key can only match where its first run of letters stands as a whole run,
    in the text or in the target of an entry applied before. So each run leads
    to its own entries and to those that their targets can set off.
    """
    first = [(_letter_runs(row["key"]) or [""])[0] for row in rows]
    starts: dict[str, set[int]] = {}
    for i, run in enumerate(first):
        starts.setdefault(run, set()).add(i)
    out = {}
    for run in starts:
        found, open_ = set(), {run}
        while open_:
            new = set().union(*(starts.get(r, set()) for r in open_)) - found
            found |= new
            open_ = {r for i in new for r in _letter_runs(rows[i]["target"])}
        out[run] = [{"ord": f"{i:04d}", **rows[i]} for i in sorted(found)]
    return out


def _fold(text: Column, rows: list[dict[str, str]], start: Column, step, finish=None) -> Column:
    """Fold the dictionary entries that can matter for a text over ``start``, in order.

    Of some hundred entries a text usually needs none or a few; they are looked
    up by the letter runs of the text in one constant map.
    """
    by_run = _by_run(rows)
    fields = ", ".join(f"{name}: string" for name in ["ord", *rows[0]])
    table = F.from_json(
        F.lit(json.dumps(by_run, ensure_ascii=False)), f"map<string, array<struct<{fields}>>>"
    )
    known = F.from_json(F.lit(json.dumps(sorted(by_run), ensure_ascii=False)), "array<string>")
    runs = F.concat(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), F.array(F.lit("")))
    entries = F.flatten(F.transform(F.array_intersect(runs, known), lambda r: table[r]))
    ordered = F.array_sort(F.array_distinct(entries))
    return F.aggregate(ordered, start, step, finish)


def replace_bounded(text: Column, table: dict[str, str]) -> Column:
    """Replace dictionary keys that stand alone, longest first, one after another."""
    rows = [
        {"key": key.lower(), "pattern": bounded(key), "target": java_replacement(target)}
        for key, target in D.longest_first(table)
    ]
    return _fold(
        text, rows, text, lambda t, e: F.regexp_replace(t, e["pattern"], e["target"])
    )


def clean_unicode(text: Column) -> Column:
    # ASCII stays as it is; only other texts are sent to Python
    text = F.lower(F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text))
    text = F.regexp_replace(text, CONTROL, "")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    # dashes become '-', every quote mark goes
    return F.translate(text, "–—‐«»\"'", "---")


def multiplication_sign(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<=\d)\s*[хХxX×]\s*(?=\d)", "x")


def repair_scripts(text: Column) -> Column:
    """Bring tokens that mix Latin and Cyrillic letters into the script of the majority."""

    def repair(token: Column) -> Column:
        cyrillic = F.regexp_count(token, F.lit(r"[Ѐ-ӿ]"))
        latin = F.regexp_count(token, F.lit(r"[a-zA-Z]"))
        return (
            F.when((cyrillic == 0) | (latin == 0), token)
            .when(cyrillic >= latin, F.translate(token, D.CONFUSABLE_LATIN, D.CONFUSABLE_CYRILLIC))
            .otherwise(F.translate(token, D.CONFUSABLE_CYRILLIC, D.CONFUSABLE_LATIN))
        )

    mixed = text.rlike(r"[Ѐ-ӿ]") & text.rlike(r"[a-zA-Z]")
    return F.when(mixed, F.array_join(F.transform(words(text), repair), " ")).otherwise(
        F.array_join(words(text), " ")
    )


def last_dimensions(text: Column) -> Column:
    """Parts of the last ``a x b [x c]`` group, decimal commas as dots."""
    hit = F.try_element_at(F.regexp_extract_all(text, F.lit(DIMENSION), F.lit(0)), F.lit(-1))
    parts = F.array(*[F.regexp_extract(hit, DIMENSION, i) for i in (1, 2, 3)])
    parts = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.replace(p, F.lit(","), F.lit(".")))
    return F.when(hit.isNull(), F.array().cast("array<string>")).otherwise(parts)


def dot_decimals(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\d),(\d)", "$1.$2")


def numbers(text: Column) -> Column:
    """All numbers in reading order, repeats kept; empty for missing text."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: n.try_cast("double")
    )
    return F.coalesce(F.filter(found, lambda n: n.isNotNull()), F.array().cast("array<double>"))


def canonical_units(text: Column, table: dict[str, str] = D.UNIT_ALIASES) -> Column:
    """``struct(text, unit)``: units in canonical form and the first selling unit found.

    Pass one rewrites, per key, the first occurrence right after a digit; pass
    two rewrites every occurrence that is a word of its own.
    """
    rows = []
    for key, target in D.longest_first(table):
        selling = "" if target in D.DIMENSION_UNITS else target
        rows.append(
            {
                "key": key.lower(),
                "pattern": r"(?siuU)^(.*?)(?<=\d)\s*" + re.escape(key) + r"(?=\s|$|[,;.])",
                "target": "$1 " + java_replacement(target),
                "selling": selling,
            }
        )
    for key, target in D.longest_first(table):
        selling = "" if target in D.DIMENSION_UNITS else target
        rows.append(
            {
                "key": key.lower(),
                "pattern": r"(?iuU)\b" + re.escape(key) + r"\b",
                "target": java_replacement(target),
                "selling": selling,
            }
        )

    def step(state: Column, entry: Column) -> Column:
        def after(new: Column) -> Column:
            # a unit already written in its canonical form is found, but changes nothing
            same = (entry["key"] == entry["selling"]) & F.rlike(state["text"], entry["pattern"])
            unit = F.when(state["unit"] == "", entry["selling"]).otherwise(state["unit"])
            return F.when(
                (new != state["text"]) | same, F.struct(new.alias("text"), unit.alias("unit"))
            ).otherwise(state)

        return F.when(
            F.contains(F.lower(state["text"]), entry["key"]),
            let(F.regexp_replace(state["text"], entry["pattern"], entry["target"]), after),
        ).otherwise(state)

    start = F.struct(text.alias("text"), F.lit("").alias("unit"))
    return _fold(
        text,
        rows,
        start,
        step,
        lambda s: F.struct(
            F.trim(F.regexp_replace(s["text"], r"(?U)\s+", " ")).alias("text"),
            F.nullif(s["unit"], F.lit("")).alias("unit"),
        ),
    )


def first_packaging(text: Column, keywords: list[str] = D.PACKAGING_KEYWORDS) -> Column:
    """First keyword, in list order, that stands alone in the text."""
    entries = _entries([{"key": k, "low": k.lower(), "pattern": bounded(k.lower())} for k in keywords])

    def first(low: Column) -> Column:
        hits = F.filter(entries, lambda e: F.contains(low, e["low"]) & F.rlike(low, e["pattern"]))
        return F.get(hits, F.lit(0))["key"]

    return let(F.lower(text), first)


def known_brand(text: Column, table: dict[str, str] = D.BRAND_ALIASES) -> Column:
    """``struct(key, target)`` of the longest alias found anywhere in the text."""
    entries = _entries(
        [{"key": k.lower(), "target": v} for k, v in D.longest_first(table)]
    )
    return let(
        F.lower(text), lambda low: F.get(F.filter(entries, lambda e: F.contains(low, e["key"])), F.lit(0))
    )


def drop_words(text: Column, stopwords: list[str] = D.STOPWORDS) -> Column:
    listed = F.array(*[F.lit(w.lower()) for w in stopwords])
    kept = F.filter(words(text), lambda w: ~F.array_contains(listed, F.lower(w)))
    return F.array_join(kept, " ")


def tokens(text: Column) -> Column:
    return words(F.regexp_replace(text, r"[,;:!?()\[\]{}]", " "))


def article_code(token_list: Column) -> Column:
    """Digits after an article prefix win over the first plain run of six or more digits."""
    prefixed = F.filter(token_list, lambda t: t.rlike(ARTICLE_PREFIXED))
    plain = F.filter(token_list, lambda t: t.rlike(ARTICLE_PLAIN))
    return F.coalesce(
        F.regexp_extract(F.get(prefixed, F.lit(0)), ARTICLE_PREFIXED, 1), F.get(plain, F.lit(0))
    )


def packaging_token(token_list: Column, keywords: list[str] = D.PACKAGING_KEYWORDS) -> Column:
    listed = F.array(*[F.lit(k.lower()) for k in keywords])
    return F.lower(F.get(F.filter(token_list, lambda t: F.array_contains(listed, F.lower(t))), F.lit(0)))


def leading_word(token_list: Column) -> Column:
    """First purely alphabetic token longer than three characters."""
    return F.get(
        F.filter(token_list, lambda t: (F.length(t) > 3) & t.rlike(r"^\p{L}+$")), F.lit(0)
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
