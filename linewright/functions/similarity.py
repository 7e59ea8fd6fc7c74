"""Similarity measures as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from linewright.functions.text import let


def alphanumeric_words(text: Column) -> Column:
    return F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""
    )


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(alphanumeric_words(text), of_word)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two arrays without repeats; 0 when both are empty."""

    def share(shared: Column) -> Column:
        total = F.size(left) + F.size(right) - shared
        return F.when(total > 0, shared / total).otherwise(F.lit(0.0))

    return let(F.size(F.array_intersect(left, right)), share)


def lexeme_tokens(text: Column) -> Column:
    """Words and decimal numbers of a text, lowercased, in reading order."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\d+\.\d+|[\p{L}\p{N}_]+"), F.lit(0)
    )


def lexeme_positions(lexemes: Column) -> Column:
    """``map<lexeme, positions>`` of an array of lexemes; null entries keep their place."""
    placed = F.transform(lexemes, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i")))

    def grouped(sorted_: Column) -> Column:
        # after one sort the places of a lexeme are neighbours
        new = F.transform(
            sorted_, lambda p, i: F.when((i == 0) | (F.get(sorted_, i - 1)["w"] != p["w"]), i)
        )

        def cut(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(sorted_))
            return F.map_from_entries(
                F.transform(
                    starts,
                    lambda at, k: F.struct(
                        F.get(sorted_, at)["w"],
                        F.transform(F.slice(sorted_, at + 1, end(k) - at), lambda p: p["i"]),
                    ),
                )
            )

        return let(F.filter(new, lambda i: i.isNotNull()), cut)

    return let(F.sort_array(F.filter(placed, lambda p: p["w"].isNotNull())), grouped)


# weight of a plain position and the limit of sum(1/i^2), as the ranking formula has them
POSITION_WEIGHT = 0.1
INVERSE_SQUARE_LIMIT = 1.64493406685


def _closeness(distance: Column) -> Column:
    return POSITION_WEIGHT * F.sqrt(
        F.when(distance > 100, F.lit(1e-30)).otherwise(
            1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2.0))
        )
    )


def text_rank(terms: Column, positions: Column) -> Column:
    """Rank of a document for a conjunction of terms.

    With two or more distinct terms, every pair of positions of different
    terms adds its closeness, as independent evidence. A single term sums
    ``0.1 / i^2`` over its occurrences.
    """
    found = F.filter(
        F.transform(terms, lambda t, i: F.struct(i.alias("i"), positions[t].alias("at"))),
        lambda x: x["at"].isNotNull(),
    )
    flat = F.flatten(
        F.transform(
            found, lambda x: F.transform(x["at"], lambda p: F.struct(x["i"].alias("i"), p.alias("p")))
        )
    )

    def missed(flat: Column) -> Column:
        return F.aggregate(
            flat,
            F.lit(1.0),
            lambda acc, x: F.aggregate(
                flat,
                acc,
                lambda inner, y: F.when(
                    (y["i"] < x["i"]) & (y["p"] != x["p"]),
                    inner * (1.0 - _closeness(F.abs(x["p"] - y["p"]).cast("double"))),
                ).otherwise(inner),
            ),
        )

    def single(flat: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(1), F.size(flat)),
            F.lit(0.0),
            lambda acc, j: acc + POSITION_WEIGHT / (j * j).cast("double"),
        )
        return total / INVERSE_SQUARE_LIMIT

    return let(
        flat,
        lambda flat: F.when(F.size(flat) == 0, F.lit(0.0))
        .when(F.size(terms) == 1, single(flat))
        .when(F.size(flat) == 1, F.lit(0.0))
        .otherwise(1.0 - missed(flat)),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; null when a length differs or a norm is zero."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when((F.size(left) == F.size(right)) & (norm > 0), dot(left, right) / norm)


def _common_subsequence(a: str, b: str) -> int:
    # one machine-word style pass: bit i of `row` is 0 where the length grows at a[i]
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@pandas_udf(DoubleType())
def _edit_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(left, right):
        a, b = pair
        if a is None or b is None:
            out.append(None)
            continue
        if pair not in seen:
            total = len(a) + len(b)
            seen[pair] = 2.0 * _common_subsequence(a, b) / total if total else 1.0
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def edit_ratio(left: Column, right: Column) -> Column:
    """Insert/delete similarity ``2 * LCS / (m + n)``, in 0..1."""
    return _edit_ratio(left, right)


def _without(values: Column, index: Column) -> Column:
    return F.concat(
        F.slice(values, F.lit(1), index - 1), F.slice(values, index + 1, F.size(values))
    )


def _near(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return (gap <= 0.1) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= 0.15)


def number_signature(query: Column, candidate: Column) -> Column:
    """``struct(matched, score, conflict)`` of two number lists.

    Equal numbers pair up first; each query number left over, in order, takes
    the first remaining candidate number within 0.1 or 15 percent.
    """
    empty = F.array().cast("array<double>")

    def equal(state: Column, number: Column) -> Column:
        at = F.array_position(state["rest"], number).cast("int")
        return F.when(
            at > 0,
            F.struct(
                _without(state["rest"], at).alias("rest"),
                state["open"].alias("open"),
                (state["matched"] + 1).alias("matched"),
            ),
        ).otherwise(
            F.struct(
                state["rest"].alias("rest"),
                F.concat(state["open"], F.array(number)).alias("open"),
                state["matched"].alias("matched"),
            )
        )

    def close(state: Column, number: Column) -> Column:
        at = F.array_position(
            F.transform(state["rest"], lambda c: _near(number, c)), F.lit(True)
        ).cast("int")
        return F.when(
            at > 0,
            F.struct(
                _without(state["rest"], at).alias("rest"),
                (state["matched"] + 1).alias("matched"),
            ),
        ).otherwise(state)

    first = F.aggregate(
        query,
        F.struct(candidate.alias("rest"), empty.alias("open"), F.lit(0).alias("matched")),
        equal,
    )
    matched = let(
        first,
        lambda s: F.aggregate(
            s["open"],
            F.struct(s["rest"].alias("rest"), s["matched"].alias("matched")),
            close,
            lambda t: t["matched"],
        ),
    )
    both = (F.size(query) > 0) & (F.size(candidate) > 0)
    return let(
        F.when(both, matched).otherwise(F.lit(0)),
        lambda m: F.struct(
            m.alias("matched"),
            F.when(both, m / (F.size(query) + F.size(candidate) - m)).otherwise(F.lit(0.0)).alias("score"),
            (both & (m == 0)).alias("conflict"),
        ),
    )
