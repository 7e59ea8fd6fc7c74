from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from linewright.llm import source_mix

DOCS = "doc_id long, source string"


def docs(spark, sizes):
    rows, at = [], 0
    for name, n in sizes.items():
        rows += [(at + i, name) for i in range(n)]
        at += n
    return spark.createDataFrame(rows, DOCS)


def natural(sizes, turn_rows, max_share):
    """Shares of turns under a ceiling, by raising the ceiling's members one at a time."""
    turns = {s: Fraction(-(-n // turn_rows)) for s, n in sizes.items()}
    cap, at_cap = max(Fraction(max_share), Fraction(1, len(turns))), set()
    while True:
        free = sum(n for s, n in turns.items() if s not in at_cap)
        share = {s: cap if s in at_cap else n / free * (1 - len(at_cap) * cap) for s, n in turns.items()}
        over = {s for s in share if share[s] > cap}
        if not over:
            return share
        at_cap |= {max(over, key=turns.get)}


@pytest.mark.parametrize(
    "sizes, weights",
    [
        ({"a": 4000, "b": 900, "c": 300, "d": 350, "e": 50}, None),
        ({"a": 700, "b": 700}, None),
        ({"a": 900, "b": 500, "c": 100, "unnamed": 40}, {"a": 0.2, "b": 0.5, "c": 0.3, "absent": 1.0}),
        # weights that no small number of quanta can hold, over many cycles
        ({"a": 9000, "b": 4000, "c": 300, "d": 40}, {"a": 0.6789, "b": 0.3002, "c": 0.0209, "d": 0.0009}),
        ({f"s{i}": 40 + 7 * i for i in range(30)}, None),
        # a third of the rows in one source, the rest in many small ones
        ({"hot": 3000} | {f"s{i}": 1 + i % 40 for i in range(300)}, None),
    ],
)
def test_schedule(spark, sizes, weights):
    rows = source_mix.plan(docs(spark, sizes), weights, block_rows=4, max_share=0.4).collect()
    assert len(rows) == sum(sizes.values()) and len({r["doc_id"] for r in rows}) == len(rows)
    laned = [r for r in rows if r["lane"] is not None]
    assert {r["source"] for r in rows} - {r["source"] for r in laned} == ({"unnamed"} if weights and "unnamed" in sizes else set())
    assert all((r["slot"] is not None) == r["in_mix"] for r in rows) and all(r["block"] == r["turn"] // 2 for r in laned)
    assert max(Counter((r["lane"], r["turn"]) for r in laned).values()) <= 2
    turns = sorted({(r["slot"], r["source"], r["turn"], r["release"], r["deadline"]) for r in rows if r["in_mix"]})
    # each slot has one turn, and the turns of a source come in their order
    assert [t[0] for t in turns] == list(range(len(turns)))
    seen = Counter()
    present = {s: w for s, w in (weights or {}).items() if s in sizes}
    exact = {s: Fraction(w) / sum(map(Fraction, present.values())) for s, w in present.items()} or natural(sizes, 2, 0.4)
    # at any moment each source is less than a block, two turns, from its weight as given
    for slot, name, turn, release, deadline in turns:
        assert release <= slot < deadline and turn == seen[name]
        seen[name] += 1
        assert all(abs(seen[s] - w * (slot + 1)) < 2 for s, w in exact.items())
    # it ends when a source has none left for its weight
    assert len(turns) + 1 >= min(-(-sizes[s] // 2) / w for s, w in exact.items()) - 1e-6


def test_natural_shares_keep_everything(spark):
    rows = source_mix.plan(docs(spark, {"a": 300, "b": 201, "c": 99, "d": 1}), max_share=1.0).collect()
    assert all(r["in_mix"] for r in rows)
    many = docs(spark, {"hot": 2000} | {f"s{i}": 1 + i % 7 for i in range(200)})
    assert source_mix.mixed(many, max_share=1.0).count() == many.count()


def test_ceiling_and_mixed_rows(spark):
    table = docs(spark, {"hot": 3000, "b": 400, "c": 400, "d": 400}).withColumn("slot", F.lit("x")).withColumn("whole", F.lit(1))
    kept = source_mix.mixed(table)
    assert kept.columns == table.columns
    counts = {r["source"]: r["count"] for r in kept.groupBy("source").count().collect()}
    assert counts["b"] == counts["c"] == counts["d"] == 400 and abs(counts["hot"] - 400) <= source_mix.BLOCK_ROWS
    planned = {r["doc_id"] for r in source_mix.plan(table).where("in_mix").collect()}
    assert planned == {r["doc_id"] for r in kept.collect()}


def test_null_source_repeats_and_none(spark):
    rows = [(1, None), (1, None), (2, "a"), (None, "a"), (2, "a")]
    found = source_mix.plan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"], r["source"]) for r in found), key=str) == sorted(rows, key=str)
    none = spark.createDataFrame([], DOCS)
    assert source_mix.plan(none).collect() == [] and source_mix.mixed(none).collect() == []
    with pytest.raises(ValueError):
        source_mix.plan(none, block_rows=5)
