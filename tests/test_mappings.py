"""Mappings by supplier: all keys of a line, hot suppliers, and how often rows move."""

import random

import pytest

from linewright.operators import mappings as M

LINES = "line_id string, supplier_id string, raw_text string, n_text string, article string"
MAPPINGS = (
    "mapping_id string, supplier_id string, supplier_sku string, supplier_article string, supplier_raw_text string, "
    "normalized_supplier_text string, product_id string, mapping_type string, confidence double, is_active boolean"
)


@pytest.fixture(scope="module")
def world(spark):
    """Few values, so that suppliers, texts and ids repeat; each may be null."""
    dice = random.Random(7)
    one = lambda *values: dice.choice([*values, None])
    words = ["a", "b", "c", "d"]
    lines = [(f"l{i // 2 * 2 if i % 10 == 0 else i}", one("s1", "s2", "s3"), one(*words), one(*words), one("", *words)) for i in range(120)]
    known = [
        (f"m{i}", one("s1", "s2", "s3"), one(*words), one("", *words), one(*words), one(*words), f"p{i}",
         one("exact", "approved", "manual", "learned", "other"), one(0.0, 0.5), dice.random() < 0.5)
        for i in range(40)
    ]
    return lines, known, spark.createDataFrame(lines, LINES), spark.createDataFrame(known, MAPPINGS)


def best(rows, mapping_key):
    rows = [m for m in rows if m[9]]
    return min(rows, key=mapping_key) if rows else None


@pytest.mark.parametrize("hot", [1_000_000, 60, 1])
@pytest.mark.parametrize("empty", [False, True])
def test_overrides_equal_brute_force(world, monkeypatch, hot, empty):
    monkeypatch.setattr(M, "HOT_ROWS", hot)
    monkeypatch.setattr(M, "TASK_ROWS", 5)
    lines, known, left, right = world
    rank = lambda m: M.TYPE_RANK.get(m[7], 5)
    wanted = {}
    for line_id, supplier, raw, words, article in lines:
        article = (article or "") if empty else article or None
        hits = [
            m for m in known if supplier is not None and m[1] == supplier and (
                raw is not None and raw in (m[2], m[4]) or article is not None and m[3] == article or words is not None and m[5] == words
            )
        ]
        wanted.setdefault(line_id, []).extend(hits)
    wanted = {i: best(hits, lambda m: (rank(m), m[0])) for i, hits in wanted.items()}
    wanted = sorted((i, m[6], m[7], m[8] or 0.995) for i, m in wanted.items() if m)
    assert sorted(map(tuple, M.supplier_overrides(left, right, empty).collect()), key=lambda r: r[0]) == wanted


@pytest.mark.parametrize("hot", [1_000_000, 60, 1])
def test_first_mapping_equals_brute_force(world, monkeypatch, hot):
    monkeypatch.setattr(M, "HOT_ROWS", hot)
    lines, known, left, right = world
    wanted = []
    for line_id, supplier, raw, words, article in lines:
        at, value = (3, article) if article else (5, words) if words else (4, raw)
        hit = best([m for m in known if supplier and value and m[1] == supplier and m[at] == value], lambda m: m[0])
        wanted += [(line_id, hit[0], hit[6], hit[7])] if hit else []
    lookups = left.withColumnsRenamed({"line_id": "lookup_id", "n_text": "normalized_text"})
    found = [tuple(r) for r in M.find_mapping(lookups, right).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(wanted, key=key)


def test_a_row_moves_once_for_all_its_keys(world):
    """The keys of lines and mappings are laid out behind the exchange by supplier, not before it."""
    plan = M.supplier_overrides(world[2], world[3])._jdf.queryExecution().executedPlan().toString()
    moved = plan.index("Exchange hashpartitioning(supplier_id")
    assert "Generate explode" in plan[:moved] and "REPARTITION_BY_NUM" in plan[moved : moved + 200]


def test_types_of_no_use_stay_behind(world):
    """Without the later types the lines whose best mapping is of an early one are as before."""
    lines, known, left, right = world
    everything = {tuple(r) for r in M.supplier_overrides(left, right).collect()}
    for last, types in (("exact", ("exact",)), ("approved", ("exact", "approved")), ("learned", tuple(M.TYPE_RANK))):
        found = [tuple(r) for r in M.supplier_overrides(left, right, up_to=last).collect()]
        assert len(found) == len(set(found)) and set(found) == {r for r in everything if r[2] in types}


def test_merge_of_overrides_with_copies_and_nulls(spark, tmp_path):
    """A line of which there are copies is given once, and moves to its supplier and to its id, nowhere else."""
    import re

    from checks import matching
    from checks.common import QUERIES, mappings

    dice = random.Random(3)
    one = lambda *values: dice.choice([*values, None])
    rows = [
        (one(1, 2, 3, 4, 5), one(1, 2, 3), one(1, 2), one(1, 2), float(dice.randint(1, 50)), one(0.0, 0.1), one(0.02, 0.08), one("A", "R", "N"), one("O", "F"))
        for _ in range(80)
    ]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    table = spark.createDataFrame(rows + rows[:30], schema).selectExpr("*", "timestamp'2024-01-01' as l_shipdate")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = matching._lines(spark, str(tmp_path)).collect()
    best = {r["line_id"]: r for r in M.supplier_overrides(matching._lines(spark, str(tmp_path)), mappings(spark, str(tmp_path))).collect()}
    done = {i: r for i, r in best.items() if r["mapping_type"] in ("exact", "approved")}
    wanted = [(i, "auto_match", r["product_id"]) for i, r in done.items()] + [(r["line_id"], "scored", None) for r in lines if r["line_id"] not in done]
    merged = QUERIES["E21_override_merge"](spark, str(tmp_path))
    found = [(r["line_id"], r["route"], r["product_id"]) for r in merged.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(wanted, key=key) and done and len(done) < len(found)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\((\w+)[^,]*, (\w+)", plan)
    assert not [m for m in moved if m[1].startswith("l_")], "lines move by all their columns"
