"""The index in segments against one that is built at once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import retrieval as R
from linewright.operators import segments as G
from linewright.plans import ingest

WORDS = "red blue green pump pipe bolt steel насос труба 25 40 m12 плита valve cap".split()
SCHEMA = "product_id string, normalized_name string, search_document string, is_active boolean"


def product(rng, i):
    name = "red steel pump" if i % 4 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
    return (f"p{i:03d}", name, None if i % 31 == 0 else f"{name} | {rng.choice(['acme', 'bolts ltd'])}", True)


def matches(spark, index):
    queries = spark.createDataFrame([(q, q) for q in ("red steel pump", "blue pipe", "насос 25", "valve", "m12 acme", "new lamp")], "query_id string, text string")
    return sorted(map(tuple, R.lexical_matches(queries, index, cap=30, floors=()).collect()))


def files(path, segment):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/{segment}") for f in names}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Three catalogs, one after the other, and the index as refreshed to each."""
    rng = random.Random(3)
    rows = {f"p{i:03d}": product(rng, i) for i in range(120)}
    path = str(tmp_path_factory.mktemp("index"))
    index, out = G.open_segments(spark, path), []
    for step in range(3):
        if step:
            for key in rng.sample(sorted(rows), 12):
                choice = rng.random()
                if choice < 0.3:
                    del rows[key]
                elif choice < 0.5:
                    rows[key] = (*rows[key][:3], not rows[key][3])
                else:
                    rows[key] = (key, "new lamp", f"new lamp | {step}", True)
            rows.pop("p000", None)  # the first product of the largest class
            for i in range(200 + 10 * step, 205 + 10 * step):
                rows[f"p{i:03d}"] = product(rng, i)
        catalog = spark.createDataFrame(list(rows.values()), SCHEMA)
        before = {s: files(path, s) for s in index.names}
        index = G.refresh(index, catalog)
        out.append((catalog, index, before))
    return path, out


@pytest.mark.parametrize("step", range(3))
def test_equals_the_whole_index(spark, steps, step):
    _, out = steps
    catalog, index, _ = out[step]
    assert len(index.names) == step + 1
    assert matches(spark, G.catalog_index(index)) == matches(spark, R.build_index(catalog))


def test_old_segments_are_not_written_again(spark, steps):
    path, out = steps
    for _, _, before in out:
        for segment, there in before.items():
            assert there and there.items() <= files(path, segment).items()
    assert out[-1][1].names == G.open_segments(spark, path).names


def test_a_delta_holds_what_changed_only(spark, steps):
    _, out = steps
    _, index, _ = out[1]
    first, delta = (index.table(s, "members").count() for s in index.names)
    assert 0 < delta < 60 < first
    known = {r["gram"] for r in index.table(index.names[0], "name_frequency").collect()}
    new = {r["gram"] for r in index.table(index.names[1], "name_frequency").collect()}
    assert new and not new & known  # "lamp" came with the second segment


def test_merged_segments_find_the_same(spark, steps):
    _, out = steps
    catalog, index, _ = out[-1]
    merged = G.merge(index)
    assert len(merged.names) == 1 and G.share_of_deltas(merged) == 0
    assert matches(spark, G.catalog_index(merged)) == matches(spark, R.build_index(catalog))
    assert G.open_segments(spark, index.path).names == merged.names


def test_nothing_changed_writes_nothing(spark, tmp_path):
    catalog = spark.createDataFrame([("a", "red pump", "red pump | acme", True)], SCHEMA)
    empty = G.open_segments(spark, str(tmp_path / "none"))
    assert empty.names == ()
    index = G.refresh(empty, catalog)
    assert G.refresh(index, catalog).names == index.names == ("base-0",)
    none = G.refresh(index, catalog.limit(0))
    assert len(none.names) == 2 and G.catalog_index(none).members.count() == 0
    assert matches(spark, G.catalog_index(none)) == []


def test_refresh_index_merges_and_names_the_version(spark, tmp_path):
    rows = [(f"p{i}", f"pump {i}", f"pump {i}", True) for i in range(8)]
    versions = spark.createDataFrame([("v1", True)], "index_version_id string, is_active boolean")
    version = spark.createDataFrame([("v2",)], "index_version_id string")
    index = G.refresh(G.open_segments(spark, str(tmp_path)), spark.createDataFrame(rows[:4], SCHEMA))
    index, after = ingest.refresh_index(index, spark.createDataFrame(rows, SCHEMA), versions, version)
    assert index.names == ("base-2",)  # as many came as there were, so they were merged
    assert {(r["index_version_id"], r["is_active"]) for r in after.collect()} == {("v1", False), ("v2", True)}
    assert G.catalog_index(index).members.agg(F.count_distinct("product_id")).first()[0] == 8
