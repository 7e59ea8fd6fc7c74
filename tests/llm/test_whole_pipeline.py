"""The stages of the pipeline lose nothing but what they are there to remove."""

from collections import Counter

import pytest

import corpus_pipeline
from linewright.llm import source_mix


@pytest.mark.parametrize(
    "sizes",
    [
        {"hot": 1000, **{f"small{i}": 2 for i in range(1000)}},
        {"a": 3000, "b": 400, "c": 30},
        {"hot": 3000, "b": 400, "c": 400, "d": 400, "e": 400, "f": 7},
    ],
)
def test_mixing_keeps_every_document_of_skewed_sources(spark, sizes):
    rows = [(i, name) for i, name in enumerate(name for name, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    assert sorted(map(tuple, corpus_pipeline.mixing(spark, docs, "").collect())) == rows


def test_mixing_puts_documents_in_the_order_of_the_schedule(spark, tmp_path):
    """At any place each source is less than a block from its share, also in what was written, file after file."""
    sizes = {"a": 1600, "b": 800, "c": 160, "d": 80}
    names = [name for name, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    mixed = corpus_pipeline.mixing(spark, docs, "")
    slots = {r["doc_id"]: (r["slot"], r["place"]) for r in source_mix.plan(docs, max_share=1.0).collect()}
    mixed.write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*"))
    written = [r for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    for rows in (mixed.collect(), written):
        assert [slots[r["doc_id"]] for r in rows] == sorted(slots.values()) and len(rows) == len(names)
        seen = Counter()
        for at, r in enumerate(rows, 1):
            seen[r["source"]] += 1
            assert all(abs(seen[s] - n * at / len(names)) < source_mix.BLOCK_ROWS for s, n in sizes.items())


def test_ordered_mix_holds_the_rows_of_the_mix(spark):
    """Odd rows too: null and repeated ids, a null source, columns named as those of the schedule, no rows."""
    sizes = {"hot": 300, None: 40, "c": 40, "d": 40}
    names = [name for name, n in sizes.items() for _ in range(n)]
    rows = [(None if i % 50 == 0 else i // 2 * 2 if i % 10 == 1 else i, name, i, -i) for i, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, at long, slot long")
    key = lambda r: tuple(map(str, r))
    for share in (source_mix.MAX_SHARE, 1.0):
        found = source_mix.in_order(docs, max_share=share)
        assert found.columns == docs.columns
        assert sorted(found.collect(), key=key) == sorted(source_mix.mixed(docs, max_share=share).collect(), key=key)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(rows, key=key)
    assert source_mix.in_order(docs.limit(0)).collect() == []


def test_sequences_follow_the_mixture(spark):
    """Every piece is placed once, and sequences come in the order of their first document in the schedule."""
    names = ["a"] * 40 + ["b"] * 20 + ["c"] * 4 + [None] * 3
    rows = [(None if i == 66 else i, name, "word " * (1 + i * 37 % 900) + str(i)) for i, name in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = corpus_pipeline.packed(spark, docs, "").collect()
    plain = corpus_pipeline.packing.pack_documents(docs, corpus_pipeline.VOCABULARY)
    assert found[0].asDict().keys() == plain.first().asDict().keys()
    same = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(same, found)) == sorted(map(same, plain.collect()))
    at = {r["doc_id"]: r["at"] for r in source_mix.places(docs, max_share=1.0).collect()}
    first, taken = {}, {}
    for r in found:
        first[r["sequence_id"]] = min(at[r["doc_id"]], first.get(r["sequence_id"], len(rows)))
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(first) == list(range(len(first))) and [first[i] for i in sorted(first)] == sorted(first.values())
    for places in map(sorted, taken.values()):
        assert places[0][0] == 0 and all(o + n == then for (o, n), (then, _) in zip(places, places[1:]))
        assert sum(places[-1]) <= corpus_pipeline.packing.CAPACITY
