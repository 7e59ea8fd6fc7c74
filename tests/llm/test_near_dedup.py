import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from linewright.llm import near_dedup

DOCS = "doc_id long, text string"


def slow_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "ÀÉ a b c d É", "A b a b a b a b", "w\x1cx y z"])
def test_fingerprint(text):
    assert near_dedup.simhash(text) == slow_simhash(text)


def test_fingerprint_of_a_long_text():
    draw = random.Random(1)
    text = " ".join(draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(70_000))
    assert near_dedup.simhash(text) == slow_simhash(text)


def brute_pairs(prints):
    u = np.unique(np.array(prints, np.int64))
    bits = np.bitwise_count((u[:, None] ^ u[None, :]).view(np.uint64))
    return {(int(u[max(i, j)]), int(u[min(i, j)])) for i, j in zip(*np.nonzero((bits > 0) & (bits <= 3)))}


def linked(spark, prints):
    df = spark.createDataFrame([(p,) for p in set(prints)], "fp long")
    return {(r["a"], r["b"]) for r in near_dedup.linked_pairs(df).collect()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(draw, base, most):
    for _ in range(draw.randint(0, most)):
        base ^= 1 << draw.randrange(64)
    return base


def test_pairs_equal_brute_force(spark):
    draw = random.Random(7)
    bases = [draw.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    prints = [signed(near(draw, b, 5)) for b in bases for _ in range(25)]
    assert linked(spark, prints) == brute_pairs(prints)


def test_crowded_halves_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 8)
    draw = random.Random(8)
    prints = [signed(near(draw, 0xABCDEF0123456789, 4)) for _ in range(150)]
    prints += [signed(0x1234567800000000 | draw.getrandbits(32)) for _ in range(100)]
    prints += [signed(0x1234567812340000 | draw.getrandbits(16)) for _ in range(100)]
    assert linked(spark, prints) == brute_pairs(prints)


def test_groups_and_survivors(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(7, base), (3, base), (9, base.replace("word200", "other")), (4, "something else entirely"), (5, None), (6, ""), (None, base)]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {7: 3, 3: 3, 9: 3, 4: 4, 5: 5, 6: 5, None: 3}
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows] + [(3, base, "y", 1)], DOCS + ", fp string, at int")
    kept = near_dedup.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_empty_and_nameless(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_dedup.groups(none).collect() == [] and near_dedup.one_per_group(none).collect() == []
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c")], DOCS)
    assert [r["component_id"] for r in near_dedup.groups(nameless).collect()] == [None, None]
    assert near_dedup.one_per_group(nameless).count() == 1


def test_survivors_are_linked_by_simhash_too(spark):
    # one refrain gives the fingerprint, so what follows it makes other sets of shingles only
    refrain = " ".join(["a b c"] * 300)
    rows = [(2, refrain), (1, refrain + " x y z p q r s t u v"), (8, "something else entirely")]
    docs = spark.createDataFrame(rows, DOCS)
    wanted = {r["doc_id"]: r["component_id"] for r in near_dedup.simhash_groups(docs).collect()}
    assert wanted == {1: 1, 2: 1, 8: 8}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups(docs, simhash_too=True).collect()} == wanted
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup(spark, docs, "").collect()) == [1, 8]
