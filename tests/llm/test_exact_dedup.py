import hashlib
import random
import string

import pytest

from linewright.llm import exact_dedup

SCHEMA = "doc_id long, text string, at string, recipe int, keep_id string, name string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), place == len(ids) - 1, digest) for place, i in enumerate(ids)]
    return sorted(out, key=str)


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)
    out = exact_dedup.duplicates(table, **options)
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in out.collect()), key=str)


def corpus():
    draw = random.Random(3)
    shared = "".join(draw.choice(string.ascii_letters + " é\n") for _ in range(30_000))
    rows = [(i, "Copy of THE text") for i in range(100, 400)]  # one hot group
    for i in range(60):
        head = "".join(draw.choice(string.ascii_letters) for _ in range(draw.choice([0, 1, 31, 32, 33, 200])))
        rows.append((i, head + shared))  # a passage that many texts hold
        if i % 3 == 0:
            rows.append((1000 + i, (head + shared).swapcase().replace("É", "é")))
    rows += [(2000 + i, shared[:-1] + c) for i, c in enumerate("abcabA")]
    rows += [(3000, None), (3001, ""), (3002, " "), (None, None), (None, "only"), (3003, "ÀÉ"), (3004, "àé"), (3005, "Z" * 200_000), (3006, "z" * 200_000)]
    return rows + [(3007, "twice"), (3007, "twice"), (3008, "x\x00y"), (3009, "x\x00y")]


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force(spark, bits):
    rows = corpus()
    assert found(spark, rows, hash_bits=bits) == expected(rows)


def test_no_rows(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("size", [0, 1, 31, 32, 33, 5_000, 300_000])
def test_cuts_cover_the_text(size):
    draw = random.Random(size)
    for data in (draw.randbytes(size), b"a" * size):
        parts = exact_dedup.chunks(data)
        assert b"".join(parts) == data and all(0 < len(p) <= exact_dedup.MOST_BYTES for p in parts)


def test_cuts_follow_the_content():
    draw = random.Random(9)
    passage = draw.randbytes(200_000)
    one, two = (exact_dedup.chunks(draw.randbytes(n) + passage) for n in (1_000, 77_777))
    shared = set(one) & set(two)
    assert sum(map(len, shared)) > 180_000 and len(shared) > 20


def test_copies_share_one_recipe(spark):
    text = "same text " * 3_000
    docs = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string")
    cooked = exact_dedup._recipes(docs.selectExpr("doc_id", "cast(text as binary) AS text"), 64, False).select("recipe").distinct().collect()
    assert [r["recipe"] for r in cooked] == [exact_dedup._names(exact_dedup.chunks(text.encode()), 64)]
