import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linewright.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, length string, rank int"
ODD = ["", " ", "  a\n\n b", "a<|endoftext|>b", "Don't we'll\t x  ", "ü  x 12½³", "日本語 test", "é\u200b\u3000a   \u0085 b", "!!'s  'S", "\r\n\r\n x",
       "a\x1c\x1d\x1e\x1f b\x00\x0b\x0c", "\u0130i̇ ǅ ʼn ƿ", "x\u2028y\u2029z\u00a0 \u00adq", "🙂🙂 ok", "١٢٣ ٤"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_encoder_equals_tokenizer(tokenizer):
    encode = packing.Encoder(VOCABULARY)
    draw = random.Random(4)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)] if not 0xD800 <= c < 0xE000]
    texts = ODD + ["".join(draw.choice(alphabet) for _ in range(80)) for _ in range(300)]
    for text in texts:
        assert [*np.frombuffer(encode(text), "<u4"), 0] == ids(tokenizer, text), repr(text)


def test_added_tokens_are_as_the_tokenizer_has_them(tokenizer):
    encode = packing.Encoder(VOCABULARY)
    for text in ("<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> x <|endoftext|><|endoftext|>", "<|endoftext", "word " * 5_000 + "<|endoftext|>"):
        assert [*np.frombuffer(encode(text), "<u4"), 0] == ids(tokenizer, text), repr(text[-40:])
    assert [*np.frombuffer(encode("a<|endoftext|>b"), "<u4")] == [64, 50256, 65]


def test_best_fit_equals_piece_by_piece():
    draw = random.Random(6)
    for _ in range(30):
        capacity = draw.randint(5, 60)
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 200))]
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.best_fit_plan(counts, capacity)
        fill = {}
        for length, rank, n, sequence, offset in plan:
            for s in range(sequence, sequence + n):
                fill.setdefault(s, []).append((offset, length))
        assert sum(n for _, _, n, _, _ in plan) == len(lengths)
        for parts in fill.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))]
            assert sum(x for _, x in parts) <= capacity
        rooms = []  # plain best-fit decreasing
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
        assert len(fill) <= len(rooms)


def check(rows, docs, tokenizer, capacity):
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for key, text in docs:
        whole = ids(tokenizer, text)
        parts = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert sum(r["length"] for r in parts) == len(whole)
        assert all(r["length"] == capacity for r in parts[1:])
        for r in parts:
            piece = np.array(whole[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert len(piece) == 4 * r["length"] and zlib.crc32(piece) == r["ids_crc32"]
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_documents(spark, tokenizer):
    draw = random.Random(9)
    docs = [(i, t) for i, t in enumerate([None, *ODD, "long " * 4096, "long " * 4095, "long " * 2047])]
    docs += [(100 + i, "word " * draw.randint(1, 900)) for i in range(120)] + [(1000 + i, "same text") for i in range(200)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS)
    rows = packing.pack_documents(df, VOCABULARY).collect()
    n = check(rows, docs, tokenizer, packing.CAPACITY)
    assert n <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


def test_ids_repeats_nulls_and_none(spark):
    df = spark.createDataFrame([(1, "a b", "", 0), (1, "a b", "", 0), (None, "c", "", 0)], DOCS)
    rows = packing.pack_documents(df, VOCABULARY).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in rows) == [(False, 3), (False, 3), (True, 2)]
    assert sorted(r["offset"] for r in rows) == [0, 3, 6]
    pieces = packing.tokenized_pieces(df, VOCABULARY, with_ids=True).collect()
    assert sorted(len(r["ids"]) for r in pieces) == [2, 3, 3] and all(r["ids"][-1] == 0 for r in pieces)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), VOCABULARY).collect() == []
