"""Near-duplicates by similarity, against brute force over all pairs."""

import random

import pytest

from linewright.llm import near_dedup, shingle_pairs

DOCS = "doc_id long, text string"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(rows)}


def texts():
    draw = random.Random(5)
    line = "a line that stands in nearly all of the texts of this table"
    for _ in range(25):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([3, 5, 30, 60, 200]))]
        for _ in range(draw.randint(1, 8)):
            words = list(base)
            for _ in range(draw.randint(0, 1 + len(base) // 30)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(3000)}"
            yield " ".join(words) + (f" {line}" if draw.random() < 0.8 else "")


@pytest.mark.parametrize("bucket, rounds", [(128, 4), (2, 0), (3, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, bucket, rounds):
    monkeypatch.setattr(shingle_pairs, "BUCKET", bucket)
    monkeypatch.setattr(shingle_pairs, "ROUNDS", rounds)
    rows = list(enumerate(texts()))
    want = brute_groups(rows)
    table = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.groups(table).collect()} == want
    if bucket == 128:
        assert {r["doc_id"] for r in near_dedup.one_per_group(table).collect()} == set(want.values())


def test_near_copies_beyond_three_bits_are_one_group(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:30], "other", *words[31:]]))]
    assert (near_dedup.simhash(rows[0][1]) ^ near_dedup.simhash(rows[1][1])).bit_count() > 3
    assert [r["doc_id"] for r in near_dedup.one_per_group(spark.createDataFrame(rows, DOCS)).collect()] == [0]


def test_simhash_groups_keep_to_the_digest(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(7, base), (3, base), (9, base.replace("word200", "other")), (4, "something else entirely"), (5, None), (6, ""), (None, base)]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {7: 3, 3: 3, 9: 3, 4: 4, 5: 5, 6: 5, None: 3}


def test_a_template_that_the_sample_misses_is_not_crowded(spark, monkeypatch):
    """1,500 texts share 24 of 44 words; their heads are made anew with the shared shingles last, and no pair is left."""
    monkeypatch.setattr(shingle_pairs, "COMMON_LEAST", 10**9)
    template = " ".join(f"t{i}" for i in range(24))
    rows = [(i, f"{template} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(1_500)]
    rows.append((5_000, rows[7][1].replace("w7x19", "other")))
    table = spark.createDataFrame(rows, DOCS).select("doc_id", "text", shingle_pairs.marks_of(5)("text").alias("mark"))
    marked = table.selectExpr("doc_id AS at", "text", "mark.digest", "mark.size", "mark.bits")
    shared, crowded = shingle_pairs._shared_heads(marked, 5, 0.8, 1_501)
    assert crowded.count() == 0 and shared.count() < 50
    links = shingle_pairs.similar_links(marked, 5, 0.8).collect()
    digests = {r["at"]: r["digest"] for r in marked.where("at in (7, 5000)").collect()}
    assert [{r["a"], r["b"]} for r in links] == [set(digests.values())]


def test_what_is_not_on_the_map_is_not_among_the_values(spark, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "MARKED_LONGS", 2)
    values = spark.range(0, 600, 7)
    named, others = shingle_pairs.split_by(spark.range(600).selectExpr("id", "'x' AS bits"), shingle_pairs.map_of(values, "id"), "id")
    assert {r["id"] for r in values.collect()} <= {r["id"] for r in named.collect()}
    assert named.count() + others.count() == 600 and others.count() > 100


def _marked(spark, rows):
    table = spark.createDataFrame(rows, DOCS).select("doc_id", "text", shingle_pairs.marks_of(5)("text").alias("mark"))
    return table.selectExpr("doc_id AS at", "text", "mark.digest", "mark.size", "mark.bits")


def _seen(monkeypatch):
    """How many rows each written table has, by its label."""
    rows, write = {}, shingle_pairs.materialize

    def counted(df, label):
        table = write(df, label)
        rows.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(shingle_pairs, "materialize", counted)
    return rows


def test_heads_of_all_texts_are_made_once_and_copies_do_not_meet(spark, monkeypatch):
    """A template that the small sample misses costs no second pass, and a head that only exact copies share is not kept."""
    monkeypatch.setattr(shingle_pairs, "COMMON_LEAST", 10**9)
    seen = _seen(monkeypatch)
    template = " ".join(f"t{i}" for i in range(24))
    rows = [(i, f"{template} " + " ".join(f"w{i}x{j}" for j in range(20))) for i in range(600)]
    rows += [(1_000 + i, text) for i, text in rows[:200]]
    shared, _ = shingle_pairs._shared_heads(_marked(spark, rows), 5, 0.8, 600)
    assert seen["set-heads"] == [800] and shared.count() < 50


def test_unlike_sets_of_a_crowded_shingle_do_not_become_pairs(spark, monkeypatch):
    """Texts alike in nothing but a frame; the few that are alike are still linked."""
    monkeypatch.setattr(shingle_pairs, "COMMON_LEAST", 10**9)
    monkeypatch.setattr(shingle_pairs, "SHOWN", 0)  # nothing is put last, so the frame stays crowded
    frame = " ".join(f"t{i}" for i in range(60))
    rows = [(i, f"{frame} " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(300)]
    rows += [(900 + i, text.replace(f"w{i}x59", "other")) for i, text in rows[:5]]
    marked = _marked(spark, rows)
    seen = _seen(monkeypatch)
    links = {frozenset((r["a"], r["b"])) for r in shingle_pairs.similar_links(marked, 5, 0.8).collect()}
    digests = {r["at"]: r["digest"] for r in marked.collect()}
    assert links == {frozenset((digests[i], digests[900 + i])) for i in range(5)}
    assert sum(seen["crowd"]) > 300 and sum(seen["crowd-pairs"]) < 300
