import re

import pytest
from pyspark.sql import functions as F

from linewright.llm import quality_rules

DOCS = "doc_id long, text string, source string"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one two",
    "a a a a",
    "a b c d a b c",
    "x y z\nx y z\n\n x y z\nx y z",
    "ü ß$ 日本 é|<>&%*#    b",
    "\ta b\x0bc\r\nd  e ",
    " ".join(f"w{i % 40}" for i in range(300)),
    " ".join(f"w{i}" for i in range(20_000)) + " w1 w2 w3 w1 w2 w3",
    "Und " * 5_000,
]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)], DOCS)
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(rows[i][c] for c in quality_rules.COUNTS) == counts(text), repr(text)[:50]
        n_words, *_, repeated = counts(text)
        assert rows[i]["base_failed"] == (n_words < 50 or 100 * repeated > 50 * n_words)


GOOD = " ".join(f"word{i}" for i in range(60))


def test_bad_host_takes_its_documents_along(spark):
    rows = [(i, GOOD if i % 20 == 0 else "short", "bad") for i in range(200)]
    rows += [(1000 + i, GOOD, "good") for i in range(200)] + [(2000, GOOD, "small"), (2001, "short", "tiny")]
    rows += [(3000, GOOD, None), (None, GOOD, "good")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not kept[0] and kept[1000] and kept[2000] and kept[3000] and kept[None]
    stay = {r["doc_id"] for r in quality_rules.keep_good(spark.createDataFrame(rows, DOCS)).collect()}
    assert stay == {k for k, v in kept.items() if v}


def test_one_failure_does_not_condemn_a_small_host(spark):
    rows = [(100 * h + i, "short" if i < h % 3 else GOOD, f"h{h}") for h in range(30) for i in range(20)] + [(9999, "short", "tiny")]
    judged = quality_rules.rule_counts(spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "host"))
    rates = {r["host"]: r for r in quality_rules.host_verdicts(judged).collect()}
    assert rates["tiny"]["rate"] < 0.5 and not rates["tiny"]["rejected"]


def test_empty_repeats_and_clashing_names(spark):
    assert quality_rules.judge(spark.createDataFrame([], DOCS)).collect() == []
    assert quality_rules.keep_good(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, GOOD, "s")] * 2 + [(2, "x", "s")], DOCS)
    for name in ("host", "row", "words", "kept", "n_words", "bad_host", "rejected"):
        docs = docs.withColumn(name, F.lit(name))
    assert sorted((r["doc_id"], r["kept"]) for r in quality_rules.judge(docs).collect()) == [(1, True), (1, True), (2, False)]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r["host"] for r in kept.collect()] == ["host", "host"]


@pytest.mark.parametrize("failures", [0, 1])
def test_hosts_all_alike(spark, failures):
    text = "short" if failures else GOOD
    docs = spark.createDataFrame([(i, text, f"h{i % 4}") for i in range(40)], DOCS)
    assert {r["kept"] for r in quality_rules.judge(docs).collect()} == {not failures}
