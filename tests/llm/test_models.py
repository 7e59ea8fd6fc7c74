import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import language_id, quality_model

FOLDER = "/root/testdata/sf0.01"


def test_statistics_of_any_text():
    for text in (None, "", " \n\t", "a", "é", "a b\nb a\na b", "|" * 100, "Und " * 50_000, "\ud800"):
        row = quality_model.statistics(text)
        assert len(row) == quality_model.FEATURES and np.isfinite(row).all()


def test_trees_walk_as_they_were_grown():
    draw = np.random.default_rng(1)
    stats = np.round(draw.normal(size=(600, 4)), 1)
    labels = ((stats[:, 0] > 0) ^ (stats[:, 2] > 0.5)).astype(float)
    model = quality_model.fit(stats, labels, trees=30)
    scores = model.scores(stats)
    assert ((scores >= 0.5) == labels).mean() > 0.98
    for i in range(0, 600, 50):  # one row and one tree at a time
        total = model.base
        for feature, bound, leaf in zip(model.feature, model.bound, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if stats[i, feature[node]] > bound[node] else 1)
            total += leaf[node - len(feature)]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("labels, least, most", [([], 0.4, 0.6), ([1, 1, 1], 0.7, 1), ([0, 0, 0], 0, 0.3)])
def test_models_of_one_label(labels, least, most):
    model = quality_model.fit(np.zeros((len(labels), quality_model.FEATURES)), np.array(labels, float))
    assert least <= model.scores(np.zeros((2, quality_model.FEATURES)))[0] <= most


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality_model.query(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    changed = labels.withColumn("quality", F.when(quality_model.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model.train(docs, labels), quality_model.train(docs, changed)
    assert all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("feature", "bound", "leaf"))


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, "good text", "x"), (1, "good text", "x"), (2, None, "x"), (None, "", "x"), (3, "##", "x")], "doc_id long, text string, score string"
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (77, 0)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    rows = quality_model.classify(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert quality_model.keep_good(docs, model).columns == docs.columns
    none = spark.createDataFrame([], docs.schema)
    empty = quality_model.train(none, spark.createDataFrame([], labels.schema))
    assert quality_model.classify(none, empty).collect() == [] and quality_model.keep_good(none, empty).collect() == []


def words(draw, syllables, n):
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))


LANGS = {"xx": ["ba", "lo", "mi"], "yy": ["kru", "stu", "ö"], "zz": ["日", "本", "語"]}


def test_grams_equal_plain_counts():
    text = "Ab, aB-ab 12 É"
    plain = text.lower().encode()
    words = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in plain).split()
    spaced = b" " + b" ".join(words) + b" "
    counts = np.zeros(language_id.WIDTH)
    for n in (2, 3):
        for i in range(len(spaced) - n + 1):
            code = int.from_bytes(spaced[i : i + n], "big") | (1 << 24 if n == 3 else 0)
            counts[(code * 2654435761 % 2**32) >> 20] += 1
    assert np.allclose(language_id.grams(text), np.log1p(counts))


def test_languages_apart_and_noise(spark):
    draw = random.Random(3)
    rows = [(i, words(draw, LANGS[lang], 30), lang) for i, lang in enumerate([*LANGS] * 60)]
    rows += [(1000 + i, words(draw, LANGS["yy"], 30), "xx") for i in range(3)]  # wrong labels
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.classify(docs, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[:180])
    far = spark.createDataFrame([(1, "qqq www ppp qwp " * 20, None)], docs.schema)
    assert language_id.classify(far, model).first()["rejected"]
    assert language_id.classify(far, model, reject=True).first()["lang_pred"] == "und"


def test_held_out_languages_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = language_id.is_held_out(F.col("doc_id"))
    changed = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(held, "other").otherwise(F.col("text")))
    a, b = language_id.train(docs), language_id.train(changed)
    assert a.lang == b.lang and np.array_equal(a.centers, b.centers) and np.array_equal(a.idf, b.idf)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = language_id.query(spark, FOLDER).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "lo mi ba", "xx", ""), (1, "lo mi ba", "xx", ""), (3, None, "xx", ""), (4, "", "xx", ""), (5, "12 --", "xx", ""), (None, "lo", None, "")]
    docs = spark.createDataFrame(rows, schema)
    found = language_id.classify(docs, language_id.train(docs)).collect()
    assert sorted((r["lang_pred"], r["score"] == 0) for r in found) == [("und", True)] * 3 + [("xx", False)] * 3
    none = spark.createDataFrame([], schema)
    unlearned = language_id.train(none)
    assert language_id.classify(none, unlearned).collect() == []
    assert {r["lang_pred"] for r in language_id.classify(docs, unlearned).collect()} == {"und"}
