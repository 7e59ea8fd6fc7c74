"""Normalization against hand-worked cases and a plain one-key-at-a-time oracle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D
from linewright.functions import text as T
from linewright.operators import normalize as N


def rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw_text string")
    out = N.extract_features(N.normalize(df)).orderBy("id").collect()
    return [r.asDict() for r in out]


CASES = [
    ("кабель 3х2.5", {"contains": "3x2.5"}),
    ("труба 32,5 мм", {"number": 32.5}),
    ("насос 25-40 180", {"numbers": [25.0, 40.0, 180.0]}),
    ("труба 32 мм", {"contains": "mm", "n_unit": None}),
    ("пена 750 мл", {"n_unit": "ml"}),
    ("клей 25 кг", {"n_unit": "kg"}),
    ("грунтовка 10 л", {"n_unit": "l"}),
    ("лампа 60 вт", {"n_unit": "w"}),
    ("насос grundfoss 25-40", {"n_brand": "grundfos"}),
    ("насос грундфос 25-40", {"n_brand": "grundfos"}),
    ("кабель для прокладки", {"no_token": "для"}),
    ("арт. 12345 кабель", {"no_token": "арт."}),
    ("Кабель ВВГнг 3х2,5 ГОСТ", {"token": "ввгнг", "no_token": "гост", "numbers": [3.0, 2.5]}),
    ("", {"n_text": "", "n_tokens": [], "numbers": []}),
    ("Дюбель 100 шт", {"n_unit": "pcs"}),
    ("Плитка 1.2 м2", {"n_unit": "sqm"}),
    ("Автомат шнайдер 16А", {"n_brand": "schneider electric"}),
    ("abcр", {"n_text": "abcp"}),
    ("банан", {"n_text": "банан", "n_packaging": None}),
    ("Насос Danfoss MSV-S 25 арт.96281375", {"article": "96281375", "n_brand": "danfoss"}),
    ("Болт М12 х 50 мм 1234", {"article": None}),
    ("плита 100х50х25,5", {"dims": ["100", "50", "25.5"]}),
    ("краска (белая), 3 бан.", {"n_packaging": "банка"}),
]


def test_cases(spark):
    for (text, want), got in zip(CASES, rows(spark, [t for t, _ in CASES])):
        for key, value in want.items():
            if key == "contains":
                assert value in got["n_text"], text
            elif key == "number":
                assert value in got["n_numbers"], text
            elif key == "numbers":
                assert got["n_numbers"] == value, text
            elif key == "dims":
                assert got["n_dims"] == value, text
            elif key == "token":
                assert value in got["n_tokens"], text
            elif key == "no_token":
                assert value not in got["n_tokens"], text
            else:
                assert got[key] == value, (text, key, got)


def one_by_one(text, table):
    for key, target in D.longest_first(table):
        text = re.sub(r"(?<!\w)" + re.escape(key) + r"(?!\w)", lambda m: target, text, flags=re.I)
    return text


def units_one_by_one(text):
    unit = None
    for loop in (1, 2):
        for key, target in D.longest_first(D.UNIT_ALIASES):
            quoted = re.escape(key)
            pattern = r"(?<=\d)\s*" + quoted + r"(?=\s|$|[,;.])" if loop == 1 else r"\b" + quoted + r"\b"
            if not re.search(pattern, text, re.I):
                continue
            if unit is None and target not in D.DIMENSION_UNITS:
                unit = target
            lead = " " if loop == 1 else ""
            text = re.sub(pattern, lambda m: lead + target, text, count=2 - loop, flags=re.I)
    return re.sub(r"\s+", " ", text).strip(), unit


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(7)
    keys = [*D.ABBREVIATIONS, *D.PACKAGING_ALIASES, *D.UNIT_ALIASES, "труба", "насос", "10", "2.5", "x"]
    keys = [k for k in keys if not set(k) & set("²³")]  # compatibility forms are gone by then
    glue = [" ", " ", "", ".", ", ", "/", "-"]
    return [
        "".join(rng.choice(keys) + rng.choice(glue) for _ in range(rng.randint(1, 7))) for _ in range(400)
    ]


def test_dictionaries_match_sequential_replacement(spark, random_texts):
    df = spark.createDataFrame([(t,) for t in random_texts], "t string")
    got = df.select(
        "t",
        T.replace_bounded(F.col("t"), D.ABBREVIATIONS).alias("abbr"),
        T.replace_bounded(F.col("t"), D.PACKAGING_ALIASES).alias("pack"),
        T.canonical_units(F.col("t")).alias("unit"),
    ).collect()
    for r in got:
        assert r.abbr == one_by_one(r.t, D.ABBREVIATIONS), r.t
        assert r.pack == one_by_one(r.t, D.PACKAGING_ALIASES), r.t
        assert (r.unit.text, r.unit.unit) == units_one_by_one(r.t), r.t


def test_unicode_cleanup(spark):
    df = spark.createDataFrame([("  «Ａ－Б» —\u0007 ½ м²  ",)], "t string")
    assert df.select(T.clean_unicode(F.col("t"))).first()[0] == "a-б - 1⁄2 м2"


def test_custom_steps(spark):
    df = spark.createDataFrame([("A  B",)], "raw_text string")
    out = N.normalize(df, steps=[N.tokenize, lambda d: d.withColumn("n_text", F.upper("n_text"))])
    assert out.first().n_text == "A B"


SYNONYMS = [
    (1, None, "цемент", "cement", True),
    (2, "s1", "цемент", "supplier cement", True),
    (3, None, "big pump", "насос", True),
    (4, None, "насос", "pump unit", True),
    (5, None, "off", "on", False),
    (6, "s2", "m $5", "a$b", True),
]


def test_synonyms(spark):
    table = spark.createDataFrame(
        SYNONYMS,
        "synonym_id int, supplier_id string, normalized_source_text string, target_text string, is_active boolean",
    )
    assert {r.source: r.target for r in N.synonym_map(table).collect()}["цемент"] == "cement"
    assert {r.source: r.target for r in N.synonym_map(table, "s1").collect()}["цемент"] == "supplier cement"
    lines = spark.createDataFrame(
        [(1, None, "цемент м500"), (2, "s1", "цемент м500"), (3, "s3", "the big pump off"),
         (4, "s2", "m $5 x"), (5, None, "nothing")],
        "line_id int, supplier_id string, n_text string",
    )
    got = {r.line_id: (r.n_text, r.n_synonyms) for r in N.apply_synonyms(lines, table).collect()}
    assert got[1] == ("cement м500", ["цемент->cement"])
    assert got[2][0] == "supplier cement м500"
    assert got[3] == ("the pump unit off", ["big pump->насос", "насос->pump unit"])
    assert got[4][0] == "a$b x"
    assert got[5] == ("nothing", [])
