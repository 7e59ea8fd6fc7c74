"""Sheets, catalog files and ERP pages against small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from linewright.operators import catalog as C
from linewright.operators import grid as G
from linewright.sources import catalog_files, erp, grids, lines, sinks


def cells(spark, *frames):
    rows = []
    for i, frame in enumerate(frames):
        for r, row in enumerate(frame):
            for c, value in enumerate(row):
                rows.append((f"f{i}", "s", r, c, value))
    return spark.createDataFrame(rows, "file_id string, sheet string, row int, col int, value string")


TWO_TABLES = [
    ["Заказчик: Северный лес", None, None, "Каталог склада", None],
    ["Номенклатура", "Единица", None, "Наименование", "Цена"],
    ["Доска сосновая", "м", None, "Доска 40х150", "310"],
    ["Саморез жёлтый", "кг", None, "Саморез 5х70", "95"],
    ["Герметик", "шт", None, "Герметик акриловый", "220"],
]


def test_two_tables(spark):
    df = cells(spark, TWO_TABLES)
    assert [r.col for r in G.column_gaps(df).collect()] == [2]
    assert sorted((r.col_start, r.col_end) for r in G.column_groups(df).collect()) == [(0, 1), (3, 4)]
    regions, items = G.analyze(df)
    got = {r.region: r for r in regions.collect()}
    assert {r.header_row for r in got.values()} == {1}
    assert (got[1].role, got[2].role) == ("supplier_input", "catalog_reference")
    assert got[1].supplier_name == "Северный лес"
    summary = G.file_summary(regions, items).first()
    assert (summary.tables_detected, summary.supplier_items, summary.catalog_items) == (2, 3, 3)
    assert summary.supplier_name == "Северный лес"
    rows = {(r.region, r.raw_text): r for r in items.collect()}
    assert rows[1, "Саморез жёлтый"].unit == "кг" and rows[2, "Саморез 5х70"].price == "95"
    assert rows[2, "Саморез 5х70"].original_row == {"Наименование": "Саморез 5х70", "Цена": "95"}


def types(spark, frame):
    df = cells(spark, frame)
    headed = G.whole_sheets(df).withColumn("header_row", F.lit(0))
    return [r.column_type for r in G.column_types(df, headed).orderBy("col").collect()]


def test_column_types(spark):
    wordy = ["плита газобетонная стеновая", "клей монтажный для плит", "сетка кладочная оцинкованная", "дюбель фасадный с гвоздём"]
    table = [["x", "y", "z"]] + [[str(2 + i), f"{70 + 13 * i},25 руб", w] for i, w in enumerate(wordy)]
    assert types(spark, table) == ["number", "price", "name"]
    coded = [["x", "y", "Артикул"], ["кг", "ZK", "17"], ["шт", "ZK7654321", "18"], ["м", "K", "19"], ["л", "ZQ", "20"]]
    assert types(spark, coded) == ["unit", "article", "article"]
    assert types(spark, [["x"], [None], [None], [None]]) == ["other"]


def test_title_rows_are_no_headers(spark):
    frame = [["Весенний лист", "Весенний лист"], [None, None], [None, None], ["Наименование", "Цена"], ["Грунт универсальный", "64"]]
    df = cells(spark, frame)
    assert G.header_rows(df, G.whole_sheets(df)).first().header_row == 3


def test_items_skip_totals_and_repeats(spark):
    frame = [["Name", "Name", "Unit", "Price"], ["Pump", "Backup", "pcs", "100"], ["pump", "x", "", ""], ["Итого", "", "", ""], ["Cable", "", "m", "nan"], ["", "", "", ""], ["A", "", "", ""]]
    df = cells(spark, frame)
    regions = G.whole_sheets(df).withColumns({"header_row": F.lit(0), "name_col": F.lit(0), "unit_col": F.lit(2), "price_col": F.lit(3)})
    got = sorted(G.region_items(df, regions).collect(), key=lambda r: int(r.line_id))
    assert [(r.line_id, r.raw_text, r.unit, r.price) for r in got] == [("1", "Pump", "pcs", "100"), ("4", "Cable", "m", None)]
    assert got[0].original_row == {"Name": "Pump", "Name_1": "Backup", "Unit": "pcs", "Price": "100"}


def test_supplier_name_patterns(spark):
    texts = ["Номенклатура клиента = КЕМИКС", "поставщик: «Альфа»", "ООО Ромашка", "ничего"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(G.supplier_name(F.col("t")).alias("n")).collect()] == ["КЕМИКС", "Альфа", "ООО", None]


def test_single_table_and_sheet_choice(spark):
    df = cells(spark, [["код", "Номенклатура клиента", "Наименование"], ["1", "Насос А", "x"], ["2", "Насос Б", "y"]])
    assert sorted(r.raw_text for r in G.single_table_items(df).collect()) == ["Насос А", "Насос Б"]
    dense = cells(spark, [["a", "b"], ["1", "длинный текст"], ["2", "ещё текст"]])
    assert sorted(r.raw_text for r in G.single_table_items(dense).collect()) == ["длинный текст", "ещё текст"]
    sheets = spark.createDataFrame([("f", "b", 0, 0, "x"), ("f", "a", 0, 0, "x"), ("f", "c", 3, 0, None)], "file_id string, sheet string, row int, col int, value string")
    assert G.best_sheets(sheets).first().sheet == "a"


def test_column_letters(spark):
    df = spark.createDataFrame([("A",), ("z",), ("AA",), (" ab ",), (None,)], "l string")
    assert [r.i for r in df.select(G.column_index(F.col("l")).alias("i")).collect()] == [0, 25, 26, 27, None]


def test_text_cells(spark):
    texts = spark.createDataFrame([("f", '﻿a;b\n\n"x;y";"say ""hi"""\n1;2;3\n;z\n')], "file_id string, text string")
    got = {(r.row, r.col): r.value for r in grids.text_cells(texts).collect()}
    assert got == {(0, 0): "a", (0, 1): "b", (1, 0): "x;y", (1, 1): 'say "hi"', (2, 0): None, (2, 1): "z"}
    assert [(r.record, r.fields) for r in grids.wide_records(texts).collect()] == [(2, ["1", "2", "3"])]


def test_bars_line_breaks_and_late_delimiters(spark):
    texts = spark.createDataFrame([("bar", "a|b\n1|2"), ("quoted", 'n;m\n"x\ny";1\n'), ("late", "title " * 2000 + "\nx;y;z\n" * 3), ("none", None), ("empty", "")], "file_id string, text string")
    cells = {(r.file_id, r.row, r.col): r.value for r in grids.text_cells(texts).collect()}
    assert cells["bar", 1, 1] == "2" and cells["quoted", 1, 0] == "x\ny" and cells["quoted", 1, 1] == "1"
    assert not any(k[0] in ("none", "empty") for k in cells)
    assert grids.wide_records(texts).count() == 3


def test_grid_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Товар;Цена\nБолт;5\n", encoding="utf-8")
    (tmp_path / "two.txt").write_text("Товар|Цена\nГайка|7\n", encoding="utf-8")
    got = {(r.file_id, r.row, r.col): r.value for r in grids.read_grid_files(spark, str(tmp_path)).collect()}
    assert got["one.csv", 1, 0] == "Болт" and got["two.txt", 1, 1] == "7"


def test_catalog_files_with_two_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Наименование;Артикул;Вес;Прочее\n Насос ;A1;1,5;x\n;A2;1;x\n\"Труба; \"\"гнутая\"\"\nдлинная\";;нет;y\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("id\tname\tединица\tед.\nb1\tКлей\tкг\t\n", encoding="utf-8")
    got = {r.name: r for r in catalog_files.read_catalog(spark, str(tmp_path)).collect()}
    assert set(got) == {"Насос", 'Труба; "гнутая"\nдлинная', "Клей"}
    assert got["Насос"].weight_value == 1.5 and got["Насос"].article == "A1" and got["Насос"].product_id.startswith("prd_")
    assert got["Клей"].product_id == "b1" and got["Клей"].unit == "кг"
    (tmp_path / "c.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="no recognized columns"):
        catalog_files.read_catalog(spark, str(tmp_path))


def test_erp_records(spark):
    full = {
        "Ref_Key": "r1", "Description": "", "Наименование": " Подшипник ", "Бренд": {"Description": "SKF "}, "ЕдиницаИзмерения": {"Наименование": "шт"},
        "Родитель_Key": "c2", "Вес": "1,2", "Объем": "bad", "CustomField": "kept", "Code": 7,
    }
    rows = [full, {"Description": "x", "DeletionMark": True}, {"Description": "x", "IsFolder": True}, {"Description": "  "},
            {"Name": "orphan", "Родитель_Key": "00000000-0000-0000-0000-000000000000"}]
    pages = spark.createDataFrame([(json.dumps({"value": rows}),), (json.dumps({"d": {"results": [{"name": "b"}]}}),), (json.dumps([{"name": "c"}]),)], "body string")
    folders = spark.createDataFrame([("c1", "Root", None), ("c2", "Bearings", "c1")], "category_id string, name string, parent_id string")
    got = {r.name: r for r in erp.map_records(erp.page_rows(pages), C.category_paths(folders)).collect()}
    assert set(got) == {"Подшипник", "orphan", "b", "c"}
    bearing = got["Подшипник"]
    assert (bearing.product_id, bearing.brand, bearing.unit, bearing.code) == ("r1", "SKF", "шт", "7")
    assert (bearing.weight_value, bearing.volume_value, bearing.category_path) == (1.2, None, "Root/Bearings")
    assert bearing.extra == {"CustomField": "kept"}
    assert got["orphan"].category_path is None
    bare = erp.map_records(erp.page_rows(pages)).filter("name = 'Подшипник'").first()
    assert bare.category_path == "c2"


def test_category_cycles_end(spark):
    loop = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a")] + [(f"n{i}", f"N{i}", f"n{i - 1}") for i in range(15)], "category_id string, name string, parent_id string")
    got = {r.category_id: r.path for r in C.category_paths(loop).collect()}
    assert (got["a"], got["b"], len(got["n14"].split("/"))) == ("B/A", "A/B", 15)
    got = {r.category_id: r.path for r in C.category_paths(loop, max_depth=10).collect()}
    assert got["a"].split("/")[-1] == "A" and len(got["a"].split("/")) == 11
    assert got["n2"] == "N0/N1/N2" and len(got["n14"].split("/")) == 11


def test_lines_and_export(spark):
    rows = spark.createDataFrame([("7", 3.5, "", " Насос "), ("8", 1.0, "Труба", "x"), ("9", 2.0, "", "")], "id string, qty double, name string, note string")
    got = {r.line_id: r.raw_text for r in lines.tabular_lines(rows, rows.columns, F.lit(0)).collect()}
    assert got == {"7": "Насос", "8": "Труба", "9": "9"}
    results = spark.createDataFrame(
        [("1", "t", None, "auto_match", 0.995, "p", "Насос", None, "B", ["a", "b"], {"Номенклатура.1": "", "k": "v"}), ("2", "t", None, "no_match", None, None, None, None, None, [], None)],
        "line_id string, raw_text string, normalized_text string, status string, confidence double, best_product_id string, name string, article string, brand string, reasons array<string>, original_row map<string,string>",
    )
    out = {r.line_id: r.row for r in sinks.export_rows(results).collect()}
    assert out["1"]["Номенклатура.1"] == "Насос" and out["1"]["k"] == "v" and out["1"]["Уверенность"] == "100%" and out["1"]["Причины"] == "a; b"
    assert "Найдено в 1С (Товар)" not in out["1"]
    assert out["2"]["Статус"] == "Не найдено" and out["2"]["Уверенность"] == "—" and out["2"]["Исходный текст"] == "t"


def test_transform_hash_matches_sorted_json(spark):
    import hashlib

    raw = spark.createDataFrame([('Насос "А"/Б\n', None, "Grundfoss", "c1", "prd_old"), ("x", "", None, None, "native")], "name string, article string, brand string, code string, product_id string")
    got = {r.name: r for r in C.transform_items(raw).collect()}
    for name, r in got.items():
        body = json.dumps({"name": r.name, "article": r.article, "brand": r.brand, "code": r.code}, sort_keys=True, ensure_ascii=False)
        assert r.source_hash == hashlib.sha256(body.encode()).hexdigest()[:16]
    first = got['Насос "А"/Б\n']
    assert first.product_id == "prd_" + first.source_hash and first.normalized_brand == "grundfos"
    assert got["x"].product_id == "native"


def test_long_texts_go_to_python_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(grids, "MOST_FIELDS", 10)
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    texts = spark.createDataFrame([(i, 'a,"b\nc",d\n' * 20 + "1,2,3,4\n") for i in range(30)] + [(30, None), (31, "")], "file_id long, text string")
    values = grids.text_cells(texts, ",").groupBy("col", "value").count().collect()
    assert {(r.col, r.value, r["count"]) for r in values} == {(0, "a", 600), (1, "b\nc", 600), (2, "d", 600)}
    wide = grids.wide_records(texts, ",").collect()
    assert {(r.file_id, r.record, len(r.fields)) for r in wide} == {(i, 20, 4) for i in range(30)}
    long = spark.createDataFrame([(str(i), "x" * 1_000_000) for i in range(20)], "file_id string, text string").coalesce(1)

    def rows(batches):
        for batch in batches:
            yield grids.pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    assert max(r.n for r in long.mapInArrow(rows, "n long").collect()) < 10
