"""Default dictionaries of the normalizer and the grid heuristics.

Order matters: replacements run longest key first and, among equal lengths,
in the order written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: must equal the published defaults for equal results ---

STOPWORDS = [
    "арт", "артикул", "арт.", "гост", "ту", "для", "на", "по", "из", "от", "до", "или", "при",
    "без", "под", "над", "через", "между", "новый", "новая", "новое", "россия", "производство",
    "серия", "тип", "марка", "модель",
]

BRAND_ALIASES = {
    "grundfoss": "grundfos", "грундфос": "grundfos", "грундфосс": "grundfos",
    "bosch": "bosch", "бош": "bosch",
    "makita": "makita", "макита": "makita",
    "hilti": "hilti", "хилти": "hilti",
    "knauf": "knauf", "кнауф": "knauf",
    "henkel": "henkel", "хенкель": "henkel",
    "legrand": "legrand", "легранд": "legrand",
    "schneider": "schneider electric", "шнайдер": "schneider electric",
    "abb": "abb", "абб": "abb",
    "danfoss": "danfoss", "данфосс": "danfoss",
    "valtec": "valtec", "валтек": "valtec",
    "rehau": "rehau", "рехау": "rehau",
    "технониколь": "technonikol", "техноникол": "technonikol",
    "isover": "isover", "изовер": "isover",
    "rockwool": "rockwool", "роквул": "rockwool",
    "пеноплэкс": "penoplex", "пеноплекс": "penoplex",
    "vaillant": "vaillant", "вайлант": "vaillant",
    "viega": "viega", "вьега": "viega",
    "uponor": "uponor", "юпонор": "uponor",
    "watts": "watts", "ваттс": "watts",
    "oventrop": "oventrop", "овентроп": "oventrop",
    "giacomini": "giacomini", "джакомини": "giacomini",
    "geberit": "geberit", "геберит": "geberit",
    "roca": "roca", "рока": "roca",
    "grohe": "grohe", "гроэ": "grohe",
}

UNIT_ALIASES = {
    "мм": "mm", "см": "cm", "м": "m", "мет": "m", "метр": "m", "метров": "m",
    "г": "g", "гр": "g", "грамм": "g", "кг": "kg", "килограмм": "kg",
    "т": "t", "тонн": "t", "тонна": "t",
    "мл": "ml", "л": "l", "литр": "l", "литров": "l",
    "шт": "pcs", "шт.": "pcs", "штук": "pcs", "штука": "pcs",
    "кв.м": "sqm", "м2": "sqm", "м²": "sqm", "кв.м.": "sqm",
    "вт": "w", "квт": "kw", "ва": "va", "ква": "kva", "в": "v", "а": "a",
    "бар": "bar", "атм": "atm", "мпа": "mpa",
    "об/мин": "rpm", "rpm": "rpm", "дюйм": "inch", '"': "inch",
    "куб.м": "cbm", "м3": "cbm", "м³": "cbm",
    "п.м": "lm", "п.м.": "lm", "пм": "lm",
    "комп": "set", "компл": "set", "комплект": "set",
    "пар": "pair", "пара": "pair",
}

# sizes, never the unit a product is sold by
DIMENSION_UNITS = ["mm", "cm"]

PACKAGING_KEYWORDS = [
    "упаковка", "упак", "пачка", "пак", "коробка", "кор", "мешок", "меш", "рулон", "рул",
    "бухта", "палета", "палетта", "паллет", "банка", "бан", "канистра", "кан", "баллон", "бал",
    "туба", "флакон", "ведро", "бутылка", "бут", "лист", "плита", "панель", "секция", "комплект",
]

PACKAGING_ALIASES = {
    "упак.": "упаковка", "упак": "упаковка", "уп.": "упаковка", "уп": "упаковка",
    "пач.": "пачка", "пач": "пачка",
    "кор.": "коробка", "кор": "коробка",
    "меш.": "мешок", "меш": "мешок",
    "рул.": "рулон", "рул": "рулон",
    "бан.": "банка", "бан": "банка",
    "кан.": "канистра", "кан": "канистра",
    "бал.": "баллон", "бал": "баллон",
    "бут.": "бутылка", "бут": "бутылка",
    "лист": "лист", "плита": "плита", "панель": "панель", "секция": "секция",
    "компл.": "комплект", "компл": "комплект",
}

ABBREVIATIONS = {
    "пвх": "поливинилхлорид",
    "пнд": "полиэтилен низкого давления",
    "пвд": "полиэтилен высокого давления",
    "жби": "железобетонные изделия",
    "жб": "железобетон",
    "гкл": "гипсокартон",
    "гвл": "гипсоволокно",
    "осб": "ориентированно стружечная плита",
    "дсп": "древесно стружечная плита",
    "мдф": "древесноволокнистая плита средней плотности",
    "рвд": "рукав высокого давления",
    "ппр": "полипропилен",
    "пп": "полипропилен",
    "кмц": "карбоксиметилцеллюлоза",
    "ввг": "провод ввг",
    "пвс": "провод пвс",
    "шввп": "провод шввп",
    "узо": "устройство защитного отключения",
    "автомат": "автоматический выключатель",
    "б/у": "бывший в употреблении",
    "б у": "бывший в употреблении",
    "нерж": "нержавеющая сталь",
    "нерж.": "нержавеющая сталь",
    "оцинк": "оцинкованный",
    "оц": "оцинкованный",
    "оц.": "оцинкованный",
    "г/к": "горячекатаный",
    "х/к": "холоднокатаный",
    "эл.": "электрический",
    "авт.": "автоматический",
    "гидр.": "гидравлический",
    "техн.": "технический",
    "пром.": "промышленный",
    "кр.": "круглый",
    "кр": "круглый",
    "прям": "прямоугольный",
    "возд": "воздуховод",
    "вент": "вентиляция",
    "шумоглушитель": "глушитель",
    "стакан": "прямая врезка",
    "ст": "сталь",
    "ст.": "сталь",
    "д.": "диаметр",
}

# Latin letters and the Cyrillic letters they are confused with
CONFUSABLE_LATIN = "aceopxykhtbm"
CONFUSABLE_CYRILLIC = "асеорхукнтвм"

# spreadsheet header -> catalog field
HEADER_FIELDS = {
    "код": "code", "артикул": "article", "наименование": "name",
    "полное наименование": "full_name", "бренд": "brand", "производитель": "manufacturer",
    "код производителя": "manufacturer_code", "единица": "unit", "единица измерения": "unit",
    "ед": "unit", "ед.": "unit", "категория": "category_path", "группа": "category_path",
    "упаковка": "packaging", "вес": "weight_value", "объем": "volume_value",
    "размер": "size_value", "ссылка": "onec_ref", "ref": "onec_ref", "id": "product_id",
    "product_id": "product_id", "code": "code", "article": "article", "name": "name",
    "full_name": "full_name", "brand": "brand", "manufacturer": "manufacturer",
    "manufacturer_code": "manufacturer_code", "unit": "unit", "category_path": "category_path",
    "packaging": "packaging", "weight_value": "weight_value", "volume_value": "volume_value",
    "size_value": "size_value", "onec_ref": "onec_ref",
}

# ERP JSON keys tried in order for each catalog field
ERP_FIELDS = {
    "name": ["Description", "Наименование", "Name", "name"],
    "full_name": ["НаименованиеПолное", "FullName", "full_name"],
    "article": ["Артикул", "Article", "article", "SKU"],
    "code": ["Code", "Код", "code"],
    "onec_ref": ["Ref_Key", "Ссылка_Key", "Ref", "id", "uid"],
    "brand": ["Бренд", "Brand", "brand"],
    "manufacturer": ["Производитель", "Manufacturer", "manufacturer"],
    "manufacturer_code": ["КодПроизводителя", "ManufacturerCode", "manufacturer_code"],
    "unit": ["ЕдиницаИзмерения", "Unit", "unit", "BaseUnit"],
    "category_id": ["Родитель_Key", "Parent_Key"],
    "packaging": ["Упаковка", "Packaging", "packaging"],
    "weight_value": ["Вес", "Weight", "weight"],
    "volume_value": ["Объем", "Volume", "volume"],
}
ERP_SYSTEM_FIELDS = ["DeletionMark", "IsFolder", "DataVersion", "Predefined", "PredefinedDataName"]
EMPTY_REFERENCE = "00000000-0000-0000-0000-000000000000"

# header words that tell what a spreadsheet column holds
NAME_WORDS = [
    "номенклатура", "наименование", "название", "товар", "продукт", "описание", "продукция",
    "позиция", "name", "product", "description", "item",
]
UNIT_WORDS = ["ед.изм", "ед. изм", "единица", "единицы", "unit", "измерен"]
PRICE_WORDS = ["цена", "стоимость", "price", "руб", "₽", "cost"]
ARTICLE_WORDS = ["артикул", "арт", "код", "sku", "article", "code", "id товара"]
SUPPLIER_WORDS = ["клиент", "поставщик", "заказчик", "покупатель", "supplier", "client"]
CATALOG_WORDS = ["каталог", "наш", "эталон", "база", "справочник", "catalog", "reference"]
TARGET_PHRASES = ["номенклатура клиента", "наименование клиента"]

# preferred columns of a tabular upload
LINE_TEXT_COLUMNS = [
    "Номенклатура клиента", "Номенклатура", "raw_text", "text", "name", "наименование",
    "Наименование",
]
LINE_ID_COLUMNS = ["line_id", "id", "№"]

# USD per million tokens: model -> (prompt, completion)
TOKEN_PRICES = {
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1-nano": (0.10, 0.40),
    "text-embedding-3-small": (0.02, 0.0),
    "text-embedding-3-large": (0.13, 0.0),
    "meta-llama/llama-4-maverick": (0.20, 0.20),
    "qwen/qwen3-235b-a22b": (0.20, 0.20),
    "rerank-multilingual-v3.0": (0.01, 0.0),
}
DEFAULT_TOKEN_PRICE = (0.50, 1.50)

# --- end of fixed values ---

_TABLES = {
    "brand": BRAND_ALIASES,
    "unit": UNIT_ALIASES,
    "packaging": PACKAGING_ALIASES,
    "abbreviation": ABBREVIATIONS,
    "stopword": {word: "" for word in STOPWORDS},
    "packaging_keyword": {word: "" for word in PACKAGING_KEYWORDS},
}


def longest_first(table: dict[str, str]) -> list[tuple[str, str]]:
    """Entries by falling key length, ties in written order."""
    return sorted(table.items(), key=lambda entry: -len(entry[0]))


def dictionary_frame(spark: SparkSession, tables: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The dictionaries as rows ``(kind, ord, source, target)``; ``ord`` is the order of use."""
    rows = []
    for kind, table in (tables or _TABLES).items():
        ordered = list(table.items()) if kind in ("stopword", "packaging_keyword") else longest_first(table)
        rows += [(kind, i, source, target) for i, (source, target) in enumerate(ordered)]
    return spark.createDataFrame(rows, "kind string, ord int, source string, target string")


def load_dictionaries(path: str) -> dict:
    """Read dictionaries from a YAML file (driver side; files of dictionary size)."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)
