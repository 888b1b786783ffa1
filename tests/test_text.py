import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricewright.functions import numbers, text


def values(spark, expr, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def check(spark, expr, cases):
    assert values(spark, expr, list(cases)) == list(cases.values())


def test_normalize(spark):
    check(spark, text.normalize, {"  ΦΈΤΑ   Δωδώνης ": "φετα δωδωνης", "Crème brûlée": "creme brulee", "é": "e", "": "", None: None})


@pytest.mark.parametrize("name", ["ΚΡΈΜΑ  γάλακτος", "Straße é", "A\tB"])
def test_literal_matches_column(spark, name):
    assert values(spark, text.normalize, [name]) == [text.normalize_literal(name)]


def test_size(spark):
    cases = {
        "Lacta Γκοφρέτα 28,5γρ": (28.5, "g"),
        "Coca-Cola 1,5lt": (1.5, "l"),
        "Nirvana Παγωτό 313g (420ml)": (420.0, "ml"),
        "Nirvana 313γρ./420ml": (420.0, "ml"),
        "Pampers Pants No7 38τεμ": (7.0, "no"),
        "Pampers Pants Νο6 13-19kg 42τεμ": (6.0, "no"),
        "Pampers 5No": (5.0, "no"),
        "MELISSA Σπαγγέτι Χωρίς γλουτένη 400g": (400.0, "g"),
        "Χαρτί 12 ρολά": (12.0, "τεμ"),
        "plain": None,
        None: None,
    }
    got = values(spark, text.size, list(cases))
    assert [x and (x["value"], x["unit"]) for x in got] == list(cases.values())


def test_size_profiles_differ(spark):
    assert values(spark, lambda c: text.size(c, "catalogue"), ["Χαρτί 12 ρολά", "Pampers No7"]) == [None, None]


def test_pack(spark):
    check(spark, text.pack_count, {"Coca-Cola 2x1lt": 2, "Lacta 3x28,5γρ": 3, "Nirvana 420ml": 1, "COCA-COLA 5x330ml +1 Δώρο": 6, "99x1l": 1, "6 Χ 23.5gr": 6, "": 1})


def test_manufacturer(spark):
    cases = {
        "Lacta Nuts σοκολάτα": "lacta", "lactacyd fresh": None, "Rio Mare τόνος": "rio-mare", "Kri-Kri γιαούρτι": "kri-kri", "My Gusto Lacta": None,
        "O.B. Pro Comfort": None, "Το Lacta 100g": "lacta", "μεγάλη νέα Lacta": None, "ΔΩΔΩΝΗ Φέτα": "dodoni", "": None,
    }
    check(spark, text.manufacturer, cases)


def test_tokens_and_key(spark):
    rows = [(1, "Lacta Γκοφρέτα Φουντούκι 31γρ"), (2, "Coca-Cola 2x1,5lt"), (3, "Δωδώνη Γιαούρτι Στραγγιστό 2% 200g"), (4, "Unknown 5g")]
    got = {r["i"]: r for r in text.with_features(spark.createDataFrame(rows, "i int, name string")).collect()}
    assert got[1]["variant_tokens"] == ["foyntoyki", "gkofreta"]
    assert got[1]["canonical_key"] == "lacta:foyntoyki-gkofreta:31g:1"
    assert got[2]["canonical_key"] == "coca-cola:x:1.5l:2"
    assert "2%" in got[3]["variant_tokens"]
    assert got[4]["canonical_key"] is None


def test_prices(spark):
    cases = {"4,99 €": "4.990", "€4.99": "4.990", "1.234,56": "1234.560", "1,234.56": "1234.560", "1.234": "1.234", "12": "12.000", "x": None, "": None, None: None}
    assert [None if v is None else str(v) for v in values(spark, numbers.parse_price, list(cases))] == list(cases.values())


def test_percent(spark):
    check(spark, numbers.parse_percent, {"-23%": 23, "έκπτωση 5 %": 5, "150%": None, "no": None, None: None})


def test_dates(spark):
    d = datetime.date
    check(spark, lambda c: numbers.parse_date(c, 2026), {"28 Μαΐου 2026": d(2026, 5, 28), "28.05": d(2026, 5, 28), "28/05/2025": d(2025, 5, 28), "28-05-26": d(2026, 5, 28), "31.02": None, "3 ιουνίου": d(2026, 6, 3), "": None, None: None})
    got = values(spark, lambda c: numbers.parse_date_range(c, 2026), ["Από 28.05 έως 03.06", "28/05", "x"])
    assert [tuple(x) for x in got] == [(d(2026, 5, 28), d(2026, 6, 3)), (d(2026, 5, 28), None), (None, None)]


def test_small_numbers(spark):
    check(spark, numbers.comma_price, {"€1.234,50": Decimal("1234.50"), "2,5": Decimal("2.50"), "x": None})
    check(spark, numbers.promo_label, {" 1 + 1  free ": "1+1 δώρο", "Κέρδος  15%": "Κέρδος 15%", " ": None})
    one = spark.createDataFrame([("3", "5"), ("12", ""), (None, "5")], "w string, f string").select(numbers.compose_price(F.col("w"), F.col("f")).alias("y")).collect()
    assert [r["y"] for r in one] == [Decimal("3.05"), Decimal("12.00"), None]


def test_match_key(spark):
    check(spark, text.match_key, {"Μπύρα 330 ml (6x)": "μπυρα 330ml 6x", "Νερό 1,5 lt": "νερο 1 5l"})
