"""Scalar rules against their golden rows."""

import difflib

import pytest
from pyspark.sql import functions as F

from tallywright.functions import similarity, text

GOLDEN = {
    text.normalize_money: {"1.356.000": "1356000", "1,356,000": "1356000", "452.000 đ": "452000", "-24,000": "-24000", "": "", "(24,000)": "-24000", "24,000-": "24000", "VND 5,000": "5000", "abc": "", "12.50": "1250", None: ""},
    text.normalize_date: {"19/04/2026": "19/04/2026", "19-04-2026": "19/04/2026", "19.04.2026": "19/04/2026", "2026-04-19": "19/04/2026", "1/4/2026": "1/4/2026", "99/99/9999": "99/99/9999", " 19-04-2026 ": "19/04/2026"},
    text.normalize_quantity: {"10.000": "10", "10": "10", "0.47": "0.47", "1,254": "1.254", "4,378kg": "4378", "0,520": "0.52", "2.50": "2.5", "-1": "-1", "": "", "nan": None, "1e7": "10000000", "0.0005": "0.0005", "0.00001": "1e-05", "-0.00000125": "-1.25e-06", "0.0001": "0.0001", "0.001": "0.001", "1e18": "1000000000000000000", "1e23": "99999999999999991611392", "12345678.5": "12345678.5", "-123456789.25": "-123456789.25", "1e-100": "1e-100", "-0.0": "0", "1234567890123,5": "1234567890123.5"},
    text.money_for_compare: {"-24,000": "24000", "0059000": "59000", "abc": "0", "": ""},
    text.quantity_for_compare: {"10.000": "10", "4,378kg": "4.378", "100": "100", "1.000,5": "1.000.5"},
    text.fold_accents: {"Đặng  Văn": "dang van", "Élève Größe": "eleve große"},
    text.remove_marks: {"Đặng  Văn": "dang van", "Ǖber": "uber"},
    text.normalize_unicode: {" é ": "é", None: ""},
    text.normalize_type: {" WinMart ": "winmart"},
    text.hostname: {"https://m.EXAMPLE.net:80/x": "m.example.net", "http://u:p@a_b.example.com/x?y#z": "a_b.example.com", "nothing": None, "http://[::1]:8/": "::1"},
    text.basename: {"https://a/b/c.jpg": "c.jpg", "plain": "plain"},
    text.split_label: {"/a/dev_set.json": "dev", "/dev/test_set.json": "test", "gold.json": "full"},
}


@pytest.mark.parametrize("rule", GOLDEN, ids=lambda f: f.__name__)
def test_golden(spark, rule):
    rows = spark.createDataFrame(list(GOLDEN[rule].items()), "given string, expected string").select("given", "expected", rule(F.col("given")).alias("got")).collect()
    assert [(r["given"], r["got"]) for r in rows] == [(r["given"], r["expected"]) for r in rows]


def test_hosts(spark):
    urls = {"https://example.net/x": True, "https://m.EXAMPLE.net:80/x": True, "https://notexample.net/": False, "x": False}
    rows = spark.createDataFrame(list(urls.items()), "u string, e boolean").select("e", text.host_allowed(F.col("u"), F.array(F.lit("example.net"))).alias("g")).collect()
    assert all(r["e"] == r["g"] for r in rows)


def test_similarity():
    assert similarity.common_subsequence("kitten", "sitting") == 4 and similarity.common_subsequence("", "a") == 0
    assert similarity.weighted_ratio("aeon mall", "aeon mall") == 100 and similarity.weighted_ratio("", "a") == 0
    assert similarity.weighted_ratio("aeon mall tan phu", "aeon mall tân phú") >= 80
    assert similarity.weighted_ratio("tan phu aeon mall", "aeon mall tan phu") == 95
    assert similarity.weighted_ratio("mall", "the aeon mall of tan phu") == 90
    assert similarity.block_ratio("milk tea bottle 500ml.", "milk tea bottle 500ml") == difflib.SequenceMatcher(None, "milk tea bottle 500ml.", "milk tea bottle 500ml").ratio() > 0.95


def test_bounds(spark):
    row = spark.range(1).select(similarity.ratio_possible(F.lit("abcdefghij"), F.lit("abcdefghijk"), 0.95).alias("a"), similarity.ratio_possible(F.lit("abc"), F.lit("abcd"), 0.95).alias("b"), similarity.edit_score(F.lit("abcd"), F.lit("abxd")).alias("c")).first()
    assert row["a"] and not row["b"] and row["c"] == 75.0


def test_paths(spark):
    rows = spark.createDataFrame([("product[2].product_name",), ("date",)], "p string").select(text.mismatch_field(F.col("p")).alias("m")).collect()
    assert [tuple(r["m"]) for r in rows] == [(2, "product_name"), (None, "date")]
