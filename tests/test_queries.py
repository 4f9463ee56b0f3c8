"""Registered queries against their SQL, and what that SQL leaves out."""

import os
import random

import duckdb
from pyspark.sql import functions as F

from tallywright.functions.similarity import edit_score
from tallywright.operators import match, metrics, score
from tallywright.plans import registry
from tallywright.schemas import PRODUCT_FIELDS

SMALL = "/root/testdata/sf0.001"


def by_sql(name, folder=SMALL):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{file}')")
    return con.execute(registry.oracle_sql()[name])


def test_histograms_equal_their_sql(spark):
    for name in ("histogram", "histogram_quantile_p95"):
        found = by_sql(name)
        columns = [c[0] for c in found.description]
        assert sorted(map(tuple, registry.queries()[name](spark, SMALL).select(columns).collect())) == sorted(found.fetchall()), name


def test_histogram_of_nulls_and_nan(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None)], "kind string, value double")
    found = metrics.cumulative_histogram(rows, "value", (0.5, 1.0), ["kind"]).collect()
    inf = float("inf")
    assert sorted(map(tuple, found)) == [("a", 0.5, 0), ("a", 1.0, 1), ("a", inf, 1), ("b", 0.5, 0), ("b", 1.0, 0), ("b", inf, 0)]
    assert metrics.histogram_quantile(spark.createDataFrame(found), 0.95, ["kind"]).filter(F.col("kind") == "b").count() == 0


def test_similar_names_of_the_tables(spark):
    names = [("old widget", "cold widget", True), ("cold widget", "old widget", True), ("old gizmo", "cold gizmo", False), ("old widget", "old widget.", True)]
    rows = [("product_name", g, p, g, p, False, ok) for p, g, ok in names]
    long = spark.createDataFrame(rows, "field string, expected string, predicted string, __g string, __p string, ok boolean, due boolean")
    assert all(r["ok"] == r["due"] for r in score.settle_names(long).collect())


def test_names_of_lists_in_no_order(spark):
    """Records whose products come in another order each time they are worked out, as after a shuffle, keep their matches."""
    names = [f"{x} apple juice" for x in ("red", "green", "blue", "white", "black", "brown", "grey", "pink")]
    kinds = dict.fromkeys(PRODUCT_FIELDS, "string")

    def shuffled(key):
        return [{**dict.fromkeys(PRODUCT_FIELDS, ""), "product_name": n} for n in random.SystemRandom().sample(names, len(names))]

    lists = F.udf(shuffled, f"array<struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>>").asNondeterministic()
    base = [F.lit("").alias(c) for c in ("name", "type", "date", "time", "pos_id", "receipt_number", "cashier", "total_money", "barcode")]
    records = spark.range(20).withColumn("products", lists("id")).select("id", F.struct(*base, "products").alias("record"))
    entries = spark.createDataFrame([(i, n.title()) for i, n in enumerate(names)], "pos int, canonical string")
    for r in match.postprocessed(records, entries, entries, scorer=edit_score).collect():
        assert sorted(str(p["product_name"]) for p in r["record"]["products"]) == sorted(n.title() for n in names)
