"""Scoring: what is worked out in the JVM, and that it is what the plain rules give."""

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from tallywright.functions import similarity, text
from tallywright.operators import match, score
from tallywright.plans import views
from tallywright.schemas import PRODUCT_FIELDS

SMALL = "/root/testdata/sf0.001"


def record(**fields):
    base = dict.fromkeys(score.BASE_FIELDS, "")
    return {**base, "products": [], **fields}


RECORD = "struct<name:string,type:string,date:string,time:string,pos_id:string,receipt_number:string,cashier:string,total_money:string,barcode:string,products:array<struct<product_id:string,product_name:string,product_unit_price:string,product_quantity:string,product_total_money:string>>>"


def test_accuracy_counts_before_arrow(spark):
    """Comparisons are counted in the JVM, in methods that it compiles, and only distinct doubtful names go to the Arrow function."""
    found = score.accuracy(views.scored_records(spark, SMALL), by="type")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("ArrowEvalPython") : plan.index("Generate explode")]
    code = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(code):
            score.accuracy(views.scored_records(spark, SMALL), by="type").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code.getvalue())]
    assert sizes and max(sizes) < 8000
    rnd = random.Random(7)
    pick = lambda *values: rnd.choice(values)
    name = lambda: "".join(rnd.choice("ab ") for _ in range(rnd.choice((3, 30, 45, 230))))
    rows = []
    for i in range(150):
        names = [name() for _ in range(rnd.randrange(4))]
        line = lambda n: {"product_id": pick("", "1"), "product_name": n, "product_unit_price": pick("", "10", "-10", "010\n", "٣", "x", "10\n"), "product_quantity": pick("", "5", "5,00", "5.", "5\n", "05", "1e3", "0.5", ".50", "123456789012345678", "5.0.0"), "product_total_money": pick("", "0", "00", "abc", "7", "7 đ")}
        change = lambda n: pick(n, n + ".", "x" + n, n[1:], n.upper(), n.replace("ab", "ba", 1), " " + n)
        rows.append((i, pick("a", "", None), record(name=pick("", "Shop"), products=[line(n) for n in names]), record(name=pick(" ", "SHOP\x1f", "shop"), barcode="*", products=[line(change(n)) for n in names])))
    frame = spark.createDataFrame(rows, f"rec int, kind string, gold {RECORD}, pred {RECORD}")
    long = score.comparisons(frame, ["rec", "kind"]).cache()
    for r in long.filter("field = 'product_name' and predicted <> ''").collect():
        assert r["ok"] == (similarity.block_ratio(r["predicted"].strip().lower(), r["expected"].strip().lower()) > 0.95), r
    order = lambda df: sorted(map(str, df.collect()))
    assert order(score.accuracy(frame, by="kind")) == order(score.field_accuracy(long, by="kind")) and order(score.accuracy(frame)) == order(score.field_accuracy(long))
    assert order(score.mistakes(frame, ["rec", "kind"])) == order(long.filter("not ok"))
    assert 10 < long.filter("not ok").count() < long.count() - 10


def test_numbers_told_by_one_look(spark):
    """Plain numbers have the form that the longer way gives them."""
    raw = ["7", "70", "007", "0", "00", "7\n", "\n7", "7 ", "-7", "٣٤", "7x", "", "5,00", "5.", "5,", "5.10", "5.0.0", "5\r\n", "999999999999999", "9999999999999999", "1234567890123456789", "10,0000"]
    rows = spark.createDataFrame([(v,) for v in raw], "v string").select("v", text.money_for_compare(F.col("v")).alias("money"), text.quantity_for_compare(F.col("v")).alias("same"), text.quantity_for_compare(F.concat(F.lit("#"), "v")).alias("long")).collect()
    for r in rows:
        kept = re.sub(r"[^\d]", "", r["v"]).lstrip("0")
        assert r["money"] == ("" if r["v"] == "" else kept or "0"), r
        assert r["v"] == "" or r["same"] == r["long"], r


def test_postprocessed_moves_no_records(spark, monkeypatch):
    """Results of few names go to the records, which stay where they are; those of many meet them by joins, with the same result."""
    kinds = dict.fromkeys(PRODUCT_FIELDS, "string")
    names = ["Milk Tea Bottle", "MILK TEA BOTTLE", "milk tea botle", "no such thing", "", None, "Othe"]
    lines = lambda i: [{**dict.fromkeys(PRODUCT_FIELDS, "1"), "product_name": names[(i + k) % len(names)]} for k in range(i % 4)]
    rows = [(i, record(name=names[i % 7], products=lines(i)) if i % 5 else None) for i in range(30)]
    frame = spark.createDataFrame(rows, f"id int, record {RECORD.split('products:')[0]}products:array<struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>>>")
    entries = spark.createDataFrame([(0, "Milk Tea Bottle"), (1, "Other")], "pos int, canonical string")
    few = match.postprocessed(frame, entries, entries, scorer=similarity.edit_score)
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(match, "SENT_ENTRIES", 1)
    many = match.postprocessed(frame, entries, entries, scorer=similarity.edit_score)
    assert "hashpartitioning" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert {p["product_name"] for r in few.collect() if r["record"] for p in r["record"]["products"]} == {"Milk Tea Bottle", "Other", "no such thing", ""}
