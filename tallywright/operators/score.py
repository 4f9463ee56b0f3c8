"""Scoring predictions against labels: greedy line alignment, field comparison, accuracy roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.functions.similarity import contained_ratio, ratio_possible, sequence_ratio
from tallywright.functions.text import apart, money_for_compare, quantity_for_compare, strip, text
from tallywright.schemas import BASE_FIELDS, SCORED_PRODUCT_FIELDS

MONEY_FIELDS = ("total_money", "product_unit_price", "product_total_money")
NAME_SIMILARITY = 0.95


def alias_products(products: Column, keep_discount: bool = False) -> Column:
    """Labelled products under the current names: the older name stands in where the key is absent."""

    def one(p: Column) -> Column:
        absent = lambda new, old: F.coalesce(p[new], p[old], F.lit(""))
        fields = [
            absent("product_id", "product_code").alias("product_id"), text(p["product_name"]).alias("product_name"), text(p["product_unit_price"]).alias("product_unit_price"),
            absent("product_quantity", "product_amount").alias("product_quantity"), text(p["product_total_money"]).alias("product_total_money"),
        ]
        return F.struct(*fields, *([text(p["product_discount_money"]).alias("product_discount_money")] if keep_discount else []))

    return F.transform(F.coalesce(products, F.array()), one)


#: What an equal key of two lines is worth.
_WORTH = {"price": 2, "total": 2, "name": 3}
#: A score and a place in one number: of equal scores the first place is the largest.
_PLACES = 1 << 32


def _line_keys(line: Column) -> list[Column]:
    """What lines are matched by: unit price and line total as money is compared, and the name; empty where there is nothing."""
    name = comparable(text(line["product_name"]))
    found = {"price": money_for_compare(line["product_unit_price"]), "total": money_for_compare(line["product_total_money"]), "name": name}
    return [value.alias(key) for key, value in found.items()]


def align_lines(gold: Column, pred: Column) -> Column:
    """For each labelled line in order, the index of the unused predicted line that scores best; null if none scores.

    Two points for an equal unit price, two for an equal line total, three for
    an equal name; the first of equal ones is taken. A choice uses its line up,
    so this is a fold over the labelled lines, which holds the lines that are
    left; of these only the ones with an equal key are scored. Every line is
    normalised once, and all stays within the row.
    """
    guesses = F.transform(pred, lambda line, i: F.struct(*_line_keys(line), i.cast("int").alias("at")))

    def choose(a: Column, line: Column) -> Column:
        equal = {key: (lambda guess, key=key: (line[key] == guess[key]) & (line[key] != "")) for key in _WORTH}
        fitting = F.filter(a["left"], lambda guess: equal["name"](guess) | equal["price"](guess) | equal["total"](guess))
        points = lambda guess: sum((F.when(equal[key](guess), worth).otherwise(0) for key, worth in _WORTH.items()), F.lit(0))
        best = F.array_max(F.transform(fitting, lambda guess: points(guess).cast("bigint") * _PLACES - guess["at"]))
        picked = F.pmod(-best, F.lit(_PLACES)).cast("int")
        # The choice is bound once, as the element of an array of one.
        return F.transform(F.array(picked), lambda at: F.struct(F.array_append(a["chosen"], at).alias("chosen"), F.when(at.isNull(), a["left"]).otherwise(F.filter(a["left"], lambda guess: guess["at"] != at)).alias("left")))[0]

    start = F.struct(F.array().cast("array<int>").alias("chosen"), guesses.alias("left"))
    return F.aggregate(F.transform(gold, lambda line: F.struct(*_line_keys(line))), start, choose, lambda a: a["chosen"])


def compare_field(field: Column, pred: Column, gold: Column) -> Column:
    """Whether a prediction is right; null where the label has nothing to compare with.

    An empty prediction is wrong, and one that is the label as it stands is
    right: nothing is worked out for these. All else is compared as
    :func:`comparable` makes it, money by digits, a barcode without asterisks, a
    quantity as a number. A product name also passes if it is similar enough:
    see :func:`settle_names`.
    """
    p, g = comparable(pred), comparable(gold)
    same = (
        F.when(field.isin(*MONEY_FIELDS), money_for_compare(p) == money_for_compare(g))
        .when(field == "barcode", F.replace(p, F.lit("*"), F.lit("")) == F.replace(g, F.lit("*"), F.lit("")))
        .when(field == "product_quantity", quantity_for_compare(p) == quantity_for_compare(g))
        .otherwise(p == g)
    )
    return F.when(gold == "", F.lit(None)).when(pred == "", False).when(pred == gold, True).otherwise(same)


def comparable(value: Column) -> Column:
    """Stripped and in lower case."""
    # Most texts have neither end to strip, which one look tells.
    return F.lower(F.when(value.rlike(r"^[!-~](?:.*[!-~])?\z"), value).otherwise(strip(text(value))))


def _doubtful_names(long: DataFrame) -> DataFrame:
    """``long`` with ``__p`` and ``__g`` left only where the ratio of matching blocks has to be worked out: unequal names that neither a bound nor one's being a part of the other settles."""
    p, g = F.col("__p"), F.col("__g")
    unequal = (F.col("field") == "product_name") & (~F.col("ok")) & (F.col("predicted") != "") & (p != "") & (g != "")
    part = F.when(unequal, contained_ratio(p, g))
    doubtful = unequal & part.isNull() & ratio_possible(p, g, NAME_SIMILARITY)
    return long.withColumns({"ok": F.col("ok") | F.coalesce(part > NAME_SIMILARITY, F.lit(False)), "__p": F.when(doubtful, p), "__g": F.when(doubtful, g)})


def _by_ratio(long: DataFrame) -> DataFrame:
    """``long`` with the doubtful names settled; each worker remembers the pairs it has worked out."""
    near = sequence_ratio(F.col("__p"), F.col("__g"))
    return long.withColumn("ok", F.col("ok") | F.coalesce(near > NAME_SIMILARITY, F.lit(False)))


def settle_names(long: DataFrame) -> DataFrame:
    """Product names that are not equal by the ratio of matching blocks; ``__p`` and ``__g`` are both sides as they are compared.

    Only names that are doubtful are handed to the Arrow function, all else is null there.
    """
    return _by_ratio(_doubtful_names(long))


def _judged(records: DataFrame, keep: list[str], gold: str, pred: str, kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per compared field of each record, or of those that are ``kept``; doubtful names, in ``__p`` and ``__g``, are still to be settled."""
    at = lambda side, name: F.col(f"{side}.{name}")
    lines = F.coalesce(at(gold, "products"), F.array())
    guesses = F.coalesce(at(pred, "products"), F.array())
    aligned = records.withColumn("__lines", lines).withColumn("__guesses", guesses).withColumn("__at", align_lines(F.col("__lines"), F.col("__guesses")))

    def both(field: str, p: Column, g: Column, i: Column) -> Column:
        return F.struct(i.cast("int").alias("idx"), F.lit(field).alias("field"), text(p).alias("predicted"), text(g).alias("expected"))

    base = F.array(*[both(f, at(pred, f), at(gold, f), F.lit(None)) for f in BASE_FIELDS])
    pairs = F.transform("__lines", lambda g, i: F.struct(g.alias("g"), F.get(F.col("__guesses"), F.get(F.col("__at"), i)).alias("p"), i.alias("i")))
    each = F.transform(pairs, lambda x: F.array(*[both(f, x["p"][f], x["g"][f], x["i"]) for f in SCORED_PRODUCT_FIELDS]))

    def judge(c: Column) -> Column:
        return F.struct(c["idx"].alias("idx"), c["field"].alias("field"), c["predicted"].alias("predicted"), c["expected"].alias("expected"), compare_field(c["field"], c["predicted"], c["expected"]).alias("ok"))

    # Fields without a label go before anything is worked out for them. All is judged within the array: in the rows, the
    # rules would be too long for a method that the JVM compiles, and every filter and column that asks would repeat them.
    judged = F.transform(F.filter(F.concat(apart(base), F.flatten(each)), lambda c: c["expected"] != ""), judge)
    long = aligned.select(*keep, F.explode(judged if kept is None else F.filter(judged, kept)).alias("c")).select(*keep, "c.*")
    unequal = (F.col("field") == "product_name") & ~F.col("ok") & (F.col("predicted") != "")
    return _doubtful_names(long.withColumns({"__p": F.when(unequal, apart(comparable(F.col("predicted")))), "__g": F.when(unequal, apart(comparable(F.col("expected"))))}))


def comparisons(records: DataFrame, keep: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row per compared field of each record: ``keep``, ``idx`` (null for base fields), field, predicted, expected, ok.

    ``gold`` and ``pred`` are record structs. Predicted lines that no labelled
    line takes are not compared, so extra predictions cost nothing.
    """
    return _by_ratio(_judged(records, keep, gold, pred)).drop("__p", "__g")


def mistakes(records: DataFrame, keep: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The rows of :func:`comparisons` that are wrong; those that are right by themselves are not handed to the Arrow function."""
    return _by_ratio(_judged(records, keep, gold, pred, lambda c: ~c["ok"])).filter(~F.col("ok")).drop("__p", "__g")


def accuracy(records: DataFrame, by: str | None = None, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """:func:`field_accuracy` of the comparisons of ``records``.

    Comparisons are counted first, and of the counts the distinct doubtful names
    are settled: rows stay in the JVM, however many there are.
    """
    keep = [by] if by else []
    counted = _judged(records, keep, gold, pred).groupBy(*keep, "field", "ok", "__p", "__g").agg(F.count("*").alias("n"))
    return field_accuracy(_by_ratio(counted), by, F.col("n"))


def mismatches(long: DataFrame, record: str) -> DataFrame:
    """Wrong comparisons: record, path (``product[i].field`` for lines), and both sides stripped."""
    path = F.when(F.col("idx").isNull(), F.col("field")).otherwise(F.format_string("product[%d].%s", "idx", "field"))
    return long.filter(~F.col("ok")).select(record, path.alias("path"), strip(F.col("expected")).alias("expected"), strip(F.col("predicted")).alias("predicted"))


def percent(correct: Column, total: Column) -> Column:
    """To one decimal; 0 if there is nothing."""
    return F.when(total > 0, F.round(correct / total * 100, 1)).otherwise(F.lit(0.0))


def field_accuracy(long: DataFrame, by: str | None = None, times: Column | None = None) -> DataFrame:
    """scope, ``by``, field, correct, total, pct: overall, and for each value of ``by``.

    The comparisons are counted once, by value and field; the overall counts are
    sums of those few rows. ``times`` tells how many comparisons a row stands for.
    """
    correct, total = (F.count_if("ok"), F.count("*")) if times is None else (F.sum(F.when(F.col("ok"), times).otherwise(0)), F.sum(times))
    if by is None:
        return long.groupBy("field").agg(correct.alias("correct"), total.alias("total")).withColumn("pct", percent(F.col("correct"), F.col("total")))
    kind = F.coalesce(F.when(F.col(by) != "", F.col(by)), F.lit("unknown"))
    counted = long.groupBy(kind.alias("__by"), "field").agg(correct.alias("c"), total.alias("t"))
    grouped = counted.groupingSets([["field"], ["__by", "field"]], "__by", "field").agg(F.grouping("__by").alias("__all"), F.sum("c").alias("correct"), F.sum("t").alias("total"))
    return grouped.select(F.when(F.col("__all") == 1, "overall").otherwise("by_type").alias("scope"), F.col("__by").alias(by), "field", "correct", "total", percent(F.col("correct"), F.col("total")).alias("pct"))


def macro_average(accuracy: DataFrame) -> DataFrame:
    """Mean of the rounded percentages, rounded again."""
    return accuracy.agg(F.round(F.avg("pct"), 1).alias("macro_avg"), F.count("*").alias("n_fields"))


def run_summary(records: DataFrame) -> DataFrame:
    """n, n_success, n_failed and the mean latency of those that are ok, from (status, latency_s)."""
    ok = F.col("status") == "ok"
    return records.agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_success"), (F.count("*") - F.count_if(ok)).alias("n_failed"), F.coalesce(F.round(F.avg(F.when(ok, F.round("latency_s", 2))), 2), F.lit(0.0)).alias("avg_latency_s"))


def experiment_row(accuracy: DataFrame, fields: tuple[str, ...] = ("name", "date", "receipt_number", "total_money", "product_name")) -> DataFrame:
    """One row with the percentages of ``fields``, 0 where a field is missing."""
    return accuracy.agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("pct"))), F.lit(0.0)).alias(f) for f in fields])


def replayed(records: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """``records`` with ``pred`` rebuilt from the labels and the mismatches: what a report without predictions allows.

    Names that passed as similar become equal by this, so lines may align otherwise.
    """
    wrong = long.filter(~F.col("ok")).groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct("idx", "field", "predicted")).alias("__wrong"))
    joined = records.join(wrong, F.col(key) == F.col("__key"), "left")
    known = lambda idx, field, value: F.coalesce(F.get(F.filter(F.coalesce("__wrong", F.array()), lambda m: m["idx"].eqNullSafe(idx) & (m["field"] == field)), F.lit(0))["predicted"], value)
    none = F.lit(None).cast("int")
    products = F.transform(F.coalesce("gold.products", F.array()), lambda g, i: F.struct(*[known(i.cast("int"), f, text(g[f])).alias(f) for f in SCORED_PRODUCT_FIELDS]))
    rebuilt = F.struct(*[known(none, f, text(F.col(f"gold.{f}"))).alias(f) for f in BASE_FIELDS], products.alias("products"))
    return joined.withColumn("pred", rebuilt).drop("__key", "__wrong")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__place", place).filter(F.col("__place") == 1).drop("__place")


def join_by_file(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with their labels by ``file``: of labels with one file the last by ``golden_index`` counts, predictions without are left out."""
    return predictions.join(latest_by(gold, ["file"], ["golden_index"]), "file")


def next_run(log: DataFrame, budget: int = 3) -> dict:
    """Number of the next experiment, and why it may not run: the budget is spent or a final run locked the log.

    ``log`` (run, final) has a row for each run so far.
    """
    row = log.agg(F.count("*").alias("n"), F.coalesce(F.max("final"), F.lit(False)).alias("locked")).first()
    refusal = "locked" if row["locked"] else "budget" if row["n"] >= budget else None
    return {"run": row["n"] + 1, "refusal": refusal}
