"""Dashboard questions over metric samples: counters, gauges, rates, histogram quantiles, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def labelled_counts(events: DataFrame, labels: list[str]) -> DataFrame:
    """Occurrences by labels."""
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def cumulative_histogram(values: DataFrame, value: str, bounds: tuple[float, ...], labels: list[str]) -> DataFrame:
    """labels, le, n: observations at or below each bound, the last being infinity.

    A null or NaN is at or below none; labels that have nothing else come with zeros.
    """
    ends = (*map(float, bounds), float("inf"))
    # One row per label set comes out of the aggregate; bounds are spread after it.
    wide = values.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(ends)])
    pairs = F.arrays_zip(F.array(*map(F.lit, ends)).alias("le"), F.array(*[f"b{i}" for i in range(len(ends))]).alias("n"))
    return wide.select(*labels, F.inline(pairs).alias("le", "n"))


def gauge_total(samples: DataFrame, series: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    """Sum of every series' last value."""
    last = samples.groupBy(*series).agg(F.max_by(value, at).alias("last"))
    return last.agg(F.sum("last").alias("total"), F.count("*").alias("n_series"))


def increases(samples: DataFrame, series: list[str], at: str = "ts", value: str = "value") -> DataFrame:
    """``samples`` with ``increase`` since the series' previous sample; a fall is a restart from zero. The first has none."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(at))
    return samples.withColumn("increase", F.when(before.isNull(), F.lit(None)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def rates(samples: DataFrame, series: list[str], by: list[str], window: str = "5 minutes", slide: str | None = None, at: str = "ts", value: str = "value") -> DataFrame:
    """window_start, ``by``, increase, rate (per second): increases summed by window.

    The edges of a window are not extrapolated.
    """
    seconds = F.window(at, window, slide or window)
    summed = increases(samples, series, at, value).filter(F.col("increase").isNotNull()).groupBy(seconds.alias("w"), *by).agg(F.sum("increase").alias("increase"))
    span = F.col("w.end").cast("double") - F.col("w.start").cast("double")
    return summed.select(F.col("w.start").alias("window_start"), *by, "increase", (F.col("increase") / span).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str], le: str = "le", count: str = "n") -> DataFrame:
    """The quantile of cumulative buckets: linear within the bucket that holds it, from 0 in the first.

    In the infinite bucket it is the largest finite bound. Without observations it is null.
    """
    order = Window.partitionBy(*by).orderBy(le)
    whole = Window.partitionBy(*by)
    placed = buckets.select(
        *by, F.col(le).alias("le"), F.col(count).cast("double").alias("n"), F.coalesce(F.lag(le).over(order), F.lit(0.0)).alias("low"), F.coalesce(F.lag(count).over(order), F.lit(0)).cast("double").alias("below"),
        (F.max(count).over(whole) * F.lit(q)).alias("rank"),
    )
    inside = placed.filter((F.col("n") >= F.col("rank")) & (F.col("rank") > F.col("below")))
    at = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below")))
    # Buckets with no observation of their own can reach the rank too: the first counts.
    return inside.groupBy(*by).agg(F.min_by(at, "le").alias("quantile"))


def quantile_of(buckets: Column, q: float) -> Column:
    """:func:`histogram_quantile` of an array of cumulative buckets (le, n) in order, infinity last."""
    rank = F.element_at(buckets, -1)["n"] * F.lit(q)
    below = lambda i, f, none: F.when(i > 0, F.get(buckets, i - 1)[f]).otherwise(F.lit(none))
    # Buckets with the one before them: the first that reaches the rank holds it.
    placed = F.transform(buckets, lambda b, i: F.struct(b["le"].alias("le"), b["n"].alias("n"), below(i, "le", 0.0).alias("low"), below(i, "n", 0.0).alias("below")))
    first = F.get(F.filter(placed, lambda b: (b["n"] >= rank) & (rank > b["below"])), F.lit(0))
    inside = first["low"] + (first["le"] - first["low"]) * (rank - first["below"]) / F.nullif(first["n"] - first["below"], F.lit(0.0))
    return F.when(first["le"] == float("inf"), first["low"]).otherwise(inside)


def ratio(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses); null if there are none."""
    return F.when(hits + misses > 0, hits / (hits + misses))
