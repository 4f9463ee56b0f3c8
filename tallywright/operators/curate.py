"""Curating labelled records: alignment to the schema, filters, quality checks, dictionaries, stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywright.functions.text import fold_accents, strip, strip_then_compose, text
from tallywright.schemas import BASE_FIELDS, DEFAULTS, PRODUCT_FIELDS

CRITICAL_FIELDS = ("date", "receipt_number", "total_money")
ACCEPTED_STATUSES = ("verified_ok", "corrected")
#: Positions of known bad labels (fixed values).
EXCLUDED_POSITIONS = (161, 589, 699, 765, 778, 1183)
#: The record type that always has two test records.
SMALL_TYPE, SMALL_TEST = "coopxtra", 2


def stratum(kind: Column) -> Column:
    """The type in lower case, ``unknown`` if empty."""
    return F.lower(F.coalesce(F.when(kind != "", kind), F.lit("unknown")))


def align_schema(records: DataFrame) -> DataFrame:
    """Only the record's own fields and ``file``, products cut to theirs; null stays for absent keys."""
    products = F.transform("products", lambda p: F.struct(*[p[f].alias(f) for f in PRODUCT_FIELDS]))
    return records.select("file", *BASE_FIELDS, products.alias("products"))


def unknown_keys(raw: Column, known: tuple[str, ...] = (*BASE_FIELDS, "products")) -> Column:
    """Top-level keys of a JSON record that the closed schema doesn't have."""
    return F.array_except(F.coalesce(F.json_object_keys(raw), F.array()), F.array(*map(F.lit, known)))


def unknown_product_keys(raw: Column) -> Column:
    """Keys of any product that the closed schema doesn't have."""
    products = F.from_json(F.get_json_object(raw, "$.products"), "array<string>")
    keys = F.flatten(F.transform(F.coalesce(products, F.array()), lambda p: F.coalesce(F.json_object_keys(p), F.array())))
    return F.array_except(F.array_distinct(keys), F.array(*map(F.lit, PRODUCT_FIELDS)))


def closed_schema_valid(raw: Column) -> Column:
    """Whether the JSON text is an object with no key beyond the schema, at both levels, and text in every field."""
    fields = [F.get_json_object(raw, f"$.{f}") for f in BASE_FIELDS]
    flat = [~F.coalesce(f.rlike(r"^\s*[\[{]"), F.lit(False)) for f in fields]
    whole = F.coalesce(F.json_object_keys(raw).isNotNull(), F.lit(False))
    valid = whole & (F.size(unknown_keys(raw)) == 0) & (F.size(unknown_product_keys(raw)) == 0)
    for one in flat:
        valid = valid & one
    return valid


def abort_on_invalid(records: DataFrame, valid: Column, message: str = "invalid record") -> DataFrame:
    """``records``; reading any row that is not valid fails the job."""
    return records.withColumn("__ok", F.assert_true(valid, F.lit(message))).filter(F.col("__ok").isNull()).drop("__ok")


def accepted(records: DataFrame, statuses: tuple[str, ...] = ACCEPTED_STATUSES, include_all: bool = False) -> DataFrame:
    """Records of a verified status; null is not."""
    return records if include_all else records.filter(F.col("_verify_status").isin(*statuses))


def without_positions(records: DataFrame, positions: tuple[int, ...] = EXCLUDED_POSITIONS, column: str = "golden_index") -> DataFrame:
    """Records at none of ``positions``."""
    return records.filter(~F.col(column).isin(*positions))


def with_critical(records: DataFrame, fields: tuple[str, ...] = CRITICAL_FIELDS) -> DataFrame:
    """Records with text in every critical field."""
    condition = F.lit(True)
    for f in fields:
        condition = condition & (F.char_length(strip(text(F.col(f)))) > 0)
    return records.filter(condition)


def garbled(name: Column) -> Column:
    """A question mark next to a letter or digit: a lost character."""
    return name.rlike(r"[\p{L}\p{N}]\?|\?[\p{L}\p{N}]")


def quality_counts(records: DataFrame, products: str = "products") -> DataFrame:
    """garbled_products, hash_records (``###``), question_records (``???``) in one pass."""
    dump = F.to_json(F.struct(*records.columns))
    lost = F.size(F.filter(F.coalesce(F.col(products), F.array()), lambda p: F.coalesce(garbled(p["product_name"]), F.lit(False))))
    return records.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("garbled_products"), F.count_if(F.contains(dump, F.lit("###"))).alias("hash_records"), F.count_if(F.contains(dump, F.lit("???"))).alias("question_records"))


def type_distribution(records: DataFrame) -> DataFrame:
    """Records by type, most first; equal counts by type."""
    return records.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def dictionary_profile(records: DataFrame) -> DataFrame:
    """By type: records with a name, and products with one."""
    named = lambda c: F.char_length(strip(text(c))) > 0
    products = F.size(F.filter(F.coalesce("products", F.array()), lambda p: named(p["product_name"])))
    return records.groupBy("type").agg(F.count_if(named(F.col("name"))).alias("records_with_name"), F.coalesce(F.sum(products), F.lit(0)).alias("products_with_name"))


def spread_rank(rows: DataFrame, groups: list[str], bucket: Column, order: list[Column], output: str) -> DataFrame:
    """``rows`` with their place (from 1) within ``groups`` by ``order``, worked out bucket by bucket.

    ``bucket`` has to follow the order: no row comes before one of a smaller
    bucket. Rows are counted by bucket, the counts summed up along the buckets of
    a group, and each row's place is that sum and its place in its own bucket. So
    a group that holds most rows is ranked by as many tasks as it has buckets.
    """
    keyed = rows.withColumn("__part", bucket)
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    ahead = counts.select(*[F.col(g).alias(f"__group{i}") for i, g in enumerate(groups)], F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__ahead"))
    same = F.col("__part").eqNullSafe(F.col("__of"))
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__group{i}"))
    own = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order))
    placed = keyed.withColumn("__own", own).join(ahead, same)
    return placed.withColumn(output, F.col("__ahead") + F.col("__own")).select(*rows.columns, output)


def name_dictionary(names: DataFrame, column: str) -> DataFrame:
    """Distinct names, stripped and composed, in code point order with their place."""
    distinct = names.select(F.trim(F.col(column)).alias("raw")).distinct().select(strip_then_compose(F.col("raw")).alias("canonical")).filter(F.col("canonical") != "").distinct()
    # Composing runs on distinct names only; ranks go by the names' beginnings.
    ranked = spread_rank(distinct, [], F.substring("canonical", 1, 3), [F.col("canonical")], "rank")
    return ranked.select((F.col("rank") - 1).cast("int").alias("pos"), "canonical")


def stratified_split(records: DataFrame, key: str, seed: int = 42, ratio: float = DEFAULTS.test_ratio) -> DataFrame:
    """``records`` with ``stratum`` and ``split``: in each type the last floor(n * ratio) in seeded hash order are test.

    The small type has two at least. Sizes, disjointness and repeatability are
    given; who is in which part depends on the hash.
    """
    own = records.withColumn("stratum", stratum(F.col("type")))
    sizes = own.groupBy("stratum").agg(F.count("*").alias("__n"))
    wanted = F.floor(F.col("__n") * F.lit(ratio))
    wanted = F.when(F.col("stratum") == SMALL_TYPE, F.greatest(F.lit(SMALL_TEST), wanted)).otherwise(wanted)
    hashed = own.withColumn("__hash", F.xxhash64(F.lit(seed), key))
    # A type may hold most records: it is ranked in 65,536 parts of about equal size.
    placed = spread_rank(hashed, ["stratum"], F.shiftright("__hash", 48), [F.col("__hash"), F.col(key)], "__place").drop("__hash")
    return placed.join(sizes, "stratum").withColumn("split", F.when(F.col("__place") > F.col("__n") - wanted, "test").otherwise("dev")).drop("__n", "__place")


def split_overlap(split: DataFrame, key: str) -> DataFrame:
    """Keys in both parts: must be none."""
    part = lambda name: split.filter(F.col("split") == name).select(key)
    return part("dev").intersect(part("test"))


def split_metadata(split: DataFrame) -> DataFrame:
    """golden_index, type, split, file_url, verify_status; dev first, then test."""
    rows = split.select("golden_index", "type", "split", F.col("file").alias("file_url"), F.col("_verify_status").alias("verify_status"))
    return rows.filter(F.col("split") == "dev").unionByName(rows.filter(F.col("split") == "test"))


def seeded_sample(records: DataFrame, key: str, rows: int | None, seed: int = 42) -> DataFrame:
    """``rows`` records in seeded hash order if that is above zero and there are more; else all."""
    if not rows or rows < 0:
        return records
    return records.orderBy(F.xxhash64(F.lit(seed), key), key).limit(rows)


SKIPPED_KEYS = ("file", "type")


def normalized_record(kind: T.DataType, value: Column, skipped: tuple[str, ...] = SKIPPED_KEYS) -> Column:
    """A value of any depth with every text in it folded (see ``remove_marks``), keys named in ``skipped`` as they are at each level."""
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), fold_accents(value))
    if isinstance(kind, T.StructType):
        fields = [(value[f.name] if f.name in skipped else normalized_record(f.dataType, value[f.name], skipped)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalized_record(kind.elementType, x, skipped))
    return value


def normalized_records(records: DataFrame, skipped: tuple[str, ...] = SKIPPED_KEYS) -> DataFrame:
    """``records`` with all texts folded, in nested records and lists as well."""
    return records.select(*[(F.col(f"`{f.name}`") if f.name in skipped else normalized_record(f.dataType, F.col(f"`{f.name}`"), skipped)).alias(f.name) for f in records.schema.fields])


def head(records: DataFrame, order: str, rows: int) -> DataFrame:
    """The first ``rows`` by ``order``."""
    return records.orderBy(order).limit(rows)
