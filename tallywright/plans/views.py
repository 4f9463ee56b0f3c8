"""Deterministic views of the service's data over the driver's tables, in DataFrames and in DuckDB SQL.

Derived by integer arithmetic on keys only, so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that job queries take as now.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(value: Column) -> Column:
    """A double's whole part as text."""
    return F.floor(value).cast("bigint").cast("string")


def orders_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base fields of one receipt per order."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        key.alias("rec_id"), F.concat(F.lit("https://img.example.com/"), key.cast("string"), F.lit(".jpg")).alias("file"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"),
        F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0")).alias("time"),
        F.concat(F.lit("POS"), (key % 7).cast("string")).alias("pos_id"), key.cast("string").alias("receipt_number"), F.col("o_orderpriority").alias("cashier"),
        whole(F.col("o_totalprice")).alias("total_money"), F.concat(F.lit("*"), (key * 31).cast("string"), F.lit("*")).alias("barcode"),
    )


ORDERS_FLAT = """
SELECT o_orderkey AS rec_id, 'https://img.example.com/' || o_orderkey || '.jpg' AS file, c_name AS name, c_mktsegment AS type, strftime(o_orderdate, '%d/%m/%Y') AS date,
       lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS time, 'POS' || (o_orderkey % 7) AS pos_id, o_orderkey::VARCHAR AS receipt_number,
       o_orderpriority AS cashier, floor(o_totalprice)::BIGINT::VARCHAR AS total_money, '*' || (o_orderkey * 31) || '*' AS barcode
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def perturbed(flat: DataFrame) -> DataFrame:
    """Predicted base fields: some blank, some in another form, some wrong, by key."""
    key = F.col("rec_id")
    change = {
        "name": F.when(key % 11 == 0, "").when(key % 13 == 0, F.upper("name")).otherwise(F.col("name")),
        "type": F.when(key % 17 == 0, F.lit("other")).otherwise(F.lower("type")),
        "date": F.when(key % 19 == 0, "").otherwise(F.col("date")),
        "receipt_number": F.when(key % 7 == 0, F.concat(F.lit("9"), F.col("receipt_number"))).otherwise(F.col("receipt_number")),
        "total_money": F.when(key % 5 == 0, F.concat(F.lit("0"), F.col("total_money"), F.lit(" đ"))).when(key % 23 == 0, F.lit("1")).otherwise(F.col("total_money")),
        "barcode": F.replace(F.col("barcode"), F.lit("*"), F.lit("")),
    }
    return flat.withColumns(change)


PERTURBED = """
SELECT * REPLACE (
  CASE WHEN rec_id % 11 = 0 THEN '' WHEN rec_id % 13 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN rec_id % 17 = 0 THEN 'other' ELSE lower(type) END AS type,
  CASE WHEN rec_id % 19 = 0 THEN '' ELSE date END AS date, CASE WHEN rec_id % 7 = 0 THEN '9' || receipt_number ELSE receipt_number END AS receipt_number,
  CASE WHEN rec_id % 5 = 0 THEN '0' || total_money || ' đ' WHEN rec_id % 23 = 0 THEN '1' ELSE total_money END AS total_money, replace(barcode, '*', '') AS barcode)
FROM flat
"""


def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per receipt line; some line totals have no digit. Equal lines are alike in all columns."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"),
        whole(F.col("p_retailprice")).alias("product_unit_price"), whole(F.col("l_quantity")).alias("product_quantity"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 14 == 0, "abc").otherwise(whole(F.col("l_extendedprice"))).alias("product_total_money"),
    )


PRODUCT_ROWS = """
SELECT l_orderkey AS rec_id, l_linenumber AS line, l_partkey::VARCHAR AS product_id, p_name AS product_name, floor(p_retailprice)::BIGINT::VARCHAR AS product_unit_price,
       floor(l_quantity)::BIGINT::VARCHAR AS product_quantity, CASE WHEN (l_orderkey + l_linenumber) % 14 = 0 THEN 'abc' ELSE floor(l_extendedprice)::BIGINT::VARCHAR END AS product_total_money
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
_ORDER = ("line", "product_id", "product_unit_price", "product_quantity", "product_total_money", "product_name")


def product_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id with its products, sorted."""
    sort = F.array_sort(F.collect_list(F.struct(*_ORDER)))
    return product_rows(spark, sf_dir).groupBy("rec_id").agg(sort.alias("lines")).select("rec_id", F.transform("lines", lambda p: F.struct(*[p[c].alias(c) for c in _ORDER if c != "line"])).alias("products"))


def predicted_products(products: Column, key: Column) -> Column:
    """Products as predicted: reversed, the first one lost, prices or names changed or written otherwise, by key."""
    changed = F.transform(products, lambda p, i: F.struct(
        p["product_id"].alias("product_id"), F.when((key + i) % 9 == 0, F.concat(p["product_name"], F.lit("."))).when((key + i) % 10 == 0, F.lit("")).otherwise(p["product_name"]).alias("product_name"),
        F.when((key + i) % 8 == 0, F.lit("1")).when((key + i) % 8 == 3, F.concat(F.lit("-"), p["product_unit_price"])).when((key + i) % 8 == 5, F.concat(F.lit("00"), p["product_unit_price"], F.lit(" đ"))).otherwise(p["product_unit_price"]).alias("product_unit_price"),
        F.concat(p["product_quantity"], F.lit(",00")).alias("product_quantity"), F.when(p["product_total_money"] == "abc", "n/a").otherwise(p["product_total_money"]).alias("product_total_money"),
    ))
    turned = F.when(key % 2 == 0, F.reverse(changed)).otherwise(changed)
    return F.when((key % 3 == 0) & (F.size(turned) > 1), F.slice(turned, 2, 1_000_000)).otherwise(turned)


def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, type, gold, pred: labels and predictions as record structs."""
    flat = orders_flat(spark, sf_dir)
    fields = [c for c in flat.columns if c not in ("rec_id", "file")]
    guessed = perturbed(flat).select(F.col("rec_id").alias("pred_id"), F.struct(*fields).alias("p"))
    lists = product_lists(spark, sf_dir).withColumnRenamed("rec_id", "list_id")
    joined = flat.join(guessed, flat["rec_id"] == guessed["pred_id"]).join(lists, flat["rec_id"] == lists["list_id"], "left")
    products = F.coalesce("products", F.array().cast(lists.schema["products"].dataType))
    return joined.select(
        "rec_id", "type", F.struct(*[F.col(c) for c in fields], products.alias("products")).alias("gold"),
        F.struct(*[F.col(f"p.{c}") for c in fields], predicted_products(products, F.col("rec_id")).alias("products")).alias("pred"),
    )


def job_status() -> Column:
    """An event's type as a job's status."""
    return F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "PROCESSING").when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "error", "FAILED_TRANSIENT").otherwise("FAILED_PERMANENT")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table out of events."""
    event, key, status = table(spark, sf_dir, "events"), F.col("event_id"), job_status()
    return event.select(
        key.cast("string").alias("job_id"), status.alias("status"), F.when(key % 3 != 0, F.concat(F.lit("h"), (key % 500).cast("string"))).alias("phash"),
        F.concat(F.lit("https://img.example.com/"), key.cast("string")).alias("image_url"), F.when((status == "SUCCEEDED") & (key % 5 != 0), F.col("props")).alias("result"),
        F.when((key % 4 == 0), F.lit("")).when(key % 4 == 1, F.lit("storage_transient")).alias("error_code"), F.lit(None).cast("string").alias("error_message"),
        F.col("ts").alias("created_at"), (F.col("ts") + F.make_interval(mins=(key % 60).cast("int"))).alias("updated_at"),
    )


JOBS = """
SELECT event_id::VARCHAR AS job_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED_TRANSIENT' ELSE 'FAILED_PERMANENT' END AS status,
       CASE WHEN event_id % 3 <> 0 THEN 'h' || (event_id % 500) END AS phash, 'https://img.example.com/' || event_id AS image_url,
       CASE WHEN event_type = 'purchase' AND event_id % 5 <> 0 THEN props END AS result, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'storage_transient' END AS error_code, NULL::VARCHAR AS error_message,
       ts AS created_at, ts + to_minutes(event_id % 60) AS updated_at
FROM events
"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters by event type, sampled every quarter of an hour, restarting each tenth day."""
    event = table(spark, sf_dir, "events")
    from pyspark.sql.window import Window

    binned = event.groupBy((F.floor(F.unix_timestamp("ts") / 900) * 900).alias("t"), "event_type").agg(F.count("*").alias("n"))
    epoch = F.floor(F.col("t") / 864_000)
    running = F.sum("n").over(Window.partitionBy("event_type", epoch).orderBy("t"))
    return binned.select(F.timestamp_seconds("t").alias("ts"), "event_type", running.alias("value"))


COUNTERS = """
SELECT to_timestamp(t)::TIMESTAMP AS ts, event_type, sum(n) OVER (PARTITION BY event_type, t // 864000 ORDER BY t)::BIGINT AS value
FROM (SELECT (floor(epoch(ts))::BIGINT // 900) * 900 AS t, event_type, count(*) AS n FROM events GROUP BY 1, 2)
"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to match, with a later upper-case double of every third."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.concat("n_name", F.lit(" STORE")).alias("canonical"))
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).select((F.col("k") + 1000).cast("int").alias("pos"), F.initcap("p_name").alias("canonical"))
    doubles = parts.filter(F.col("pos") % 3 == 0).select((F.col("pos") + 10_000_000).alias("pos"), F.upper("canonical").alias("canonical"))
    return names.select(F.col("pos").cast("int").alias("pos"), "canonical").unionByName(parts).unionByName(doubles)


DICTIONARY = """
SELECT n_nationkey::INT AS pos, n_name || ' STORE' AS canonical FROM nation
UNION ALL SELECT (k + 1000)::INT, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name)
UNION ALL SELECT (k + 10001000)::INT, upper(p_name) FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) WHERE (k + 1000) % 3 = 0
"""


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as read: exact, in another case, with a letter lost or doubled, or unknown, by key."""
    key = F.col("p_partkey")
    raw = F.when(key % 5 == 0, F.upper("p_name")).when(key % 5 == 1, F.concat(F.col("p_name"), F.substring("p_name", -1, 1))).when(key % 5 == 2, F.concat(F.substring("p_name", 1, 4), F.expr("substring(p_name, 6)"))).when(key % 35 == 3, F.concat(F.lit("zz"), key.cast("string"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(key.alias("probe_id"), raw.alias("raw"))


RAW_NAMES = """
SELECT p_partkey AS probe_id, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 1 THEN p_name || right(p_name, 1) WHEN p_partkey % 5 = 2 THEN left(p_name, 4) || substr(p_name, 6)
       WHEN p_partkey % 35 = 3 THEN 'zz' || p_partkey ELSE p_name END AS raw FROM part
"""


def now() -> Column:
    """:data:`NOW` as a column."""
    return F.lit(NOW).cast("timestamp")
