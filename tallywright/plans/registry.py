"""The registered queries of the record operators, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import geometry, text
from tallywright.functions.similarity import edit_score
from tallywright.operators import adapter, chains, curate, jobs, match, metrics, score
from tallywright.operators.job_table import JobTable
from tallywright.plans import views
from tallywright.plans.views import now, table
from tallywright.schemas import DEFAULTS
from tallywright.sources import files, json_arrays
from tallywright.sources.shared import delete, shared_folder
from tallywright.streaming import jobs as streams
from tallywright.streaming import timed
from tallywright.streaming.consumer import Consumer

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return dict(_SQL)


# Scoring

_FLAT = f"WITH flat AS ({views.ORDERS_FLAT}), guess AS ({views.PERTURBED})"
_DIGITS = "regexp_replace(regexp_replace({0}, '[^0-9]', '', 'g'), '^0+', '')"
_MONEY = f"CASE WHEN {{0}} = '' THEN '' ELSE coalesce(nullif({_DIGITS}, ''), '0') END"


def _base_sql(select: str) -> str:
    """Comparisons of the base fields, null where the label is empty."""
    same = {
        "total_money": "coalesce(nullif({p}, ''), '0') = coalesce(nullif({g}, ''), '0')".format(p=_DIGITS.format("p.total_money"), g=_DIGITS.format("g.total_money")),
        "barcode": "replace(p.barcode, '*', '') = replace(g.barcode, '*', '')",
    }
    rows = [f"SELECT g.rec_id, g.type, '{f}' AS field, CASE WHEN g.{f} = '' THEN NULL WHEN p.{f} = '' THEN false ELSE {same.get(f, f'lower(trim(p.{f})) = lower(trim(g.{f}))')} END AS ok FROM flat g JOIN guess p USING (rec_id)" for f in score.BASE_FIELDS]
    return f"{_FLAT}, compared AS ({' UNION ALL '.join(rows)}), judged AS (SELECT * FROM compared WHERE ok IS NOT NULL) {select}"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = views.orders_flat(spark, sf_dir)
    fields = [c for c in flat.columns if c not in ("rec_id", "file")]
    guess = views.perturbed(flat).select("rec_id", F.struct(*fields).alias("p"))
    none = F.array().cast("array<struct<product_id:string,product_name:string,product_unit_price:string,product_quantity:string,product_total_money:string>>")
    records = flat.select("rec_id", "type", F.struct(*fields, none.alias("products")).alias("gold")).join(guess, "rec_id")
    return records.withColumn("pred", F.struct("p.*", none.alias("products")))


_PCT = "CASE WHEN count(*) > 0 THEN round(count_if(ok) / count(*) * 100, 1) ELSE 0 END"
_ROLL = f"count_if(ok)::BIGINT AS correct, count(*) AS total, {_PCT} AS pct FROM judged"

_LINES = f"""
WITH lines AS ({views.PRODUCT_ROWS}), gold AS (
  SELECT rec_id, *, row_number() OVER (PARTITION BY rec_id ORDER BY line, product_id, product_unit_price, product_quantity, product_total_money, product_name) - 1 AS i, count(*) OVER (PARTITION BY rec_id) AS n FROM lines
), changed AS (
  SELECT rec_id, n, product_id, CASE WHEN (rec_id + i) % 9 = 0 THEN product_name || '.' WHEN (rec_id + i) % 10 = 0 THEN '' ELSE product_name END AS product_name,
         CASE (rec_id + i) % 8 WHEN 0 THEN '1' WHEN 3 THEN '-' || product_unit_price WHEN 5 THEN '00' || product_unit_price || ' đ' ELSE product_unit_price END AS product_unit_price, product_quantity || ',00' AS product_quantity,
         CASE WHEN product_total_money = 'abc' THEN 'n/a' ELSE product_total_money END AS product_total_money,
         CASE WHEN rec_id % 2 = 0 THEN n - 1 - i ELSE i END - CASE WHEN rec_id % 3 = 0 AND n > 1 THEN 1 ELSE 0 END AS j
  FROM gold
)
"""


def _aligned_sql(pred: str, s: str = "") -> str:
    """Common table expressions that align the gold lines to those of ``pred`` as ``aligned`` with the suffix ``s``."""
    return f""", pairs{s} AS (
  SELECT g.rec_id, g.i, p.j,
         CASE WHEN {_MONEY.format('g.product_unit_price')} = {_MONEY.format('p.product_unit_price')} THEN 2 ELSE 0 END + CASE WHEN {_MONEY.format('g.product_total_money')} = {_MONEY.format('p.product_total_money')} THEN 2 ELSE 0 END + CASE WHEN lower(g.product_name) = lower(p.product_name) THEN 3 ELSE 0 END AS s
  FROM gold g JOIN {pred} p ON g.rec_id = p.rec_id AND p.j >= 0
), options{s} AS (
  SELECT rec_id, i, list({{'s': s, 'j': j}} ORDER BY s DESC, j) FILTER (WHERE s > 0) AS o FROM pairs{s} GROUP BY rec_id, i
), steps{s} AS (
  SELECT g.rec_id, list({{'o': coalesce(o, []), 'chosen': []::BIGINT[]}} ORDER BY g.i) AS l FROM gold g LEFT JOIN options{s} USING (rec_id, i) GROUP BY g.rec_id
), folded{s} AS (
  SELECT rec_id, list_reduce(l, lambda a, x: {{'o': x.o, 'chosen': list_append(a.chosen, coalesce(list_filter(x.o, lambda y: NOT list_contains(a.chosen, y.j))[1].j, -1))}}, {{'o': l[1].o, 'chosen': []::BIGINT[]}}).chosen AS chosen FROM steps{s}
), aligned{s} AS (
  SELECT g.rec_id, g.i, chosen[g.i + 1] AS j FROM gold g JOIN folded{s} USING (rec_id)
)
"""


_LINES += _aligned_sql("changed")


@query(f"{_LINES} SELECT rec_id, i AS line_index, nullif(j, -1) AS matched_index FROM aligned")
def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy alignment of labelled to predicted lines."""
    records = views.scored_records(spark, sf_dir)
    return records.select("rec_id", F.posexplode(score.align_lines(F.col("gold.products"), F.col("pred.products"))).alias("line_index", "matched_index"))


#: When a predicted field of a line (p) is equal to the labelled one (g). Of names that are similar it knows those with a dot only: not "old widget" and "cold widget", whose ratio is 20/21, so the operator accepts one line more at sf0.1.
_SAME_LINE = {
    "product_id": "p.product_id = g.product_id",
    "product_name": "(lower(p.product_name) = lower(g.product_name) OR (g.product_name || '.' = p.product_name AND 2.0 * length(g.product_name) / (2 * length(g.product_name) + 1) > 0.95))",
    "product_quantity": "regexp_replace(p.product_quantity, ',00$', '') = g.product_quantity",
    **{f: f"{_MONEY.format(f'p.{f}')} = {_MONEY.format(f'g.{f}')}" for f in ("product_unit_price", "product_total_money")},
}


def _product_sql(pred: str, s: str = "") -> str:
    """Comparisons of the product fields, null where the label is empty."""
    return " UNION ALL ".join(f"SELECT g.rec_id, '{f}' AS field, CASE WHEN g.{f} = '' THEN NULL WHEN coalesce(p.{f}, '') = '' THEN false ELSE {_SAME_LINE[f]} END AS ok FROM gold g JOIN aligned{s} a USING (rec_id, i) LEFT JOIN {pred} p ON p.rec_id = g.rec_id AND p.j = a.j AND a.j >= 0" for f in score.SCORED_PRODUCT_FIELDS)


def _all_sql(select: str, replayed: bool = False) -> str:
    """Comparisons of all fields; ``replayed``, against what labels and mismatches give for the predictions."""
    base = _base_sql("SELECT rec_id, type, field, ok FROM judged")
    product, more = _product_sql("changed"), ""
    if replayed:
        values = ", ".join(f"CASE WHEN g.{f} = '' THEN g.{f} WHEN coalesce(p.{f}, '') <> '' AND {_SAME_LINE[f]} THEN g.{f} ELSE coalesce(p.{f}, '') END AS {f}" for f in score.SCORED_PRODUCT_FIELDS)
        more = f", rebuilt AS (SELECT g.rec_id, g.i AS j, {values} FROM gold g JOIN aligned a USING (rec_id, i) LEFT JOIN changed p ON p.rec_id = g.rec_id AND p.j = a.j AND a.j >= 0)" + _aligned_sql("rebuilt", "_again")
        product = _product_sql("rebuilt", "_again")
    return f"{_LINES}{more}, base AS ({base}), types AS (SELECT rec_id, type FROM ({views.ORDERS_FLAT})), product AS ({product}), judged AS (SELECT * FROM base UNION ALL SELECT rec_id, type, field, ok FROM product JOIN types USING (rec_id) WHERE ok IS NOT NULL) {select}"


@query(_all_sql(f"SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE 'by_type' END AS scope, type, field, {_ROLL} GROUP BY GROUPING SETS ((field), (type, field))"))
def field_accuracy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of every field, overall and by record type: alignment, comparison and roll-up in one plan."""
    return score.accuracy(views.scored_records(spark, sf_dir), by="type")


@query(_base_sql(f"SELECT field, {_ROLL} GROUP BY field"))
def base_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the base fields."""
    return score.accuracy(_base(spark, sf_dir))


@query(_base_sql(f", a AS (SELECT field, {_ROLL} GROUP BY field) SELECT round(avg(pct), 1) AS macro_avg, count(*) AS n_fields FROM a"))
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy over the base fields."""
    return score.macro_average(score.accuracy(_base(spark, sf_dir)))


@query(_base_sql(f""", a AS (SELECT field, {_ROLL} GROUP BY field)
SELECT max(pct) FILTER (WHERE field = 'name') AS name, max(pct) FILTER (WHERE field = 'date') AS date, max(pct) FILTER (WHERE field = 'receipt_number') AS receipt_number, max(pct) FILTER (WHERE field = 'total_money') AS total_money, 0.0 AS product_name FROM a"""))
def experiment_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of the tracked fields in one row."""
    return score.experiment_row(score.accuracy(_base(spark, sf_dir)))


@query(_all_sql("SELECT field, count(*) AS n, 0::BIGINT AS unstripped FROM judged WHERE NOT ok GROUP BY field"))
def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong comparisons by field, read back from their paths."""
    wrong = score.mistakes(views.scored_records(spark, sf_dir), ["rec_id"])
    padded = F.col("expected").rlike(r"^\s|\s$") | F.col("predicted").rlike(r"^\s|\s$")
    # Counted by path first: of the few paths that there are the fields are read.
    paths = score.mismatches(wrong, "rec_id").groupBy("path").agg(F.count("*").alias("n"), F.count_if(padded).alias("unstripped"))
    return paths.groupBy(text.mismatch_field(F.col("path"))["field"].alias("field")).agg(F.sum("n").alias("n"), F.sum("unstripped").alias("unstripped"))


@query(_all_sql(f"SELECT field, {_ROLL} GROUP BY field", replayed=True))
def replayed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy as a report without predictions would give it."""
    records = views.scored_records(spark, sf_dir)
    return score.accuracy(score.replayed(records, score.mistakes(records, ["rec_id"]), "rec_id"))


@query("""SELECT count(*) AS n_total, count_if(event_type <> 'error')::BIGINT AS n_success, count_if(event_type = 'error')::BIGINT AS n_failed,
  coalesce(round(avg(round(value, 2)) FILTER (WHERE event_type <> 'error'), 2), 0) AS avg_latency_s FROM events""")
def eval_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes, failures and mean latency of a run."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "pipeline_failed").otherwise("ok").alias("status"), F.col("value").alias("latency_s"))
    return score.run_summary(rows)


@query(f"""{_FLAT}, gold AS (SELECT *, 'https://img.example.com/' || (rec_id // 2) || '.jpg' AS shared, rec_id AS golden_index FROM flat)
SELECT p.rec_id, g.receipt_number FROM guess p JOIN (SELECT shared, max_by(receipt_number, golden_index) AS receipt_number FROM gold GROUP BY shared) g ON p.file = g.shared""")
def predictions_with_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the last label of their file."""
    flat = views.orders_flat(spark, sf_dir)
    gold = flat.select(F.concat(F.lit("https://img.example.com/"), F.floor(F.col("rec_id") / 2).cast("string"), F.lit(".jpg")).alias("file"), "receipt_number", F.col("rec_id").alias("golden_index"))
    return score.join_by_file(flat.select("rec_id", "file"), gold).select("rec_id", "receipt_number")


# Normalising

_RAW_MONEY = "CASE l_linenumber % 5 WHEN 0 THEN '(' || l_partkey || ',000)' WHEN 1 THEN '-' || l_partkey || '.500' WHEN 2 THEN ' ' || l_partkey || '.000 đ' WHEN 3 THEN 'VND ' || l_partkey || ',000-' ELSE 'abc' END"


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_RAW_MONEY} AS raw FROM lineitem), b AS (SELECT *, regexp_replace(trim(raw), '[đĐ₫\\s]', '', 'g') AS bare FROM r), k AS (SELECT *, regexp_replace(bare, '[^0-9]', '', 'g') AS kept FROM b)
SELECT raw, CASE WHEN kept = '' THEN '' WHEN left(bare, 1) IN ('-', '(') THEN '-' || kept ELSE kept END AS money, coalesce(nullif(ltrim(kept, '0'), ''), '0') AS compared, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def normalize_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money texts as digits, with a sign, and as compared."""
    key = F.col("l_partkey").cast("string")
    turn = F.col("l_linenumber") % 5
    raw = F.when(turn == 0, F.concat(F.lit("("), key, F.lit(",000)"))).when(turn == 1, F.concat(F.lit("-"), key, F.lit(".500"))).when(turn == 2, F.concat(F.lit(" "), key, F.lit(".000 đ"))).when(turn == 3, F.concat(F.lit("VND "), key, F.lit(",000-"))).otherwise("abc")
    # Distinct texts are normalised once.
    rows = table(spark, sf_dir, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return rows.select("raw", text.normalize_money(F.col("raw")).alias("money"), text.money_for_compare(F.col("raw")).alias("compared"), "n")


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN ' ' || strftime(o_orderdate, '%d/%m/%Y') || ' ' ELSE 'n/a' END AS raw FROM orders)
SELECT o_orderkey, raw, regexp_replace(regexp_replace(trim(raw), '^(\\d{2})[-.](\\d{2})[-.](\\d{4})$', '\\1/\\2/\\3'), '^(\\d{4})-(\\d{2})-(\\d{2})$', '\\3/\\2/\\1') AS date FROM r""")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of four forms as DD/MM/YYYY."""
    day, turn = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(turn == 0, F.date_format(day, "dd-MM-yyyy")).when(turn == 1, F.date_format(day, "dd.MM.yyyy")).when(turn == 2, F.date_format(day, "yyyy-MM-dd")).when(turn == 3, F.concat(F.lit(" "), F.date_format(day, "dd/MM/yyyy"), F.lit(" "))).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("date", text.normalize_date(F.col("raw")))


#: Quantities that are small, large or long, and how they are stored and compared.
_ODD = (("0.0005", "0.0005"), ("0,00001", "1e-05"), ("12345678,5", "12345678.5"), ("-0.25", "-0.25"), ("", ""))
_TURN = f"CASE WHEN l_linenumber % 5 < 4 THEN l_linenumber % 5 ELSE 4 + l_partkey % {len(_ODD)} END"
_ODD_CASES = [" ".join(f"WHEN {4 + i} THEN '{pair[k].replace('-0.25', '0.25') if compared else pair[k]}'" for i, pair in enumerate(_ODD)) for k, compared in ((0, False), (1, False), (1, True))]


@query(f"""WITH r AS (SELECT {_TURN} AS turn, floor(l_quantity)::BIGINT AS q FROM lineitem)
SELECT CASE turn WHEN 0 THEN q || '.000' WHEN 1 THEN q || ',5' WHEN 2 THEN q || ',250kg' WHEN 3 THEN ' ' || q || ' ' {_ODD_CASES[0]} END AS raw, CASE turn WHEN 0 THEN q || '' WHEN 1 THEN q || '.5' WHEN 2 THEN q || '250' WHEN 3 THEN q || '' {_ODD_CASES[1]} END AS quantity,
  CASE turn WHEN 0 THEN q || '' WHEN 1 THEN q || '.5' WHEN 2 THEN q || '.25' WHEN 3 THEN q || '' {_ODD_CASES[2]} END AS compared, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def normalize_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as stored and as compared: the two rules differ on purpose."""
    q, turn = F.floor("l_quantity").cast("bigint").cast("string"), F.col("l_linenumber") % 5
    odd = F.get(F.array(*[F.lit(raw) for raw, _ in _ODD]), (F.col("l_partkey") % len(_ODD)).cast("int"))
    raw = F.when(turn == 0, F.concat(q, F.lit(".000"))).when(turn == 1, F.concat(q, F.lit(",5"))).when(turn == 2, F.concat(q, F.lit(",250kg"))).when(turn == 3, F.concat(F.lit(" "), q, F.lit(" "))).otherwise(odd)
    rows = table(spark, sf_dir, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return rows.select("raw", text.normalize_quantity(F.col("raw")).alias("quantity"), text.quantity_for_compare(F.col("raw")).alias("compared"), "n")


@query("SELECT c_custkey, lower(trim(' ' || c_mktsegment || ' ')) AS type, trim(' ' || (c_custkey % 24) || ':00 ') AS time FROM customer")
def normalize_type_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types in lower case, times stripped."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_type(padded(F.col("c_mktsegment"))).alias("type"), text.normalize_time(padded(F.concat((F.col("c_custkey") % 24).cast("string"), F.lit(":00")))).alias("time"))


@query("SELECT doc_id, trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'd')), '\\s+', ' ', 'g')) AS folded FROM documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without accents, natively for the closed set."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_accents(F.col("text")).alias("folded"))


@query("SELECT doc_id, trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'd')), '\\s+', ' ', 'g')) AS folded FROM documents")
def accent_fold_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without accents, for all of Unicode."""
    return table(spark, sf_dir, "documents").select("doc_id", text.remove_marks(F.col("text")).alias("folded"))


@query("SELECT doc_id, trim(nfc_normalize(text)) AS composed FROM documents")
def nfc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts composed and stripped."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_unicode(F.col("text")).alias("composed"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1))"


@query(f"SELECT page_id, {_HOST} AS host, ({_HOST} IN ('example.com', 'example.net') OR {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.net') AS allowed FROM pages")
def domain_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, and whether they are allowed."""
    allowed = F.array(F.lit("example.com"), F.lit("example.net"))
    return table(spark, sf_dir, "pages").select("page_id", text.hostname(F.col("url")).alias("host"), text.host_allowed(F.col("url"), allowed).alias("allowed"))


@query("""SELECT page_id, list_last(string_split(url, '/')) AS base, CASE WHEN regexp_matches(url, '(?i)\\.(jpe?g|png|webp|gif|bmp)$') THEN list_last(string_split(url, '/')) ELSE list_last(string_split(url, '/')) || '.jpg' END AS file_name FROM pages""")
def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last segments of URLs and download names."""
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"), text.basename(F.col("url"), True).alias("file_name"))


@query("""SELECT event_id, greatest(60.0, (epoch_ms(CASE WHEN ts < date_trunc('day', ts) + INTERVAL 2 HOUR THEN date_trunc('day', ts) + INTERVAL 2 HOUR ELSE date_trunc('day', ts) + INTERVAL 26 HOUR END) - epoch_ms(date_trunc('second', ts))) / 1000.0)::BIGINT AS seconds,
  'ocr:phash:h' || (event_id % 500) || ':psv:v1' AS cache_key, 'ocr:requeue:' || event_id AS requeue_key, strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM events""")
def schedule_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to the nightly run, cache and requeue keys, time stamps cut to the minute."""
    second = F.date_trunc("second", "ts")
    key = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id", text.seconds_until_hour(second).cast("bigint").alias("seconds"), text.cache_key(F.concat(F.lit("h"), (F.col("event_id") % 500).cast("string")), F.lit("v1")).alias("cache_key"),
        text.requeue_key(key).alias("requeue_key"), F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1, 16).alias("minute"),
    )


# Curation


@query("""SELECT doc_id, lang AS type, source FROM documents WHERE doc_id NOT IN (161, 589, 699, 765, 778, 1183) AND source IN ('src0', 'src1') AND length(trim(coalesce(text, ''))) > 0""")
def curated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by status, position and critical text."""
    rows = table(spark, sf_dir, "documents").withColumn("_verify_status", F.col("source"))
    rows = curate.without_positions(curate.accepted(rows, ("src0", "src1")), column="doc_id")
    return curate.with_critical(rows, ("text",)).select("doc_id", F.col("lang").alias("type"), "source")


@query(f"""{_FLAT} SELECT rec_id FROM guess WHERE date <> '' AND receipt_number <> '' AND total_money <> ''""")
def missing_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted records with all critical fields."""
    return curate.with_critical(views.perturbed(views.orders_flat(spark, sf_dir))).select("rec_id")


@query("""SELECT coalesce(sum(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]\\?|\\?[\\p{L}\\p{N}]')))), 0)::BIGINT AS garbled_products, count_if(contains(text, '###'))::BIGINT AS hash_records, count_if(contains(text, '???'))::BIGINT AS question_records FROM documents""")
def quality_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of damaged text."""
    rows = table(spark, sf_dir, "documents").select("text", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("product_name"))).alias("products"))
    return curate.quality_counts(rows)


@query("SELECT c_mktsegment AS type, count(*) AS n FROM customer GROUP BY 1")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by type."""
    return curate.type_distribution(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("type")))


@query(f"""{_FLAT}, lines AS ({views.PRODUCT_ROWS}), counts AS (SELECT rec_id, count(*) AS n FROM lines GROUP BY rec_id)
SELECT type, count_if(name <> '')::BIGINT AS records_with_name, coalesce(sum(n), 0)::BIGINT AS products_with_name FROM guess LEFT JOIN counts USING (rec_id) GROUP BY type""")
def dictionary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and products with names, by type."""
    rows = views.perturbed(views.orders_flat(spark, sf_dir)).join(views.product_lists(spark, sf_dir), "rec_id", "left")
    return curate.dictionary_profile(rows)


@query(
    "SELECT o_orderkey // 10000 AS part, (row_number() OVER (PARTITION BY o_orderkey // 10000 ORDER BY o_orderkey) - 1)::BIGINT AS place, o_orderkey, o_orderstatus || '\",[' AS mark,"
    " round(o_totalprice * 100)::BIGINT AS cents FROM orders"
)
def json_array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON arrays, a file for each 10,000 keys, read again by ranges, with strings that look like the end of an element."""
    path = f"{shared_folder(spark)}/arrays"
    row = F.struct("o_orderkey", F.concat("o_orderstatus", F.lit('",[')).alias("mark"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    arrays = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 10000).alias("part")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    arrays.select(F.to_json("rows").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = json_arrays.elements(spark, path).select("place", F.from_json("raw", "o_orderkey long, mark string, cents long").alias("r"))
    return found.select(F.floor(F.col("r.o_orderkey") / 10000).alias("part"), "place", "r.*")


@query("SELECT (row_number() OVER (ORDER BY canonical) - 1)::INT AS pos, canonical FROM (SELECT DISTINCT trim(p_name) AS canonical FROM part)")
def dictionary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in code point order."""
    return curate.name_dictionary(table(spark, sf_dir, "part"), "p_name")


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id < 4 THEN 'COOPXTRA' WHEN doc_id % 50 = 7 THEN '' ELSE lang END AS type FROM documents), r AS (SELECT coalesce(nullif(lower(type), ''), 'unknown') AS stratum, count(*) AS n FROM t GROUP BY 1),
w AS (SELECT *, CASE WHEN stratum = 'coopxtra' THEN greatest(2, floor(n * 0.3::DOUBLE)) ELSE floor(n * 0.3::DOUBLE) END AS wanted FROM r), both_ AS (SELECT count(*) AS overlap FROM (SELECT doc_id FROM t INTERSECT SELECT doc_id FROM t WHERE type = 'none'))
SELECT stratum, (n - wanted)::BIGINT AS dev, wanted::BIGINT AS test, overlap FROM w, both_""")
def stratified_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the split by stratum, one of them the small type, and how many keys are in both parts."""
    key = F.col("doc_id")
    typed = table(spark, sf_dir, "documents").select("doc_id", F.when(key < 4, "COOPXTRA").when(key % 50 == 7, "").otherwise(F.col("lang")).alias("type"))
    split = curate.stratified_split(typed, "doc_id")
    both = curate.split_overlap(split, "doc_id").agg(F.count("*").alias("overlap"))
    sizes = split.groupBy("stratum").agg(F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"))
    return sizes.join(F.broadcast(both), F.lit(True)).select("stratum", "dev", "test", "overlap")


@query("SELECT count(*) AS n, count(*) AS distinct_ids, count(*) AS known, count(*) AS again, true AS spread FROM (SELECT * FROM documents LIMIT 100)")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a hundred: all of them rows of the table, the same when drawn anew from other partitions, and not only from its start."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    drawn, anew = curate.seeded_sample(ids, "doc_id", 100), curate.seeded_sample(ids.repartition(7), "doc_id", 100)
    both = drawn.join(ids, "doc_id", "left_semi").withColumn("k", F.lit(1)).unionByName(anew.withColumn("k", F.lit(2)))
    met = both.groupBy("doc_id").agg(F.count_if(F.col("k") == 1).alias("one"), F.count_if(F.col("k") == 2).alias("two"))
    total = ids.agg(F.max("doc_id").alias("most"))
    counts = met.agg(F.sum("one").alias("n"), F.count_if(F.col("one") > 0).alias("distinct_ids"), F.sum("one").alias("known"), F.count_if((F.col("one") == 1) & (F.col("two") == 1)).alias("again"), F.max("doc_id").alias("last"))
    return counts.join(F.broadcast(total), F.lit(True)).select("n", "distinct_ids", "known", "again", (F.col("last") > F.col("most") / 2).alias("spread"))


_JSON = "'{\"name\": \"a\", \"' || CASE event_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'extra' WHEN 2 THEN 'barcode' ELSE 'type' END || '\": ' || CASE WHEN event_id % 5 = 0 THEN '[1]' ELSE '\"x\"' END || ', \"products\": [{\"' || CASE WHEN event_id % 7 = 0 THEN 'odd' ELSE 'product_id' END || '\": \"1\"}]}'"


@query("SELECT event_id, event_id % 4 <> 1 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM events")
def closed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether JSON records keep to the closed schema."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(_JSON.replace('\\"', '"')).alias("raw")).select("event_id", curate.closed_schema_valid(F.col("raw")).alias("valid"))


# Matching

_NAMES = f"""WITH entries AS ({views.DICTIONARY}), names AS (SELECT lower(canonical) AS lower, max_by(canonical, pos) AS canonical, min(pos) AS pos FROM entries GROUP BY 1), probes AS ({views.RAW_NAMES})"""


@query(f"{_NAMES} SELECT lower, canonical, pos FROM names")
def canonical_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names by lower-case form."""
    return match.canonical_names(views.dictionary(spark, sf_dir))


@query(f"{_NAMES} SELECT left(lower, 3) AS prefix3, (length(lower) // 4)::INT AS bucket, count(*) AS n, min(pos) AS first_pos FROM names GROUP BY 1, 2")
def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the dictionary and their sizes."""
    return match.block_index(match.canonical_names(views.dictionary(spark, sf_dir))).select("prefix3", "bucket", F.size("names").cast("bigint").alias("n"), F.col("names")[0]["pos"].alias("first_pos"))


_CANDIDATES = f"""{_NAMES}, lowered AS (SELECT DISTINCT lower(trim(raw)) AS lower FROM probes), candidates AS (
  SELECT p.lower, n.lower AS candidate, n.canonical, (length(n.lower) // 4 - length(p.lower) // 4)::INT AS step, n.pos FROM lowered p JOIN names n ON left(p.lower, 3) = left(n.lower, 3) AND abs(length(n.lower) // 4 - length(p.lower) // 4) <= 1)"""


@query(f"{_CANDIDATES} SELECT lower, candidate, step, pos FROM candidates")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that blocking leaves for each name."""
    probes = views.raw_names(spark, sf_dir).select(F.lower(text.strip(F.col("raw"))).alias("lower")).distinct()
    return match.block_candidates(probes, match.canonical_names(views.dictionary(spark, sf_dir))).select("lower", "candidate", "step", "pos")


_EDIT = "(100.0::DOUBLE * (greatest(length({0}), length({1})) - levenshtein({0}, {1})) / greatest(length({0}), length({1})))"


@query(f"""{_CANDIDATES}, scored AS (SELECT *, {_EDIT.format('lower', 'candidate')} AS score FROM candidates), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lower ORDER BY score DESC, step, pos) = 1),
alone AS (SELECT lower FROM lowered WHERE lower NOT IN (SELECT lower FROM candidates) AND lower NOT IN (SELECT lower FROM names)),
low AS (SELECT a.lower, n.canonical, {_EDIT.format('a.lower', 'n.lower')} AS score FROM alone a, names n QUALIFY row_number() OVER (PARTITION BY a.lower ORDER BY score DESC, n.pos) = 1),
found AS (SELECT lower, canonical, 100.0::DOUBLE AS score, 'exact' AS tier FROM lowered JOIN names USING (lower) UNION ALL
  SELECT lower, canonical, score, CASE WHEN score = 100 THEN 'exact' ELSE 'fuzzy_high' END FROM best WHERE score >= 80 AND lower NOT IN (SELECT lower FROM names) UNION ALL SELECT lower, canonical, score, 'fuzzy_low' FROM low WHERE score >= 60)
SELECT probe_id, raw, coalesce(canonical, trim(raw)) AS matched, coalesce(tier, 'miss') AS tier, coalesce(score, 0) AS score FROM probes LEFT JOIN found ON lower(trim(raw)) = lower""")
def fuzzy_match_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched with the native scorer."""
    return match.match_names(views.raw_names(spark, sf_dir), views.dictionary(spark, sf_dir), scorer=edit_score)


@query()
def fuzzy_match_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched with the composite scorer."""
    return match.match_names(views.raw_names(spark, sf_dir), views.dictionary(spark, sf_dir))


# Jobs

_JOBS, _NOW = f"WITH jobs AS ({views.JOBS})", f"TIMESTAMP '{views.NOW}'"


@query(f"{_JOBS} SELECT job_id, status FROM jobs WHERE (status = 'PROCESSING' AND updated_at < {_NOW} - INTERVAL 15 MINUTE) OR (status = 'PENDING' AND created_at < {_NOW} - INTERVAL 30 MINUTE)")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that the sweeper takes."""
    return views.jobs(spark, sf_dir).filter(jobs.stale(now())).select("job_id", "status")


@query(f"""{_JOBS}, s AS (SELECT *, (status = 'PROCESSING' AND updated_at < {_NOW} - INTERVAL 15 MINUTE) OR (status = 'PENDING' AND created_at < {_NOW} - INTERVAL 30 MINUTE) AS hit FROM jobs)
SELECT CASE WHEN hit THEN 'FAILED_TRANSIENT' ELSE status END AS status, coalesce(CASE WHEN hit THEN 'stale_timeout' ELSE error_code END, '-') AS code, count(*) AS n FROM s GROUP BY 1, 2""")
def sweeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states after a sweep."""
    return jobs.swept(views.jobs(spark, sf_dir), now()).groupBy("status", F.coalesce("error_code", F.lit("-")).alias("code")).agg(F.count("*").alias("n"))


_LATER = "TIMESTAMP '2024-04-10 00:00:00'"


@query(f"{_JOBS} SELECT status, count_if(status IN ('SUCCEEDED', 'FAILED_PERMANENT', 'FAILED_TRANSIENT') AND updated_at < {_LATER} - INTERVAL 90 DAY)::BIGINT AS deleted FROM jobs GROUP BY status")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs deleted by retention, by status."""
    return jobs.purge(views.jobs(spark, sf_dir), F.lit("2024-04-10 00:00:00").cast("timestamp"))[1]


@query(f"{_JOBS} SELECT count(*) AS n FROM jobs WHERE NOT (status IN ('SUCCEEDED', 'FAILED_PERMANENT', 'FAILED_TRANSIENT') AND updated_at < {_LATER} - INTERVAL 90 DAY)")
def retention_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that retention leaves."""
    return jobs.purge(views.jobs(spark, sf_dir), F.lit("2024-04-10 00:00:00").cast("timestamp"))[0].agg(F.count("*").alias("n"))


@query(f"""{_JOBS} SELECT job_id, CASE status WHEN 'SUCCEEDED' THEN 200 WHEN 'PENDING' THEN 202 WHEN 'PROCESSING' THEN 202 WHEN 'FAILED_PERMANENT' THEN 422 WHEN 'FAILED_TRANSIENT' THEN 503 ELSE 500 END AS http_status,
  CASE status WHEN 'FAILED_PERMANENT' THEN coalesce(nullif(error_code, ''), 'failed_permanent') WHEN 'FAILED_TRANSIENT' THEN coalesce(nullif(error_code, ''), 'failed_transient') END AS error_code FROM jobs""")
def status_http_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP answer of each job."""
    return views.jobs(spark, sf_dir).select("job_id", jobs.http_answer().alias("a")).select("job_id", "a.*")


@query(f"{_JOBS} SELECT job_id, 'succeeded_has_result' AS violation FROM jobs WHERE status = 'SUCCEEDED' AND result IS NULL")
def job_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a constraint."""
    return jobs.violations(views.jobs(spark, sf_dir)).select("job_id", "violation")


@query(f"""{_JOBS}, c AS (SELECT event_id::VARCHAR AS job_id, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END AS phash, CASE WHEN event_id % 6 = 0 THEN 'x' END AS error_code, CASE WHEN event_id % 9 = 0 THEN 'FAILED_TRANSIENT' ELSE 'SUCCEEDED' END AS changed FROM events WHERE event_id % 3 = 0)
SELECT j.job_id, CASE WHEN c.job_id IS NOT NULL THEN changed ELSE status END AS status, coalesce(c.phash, j.phash) AS phash, coalesce(c.error_code, j.error_code) AS error_code, CASE WHEN c.job_id IS NOT NULL THEN {_NOW} ELSE updated_at END AS updated_at FROM jobs j LEFT JOIN c USING (job_id)""")
def dynamic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after updates that leave what they don't name; some jobs have two, of which the later one counts."""
    key = F.col("event_id")
    changes = table(spark, sf_dir, "events").filter(key % 3 == 0).select(key.cast("string").alias("job_id"), F.lit("SUCCEEDED").alias("status"), F.when(key % 2 == 0, F.concat(F.lit("n"), key.cast("string"))).alias("phash"), F.when(key % 6 == 0, "x").alias("error_code"), F.lit(1).alias("turn"))
    again = changes.filter(F.col("job_id").cast("bigint") % 9 == 0).select("job_id", F.lit("FAILED_TRANSIENT").alias("status"), F.lit(None).cast("string").alias("phash"), F.lit(None).cast("string").alias("error_code"), F.lit(2).alias("turn"))
    return jobs.update(views.jobs(spark, sf_dir), changes.unionByName(again), now(), order="turn").select("job_id", "status", "phash", "error_code", "updated_at")


@query(f"""{_JOBS}, m AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS job_id FROM events)
SELECT coalesce(status, 'none') AS status, count(*) AS n, count(*) FILTER (WHERE status IN ('PENDING', 'PROCESSING')) AS runnable, count(*) FILTER (WHERE status IS NULL) AS orphans FROM m LEFT JOIN jobs USING (job_id) GROUP BY 1""")
def messages_with_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages by the status of their job, how many of them run, and how many have no job."""
    table_, key = views.jobs(spark, sf_dir), F.col("job_id")
    messages = table_.select(F.when(key.cast("bigint") % 5 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("job_id"), "image_url")
    met = messages.join(table_.select("job_id", "status"), "job_id").groupBy("status").agg(F.count("*").alias("n"))
    run = jobs.runnable(messages, table_).groupBy(F.col("status").alias("s")).agg(F.count("*").alias("r"))
    known = met.join(run, F.col("status") == F.col("s"), "left").select("status", "n", F.coalesce("r", F.lit(0)).alias("runnable"), F.lit(0).cast("bigint").alias("orphans"))
    none = jobs.orphans(messages, table_).agg(F.count("*").alias("n")).select(F.lit("none").alias("status"), "n", F.lit(0).cast("bigint").alias("runnable"), F.col("n").alias("orphans"))
    return known.unionByName(none.filter("n > 0"))


@query("""SELECT user_id::VARCHAR AS job_id, max_by(event_type, event_id) AS status, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY 1""")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's last state of its event log."""
    log = table(spark, sf_dir, "events").withColumn("job_id", F.col("user_id").cast("string"))
    return jobs.latest_state(log, "job_id", "event_type", "ts", "event_id")


_REQUEUES = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS requeue_count FROM events WHERE event_type = 'error'"


@query(f"SELECT event_id, user_id, requeue_count, CASE WHEN requeue_count > 3 THEN 'orphan_requeue_cap' ELSE 'requeue' END AS outcome FROM ({_REQUEUES})")
def requeue_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries counted along each job, beyond the cap orphaned."""
    attempts = table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    return jobs.requeues(attempts, "user_id", ["ts", "event_id"]).select("event_id", "user_id", "requeue_count", "outcome")


@query("""SELECT b AS minute_bin, n AS depth, CASE WHEN n >= 500 THEN 'reject' WHEN n >= 200 THEN 'warn' ELSE 'ok' END AS level, CASE WHEN n >= 500 THEN 429 ELSE 202 END AS http_status, CASE WHEN n >= 500 THEN 5 END AS retry_after
FROM (SELECT floor(epoch(ts))::BIGINT // 43200 AS b, count(*) AS n FROM events GROUP BY 1)""")
def backpressure_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission by queue depth."""
    binned = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp("ts") / 43_200).alias("minute_bin")).agg(F.count("*").alias("depth"))
    return binned.select("minute_bin", "depth", jobs.backpressure(F.col("depth")).alias("b")).select("minute_bin", "depth", "b.*")


@query(f"""SELECT accepted, http_status, count(*) AS n FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 429 WHEN {_HOST} IN ('example.com', 'example.net') OR {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.net' THEN 202 ELSE 400 END AS http_status, http_status = 202 AS accepted FROM pages) GROUP BY 1, 2""")
def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by verdict."""
    requests = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("image_url"))
    return jobs.admitted(requests, F.when(F.col("page_id") % 10 == 0, 500).otherwise(10)).groupBy("accepted", "http_status").agg(F.count("*").alias("n"))


@query("""SELECT code, permanent, count(*) AS n FROM (SELECT CASE WHEN event_id % 50 = 0 OR s >= 500 THEN 'storage_transient' WHEN s >= 400 THEN 'image_download_failed' WHEN z > 10485760 THEN 'image_too_large' END AS code, CASE WHEN code IS NOT NULL THEN code <> 'storage_transient' END AS permanent
FROM (SELECT event_id, 200 + (event_id % 4) * 100 AS s, event_id * 4000 AS z FROM events)) GROUP BY 1, 2""")
def download_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads by outcome."""
    key = F.col("event_id")
    judged = table(spark, sf_dir, "events").select(jobs.download_outcome(200 + (key % 4) * 100, key * 4000, key % 50 == 0).alias("o"))
    return judged.groupBy(F.col("o.error_code").alias("code"), F.col("o.permanent").alias("permanent")).agg(F.count("*").alias("n"))


@query("""SELECT http_status, CASE WHEN http_status IN (400, 413, 415, 422) THEN 'FAILED_PERMANENT' ELSE 'FAILED_TRANSIENT' END AS status, n FROM (SELECT 400 + (event_id % 30)::INT AS http_status, count(*) AS n FROM events GROUP BY 1)""")
def payload_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job status reported for rejected requests."""
    counts = table(spark, sf_dir, "events").groupBy((400 + F.col("event_id") % 30).cast("int").alias("http_status")).agg(F.count("*").alias("n"))
    return counts.select("http_status", jobs.payload_status(F.col("http_status")).alias("status"), "n")


@query("""WITH w AS (SELECT 'h' || (event_id % 700) AS phash, max_by(CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE props END, ts) AS payload FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 86400 SECOND GROUP BY 1), l AS (SELECT event_id, 'h' || (event_id % 700) AS phash FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT CASE WHEN payload IS NULL THEN 'miss' WHEN payload = 'bad' THEN 'drift' ELSE 'hit' END AS outcome, count(*) AS n FROM l LEFT JOIN w USING (phash) GROUP BY 1""")
def cache_hits_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache lookups by outcome."""
    at, key = F.lit("2024-01-20 00:00:00").cast("timestamp"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("h"), (key % 700).cast("string")).alias("phash"), F.lit("v1").alias("psv"), F.when(key % 9 == 0, "bad").otherwise(F.col("props")).alias("payload"))
    cache = rows.filter(F.col("ts") < at).select("phash", "psv", "payload", F.col("ts").alias("written_at"))
    found = jobs.cache_lookup(rows.filter(F.col("ts") >= at).select("event_id", "phash", "psv"), cache, at, F.get_json_object("payload", "$.k").isNotNull())
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


_CACHE_FOLD = """WITH RECURSIVE r AS (SELECT event_id % 700 AS phash, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts, event_id) AS i FROM events), walk AS (
  SELECT phash, event_id, i, false AS hit, t AS written FROM r WHERE i = 1
  UNION ALL SELECT r.phash, r.event_id, r.i, r.t < w.written + 86400000000, CASE WHEN r.t < w.written + 86400000000 THEN w.written ELSE r.t END FROM walk w JOIN r ON r.phash = w.phash AND r.i = w.i + 1)
SELECT phash, event_id, hit FROM walk"""
_BUCKET_FOLD = """WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), walk AS (
  SELECT user_id, event_id, i, true AS granted, 1::DOUBLE AS tokens, t FROM r WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END, t
  FROM (SELECT r.user_id, r.event_id, r.i, r.t, least(2::DOUBLE, w.tokens + (r.t - w.t) * 0.0001::DOUBLE) AS have FROM walk w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1))
SELECT user_id, event_id, granted FROM walk"""


@query(_CACHE_FOLD)
def cache_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each request finds an earlier one's entry alive."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 700).alias("phash"))
    return jobs.cached_by_order(rows, "phash", "ts", "event_id")


@query(_BUCKET_FOLD)
def token_bucket_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that get a token, by user."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return jobs.token_grants(rows, "user_id", "at", "event_id", rate=0.0001, burst=2.0)


@query("""SELECT event_id % 6 AS kind, CASE event_id % 6 WHEN 0 THEN 'yield' WHEN 1 THEN 'permanent' WHEN 2 THEN 'ok' WHEN 3 THEN 'gemini_exhausted' WHEN 4 THEN 'ok' ELSE 'gemini_exhausted' END AS result, CASE event_id % 6 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 4 ELSE 1 END AS calls, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of extractions by the answers they got."""
    answers = {0: [429, 200], 1: [404, 200], 2: [200], 3: [500, 503, 500, 500, 200], 4: [500, 0, 200], 5: [0, 0, 0, 0, 0]}
    kind = F.col("event_id") % 6
    given = F.when(kind == 0, F.array(*map(F.lit, answers[0])))
    for k in range(1, 6):
        given = given.when(kind == k, F.array(*map(F.lit, answers[k])))
    planned = table(spark, sf_dir, "events").select(kind.alias("kind"), jobs.retry_plan(given).alias("r"))
    return planned.groupBy("kind", F.col("r.result").alias("result"), F.col("r.calls").alias("calls")).agg(F.count("*").alias("n"))


@query("""SELECT 'p' || page_id AS file_name FROM pages WHERE page_id % 3 <> 0""")
def files_to_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not there yet."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_name"), "page_id")
    return jobs.to_download(files.select("file_name"), files.filter(F.col("page_id") % 3 == 0).select("file_name"))


_PERMANENT = (
    "extractor_invalid_json", "gemini_api_key_missing", "gemini_client_error", "image_download_failed", "image_too_large", "no_invoice_detected", "orphan_requeue_cap", "payload_too_large", "prompt_missing", "truncated_upload",
    "unsupported_media_type", "yolo_bad_output_shape", "yolo_degenerate_box",
)
_TRANSIENT = ("database_unavailable", "gemini_exhausted", "rate_limited_locally", "stale_timeout", "storage_transient", "triton_unavailable")
_CODES = (*_PERMANENT, *_TRANSIENT, "unheard_of")


@query(f"""WITH c AS (SELECT {list(_CODES)}[event_id % {len(_CODES)} + 1] AS error_code FROM events)
SELECT error_code, error_code IN {_PERMANENT} AS permanent, CASE WHEN error_code IN {_PERMANENT} THEN 'FAILED_PERMANENT' ELSE 'FAILED_TRANSIENT' END AS status, count(*) AS n FROM c WHERE error_code <> 'unheard_of' GROUP BY 1""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by error class, every code among them."""
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("event_id") % len(_CODES)).cast("int"))
    return table(spark, sf_dir, "events").select(code.alias("error_code")).join(F.broadcast(jobs.errors(spark)), "error_code").groupBy("error_code", "permanent", "status").agg(F.count("*").alias("n"))


# Metrics

_SERIES = f"WITH samples AS ({views.COUNTERS}), inc AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM samples), up AS (SELECT ts, event_type, CASE WHEN value < before THEN value ELSE value - before END AS increase FROM inc WHERE before IS NOT NULL)"


@query(f"{_SERIES} SELECT to_timestamp((epoch(ts)::BIGINT // 3600) * 3600)::TIMESTAMP AS window_start, event_type, sum(increase)::BIGINT AS increase, sum(increase)::DOUBLE / 3600 AS rate FROM up GROUP BY 1, 2")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of each counter by hour, restarts taken into account."""
    return metrics.rates(views.counters(spark, sf_dir), ["event_type"], ["event_type"], "1 hour")


@query(f"{_SERIES} SELECT to_timestamp((epoch(ts)::BIGINT // 3600) * 3600)::TIMESTAMP AS window_start, event_type = 'error' AS failed, sum(increase)::BIGINT AS increase, sum(increase)::DOUBLE / 3600 AS rate FROM up GROUP BY 1, 2")
def sum_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates summed by a label."""
    samples = views.counters(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return metrics.rates(samples, ["event_type"], ["failed"], "1 hour")


@query(f"{_SERIES}, h AS (SELECT epoch(ts)::BIGINT // 3600 AS hour, event_type, increase FROM up), o AS (SELECT hour + d AS hour, increase FROM h, (VALUES (0), (1)) v(d)) SELECT to_timestamp((hour - 1) * 3600)::TIMESTAMP AS window_start, sum(increase)::BIGINT AS increase, sum(increase)::DOUBLE / 7200 AS rate FROM o GROUP BY 1")
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate over sliding windows."""
    return metrics.rates(views.counters(spark, sf_dir), ["event_type"], [], "2 hours", "1 hour")


@query(f"WITH samples AS ({views.COUNTERS}) SELECT sum(last)::BIGINT AS total, count(*) AS n_series FROM (SELECT event_type, max_by(value, ts) AS last FROM samples GROUP BY 1)")
def gauge_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the series' last values."""
    return metrics.gauge_total(views.counters(spark, sf_dir), ["event_type"])


_BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0)
_HISTOGRAM = f"SELECT event_type, b.le, count_if(value <= b.le)::BIGINT AS n FROM events, (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in _BOUNDS)}, 'Infinity'::DOUBLE]) AS le) b GROUP BY 1, 2"


@query(_HISTOGRAM)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets by type."""
    return metrics.cumulative_histogram(table(spark, sf_dir, "events"), "value", _BOUNDS, ["event_type"])


@query(f"""WITH h AS ({_HISTOGRAM}), p AS (SELECT event_type, le, n::DOUBLE AS n, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0)::DOUBLE AS below, (max(n) OVER (PARTITION BY event_type)) * 0.95::DOUBLE AS rank FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, min_by(CASE WHEN le = 'Infinity'::DOUBLE THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, le) AS quantile FROM p WHERE n >= rank AND rank > below GROUP BY 1""")
def histogram_quantile_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile out of buckets."""
    return metrics.histogram_quantile(histogram(spark, sf_dir), 0.95, ["event_type"])


@query(f"{_SERIES}, r AS (SELECT to_timestamp((epoch(ts)::BIGINT // 86400) * 86400)::TIMESTAMP AS window_start, coalesce(sum(increase) FILTER (WHERE event_type = 'view'), 0)::BIGINT AS hits, coalesce(sum(increase) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS misses FROM up GROUP BY 1) SELECT window_start, hits, misses, CASE WHEN hits + misses > 0 THEN hits / (hits + misses) END AS ratio FROM r")
def hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of two counters' rates by day."""
    daily = metrics.rates(views.counters(spark, sf_dir), ["event_type"], ["event_type"], "1 day").groupBy("window_start").pivot("event_type", ["view", "click"]).sum("increase")
    hits, misses = F.coalesce("view", F.lit(0)), F.coalesce("click", F.lit(0))
    return daily.select("window_start", hits.alias("hits"), misses.alias("misses"), metrics.ratio(hits, misses).alias("ratio"))


@query(f"{_JOBS} SELECT status, coalesce(error_code, '-') AS code, count(*) AS n FROM jobs GROUP BY 1, 2")
def labelled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences by label."""
    return metrics.labelled_counts(views.jobs(spark, sf_dir).select("status", F.coalesce("error_code", F.lit("-")).alias("code")), ["status", "code"])


@query(f"{_JOBS} SELECT count(DISTINCT phash) AS hashes, count(*) AS n FROM jobs")
def distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct content hashes."""
    return views.jobs(spark, sf_dir).agg(F.countDistinct("phash").alias("hashes"), F.count("*").alias("n"))


# Geometry


@query("""WITH a AS (SELECT vec_id, unnest(embedding) AS conf, generate_subscripts(embedding, 1) - 1 AS anchor FROM embeddings) SELECT vec_id, anchor::INT AS anchor, conf::DOUBLE AS conf FROM a QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY conf DESC, anchor) = 1""")
def argmax_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident anchor of each image."""
    anchors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("anchor", "conf"))
    return geometry.best_anchor(anchors, "vec_id").select("vec_id", "anchor", F.col("conf").cast("double").alias("conf"))


_BOX = """WITH b AS (SELECT vec_id, 100.0 + vec_id % 400 AS cx, 120.0 + vec_id % 300 AS cy, 50.0 + vec_id % 90 AS w, 40.0 + vec_id % 70 AS h, (vec_id % 100) / 100.0::DOUBLE AS conf, 600 + vec_id % 900 AS iw, 500 + vec_id % 700 AS ih FROM embeddings),
s AS (SELECT *, least(640.0::DOUBLE / iw, 640.0::DOUBLE / ih) AS scale FROM b), n AS (SELECT *, round_even(iw * scale, 0)::INT AS nw, round_even(ih * scale, 0)::INT AS nh FROM s), p AS (SELECT *, (640 - nw) // 2 AS px, (640 - nh) // 2 AS py FROM n),
c AS (SELECT *, (cx - w / 2 - px)::DOUBLE / scale AS l, (cy - h / 2 - py)::DOUBLE / scale AS t, (cx + w / 2 - px)::DOUBLE / scale AS r, (cy + h / 2 - py)::DOUBLE / scale AS u FROM p)"""


@query(f"""{_BOX}, e AS (SELECT *, (r - l) * 0.02::DOUBLE AS mx, (u - t) * 0.02::DOUBLE AS my FROM c), f AS (SELECT vec_id, conf, greatest(0, least(round_even(l - mx, 0)::INT, iw))::INT AS x1, greatest(0, least(round_even(t - my, 0)::INT, ih))::INT AS y1, greatest(0, least(round_even(r + mx, 0)::INT, iw))::INT AS x2, greatest(0, least(round_even(u + my, 0)::INT, ih))::INT AS y2 FROM e)
SELECT vec_id, x1, y1, x2, y2, CASE WHEN conf < 0.35 THEN 'no_invoice_detected' WHEN x2 <= x1 OR y2 <= y1 THEN 'yolo_degenerate_box' END AS error_code FROM f""")
def box_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in image corners."""
    key = F.col("vec_id")
    number = lambda c: c.cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", geometry.decode_box(number(100 + key % 400), number(120 + key % 300), number(50 + key % 90), number(40 + key % 70), (key % 100) / 100, 600 + key % 900, 500 + key % 700).alias("b")).select("vec_id", "b.*")


# Streams


@query(f"SELECT event_id, user_id::VARCHAR AS job_id, requeue_count::INT AS requeue_count, CASE WHEN requeue_count > 3 THEN 'orphan_requeue_cap' ELSE 'requeue' END AS outcome FROM ({_REQUEUES})")
def stream_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded retries as a stream with state; equal to the batch form."""
    return streams.run_requeue(spark, f"{sf_dir}/event[s].parquet")


@query(_BUCKET_FOLD)
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token bucket as a stream with state; equal to the batch form."""
    return streams.run_token_bucket(spark, f"{sf_dir}/event[s].parquet", rate=0.0001, burst=2.0)


@query(_CACHE_FOLD)
def stream_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiring cache as a stream with state; equal to the batch form."""
    return streams.run_ttl_cache(spark, f"{sf_dir}/event[s].parquet")


@query("""SELECT user_id::VARCHAR AS job_id, max_by(event_type, event_id) AS status, count(*) AS n_events FROM events GROUP BY 1""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job state machine as a stream: the last state of each job."""
    return streams.run_job_states(spark, f"{sf_dir}/event[s].parquet")


@query("""WITH log AS (SELECT user_id::VARCHAR AS job_id, ts, event_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED_TRANSIENT' ELSE 'FAILED_PERMANENT' END AS status FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM log), e AS (SELECT job_id, min(i) FILTER (WHERE status NOT IN ('PENDING', 'PROCESSING')) AS stop, max(i) AS last FROM n GROUP BY 1)
SELECT n.job_id, n.status, last AS n_events, (last - coalesce(stop, last))::BIGINT AS n_ignored FROM n JOIN e ON n.job_id = e.job_id AND n.i = coalesce(stop, last)""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each job after its log, ended jobs staying as they ended."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), "ts", "event_id", views.job_status().alias("status"))
    return jobs.state_machine(log, "job_id", "status", "ts", "event_id")


@query(_SQL["state_machine"])
def stream_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job state machine as a stream with state; equal to the batch form."""
    return streams.run_state_machine(spark, f"{sf_dir}/event[s].parquet", views.job_status())


#: Later than any row of the tables.
_END_S = 4_000_000_000.0


@query("""WITH log AS (SELECT strftime(ts, '%Y%m%d') || '-' || user_id % 7 AS job_id, epoch_us(ts) / 1e6 AS t, event_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PROCESSING' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED_TRANSIENT' ELSE 'FAILED_PERMANENT' END AS status FROM events),
n AS (SELECT *, row_number() OVER w AS i, lead(t) OVER w AS next, greatest(t, CASE status WHEN 'PROCESSING' THEN t + 900 WHEN 'PENDING' THEN min(t) OVER (PARTITION BY job_id) + 1800 END) AS deadline FROM log WINDOW w AS (PARTITION BY job_id ORDER BY t, event_id)),
e AS (SELECT *, status IN ('PENDING', 'PROCESSING') AND (next IS NULL OR deadline < next) AS stale, count(*) OVER (PARTITION BY job_id) AS total FROM n)
SELECT job_id, CASE WHEN stale THEN 'FAILED_TRANSIENT' ELSE status END AS status, CASE WHEN stale THEN 'stale_timeout' END AS error_code, CASE WHEN stale THEN deadline ELSE t END AS ended_at, (total - i)::BIGINT AS n_ignored
FROM e WHERE stale OR status NOT IN ('PENDING', 'PROCESSING') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i) = 1""")
def timed_out_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each job ends if none may stay too long, out of the whole log."""
    return timed.timed_out_by_scan(_job_log(spark, sf_dir))


def _job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), (F.col("user_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").select(job.alias("job_id"), timed.seconds(F.col("ts")), F.col("event_id").alias("seq"), views.job_status().alias("status"))


@query(_SQL["timed_out_jobs"])
def stream_timed_out_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a timer of each job in a stream: no scan of any table."""
    with timed.timed_state(spark):
        log = _job_log(spark, sf_dir)
        stream = timed.replayed(log, shared_folder(spark), spark.createDataFrame([("~", _END_S, 0, "PENDING")], log.schema))
        rows = timed.on_time(streams.drained(timed.timed_out_jobs(stream, lateness="20 days")))
    end = F.max(F.when(~F.col("ignored") & F.col("status").isin(*_ENDED), F.struct("status", "error_code", "at")))
    return rows.filter("job_id <> '~'").groupBy("job_id").agg(end.alias("e"), F.count_if("ignored").alias("n_ignored")).select("job_id", "e.status", "e.error_code", F.col("e.at").alias("ended_at"), "n_ignored")


_ENDED = ("SUCCEEDED", "FAILED_PERMANENT", "FAILED_TRANSIENT")
_SLIDING = "SELECT to_timestamp((floor(epoch(ts) / 900)::BIGINT - o) * 900)::TIMESTAMP AS window_start, event_type, {0} FROM {1}, (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY 1, 2"


@query(f"WITH samples AS ({views.COUNTERS}), inc AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM samples), up AS (SELECT ts, event_type, CASE WHEN value < before THEN value ELSE value - before END AS increase FROM inc WHERE before IS NOT NULL) " + _SLIDING.format("sum(increase)::DOUBLE AS increase, sum(increase)::DOUBLE / 3600 AS rate", "up"))
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of counters that restart, by windows of an hour that slide by a quarter, as a stream."""
    samples = views.counters(spark, sf_dir).select("event_type", timed.seconds(F.col("ts")), F.lit(0).cast("long").alias("seq"), F.col("value").cast("double").alias("value"))
    with timed.timed_state(spark):
        stream = timed.replayed(samples, shared_folder(spark), spark.createDataFrame([("~", _END_S, 0, 0.0), ("~", _END_S + 1e7, 0, 0.0)], samples.schema))
        done = streams.drained(timed.stream_rates(stream, ["event_type"], ["event_type"], "1 hour", "15 minutes", lateness="20 days"))
    return done.filter("event_type <> '~'").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "increase", "rate")


_STREAM_BOUNDS = (10.0, 25.0, 50.0, 100.0)
_LES = ", ".join(f"{b}::DOUBLE" for b in _STREAM_BOUNDS) + ", 'Infinity'::DOUBLE"


@query(f"""WITH bins AS (SELECT to_timestamp((floor(epoch(ts))::BIGINT // 900) * 900)::TIMESTAMP AS ts, event_type, le, count_if(value <= le)::DOUBLE AS n FROM events, (SELECT unnest([{_LES}]) AS le) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
up AS (SELECT *, lag(n) OVER (PARTITION BY event_type, le ORDER BY ts) AS before FROM bins), summed AS (SELECT to_timestamp((floor(epoch(ts) / 900)::BIGINT - o) * 900)::TIMESTAMP AS window_start, event_type, le, sum(n) AS n FROM up, (SELECT unnest([0, 1, 2, 3]) AS o) WHERE before IS NOT NULL GROUP BY 1, 2, 3),
placed AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY window_start, event_type) * 0.95::DOUBLE AS rank FROM summed WINDOW w AS (PARTITION BY window_start, event_type ORDER BY le)),
inside AS (SELECT window_start, event_type, min_by(CASE WHEN le = 'Infinity'::DOUBLE THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, le) AS quantile FROM placed WHERE n >= rank AND rank > below GROUP BY 1, 2)
SELECT DISTINCT window_start, event_type, round(quantile, 6) AS quantile FROM summed LEFT JOIN inside USING (window_start, event_type)""")
def stream_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of histogram counters by sliding windows, as a stream."""
    from pyspark.sql.window import Window

    bins = table(spark, sf_dir, "events").filter(F.col("value").isNotNull()).groupBy((F.floor(F.unix_timestamp("ts") / 900) * 900).cast("double").alias("at"), "event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(_STREAM_BOUNDS)], F.count("*").alias(f"b{len(_STREAM_BOUNDS)}"))
    les = F.array(*map(F.lit, (*_STREAM_BOUNDS, float("inf"))))
    spread = bins.select("at", "event_type", F.inline(F.arrays_zip(les.alias("le"), F.array(*[f"b{i}" for i in range(len(_STREAM_BOUNDS) + 1)]).alias("n"))).alias("le", "n"))
    buckets = spread.select("event_type", "le", "at", F.lit(0).cast("long").alias("seq"), F.sum("n").over(Window.partitionBy("event_type", "le").orderBy("at")).cast("double").alias("value"))
    with timed.timed_state(spark):
        stream = timed.replayed(buckets, shared_folder(spark), spark.createDataFrame([("~", 1.0, _END_S, 0, 0.0), ("~", 1.0, _END_S + 1e7, 0, 0.0)], buckets.schema))
        done = streams.drained(timed.stream_quantiles(stream, 0.95, _STREAM_BOUNDS, ["event_type"], "1 hour", "15 minutes", lateness="20 days"))
    return done.filter("event_type <> '~'").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.round("quantile", 6).alias("quantile"))


_UUID = "'0b8e2f4e-0d0c-4c56-8a2f-' || lpad(page_id::VARCHAR, 12, '0')"


def _queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    uuid = F.concat(F.lit("0b8e2f4e-0d0c-4c56-8a2f-"), F.lpad(key.cast("string"), 12, "0"))
    return table(spark, sf_dir, "pages").select(F.when(key % 4 == 1, F.concat(F.lit("x"), key.cast("string"))).otherwise(uuid).alias("job_id"), F.when(key % 7 != 2, F.col("url")).otherwise("").alias("image_url"))


_VALID = f"SELECT {_UUID} AS job_id, url AS image_url FROM pages WHERE page_id % 4 <> 1 AND page_id % 7 <> 2"


@query(_VALID)
def valid_queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a UUID and a URL."""
    return jobs.valid_messages(_queued(spark, sf_dir))


@query(_VALID)
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through the queue: written as JSON lines, read as a stream, invalid ones left out."""
    return streams.run_queue(spark, _queued(spark, sf_dir))


@query(f"""{_JOBS}, j AS (SELECT '0b8e2f4e-0d0c-4c56-8a2f-' || lpad(job_id, 12, '0') AS job_id, job_id::BIGINT AS k, status, error_code, status IN ('PENDING', 'PROCESSING') AS runs FROM jobs)
SELECT job_id, CASE WHEN NOT runs THEN status WHEN k % 7 = 0 THEN 'FAILED_PERMANENT' ELSE 'SUCCEEDED' END AS status, CASE WHEN runs AND k % 7 = 0 THEN 'extractor_invalid_json' ELSE error_code END AS error_code, CASE WHEN runs THEN 1 ELSE 0 END::BIGINT AS endings,
  CASE WHEN runs AND k % 5 = 0 AND k % 7 <> 0 THEN 2 ELSE 1 END::BIGINT AS tries FROM j""")
def stream_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue consumed to its end, with a batch that is run again after its driver was lost: every job ends once, and no message is lost."""
    folder = shared_folder(spark)
    queue = f"{folder}/queue"
    rows = views.jobs(spark, sf_dir).withColumn("job_id", F.concat(F.lit("0b8e2f4e-0d0c-4c56-8a2f-"), F.lpad("job_id", 12, "0")))
    stored = JobTable(spark, f"{folder}/jobs", buckets=8)
    stored.insert(rows)
    stored.compact()
    # A message of each job, one of every ninth twice, and some of jobs that nobody knows.
    key = F.right("job_id", F.lit(12)).cast("bigint")
    streams.enqueue(rows.select("job_id", "image_url"), queue)
    streams.enqueue(rows.filter(key % 9 == 0).select("job_id", "image_url").unionByName(rows.filter(key % 11 == 0).select(F.concat(F.lit("ffffffff"), F.substring("job_id", 9, 28)).alias("job_id"), "image_url")), queue)

    def work(messages: DataFrame) -> DataFrame:
        first = F.col("requeue_count") == 0
        return messages.withColumn("extract", F.when(key % 7 == 0, "extractor_invalid_json").when((key % 5 == 0) & first, "exhausted"))

    consumer = Consumer(stored, work, f"{folder}/consumer", queue)

    def run() -> None:
        consumer.consuming(streams.messages(spark, queue, files_at_once=4), lambda: now()).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    # As if the driver were lost before the last batch was noted as done.
    last = consumer.verdicts().agg(F.max("batch")).first()[0]
    delete(spark, f"{folder}/state/commits/{last}")
    delete(spark, f"{folder}/state/commits/.{last}.crc")
    run()
    run()
    ends = stored.history().filter("kind = 'update'").groupBy("job_id").agg(F.count("*").alias("endings"))
    told = consumer.verdicts().groupBy("job_id").agg(F.count_if(F.col("action").isin("requeue", "succeed", "fail")).alias("tries"))
    return stored.read().join(ends, "job_id", "left").join(told, "job_id", "left").select("job_id", "status", "error_code", F.coalesce("endings", F.lit(0).cast("long")).alias("endings"), F.greatest("tries", F.lit(1).cast("long")).alias("tries"))


# More of the job table


@query(f"{_JOBS} SELECT job_id, status, image_url FROM jobs WHERE job_id = '42'")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job by its id."""
    return jobs.job_by_id(views.jobs(spark, sf_dir), "42").select("job_id", "status", "image_url")


@query(f"{_JOBS} SELECT job_id, CASE WHEN job_id::BIGINT % 10 = 3 THEN {_NOW} ELSE updated_at END AS updated_at FROM jobs")
def touched_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after a touch of some jobs."""
    table_ = views.jobs(spark, sf_dir)
    return jobs.touch(table_, table_.filter(F.col("job_id").cast("bigint") % 10 == 3).select("job_id"), now()).select("job_id", "updated_at")


@query("""SELECT error, CASE WHEN error IN ('DatabaseUnavailable', 'StorageTransient') THEN 503 ELSE 500 END AS http_status, count(*) AS n
FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'DatabaseUnavailable' WHEN 1 THEN 'StorageTransient' WHEN 2 THEN 'ValueError' ELSE '' END AS error FROM events) GROUP BY 1, 2""")
def exception_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP status of unhandled errors by class."""
    turn = F.col("event_id") % 4
    error = F.when(turn == 0, "DatabaseUnavailable").when(turn == 1, "StorageTransient").when(turn == 2, "ValueError").otherwise("")
    return table(spark, sf_dir, "events").groupBy(error.alias("error")).agg(F.count("*").alias("n")).select("error", jobs.exception_status(F.col("error")).alias("http_status"), "n")


@query(f"{_JOBS}, f AS (SELECT job_id, 'h' || (job_id::BIGINT % 250) AS fresh, phash FROM jobs) SELECT job_id, fresh AS phash FROM f WHERE phash IS DISTINCT FROM fresh")
def phash_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose image has another hash than stored."""
    table_ = views.jobs(spark, sf_dir)
    return jobs.phash_changes(table_, table_.select("job_id", F.concat(F.lit("h"), (F.col("job_id").cast("bigint") % 250).cast("string")).alias("phash")))


@query(f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 9 = 4 THEN url || repeat('x', 600) ELSE url END AS url FROM pages), a AS (SELECT *, CASE WHEN page_id % 10 = 0 THEN 429 WHEN {_HOST} IN ('example.com', 'example.net') OR {_HOST} LIKE '%.example.com' OR {_HOST} LIKE '%.example.net' THEN CASE WHEN length(url) > 512 THEN 500 ELSE 202 END ELSE 400 END AS http_status FROM r)
SELECT http_status, CASE http_status WHEN 429 THEN 'backpressure' WHEN 400 THEN 'disallowed_domain' WHEN 500 THEN 'internal_error' END AS error_code, CASE http_status WHEN 202 THEN 'PENDING' WHEN 400 THEN 'FAILED_PERMANENT' ELSE 'FAILED_TRANSIENT' END AS status, count(*) AS n,
       count_if(http_status = 202)::BIGINT AS stored, count_if(http_status = 202)::BIGINT AS queued FROM a GROUP BY 1, 2, 3""")
def submitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from answer to job row and message."""
    key = F.col("page_id")
    requests = table(spark, sf_dir, "pages").select("page_id", key.cast("string").alias("job_id"), F.when(key % 9 == 4, F.concat("url", F.repeat(F.lit("x"), F.lit(600)))).otherwise(F.col("url")).alias("image_url"))
    answers, rows, messages = jobs.submitted(requests, F.when(key % 10 == 0, 500).otherwise(10), now())
    joined = answers.join(rows.filter("status = 'PENDING'").select(F.col("job_id").alias("row")), F.col("job_id") == F.col("row"), "left").join(messages.select(F.col("job_id").alias("message")), F.col("job_id") == F.col("message"), "left")
    return joined.groupBy("http_status", "error_code", "status").agg(F.count("*").alias("n"), F.count("row").alias("stored"), F.count("message").alias("queued"))


@query(f"{_JOBS}, y AS (SELECT * FROM jobs WHERE status = 'PROCESSING') SELECT count(*) AS pushed, min({_NOW}) AS enqueued_at, (SELECT count(*) FROM jobs WHERE status = 'PROCESSING') AS touched FROM y")
def yielded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that go back to the queue."""
    table_ = views.jobs(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    touched, pushed = jobs.yielded(table_, table_.filter("status = 'PROCESSING'").select("job_id", "image_url"), now())
    counts = pushed.agg(F.count("*").alias("pushed"), F.min("enqueued_at").alias("enqueued_at"))
    return counts.join(F.broadcast(touched.agg(F.count_if(F.col("updated_at") == now()).alias("touched"))), F.lit(True))


@query("SELECT count(*) AS depth, CASE WHEN count(*) >= 500 THEN 'reject' WHEN count(*) >= 200 THEN 'warn' ELSE 'ok' END AS level FROM events WHERE event_id % 40 = 1")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that wait in the queue, whatever a batch has of them."""
    queue = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("job_id"), F.col("ts").alias("enqueued_at"), "event_id")
    return jobs.queue_depth(queue.select("job_id", "enqueued_at"), queue.filter(F.col("event_id") % 40 != 1).select("job_id", "enqueued_at"))


@query("SELECT event_id FROM (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 50)")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty messages that a worker gets first."""
    queue = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("enqueued_at"), F.col("event_id").alias("seq"))
    return jobs.popped(jobs.fifo(queue), 50)[0].select("event_id")


_OUTCOMES = {
    "check": {3: "unavailable"}, "mark": {5: "unavailable"}, "download": {7: "transient", 9: "image_too_large", 11: "storage_transient"}, "preprocess": {13: "truncated_upload"},
    "detect": {15: "unavailable", 17: "no_invoice_detected"}, "bucket": {19: "empty"}, "extract": {21: "throttled", 23: "exhausted", 25: "extractor_invalid_json", 26: "gemini_client_error", 27: "odd", 28: "gemini_api_key_missing", 30: "permanent:never_seen"}, "persist": {29: "unavailable"},
}


@query(f"""{_JOBS}, a AS (SELECT event_id % 31 AS kind, event_id % 5 AS tries, event_id % 2 = 0 AS cached, CASE WHEN event_id % 37 = 0 THEN NULL ELSE status END AS status FROM jobs JOIN events ON job_id = event_id::VARCHAR),
b AS (SELECT *, CASE WHEN kind = 3 THEN 'yield' WHEN status IS NULL THEN 'drop_unknown' WHEN status NOT IN ('PENDING', 'PROCESSING') THEN 'drop_terminal' WHEN kind = 5 THEN 'yield' WHEN kind = 7 THEN 'retry' WHEN kind IN (9, 11, 13) THEN 'fail'
  WHEN NOT cached AND kind IN (15, 23) THEN 'retry' WHEN NOT cached AND kind IN (17, 25, 26, 27, 28, 30) THEN 'fail' WHEN NOT cached AND kind IN (19, 21) THEN 'yield' WHEN kind = 29 THEN 'yield' ELSE 'succeed' END AS what FROM a),
c AS (SELECT *, CASE WHEN what = 'retry' THEN CASE WHEN tries + 1 > 3 THEN 'orphan' ELSE 'requeue' END ELSE what END AS action FROM b)
SELECT action, CASE WHEN action IN ('succeed', 'drop_unknown', 'drop_terminal') THEN NULL ELSE CASE kind WHEN 3 THEN 'check' WHEN 5 THEN 'mark' WHEN 13 THEN 'preprocess' WHEN 15 THEN 'detect' WHEN 17 THEN 'detect' WHEN 19 THEN 'bucket' WHEN 29 THEN 'persist' ELSE CASE WHEN kind < 12 THEN 'download' ELSE 'extract' END END END AS stage,
  CASE WHEN action = 'succeed' THEN 'SUCCEEDED' WHEN action = 'orphan' THEN 'FAILED_PERMANENT' WHEN action = 'fail' THEN CASE WHEN kind IN (11, 27) THEN 'FAILED_TRANSIENT' ELSE 'FAILED_PERMANENT' END END AS new_status,
  CASE WHEN action = 'orphan' THEN 'orphan_requeue_cap' WHEN action = 'fail' THEN CASE kind WHEN 9 THEN 'image_too_large' WHEN 11 THEN 'storage_transient' WHEN 13 THEN 'truncated_upload' WHEN 17 THEN 'no_invoice_detected' WHEN 25 THEN 'extractor_invalid_json' WHEN 26 THEN 'gemini_client_error' WHEN 28 THEN 'gemini_api_key_missing' WHEN 30 THEN 'never_seen' ELSE 'lifecycle_uncaught' END END AS new_code, count(*) AS n FROM c GROUP BY 1, 2, 3, 4""")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tries at jobs end: which stage decides, and what follows."""
    key = F.col("job_id").cast("bigint")
    tries = views.jobs(spark, sf_dir).select(F.when(key % 37 != 0, F.col("status")).alias("status"), (key % 5).alias("requeue_count"), (key % 2 == 0).alias("cached"), (key % 31).alias("kind"))
    for stage, known in _OUTCOMES.items():
        outcome = F.lit(None).cast("string")
        for kind, what in known.items():
            outcome = F.when(F.col("kind") == kind, what).otherwise(outcome)
        tries = tries.withColumn(stage, outcome)
    return jobs.lifecycle(tries).groupBy("action", "stage", "new_status", "new_code").agg(F.count("*").alias("n"))


@query("""WITH old AS (SELECT 'h' || (event_id % 50) AS phash, 'old' AS payload, max(ts) AS written_at FROM events GROUP BY 1), fresh AS (SELECT 'h' || (event_id % 80) AS phash, max(event_id::VARCHAR) AS payload, TIMESTAMP '2024-01-31 00:00:00' AS written_at FROM events WHERE event_id % 80 >= 40 GROUP BY 1)
SELECT * FROM old WHERE phash NOT IN (SELECT phash FROM fresh) UNION ALL SELECT * FROM fresh""")
def cache_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after new entries are written, old ones of their keys replaced."""
    event, key = table(spark, sf_dir, "events"), F.col("event_id")
    named = lambda n: F.concat(F.lit("h"), (key % n).cast("string")).alias("phash")
    old = event.groupBy(named(50)).agg(F.max("ts").alias("written_at")).select("phash", F.lit("v1").alias("psv"), F.lit("old").alias("payload"), "written_at")
    fresh = event.filter(key % 80 >= 40).select(named(80), F.lit("v1").alias("psv"), key.cast("string").alias("payload"))
    return jobs.cache_write(old, fresh, now()).select("phash", "payload", F.col("written_at").cast("timestamp_ntz").alias("written_at"))


@query(f"""{_JOBS}, n AS (SELECT *, job_id::BIGINT AS k FROM jobs), a AS (
  SELECT k, job_id, CASE WHEN k % 150 = 8 THEN 'FAILED_TRANSIENT' WHEN k % 50 = 8 THEN 'SUCCEEDED' ELSE status END AS status, CASE WHEN k % 50 = 8 THEN 'new' || k ELSE phash END AS phash, CASE WHEN k % 150 = 8 THEN 'stale_timeout' ELSE error_code END AS error_code,
    CASE WHEN k % 50 = 8 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE updated_at END AS updated_at FROM n
), b AS (
  SELECT * FROM a WHERE NOT (status IN ('SUCCEEDED', 'FAILED_PERMANENT', 'FAILED_TRANSIENT') AND updated_at < {_LATER} - INTERVAL 90 DAY) UNION ALL SELECT k, 'n' || k, 'PENDING', NULL, NULL, TIMESTAMP '2024-06-02 00:00:00' FROM n WHERE k % 20 = 3
)
SELECT job_id, CASE WHEN job_id[1] = 'n' AND k % 40 = 3 THEN 'PROCESSING' ELSE status END AS status, phash, error_code, CASE WHEN job_id[1] = 'n' AND k % 40 = 3 THEN TIMESTAMP '2024-06-03 00:00:00' ELSE updated_at END AS updated_at FROM b""")
def job_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table after rounds of insertions, changes, a purge and compactions, the last change still in the log."""
    day = lambda d: F.lit(f"2024-06-{d:02d} 00:00:00").cast("timestamp")
    rows, key = views.jobs(spark, sf_dir), F.col("job_id").cast("bigint")
    stored = JobTable(spark, shared_folder(spark, "jobs"), buckets=8)
    stored.insert(rows)
    stored.compact()
    stored.update(rows.filter(key % 50 == 8).select("job_id", F.lit("SUCCEEDED").alias("status"), F.concat(F.lit("new"), "job_id").alias("phash")), day(1))
    stored.update(rows.filter(key % 150 == 8).select("job_id", F.lit("FAILED_TRANSIENT").alias("status"), F.lit("stale_timeout").alias("error_code")), day(1))
    stored.purge(F.lit("2024-04-10 00:00:00").cast("timestamp"))
    fresh = rows.filter(key % 20 == 3).select(F.concat(F.lit("n"), "job_id").alias("job_id"), "image_url")
    stored.insert(jobs.new_jobs(fresh, day(2)))
    stored.compact()
    # Jobs that are there already stay as they are.
    stored.insert(jobs.new_jobs(fresh, day(9)))
    stored.update(fresh.filter(F.substring("job_id", 2, 20).cast("bigint") % 40 == 3).select("job_id", F.lit("PROCESSING").alias("status")), day(3))
    return stored.read().select("job_id", "status", "phash", "error_code", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""SELECT event_id, ts - INTERVAL 90 MINUTE < CASE WHEN ts >= date_trunc('day', ts) + INTERVAL 2 HOUR THEN date_trunc('day', ts) + INTERVAL 2 HOUR ELSE date_trunc('day', ts) - INTERVAL 22 HOUR END AS due FROM events""")
def purge_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nightly hour came in the hour and a half before each moment."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", jobs.purge_due(at - F.expr("INTERVAL 90 MINUTES"), at).alias("due"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN upper(url) END AS said, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'yield' ELSE 'permanent' END AS outcome, 1 AS calls FROM pages""")
def adapter_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through the adapter: answered, put off, refused."""

    def setup():
        def call(value: str) -> str:
            number, url = value.split(" ", 1)
            if int(number) % 3 == 1:
                raise adapter.Throttled
            if int(number) % 3 == 2:
                raise adapter.Refused
            return url.upper()

        return call

    rows = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("asked"))
    return adapter.with_adapter(rows, setup, "asked", "said").select("page_id", "said", "outcome", "calls")


# More of records, files and runs

def _best_sql(out: str, probes: str, entries: str, cutoff: float, fallback: float | None = None) -> str:
    """Common table expressions that match the distinct ``raw`` of ``probes`` to ``entries`` (pos, canonical), as ``out`` (raw, matched)."""
    low = f" UNION ALL SELECT * FROM (SELECT raw, canonical, {_EDIT.format('raw', 'lower')} AS score, pos, 0 AS step FROM (SELECT raw FROM {out}_probe WHERE raw NOT IN (SELECT raw FROM {out}_near)), {out}_names) WHERE score >= {fallback}" if fallback else ""
    return f""", {out}_names AS (SELECT lower(canonical) AS lower, max_by(canonical, pos) AS canonical, min(pos) AS pos FROM {entries} GROUP BY 1), {out}_probe AS (SELECT DISTINCT lower(trim(raw)) AS raw FROM {probes} WHERE trim(raw) <> ''),
{out}_near AS (SELECT raw, canonical, {_EDIT.format('raw', 'lower')} AS score, pos, length(lower) // 4 - length(raw) // 4 AS step FROM {out}_probe JOIN {out}_names ON left(raw, 3) = left(lower, 3) AND abs(length(lower) // 4 - length(raw) // 4) <= 1),
{out} AS (SELECT raw, canonical AS matched FROM (SELECT * FROM {out}_near WHERE score >= {cutoff}{low}) QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, step, pos) = 1)"""


_STORE_NAME = "CASE rec_id % 5 WHEN 0 THEN lower(n_name) || ' store' WHEN 1 THEN ' ' || n_name || ' STOREY' WHEN 2 THEN 'QZ' || n_name || ' STORE' WHEN 3 THEN 'shop ' || rec_id % 50 ELSE '' END"
_LINE_NAME = "CASE line % 3 WHEN 0 THEN product_name || right(product_name, 1) WHEN 1 THEN ' ' || upper(product_name) ELSE product_name END"


@query(f"""{_FLAT}, entries AS ({views.DICTIONARY}), stores AS (SELECT n_nationkey AS pos, n_name || ' STORE' AS canonical FROM nation), lines AS (SELECT *, {_LINE_NAME} AS raw FROM ({views.PRODUCT_ROWS})),
shops AS (SELECT rec_id, {_STORE_NAME} AS raw FROM guess JOIN orders ON o_orderkey = rec_id JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
{_best_sql('store', 'shops', 'stores', 80, 60)}{_best_sql('line', 'lines', 'entries', 70)},
p AS (SELECT rec_id, count(*) AS n, count(matched) AS matched, sum(hash_of)::BIGINT AS letters, sum(('0' || coalesce(nullif(regexp_replace(product_unit_price, '[^0-9]', '', 'g'), ''), '0'))::BIGINT)::BIGINT AS prices, sum(product_quantity::BIGINT)::BIGINT AS quantities
  FROM (SELECT l.*, matched, length(coalesce(matched, trim(l.raw))) + ascii(coalesce(matched, trim(l.raw))) AS hash_of FROM lines l LEFT JOIN line m ON lower(trim(l.raw)) = m.raw) GROUP BY 1)
SELECT g.rec_id, lower(g.type) AS type, regexp_replace(g.date, '^(\\d{{2}})[-.](\\d{{2}})[-.](\\d{{4}})$', '\\1/\\2/\\3') AS date, regexp_replace(g.total_money, '[^0-9]', '', 'g') AS total_money, coalesce(s.matched, trim(h.raw)) AS name,
  coalesce(n, 0)::BIGINT AS n, coalesce(p.matched, 0)::BIGINT AS matched, coalesce(letters, 0)::BIGINT AS letters, coalesce(prices, 0)::BIGINT AS prices, coalesce(quantities, 0)::BIGINT AS quantities
FROM guess g JOIN shops h USING (rec_id) LEFT JOIN store s ON lower(trim(h.raw)) = s.raw LEFT JOIN p USING (rec_id)""")
def postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are stored: every field by its rule, store names by a dictionary with fallback, product names by one without."""
    key = F.col("rec_id")
    nation = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("rec_id"), "n_name")
    shop = F.when(key % 5 == 0, F.concat(F.lower("n_name"), F.lit(" store"))).when(key % 5 == 1, F.concat(F.lit(" "), "n_name", F.lit(" STOREY"))).when(key % 5 == 2, F.concat(F.lit("QZ"), "n_name", F.lit(" STORE"))).when(key % 5 == 3, F.concat(F.lit("shop "), (key % 50).cast("string"))).otherwise("")
    flat = views.perturbed(views.orders_flat(spark, sf_dir)).join(nation, "rec_id").withColumn("name", shop).drop("n_name")
    rows = views.product_rows(spark, sf_dir)
    read = F.when(F.col("line") % 3 == 0, F.concat("product_name", F.substring("product_name", -1, 1))).when(F.col("line") % 3 == 1, F.concat(F.lit(" "), F.upper("product_name"))).otherwise(F.col("product_name"))
    line = F.struct("product_id", read.alias("product_name"), F.concat(F.lit(" "), "product_unit_price", F.lit(".000 đ")).alias("product_unit_price"), F.concat("product_quantity", F.lit(",000")).alias("product_quantity"), F.lit("").alias("product_discount_money"), "product_total_money")
    records = flat.join(rows.groupBy("rec_id").agg(F.collect_list(line).alias("products")), "rec_id", "left")
    structs = records.select("rec_id", F.struct(*[c for c in records.columns if c not in ("rec_id", "file")]).alias("record"))
    stores = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("pos"), F.concat("n_name", F.lit(" STORE")).alias("canonical"))
    entries = views.dictionary(spark, sf_dir)
    done = match.postprocessed(structs, stores, entries, settings=DEFAULTS, scorer=edit_score)
    known = match.sent(match.canonical_names(entries).select(F.col("canonical").alias("known")).distinct())
    each = done.select("rec_id", "record.type", "record.date", "record.total_money", "record.name", F.explode_outer("record.products").alias("p")).join(known, F.col("p.product_name") == F.col("known"), "left")
    total = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast("bigint")
    return each.groupBy("rec_id", "type", "date", "total_money", "name").agg(
        F.count("p").alias("n"), F.count("known").alias("matched"), total(F.char_length("p.product_name") + F.ascii("p.product_name")).alias("letters"),
        (total(F.coalesce(F.col("p.product_unit_price").try_cast("bigint"), F.lit(0))) / 1000).cast("bigint").alias("prices"), total(F.col("p.product_quantity").cast("bigint")).alias("quantities"),
    )


@query("""SELECT p_partkey AS part, p_name AS file, 'TYPE ' || p_partkey AS type, lower(trim(regexp_replace(strip_accents(p_name), '\\s+', ' ', 'g'))) AS name, lower(trim(regexp_replace(strip_accents(p_name), '\\s+', ' ', 'g'))) AS line, 'TYPE ' || p_partkey AS line_type FROM part""")
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with all texts folded at every level, but for the keys that are left as they are."""
    name, padded = F.col("p_name"), F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))
    kind = F.concat(F.lit("TYPE "), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), name.alias("file"), kind.alias("type"), padded.alias("name"), F.array(F.struct(padded.alias("line"), kind.alias("type"))).alias("products"))
    return curate.normalized_records(rows).select("part", "file", "type", "name", F.col("products")[0]["line"].alias("line"), F.col("products")[0]["type"].alias("line_type"))


@query("SELECT part, i::INT AS i, CASE WHEN part % 2 = 0 THEN 'new' || part WHEN part % 3 = 0 THEN '' ELSE 'old' || part END AS product_id, CASE WHEN part % 5 = 0 THEN '' ELSE '2' END AS product_quantity FROM (SELECT p_partkey AS part, unnest([0, 1]) AS i FROM part)")
def aliased_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older labels under the current names."""
    key = F.col("p_partkey")
    code, text_ = lambda prefix: F.concat(F.lit(prefix), key.cast("string")), F.lit(None).cast("string")
    line = F.struct(
        F.when(key % 2 == 0, code("new")).when(key % 3 == 0, "").alias("product_id"), code("old").alias("product_code"), text_.alias("product_name"), text_.alias("product_unit_price"),
        F.when(key % 5 == 0, "").alias("product_quantity"), F.lit("2").alias("product_amount"), text_.alias("product_total_money"),
    )
    rows = table(spark, sf_dir, "part").select(key.alias("part"), F.posexplode(score.alias_products(F.array(line, line))).alias("i", "p"))
    return rows.select("part", "i", "p.product_id", "p.product_quantity")


#: A receipt of each chain that meets its formats, and one of a shop without any.
_RECEIPTS = {
    "aeon": ("TRUNG TÂM MUA SẮM AEON - BÌNH TÂN", "062", "1234567", "Lê Thị Tâm", "", "10:45"), "bhx_2024": ("6006 BHX_DON_LKH - 3 HOÀNG DIỆU", "106729", "OV123456789012345678", "", "", "10:45"),
    "bigc": ("SIEU THI GO! QUANG NGAI", "043", "043000123", "108123", "9900112233", "10:45:30"), "coopmart": ("CO.OPMART XA LO HA NOI", "10", "88112", "16138980-Như", "", "10:45:30"),
    "coopxtra": ("CO-OPXTRA THU DUC", "7", "99", "any", "123", "10:45:30"), "emart": ("Emart Phan Văn Trị", "0021-0183", "01001", "2300747(Nguyen Thi Anh Thu)", "0202401200100300100006", "10:45"),
    "lotte": ("LOTTE MART WEST LAKE", "1064-0020", "017240830021300180005097", "207022402VO NGUYEN THU", "001240120001600050017040", "10:45"), "satra": ("SIÊU THỊ SÀI GÒN", "SGT01", "24SGT1-00012", "Trần Văn A", "*24SGT00012345*", "10:45"),
    "corner": ("Corner Shop", "x", "x", "x", "x", "x"),
}
_FIELDS = ("name", "pos_id", "receipt_number", "cashier", "barcode", "time")
#: Which receipts have a mark before a field, and which have the field empty, by remainder of the key.
_MARKED, _BLANK = {"name": 5, "pos_id": 7, "receipt_number": 11, "cashier": 4, "barcode": 6, "time": 10}, 13
#: Fields of which any text is right, by chain; with the mark a cashier of these is still one, and so is a Satra or BigC name not.
_FREE = {"aeon": ("cashier",), "bhx_2024": ("time",), "coopmart": ("barcode",), "coopxtra": ("cashier", "barcode"), "satra": ("cashier",), "corner": _FIELDS}


def _receipt_sql(field: str, i: int) -> str:
    good = " ".join(f"WHEN {k} THEN '{row[i]}'" for k, row in enumerate(_RECEIPTS.values()))
    return f"CASE WHEN k % {_BLANK} = 0 THEN '' WHEN k % {_MARKED[field]} = 0 THEN '?' || (CASE k % {len(_RECEIPTS)} {good} END) ELSE CASE k % {len(_RECEIPTS)} {good} END END AS {field}"


def _broken_sql(field: str) -> str:
    held = [str(k) for k, chain in enumerate(_RECEIPTS) if field not in _FREE.get(chain, ())]
    return f"CASE WHEN k % {_BLANK} <> 0 AND k % {_MARKED[field]} = 0 AND k % {len(_RECEIPTS)} IN ({', '.join(held)}) THEN '{field}' END"


@query(f"""WITH r AS (SELECT o_orderkey AS k, {', '.join(_receipt_sql(f, i) for i, f in enumerate(_FIELDS))} FROM orders)
SELECT k AS rec_id, {list(_RECEIPTS)}[k % {len(_RECEIPTS)} + 1] AS type, CASE WHEN name = '' OR name[1] = '?' THEN NULL ELSE nullif({list(_RECEIPTS)}[k % {len(_RECEIPTS)} + 1], 'corner') END AS chain, array_to_string(list_filter([{', '.join(map(_broken_sql, ('name', 'pos_id', 'receipt_number', 'barcode', 'time', 'cashier')))}], lambda x: x IS NOT NULL), ',') AS broken,
  CASE WHEN k % {len(_RECEIPTS)} = 5 THEN 'CAFE GOLD' ELSE '01) VAT08  CAFE GOLD' END AS line FROM r""")
def chain_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of all chains that meet and break their formats, with the fields that do."""
    key, n = F.col("o_orderkey"), len(_RECEIPTS)
    at = lambda values: F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))
    made = {}
    for i, f in enumerate(_FIELDS):
        good = at([row[i] for row in _RECEIPTS.values()])
        made[f] = F.when(key % _BLANK == 0, "").when(key % _MARKED[f] == 0, F.concat(F.lit("?"), good)).otherwise(good)
    rows = table(spark, sf_dir, "orders").select(key.alias("rec_id"), at(list(_RECEIPTS)).alias("type"), *[c.alias(f) for f, c in made.items()])
    kind = F.col("type")
    return rows.select("rec_id", "type", chains.chain_of(F.col("name")).alias("chain"), F.array_join(chains.broken_formats(kind, {f: F.col(f) for f in _FIELDS}), ",").alias("broken"), chains.line_name(kind, F.lit("01) VAT08  CAFE GOLD")).alias("line"))


@query("SELECT (count(*) + 1)::BIGINT AS run, CASE WHEN count(*) >= 3 THEN 'budget' END AS refusal FROM region")
def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of the next experiment and why it may not run."""
    found = score.next_run(table(spark, sf_dir, "region").select(F.lit(False).alias("final")))
    return spark.createDataFrame([(found["run"], found["refusal"])], "run long, refusal string")


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10)")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records in order."""
    return curate.head(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 10)


@query("""WITH t AS (SELECT lower(lang) AS s, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS n, (SELECT count(*) FROM documents) AS distinct_keys, (SELECT sum(floor(n * 0.3::DOUBLE))::BIGINT FROM t) AS test FROM documents""")
def split_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of a split together: every record once."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("golden_index"), F.col("lang").alias("type"), F.col("source").alias("file"), F.lit("verified_ok").alias("_verify_status"))
    return curate.split_metadata(curate.stratified_split(rows, "doc_id")).agg(F.count("*").alias("n"), F.countDistinct("golden_index").alias("distinct_keys"), F.count_if(F.col("split") == "test").alias("test"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'full' END AS label FROM pages")
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part a file of labels holds, by its name."""
    key = F.col("page_id")
    path = F.concat(F.lit("/data/test.dev/"), F.when(key % 3 == 0, "golden_dev").when(key % 3 == 1, "test_set").otherwise("golden"), F.lit(".v2.json"))
    return table(spark, sf_dir, "pages").select("page_id", text.split_label(path).alias("label"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS golden_index, 'u/' || n_nationkey AS file, n_name AS name, NULL::VARCHAR AS type FROM nation")
def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a JSON array file, with their places."""
    path = f"{shared_folder(spark)}/gold"
    records = F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda r: F.struct(F.concat(F.lit("u/"), r["k"].cast("string")).alias("file"), r["name"].alias("name")))
    _nations(spark, sf_dir).agg(F.to_json(records).alias("value")).write.text(path)
    return files.json_array(spark, path).select("golden_index", "file", "name", "type")


@query("SELECT (row_number() OVER (ORDER BY canonical) - 1)::INT AS pos, canonical FROM (SELECT DISTINCT trim(p_name) AS canonical FROM part)")
def dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary built, written as a JSON array and read again."""
    path = f"{shared_folder(spark)}/dictionary"
    files.write_dictionary(curate.name_dictionary(table(spark, sf_dir, "part"), "p_name"), path)
    return files.dictionary(spark, path)


@query("SELECT c_custkey, c_mktsegment AS type, CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'dev' END AS split FROM customer")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a split as JSON files and back."""
    folder = shared_folder(spark)
    files.write_split(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("type"), F.when(F.col("c_custkey") % 3 == 0, "test").otherwise("dev").alias("split")), folder)
    return spark.read.schema("c_custkey long, type string, split string").json(f"{folder}/split")


@query("SELECT c_custkey, c_name AS name, 'a, \"b\"' AS quoted FROM customer")
def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV with a header and back."""
    folder = f"{shared_folder(spark)}/csv"
    files.write_csv(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit('a, "b"').alias("quoted")), folder)
    return spark.read.option("header", True).option("escape", "\\").schema("c_custkey long, name string, quoted string").csv(folder)


@query("SELECT field, sum(n)::BIGINT AS total, sum(n)::BIGINT AS by_type FROM (SELECT c_mktsegment AS field, count(*) AS n FROM customer GROUP BY 1) GROUP BY 1")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation report written as JSON, found as the newest file and read as text."""
    long = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("field"), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("type"), (F.col("c_custkey") % 3 == 0).alias("ok"))
    accuracy = score.field_accuracy(long, by="type")
    folder = shared_folder(spark)
    path = files.write_report(spark, files.report(spark.createDataFrame([(1,)], "n_total long"), accuracy, score.macro_average(accuracy.filter("scope = 'overall'")), "v1", "dev", "t"), folder)
    body = files.prompt(spark, files.newest_file(spark, path, "*.txt"))
    kinds = "map<string,struct<correct:bigint,total:bigint,pct:double>>"
    read = spark.createDataFrame([(body,)], "value string").select(F.from_json("value", f"struct<field_accuracy:{kinds},by_type:map<string,{kinds}>>").alias("r"))
    overall = read.select(F.explode("r.field_accuracy").alias("field", "a")).select("field", F.col("a.total").alias("total"))
    each = read.select(F.explode("r.by_type").alias("type", "m")).select(F.explode("m").alias("field_", "a")).groupBy("field_").agg(F.sum("a.total").alias("by_type"))
    return overall.join(each, F.col("field") == F.col("field_")).select("field", "total", "by_type")


@query("SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT '| k | name |' UNION ALL SELECT '|-|-|'")
def markdown_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a Markdown table, in two goes."""
    folder, rows = f"{shared_folder(spark)}/log", _nations(spark, sf_dir)
    files.append_markdown(rows.filter("k < 10"), folder, ["k", "name"])
    files.append_markdown(rows.filter("k >= 10"), folder, ["k", "name"])
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query("SELECT count(*) AS n, 3.5::DOUBLE AS rate, 8.0::DOUBLE AS burst FROM events")
def stream_bucket_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate configuration that batches of requests were run with; what it does not name has its default."""
    config, folder = spark.createDataFrame([(3.5, None)], "rps double, burst double"), shared_folder(spark)
    apply = lambda batch, rate, burst: batch.agg(F.count("*").alias("n")).withColumns({"rate": F.lit(float(rate)), "burst": F.lit(float(burst))}).write.mode("append").parquet(f"{folder}/out")
    run = streams.refreshed_bucket(streams.events(spark, f"{sf_dir}/event[s].parquet"), lambda: config, apply).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("rate", "burst").agg(F.sum("n").alias("n")).select("n", "rate", "burst")
