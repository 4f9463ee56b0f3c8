"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import audit, bpe, concurrency, langid, lines, mixing, neighbours, pii, quality, simhash, toxicity, urlfilter, winnowing
from tallywright.llm.common import held_out, table

#: Session setting that holds the key of replacements.
SURROGATE_KEY = "spark.tallywright.surrogateKey"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, n_entities, kinds.

    The key is the session's ``SURROGATE_KEY`` setting; without one a fresh key is
    drawn and forgotten, so that nobody can try out originals.
    """
    key = spark.conf.get(SURROGATE_KEY, None) or secrets.token_hex(32)
    done = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return done.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join("entities", ",").alias("kinds"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text: doc_id, held_out, lang_pred, score, n_spans."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth: query_id, rank, vec_id, score."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), output="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint against its edited text's and the next document's."""
    return winnowing.compared_with_follower(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document for the target mix of sources."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the line that its component keeps: doc_id, line_no, line_id, first_doc_id, first_line_no, kept."""
    found = lines.line_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("no").alias("line_no"), "line_id", F.col("first_key").alias("first_doc_id"), F.col("first_no").alias("first_line_no"), "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text: doc_id, held_out, score, predicted, n_lines, bad_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), output="score", lines="lines")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
        F.size("lines").alias("n_lines"), F.size(F.filter("lines", lambda p: p < 0.5)).alias("bad_lines"),
    )


#: Verdicts by host and path (fixed values).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Names of hosts whose URLs the list holds (fixed values).
LISTED_HOSTS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules, else by the list of the URLs that pages of listed hosts have: page_id, host, path, rule, verdict, listed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(urlfilter.host_of(F.col("url")).rlike(rf"(?:^|\.)(?:{'|'.join(LISTED_HOSTS)})\."))
    return urlfilter.judge(pages, listed, RULES, keep=["page_id"])


def op12_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales by nation at every moment of change: nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak."""
    return concurrency.sales_concurrency(*[table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients")])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio,
         ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE) AS level
  FROM sources WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (
  SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, source ASC NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, w * coalesce((SELECT level FROM found), 'Infinity'::DOUBLE)) AS target FROM levels
), ranked AS (
  SELECT doc_id, s.source, size, source_size, target,
         row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) AS rank,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         ('0x' || substr(md5('42:' || coalesce('=' || s.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (floor(each * rank + shift) - floor(each * (rank - 1) + shift))::INT AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM taken
"""
_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(f"WHEN (host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.split('/', 1)[1]}') THEN '{{{i}}}'" for i, t in enumerate(t for _, t in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))))
_BY_LENGTH = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
OP11_SQL = rf"""
WITH parts AS (
  SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), forms AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid)(=|$)'))) AS given,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '(:(80|443))$', ''), '\.+$', ''), '^www\.(.)', '\1') AS site,
         CASE {_FITS.format(*[t for _, t in _BY_LENGTH])} END AS rule, CASE {_FITS.format(*[v for v, _ in _BY_LENGTH])} END AS ruled
  FROM parts
), keyed AS (
  SELECT *, CASE WHEN contains(url, '://') THEN site || regexp_replace(path, '/+$', '') || CASE WHEN len(given) > 0 THEN '?' || array_to_string(given, '&') ELSE '' END END AS key FROM forms
), known AS (
  SELECT DISTINCT key AS known FROM keyed WHERE key IS NOT NULL AND regexp_matches(host, '(^|\.)({'|'.join(LISTED_HOSTS)})\.')
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN known IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, known IS NOT NULL AS listed FROM keyed LEFT JOIN known ON key = known
"""
OP12_SQL = """
WITH shipped AS (
  SELECT sale_id, min(epoch_us(shipped_at) // 60000000) * 60 + 604800 AS e FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id
), homes AS (
  SELECT client_id, min(nation_id) AS nation FROM clients GROUP BY client_id
), alive AS (
  SELECT coalesce(nation, -1) AS nation, (epoch_us(sold_at) // 60000000) * 60 AS b, e, coalesce(floor(100 * total + 0.5), 0)::BIGINT AS cents
  FROM sales LEFT JOIN shipped USING (sale_id) LEFT JOIN homes USING (client_id) WHERE sold_at IS NOT NULL AND (e IS NULL OR e > (epoch_us(sold_at) // 60000000) * 60)
), counted_twice AS (
  SELECT * FROM alive UNION ALL SELECT -2, b, e, cents FROM alive
), moves AS (
  SELECT nation, t, sum(d)::BIGINT AS d, sum(c)::BIGINT AS c FROM (
    SELECT nation, b AS t, 1 AS d, cents AS c FROM counted_twice UNION ALL SELECT nation, e, -1, -cents FROM counted_twice WHERE e IS NOT NULL
  ) GROUP BY nation, t HAVING sum(d) <> 0 OR sum(c) <> 0
), summed AS (
  SELECT nation, t, lead(t) OVER w AS next, (sum(d) OVER w)::BIGINT AS n, (sum(c) OVER w)::BIGINT AS cents FROM moves WINDOW w AS (PARTITION BY nation ORDER BY t)
)
SELECT nation::INT AS nation_id, t::BIGINT AS from_s, next::BIGINT AS to_s, n AS n_open, cents AS open_cents, max(n) OVER (PARTITION BY nation ORDER BY t) AS high_open, cents = max(cents) OVER (PARTITION BY nation) AS is_peak FROM summed
"""
OP13_SQL = r"""
WITH counted AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failed AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM counted
), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM failed LEFT JOIN known USING (doc_id)
), grouped AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM judged GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 64 AS f, list_transform(string_split(left(filter_order, step - 1), ''), lambda l: ascii(l) - 64) AS earlier FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), told AS (
  SELECT part, filter_order, step, f, fails[f] AS own, step > 1 AND len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k, n, good, toxic FROM grouped, steps
), results AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM told GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM results
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {"op1_pii": op1_pii, "op2_language": op2_language, "op3_simhash": op3_simhash, "op4_nearest": op4_nearest, "op5_byte_bpe": op5_byte_bpe, "op6_toxicity": op6_toxicity, "op7_winnowing": op7_winnowing, "op8_mixing": op8_mixing, "op9_line_dedup": op9_line_dedup, "op10_quality": op10_quality, "op11_url_filter": op11_url_filter, "op12_concurrency": op12_concurrency, "op13_filter_audit": op13_filter_audit}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query, where SQL can express it."""
    return {"op8_mixing": OP8_SQL, "op11_url_filter": OP11_SQL, "op12_concurrency": OP12_SQL, "op13_filter_audit": OP13_SQL}
