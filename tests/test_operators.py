"""Matching, scoring, curation, jobs, metrics and geometry on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.functions import geometry
from tallywright.operators import curate, jobs, match, metrics, score
from tallywright.schemas import GOLD

LINE = "array<struct<product_name:string,product_unit_price:string,product_total_money:string>>"


def align(spark, gold, pred):
    frame = spark.createDataFrame([(gold, pred)], f"g {LINE}, p {LINE}")
    return frame.select(score.align_lines(F.col("g"), F.col("p")).alias("m")).first()["m"]


def plain_money(value):
    """Digits only, no leading zeros, 0 if none are left; empty stays empty."""
    return "" if not value else "".join(c for c in value if c.isdigit()).lstrip("0") or "0"


def plain_align(gold, pred):
    gold, pred = ([(n, plain_money(a), plain_money(b)) for n, a, b in side] for side in (gold, pred))
    used, out = set(), []
    for g in gold:
        best, at = 0, None
        for i, p in enumerate(pred):
            if i not in used:
                s = 2 * (g[1] != "" and g[1] == p[1]) + 2 * (g[2] != "" and g[2] == p[2]) + 3 * (g[0] != "" and g[0].lower() == p[0].lower())
                if s > best:
                    best, at = s, i
        out.append(at)
        used.add(at)
    return out


def test_alignment(spark):
    assert align(spark, [("A", "10", "10"), ("B", "20", "20")], [("B", "20", "20"), ("A", "10", "10")]) == [1, 0]
    assert align(spark, [("MILK", "10", ""), ("MILK", "20", ""), ("EGG", "5", "")], [("MILK", "20", ""), ("MILK", "10", ""), ("ZZ", "99", "")]) == [1, 0, None]
    assert align(spark, [("X", "1", "1")], []) == [None] and align(spark, [], [("X", "1", "1")]) == []
    assert align(spark, [("a", "10", ""), ("b", "10", "")], [("p", "10", ""), ("q", "10", "")]) == [0, 1]
    for one, two in (("-24,000", "24000"), ("0059000", "59000"), ("abc", "n/a"), ("0", "free")):
        assert align(spark, [("x", one, "")], [("y", two, "")]) == [0]
    rnd = random.Random(2)
    pick = lambda: [(rnd.choice("abc"), rnd.choice(["", "1", "-1", "001", "2"]), rnd.choice(["", "5", "6", "abc", "0"])) for _ in range(rnd.randint(0, 5))]
    cases = [(pick(), pick()) for _ in range(200)]
    rows = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(cases)], f"i int, g {LINE}, p {LINE}").select("i", score.align_lines(F.col("g"), F.col("p")).alias("m")).collect()
    assert all(r["m"] == plain_align(*cases[r["i"]]) for r in rows)


def record(**fields):
    base = dict.fromkeys(score.BASE_FIELDS, "")
    return {**base, "products": [], **fields}


RECORD = "struct<name:string,type:string,date:string,time:string,pos_id:string,receipt_number:string,cashier:string,total_money:string,barcode:string,products:array<struct<product_id:string,product_name:string,product_unit_price:string,product_quantity:string,product_total_money:string>>>"


def test_comparisons(spark):
    gold = record(name="Shop", total_money="24,000", barcode="*24SGT1*", date="1/1/2026", products=[{"product_id": "1", "product_name": "milk tea bottle 500ml", "product_unit_price": "10", "product_quantity": "2.0", "product_total_money": "20"}])
    pred = record(name=" SHOP ", total_money="-24.000", barcode="24SGT1", date="", cashier="extra", products=[{"product_id": "1", "product_name": "milk tea bottle 500ml.", "product_unit_price": "10", "product_quantity": "2", "product_total_money": "21"}, {"product_id": "9", "product_name": "more", "product_unit_price": "", "product_quantity": "", "product_total_money": ""}])
    frame = spark.createDataFrame([(1, gold, pred)], f"rec int, gold {RECORD}, pred {RECORD}")
    long = score.comparisons(frame, ["rec"])
    got = {(r["idx"], r["field"]): r["ok"] for r in long.collect()}
    assert got == {(None, "name"): True, (None, "total_money"): True, (None, "barcode"): True, (None, "date"): False, (0, "product_id"): True, (0, "product_name"): True, (0, "product_unit_price"): True, (0, "product_quantity"): True, (0, "product_total_money"): False}
    assert {r["path"] for r in score.mismatches(long, "rec").collect()} == {"date", "product[0].product_total_money"}
    odd = spark.createDataFrame([(1, record(name=" Shop "), record(name="\tOther "))], f"rec int, gold {RECORD}, pred {RECORD}")
    assert [tuple(r) for r in score.mismatches(score.comparisons(odd, ["rec"]), "rec").collect()] == [(1, "name", "Shop", "Other")]


def test_replay_diverges(spark):
    name = "MILK TEA BOTTLE 500ML"
    lines = [{"product_id": "", "product_name": name, "product_unit_price": p, "product_quantity": "", "product_total_money": p} for p in ("10", "20")]
    frame = spark.createDataFrame([(1, record(products=lines), record(products=[{**lines[1], "product_name": name + "."}]))], f"rec int, gold {RECORD}, pred {RECORD}")
    long = score.comparisons(frame, ["rec"])
    right = lambda df: df.filter("field = 'product_unit_price' and ok").count()
    assert right(long) == 1
    assert right(score.comparisons(score.replayed(frame, long, "rec"), ["rec"])) <= 1


def test_aliases(spark):
    rows = spark.createDataFrame([([{"product_code": "7", "product_amount": "2", "product_name": "x"}, {"product_id": "", "product_code": "8"}],)], GOLD["products"].dataType.simpleString().join(["products ", ""]))
    got = rows.select(score.alias_products(F.col("products")).alias("p")).first()["p"]
    assert [(p["product_id"], p["product_quantity"]) for p in got] == [("7", "2"), ("", "")]


def dictionary(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "pos int, canonical string")


def matched(spark, names, raws, **options):
    rows = match.match_names(spark.createDataFrame([(r,) for r in raws], "raw string"), dictionary(spark, names), **options).collect()
    return {r["raw"]: (r["matched"], r["tier"]) for r in rows}


def test_matching(spark):
    stores = ["AEON Mall Tân Phú", "Co.opmart Đinh Tiên Hoàng"]
    got = matched(spark, stores, ["aeon mall tân phú", "AEON Mall Tan Phu", "", None, "zzzz"])
    assert got["aeon mall tân phú"] == (stores[0], "exact") and got["AEON Mall Tan Phu"] == (stores[0], "fuzzy_high")
    assert got[""] == ("", "miss") and got[None] == ("", "miss") and got["zzzz"] == ("zzzz", "miss")
    assert matched(spark, ["Sữa tươi Vinamilk 1L"], ["xyzabcunknown"], cutoff=70, fallback=None) == {"xyzabcunknown": ("xyzabcunknown", "miss")}
    assert matched(spark, ["CO.OPMART X", "Co.opMart X"], ["co.opmart x"])["co.opmart x"] == ("Co.opMart X", "exact")
    # Another start, so the blocks are empty and the whole dictionary is scanned.
    assert matched(spark, stores, ["xAEON Mall Tân Phú"])["xAEON Mall Tân Phú"] == (stores[0], "fuzzy_low")
    # A block that holds something below the cut-off is a miss, not a scan.
    assert matched(spark, ["aeon qqqqqqqqqqqq", "xaeon mall tan ph"], ["aeon mall tan phu"], cutoff=99)["aeon mall tan phu"][1] == "miss"


@pytest.mark.parametrize("kind,n,test", [("x", 10, 3), ("x", 1, 0), ("coopxtra", 6, 2), ("coopxtra", 1, 1)])
def test_split(spark, kind, n, test):
    rows = spark.range(n).select(F.col("id"), F.lit(kind.upper()).alias("type"))
    split = curate.stratified_split(rows, "id")
    assert split.filter("split = 'test'").count() == test and split.count() == n
    assert curate.split_overlap(split, "id").count() == 0
    again = curate.stratified_split(rows.orderBy(F.desc("id")), "id")
    assert split.select("id", "split").exceptAll(again.select("id", "split")).count() == 0


def test_closed_schema(spark):
    raws = {'{"name": "a"}': True, '{"name": "a", "odd": 1}': False, '{"products": [{"product_id": "1"}]}': True, '{"products": [{"x": "1"}]}': False, '{"name": ["a"]}': False, "not json": False, "{}": True}
    rows = spark.createDataFrame(list(raws.items()), "raw string, e boolean").select("raw", "e", curate.closed_schema_valid(F.col("raw")).alias("g")).collect()
    assert [(r["raw"], r["g"]) for r in rows] == [(r["raw"], r["e"]) for r in rows]
    with pytest.raises(Exception, match="invalid record"):
        curate.abort_on_invalid(spark.range(2), F.col("id") < 1).collect()


def test_quality_patterns(spark):
    names = {"caf?": True, "?x": True, "what ?": False, "ok": False, "1?": True}
    rows = spark.createDataFrame(list(names.items()), "n string, e boolean").select("e", curate.garbled(F.col("n")).alias("g")).collect()
    assert all(r["e"] == r["g"] for r in rows)


def test_backpressure(spark):
    levels = {0: "ok", 199: "ok", 200: "warn", 499: "warn", 500: "reject", 501: "reject", None: "ok"}
    rows = spark.createDataFrame(list(levels.items()), "d int, e string").select("e", jobs.backpressure(F.col("d")).alias("b")).collect()
    assert all(r["e"] == r["b"]["level"] and (r["b"]["retry_after"] == 5) == (r["e"] == "reject") for r in rows)


def test_stale_is_strict(spark):
    rows = [("a", "PROCESSING", "2024-01-01 00:00:00", "2024-01-01 00:45:00"), ("b", "PROCESSING", "2024-01-01 00:00:00", "2024-01-01 00:44:59"), ("c", "PENDING", "2024-01-01 00:29:59", "2024-01-01 00:59:00"), ("d", "SUCCEEDED", "2023-01-01 00:00:00", "2023-01-01 00:00:00")]
    frame = spark.createDataFrame(rows, "job_id string, status string, c string, u string").select("job_id", "status", F.col("c").cast("timestamp").alias("created_at"), F.col("u").cast("timestamp").alias("updated_at"))
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    assert {r["job_id"] for r in frame.filter(jobs.stale(now)).collect()} == {"b", "c"}
    assert [r["job_id"] for r in frame.filter(jobs.expired(now)).collect()] == ["d"]


def test_update_keeps_old_errors(spark):
    schema = "job_id string, status string, error_code string, updated_at string"
    table = spark.createDataFrame([("a", "FAILED_TRANSIENT", "stale_timeout", "x"), ("b", "PENDING", None, "x")], schema)
    changes = spark.createDataFrame([("a", "SUCCEEDED", None), ("b", "PROCESSING", "c")], "job_id string, status string, error_code string")
    rows = {r["job_id"]: tuple(r)[1:] for r in jobs.update(table, changes, F.lit("now")).collect()}
    assert rows == {"a": ("SUCCEEDED", "stale_timeout", "now"), "b": ("PROCESSING", "c", "now")}
    strict = {r["job_id"]: r["status"] for r in jobs.update(table, changes, F.lit("now"), strict_terminal=True).collect()}
    assert strict == {"a": "FAILED_TRANSIENT", "b": "PROCESSING"}
    twice = spark.createDataFrame([("a", "PROCESSING", "one", 1), ("a", "SUCCEEDED", None, 2)], "job_id string, status string, error_code string, turn int")
    assert [tuple(r) for r in jobs.update(table, twice, F.lit("now"), order="turn").orderBy("job_id").collect()] == [("a", "SUCCEEDED", "one", "now"), ("b", "PENDING", None, "x")]


def test_new_jobs_refuse_long_urls(spark):
    frame = spark.createDataFrame([("a", "u" * 512), ("b", "u" * 513)], "job_id string, image_url string")
    assert jobs.new_jobs(frame.filter("job_id = 'a'"), F.lit("now")).first()["image_url"] == "u" * 512
    with pytest.raises(Exception, match="too long"):
        jobs.new_jobs(frame, F.lit("now")).collect()


def test_exceptions_and_hashes(spark):
    rows = spark.createDataFrame([("DatabaseUnavailable",), ("StorageTransient",), ("KeyError",), (None,)], "e string").select(jobs.exception_status(F.col("e")).alias("s")).collect()
    assert [r["s"] for r in rows] == [503, 503, 500, 500]
    table = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "job_id string, phash string")
    fresh = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w"), ("d", "q")], "job_id string, phash string")
    assert {tuple(r) for r in jobs.phash_changes(table, fresh).collect()} == {("b", "z"), ("c", "w")}


def test_postprocess(spark):
    """A record by all its rules; names by the dictionaries, a product name never by a scan."""
    lines = [("7", "milk tea botle", "10.000", "10.000", "", "20,000"), ("8", "zzz", "", "0,47", "", "(5)")]
    kind = "struct<name:string,type:string,date:string,time:string,pos_id:string,receipt_number:string,cashier:string,total_money:string,barcode:string,products:array<struct<product_id:string,product_name:string,product_unit_price:string,product_quantity:string,product_discount_money:string,product_total_money:string>>>"
    record_ = ("aeon mall tân phú", " AEON ", "31-12-2025", " 10:00", " 1", "2 ", None, "24.000đ", "*1*", lines)
    rows = spark.createDataFrame([(1, record_), (2, None), (3, (*record_[:9], None))], f"id int, record {kind}")
    done = {r["id"]: r["record"] for r in match.postprocessed(rows, dictionary(spark, ["AEON Mall Tân Phú"]), dictionary(spark, ["Milk Tea Bottle", "Other"])).collect()}
    assert tuple(done[1])[:9] == ("AEON Mall Tân Phú", "aeon", "31/12/2025", "10:00", "1", "2", "", "24000", "*1*") and done[2] is None and done[3]["products"] == []
    assert [tuple(p) for p in done[1]["products"]] == [("7", "Milk Tea Bottle", "10000", "10", "", "20000"), ("8", "zzz", "", "0.47", "", "-5")]


def test_records_are_folded_at_every_level(spark):
    rows = spark.createDataFrame([("A  É", "KEEP", [("Đ  x", "Keep")], {"a": 1})], "name string, type string, products array<struct<n:string,file:string>>, other map<string,int>")
    assert [tuple(r) for r in curate.normalized_records(rows).collect()] == [("a e", "KEEP", [("d x", "Keep")], {"a": 1})]


def test_token_bucket(spark):
    at = [0.0] * 9 + [0.25, 100.0, *[100.0] * 8]
    frame = spark.createDataFrame([("k", t, i) for i, t in enumerate(at)], "k string, at double, seq int")
    got = [r["granted"] for r in jobs.token_grants(frame.repartition(3), "k", "at", "seq", 4.0, 8.0).orderBy("seq").collect()]
    assert got == [True] * 8 + [False, True] + [True] * 8 + [False]


def test_retries(spark):
    cases = {(429,): (1, "yield", 0.0), (500, 500, 500, 500, 200): (4, "gemini_exhausted", 2.1), (404,): (1, "permanent", 0.0), (0, 200): (2, "ok", 0.3)}
    rows = spark.createDataFrame([(list(k),) for k in cases], "o array<int>").select("o", jobs.retry_plan(F.col("o")).alias("r")).collect()
    assert {tuple(r["o"]): (r["r"]["calls"], r["r"]["result"], round(r["r"]["slept"], 6)) for r in rows} == cases


def test_metrics(spark):
    samples = spark.createDataFrame([("a", t, v) for t, v in ((0, 1), (60, 5), (120, 2), (180, 4))], "s string, t int, value int").withColumn("ts", F.timestamp_seconds("t"))
    assert [r["increase"] for r in metrics.increases(samples, ["s"]).orderBy("t").collect()] == [None, 4, 2, 2]
    assert [round(r["rate"], 6) for r in metrics.rates(samples, ["s"], ["s"], "4 minutes").collect()] == [round(8 / 240, 6)]
    buckets = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 6), ("a", float("inf"), 8), ("b", 1.0, 0), ("b", float("inf"), 0)], "s string, le double, n long")
    assert [tuple(r) for r in metrics.histogram_quantile(buckets, 0.5, ["s"]).collect()] == [("a", 1.5)]
    assert [tuple(r) for r in metrics.histogram_quantile(buckets, 0.95, ["s"]).collect()] == [("a", 2.0)]


def test_geometry(spark):
    anchors = spark.createDataFrame([(1, i, c) for i, c in enumerate((0.05, 0.95, 0.10, 0.95))], "image int, anchor int, conf double")
    assert geometry.best_anchor(anchors, "image").first()["anchor"] == 1
    number = lambda v: F.lit(float(v))
    box = spark.range(1).select(geometry.decode_box(*map(number, (320, 320, 200, 200, 0.95)), F.lit(1000), F.lit(1000)).alias("b")).first()["b"]
    assert tuple(box) == (338, 338, 662, 662, None)
    low = spark.range(1).select(geometry.decode_box(*map(number, (320, 320, 200, 200, 0.1)), F.lit(1000), F.lit(1000)).alias("b")).first()["b"]
    assert low["error_code"] == "no_invoice_detected"


def test_adapter(spark):
    from tallywright.operators import adapter
    from tallywright.schemas import Settings

    calls = []

    def failing(error, times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return "done"

        return call

    quiet = {"sleep": lambda _: None}
    for error, times, expected in ((adapter.Throttled(), 9, ("yield", None, 1)), (adapter.Refused(), 9, ("permanent", None, 1)), (OSError(), 9, ("gemini_exhausted", None, 4)), (OSError(), 2, ("ok", "done", 3))):
        calls.clear()
        assert adapter.call_with_retries(failing(error, times), **quiet) == expected
    rows = adapter.with_adapter(spark.createDataFrame([("a",), ("b",)], "v string"), lambda: str.upper, "v", "said", Settings()).collect()
    assert {(r["v"], r["said"], r["outcome"], r["calls"]) for r in rows} == {("a", "A", "ok", 1), ("b", "B", "ok", 1)}


def test_run_budget(spark):
    log = lambda *rows: spark.createDataFrame(list(rows), "run int, final boolean")
    assert score.next_run(log()) == {"run": 1, "refusal": None}
    assert score.next_run(log((1, False), (2, False), (3, False))) == {"run": 4, "refusal": "budget"}
    assert score.next_run(log((1, True))) == {"run": 2, "refusal": "locked"}


@pytest.mark.parametrize("scorer", ["weighted", "edit"])
@pytest.mark.parametrize("sent", [100_000, 10])
def test_best_of_a_whole_dictionary(spark, monkeypatch, scorer, sent):
    """The search by letters equals scoring all pairs, in one plan and by falling scores, for words in another order, parts, repeats and white space of all kinds."""
    from tallywright.functions import similarity

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    plain = similarity.weighted_ratio.__wrapped__ if scorer == "weighted" else lambda a, b: 100.0 * (max(len(a), len(b)) - distance(a, b)) / max(len(a), len(b))
    monkeypatch.setattr(match, "SENT_ENTRIES", sent)
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("aeioutnsrlkmđ", k=rnd.randint(1, 8))) for _ in range(60)]
    entries = list(dict.fromkeys([" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 5))) for _ in range(250)] + ["\t", "a a a a", "a\xa0b"]))
    probes = {(" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 4))) + rnd.choice(["", "q", "zz"]))[rnd.randint(0, 2) :].strip() for _ in range(60)} | {"zz123", "a", "a b a b", "q" * 60}
    probes -= {""}
    found = match.best_matches(spark.createDataFrame([(p,) for p in probes], "lower string"), spark.createDataFrame([(e, e.upper(), i) for i, e in enumerate(entries)], "lower string, canonical string, pos int"), 60.0, getattr(similarity, f"{scorer}_score"))
    got = {r["lower"]: (r["canonical"], round(r["score"], 9)) for r in found.collect()}
    best = {p: max((plain(p, e), -i, e.upper()) for i, e in enumerate(entries)) for p in probes}
    assert got == {p: (e, round(s, 9)) for p, (s, _, e) in best.items() if s >= 60}


def test_no_nested_loop(spark):
    entries = spark.createDataFrame([(0, "Alpha Shop"), (1, "Beta Store")], "pos int, canonical string")
    done = match.match_names(spark.createDataFrame([("zz alpha shop",), (None,), ("ALPHA SHOP",)], "raw string"), entries)
    assert "NestedLoop" not in done._jdf.queryExecution().toString() and "Cartesian" not in done._jdf.queryExecution().toString()
    assert {(r["raw"], r["matched"], r["tier"]) for r in done.collect()} == {("zz alpha shop", "Alpha Shop", "fuzzy_low"), (None, "", "miss"), ("ALPHA SHOP", "Alpha Shop", "exact")}


def test_names_are_composed_and_entries_left_as_they_are(spark):
    entries = spark.createDataFrame([(0, "Café"), (1, " padded ")], "pos int, canonical string")
    rows = match.match_names(spark.createDataFrame([("Café",), ("padded",), ("xé",)], "raw string"), entries, cutoff=100.0, fallback=None).collect()
    assert {(r["raw"], r["matched"], r["tier"]) for r in rows} == {("Café", "Café", "exact"), ("padded", "padded", "miss"), ("xé", "xé", "miss")}


def test_outcomes_may_tell_that_they_are_permanent(spark):
    stages = [s for s, _, _ in jobs.STAGES]
    rows = [("gemini_client_error",), ("gemini_api_key_missing",), ("permanent:new_code",), ("permanent:storage_transient",), ("new_code",)]
    frame = spark.createDataFrame(rows, "extract string").select(F.lit("PENDING").alias("status"), F.lit(0).alias("requeue_count"), F.lit(False).alias("cached"), *[F.lit(None).cast("string").alias(s) for s in stages if s != "extract"], "extract")
    got = {r["extract"]: (r["new_status"], r["new_code"]) for r in jobs.lifecycle(frame).collect()}
    gone = lambda code: ("FAILED_PERMANENT", code)
    assert got == {"gemini_client_error": gone("gemini_client_error"), "gemini_api_key_missing": gone("gemini_api_key_missing"), "permanent:new_code": gone("new_code"), "permanent:storage_transient": gone("storage_transient"), "new_code": ("FAILED_TRANSIENT", "lifecycle_uncaught")}


def test_chain_formats(spark):
    from tallywright.operators import chains

    rows = [
        ("lotte", "LOTTE MART NAM SAI GON", "1064-0020", "1064-0020", ""), ("lotte", "Emart Phan", "1064", "12345", "x"), ("bhx_2024", "BÁCH HÓA XANH", "106729", "OV1", "someone"), ("bhx_2024", "PHIẾU THANH TOÁN BÁCH HÓA XANH", "", None, None),
        ("other", "x", "x", "x", "x"), (None, "GO! GO VAP", "1", "1", "1"), ("satra", "TRUNG TÂM THƯƠNG MẠI SATRA CỦ CHI", "SGT1", "24SGT", "Trần"),
    ]
    frame = spark.createDataFrame(rows, "type string, name string, pos_id string, receipt_number string, cashier string")
    got = [tuple(r) for r in frame.select(chains.chain_of(F.col("name")).alias("c"), chains.broken_formats(F.col("type"), {c: F.col(c) for c in frame.columns[1:]}).alias("b")).collect()]
    assert got == [("lotte", []), ("emart", ["name", "pos_id", "receipt_number", "cashier"]), ("bhx_2024", ["receipt_number", "cashier"]), (None, ["name"]), (None, []), ("bigc", []), ("satra", ["pos_id", "receipt_number"])]
    lines = spark.createDataFrame([("emart", "01) VAT08  CAFE"), ("lotte", "01) VAT08  CAFE"), ("emart", None)], "t string, n string").select(chains.line_name(F.col("t"), F.col("n")).alias("l")).collect()
    assert [r["l"] for r in lines] == ["CAFE", "01) VAT08  CAFE", ""]
