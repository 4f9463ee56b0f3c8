"""URL filter, concurrency sweep and filter audit: against plain versions, and on nulls, ties, repeats and empty tables."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywright.llm import audit, concurrency, queries, urlfilter

MIDDLE = "/root/testdata/sf0.01"
RULES = queries.RULES


# URL filter


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path):
    fits = []
    for verdict, text in RULES:
        name, _, start = text.partition("/")
        if (host == name or host.endswith(f".{name}")) and path.startswith(f"/{start}"):
            fits.append((len(text), text, verdict))
    return max(fits, default=(0, None, None))[1:]


ODD = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "HTTP://A.Net/x", "ftp://example.net/en", "http://example.net/en/", "http://m.example.net/en/9?x=1", "http://badexample.net/en/", "http://example.com/de/1",
    "http://example.com/de", "http://x.example.com/de/1#/fr/", "http://a.org/fr/", "http://a.org?/fr/", "http://org/fr/x", "http://listed.com/a", "https://www.Listed.com:443/a/?utm_source=q#top", "http://user@listed.com/a?ref=1&",
    "http://listed.com/a?b=2&a=1", "http://listed.com/a?a=1&b=2", "http://listed.com/b", "http://a/b://c", "http://listed.com/a\nb", "http://listed.com./a",
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(ODD)] + [(99, "http://listed.com/a", "x", "y")] * 3, "page_id long, url string, host string, verdict string").repartition(3)
    listed = spark.createDataFrame([("http://listed.com/a",), ("http://listed.com/a",), ("https://listed.com/a?b=2&a=1&utm_medium=x",), (None,), ("odd",), ("http://deep.net/en/",)], "url string")
    rows = urlfilter.judge(pages, listed, RULES).collect()
    assert len(rows) == len(ODD) + 3 and set(rows[0].asDict()) == {"page_id", "url", "host", "path", "rule", "verdict", "listed"}
    held = {"http://listed.com/a", "https://www.Listed.com:443/a/?utm_source=q#top", "http://user@listed.com/a?ref=1&", "http://listed.com/a?b=2&a=1", "http://listed.com/a?a=1&b=2", "http://listed.com./a"}
    for r in rows:
        host, path = plain_parts(r["url"])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["listed"]) == (host, path, rule, r["url"] in held), r
        assert r["verdict"] == (verdict or ("block" if r["url"] in held else "allow"))


def test_url_filter_without_list_or_pages(spark):
    none, pages = spark.createDataFrame([], "url string"), spark.createDataFrame([("http://a.com/",), (None,)], "url string")
    assert [r["verdict"] for r in urlfilter.judge(pages, none).collect()] == ["allow", "allow"]
    assert urlfilter.judge(none, pages, RULES).count() == 0
    with pytest.raises(ValueError, match="rules"):
        urlfilter.judge(pages, none, [("block", f"h{i}/") for i in range(urlfilter.MOST_RULES + 1)])


def test_bloom_filter_passes_listed_and_few_others(spark):
    """Every listed key passes, of 20,000 others under a hundredth, and the join decides about those."""
    keys = spark.range(5000).select(F.concat(F.lit("in"), "id").alias("key"))
    blocks = urlfilter.blocks_for(5000)
    bloom = urlfilter.bloom_filter(keys, "key", blocks)
    assert bloom.count() <= blocks
    assert urlfilter.maybe_listed(keys, "key", bloom, blocks, "m").filter("m").count() == 5000
    others = spark.range(20_000).select(F.concat(F.lit("out"), "id").alias("key"))
    assert urlfilter.maybe_listed(others, "key", bloom, blocks, "m").filter("m").count() < 200


def test_url_filter_when_the_filter_is_full(spark, monkeypatch):
    """A list beyond the filter's bound passes nearly all rows, with the same verdicts."""
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", 1)
    pages = spark.range(2000).select(F.concat(F.lit("http://h.com/"), "id").alias("url"), "id")
    rows = urlfilter.judge(pages, pages.filter("id % 2 = 0").select("url")).filter("verdict = 'block'")
    assert {r["id"] % 2 for r in rows.select("id").collect()} == {0} and rows.count() == 1000


def test_url_plan_is_native(spark):
    plan = queries.op11_url_filter(spark, MIDDLE)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|CartesianProduct|NestedLoop", plan)


# Concurrency


def plain_sweep(intervals):
    moves = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for nation, start, end, n, cents in intervals:
        for at, sign in ((start, 1), (end, -1)):
            if at is not None:
                moves[nation][at][0] += sign * n
                moves[nation][at][1] += sign * cents
    rows = []
    for nation, of in moves.items():
        n = cents = high = 0
        found = []
        for at in sorted(t for t, d in of.items() if d != [0, 0]):
            n, cents = n + of[at][0], cents + of[at][1]
            high = max(high, n) if found else n
            found.append((at, n, cents, high))
        top = max((c for _, _, c, _ in found), default=0)
        rows += [(nation, at, found[i + 1][0] if i + 1 < len(found) else None, n, cents, high, cents == top) for i, (at, n, cents, high) in enumerate(found)]
    return sorted(rows, key=str)


SPANS = "nation int, start long, end long, n long, cents long"


@pytest.mark.parametrize("longest,span", [(50, 2000), (3000, 400_000), (720, 2160)])
def test_sweep_equals_plain(spark, longest, span):
    """Short intervals in few chunks, long ones over thousands of chunks (more than one group of the scan), and ends on the borders of chunks."""
    rnd = random.Random(longest)
    near = [0, 1, 719, 720, 721, 1439, 1440, -720, -1, -721]
    rows = []
    for _ in range(1500):
        start = rnd.choice(near) if longest == 720 else rnd.randrange(-span // 2, span)
        end = None if rnd.random() < 0.05 else start + (rnd.choice([1, 719, 720, 721, 1440]) if longest == 720 else rnd.randint(1, longest))
        rows.append((rnd.choice([-2, 3, 3, 3, 7]), start, end, rnd.randint(1, 3), rnd.choice([0, 0, -50, 100, 12345])))
    rows += rows[:100] + [(9, 100, 200, 1, 5), (9, 200, 300, 1, 5), (9, 300, 300 + 720 * 300, 1, 5), (11, 5, 6, 1, -7)]
    got = concurrency.concurrency(spark.createDataFrame(rows, SPANS).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_sweep(rows)


def test_sweep_of_large_chunks_in_parts(spark, monkeypatch):
    """A chunk larger than what a task takes up, and than an Arrow batch, is still swept as one."""
    monkeypatch.setattr(concurrency, "ROWS_AT_ONCE", 16)
    rows = [(n, i % 300, i % 300 + 1 + i % 97, 1, i) for n in range(6) for i in range(700)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = concurrency.concurrency(spark.createDataFrame(rows, SPANS)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=str) == plain_sweep(rows)


def test_forest_stabs_as_scans():
    rnd = np.random.default_rng(5)
    lo = rnd.integers(0, concurrency.CHUNK, 4000)
    hi = np.minimum(lo + rnd.integers(0, 200, 4000) * rnd.integers(0, 2, 4000), concurrency.CHUNK)
    tree, w = np.sort(rnd.integers(0, 5, 4000)), rnd.integers(-9, 99, 4000)
    own, at = np.repeat(np.arange(5), concurrency.CHUNK), np.tile(np.arange(concurrency.CHUNK), 5)
    found = concurrency.IntervalForest(tree, lo, hi, [np.ones(4000, np.int64), w]).stab(own, at)
    for t, m, n, c in zip(own[::37], at[::37], found[0][::37], found[1][::37]):
        here = (tree == t) & (lo <= m) & (m < hi)
        assert (n, c) == (here.sum(), w[here].sum())


def test_sales_edges(spark):
    """Null and unknown clients, no lines, null starts, ends before starts, totals that are no numbers, repeated sales and clients, clashing names."""
    day = datetime(2024, 1, 10)
    sales = [
        (1, 1, 10.005, day + timedelta(seconds=59)), (1, 1, 10.005, day + timedelta(seconds=59)), (2, None, None, day), (3, 99, float("nan"), day), (4, 2, float("inf"), day), (5, 3, 1.0, None), (None, 1, 2.0, day + timedelta(days=1)), (6, 1, 5.0, day), (7, 1, 7.0, day),
    ]
    lines = [(1, day + timedelta(days=2)), (1, day), (1, None), (6, day - timedelta(days=7)), (7, day - timedelta(days=6)), (None, day), (2, None)]
    clients = [(1, 4), (1, 5), (2, None), (None, 6), (3, 1)]
    frames = (
        spark.createDataFrame([(*r, "x", "y") for r in sales], "sale_id long, client_id long, total double, sold_at timestamp_ntz, start string, nation string"),
        spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"), spark.createDataFrame(clients, "client_id long, nation_id int"),
    )
    minute = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 60
    at, end = minute(day), minute(day + timedelta(days=7))
    spans = [(4, at, end, 1, 1001), (4, at, end, 1, 1001), (-1, at, None, 1, 0), (-1, at, None, 1, 0), (-1, at, None, 1, 0), (4, at + 1440, None, 1, 200), (4, at, at + 1440, 1, 700)]
    want = plain_sweep(spans + [(-2, *s[1:]) for s in spans])
    got = concurrency.sales_concurrency(*frames).collect()
    assert sorted(((r[0], r[1] // 60, r[2] and r[2] // 60, *r[3:]) for r in got), key=str) == want
    assert concurrency.sales_concurrency(frames[0].filter("false"), *frames[1:]).count() == 0
    # The same moments with a zone.
    zoned = frames[0].withColumn("sold_at", F.col("sold_at").cast("timestamp"))
    assert sorted(map(tuple, concurrency.sales_concurrency(zoned, *frames[1:]).collect()), key=str) == sorted(map(tuple, got), key=str)


# Filter audit


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text) is not None)
    return sum(1 << i for i, t in enumerate(tests) if t)


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, lang in docs:
        parts[lang or ""].append((plain_mask(t or "") | (16 if i is not None and i > first[t or ""] else 0), i in good, i in toxic))
    rows = []
    for part, of in parts.items():
        lost = Counter()
        made = []
        for order in permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in of if x[0] & bit and not x[0] & before]
                lost[letter] += len(gone)
                made.append((part, "".join(order), step, sum(not x[0] & (before | bit) for x in of), len(gone), sum(bool(x[0] & bit and x[0] & before) for x in of), sum(x[0] == bit for x in of), sum(x[1] for x in gone), sum(x[2] for x in gone), letter))
                before |= bit
        rows += [(*r[:-1], lost[r[-1]]) for r in made]
    return sorted(rows)


LONG = "word " * 300 + "Tail"
DOCS = [
    (1, "", "en"), (2, None, "en"), (3, "  \t\x0b ", None), (4, LONG, "de"), (5, LONG, "de"), (5, LONG, "fr"), (4, LONG, "de"), (None, LONG, "de"), (None, None, None), (6, " ".join(f"w{i}" for i in range(250)), "en"), (7, " ".join(f"W{i}#" for i in range(250)), "en"),
    (8, "ÄÖÜ é🙂 a|b " * 100, "de"), (9, "x" * 300_000 + " " + "x" * 300_000, "en"), (10, "\x85\xa0 no\u2003break", ""), (11, " ".join(f"w{i}" for i in range(250)), "en"), (12, "a" * 70 + " " + "a" * 69 + "b " + "a" * 70, "fr"),
]


def test_audit_equals_plain(spark):
    labels = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (5, None, 1), (6, 1, None), (None, 1, 1), (77, 1, 1), (8, 0, 1), (8, 1, 0)]
    docs = spark.createDataFrame([(*d, "clash", "clash") for d in DOCS], "doc_id long, text string, lang string, part string, words string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, known)
    assert sorted(map(tuple, got.collect())) == plain_audit(DOCS, labels)
    assert audit.audit(docs.filter("false"), known).count() == 0
    assert {r["good_lost"] for r in audit.audit(docs, known.filter("false")).collect()} == {0}


def test_counts_from_buffers():
    """Offsets of sliced arrays, nulls, and hashes that all collide: the counts stay."""
    rnd = random.Random(2)
    texts = [None, ""] + ["".join(rnd.choices("ab AZ#é🙂\t\n\x85", k=rnd.randint(0, 40))) for _ in range(300)] + ["y" * 100 + " " + "y" * 99 + "z " + "y" * 100]
    want = [(len(w := re.findall(r"[^\x20\x09-\x0D]+", t or "")), len(set(w)), len(re.findall("[A-Z]", t or "")), len(re.findall(r"[#$%&*|]", t or "")), len(t or "")) for t in texts]
    same = lambda data, starts, ends: np.zeros(len(starts), np.uint64)
    for kind in (pa.string(), pa.large_string()):
        for start in (0, 1, 5):
            for hashed in (audit.span_hashes, same):
                assert list(zip(*(c.tolist() for c in audit.counted(pa.array(texts, kind).slice(start), hashed)))) == want[start:]
