"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallywright.llm import bpe, langid, lines, mixing, neighbours, pii, quality, simhash, toxicity, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, score string, size string, ids string, no string, entities string, node string, h string"
LONG = "A long line of many words that goes on. " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "   \n\t", "de", None), (5, LONG, "en", "b"),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "b"), (7, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"), (7, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
    (None, "No key here at all.", "en", "c"), (8, "x", None, "c"), (9, "12345 !!!", "en", ""), (10, "naïve 🙂 \x00   text\r\nline", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["clash"] * 9) for i, t, lang, s in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in (1, 3, 5, 6, 7, 8, 9, 10)] + [(None, 1, 0), (4, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter(F.lit(False))


def test_bpe(docs, none):
    path, outputs = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ("n_tokens", "ids", "decoded_sha256")
    done = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, outputs=outputs)
    assert set(done.columns) == set(docs.columns) | set(outputs)
    rows = done.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) and (r["n_tokens"] > 0) == bool(r["text"])
    assert bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0


def test_language(docs, none):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in {"und", *model.languages}
    empty = langid.fit(none)
    assert empty.languages == [] and langid.identify(none, empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_toxicity(docs, labels, none):
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, output="score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    empty = toxicity.fit(none, labels)
    assert len(empty[0]) == len(empty[1]) == len(toxicity.fit(docs, labels.filter(F.lit(False)))[0]) == 0
    assert {r["toxicity"] for r in toxicity.score(docs, empty).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_quality(docs, labels, none):
    field = quality.fit(docs, labels)
    rows = quality.score(docs, field, output="score", lines="size").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["score"] <= 1 and len(r["size"]) == (r["text"] or "").count("\n") + 1
    assert quality.fit(none, labels) is None
    assert all(abs(r["quality"] - 0.5) < 1e-9 for r in quality.score(docs, None).collect())


def test_winnowing(docs, none):
    rows = winnowing.compared_with_follower(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert winnowing.compared_with_follower(none).count() == 0
    one = winnowing.compared_with_follower(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert winnowing.fingerprints(docs.select("doc_id", "text", F.lit(1).alias("hashes"))).count() == len(ROWS)


def test_winnowing_keys(spark):
    """Keys of any type; thousands of null keys and of equal rows spread over tasks; every row has the follower that a plain sort gives."""
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = [" ".join(words[(i * j) % 5] for j in range(1, 12)) + str(i) for i in range(60)]
    named = [(f"k{i:03d}", t) for i, t in enumerate(texts)]
    rows = {r["name"]: r for r in winnowing.compared_with_follower(spark.createDataFrame(named, "name string, text string").repartition(5), key="name").collect()}
    for i, (name, text) in enumerate(named):
        after = texts[(i + 1) % len(texts)]
        assert rows[name]["edited_sha256"] == hashlib.sha256(winnowing.with_edited(text, after).encode()).hexdigest()
        assert rows[name]["near_next"] == winnowing.likeness(winnowing.winnow(text)[0], winnowing.winnow(after)[0])
    keyless = spark.range(4000).select(F.lit(None).cast("string").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    equal = spark.range(4000).select(F.lit("k").alias("doc_id"), F.lit("one text in very many rows").alias("text"))
    both = keyless.unionByName(equal)
    sizes = [len(p) for p in winnowing.in_order(both, "doc_id", "text").rdd.glom().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 4000
    found = winnowing.compared_with_follower(both).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("near_next") == 1).alias("same")).collect()
    # Null keys come first; the last equal row is followed by the first of all.
    assert {(r["doc_id"], r["n"], r["same"]) for r in found} == {(None, 4000, 0), ("k", 4000, 3999)}


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    group = {r["doc_id"]: (r["fp"], r["component_id"]) for r in rows}
    assert group[1][1] == group[7][1] == 1
    assert group[2] == group[3] == group[4] == (0, 2)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (3, 4, 7)").count() == 0 and kept.filter("doc_id is null").count() == 1


def test_simhash_keeps_one_row(spark):
    """Of rows that share the key that stays, one does, and of groups without a key one row."""
    one, two, three = ("one two three four five six", "seven eight nine ten eleven", "quite another text of some words")
    docs = spark.createDataFrame([(1, one), (1, one), (1, two), (2, one), (None, two), (None, three), (None, three), (3, two)], "doc_id long, text string").withColumn("component", F.lit("x")).withColumn("fp_", F.lit("y"))
    rows = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicated(docs).collect()), key=str)
    assert rows == [(1, one), (1, two), (None, three)]
    assert simhash.deduplicated(docs.filter(F.lit(False))).count() == 0


def test_lines(docs, none):
    rows = lines.line_groups(docs).collect()
    assert {(r["doc_id"], r["no"], r["kept"]) for r in rows if r["doc_id"] in (1, 7)} == {(1, 0, True), (7, 0, False)}
    assert not [r for r in rows if r["doc_id"] in (2, 3, 4)] and [(r["no"], r["kept"]) for r in rows if r["doc_id"] is None] == [(0, True)]
    cleaned = lines.deduplicated(docs)
    assert cleaned.columns == docs.columns
    left = [r["doc_id"] for r in cleaned.collect()]
    assert 7 not in left and {1, 2, 3, 4, 5, 6, 8, 9, 10} <= set(left) and None in left
    assert lines.line_groups(none).count() == 0 and lines.deduplicated(none).count() == 0


def test_lines_without_keys(spark):
    """Rows without a key are documents by their texts, behind those that have one."""
    rows = [(None, "a line that two of them have\nown line of the first"), (None, "a line that two of them have\nown line of the other"), (5, "a line that two of them have"), (None, "own line of the other, again\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in lines.deduplicated(docs).collect()) == ["a line that two of them have", "own line of the first", "own line of the other", "own line of the other, again\n"]
    again = lines.deduplicated(docs.unionByName(docs.filter("text like '%first'")))
    assert sorted(r["text"] for r in again.collect()).count("own line of the first") == 2


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in rows)
    assert {r["size"] for r in rows if r["key"] in (2, 3, 4)} == {0}
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    again = docs.unionByName(docs).unionByName(docs)
    taken = sum(r["copies"] for r in mixing.mix(again).collect())
    assert mixing.mixed_documents(again).count() == taken
    blank = mixing.mix(docs.filter("doc_id in (2, 3)")).collect()
    assert [r["taken"] for r in blank] == [0, 0] and {r["target"] for r in blank} == {0.0}


def test_pii(docs, none):
    done = pii.pseudonymised(docs, "key")
    assert done.columns[-1] == "entities" and set(done.columns) == set(docs.columns)
    assert {(r["doc_id"], r["text"]) for r in done.collect()} == {(i, t) for i, t, *_ in ROWS}
    assert pii.pseudonymised(none, "key").count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (9, []), (10, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("x")).withColumn("score", F.lit("y"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.nearest(table).collect()}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, 1): 1, (0, 2): 2, (0, 3): 50, (0, 4): 8}
    assert {v for (q, _), v in got.items() if q == 50} == {0, 1, 2, 8}
    assert neighbours.nearest(table.filter(F.lit(False))).count() == 0
    assert neighbours.nearest(table.filter("vec_id = 0")).count() == 0
