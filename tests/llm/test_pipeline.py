"""The pipeline stage by stage against plain versions of what each stage has to do."""

import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tallywright.llm import common
from tallywright.llm import bpe, lines, mixing, simhash, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, []
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{place}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{place}")
        assert set(docs.columns) >= set(columns) and (place == 4 or docs.columns == columns), name
        kept.append((before, docs))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    toxic = toxicity.score(kept[0][0], toxicity.fit(kept[0][0], labels)).filter(F.col("toxicity") >= 0.5)
    assert kept[0][1].count() == kept[0][0].count() - toxic.count()
    whole = {r["doc_id"]: r["text"] for r in kept[1][0].collect()}
    groups = {}
    for r in lines.line_groups(kept[1][0]).collect():
        groups.setdefault(r["doc_id"], {})[r["no"]] = r["kept"]
    for r in kept[1][1].collect():
        parts = whole[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(p for i, p in enumerate(parts) if groups.get(r["doc_id"], {}).get(i, True)) and r["n_chars"] == len(r["text"])
    prints = {}
    for r in kept[2][1].collect():
        prints[r["doc_id"]] = simhash.fingerprint(r["text"])
    assert not [1 for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    taken = {r["key"]: r["copies"] for r in mixing.mix(kept[3][0]).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in kept[3][1].groupBy("doc_id").count().collect()} == taken
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    for r in kept[4][1].collect():
        assert r["ids"] == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"])


def test_planted_cases(spark, tmp_path):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:7] for i in range(4000)]
    text = lambda n: "\n".join(" ".join(words[(n * 97 + 12 * k + j) % 4000] for j in range(12)) for k in range(8))
    rows = [(i, text(i), "en", f"s{i % 2}", 0) for i in range(30)] + [(100, text(3), "en", "s0", 0), (101, text(4).replace(words[400], "changed", 1), "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.drop_repeated_lines(spark, docs, SMALL)
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, cleaned, SMALL).collect()}
    assert left == set(range(30))


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] == corpus_pipeline.run
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and keys, further columns and empty tables, through all stages."""
    one = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = "one two three four five six seven " * 2000
    odd = [(None, "a text that has no key", "en", "s", 1), (None, None, None, None, None), (900001, None, "en", "s", 0), (900002, "", None, None, 0), (900003, " \n\t", "en", "s", 3), (900004, long, "en", "t", 9), (900005, "said twice by one key", "en", "s", 5), (900005, "and once otherwise", "en", "s", 5)]
    rows = spark.createDataFrame(odd + odd[:1] + odd[6:7], one.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = one.select(*rows.columns).limit(60).unionByName(rows).withColumns({"key": F.lit("k"), "fp": F.lit("f"), "size": F.lit("s"), "no": F.lit("n"), "node": F.lit("x")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, docs.filter(F.lit(False))):
        kept, columns = start, start.columns
        for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
            with common.scratch(spark):
                found = stage(spark, kept, str(tmp_path)).collect()
            assert place == 4 or not found or list(found[0].asDict()) == columns, name
            if place < 4:
                kept = spark.createDataFrame(found, start.schema)
        assert bool(found) == (start is docs)
        if place == 4 and found:
            assert all((r["n_tokens"] > 0) == bool(r["text"]) for r in found)


def test_run_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 0 and {"ids", "n_tokens"} <= set(rows.columns)
    left = [p.name for p in (tmp_path / "shared").iterdir()]
    assert len(left) == 1 and [p.name for p in (tmp_path / "shared" / left[0]).iterdir()] == ["4"]
