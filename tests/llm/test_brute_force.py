"""Operators against plain versions on small fixtures, round trips, and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tallywright.llm import bpe, common, components, langid, lines, mixing, neighbours, pii, quality, queries, simhash, toxicity, winnowing

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        return bpe.BytePairCodec(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, texts, library):
    rows = {r["doc_id"]: r for r in queries.op5_byte_bpe(spark, SMALL).collect()}
    assert len(rows) == len(texts)
    for i, text in texts:
        ids = library.encode_ordinary(text)
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_appends_and_edits(codec, library):
    rnd, letters = random.Random(3), "aAéß  \n\t\x1c\x85\xa0²½١一あ🙂'sтест,.!_09\r"
    for _ in range(2000):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 30)))
        assert codec.encode(text) == library.encode_ordinary(text)
        a = rnd.randint(0, len(text))
        b, new = rnd.randint(a, len(text)), "".join(rnd.choices(letters, k=rnd.randint(0, 6)))
        edited = bpe.EditableText(codec, text)
        edited.replace(a, b, new)
        assert edited.ids() == library.encode_ordinary(text[:a] + new + text[b:])
        edited.append(text)
        assert edited.ids() == library.encode_ordinary(text[:a] + new + text[b:] + text)
    for _ in range(300):
        data = "".join(rnd.choices("abtheionäß ", k=rnd.randint(0, 40))).encode()
        a = rnd.randint(0, len(data))
        b = rnd.randint(a, len(data))
        prefix = bpe.PrefixEncoding(codec, data)
        prefix.replace(a, b, b"ion")
        assert prefix.last == bpe.PrefixEncoding(codec, data[:a] + b"ion" + data[b:]).last
        assert codec.decode(prefix.ids(a)) == data[:a]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(count, near):
    least = list(range(count))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in near:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return [root(x) for x in range(count)]


def test_simhash_query(spark, texts):
    rows = sorted(queries.op3_simhash(spark, SMALL).collect(), key=lambda r: r["doc_id"])
    prints = [plain_fingerprint(t) for _, t in texts]
    assert [int(r["fingerprint"], 16) for r in rows] == prints
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert [r["component_id"] for r in rows] == [texts[x][0] for x in components_of(len(prints), near)]


def test_simhash_links_find_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**64 - 1, 1500, dtype=np.uint64)
    for i in range(700):
        x = int(codes[0] if i % 2 else codes[rng.integers(0, 1500)])
        for _ in range(rng.integers(0, 4)):
            x ^= 1 << int(rng.integers(0, 64))
        codes[rng.integers(1, 1500)] = x
    codes = np.unique(codes)
    i, j = np.triu_indices(len(codes), 1)
    close = np.bitwise_count(codes[i] ^ codes[j]) <= 3
    expected = components.local_forest(len(codes), i[close], j[close])
    for tile, fan in ((simhash.TILE, simhash.FAN), (40, simhash.FAN), (7, 3)):  # the second makes pairs of tiles, the third trees of them
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "FAN", fan)
        frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
        edges = np.array([(r["a"], r["b"]) for r in simhash.links(frame).collect()], np.int64).view(np.uint64)
        found = components.local_forest(len(codes), np.searchsorted(codes, edges[:, 0]), np.searchsorted(codes, edges[:, 1]))
        assert (found == expected).all()


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(100)]
    expected = components_of(2200, edges)
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in rows} == {x: expected[x] for x in touched}


def plain_lines(texts):
    k = lines.SHINGLE
    sets, first = {}, {}
    for i, text in texts:
        for no, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                sets.setdefault(line, {line[p : p + k] for p in range(max(1, len(line) - k + 1))})
                first[i, no] = line
    names = list(sets)
    near = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[names[a]]) * 0.8 <= len(sets[names[b]]) <= len(sets[names[a]]) / 0.8 and len(sets[names[a]] & sets[names[b]]) >= 0.8 * len(sets[names[a]] | sets[names[b]])]
    root = dict(zip(names, components_of(len(names), near)))
    heads = {}
    for place in sorted(first):
        heads.setdefault(root[first[place]], place)
    return {place: heads[root[line]] for place, line in first.items()}


def test_lines_query(spark, texts):
    rows = queries.op9_line_dedup(spark, SMALL).collect()
    expected = plain_lines(texts)
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in rows}
    assert got.keys() == expected.keys()
    assert sum(got[p] == expected[p] for p in got) >= 0.999 * len(got)
    assert all(r["kept"] == (got[r["doc_id"], r["line_no"]] == (r["doc_id"], r["line_no"])) for r in rows)


def test_line_bands_meet_at_the_limit():
    """Pairs of 90 shingles each that differ in 10 have similarity 0.8."""
    draw = random.Random(11)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    starts = [word(89) for _ in range(2000)]
    one, two = (lines.band_hashes([s + word(10) for s in starts]) for _ in range(2))
    assert (one == two).any(axis=1).all()


@pytest.mark.parametrize("sent", [0, lines.SENT_LINES])
def test_lines_of_one_large_group(spark, monkeypatch, sent):
    monkeypatch.setattr(lines, "TILE", 8)
    monkeypatch.setattr(lines, "SENT_LINES", sent)
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split() * 3
    texts = [(i, " ".join([*words[:30], f"x{i}", *words[30:]])) for i in range(40)] + [(100, "something else altogether")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lines.line_groups(docs).collect()
    assert {r["doc_id"]: r["first_key"] for r in rows} == {place[0]: head[0] for place, head in plain_lines(texts).items()}
    assert [r["doc_id"] for r in lines.deduplicated(docs).orderBy("doc_id").collect()] == [0, 100]


def test_ties_meet_their_bands_once(spark, monkeypatch):
    """What compares a band's components reads its lines from a table: no plan joins the ties anew."""
    plans, solve = [], lines.connected_components
    monkeypatch.setattr(lines, "connected_components", lambda pairs: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or solve(pairs))
    texts = {i: f"one line that many of them have but for {i}" for i in range(6)}
    assert lines.line_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).count() == 6
    assert len(plans) == 2 and "LeftSemi" not in plans[1]


def test_lines_in_a_chain(spark, monkeypatch):
    """Each line is near the next ones only, and the chain spans over fifty tiles: one component all the same, and nothing else in it."""
    monkeypatch.setattr(lines, "TILE", 4)
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)]
    chain = [" ".join(words[i : i + 40]) for i in range(220)]
    apart = [" ".join(rnd.sample(words, 40)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(chain + apart)), "doc_id long, text string")
    rows = {r["doc_id"]: r["first_key"] for r in lines.line_groups(docs).collect()}
    assert {rows[i] for i in range(220)} == {0} and all(rows[i] == i for i in range(220, 240))


def test_winnowing_query(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op7_winnowing(spark, SMALL).collect()}
    prints = {}
    for at, (i, text) in enumerate(texts):
        after = texts[(at + 1) % len(texts)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        own, other = set(winnowing.winnow(text)[0].tolist()), set(winnowing.winnow(after)[0].tolist())
        assert abs(r["near_next"] - len(own & other) / len(own | other)) < 1e-12
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.4 > np.mean([r["near_next"] for r in rows.values()])


@pytest.mark.parametrize("k,w", [(16, 16), (5, 3), (7, 4), (1, 1)])
def test_winnowing_plainly(k, w):
    rnd = random.Random(k)
    for _ in range(60):
        text = "".join(rnd.choices("abc🙂", k=rnd.randint(0, 120)))
        hashes = winnowing.gram_hashes(text, k)
        grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
        assert len(hashes) == len(grams) and len(set(hashes.tolist())) == len(set(grams))
        chosen, size = set(), min(w, len(grams))
        for start in range(len(grams) - size + 1 if grams else 0):
            chosen.add(max(range(start, start + size), key=lambda i: (-int(hashes[i]), i)))
        assert winnowing.winnow(text, k, w)[1].tolist() == sorted(chosen)
    shared = "".join(rnd.choices("abcdefgh", k=k + w - 1))
    a, b = winnowing.winnow("xyz" * 9 + shared + "pq" * 9, k, w)[0], winnowing.winnow("uv" * 11 + shared + "nm" * 9, k, w)[0]
    assert np.intersect1d(a, b).size


def test_mixing_targets(spark):
    rows = queries.op8_mixing(spark, MIDDLE).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max("size").alias("largest"), F.sum("size").alias("check"), F.max("copies").alias("copies")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1.5 * r["largest"] and r["copies"] <= 3 and r["check"] == r["size"] and r["target"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["target"] for r in rows) / sum(r["size"] for r in rows) - 1) < 1e-9
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = {r["key"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in expected.items() if v}


def test_mixing_caps(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1000), (None, 10)], "source string, source_size long")
    targets = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # Weights 5, 2, 1, 5: a, b and the null source stop at three times their sizes.
    assert targets == {"a": 3.0, "b": 300.0, "c": 1111.0 - 333.0, None: 30.0}


def test_language_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 5, 1, 9, 0, 7])
    scores = rng.normal(0, 6, (lengths.sum(), 3)).astype(np.float32)
    got, at = langid.best_paths(scores, lengths, 4.0), 0
    for n in lengths:
        part = scores[at : at + n].astype(float)
        worth = lambda path: sum(part[i, l] for i, l in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        if n:
            best = part[0].copy()
            for row in part[1:]:
                best = np.maximum(best, best.max() - 4.0) + row
            assert abs(worth(got[at : at + n]) - best.max()) < 1e-4
        at += n


def test_language_accuracy_and_spans(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    joined = queries.op2_language(spark, MIDDLE).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert joined.filter("lang = lang_pred").count() / joined.count() > 0.97
    model = langid.fit(docs)
    by_lang = {r["lang"]: r["t"] for r in docs.filter("n_chars between 300 and 900").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    (lang, _, spans), = langid.label_texts(model, [by_lang["de"] + "\n" + by_lang["es"]])
    assert {s[2] for s in spans} >= {"de", "es"} and lang in ("de", "es")


M64 = (1 << 64) - 1


def plain_mix(x):
    """The splitmix64 finalizer on a whole number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def test_language_plainly(spark):
    """Whole texts, word by word and n-gram by n-gram, against the operator."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model, number = langid.fit(docs), lambda c: int(langid.scripts_of(np.array([ord(c)]))[0])
    for text in [r["text"] for r in docs.filter("n_chars < 1500").orderBy("doc_id").limit(25).collect()] + ["日本語English да", "ok 12"]:
        lower, runs = text.lower(), []
        for i, c in enumerate(lower):
            if number(c):
                if runs and runs[-1][1] == i and number(lower[i - 1]) == number(c):
                    runs[-1][1] = i + 1
                else:
                    runs.append([i, i + 1])
        at = lambda i: ord(lower[i]) if 0 <= i < len(lower) and number(lower[i]) else 32  # noqa: E731, B023
        scores = []
        for a, b in runs:
            total = np.zeros(len(model.languages))
            for i in range(a, b + 1):
                one, two, three = at(i), at(i - 1), at(i - 2) if at(i - 1) != 32 else 32
                for order, key in enumerate((one, one | two << 21, one | two << 21 | three << 42)):
                    total += model.logs[order][plain_mix(key + order + 1 & M64) >> 64 - langid.BITS]
            allowed = model.allowed[number(lower[a])]
            scores.append(total - (1e6 * ~allowed if allowed.any() else 0))
        (lang, share, _), = langid.label_texts(model, [text])
        if not runs:
            assert (lang, share) == ("und", 0.0)
            continue
        best, came = scores[0], []
        for s in scores[1:]:
            jump = best.max() - langid.SWITCH
            came.append(np.where(best < jump, best.argmax(), np.arange(len(best))))
            best = np.maximum(best, jump) + s
        path = [int(best.argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        letters = np.bincount(path[::-1], [b - a for a, b in runs], len(model.languages))
        assert lang == model.languages[letters.argmax()] and abs(share - letters.max() / letters.sum()) < 1e-9


def test_language_scripts():
    found = langid.scripts_of(np.array([ord(c) for c in "aяα漢あ한بગ𐐀ａÿ𝒳1🙂 "])).tolist()
    assert len(set(found[:9])) == 9 and found[9] == found[10] == found[0] and found[-3:] == [0, 0, 0] and found[8] > 0 and found[11] > 0


def test_language_runs_end_where_scripts_change():
    words = langid.words_of(["日本語English да, ok"])
    assert list(zip(words.begin.tolist(), words.end.tolist())) == [(0, 3), (3, 10), (11, 13), (15, 17)]


def test_language_of_symbols(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["plain words of it"] * 20 + ["🙂🙂", "𝟘𝟙 1", "𐐀𐐁"])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[20] == got[21] == ("und", 0.0) and got[22] == ("en", 1.0)


def test_toxicity_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    joined = queries.op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").select("toxic", "predicted").toPandas()
    assert (joined.predicted[joined.toxic == 0] == 0).mean() > 0.99 and (joined.predicted[joined.toxic == 1] == 1).mean() > 0.87


def test_toxicity_plainly(spark):
    """Scores of whole texts, feature by feature, against the operator."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    places, weights = toxicity.fit(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    of = dict(zip(places.tolist(), weights.tolist()))

    def hashed(word):
        units = np.array([ord(c) for c in word], np.uint32)
        return int(common.span_hashes(units, np.array([0]), np.array([len(word)]))[0])

    for r in toxicity.score(docs.filter("n_chars < 3000").orderBy("doc_id").limit(40), (places, weights)).collect():
        words = re.findall(r"[^\W_]+", r["text"].lower())
        found = {hashed(w) for w in words} | {plain_mix(hashed(w[:n]) + n & M64) for w in words for n in toxicity.STEMS if len(w) > n}
        found |= {plain_mix(hashed(a) * 0xD6E8FEB86659FD93 + hashed(b) + gap & M64) for gap in (1, 2, 3) for a, b in zip(words, words[gap:])}
        total = sum(of.get(p, 0.0) for p in {h >> 64 - toxicity.BITS for h in found}) + of.get(1 << toxicity.BITS, 0.0)
        assert abs(r["toxicity"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_ftrl_is_sparse_and_learns():
    rnd, learner = random.Random(0), toxicity.FtrlProximal()
    for _ in range(600):
        toxic = rnd.random() < 0.3
        learner.learn(np.array([rnd.randint(10, 1 << 19), *([3] if toxic else [])]), int(toxic))
    places, weights = learner.model()
    assert weights[places == 3][0] > 1 and len(places) < 40


def test_quality_accuracy(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    joined = queries.op10_quality(spark, MIDDLE).join(labels, "doc_id").filter("held_out")
    assert joined.filter("quality = predicted").count() / joined.count() > 0.93


def test_quality_finds_the_line_where_it_changes(spark):
    """Lines' labels are hidden in training; in a text made of a good and a bad one, nearly all lines get their half's label."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    field = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").filter(queries.held_out(F.col("doc_id"))).orderBy("doc_id").select("text", "quality").collect()
    some = lambda label: [x for x in (r["text"].split("\n")[:8] for r in rows if r["quality"] == label) if len(x) >= 4]
    right = []
    for good, bad in zip(some(1), some(0)):
        _, (lines_,) = quality.text_quality(field, ["\n".join(good + bad)])
        right.append((np.concatenate((lines_[: len(good)] > 0.5, lines_[len(good) :] <= 0.5))).mean())
    assert len(right) >= 5 and np.mean(right) > 0.8


def test_quality_slopes(spark):
    """The tilt's difference is the slope of the likelihood: a step along it raises the likelihood of the labels."""
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 6, 80)
    owner, labels = np.repeat(np.arange(80), lengths), rng.integers(0, 2, 80).astype(float)
    features = rng.normal(size=(len(owner), quality.WIDTH)) / 8
    features[:, 0] += labels[owner] - 0.5
    sizes = rng.integers(0, 50, len(owner))
    field = quality.LineField()
    field.fit(features, lengths, sizes, labels)
    mean = quality.weighted_mean(field.marginals(features, lengths)[0], sizes, owner, 80)
    assert ((field.calibrated(mean) > 0.5) == labels).mean() > 0.9


def test_quality_marginals():
    rng = np.random.default_rng(4)
    field = quality.LineField()
    field.weights, field.changes = rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2))
    features, lengths = rng.normal(size=(9, quality.WIDTH)) / 4, np.array([4, 1, 4])
    good, pairs = field.marginals(features, lengths)
    at = 0
    for text, n in enumerate(lengths):
        evidence = features[at : at + n] @ field.weights
        paths = [[int(b) for b in f"{x:0{n}b}"] for x in range(2**n)]
        worth = np.array([np.exp(sum(e * s for e, s in zip(evidence, p)) + sum(field.changes[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        worth /= worth.sum()
        assert np.allclose(good[at : at + n], [sum(w for w, p in zip(worth, paths) if p[i]) for i in range(n)])
        assert np.allclose(pairs[text], [[sum(w * sum((x, y) == (a, b) for x, y in zip(p, p[1:])) for w, p in zip(worth, paths)) for b in (0, 1)] for a in (0, 1)])
        at += n


def test_nearest_recall(spark):
    """Against all vectors, with the constants as they are shipped."""
    rows = queries.op4_nearest(spark, LARGE).toPandas()
    table = spark.read.parquet(f"{LARGE}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(table.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, group in rows.groupby("query_id"):
        near = x @ x[q]
        near[q] = -2
        best = np.argsort(-near, kind="stable")[:5]
        hits, total = hits + len(set(best) & set(group.vec_id)), total + 5
        assert group["rank"].sort_values().tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(group.score, near[group.vec_id])
    assert total == 5 * len(range(0, len(table), 50)) and hits / total >= 0.95


def test_nearest_over_blocks(spark, monkeypatch):
    """Small blocks and lists, so that rounds and search have to find what the start does not hold."""
    for name, value in (("BLOCK", 64), ("NEIGHBOURS", 12), ("REVERSE", 8), ("BEAM", 48)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12))
    x[100:160] = x[100]
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(table).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        near = np.round(unit @ unit[q], 12)
        near[q] = -2
        hits += len(set(np.argsort(-near, kind="stable")[:5]) & set(rows.vec_id[rows.query_id == q]))
    assert hits >= 0.9 * 5 * 12
    assert rows.vec_id[rows.query_id == 100].tolist() == [101, 102, 103, 104, 105]


def plain_recall(rows, x, every=50):
    """Share of the five nearest by brute force that ``rows`` hold."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, asked = 0, range(0, len(x), every)
    for q in asked:
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argsort(-near, kind="stable")[:5]) & set(rows.vec_id[rows.query_id == q]))
    return hits / (5 * len(asked))


def test_nearest_among_near_copies(spark):
    """Near copies of one vector by the thousand differ by less than a byte per component tells."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x[:4000] = x[0] + 0.025 * rng.normal(size=(4000, 64))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    assert plain_recall(neighbours.nearest(table, every=100).toPandas(), x.astype(np.float64), 100) >= 0.97


def test_nearest_keeps_recall_as_blocks_shrink(spark, monkeypatch):
    """Blocks hold a hundredth of the table, so three rounds would leave the lists half known."""
    for name, value in (("BLOCK", 64), ("NEIGHBOURS", 16), ("REVERSE", 8), ("BEAM", 16)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.random.default_rng(10).normal(size=(6000, 16))
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    assert plain_recall(neighbours.nearest(table, every=100).toPandas(), x, 100) >= 0.97


KEY = "a key of the tests"


def pseudonymised(spark, texts):
    """The texts after the operator, in order."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymised(docs, KEY).orderBy("doc_id").collect()]


def test_pii_keeps_distinct_and_alike(spark):
    texts = [f"Mail user{i}@corp{i % 5}.com or USER{i}@CORP{i % 5}.COM, call +1 (706) 555-{1000 + i}, host 10.0.{i}.7." for i in range(60)]
    texts += ["Mr. John Smith and Frau Müller; Mr. John Smith again", "card 4644348398010899 and 4644 3483 9801 0899, not 1234567812345678", 'token = "0123456789abcdef01234567"', "г-н Иванов", "(706) 555-1007 and +49 30 1234567, fe80::1:2 and FE80::1:2"]
    done = pseudonymised(spark, texts)
    mails = [re.findall(r"\S+@\S+?(?=[ ,])", t) for t in done[:60]]
    assert all(a.upper() == b for a, b in mails) and len({a for a, _ in mails}) == 60
    assert all(a.split("@")[1].split(".")[-2] == "example" for a, _ in mails) and len({a.split("@")[1] for a, _ in mails}) == 5
    phones = [re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4})", t).groups() for t in done[:60]]
    assert len(set(phones)) == 60
    assert not any(t in " ".join(done) for t in ("Smith", "Müller", "4644348398010899", "0123456789abcdef", "Иванов", "555-1000", "fe80"))
    one, two = re.findall(r"Mr\. (\S+ \S+?)(?=[ ;])", done[60] + " ")
    assert one == two
    card, spaced = re.search(r"card (\d{16}) and ([\d ]{19}), not 1234567812345678", done[61]).groups()
    assert card == spaced.replace(" ", "") and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{24}"', done[62]) and re.fullmatch(r"г-н [А-ЯЁ][а-яё-]+", done[63])
    same, german, six, again = re.fullmatch(r"(\(\d{3}\) \d{3}-\d{4}) and \+49 (\d\d \d{7}), ([0-9a-f:]+) and ([0-9A-F:]+)", done[64]).groups()
    assert same == "({}) {}".format(*phones[7]) and german != "30 1234567" and six.startswith("2001:db8:") and six.upper() == again
    hosts = [re.search(r"host (\d+)\.(\d+)\.(\d+)\.\d+\.", t).groups() for t in done[:60]]
    assert all(h in {("192", "0", "2"), ("198", "51", "100"), ("203", "0", "113")} or int(h[0]) >= 240 for h in hosts)
    other = pii.pseudonymised(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), "another key").first()["text"]
    assert other != done[0]


def test_pii_draws_again(spark):
    many = spark.createDataFrame([("given", f"m:name{i}") for i in range(400)] + [("family", f"name{i}") for i in range(400)], "kind string, canon string")
    rows = pii.assign(many, KEY).collect()
    assert len({(r["kind"], r["chosen"]) for r in rows}) == 800


def test_pii_follows_names_and_passwords(spark):
    texts = ["Dr. Maria Silva came. Maria Silva said so, Ms Silva too, and SILVA; Silvano stays.", "Dr. Anna Weber and Frau Anna Weber", "password: hunter2! and passwd=ab.", "Maria stays."]
    done = pseudonymised(spark, texts)
    given, family, *others = re.fullmatch(r"Dr\. (\S+) (\S+) came\. (\S+) (\S+) said so, Ms (\S+) too, and (\S+); Silvano stays\.", done[0]).groups()
    assert others == [given, family, family, family.upper()] and family != "Silva" and given in pii.GIVEN["latin", "f"].split()
    one, two = re.fullmatch(r"Dr\. (.+) and Frau (.+)", done[1]).groups()
    assert one == two != "Anna Weber"
    assert re.fullmatch(r"password: [a-z]{6}\d! and passwd=[0-9a-f]{2}\.", done[2]) and "hunter" not in done[2]
    assert done[3] == texts[3]


def test_pii_scripts(spark):
    """Replacements are of the entity's script, and no letter of it stays where it was."""
    done = pseudonymised(spark, ["żółw@łódź.pl", "Dr. Νίκος Παπαδόπουλος", "Mr 王小明 。", "Dr. ქეთევან", "Mr. John Smith, Dr. John Smith"])
    local, host = re.fullmatch(r"(\S{4})@(\S{4,5})\.example\.org", done[0]).groups()
    assert not any(a == b for a, b in zip(local + host, "żółwłódź") if a not in "ółwdz")
    greek = re.fullmatch(r"Dr\. (\S+) (\S+)", done[1]).groups()
    assert greek[0] in " ".join(v for (s, _), v in pii.GIVEN.items() if s == "greek") and greek[1].split("-")[0] in pii.FAMILY["greek"]
    assert re.fullmatch(r"Mr [\u4e00-\u9fff]+ 。", done[2]) and "王小明" not in done[2]
    assert re.fullmatch(r"Dr\. [\u10d0-\u10ff]+.*", done[3]) and "ქეთევან" not in done[3]
    one, two = re.fullmatch(r"Mr\. (.+), Dr\. (.+)", done[4]).groups()
    assert one == two


def test_pii_supply_does_not_end(spark):
    """More one-letter addresses of a domain than there are letters, more names of one word than of three family parts, short numbers."""
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x430, 0x450)] + [chr(c) for c in range(0x5D0, 0x5EA)] + [chr(c) for c in range(0x4E00, 0x4E00 + 916)]
    mails = [("email", f"{c}@gmail.com") for c in letters]
    phones = [("phone", f"1:{n:04}") for n in range(2000, 3000)]
    short = spark.createDataFrame(mails + phones, "kind string, canon string")
    names = spark.range(50_000).select(F.lit("family").alias("kind"), F.concat(F.lit("name"), "id").alias("canon"))
    found = pii.assign(short.unionByName(names), KEY)
    counts = {r["kind"]: (r["n"], r["d"]) for r in found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("chosen").alias("d")).collect()}
    assert counts == {"email": (len(mails),) * 2, "phone": (1000, 1000), "family": (50_000, 50_000)}
    assert found.join(short.select("kind", F.col("canon").alias("chosen")), ["kind", "chosen"]).count() == 0


def plain_spans(text):
    """Spans of a text's entities as plain regular expressions find them: all kinds, then the names told by titles and their parts."""
    names = []
    for m in regex.finditer(pii.ANY, text):
        if regex.fullmatch(dict(pii.PATTERNS)["person"], m.group()):
            words = regex.sub(pii._TITLE_HEAD, "", m.group()).split(" ")
            stop = next((i for i, w in enumerate(words) if w.lower() in pii.OPENERS and w.lower() not in pii.PARTICLES), len(words))
            name = " ".join(words[:stop])
            names += [name] if name not in names and any(w.lower() not in pii.PARTICLES for w in words[:stop]) else []
    single = dict.fromkeys(w for n in names for w in n.split(" ") if len(w) > 1 and w.lower() not in pii.PARTICLES)
    plain = lambda w: w.lower() in pii.COMMON or (w != w.lower() and regex.search(rf"(?<![\p{{L}}\p{{N}}]){w.lower()}(?![\p{{L}}\p{{N}}])", text) is not None)
    spread = lambda ws: "|".join(sorted(dict.fromkeys([*ws, *(w.upper() for w in ws), *(w.capitalize() for w in ws if w == w.lower())]), key=len, reverse=True))
    free, shy = [n for n in names if " " in n] + [w for w in single if not plain(w)], [w for w in single if plain(w)]
    every = pii.ANY + (rf"|(?<![\p{{L}}\p{{N}}])(?:{spread(free)})(?![\p{{L}}\p{{N}}])" if free else "") + (rf"|(?<=[\p{{L}}\p{{N}},;] )(?:{spread(shy)})(?![\p{{L}}\p{{N}}])" if shy else "")
    found = []
    for m in regex.finditer(every, text):
        kind = next((k for k, p in pii.PATTERNS if regex.fullmatch(p, m.group())), "person")
        number = [int(c) for c in m.group() if c in "0123456789"][::-1]
        if kind != "card" or luhn(number[::-1]):
            found.append((m.start(), m.end(), kind))
    return found


def luhn(number):
    return sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(number[::-1])) % 10 == 0


def test_pii_query(spark):
    """The query against plain expressions: exactly their spans are replaced, alike entities alike and others otherwise."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    told = {}
    for r in queries.op1_pii(spark, SMALL).collect():
        text = docs[r["doc_id"]]
        spans = plain_spans(text or "")
        assert r["kinds"].split(",") == ([k for _, _, k in spans] or [""]) and r["n_entities"] == len(spans)
        borders = [0, *(x for a, b, _ in spans for x in (a, b)), len(text or "")]
        between = [text[a:b] for a, b in zip(borders[::2], borders[1::2])] if text else []
        met = re.fullmatch("(.+?)".join(map(re.escape, between)), r["text"] or "", re.DOTALL)
        assert met, r["doc_id"]
        for (a, b, kind), new in zip(spans, met.groups()):
            figures = lambda t: [int(c) for c in t if c in "0123456789"]
            if kind in ("phone", "card"):
                assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text[a:b]) or kind == "phone"
                assert figures(new) != figures(text[a:b]) and (kind == "phone" or luhn(figures(new)))
                told.setdefault((kind, str(figures(text[a:b]))), str(figures(new)))
            elif kind == "person":
                olds, news = (regex.sub(pii._TITLE_HEAD, "", t).split(" ") for t in (text[a:b], new))
                assert len(olds) == len(news) and all((o == n) == (o.lower() in pii.PARTICLES or o.lower() in pii.OPENERS) for o, n in zip(olds, news))
                assert told.setdefault((kind, olds[-1].lower()), news[-1].lower()) == news[-1].lower() or olds[-1].lower() in pii.OPENERS
            else:
                assert new != text[a:b] and told.setdefault((kind, text[a:b].lower()), new.lower()) == new.lower()
    assert len({k for k, _ in told}) >= 4 and len({(k[0], v) for k, v in told.items()}) == len(told)


def test_folds(spark):
    rows = spark.range(50).select("id", queries.held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
