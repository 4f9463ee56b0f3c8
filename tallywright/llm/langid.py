"""Language identification of spans: script ranges, then Viterbi over words.

A word's script leaves only the languages that were seen written in it. Each
remaining language scores the word by the log-probabilities of its hashed
character n-grams. The best path through a text's words, at a price for each
change of language, labels spans; the language with most letters labels the text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import STEPPED_BYTES, code_points, held_out, mix64, partitions, text_pass

ORDERS, BITS = (1, 2, 3), 14
#: Documents of each language that the model is fitted on, about, and of all at most.
TRAIN_PER_LANGUAGE, TRAIN_ROWS = 1_500, 40_000
#: Price of a change of language, in nats; share of a language's letters that makes a script one of its own.
SWITCH, SCRIPT_SHARE = 12.0, 0.01
#: Scores held at once (words times languages).
SCORES_AT_ONCE = 12_000_000
UNDETERMINED = "und"

_SCRIPTS: tuple[np.ndarray, list[str]] | None = None


def _scripts() -> tuple[np.ndarray, list[str]]:
    """By code point, the script's number (0: no letter), and the scripts' names.

    A letter's script is the first word of its Unicode name that is no width:
    LATIN, GREEK, CJK, DEVANAGARI and so on, for all planes.
    """
    global _SCRIPTS
    if _SCRIPTS is None:
        letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
        words = [unicodedata.name(chr(c), "UNNAMED").split(" ", 2) for c in letters]
        named = [w[1] if w[0] in ("FULLWIDTH", "HALFWIDTH") and len(w) > 1 else w[0].split("-")[0] for w in words]
        names = ["", *sorted(set(named))]
        number = {name: i for i, name in enumerate(names)}
        table = np.zeros(sys.maxunicode + 1, np.uint16)
        table[letters] = [number[n] for n in named]
        _SCRIPTS = table, names
    return _SCRIPTS


def scripts_of(units: np.ndarray) -> np.ndarray:
    """The number of each code point's script; 0 for what is no letter."""
    return _scripts()[0][units]


@dataclass
class Words:
    """The letter words of some texts, in order: spans in ``units``, owning text, and places of n-grams by order."""

    units: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    text_start: np.ndarray
    grams: list[np.ndarray]


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters of one script; n-grams take in the border before and after a run of letters, and don't cross it."""
    lowered = [t.lower() for t in texts]
    # Lowering may change a text's length: then its letters are lowered one by one.
    lowered = [a if len(a) == len(t) else "".join(c.lower()[:1] for c in t) for a, t in zip(lowered, texts)]
    units, starts, _ = code_points(lowered)
    script = scripts_of(units)
    letter = script > 0
    starts_here = letter & np.concatenate(([True], script[1:] != script[:-1]))
    stops_here = letter & np.concatenate((script[1:] != script[:-1], [True]))
    begin, end = np.flatnonzero(starts_here), np.flatnonzero(stops_here) + 1
    marked = np.where(letter, units, 32).astype(np.uint64)
    back1 = np.concatenate(([32], marked[:-1])).astype(np.uint64)
    back2 = np.concatenate(([32, 32], marked[:-2])).astype(np.uint64)[: len(marked)]
    back2[back1 == 32] = 32
    keys = [marked, marked | back1 << np.uint64(21), marked | back1 << np.uint64(21) | back2 << np.uint64(42)]
    grams = [(mix64(k + np.uint64(i + 1)) >> np.uint64(64 - BITS)).astype(np.int32) for i, k in enumerate(keys)]
    return Words(units, begin, end, np.searchsorted(starts, begin, "right") - 1, starts, grams)


@dataclass
class LanguageModel:
    """Languages, their log-probabilities [order, place, language], and which scripts each is written in."""

    languages: list[str]
    logs: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """[word, language]; a language not written in the word's script is out, if any other is."""
        count = len(self.languages)
        scores = np.zeros((len(words.begin), count), np.float32)
        if len(words.begin):
            # A word's n-grams end from its first letter to the border behind it, or the next script's first letter.
            edges = np.stack((words.begin, words.end + 1), 1).ravel()
            for order, places in enumerate(words.grams):
                each = self.logs[order][np.append(places, 0)]
                scores += np.add.reduceat(each, edges, axis=0)[::2]
            open_to = self.allowed[scripts_of(words.units[words.begin])]
            scores[~open_to & open_to.any(axis=1, keepdims=True)] -= 1e6
        return scores


def best_paths(scores: np.ndarray, lengths: np.ndarray, price: float = SWITCH) -> np.ndarray:
    """The label of each word on its text's best path.

    ``scores`` has the words of text after text, ``lengths`` their numbers. All
    texts step on together, longest first, so a step is a few array operations
    over the texts that are not over. A change has to beat staying; of equal
    labels the first is taken.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    if not steps:
        return np.zeros(0, np.int32)
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    offset = np.concatenate(([0], np.cumsum(active)))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    rank = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    where = offset[step] + rank
    source = starts[rank] + step
    laid = np.empty_like(scores)
    laid[where] = scores[source]
    value = laid[: active[0]].astype(np.float64)
    came = np.empty(len(scores), np.int16)
    moved = np.zeros(scores.shape, bool)
    for t in range(1, steps):
        a, o = active[t], offset[t]
        value = value[:a]
        best = value.argmax(axis=1)
        jump = value[np.arange(a), best] - price
        came[o : o + a] = best
        np.less(value, jump[:, None], out=moved[o : o + a])
        value = np.maximum(value, jump[:, None]) + laid[o : o + a]
        # The ends of texts that stop here are read off below, so their values stay.
        laid[o : o + a] = value - value.max(axis=1, keepdims=True)
    laid[: active[0]] -= laid[: active[0]].max(axis=1, keepdims=True)
    labels = np.empty(len(scores), np.int32)
    now = np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        a, o = active[t], offset[t]
        ended = laid[o + len(now) : o + a].argmax(axis=1)
        now = np.concatenate((now, ended))
        labels[o : o + a] = now
        if t:
            left = moved[o : o + a][np.arange(a), now]
            now = np.where(left, came[o : o + a], now)
    out = np.empty(len(scores), np.int32)
    out[source] = labels[where]
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, rows: int = TRAIN_ROWS, seed: int = 7) -> LanguageModel:
    """Counts n-grams of a bounded sample outside the held-out fold: about ``per_language`` texts of each language.

    Each task counts its own texts; the counts, of a fixed number of places for
    each language, are summed up. Rows with a null or empty text or a null
    language teach nothing.
    """
    labelled = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{lang}`").alias("l")).filter(F.col("l").isNotNull() & ~held_out(F.col("k")))
    totals = labelled.groupBy("l").count()
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t")).filter(F.col("l").isNotNull() & ~held_out(F.col("k")) & (F.length("t") > 0))
    shares = {r["l"]: r["count"] for r in totals.collect()}
    languages = sorted(shares)
    if not languages:
        return LanguageModel([], np.zeros((len(ORDERS), 1 << BITS, 0), np.float32), np.zeros((len(_scripts()[1]), 0), bool))
    wanted = min(per_language, max(1, rows // len(languages)))
    table = docs.sparkSession.createDataFrame([(name, wanted / n) for name, n in shares.items()], "l string, share double")
    # A seeded hash draws each row by itself: no sort, and no task gathers the sample.
    drawn = F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30))
    sample = texts.join(F.broadcast(table), "l").filter(drawn).select("k", "l", "t")
    number = {name: i for i, name in enumerate(languages)}
    width = (1 << BITS) * len(languages)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ORDERS), width), np.int64)
        letters = np.zeros(len(_scripts()[1]) * len(languages), np.int64)
        for one in batches:
            tongues, texts = one.column(1).to_pylist(), one.column(2).to_pylist()
            for i in range(0, len(texts), 64):
                words = words_of(texts[i : i + 64])
                if not len(words.begin):
                    continue
                owner = np.array([number[name] for name in tongues[i : i + 64]])[words.owner]
                sizes = words.end + 1 - words.begin
                place = np.repeat(words.begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                tongue = np.repeat(owner, sizes)
                for order, grams in enumerate(words.grams):
                    counts[order] += np.bincount(grams[place] * len(languages) + tongue, minlength=width)
                letters += np.bincount(scripts_of(words.units[words.begin]) * len(languages) + owner, words.end - words.begin, len(letters)).astype(np.int64)
        for order in range(len(ORDERS)):
            seen = np.flatnonzero(counts[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), order), pa.int32()), pa.array(seen, pa.int64()), pa.array(counts[order][seen], pa.int64())], names=["o", "place", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(letters), len(ORDERS)), pa.int32()), pa.array(np.arange(len(letters)), pa.int64()), pa.array(letters, pa.int64())], names=["o", "place", "n"])

    spread = sample.repartition(partitions(docs.sparkSession), "k")
    summed = spread.mapInArrow(counted, "o int, place long, n long").groupBy("o", "place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(ORDERS) + 1, width))
    counts[summed["o"], summed["place"]] = summed["n"]
    grams = counts[:-1].reshape(len(ORDERS), 1 << BITS, len(languages))
    logs = np.log((grams + 0.05) / (grams.sum(axis=1, keepdims=True) + 0.05 * (1 << BITS)))
    letters = counts[-1][: len(_scripts()[1]) * len(languages)].reshape(-1, len(languages))
    # n-grams of several orders tell the same thing more than once: they are averaged.
    return LanguageModel(languages, (logs / len(ORDERS)).astype(np.float32), letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def label_texts(model: LanguageModel, texts: list[str | None], price: float = SWITCH) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: language, share of its letters, and spans (start, end, language)."""
    if not model.languages:
        for _ in texts:
            yield UNDETERMINED, 0.0, []
        return
    pending: list[tuple[Words, np.ndarray, int]] = []
    held = 0

    def finish() -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        lengths = np.concatenate([np.bincount(w.owner, minlength=n) for w, _, n in pending])
        paths = best_paths(np.concatenate([s for _, s, _ in pending]), lengths, price)
        at = 0
        for words, _, n in pending:
            labels = paths[at : at + len(words.begin)]
            at += len(words.begin)
            sizes = words.end - words.begin
            letters = np.bincount(words.owner * len(model.languages) + labels, sizes, n * len(model.languages)).reshape(n, -1)
            fresh = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (words.owner[1:] != words.owner[:-1])))) if len(labels) else np.zeros(0, np.int64)
            last = np.concatenate((fresh[1:], [len(labels)])) - 1 if len(fresh) else fresh
            owners = words.owner[fresh]
            spans = list(zip((words.begin[fresh] - words.text_start[owners]).tolist(), (words.end[last] - words.text_start[owners]).tolist(), [model.languages[i] for i in labels[fresh]]))
            borders = np.searchsorted(owners, np.arange(n + 1))
            best, total = letters.argmax(axis=1), letters.sum(axis=1)
            for i in range(n):
                if total[i]:
                    yield model.languages[best[i]], float(letters[i, best[i]] / total[i]), spans[borders[i] : borders[i + 1]]
                else:
                    yield UNDETERMINED, 0.0, []

    part, size = [], 0
    most = max(1, 3_000_000 // len(model.languages))
    for i, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= most or i == len(texts) - 1:
            words = words_of(part)
            pending.append((words, model.word_scores(words), len(part)))
            words.grams = []
            held += pending[-1][1].size
            part, size = [], 0
            if held >= SCORES_AT_ONCE:
                yield from finish()
                pending, held = [], 0
    if pending:
        yield from finish()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, price: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``, in one pass; columns of those names are replaced.

    ``lang_pred`` is the language of most letters (of equal ones the first by
    name) and ``score`` their share. A text that is null or has no letter is
    ``und`` with score 0 and no spans, as is every text if nothing was learnt. A
    script that no learnt language is written in leaves all of them open.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    outputs = [(T.StructField("lang_pred", T.StringType()), pa.string()), (T.StructField("score", T.DoubleType()), pa.float64()), (T.StructField("spans", SPANS), span)]

    def work():
        def labelled(texts: list[str]) -> list[list]:
            found = list(label_texts(sent.value, texts, price))
            return [[f[0] for f in found], [f[1] for f in found], [[{"start": a, "end": b, "lang": c} for a, b, c in f[2]] for f in found]]

        return labelled

    return text_pass(docs, text, keep, outputs, work, 4 * STEPPED_BYTES)
