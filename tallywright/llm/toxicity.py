"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the words, the beginnings of longer words (inflected
and compound forms share them), word pairs, and word pairs with one and two words
skipped that occur in it, each hashed to one of ``2**BITS`` places. The learner keeps per place the sum of squared gradients, from which its own rate
follows, and the L1 term leaves places without steady evidence at exactly zero.
So the weights to send out are few, at most one per place whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import bounded_rows, code_points, give_back, held_out, mix64, runs, sliced, span_hashes, text_pass

BITS = 20
#: Labelled documents that the classifier is fitted on and their distinct places together, at most; passes over them.
TRAIN_ROWS, TRAIN_PLACES, PASSES = 16_384, 32_000_000, 4
#: L1 is twice PASSES, so that a feature of two documents, whose gradients add up to that at most, stays at zero.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
THRESHOLD = 0.5
_GAPS = (1, 2, 3)
#: Lengths of the beginnings of words that are longer.
STEMS = (5, 6, 7)
_WORDLIKE = None


def _wordlike() -> np.ndarray:
    """By code point of the first plane: whether it is a letter or a digit."""
    global _WORDLIKE
    if _WORDLIKE is None:
        _WORDLIKE = np.fromiter((chr(c).isalnum() for c in range(0x10000)), np.bool_, 0x10000)
    return _WORDLIKE


def word_spans(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters and digits; beyond the first plane everything counts as a letter."""
    return runs(_wordlike()[np.minimum(units, 0xFFFF)] | (units > 0xFFFF))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each feature occurrence and the text it is in, repeats included."""
    units, starts, _ = code_points(t.lower() for t in texts)
    begin, end = word_spans(units)
    hashes = span_hashes(units, begin, end)
    owner = np.searchsorted(starts, begin, "right") - 1
    places, owners = [hashes], [owner]
    for length in STEMS:
        longer = end - begin > length
        places.append(mix64(span_hashes(units, begin[longer], begin[longer] + length) + np.uint64(length)))
        owners.append(owner[longer])
    for gap in _GAPS:
        same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, bool)
        first, second = hashes[: len(same)][same], hashes[gap:][: len(same)][same]
        places.append(mix64(first * np.uint64(0xD6E8FEB86659FD93) + second + np.uint64(gap)))
        owners.append(owner[: len(same)][same])
    return (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


class FtrlProximal:
    """Per-coordinate FTRL-proximal logistic regression on sets of places; the last weight is the bias."""

    def __init__(self, size: int = (1 << BITS) + 1) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias, self.seen = size - 1, 0

    def weights(self, places: np.ndarray) -> np.ndarray:
        """The weights at ``places``: zero while the evidence is within the L1 term."""
        z = self.z[places]
        l1 = np.where(places == self.bias, 0.0, L1)
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((BETA + np.sqrt(self.n[places])) / ALPHA + L2))

    def learn(self, places: np.ndarray, label: int) -> None:
        """One step on a document with the distinct ``places``."""
        places = np.append(places.astype(np.int64), self.bias)
        w = self.weights(places)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        before = self.n[places]
        after = before + g * g
        self.z[places] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        self.n[places] = after
        self.seen += 1

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights that are not zero."""
        w = self.weights(np.arange(len(self.z)))
        kept = np.flatnonzero(w)
        return kept, w[kept]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, passes: int = PASSES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The places and the weights that are not zero; the bias is at place ``2**BITS``.

    Learns from at most ``rows`` labelled rows outside the held-out fold, the
    first by a seeded hash. Their features are worked out where the texts lie;
    one task gets the places alone, four bytes for each distinct one, and goes
    over them ``passes`` times. It takes rows up in that order until they have
    ``TRAIN_PLACES`` places, so it holds 128 MB at most however long the texts
    are. Rows without label, key or document are not examples; a row labelled
    twice is two examples. Without examples the arrays are empty.
    """
    chosen = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k")))
    sample = bounded_rows(chosen, ["k", "y"], rows, seed)
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    labelled = texts.join(F.broadcast(sample), "k").select(F.xxhash64(F.lit(seed), "k").alias("h"), "k", "y", "t")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for part in sliced(one, 3):
                places, owners = features([t or "" for t in part.column(3).to_pylist()])
                pairs = np.unique(owners * (1 << BITS) + places)
                borders = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1))
                each = (pairs & ((1 << BITS) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array([each[a:b].tobytes() for a, b in zip(borders, borders[1:])], pa.binary())], names=["h", "y", "places"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, borders, marks, full = np.empty(TRAIN_PLACES, np.uint32), [0], [], False
        for one in batches:
            for y, places in zip(one.column(0).to_pylist(), one.column(1)):
                part = np.frombuffer(places.as_buffer(), np.uint32)
                # The sample ends at the first that has no room, whatever comes behind it.
                full = full or borders[-1] + len(part) > TRAIN_PLACES
                if not full:
                    every[borders[-1] : borders[-1] + len(part)] = part
                    borders.append(borders[-1] + len(part))
                    marks.append(y)
        learner = FtrlProximal()
        for turn in range(passes):
            for i in np.random.default_rng((seed, turn)).permutation(len(marks)):
                learner.learn(every[borders[i] : borders[i + 1]], marks[i])
        places, weights = learner.model() if learner.seen else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(weights, pa.float64())], names=["place", "weight"])
        del every, learner
        give_back()

    spread = labelled.mapInArrow(placed, "h long, y int, places binary")
    found = spread.repartition(1).sortWithinPartitions("h", "y", "places").select("y", "places").mapInArrow(learnt, "place long, weight double").toPandas()
    return found["place"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)


def score_texts(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of each text; each distinct feature counts once."""
    places, owners = features(texts)
    hit = weights[places] != 0
    pairs = np.unique(owners[hit] * (1 << BITS) + places[hit])
    total = bias + np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", output: str = "toxicity") -> DataFrame:
    """``docs`` with the probability ``output`` (a column of that name is replaced), in one pass.

    A null text counts as empty and has the bias alone. With an empty model
    every probability is 0: nothing is known to be toxic. Equal texts, repeated
    rows among them, have equal probabilities. A text is worked out as a whole,
    so a very long one takes memory in proportion to its length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        weights = np.zeros((1 << BITS) + 1)
        places, values = sent.value
        weights[places] = values
        if not len(places):
            return lambda texts: [np.zeros(len(texts))]
        return lambda texts: [score_texts(texts, weights[:-1], weights[-1])]

    return text_pass(docs, text, None, [(T.StructField(output, T.DoubleType()), pa.float64())], work)
