"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shape figures of its own and
of the lines before and after it; the chain adds the changes from line to line.
Forward-backward gives each line's probability of being good, and a document's
quality is their mean, weighted by length. Labels are known of documents only, so
the lines' labels are hidden in training: the field is fitted so that the weighted
mean tells the document's label, and which lines bring it about is left to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import STEPPED_BYTES, bounded_rows, code_points, held_out, runs, sliced, span_hashes, text_pass

#: Labelled documents that the field is fitted on and their lines together, at most; documents of more lines than EACH are no examples.
TRAIN_ROWS, TRAIN_LINES, EACH = 4_096, 40_000, 256
STEPS, RATE, DECAY = 150, 0.05, 1e-3
#: Evidence for staying as it is that training starts from.
STAY = 0.5
#: Step of the difference that the mean's slope is taken by.
NUDGE = 1e-3
THRESHOLD = 0.3
#: Figures of a line.
FIGURES = 15
#: Own, previous and next figures, no previous, no next, constant.
WIDTH = 3 * FIGURES + 3
_CLASSES = None
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _OTHER = range(7)


def _classes() -> np.ndarray:
    """Class of each code point of the first plane."""
    global _CLASSES
    if _CLASSES is None:
        def of(c: str) -> int:
            if c.isupper():
                return _UPPER
            if c.isalpha():
                return _LOWER
            if c.isdigit():
                return _DIGIT
            if c.isspace():
                return _SPACE
            return _STOP if c in ".,;:?'\"()-" else _MARK if c.isprintable() else _OTHER

        _CLASSES = np.fromiter((of(chr(i)) for i in range(0x10000)), np.int8, 0x10000)
    return _CLASSES


def line_figures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures [line, figure], length and owning text of every line; a text has a line more than line ends."""
    units, starts, _ = code_points(texts)
    ends = np.flatnonzero(units == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    owner = np.searchsorted(starts, begins, "right") - 1
    length = ends - begins
    kinds = _classes()[np.minimum(units, 0xFFFF)]
    n = len(ends)
    # Each line's stretch holds at least its line end, so none is empty.
    counts = [np.add.reduceat((kinds == kind).astype(np.int32), begins) for kind in (_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK)]
    counts[_SPACE] = counts[_SPACE] - 1
    size = np.maximum(length, 1)
    first, last = kinds[np.minimum(begins, len(kinds) - 1)], units[np.maximum(ends - 1, 0)]
    word_begin, word_end = runs((kinds != _SPACE) & (units != 10))
    line_of = np.searchsorted(begins, word_begin, "right") - 1
    words = np.bincount(line_of, minlength=n)
    hashes = span_hashes(units, word_begin, word_end)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    order = np.lexsort((hashes, line_of))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    distinct = np.bincount(line_of[order][fresh], minlength=n)
    whole = span_hashes(units, begins, ends)
    order = np.lexsort((np.arange(n), whole, owner))
    repeat = np.zeros(n, bool)
    repeat[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    letters = counts[_UPPER] + counts[_LOWER]
    per_word = np.maximum(words, 1)
    columns = (
        np.log1p(length) / 6, counts[_UPPER] / np.maximum(letters, 1), counts[_DIGIT] / size, counts[_SPACE] / size, counts[_STOP] / size, counts[_MARK] / size,
        letters / size, np.isin(last, (33, 46, 63)) & (length > 0), (first == _UPPER) & (length > 0), np.minimum(letters / per_word / 10, 3), distinct / per_word,
        np.bincount(line_of[again], minlength=n) / per_word, np.log1p(words) / 6, length == 0, repeat,
    )
    return np.stack([np.asarray(c, np.float64) for c in columns], 1), length, owner


def with_neighbours(figures: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Features [line, WIDTH]: own figures, those of the lines before and after in the text, and whether there are such."""
    n = len(figures)
    out = np.zeros((n, WIDTH))
    out[:, :FIGURES] = figures
    same = owner[1:] == owner[:-1]
    out[1:, FIGURES : 2 * FIGURES] = figures[:-1] * same[:, None]
    out[:-1, 2 * FIGURES : 3 * FIGURES] = figures[1:] * same[:, None]
    out[:, -3] = np.concatenate(([True], ~same))
    out[:, -2] = np.concatenate((~same, [True]))
    out[:, -1] = 1
    return out


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def weighted_mean(good: np.ndarray, length: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Mean of the lines' probabilities by text; a line weighs its length and one more."""
    return np.bincount(owner, good * (length + 1), texts) / np.bincount(owner, length + 1, texts)


class LineField:
    """The field's weights: features' evidence for good, and the four changes [from, to] (0 bad, 1 good)."""

    def __init__(self, packed: np.ndarray | None = None) -> None:
        packed = np.concatenate((np.zeros(WIDTH), (STAY, 0.0, 0.0, STAY), (0.0, 1.0))) if packed is None else np.asarray(packed, float)
        self.weights, self.changes = packed[:WIDTH].copy(), packed[WIDTH : WIDTH + 4].reshape(2, 2).copy()
        #: Shift and slope that turn the log-odds of the weighted mean into those of the label.
        self.scale = packed[WIDTH + 4 :].copy()

    def packed(self) -> np.ndarray:
        """All figures in one row."""
        return np.concatenate((self.weights, self.changes.ravel(), self.scale))

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        """The weighted mean of the lines' probabilities as a probability of the label."""
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * _log_odds(mean), -500, 500)))

    def calibrate(self, mean: np.ndarray, labels: np.ndarray) -> None:
        """Newton steps of a logistic regression on the log-odds; the slope never turns negative."""
        x = np.stack((np.ones(len(mean)), _log_odds(mean)), 1)
        for _ in range(30):
            p = self.calibrated(mean)
            slope = x.T @ (labels - p) - 0.01 * (self.scale - (0, 1))
            self.scale += np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), slope), -1, 1)
            self.scale[1] = max(self.scale[1], 0.1)

    def marginals(self, features: np.ndarray, lengths: np.ndarray, tilt: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good for each line, and each text's expected changes [text, 2, 2]; all texts step together.

        ``tilt`` is added to the lines' evidence for good.
        """
        n, texts = len(features), len(lengths)
        evidence = features @ self.weights + tilt
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        steps = int(sizes[0]) if texts else 0
        active = np.searchsorted(-sizes, -np.arange(steps), "left")
        starts = (np.cumsum(lengths) - lengths)[order]
        spread = np.exp(self.changes - self.changes.max())
        # Scaled forward and backward messages; a line's evidence as weights of bad and good.
        local = np.stack((1 / (1 + np.exp(np.clip(evidence, -50, 50))), 1 / (1 + np.exp(np.clip(-evidence, -50, 50)))), 1)
        ahead, back = np.empty((n, 2)), np.ones((n, 2))
        for t in range(steps):
            at = starts[: active[t]] + t
            message = local[at] if t == 0 else (ahead[at - 1] @ spread) * local[at]
            ahead[at] = message / message.sum(axis=1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            message = (back[at + 1] * local[at + 1]) @ spread.T
            back[at] = message / message.sum(axis=1, keepdims=True)
        both = ahead * back
        good = both[:, 1] / both.sum(axis=1)
        pairs = np.zeros((texts, 2, 2))
        if n > 1:
            owner = np.repeat(np.arange(texts), lengths)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            joint = ahead[inner][:, :, None] * spread[None] * (local * back)[inner + 1][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            np.add.at(pairs, owner[inner], joint)
        return good, pairs

    def fit(self, features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        """Gradient steps (Adam) on the mean log-likelihood of the texts' labels; the lines' labels are summed out.

        ``sizes`` are the lines' lengths in characters. The slope of a text's
        weighted mean along any weight is the covariance of the two under the
        field: what the weight's expectation changes by when the lines' evidence
        is tilted a little by their shares. One tilt that way and one the other,
        scaled by what each text wants, give the slopes of all weights at once.
        """
        owner = np.repeat(np.arange(len(lengths)), lengths)
        share = (sizes + 1) / np.bincount(owner, sizes + 1)[owner]
        start, state = self.changes.copy(), np.zeros((2, WIDTH + 6))
        for step in range(1, STEPS + 1):
            good, _ = self.marginals(features, lengths)
            mean = np.clip(np.bincount(owner, share * good), 1e-4, 1 - 1e-4)
            short = labels - self.calibrated(mean)
            wish = np.clip(short * self.scale[1] / (mean * (1 - mean)), -30, 30)
            tilt = NUDGE * share * wish[owner]
            (more, pairs), (less, fewer) = self.marginals(features, lengths, tilt), self.marginals(features, lengths, -tilt)
            scale = 2 * NUDGE * len(lengths)
            gradient = np.concatenate((
                (more - less) / scale @ features - DECAY * self.weights, ((pairs - fewer).sum(axis=0) / scale - DECAY * 10 * (self.changes - start)).ravel(),
                (short.mean(), (short * _log_odds(mean)).mean()),
            ))
            state[0] = 0.9 * state[0] + 0.1 * gradient
            state[1] = 0.99 * state[1] + 0.01 * gradient**2
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.weights += move[:WIDTH]
            self.changes += move[WIDTH : WIDTH + 4].reshape(2, 2)
            self.scale += move[WIDTH + 4 :]
            self.scale[1] = max(self.scale[1], 0.1)


def text_quality(field: LineField, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Quality of each text, and each one's probabilities by line."""
    figures, length, owner = line_figures(texts)
    counts = np.bincount(owner, minlength=len(texts))
    good, _ = field.marginals(with_neighbours(figures, owner), counts)
    return field.calibrated(weighted_mean(good, length, owner, len(texts))), np.split(good, np.cumsum(counts)[:-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, seed: int = 13) -> LineField | None:
    """The field fitted on at most ``rows`` labelled rows outside the held-out fold, the first by a seeded hash.

    The lines' figures are worked out where the texts lie, and one task gets them
    alone, 60 bytes a line, until it has ``TRAIN_LINES``; documents of more than
    ``EACH`` lines are left out. Rows without label, key or document are no
    examples; a row labelled twice is two. None if there is no example.
    """
    chosen = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("k")))
    sample = bounded_rows(chosen, ["k", "y"], rows, seed)
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(sample), "k").select(F.xxhash64(F.lit(seed), "k").alias("h"), "y", "t")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for part in sliced(one, 2):
                figures, length, owner = line_figures([t or "" for t in part.column(2).to_pylist()])
                borders = np.searchsorted(owner, np.arange(part.num_rows + 1))
                few = np.diff(borders) <= EACH
                spans = [(a, b) for a, b, k in zip(borders, borders[1:], few) if k]
                kept = part.filter(pa.array(few))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1).cast(pa.int32()), pa.array([figures[a:b].astype("<f4").tobytes() for a, b in spans], pa.binary()), pa.array([length[a:b].astype("<i8").tobytes() for a, b in spans], pa.binary())], names=["h", "y", "figures", "lengths"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures, sizes, marks, held = [], [], [], 0
        for one in batches:
            for y, shape, length in zip(*(one.column(i).to_pylist() for i in range(3))):
                held += len(length) // 8
                if held <= TRAIN_LINES:
                    marks.append(y)
                    figures.append(np.frombuffer(shape, "<f4").reshape(-1, FIGURES).astype(np.float64))
                    sizes.append(np.frombuffer(length, "<i8"))
        if marks:
            counts = np.array([len(x) for x in sizes])
            owner, length = np.repeat(np.arange(len(counts)), counts), np.concatenate(sizes)
            field, lines, truth = LineField(), with_neighbours(np.concatenate(figures), owner), np.array(marks, float)
            field.fit(lines, counts, length, truth)
            good, _ = field.marginals(lines, counts)
            field.calibrate(weighted_mean(good, length, owner, len(counts)), truth)
            yield pa.RecordBatch.from_arrays([pa.array(field.packed(), pa.float64())], names=["weight"])

    spread = texts.mapInArrow(measured, "h long, y int, figures binary, lengths binary")
    ordered = spread.repartition(1).sortWithinPartitions("h", "y", "figures").select("y", "figures", "lengths")
    weights = [r["weight"] for r in ordered.mapInArrow(learnt, "weight double").collect()]
    return LineField(np.array(weights)) if weights else None


def score(docs: DataFrame, field: LineField | None, text: str = "text", output: str = "quality", lines: str | None = None) -> DataFrame:
    """``docs`` with ``output`` (0 to 1) and, if ``lines`` is named, each line's probability; one pass.

    Columns of those names are replaced. A null text counts as empty: one line
    of no length. Without a field every quality is 0.5, and so is every line's.
    Equal texts, repeated rows among them, have equal qualities; a text is worked
    out as a whole, so a very long one takes memory in proportion to its length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field or LineField())
    added = [(T.StructField(output, T.DoubleType()), pa.float64())] + ([(T.StructField(lines, T.ArrayType(T.DoubleType())), pa.list_(pa.float64()))] if lines else [])
    return text_pass(docs, text, None, added, lambda: lambda texts: text_quality(sent.value, texts), STEPPED_BYTES)
