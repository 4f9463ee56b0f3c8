"""String similarity: matching-block ratio and a weighted composite, as Arrow functions.

Callers score distinct pairs only and test what native bounds can settle first.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.text import WHITE


@lru_cache(maxsize=200_000)
def block_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all characters; the order of arguments matters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else block_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """:func:`block_ratio` of two columns."""
    return _ratios(a, b)


def ratio_possible(a: Column, b: Column, above: float) -> Column:
    """Whether a ratio beyond ``above`` is possible, by lengths first and then by edits.

    Matching blocks are a common subsequence, so all characters beyond twice
    their number are insertions and deletions, and no fewer than the edits
    between the two: a ratio beyond ``above`` leaves fewer edits than ``1 - above``
    of all characters, and as many as make an even number with all of them. Spark's
    edit distance stops at that threshold, so few pairs are left that a bound
    can't refuse.
    """
    shorter, total = F.least(F.char_length(a), F.char_length(b)), F.char_length(a) + F.char_length(b)
    most = F.floor(F.lit(1 - above) * total + F.lit(1e-9)).cast("int")
    even = most - F.pmod(total - most, F.lit(2))
    return F.when((2 * shorter > F.lit(above) * total) & (even >= 0), F.call_function("levenshtein", a, b, even) >= 0).otherwise(False)


def contained_ratio(a: Column, b: Column) -> Column:
    """:func:`block_ratio` where one string holds the other, so that the shorter one is the matching block; null elsewhere.

    Null as well from 200 characters on, where that ratio leaves out frequent ones.
    """
    shorter, total = F.least(F.char_length(a), F.char_length(b)), F.char_length(a) + F.char_length(b)
    return F.when((F.char_length(b) < 200) & (F.contains(a, b) | F.contains(b, a)), F.lit(2.0) * shorter / total)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & where.get(c, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over all characters; 100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a stretch of the longer, stretches over the ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    width = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + width]) for i in range(1 - width, len(long)))


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    left, right = set(a.split()), set(b.split())
    return " ".join(sorted(left & right)), " ".join(sorted(left - right)), " ".join(sorted(right - left))


def token_sort_ratio(a: str, b: str, score=indel_ratio) -> float:
    """Ratio of the words in sorted order."""
    return score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Ratio by common words: 100 if one side's words are all in the other."""
    both, left, right = _token_sets(a, b)
    if both and (not left or not right):
        return 100.0
    joined_left, joined_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel_ratio(joined_left, joined_right), *((indel_ratio(both, joined_left), indel_ratio(both, joined_right)) if both else (0.0,)))


def partial_token_ratio(a: str, b: str) -> float:
    """Best partial ratio of sorted words, and 100 if a word is common."""
    both, left, right = _token_sets(a, b)
    return 100.0 if both else max(token_sort_ratio(a, b, partial_ratio), partial_ratio(left, right))


@lru_cache(maxsize=200_000)
def weighted_ratio(a: str, b: str) -> float:
    """The composite similarity, 0 to 100; 0 if either is empty.

    The plain ratio against 95 % of the best word ratio; where one string is 1.5
    times as long or more, partial ratios at 90 % (60 % from eight times) instead.
    """
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8.0 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@F.pandas_udf(T.DoubleType())
def _weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _edit(a: Column, b: Column) -> Column:
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 100.0).otherwise(100.0 * (longer - F.levenshtein(a, b)) / longer)


def letters(value: Column) -> Column:
    """The characters as a set of numbers, the second ``a`` being another one than the first: what two such sets share, the strings share in letters.

    White space counts as one letter of whatever kind it is.
    """
    sorted_ = F.array_sort(F.filter(F.split(F.translate(value, WHITE, " " * len(WHITE)), ""), lambda c: c != ""))
    # An array of one stands for a name: else the sorted letters would be worked out anew for each of them.
    return F.transform(F.array(sorted_), lambda s: F.transform(s, lambda c, i: F.ascii(c).cast("long") * (1 << 32) + i - F.array_position(s, c)))[0]


def words(value: Column) -> Column:
    """The distinct words."""
    return F.array_distinct(F.filter(F.split(value, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


class Scorer:
    """A similarity of 0 to 100 with what is known of it before it is worked out.

    ``bound(shared, a, b)`` is at least the score of two strings that share so many
    letters; ``a`` and ``b`` are structs with their length ``n`` and the length
    ``u`` of their distinct words. ``share(t)`` is the part of the smaller ``u``
    that has to be shared for a score of ``t``. ``by_word`` tells what any common word
    gives by itself: a score, with the least and the most that one string may be
    longer than the other, as (score, from, to).
    """

    def __init__(self, score: Callable[[Column, Column], Column], bound: Callable[[Column, Column, Column], Column], share: Callable[[float], float], by_word: tuple[tuple[float, float, float], ...] = ()) -> None:
        self.score, self.bound, self.share, self.by_word = score, bound, share, by_word

    def __call__(self, a: Column, b: Column) -> Column:
        return self.score(a, b)


def _weighted_bound(shared: Column, a: Column, b: Column) -> Column:
    """By letters: a common subsequence has shared letters only, and so has any stretch of words that two strings have in common.

    Where one string is much longer, a common word gives a score by itself, of
    which this bound does not speak.
    """
    plain = 200.0 * shared / (a["n"] + b["n"])
    long, short = F.greatest(a["n"], b["n"]), F.least(a["n"], b["n"])
    within = 200.0 * shared / (shared + F.least(a["u"], b["u"]))
    part = 200.0 * shared / (shared + short)
    return F.when(long < 1.5 * short, F.greatest(plain, 0.95 * within)).when(long <= 8.0 * short, F.greatest(plain, 0.9 * part, 0.855 * within)).otherwise(F.greatest(plain, 0.6 * part, 0.57 * within))


#: Native scorer: 100 less the edit distance in percent of the longer string. Letters that aren't shared cost an edit each.
edit_score = Scorer(_edit, lambda shared, a, b: 100.0 * shared / F.greatest(a["n"], b["n"]), lambda t: t / 100)
#: :func:`weighted_ratio` of two columns.
weighted_score = Scorer(lambda a, b: _weighted(a, b), _weighted_bound, lambda t: t / (200 - t), ((85.5, 1.5, 8.0), (57.0, 8.0, float("inf"))))
