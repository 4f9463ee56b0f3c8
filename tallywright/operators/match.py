"""Matching raw names to a dictionary: exact, blocked fuzzy, and the whole dictionary where a block is empty.

The whole dictionary is searched by an inverted index of letters, not by a scan. A
score bounds the letters that two strings must share, so of the shorter one a few
letters, the rarest, are enough to meet every entry that can reach it. Names are
tried at falling scores: who has found an entry as good as what is asked for can find
no better one later and is done, and only those left are asked with more letters.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywright.functions.similarity import Scorer, letters, weighted_score, words
from tallywright.functions.text import block_length, block_prefix, normalize_date, normalize_each, normalize_money, normalize_quantity, normalize_time, normalize_type, normalize_unicode, text
from tallywright.schemas import DEFAULTS, PRODUCT_FIELDS, Settings
from tallywright.sources.shared import kept

#: Dictionary rows that may be sent to all tasks; a larger one is joined by shuffle.
SENT_ENTRIES = 100_000
#: Scores at which names without a block are tried, down to the one that is asked for.
TRIED = (95.0, 85.5, 75.0)
#: Letters whose frequency is told to all tasks; all others count as rarer. It bears on speed only.
FREQUENT_LETTERS = 256


def sent(entries: DataFrame, most: int = SENT_ENTRIES) -> DataFrame:
    """``entries``, marked for broadcast if they are no more than ``most``."""
    return F.broadcast(entries) if len(entries.select(F.lit(1)).take(most + 1)) <= most else entries


def canonical_names(entries: DataFrame) -> DataFrame:
    """``lower``, ``canonical``, ``pos`` from (pos, canonical): the last entry of a lower-case form wins.

    The form keeps the place in the order where it first came. Entries are as they
    are, neither stripped nor composed.
    """
    lowered = entries.select("pos", "canonical", F.lower("canonical").alias("lower")).filter(F.col("lower") != "")
    return lowered.groupBy("lower").agg(F.max_by("canonical", "pos").alias("canonical"), F.min("pos").alias("pos"))


def block_index(names: DataFrame) -> DataFrame:
    """Blocks (prefix3, bucket) with their names in order."""
    keyed = names.select(block_prefix(F.col("lower")).alias("prefix3"), block_length(F.col("lower")).alias("bucket"), "pos", "lower", "canonical")
    return keyed.groupBy("prefix3", "bucket").agg(F.sort_array(F.collect_list(F.struct("pos", "lower", "canonical"))).alias("names"))


def _spread(probes: DataFrame) -> DataFrame:
    """Each of ``lower`` with the keys of its block and of the ones next to it in length."""
    steps = F.array(*[F.struct(F.lit(k).alias("step"), (block_length(F.col("lower")) + k).alias("bucket")) for k in (-1, 0, 1)])
    return probes.select("*", block_prefix(F.col("lower")).alias("prefix3"), F.inline(steps).alias("step", "bucket"))


def _blocked(entry: DataFrame) -> DataFrame:
    return entry.withColumns({"prefix3": block_prefix(F.col("candidate")), "bucket": block_length(F.col("candidate"))})


def block_candidates(probes: DataFrame, names: DataFrame) -> DataFrame:
    """``lower`` probes with the names of their block and the ones next to it in length; ``step``, then ``pos``, is the order of trial."""
    entry = names.select(F.col("lower").alias("candidate"), "canonical", "pos")
    return _spread(probes).join(sent(_blocked(entry)), ["prefix3", "bucket"]).select("lower", "candidate", "canonical", "step", "pos")


def _best(scored: DataFrame) -> DataFrame:
    """The best entry of each name: ``lower``, ``canonical``, ``score``; of equal ones the first in the order of trial."""
    turn = F.struct(-F.col("score"), "step", "pos")
    return scored.filter(F.col("score").isNotNull()).groupBy("lower").agg(F.min_by(F.struct("canonical", "score"), turn).alias("b")).select("lower", "b.*")


def _measured(names: DataFrame, name: str) -> DataFrame:
    """``names`` with ``letters`` and ``size``, the struct of lengths that bounds take."""
    unique = words(F.col(name))
    return names.withColumns({"letters": letters(F.col(name)), "size": F.struct(F.char_length(name).alias("n"), F.char_length(F.array_join(unique, " ")).alias("u"))})


def _bounded(pairs: DataFrame, scorer: Scorer, least: float) -> DataFrame:
    """Pairs of a name with an entry that can reach the score ``least``, by their letters."""
    shared = F.size(F.array_intersect("letters", "entry.letters"))
    return pairs.filter(scorer.bound(shared, F.col("size"), F.col("entry.size")) >= least - 1e-9)


def _entries(names: DataFrame) -> DataFrame:
    return _measured(names.select(F.col("lower").alias("candidate"), "canonical", "pos"), "candidate")


def _by_rarity(named: DataFrame, frequent: list[int]) -> DataFrame:
    """``letters`` in one order for all: those not in ``frequent``, then those that come late in it, and of equal rank repeated letters and those far down the code table first."""
    rank = (lambda x: F.array_position(F.lit(frequent), x)) if frequent else (lambda x: F.lit(0).cast("long"))
    ranked = F.transform("letters", lambda x: F.struct(rank(x).alias("r"), (-(x % (1 << 32))).alias("again"), (-x).alias("x")))
    return named.withColumn("letters", F.transform(F.array_sort(ranked), lambda p: -p["x"]))


def _telling(scorer: Scorer, least: float) -> Column:
    """The letters of a name of which an entry that is no shorter must have one, to reach ``least``."""
    needed = F.greatest(F.lit(1), F.ceil(F.col("size.u") * scorer.share(least) - 1e-9).cast("int"))
    return F.slice("letters", 1, F.greatest(F.lit(0), F.size("letters") - needed + 1))


def _reaching(asked: DataFrame, entries: DataFrame, scorer: Scorer, least: float) -> DataFrame:
    """lower, candidate, canonical, pos of all pairs whose bound by letters reaches ``least``, each once.

    The telling letters of the shorter one meet all letters of the other. A pair
    that meets in several letters counts at the first.
    """
    payload = F.struct("candidate", "canonical", "pos", "letters", "size").alias("entry")
    found = []
    for probe_tells in (True, False):
        mine, theirs = _telling(scorer, least) if probe_tells else F.col("letters"), F.col("letters") if probe_tells else _telling(scorer, least)
        probes = asked.withColumn("told", mine).withColumn("letter", F.explode("told"))
        index = entries.select(payload, theirs.alias("entry_told")).withColumn("of", F.explode("entry_told"))
        shorter = F.col("size.u") <= F.col("entry.size.u")
        first = F.array_intersect("told", "entry.letters") if probe_tells else F.array_intersect("entry_told", "letters")
        pairs = probes.join(index, (F.col("letter") == F.col("of")) & (shorter if probe_tells else ~shorter))
        found.append(_bounded(pairs.filter(F.get(first, F.lit(0)) == F.col("letter")), scorer, least))
    both = found[0].select("lower", "entry").unionByName(found[1].select("lower", "entry"))
    return both.select("lower", "entry.candidate", "entry.canonical", "entry.pos")


def _by_word(asked: DataFrame, entries: DataFrame, scorer: Scorer, least: float) -> DataFrame:
    """lower, canonical, pos, score of the first entry that a name shares a word with, where that gives a score by itself.

    Of the entries of a word only the first of each length matters, so a word that
    every entry has costs no more than one that few have.
    """
    index = entries.select(F.explode(words(F.col("candidate"))).alias("word"), F.col("size.n").alias("other"), "canonical", "pos").groupBy("word", "other").agg(F.min_by("canonical", "pos").alias("canonical"), F.min("pos").alias("pos"))
    met = asked.select("lower", F.col("size.n").alias("own"), F.explode(words(F.col("lower"))).alias("word")).join(index, "word")
    long, short = F.greatest("own", "other"), F.least("own", "other")
    score = F.lit(None).cast("double")
    for value, above, most in scorer.by_word:
        if value >= least:
            score = F.when((long >= above * short if above == scorer.by_word[0][1] else long > above * short) & (long <= F.lit(most) * short), value).otherwise(score)
    return met.select("lower", "canonical", "pos", score.alias("score")).filter(F.col("score").isNotNull())


def best_matches(names: DataFrame, dictionary: DataFrame, least: float, scorer: Scorer = weighted_score) -> DataFrame:
    """lower, canonical, score: of each distinct name in ``lower`` the best entry of the whole ``dictionary`` (lower, canonical, pos), if it reaches ``least``.

    Equal to scoring all pairs, of equal scores the first ``pos``; no name meets the
    dictionary in a nested loop. A dictionary that can be sent to all tasks is
    searched in one plan. Of a larger one each score that is tried is a
    plan of its own, and the search ends once no name is left.
    """
    return _searched(_measured(names.select("lower"), "lower"), _entries(dictionary), least, scorer, len(dictionary.take(SENT_ENTRIES + 1)) <= SENT_ENTRIES)


def _searched(asked: DataFrame, entries: DataFrame, least: float, scorer: Scorer, small: bool) -> DataFrame:
    if small:
        return _round(kept(_by_rarity(asked, [])), F.broadcast(_by_rarity(entries, [])), least, scorer)
    counts = entries.select(F.explode("letters").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    frequent = [r["x"] for r in counts.orderBy(F.desc("n"), "x").limit(FREQUENT_LETTERS).collect()][::-1]
    asked, entries, settled = kept(_by_rarity(asked, frequent)), kept(_by_rarity(entries, frequent)), None
    for t in sorted({least, *(t for t in TRIED if t > least)}, reverse=True):
        found = kept(_round(asked, entries, t, scorer))
        settled = found if settled is None else settled.unionByName(found)
        asked = kept(asked.join(found.select("lower"), "lower", "left_anti"))
        if asked.isEmpty():
            break
    return settled


def _round(asked: DataFrame, entries: DataFrame, least: float, scorer: Scorer) -> DataFrame:
    """lower, canonical, score of the names whose best entry reaches ``least``."""
    pairs = _reaching(asked, entries, scorer, least)
    scored = pairs.select("lower", "canonical", "pos", scorer(F.col("lower"), F.col("candidate")).alias("score"))
    if any(value >= least for value, _, _ in scorer.by_word):
        scored = scored.unionByName(_by_word(asked, entries, scorer, least))
    return _best(scored.withColumn("step", F.lit(0))).filter(F.col("score") >= least)


def match_names(raw: DataFrame, entries: DataFrame, column: str = "raw", cutoff: float = DEFAULTS.store_cutoff, fallback: float | None = DEFAULTS.store_fallback, scorer: Scorer = weighted_score) -> DataFrame:
    """``raw`` with ``matched``, ``tier`` and ``score``.

    Names are composed and stripped; each distinct one is scored once. A name equal
    in lower case is ``exact``. Else the best of its blocks counts if it reaches
    ``cutoff``: ``exact`` at 100, ``fuzzy_high`` below. Only where the blocks hold
    nothing at all, and a ``fallback`` is given, the whole dictionary is searched:
    ``fuzzy_low`` from that score on. Otherwise it is a ``miss`` and the name stays,
    composed and stripped. Only pairs that can reach the score by their letters are scored.
    """
    # The dictionary and its letters are worked out once, and looked at once for its size.
    entry = kept(_entries(canonical_names(entries)))
    small = entry.count() <= SENT_ENTRIES
    entry = F.broadcast(entry) if small else entry
    own = raw.select(text(F.col(f"`{column}`")).alias("__raw")).distinct().withColumn("__own", normalize_unicode(F.col("__raw"))).withColumn("__lower", F.lower("__own"))
    probes = own.select(F.col("__lower").alias("lower")).distinct().filter(F.col("lower") != "")
    equal = probes.join(entry.select("candidate", "canonical"), F.col("lower") == F.col("candidate"), "left").select("lower", "canonical")
    others = _measured(equal.filter(F.col("canonical").isNull()).select("lower"), "lower")
    index = _blocked(entry.select(F.struct("candidate", "canonical", "pos", "letters", "size").alias("entry"), "candidate"))
    met = _spread(others).join(F.broadcast(index) if small else index, ["prefix3", "bucket"])
    best = _best(_bounded(met, scorer, cutoff).select("lower", "step", "entry.pos", "entry.canonical", scorer(F.col("lower"), F.col("entry.candidate")).alias("score")))
    found = equal.filter(F.col("canonical").isNotNull()).withColumns({"score": F.lit(100.0), "tier": F.lit("exact")})
    found = found.unionByName(best.filter(F.col("score") >= cutoff).select("lower", "canonical", "score", F.when(F.col("score") == 100.0, "exact").otherwise("fuzzy_high").alias("tier")))
    if fallback is not None:
        blocks = index.select("prefix3", "bucket").distinct()
        taken = _spread(others).join(F.broadcast(blocks) if small else blocks, ["prefix3", "bucket"], "left_semi").select("lower").distinct()
        low = _searched(others.join(taken, "lower", "left_anti"), entry, fallback, scorer, small)
        found = found.unionByName(low.select("lower", "canonical", "score", F.lit("fuzzy_low").alias("tier")))
    told = own.join(found, F.col("__lower") == F.col("lower"), "left").select("__raw", F.coalesce("canonical", "__own").alias("matched"), F.coalesce("tier", F.lit("miss")).alias("tier"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return raw.join(told, text(F.col(f"`{column}`")) == F.col("__raw"), "left").drop("__raw")


def _looked_up(matched: dict[str, str]) -> Callable[[Column], Column]:
    """Each name of an array as ``matched`` tells it."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def look(names: pd.Series) -> pd.Series:
        return names.map(lambda v: None if v is None else [matched.get(x) for x in v])

    return look


def _by_lists(named: DataFrame, each: DataFrame) -> DataFrame:
    """``named`` with the array ``__matched``: what ``each`` (raw, matched) has for ``__names``, by joins only."""
    # In order: records may be worked out twice, and lists that were collected come in another order each time.
    listed = named.withColumn("__lines", F.array_sort(F.array_distinct("__names")))
    # A record's product names by themselves: equal lists are looked up once.
    lists = listed.select("__lines").distinct()
    told = lists.withColumn("raw", F.explode("__lines")).join(each, "raw")
    maps = told.groupBy(F.col("__lines").alias("__of")).agg(F.map_from_entries(F.collect_list(F.struct("raw", "matched"))).alias("__map"))
    return listed.join(maps, F.col("__lines") == F.col("__of"), "left").withColumn("__matched", F.transform("__names", lambda n: F.col("__map")[n])).drop("__lines", "__of", "__map")


def postprocessed(records: DataFrame, stores: DataFrame, products: DataFrame, record: str = "record", settings: Settings = DEFAULTS, scorer: Scorer = weighted_score) -> DataFrame:
    """``records`` with the struct ``record`` as it is stored: every field normalised, names matched to the dictionaries.

    Store names fall back to a scan of their dictionary, product names do not.
    Each distinct name is matched once, and its result goes back to the records:
    up to ``SENT_ENTRIES`` of them are sent to all tasks, so that records stay
    where they are; more meet the records by their lists of names in a shuffle
    join. A null record stays null, a null field becomes the empty text.
    """
    at = lambda name: F.col(f"{record}.{name}")
    known = F.coalesce(at("products"), F.array())
    # Names stay as they were read: each distinct one is composed when it is matched, not in every record.
    keyed = records.withColumns({"__name": text(at("name")), "__names": F.transform(known, lambda p: text(p["product_name"])), "__ids": normalize_each(F.transform(known, lambda p: p["product_id"]))})
    # Both are written: the records are worked out once for the names of a kind, and a join is planned by the size that its side has.
    found = lambda names, entries, cutoff, fallback: kept(match_names(kept(names.distinct()), entries, "raw", cutoff, fallback, scorer).select("raw", "matched"))
    store = sent(found(keyed.select(F.col("__name").alias("raw")), stores, settings.store_cutoff, settings.store_fallback).select(F.col("raw").alias("__raw"), F.col("matched").alias("__store")))
    named = keyed.join(store, F.col("__name") == F.col("__raw"), "left").drop("__raw")
    each = found(keyed.select(F.explode("__names").alias("raw")), products, settings.product_cutoff, None)
    few = each.take(SENT_ENTRIES + 1)
    joined = named.withColumn("__matched", _looked_up({r["raw"]: r["matched"] for r in few})(F.col("__names"))) if len(few) <= SENT_ENTRIES else _by_lists(named, each)

    def product(p: Column, i: Column) -> Column:
        given = {"product_name": F.get("__matched", i), "product_id": F.get("__ids", i), "product_quantity": normalize_quantity(p["product_quantity"])}
        return F.struct(*[given.get(f, normalize_money(p[f])).alias(f) for f in PRODUCT_FIELDS])

    rules = {"type": normalize_type, "date": normalize_date, "time": normalize_time, "total_money": normalize_money}
    fields = [F.col("__store").alias("name")] + [rules.get(f, normalize_unicode)(at(f)).alias(f) for f in ("type", "date", "time", "pos_id", "receipt_number", "cashier", "total_money", "barcode")]
    final = F.when(F.col(record).isNotNull(), F.struct(*fields, F.transform(known, product).alias("products")))
    return joined.select(*[final.alias(c) if c == record else F.col(f"`{c}`") for c in records.columns])
