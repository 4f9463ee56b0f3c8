"""URL filter, native: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

A rule (host, path) fits its host and all hosts below it where the URL's path
starts with the rule's; of several the longest counts. Where no rule fits, a URL
that the list holds is blocked, in whatever form it is written: both sides are
compared as canonical URLs. The list's filter goes to every task; what it passes
meets the list itself in a hash join, so nothing is blocked by chance.

The filter is a table of blocks of 256 bits, each key having one bit in each of
the eight words of one block. A key so needs one row of the table, and the filter
is probed by a join on the block's number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for a listed URL, and of a block.
BITS_EACH, BLOCK_BITS = 12, 256
#: Blocks of the filter at most: with their numbers 48 bytes a row, so 13 MB are sent to a task.
#: A list of over 5,592,405 URLs has fewer bits each; then the filter passes more, and the join decides as before.
MOST_BLOCKS = 1 << 18
#: Rules that are evaluated as one expression.
MOST_RULES = 1_000
#: Query parameters that tell where a reader came from, not what is read (fixed values).
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|msclkid)(?:=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEED = 71

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``, as for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``, as for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the ways in which one page's URL is written; null without ``://``.

    Scheme, user, fragment, a leading ``www.``, a last dot of the host, the
    ports 80 and 443, slashes at the path's end and parameters that only track
    readers go; the other parameters are put in order.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"(?::(?:80|443)?)$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.(?=.)", "")
    given = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(given, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), query))


def parsed_rules(rules: Sequence[Rule]) -> list[tuple[str, str, str, str]]:
    """(verdict, ``host/path``) as (text, host, path, verdict), the longest text first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: put them into the list")
    found = [(text, *text.partition("/")[::2], verdict) for verdict, text in rules]
    return sorted(((text, host, f"/{path}", verdict) for text, host, path, verdict in found), key=lambda r: (-len(r[0]), r[0]))


def _decided(host: Column, path: Column, rules: list[tuple[str, str, str, str]], at: int) -> Column:
    """Field ``at`` of the first of ``rules`` that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = ((host == rule[1]) | F.endswith(host, F.lit(f".{rule[1]}"))) & F.startswith(path, F.lit(rule[2]))
        out = F.when(fits, F.lit(rule[at])).otherwise(out)
    return out


def block_of(key: Column, blocks: int) -> Column:
    """Number of the key's block."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def words_of(key: Column) -> list[Column]:
    """The key's bits as four numbers of 64, each of two words of 32 bits with one bit set."""
    drawn = F.xxhash64(F.lit(_SEED), key)
    bit = lambda i: (F.shiftrightunsigned(drawn, 5 * i) % 32).cast("int")
    one = F.lit(1).cast("long")
    # shiftleft of the DataFrame API takes a number of places that is the same for all rows.
    return [F.call_function("shiftleft", one, bit(2 * w)).bitwiseOR(F.call_function("shiftleft", one, bit(2 * w + 1) + 32)) for w in range(4)]


def blocks_for(listed: int) -> int:
    """Blocks of a filter for so many URLs: a power of two, bounded."""
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * BLOCK_BITS < BITS_EACH * listed:
        blocks *= 2
    return blocks


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, w0 to w3: the filter of the column ``key``. Tasks merge their keys' bits before the shuffle, which has a row a block and task at most."""
    marked = keys.select(block_of(F.col(key), blocks), *[w.alias(f"w{i}") for i, w in enumerate(words_of(F.col(key)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def maybe_listed(rows: DataFrame, key: str, bloom: DataFrame, blocks: int, output: str) -> DataFrame:
    """``rows`` with ``output``: whether the filter lets ``key`` pass. A null key does not."""
    found = F.broadcast(bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(4)]))
    held = F.lit(True)
    for i, word in enumerate(words_of(F.col(key))):
        held = held & (F.col(f"__w{i}").bitwiseAND(word) == word)
    joined = rows.join(found, block_of(F.col(key), blocks) == F.col("__block"), "left")
    return joined.withColumn(output, F.col(key).isNotNull() & F.coalesce(held, F.lit(False))).drop("__block", *[f"__w{i}" for i in range(4)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url: str = "url", keep: Sequence[str] | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``listed``.

    ``listed`` has a column ``url`` of URLs to block in any form; repeated and
    null ones, and those without ``://``, count as none. ``rules`` are pairs of a
    verdict (``allow`` or ``block``) and ``host/path``. ``keep`` names the columns
    of ``pages`` that stay, all by default; of a name that the results have, the
    result stays. Every row of ``pages`` gives one row: a null URL has empty host
    and path, no rule, and is allowed, as every URL is if list and rules are empty.
    """
    made = ("host", "path", "rule", "verdict", "listed")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in made]
    fixed = parsed_rules(rules)
    at = F.col("__url")
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url}`").alias("__url"))
    rows = rows.withColumns({"host": host_of(at), "path": path_of(at), "__key": canonical(at)})
    rows = rows.withColumns({"rule": _decided(F.col("host"), F.col("path"), fixed, 0), "__ruled": _decided(F.col("host"), F.col("path"), fixed, 3)})
    keys = listed.select(canonical(F.col("url")).alias("__listed")).filter(F.col("__listed").isNotNull()).distinct()
    blocks = blocks_for(keys.count())
    tried = maybe_listed(rows, "__key", bloom_filter(keys, "__listed", blocks), blocks, "__maybe")
    # What the filter stops goes on without a shuffle; only what it passes meets the list.
    stopped = tried.filter(~F.col("__maybe")).withColumn("listed", F.lit(False))
    passed = tried.filter(F.col("__maybe")).join(keys, F.col("__key") == F.col("__listed"), "left").withColumn("listed", F.col("__listed").isNotNull()).drop("__listed")
    both = stopped.unionByName(passed)
    return both.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("__ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
