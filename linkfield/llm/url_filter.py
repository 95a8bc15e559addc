"""URL filter by host and path rules, looked up in cascades of Bloom filters.

A cascade gives exact membership over a fixed universe of keys: level 0 encodes the listed keys, level 1 the
universe's keys that level 0 lets through wrongly, level 2 the listed keys that level 1 lets through, and so on
until a level has no false positive left.  The universe is every key that any url of the corpus can ask for.
A lookup is a chain of bit tests on literals: no join, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_dir

#: Bits in one level at most (16 MiB of literals); lists that need more are joined instead.
MAX_BITS = 1 << 27

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str  # "allow" or "block"

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: n_bits is a multiple of 64, words holds its bits."""

    n_bits: int
    n_hashes: int
    seed: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed + i), key), F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def passes(self, key: Column) -> Column:
        if len(self.words) <= 64:
            bits = F.array(*[F.lit(w).cast("long") for w in self.words])
        else:  # folded to one literal when the plan is made
            bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        ok = F.lit(True)
        for p in self.positions(key):
            word = F.get(bits, F.shiftrightunsigned(p, 6).cast("int"))
            ok = ok & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
        return ok


class Cascade:
    def __init__(self, levels: Sequence[Level]):
        self.levels = list(levels)

    def contains(self, key: Column) -> Column:
        """The first level that stops a key decides: an even one says not listed, an odd one listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


class TooLong(ValueError):
    """The list doesn't fit a level of the greatest size."""


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over keys (column key); its words are summed up on the executors, n_bits / 64 longs come back."""
    n_bits = _bits(n, rate)
    empty = Level(n_bits, max(1, round(-math.log2(rate))), seed, ())
    hits = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    got = hits.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()
    words = [0] * (n_bits // 64)
    for r in got:
        words[r.w] = r.bits
    return Level(n_bits, empty.n_hashes, seed, tuple(words))


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.01, max_bits: int = MAX_BITS) -> Cascade:
    """A cascade for listed over universe, both with one string column key.

    Null keys are ignored.  Only the universe's keys that pass a level are kept for the next one, so that each
    level works on about rate (then half) of the keys before it.  An empty list gives no level: contains is false.

    A large universe may leave more false positives than a level holds; then level 0 is built anew at the square of its
    rate, which costs bits in proportion to the list alone.  TooLong says that the list itself has no room.
    """
    inside = listed.where("key is not null").distinct()
    n = inside.count()
    if not n:
        return Cascade([])
    while True:
        if _bits(n, rate) > max_bits:
            raise TooLong(f"{n} keys need {_bits(n, rate)} bits in one level; the bound is {max_bits}")
        levels = [_level(inside, n, rate, 101)]
        outside = universe.where("key is not null").where(levels[0].passes(F.col("key"))).distinct().join(inside, "key", "left_anti").checkpoint()
        if _bits(outside.count(), rate) <= max_bits:
            break
        rate *= rate
    while True:
        odd = len(levels) % 2 == 1
        to_encode, other = (outside, inside) if odd else (inside, outside)
        n = to_encode.count()
        if not n:
            return Cascade(levels)
        levels.append(_level(to_encode, n, 0.5 if len(levels) > 1 else rate, 101 + 100 * len(levels)))
        kept = other.where(levels[-1].passes(F.col("key"))).checkpoint()
        inside, outside = (kept, outside) if odd else (inside, kept)


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def candidate_keys(host: Column, path: Column, n_labels: int, path_lengths: Sequence[int]) -> Column:
    """Every key of a url that a rule could have: its host's endings of up to n_labels labels, each with the path's
    beginnings of the rules' lengths; longest key first, then longest host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    ends = F.transform(F.sequence(F.greatest(F.lit(1), n - (n_labels - 1)), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= k, F.left(path, F.lit(k))) for k in path_lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda p: F.struct((-F.length(e) - F.length(p)).alias("size"), (-F.length(e)).alias("host"), F.concat(e, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def _by_join(df: DataFrame, listed: DataFrame, n_labels: int, path_lengths: Sequence[int]) -> DataFrame:
    """df (with host and path) with rule and verdict, for lists that no cascade holds: the keys of distinct hosts and
    paths meet the list in a shuffled join, and the first key that is listed goes back to the rows."""
    keys = candidate_keys(F.col("host"), F.col("path"), n_labels, path_lengths)
    asked = df.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("place", "key"))
    best = asked.join(listed, "key").groupBy(F.col("host").alias("__host"), F.col("path").alias("__path")).agg(F.min_by(F.struct("key", "action"), "place").alias("__rule"))
    out = df.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").withColumn("rule", F.col("__rule.key"))
    return out.withColumn("verdict", F.coalesce("__rule.action", F.lit("allow"))).drop("__host", "__path", "__rule")


def _shape(rules: Sequence[Rule] | DataFrame) -> tuple[int, list[int]]:
    """Labels of the rules' hosts at most, and the lengths that their paths have."""
    if not isinstance(rules, DataFrame):
        return max([r.host.count(".") + 1 for r in rules], default=1), sorted({len(r.path) for r in rules}) or [0]
    n_labels, lengths = rules.agg(F.max(F.size(F.split("host", r"\."))), F.sort_array(F.collect_set(F.length("path")))).first()
    return n_labels or 1, lengths or [0]


def filter_urls(df: DataFrame, url: str, rules: Sequence[Rule] | DataFrame, rate: float = 0.01, max_bits: int = MAX_BITS) -> DataFrame:
    """df with host, path, rule and verdict; a column of such a name in df is replaced.

    A rule fits its host and every subdomain if the path starts with the rule's path; the longest rule wins (of
    equally long ones, the longer host).  Without a rule the cascade's answer is "not listed", hence allow.  A null
    url or one without :// has an empty host and path and no rule.  Rows are kept as they are, repeated ones too.

    rules may be a table (host, path, action) of any length; rows with a null or another action are no rules, and a key that is both
    allowed and blocked is blocked.  A list that needs more than max_bits in a level is joined, with the same rows.
    """
    spark = df.sparkSession
    shared_dir(spark)
    host, path = host_and_path(F.col(f"`{url}`"))
    if isinstance(rules, DataFrame):
        rules = rules.where("host is not null and path is not null and action in ('allow', 'block')")
    n_labels, lengths = _shape(rules)
    keys = candidate_keys(host, path, n_labels, lengths)
    universe = df.select(F.explode(F.array_distinct(keys)).alias("key"))
    table = rules.select(F.concat("host", "path").alias("key"), "action") if isinstance(rules, DataFrame) else spark.createDataFrame([(r.key, r.action) for r in rules], "key string, action string")
    try:
        by_action = {a: build_cascade(table.where(F.col("action") == a).select("key"), universe, rate, max_bits) for a in ("allow", "block")}
    except TooLong:
        return _by_join(df.withColumns({"host": host, "path": path}), table.groupBy("key").agg(F.max("action").alias("action")), n_labels, lengths)
    hit = F.get(F.filter(F.col("__keys"), lambda k: by_action["allow"].contains(k) | by_action["block"].contains(k)), F.lit(0))
    out = df.withColumns({"host": host, "path": path, "__keys": keys}).withColumn("rule", hit)
    blocked = F.col("rule").isNotNull() & by_action["block"].contains(F.col("rule"))
    return out.withColumn("verdict", F.when(blocked, "block").otherwise("allow")).drop("__keys")
