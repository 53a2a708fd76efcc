"""URL filter by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path. It fits a url whose host is the rule's host or a subdomain of it and whose path starts
with the rule's path. A url has a bounded set of candidate keys: every suffix of its host at a label boundary, joined
with every prefix of its path that has the length of some rule's path. The url is listed if a candidate is a rule.

The cascade answers membership exactly for the key universe, i.e. all candidates of the corpus: level 1 is a Bloom
filter of the listed keys; level 2 one of the universe's keys that pass level 1 without being listed; level 3 one of
the listed keys that pass level 2; and so on until a level stands for no key. A key's class is decided by the first
level that it doesn't pass. Levels are arrays of 64-bit words that were gathered by bit-or over word positions, so a
level's build brings words, never keys, to the driver, and a query is a few array reads for each candidate: no join.

The rule list is a parameter, so it and the filters, whose sizes follow from it, are bounded; each is one constant of the
plan, however long. Level 1 is made large enough that about as many other keys pass as there are rules. The universe is
written once, and so is what passes a level, so that urls are read once for the build and once to be judged.

Cases: a null url, or one without ``://``, has empty host and path and no rule. The longest rule (host and path
together) wins, on a tie the one with the longer host. Repeated rows get a row each. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import discard, free_names, materialize

#: (host, path, verdict)
Rule = tuple[str, str, str]

#: The share of keys that pass a level after the first.
LATER_RATE = 0.5
#: Verdict for urls that no rule fits: the cascade says they aren't listed.
UNLISTED = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for other texts."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys ``host suffix + path prefix`` for path prefixes of the given lengths that the path has; longest first by host."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def constant(values: Iterable, kind: str) -> Column:
    """An array that the optimizer folds into one constant: a list of any length is no long expression."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), f"array<{kind}>")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]

    def position(self, key: Column, number: int, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(number * 64 + i)), F.lit(self.bits))

    def passes(self, key: Column, number: int) -> Column:
        words = constant(self.words, "bigint")
        found = F.lit(True)
        for i in range(self.hashes):
            at = self.position(key, number, i)
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            found = found & (F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return found


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions of a filter of n keys with this share of false positives."""
    hashes = max(1, round(-log2(rate)))
    return max(64, ceil(-n * log(rate) / log(2) ** 2 / 64) * 64), hashes


def _build(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A level of the distinct ``keys.key``; the driver gets at most bits / 64 words."""
    bits, hashes = _shape(n, rate)
    empty = Level(bits, hashes, ())
    positions = keys.select(F.explode(F.array(*[empty.position(F.col("key"), number, i) for i in range(hashes)])).alias("at"))
    words = positions.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = {r["word"]: r["bits"] for r in words.collect()}
    return Level(bits, hashes, tuple(found.get(i, 0) for i in range(bits // 64)))


class Cascade:
    """Levels and the test of a key of the universe that they were built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, key: Column) -> Column:
        """A key that fails at an even position from the first isn't listed, at an odd one is; the last level's class is exact."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(self.levels[number].passes(key, number), verdict).otherwise(F.lit(number % 2 == 1))
        return verdict


def build(universe: DataFrame, listed: DataFrame, n_listed: int) -> Cascade:
    """A cascade for ``listed.key`` that is exact over ``universe.key`` (repeats allowed)."""
    if not n_listed:
        return Cascade([])
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    levels = [_build(listed, n_listed, min(LATER_RATE, n_listed / max(size, 1)), 0)]
    # Keys that pass all levels so far: the wrong side's are what the next level holds.
    wrong = materialize(universe.where(levels[0].passes(F.col("key"), 0)).join(F.broadcast(listed), "key", "left_anti").distinct(), "cascade")
    other, made = listed, [wrong]
    while n := wrong.count():
        number = len(levels)
        levels.append(_build(wrong, n, LATER_RATE, number))
        wrong, other = materialize(other.where(levels[-1].passes(F.col("key"), number)), "cascade"), wrong
        made.append(wrong)
    discard(*made)
    return Cascade(levels)


def judge(urls: DataFrame, rules: list[Rule], column: str = "url") -> DataFrame:
    """The columns of ``urls`` but the url's, with host, path, rule and verdict."""
    spark = urls.sparkSession
    verdicts: dict[str, str] = {}
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    for host, path, verdict in order:
        verdicts.setdefault(host + path, verdict)
    lengths = sorted({len(path) for _, path, _ in rules})
    own = ("host", "path", "rule", "verdict", column)
    parts = urls.select(*[F.col(f"`{x}`") for x in urls.columns if x.lower() not in own], host_of(F.col(column)).alias("host"), path_of(F.col(column)).alias("path"))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(UNLISTED)})
    keys = candidates(F.col("host"), F.col("path"), lengths)

    # The universe: distinct hosts and path prefixes are far fewer than urls, so they're made distinct first.
    heads = parts.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct()
    universe = materialize(heads.select(F.explode(keys).alias("key")).distinct(), "cascade-universe")
    cascades = {}
    for verdict in sorted(set(verdicts.values())):
        mine = [k for k, v in verdicts.items() if v == verdict]
        cascades[verdict] = build(universe, spark.range(1).select(F.explode(constant(mine, "string")).alias("key")), len(mine))
    discard(universe)

    def ranked(cascade: Cascade, verdict: str) -> Column:
        def rank(key: Column) -> Column:
            slash = F.instr(key, "/")
            return F.struct(F.length(key).alias("n"), F.when(slash > 0, slash).otherwise(F.length(key) + 1).alias("host_n"), key.alias("rule"), F.lit(verdict).alias("verdict"))

        return F.transform(F.filter(keys, cascade.listed), rank)

    marked = F.concat(*[ranked(cascade, verdict) for verdict, cascade in cascades.items()])
    name = free_names(parts, "best")[0]
    best = parts.withColumn(name, F.array_max(marked))
    return best.select(*[f"`{x}`" for x in parts.columns], F.col(f"{name}.rule").alias("rule"), F.coalesce(f"{name}.verdict", F.lit(UNLISTED)).alias("verdict"))
