"""Which texts contain which of a set of needles, without comparing every pair.

A needle is covered by its runs of ``GRAM`` bytes of UTF-8 (itself, if it is shorter); a text that contains it has them
all. Each needle is looked for by its rarest gram alone: how rare ``OWN`` of its grams are is counted on the first texts,
which changes what is compared but not what is found. The grams of all places of a batch of texts are looked up side by
side in a table of the needles' grams; texts meet the needles of the grams that they have, in a hash join, and the pairs
that meet are checked in full. A needle has one gram, so no pair meets twice.

Needles are a stated set. Up to ``most`` of them are sent to the tasks and texts are read once; more are dealt by hash into
blocks of half as many on average, and texts are read once for each block. Any script will do: words and blanks play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.functions.text import small_batches

GRAM, MOST = 8, 20_000
#: Texts that rarity is counted on, grams of a needle that are counted, and places of a batch that are looked up at once.
SAMPLE, OWN, PART = 2000, 64, 1 << 16

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _own_grams(needle: bytes) -> list[tuple[int, int]]:
    """Size and value of up to ``OWN`` grams, evenly spread."""
    size = min(len(needle), GRAM)
    last = len(needle) - size
    places = range(last + 1) if last < OWN else sorted({last * k // (OWN - 1) for k in range(OWN)})
    return list(dict.fromkeys((size, int.from_bytes(needle[i : i + size], "little")) for i in places))


def gram_numbers(grams: list[tuple[int, int]]):
    """A column function: the numbers (places in ``grams``) of the distinct grams that a text has."""
    tables = []
    for size in sorted({n for n, _ in grams}):
        # the gram's bytes are the highest of 64 bits
        keys = np.array([x << 64 - 8 * size for n, x in grams if n == size], np.uint64)
        order = np.argsort(keys)
        shift = np.uint64(64 - min(max(len(keys).bit_length() + 8, 12), 24))
        there = np.zeros(1 << 64 - int(shift), bool)
        there[keys * _FACTOR >> shift] = True
        tables.append((size, np.uint64(64 - 8 * size), keys[order], np.flatnonzero([n == size for n, _ in grams])[order], shift, there))

    def look(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(ends[-1] - ends[0])
        own = np.zeros(size + GRAM, np.uint8)
        if size:
            own[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        at = np.ndarray((size,), "<u8", own, strides=(1,))
        found = []
        for start in range(0, size, PART):
            eight = np.array(at[start : start + PART])
            for width, up, keys, numbers, shift, there in tables:
                grams = eight << up
                places = np.flatnonzero(there[grams * _FACTOR >> shift])
                if not len(places):
                    continue
                grams = grams[places]
                k = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                true = keys[k] == grams
                places, k = places[true] + start, k[true]
                rows = np.searchsorted(ends, places, "right") - 1
                whole = places + width <= ends[rows + 1]  # a gram may not reach into the next text
                if whole.any():
                    found.append(np.unique(rows[whole] * total + numbers[k[whole]]))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(both, np.arange(len(texts) + 1) * total).astype(np.int32)), pa.array((both % total).astype(np.int32)))

    total = len(grams)

    @F.arrow_udf("array<int>")
    def numbers_of(texts: pa.Array) -> pa.Array:
        return look(texts)

    return numbers_of


def _having(texts: DataFrame, text: str, grams: list[tuple[int, int]], name: str) -> DataFrame:
    """``texts`` with a row for each gram that the text has, its number as ``name``."""
    small_batches(texts.sparkSession)
    numbers: Column = gram_numbers(grams)(F.col(text).cast("binary"))
    return texts.select("*", F.explode(numbers).alias(name))


def rarest_grams(texts: DataFrame, text: str, needles: list[str]) -> list[tuple[int, int]]:
    """For each needle the one of its grams that the fewest of the first texts have."""
    own = [_own_grams(x.encode()) for x in needles]
    if all(len(x) == 1 for x in own):
        return [x[0] for x in own]
    every = list(dict.fromkeys(g for x in own for g in x))
    counted = _having(texts.select(text).limit(SAMPLE), text, every, "__gram").groupBy("__gram").agg(F.count("*").alias("n")).collect()
    seen = {every[r["__gram"]]: r["n"] for r in counted}
    return [min(x, key=lambda g: (seen.get(g, 0), g)) for x in own]


def meet(texts: DataFrame, text: str, needles: DataFrame, most: int = MOST) -> DataFrame:
    """The columns of ``texts`` and of ``needles`` (needle and others): a row for each text whose column ``text`` contains a needle. Null and empty needles are in no text."""
    needles, spark = needles.where("needle <> ''"), texts.sparkSession
    count = needles.count()
    if not count:
        return texts.limit(0).join(needles.limit(0), F.lit(True))
    blocks = 1 if count <= most else -(-2 * count // most)

    def found(some: DataFrame) -> DataFrame:
        told = sorted(r["needle"] for r in some.select("needle").distinct().collect())  # a block's
        chosen = rarest_grams(texts, text, told)
        grams = list(dict.fromkeys(chosen))
        number = {g: i for i, g in enumerate(grams)}
        keyed = some.join(F.broadcast(spark.createDataFrame([(x, number[g]) for x, g in zip(told, chosen, strict=True)], "needle string, __gram int")), "needle")
        return _having(texts, text, grams, "__gram").join(F.broadcast(keyed), "__gram").where(F.contains(F.col(text), F.col("needle"))).drop("__gram")

    def block(i: int) -> DataFrame:
        return needles if blocks == 1 else needles.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == i)

    return reduce(DataFrame.unionByName, [found(x) for x in map(block, range(blocks)) if blocks == 1 or not x.isEmpty()])
