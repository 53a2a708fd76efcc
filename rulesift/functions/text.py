"""Scalar text functions as Column expressions, and the one Pandas UDF (NFKC) that Spark has no function for."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space of scripts that also know the byte-order mark: Unicode's, and U+FEFF.
SPACE = r"[\s\x{FEFF}]"
#: The same characters, written out: Unicode's white space and U+FEFF.
BLANKS = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_WORD = r"[\p{L}\p{N}]+"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: Bytes of an Arrow batch, as far as single rows allow: a batch is held by Spark and, as text objects several times its size, by Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession | None) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, if its own bound isn't lower; else 10,000 rows of any length are one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = ((spark and spark.conf.get(name, None)) or "").rstrip("bB")
    if spark and (not now.isdigit() or int(now) > BATCH_BYTES):
        spark.conf.set(name, f"{BATCH_BYTES}b")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; null stays null."""
    return texts.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_each(lists: pd.Series) -> pd.Series:
    """``nfkc`` of every text of an array."""
    return lists.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def trim(text: Column) -> Column:
    """Strip Unicode white space and byte-order marks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def compact(text: Column) -> Column:
    """Remove all white space."""
    return F.regexp_replace(text, rf"(?U){SPACE}+", "")


def normalize_corpus(text: Column) -> Column:
    """CRLF to LF, then trim."""
    return trim(F.regexp_replace(text, "\r\n", "\n"))


def _where(text: Column, signs: list[str], pattern: str, by: str) -> Column:
    """The pattern replaced, in texts that have one of the signs; others, which a replacement wouldn't change, are not searched by the pattern."""
    return F.element_at(F.transform(F.array(text), lambda x: F.when(reduce(Column.__or__, [F.contains(x, F.lit(y)) for y in signs]), F.regexp_replace(x, pattern, by)).otherwise(x)), 1)


def fold_search(composed: Column) -> Column:
    """The search form of a text that is composed already: line ends, blanks, case, ends."""
    lines = _where(composed, ["\r"], "\r\n?", "\n")
    blanks = _where(_where(lines, ["\t", "  "], "[\t ]+", " "), [" \n", "\n "], " *\n *", "\n")
    return trim(F.lower(blanks))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer partitions than there are: a small file is read by few tasks, and what is done with texts costs more than a shuffle of them. Inputs of many partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def composed(text: Column, compose: bool = True) -> Column:
    """NFKC; texts of ASCII alone, which have it already, don't go to Python. ``compose=False`` for texts known to be in NFKC keeps the plan free of it."""
    if not compose:
        return text
    small_batches(SparkSession.getActiveSession())
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(nfkc(F.when(~plain, text)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once for a row, whatever reads them: filters on them aren't moved below."""
    made = F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{x}`") for x in df.columns if x not in columns], made)


def normalize_search(text: Column, compose: bool = True) -> Column:
    """Search form."""
    return fold_search(composed(text, compose))


def normalize_comparable(text: Column, compose: bool = True) -> Column:
    return trim(F.regexp_replace(composed(text, compose), rf"(?U){SPACE}+", " "))


def same_comparable(a: Column, b: Column, compose: bool = True) -> Column:
    return normalize_comparable(a, compose) == normalize_comparable(b, compose)


def normalize_name(text: Column, compose: bool = True) -> Column:
    return compact(composed(text, compose))


def plain_names(names: Column) -> Column:
    """Map from the texts of an array, composed and without blanks; rows without any don't go to Python."""
    some = F.array_distinct(F.filter(names, lambda n: n.isNotNull()))
    there = F.when(F.size(some) > 0, some)
    return F.map_from_arrays(F.coalesce(there, F.array().cast("array<string>")), F.transform(F.coalesce(nfkc_each(there), F.array().cast("array<string>")), compact))


def utf16_length(text: Column) -> Column:
    """UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(text) + F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(_ASTRAL)))


def measure(text: Column) -> Column:
    """struct(charCount, byteCount) with CRLF as LF: code points and UTF-8 bytes."""
    lines = F.regexp_replace(text, "\r\n", "\n")
    return F.struct(F.length(lines).alias("charCount"), F.octet_length(lines).alias("byteCount"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))


def tokens(text: Column) -> Column:
    """Distinct words and joined neighbours in order of first sight."""

    def both(found: Column) -> Column:
        pairs = F.when(F.size(found) > 1, F.zip_with(F.slice(found, 1, F.size(found) - 1), F.slice(found, 2, F.size(found) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(found, pairs))

    return F.element_at(F.transform(F.array(words(text)), both), 1)  # the words are looked for once


def count_in(haystack: Column, needle: Column) -> Column:
    """Leftmost non-overlapping occurrences; none of an empty needle."""
    size = F.octet_length(needle)
    return F.when(size == 0, 0).otherwise(((F.octet_length(haystack) - F.octet_length(F.replace(haystack, needle, F.lit("")))) / F.greatest(size, F.lit(1))).cast("int"))


def index_of(text: Column, part: Column) -> Column:
    """Code points before the first occurrence; null where there is none."""
    at = F.instr(text, part)
    return F.when(at > 0, at - 1)


def sha256_upper(text: Column) -> Column:
    return F.upper(F.sha2(text, 256))


def truncate(text: Column, n: int = 80) -> Column:
    return F.substring(text, 1, n)


def pad_start(text: Column, n: int) -> Column:
    """Zero padding that never cuts."""
    return F.lpad(text, F.greatest(F.length(text), F.lit(n)), F.lit("0"))


def cumulative(sizes: Column) -> Column:
    """Sums of the numbers (int) before each place of an array. In each round a place takes in the sum that lies 1, 2, 4, ... places before: no array is appended to."""
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(sizes))).cast("int") - 1, F.lit(0)))

    def step(sums: Column, k: Column) -> Column:
        gap = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: F.when(i >= gap, x + F.get(sums, i - gap)).otherwise(x))

    return F.zip_with(F.aggregate(rounds, sizes, step), sizes, lambda total, n: total - n)


def occurrence_starts(text: Column, span: Column) -> Column:
    """Code-point starts of leftmost non-overlapping exact occurrences."""
    parts = F.call_function("split", text, F.concat(F.lit("\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    before = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda g: F.length(g))
    seen = F.zip_with(before, cumulative(F.transform(before, lambda n: n + F.length(span))), lambda n, at: (at + n).cast("int"))
    return F.when(F.length(span) > 0, seen).otherwise(F.array().cast("array<int>"))


def snippet(text: Column, folded: Column, query: Column, query_tokens: Column, around: int = 120) -> Column:
    """Up to ``around`` code points on either side of the first token (of the text as it is, else of its search form ``folded``)."""
    lowered = F.lower(text)
    first = F.array_min(F.transform(query_tokens, lambda t: F.when(F.instr(lowered, t) > 0, F.instr(lowered, t) - 1)))
    other = F.array_min(F.concat(F.array(index_of(folded, query)), F.transform(query_tokens, lambda t: F.when(F.instr(folded, t) > 0, F.instr(folded, t) - 1))))
    at = F.least(F.coalesce(first, other, F.lit(0)), F.length(text))
    start, end = F.greatest(at - around, F.lit(0)), F.least(F.length(text), at + around)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "…").otherwise(""))
