"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is ``WINDOW`` consecutive words
of a benchmark item. Every run of ``GRAM`` words has a hash. Of the ``WINDOW - GRAM + 1`` runs in a window the one with
the least hash, rightmost on ties, is kept; neighbouring windows mostly keep the same one, which is a single fingerprint
with its position. So a text has about two fingerprints for ``WINDOW - GRAM + 2`` words, and every window of it has one
of them inside. Equal windows keep the same run at the same place, so a join of test and training fingerprints meets
every shared window: the test side knows how far its window starts before the kept run, the hit is extended to that
whole window, word by word, and only equal windows count. An item of fewer words is one window; its fingerprint is the
hash of all its words, and texts have one for each run of such a length.

Spread: a document is read once for all lengths, turned into fingerprints inside one generated stage and looked up in
the benchmark's there, so only hits, and a row for each document, leave the scan. The benchmark's fingerprints are
broadcast if their number, which is counted first, is within ``BROADCAST_ROWS``. Beyond that hashes alone are shuffled,
distinct ones of each document, to find the documents that share any; of these the fingerprints are joined with their
words. Hits are gathered by document.

Cases: null and empty texts have no words; items without words match nothing. An empty benchmark leaves every document
clean. Repeated item ids with different texts count as one item. Repeated documents get a row each. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import free_names

WINDOW, GRAM = 10, 5
#: Runs in a window.
RUNS = WINDOW - GRAM + 1
#: Benchmark fingerprints that may be broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; ``lower`` does just that for texts of ASCII alone, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words; null for a null text."""
    parts = F.split(text, _SEPARATORS, -1)
    head = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, head, F.greatest(F.size(parts) - head - tail + 1, F.lit(0)))


def _hash(hashes: Column, at: Column, n: int) -> Column:
    """Of the n words from a position."""
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(n)])


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _rightmost(runs: list[Column], least: Column) -> Column:
    """The offset of the last run that has the least hash."""
    out = F.lit(0)
    for k, run in enumerate(runs):
        out = F.when(run == least, F.lit(k)).otherwise(out)
    return out


def fingerprints(texts: DataFrame, lengths: list[int], mark: bool = False) -> DataFrame:
    """The columns of ``texts`` (words, hashes and others), n, fp, p: a row for each fingerprint of windows of each length, p being the position of its run; with ``mark`` one more for each text, with n 0 and p -1."""
    shorts, at, hashes, size = [n for n in lengths if n < WINDOW], F.col("__at"), F.col("hashes"), F.size("words")
    first, last = F.lit(-1 if mark else 0), F.coalesce(size, F.lit(0)) - min(lengths)
    places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array(F.lit(-1)) if mark else F.array().cast("array<int>"))
    rows = texts.select("*", F.explode_outer(places).alias("__at"))  # outer: else the words are made again for a filter on their number
    # The run before the window and those in it: made once, as filters aren't moved below a generator.
    runs = [_hash(hashes, at + k - 1, GRAM) for k in range(RUNS + 1)]
    rows = rows.select("*", F.inline_outer(F.array(F.struct(*[r.alias(f"__r{k}") for k, r in enumerate(runs)]))))
    here = [F.col(f"__r{k}") for k in range(1, RUNS + 1)]
    least, before = F.least(*here), F.least(*[F.col(f"__r{k}") for k in range(RUNS)])
    new = (at == 0) | (least != before) | (here[-1] == least)
    key = lambda n, fp, p: F.struct(F.lit(n).alias("n"), fp.alias("fp"), p.cast("int").alias("p"))
    keys = [F.when(at == -1, key(0, F.lit(0).cast("long"), at))] if mark else []
    keys += [F.when((at >= 0) & (at + WINDOW <= size) & new, key(WINDOW, least, at + _rightmost(here, least)))] if WINDOW in lengths else []
    keys += [F.when((at >= 0) & (at + n <= size), key(n, _hash(hashes, at, n), at)) for n in shorts]
    # No lambda from here on: it would end the generated stage, and rows would leave it with all their words.
    found = rows.select(*texts.columns, F.explode_outer(F.array(*keys)).alias("__key")).where("__key IS NOT NULL")
    return found.select(*texts.columns, "__key.n", "__key.fp", "__key.p")


def _tests(items: DataFrame) -> DataFrame:
    """n, fp, offset, item_id, window: every window of the items (words, hashes); the fingerprint's run stands ``offset`` words after its start."""
    at, size = F.col("__at"), F.size("words")
    n = F.least(size, F.lit(WINDOW))
    rows = items.where(size > 0).select("item_id", "words", "hashes", F.explode_outer(F.sequence(F.lit(0), size - n)).alias("__at"))
    runs = [_hash(F.col("hashes"), at + k, GRAM) for k in range(RUNS)]
    whole = F.xxhash64("hashes")  # of an array it is the hash of its members one after the other
    least = F.least(*runs)
    long = size >= WINDOW
    return rows.select(n.alias("n"), F.when(long, least).otherwise(whole).alias("fp"), F.when(long, _rightmost(runs, least)).otherwise(0).alias("offset"), "item_id", F.slice("words", at + 1, n).alias("window"))


def hits(docs: DataFrame, benchmark: DataFrame, mark: bool = False) -> DataFrame:
    """Columns of ``docs`` (a and b, which name a row, text, and others) but text; item_id, at, n: occurrences of item windows (n words from position ``at``).

    With ``mark`` there is also a row for each document, at -1, with n_words: documents are then read once for both.
    """
    names = [c for c in docs.columns if c != "text"]
    items = benchmark.select("item_id", words_of(ascii_lower(F.col("text"))).alias("words")).withColumn("hashes", _word_hashes(F.col("words")))
    size = F.size("words")
    found = items.where(size > 0).groupBy(F.least(size, F.lit(WINDOW)).alias("n")).agg(F.sum(F.greatest(size - WINDOW + 1, F.lit(1))).alias("windows")).collect()  # WINDOW rows at most
    lengths, windows = sorted({r["n"] for r in found} or {WINDOW}), sum(r["windows"] for r in found)
    tests = _tests(items)
    start = F.col("p") - F.col("offset")
    same = F.coalesce((start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window")), F.lit(False))

    def texts(some: DataFrame) -> DataFrame:
        return some.select(*names, words_of(ascii_lower(F.col("text"))).alias("words")).withColumn("hashes", _word_hashes(F.col("words")))

    def out(met: DataFrame) -> DataFrame:
        counted = F.when(F.col("n") == 0, F.when(F.col("words").isNull(), 0).otherwise(size)).cast("long")
        return met.select(*names, "item_id", start.alias("at"), "n", counted.alias("n_words"))

    if windows <= BROADCAST_ROWS:
        if mark:  # a document's own row meets a row of its own: an outer join would be slower
            kinds = {f.name: f.dataType for f in tests.schema}
            none = {"n": F.lit(0), "fp": F.lit(0), "offset": F.lit(0)}
            tests = tests.unionByName(docs.sparkSession.range(1).select(*[none.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in tests.columns]))
        met = fingerprints(texts(docs), lengths, mark).join(F.broadcast(tests), ["n", "fp"])
        return out(met.where((F.col("n") == 0) | same if mark else same))
    shared = fingerprints(texts(docs), lengths).select("a", "b", "n", "fp").distinct().join(tests.select("n", "fp").distinct(), ["n", "fp"], "left_semi").select("a", "b").distinct()
    met = fingerprints(texts(docs.join(shared, ["a", "b"], "left_semi")), lengths)
    around = F.greatest(F.col("p") - WINDOW, F.lit(0))  # a fingerprint goes with the words that its windows may have
    near = met.select(*names, "n", "fp", F.col("p").alias("__p"), around.alias("__from"), F.slice("words", around + 1, 2 * WINDOW).alias("words")).join(tests, ["n", "fp"])
    near = near.withColumn("p", F.col("__p") - F.col("__from")).where(same)
    own = near.select(*names, "item_id", (start + F.col("__from")).alias("at"), "n", F.lit(None).cast("long").alias("n_words"))
    if mark:
        each = texts(docs).select(*names, F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("n"), F.when(F.col("words").isNull(), 0).otherwise(size).cast("long").alias("n_words"))
        own = own.unionByName(each)
    return own


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a, b, text: two hashes name a row beside its id, so that rows that share an id but not a text stay apart."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), "text")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    hit = F.col("at") >= 0
    places = F.collect_set(F.when(hit, F.struct("at", "n")))
    rolled = hits(keyed(docs), benchmark, mark=True).groupBy("doc_id", "a", "b").agg(
        F.count_if(F.col("at") == -1).alias("rows"), F.max("n_words").alias("n_words"), places.alias("places"), F.array_sort(F.collect_set(F.when(hit, F.col("item_id").cast("string")))).alias("items")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))).cast("long")
    each = rolled.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))  # repeated rows get a row each
    return each.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: rows without a hit, with their columns as they were."""
    a, b = free_names(docs, "a", "b")
    dirty = hits(keyed(docs).drop("doc_id"), benchmark).select(F.col("a").alias(a), F.col("b").alias(b)).distinct()
    own = (F.xxhash64("doc_id", "text") == F.col(a)) & (F.xxhash64("text", F.lit(1)) == F.col(b))
    return docs.join(dirty, own, "left_anti").select(*[f"`{x}`" for x in docs.columns])
