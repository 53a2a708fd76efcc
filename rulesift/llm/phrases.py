"""Phrase collocation mining by contiguous pattern growth over projected occurrence pointers.

Text: A-Z lower-cased, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces into words ``[^\\x20\\x09]+``. Everything is
counted for each lang. A phrase is up to ``LONGEST`` words in a row of one piece; it is frequent if it occurs ``SUPPORT``
times, overlaps included. What a frequent phrase contains is frequent too, so patterns grow from frequent ones alone:

1. Shards. Partitions of the input are written as sequences of word numbers of their own (``SHARD`` words each and the
   ``LONGEST - 1`` that follow), with the words. The counts meet by word; a frequent word gets an id, and each shard is
   told those of its own.
2. Prefixes. Each shard counts its pairs of frequent words; the counts meet by pair, and a shard is told which of its
   pairs are frequent in the corpus, and how often they occur.
3. Projection. A frequent pair is a prefix. Its occurrence pointers are the places that start with it and go on, and the
   words up to ``LONGEST`` go with them as far as the next pairs are frequent; equal ones are one with a count.
4. Growth. All pointers of a prefix meet in one task, sorted, so that a pattern's pointers are a range. The task extends
   the pattern to the right, depth first: the range is cut by the next word, and each part that has the support is a
   pattern itself. A prefix of over ``HOT`` occurrences is dealt into that many tasks by a hash of the words that follow;
   their counts are partial, and no part of them is left out before they are summed.

Words are told apart by numbers, never by hashes, so counts are exact.

``collocations`` cuts each candidate after its first k words: l and r are the counts of the parts, n of all the lang's
words, the score floor(1000 * a * n / (l * r)) in decimals of 38 digits. The lowest-scoring cut counts, the smallest k on
ties. Candidates are dropped if a longer one that contains them occurs as often; as counts only fall when a phrase grows,
it is enough to look at those that are one word longer.

Hot words and pairs: a shard sends a word, a pair or a continuation once, with its count. Words, pairs and shares of a
prefix travel packed, by hash. Beyond a shard's own words nothing is gathered or broadcast.

Cases: a null text is the empty text, which has no words; a null lang is ``und``. Repeated rows count as often as they
occur. Extra columns are ignored. An empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulesift.functions.text import dealt
from rulesift.llm.common import discard, map_pieces, materialize, small_batches, utf8

LONGEST, SUPPORT, FIRST = 5, 100, 2000
#: Words in a shard, entries of a bucket about, and occurrences of a prefix that one task grows.
SHARD, BUCKET, HOT = 1 << 21, 1 << 20, 1 << 18
#: Bytes of a long text that are read at once, patterns that are handed on together, and salts of the first ranking.
SLICE, MADE, SALTS = 1 << 20, 50_000, 32

#: A-Z to a-z, separators to a line end, a tab to a blank.
_PLAIN = bytes.maketrans(bytes(range(0x41, 0x5B)) + b".,;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(0x61, 0x7B)) + b"\n" * 10 + b" ")
_TOKEN = re.compile(rb"[^ \n]+|\n")
_END = re.compile(rb"[ \n]")


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in its plain form, in parts that don't cut a word."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            near = _END.search(text, end)
            end = near.start() if near else len(text)
        yield text[at:end]
        at = end


class _Shard:
    """Words met so far, by lang, and their numbers one after the other; -1 ends a piece."""

    def __init__(self):
        self.count = itertools.count()
        self.known: dict[str, defaultdict[bytes, int]] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = defaultdict(self.count.__next__, {b"\n": -1})
        self.put(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))

    def put(self, numbers: np.ndarray) -> None:
        self.parts.append(numbers)
        self.size += len(numbers)

    def cut(self, most: int) -> tuple[np.ndarray, int, list[tuple[str, bytes]]]:
        """The first ``most`` numbers with those that follow, how many are its own, and the words; the rest stays."""
        whole = np.concatenate(self.parts)
        words: list[tuple[str, bytes]] = [("", b"")] * next(self.count)
        for lang, known in self.known.items():
            for word, number in known.items():
                if number >= 0:
                    words[number] = (lang, word)
        own = min(most, len(whole))
        rest = whole[own:]
        self.__init__()
        for number in rest.tolist():  # a few words: they are numbered anew
            lang, word = words[number] if number >= 0 else ("", b"\n")
            self.add(lang, [word])
        return whole[: own + LONGEST - 1], own, words


def shards(docs: DataFrame, most: int = SHARD) -> DataFrame:
    """shard, own, numbers (packed), langs and words (of each number) of every ``most`` words of a partition."""
    kept = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), utf8())
    names = ["seq", "own", "numbers", "langs", "words"]

    def row(seq: int, shard: _Shard) -> pa.RecordBatch:
        numbers, own, words = shard.cut(most)
        return pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([own], pa.int32()), pa.array([_pack(numbers.astype(np.int32))]), pa.array([[x[0] for x in words]], pa.list_(pa.string())), pa.array([[x[1] for x in words]], pa.list_(pa.binary()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq = _Shard(), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in _parts((text or b"").translate(_PLAIN)):
                    tokens = _TOKEN.findall(part)
                    shard.add(lang, tokens)
                    while shard.size >= most + LONGEST:
                        yield row(seq, shard)
                        seq += 1
                shard.put(np.full(1, -1, np.int32))
        while shard.size:
            yield row(seq, shard)
            seq += 1

    made = map_pieces(kept, run, "seq long, own int, numbers binary, langs array<string>, words array<binary>")
    return made.select((F.spark_partition_id().cast("long") * (1 << 32) + F.col("seq")).alias("shard"), "own", "numbers", "langs", "words")


def _pack(x: np.ndarray) -> bytes:
    """The numbers' bytes, all first ones, all second ones and so on: most of the higher ones are zero, and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _joined(parts: list[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    each = [np.frombuffer(x, np.uint8).reshape(size, -1).T for x in parts]
    return np.ascontiguousarray(np.concatenate(each)).view(kind).ravel() if each else np.zeros(0, kind)


def _rows(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` of every row, as a dict, gives batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work({c: batch.column(c)[i] for c in batch.schema.names})

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def shard_words(coded: DataFrame, buckets: int) -> DataFrame:
    """bucket, shard, numbers and times (packed), sizes and keys (joined): the words of each shard and how often its own places have them."""

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        numbers = _joined([row["numbers"].as_py()], np.int32)[: row["own"].as_py()]
        keys = [w + b" " + x.encode() for w, x in zip(row["words"].as_py(), row["langs"].as_py(), strict=True)]  # no word has a blank
        times = np.bincount(numbers[numbers >= 0], minlength=len(keys))
        bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)) % np.uint64(buckets)).astype(np.int32)
        out = []
        for k, (own, n) in _packed([np.arange(len(keys), dtype=np.int32), times], bucket):
            some = [keys[i] for i in _joined([own], np.int32).tolist()]
            out.append((k, row["shard"].as_py(), own, n, _pack(np.fromiter(map(len, some), np.int32, len(some))), b"".join(some)))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["bucket", "shard", "numbers", "times", "sizes", "keys"])

    return _rows(coded, work, "bucket int, shard long, numbers binary, times binary, sizes binary, keys binary")


def frequent_words(counted: DataFrame, buckets: int, support: int) -> DataFrame:
    """shard, numbers and ids (packed), for each shard the frequent words it has; for no shard (null) all of them once, as words, and the words of each lang, as totals."""
    schema = "shard long, numbers binary, ids binary, words array<struct<id:long,lang:string,word:binary,times:long>>, totals array<struct<lang:string,n:long>>"
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("times", pa.int64())])), pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))]

    def work(held: dict) -> Iterator[pa.RecordBatch]:
        known: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        codes = []
        for sizes, keys in zip(held["sizes"], held.pop("keys"), strict=True):
            ends = np.cumsum(_joined([sizes], np.int32)).tolist()
            codes.append(np.fromiter((known[keys[a:b]] for a, b in itertools.pairwise([0, *ends])), np.int64, len(ends)))
        total = np.zeros(len(known), np.int64)
        for code, times in zip(codes, held["times"], strict=True):
            total[code] += _joined([times], np.int64)  # a shard has a word once
        first, frequent = held["bucket"][0], total >= support
        out = []
        for shard, numbers, code in zip(held["shard"], held["numbers"], codes, strict=True):
            kept = frequent[code]
            if kept.any():
                out.append((shard, _pack(_joined([numbers], np.int32)[kept]), _pack(first + buckets * code[kept]), None, None))
        totals: defaultdict[str, int] = defaultdict(int)
        words = []
        for i, (key, n) in enumerate(zip(known, total.tolist(), strict=True)):
            word, lang = key.split(b" ", 1)
            totals[lang.decode()] += n
            if n >= support:
                words.append({"id": first + buckets * i, "lang": lang.decode(), "word": word, "times": n})
        out.append((None, None, None, words, [{"lang": x, "n": n} for x, n in totals.items()]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["shard", "numbers", "ids", "words", "totals"])

    return _by_bucket(counted, buckets, work, schema)


def _packed(arrays: list[np.ndarray], buckets: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The arrays' entries of each bucket, packed."""
    order = np.argsort(buckets, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], np.diff(buckets[order]) != 0))) if len(order) else np.zeros(0, np.int64)
    arrays = [np.ascontiguousarray(x[order]) for x in arrays]
    for a, b in itertools.pairwise([*at.tolist(), len(order)]):
        yield int(buckets[order[a]]), [_pack(x[a:b]) for x in arrays]


def _mixed(*ids: np.ndarray) -> np.ndarray:
    x = np.zeros(len(ids[0]), np.uint64)
    for y in ids:
        x = (x ^ y.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of a shard, and the id of each number, -1 if the word isn't frequent; the last one is that of number -1."""
    ids = np.full(row["n"].as_py() + 1, -1, np.int64)
    ids[_joined(row["known"].as_py() or [], np.int32)] = _joined(row["ids"].as_py() or [], np.int64)
    return _joined([row["numbers"].as_py()], np.int32), ids


def _unique(first: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and where a new row of values begins in it."""
    order = np.lexsort((*reversed(more), first))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (first, *more):
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    return order, np.flatnonzero(new)


def shard_pairs(known: DataFrame, buckets: int) -> DataFrame:
    """bucket, shard, a, b and times (packed): the pairs of frequent words of each shard's own places; pairs that only follow them come with no times."""

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        numbers, ids = _places(row)
        own = row["own"].as_py()
        there = (ids[numbers[:-1]] >= 0) & (ids[numbers[1:]] >= 0)
        every = np.where(there, numbers[:-1].astype(np.int64) << 32 | numbers[1:], -1)
        keys, times = np.unique(every[:own][there[:own]], return_counts=True)
        more = np.setdiff1d(every[own:][there[own:]], keys)
        keys, times = np.concatenate((keys, more)), np.concatenate((times, np.zeros(len(more), np.int64)))
        a, b = ids[keys >> 32], ids[keys & 0xFFFFFFFF]
        out = list(_packed([a, b, times.astype(np.int32)], (_mixed(a, b) % np.uint64(buckets)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([row["shard"].as_py()] * len(out), pa.int64()), *(pa.array([x[1][k] for x in out], pa.binary()) for k in range(3))], ["bucket", "shard", "a", "b", "times"])

    return _rows(known, work, "bucket int, shard long, a binary, b binary, times binary")


def _by_bucket(rows: DataFrame, buckets: int, work, schema: str) -> DataFrame:
    """``work`` gets the rows of each bucket, as lists by column."""
    names = rows.columns
    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {c: [] for c in names}
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                bucket = values[names.index("bucket")]
                if bucket != at:
                    if at is not None:
                        yield from work(held)
                    at, held = bucket, {c: [] for c in names}
                for c, x in zip(names, values, strict=True):
                    held[c].append(x)
        if at is not None:
            yield from work(held)

    small_batches(rows.sparkSession)
    return dealt.mapInArrow(run, schema)


def frequent_pairs(pairs: DataFrame, buckets: int, support: int) -> DataFrame:
    """shard, a, b and times (packed; times in the corpus), for each shard the frequent pairs it has, and for no shard (null) all pairs once."""

    def work(held: dict) -> Iterator[pa.RecordBatch]:
        place = np.repeat(np.arange(len(held["shard"]), dtype=np.int32), [len(x) // 4 for x in held["times"]])
        a, b, times = _joined(held.pop("a"), np.int64), _joined(held.pop("b"), np.int64), _joined(held.pop("times"), np.int32)
        order, starts = _unique(a, b)
        total = np.add.reduceat(times[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(starts, len(order))))
        kept, once = each >= support, order[starts[total >= support]]
        out = [(held["shard"][i], x) for i, x in _packed([a[kept], b[kept], each[kept]], place[kept])]
        out += [(None, [_pack(x[once]) for x in (a, b, each)])] * bool(len(once))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[1][k] for x in out], pa.binary()) for k in range(3))], ["shard", "a", "b", "times"])

    return _by_bucket(pairs, buckets, work, "shard long, a binary, b binary, times binary")


_WORDS = [f"w{k}" for k in range(LONGEST)]
_TOLD = ("pa", "pb", "pt")


def projected(known: DataFrame, buckets: int, hot: int) -> DataFrame:
    """bucket, parts, w0, w1, ... and times (packed): the occurrence pointers of each frequent pair that go on, with the words that follow; -1 where they end."""

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "whole", *_WORDS, "times"]
        numbers, ids = _places(row)
        if row["pa"].as_py() is None:
            return
        a, b, f = (_joined(row[x].as_py(), np.int64) for x in _TOLD)
        # The shard's numbers of the pairs, and for each place whether its pair is frequent.
        order = np.argsort(ids, kind="stable")
        back = lambda x: order[np.searchsorted(ids, x, sorter=order)].astype(np.int64)
        keys = back(a) << 32 | back(b)
        by_key = np.argsort(keys)
        keys, f = keys[by_key], f[by_key]
        place = np.where((numbers[:-1] >= 0) & (numbers[1:] >= 0), numbers[:-1].astype(np.int64) << 32 | numbers[1:], -1)
        at = np.minimum(np.searchsorted(keys, place), len(keys) - 1)
        frequent = keys[at] == place
        goes = np.zeros(len(place) + LONGEST, bool)
        goes[: len(place)] = frequent
        starts = np.flatnonzero(goes[: row["own"].as_py()] & goes[1 : row["own"].as_py() + 1])
        if not len(starts):
            return
        padded = np.concatenate((numbers, np.full(LONGEST, -1, np.int32)))
        words, on = [padded[starts], padded[starts + 1]], np.ones(len(starts), bool)
        for k in range(2, LONGEST):
            on = on & goes[starts + k - 1]
            words.append(np.where(on, padded[starts + k], -1))
        order, new = _unique(*words)
        times = np.diff(np.append(new, len(order))).astype(np.int64)
        first = order[new]
        total = f[at[starts[first]]]
        found = [ids[w[first]] for w in words]
        parts = -(-total // hot)
        part = (_mixed(*found[2:]) % parts.astype(np.uint64)).astype(np.int64)
        out = list(_packed([*found, times], ((_mixed(found[0], found[1], part) % np.uint64(buckets)) * np.uint64(2) + (parts == 1)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] // 2 for x in out], pa.int32()), pa.array([x[0] % 2 == 1 for x in out]), *(pa.array([x[1][k] for x in out], pa.binary()) for k in range(LONGEST + 1))], names)

    return _rows(known, work, f"bucket int, whole boolean, {', '.join(f'{w} binary' for w in _WORDS)}, times binary")


def grow(words: list[np.ndarray], times: np.ndarray, a: int, b: int, depth: int, support: int) -> Iterator[tuple[int, int, int]]:
    """Patterns of over ``depth`` words among the sorted pointers a to b, depth first: a pointer that has it, its words, its occurrences."""
    if depth == len(words):
        return
    column = words[depth][a:b]
    cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
    for x, y in itertools.pairwise([0, *cuts.tolist(), b - a]):
        if column[x] >= 0:
            total = int(times[a + x : a + y].sum())
            if total >= support:
                yield a + x, depth + 1, total
                yield from grow(words, times, a + x, a + y, depth + 1, support)


def grown(pointers: DataFrame, buckets: int, support: int) -> DataFrame:
    """words (an array of ids) and times of the patterns of three words and more; those of dealt prefixes are partial."""

    def work(held: dict) -> Iterator[pa.RecordBatch]:
        for whole in (True, False):
            rows = [i for i, x in enumerate(held["whole"]) if x == whole]
            if not rows:
                continue
            words, times = [_joined([held[w][i] for i in rows], np.int64) for w in _WORDS], _joined([held["times"][i] for i in rows], np.int64)
            order, _ = _unique(*words)
            words, times = [w[order] for w in words], times[order]
            prefixes = np.flatnonzero((words[0][1:] != words[0][:-1]) | (words[1][1:] != words[1][:-1])) + 1
            patterns = itertools.chain.from_iterable(grow(words, times, x, y, 2, support if whole else 1) for x, y in itertools.pairwise([0, *prefixes.tolist(), len(times)]))
            while some := list(itertools.islice(patterns, MADE)):
                yield pa.RecordBatch.from_arrays([pa.array([[int(w[p]) for w in words[:n]] for p, n, _ in some], pa.list_(pa.int64())), pa.array([t for _, _, t in some], pa.int64())], ["words", "times"])

    return _by_bucket(pointers, buckets, work, "words array<long>, times long")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, most: int = SHARD, bucket: int = BUCKET, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: words (id, lang, word, times) and phrases (words, an array of ids, and times) that are frequent, and n (lang, n)."""
    coded = materialize(shards(dealt(docs.select("lang", "text")), most), "phrase-shards")
    size = coded.agg(F.coalesce(F.sum(F.col("own").cast("long")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // bucket), docs.sparkSession.sparkContext.defaultParallelism)
    found = materialize(frequent_words(shard_words(coded, buckets), buckets, support), "frequent-words")
    words = found.where("shard IS NULL").select(F.inline("words"))
    n = found.where("shard IS NULL").select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("n"))
    told = found.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("numbers").alias("known"), F.collect_list("ids").alias("ids"))
    known = coded.select("shard", "own", "numbers", F.size("words").alias("n")).join(told, "shard", "left")
    known = materialize(known, "phrase-known")
    discard(coded)
    frequent = materialize(frequent_pairs(shard_pairs(known, buckets), buckets, support), "frequent-pairs")
    pairs = _rows(frequent.where("shard IS NULL").select("a", "b", "times"), _unpack_pairs, "words array<long>, times long")
    told = frequent.where("shard IS NOT NULL").groupBy("shard").agg(*[F.collect_list(c).alias(x) for c, x in zip(("a", "b", "times"), _TOLD, strict=True)])
    pointers = projected(known.join(told, "shard", "left"), buckets, hot)
    longer = grown(pointers, buckets, support).groupBy("words").agg(F.sum("times").alias("times")).where(F.col("times") >= support)
    one = words.select(F.array("id").alias("words"), "times")
    phrases = materialize(one.unionByName(pairs).unionByName(longer), "phrases")
    discard(known, frequent)
    return words, phrases, n


def _unpack_pairs(row: dict) -> Iterator[pa.RecordBatch]:
    a, b, times = (_joined([row[c].as_py()], np.int64) for c in ("a", "b", "times"))
    flat = np.stack((a, b), axis=1).ravel()
    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2, dtype=np.int32)), pa.array(flat)), pa.array(times)], ["words", "times"])


def score() -> Column:
    """floor(1000 * a * n / (l * r)) of long columns, exactly."""
    big = {c: F.col(c).cast("decimal(17,0)") for c in "anlr"}
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * big["a"] * big["n"], big["l"] * big["r"])


def collocations(docs: DataFrame, first: int = FIRST, support: int = SUPPORT, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first candidates."""
    words, phrases, n = frequent_phrases(docs, support, **sizes)
    candidates = phrases.where(F.size("words") > 1)
    # A longer candidate that occurs as often takes out what it contains.
    longer = candidates.where(F.size("words") > 2)
    size = F.size("words")
    inside = longer.select(F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1))).alias("words"), "times").distinct()
    open_ = candidates.join(inside, ["words", "times"], "left_anti")
    cuts = open_.select("words", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"), F.get("words", F.lit(0)).alias("id"))
    cuts = cuts.join(phrases.select(F.col("words").alias("left"), F.col("times").alias("l")), "left").join(phrases.select(F.col("words").alias("right"), F.col("times").alias("r")), "right")
    cuts = cuts.join(words.select("id", "lang"), "id").join(n, "lang")
    lowest = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct(score().alias("score"), "k", "l", "r")).alias("cut")).select("lang", "words", "a", "n", "cut.score", "cut.l", "cut.r")
    spelled = lowest.select("*", F.posexplode("words").alias("place", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("lang", "words", "a", "n", "score", "l", "r").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("each"))
    named = spelled.select("lang", F.array_join(F.transform("each", lambda x: x["word"].cast("string")), " ").alias("phrase"), "a", "l", "r", "n", "score")
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    some = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
