"""LM scoring with Brown class-based n-grams.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end. Every word of the training
texts has a class of its own choice; the number of classes grows with the vocabulary. Classes are found in two steps:

1. Exchange: the ``CLUSTERED`` most frequent tokens are units of their own, all others share a unit with the words of
   the same ending. Units move between classes so that the likelihood of the corpus' class bigrams grows every time.
2. Placing: every word that shared a unit is taken by itself. Its neighbours' classes of step 1 are counted over all
   training texts, and it goes to the class where these counts raise the likelihood most. This is one shuffle of
   partial counts, packed by hash buckets of words; words are placed side by side, against the class bigrams of step 1.

Class bigrams are then counted anew over all training texts, with every word's last class. The model is

    P(token | before) = P(class | class before) * P(word | class)

with smoothed relative frequencies; the text's first token follows an end. Words that training texts don't have belong
to the class with the most words. Beside it stands a base, the smoothed unigram model.

Texts are cut into words twice: for the word counts, and then into a table of their words' numbers, which everything
else reads. All counts cover all training texts: word counts are summed in the cluster and never gathered; unit bigrams
are at most ``(CLUSTERED + ENDINGS)^2`` numbers, class bigrams the square of the number of classes. Workers hold the
``HELD`` most frequent words; the other words of a text stand beside its numbers and meet the full table in a join.

Cases: null and empty texts are one end. Without training texts the counts are 0 and all scores follow from smoothing.
Repeated rows count, and get a row, as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import discard, id_remainder, map_pieces, materialize, pieces, utf8

#: Units: most frequent tokens (the end included), and endings that the other words are dealt into.
CLUSTERED, ENDINGS = 1024, 512
#: Classes of a small vocabulary; a larger one has the cube root of its size.
CLASSES = 48
#: Frequent words that each worker holds with their counts.
HELD = 131_072
#: Rounds of exchange at most.
ROUNDS = 12
#: Smoothing: of words against the vocabulary or their class, and of class bigrams.
ALPHA, BIGRAM = 0.1, 20.0
#: Distinct words of a worker's partial count, neighbours that it counts at once, bytes of numbers that it looks at at once for these, and hash buckets of words for each partition.
PARTIAL, NEIGHBOURS, CUT, BUCKETS = 200_000, 1_000_000, 1 << 20, 32
#: Pairs of a word and a neighbour's class that are weighed against all classes at once.
WEIGHED = 8192

UNITS = CLUSTERED + ENDINGS
END = 0  # the end's unit


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def ending(word: bytes) -> int:
    """The unit that words that aren't frequent begin in, by their last three bytes."""
    return CLUSTERED + zlib.crc32(word[-3:]) % ENDINGS


def class_count(vocabulary: int) -> int:
    return max(CLASSES, round(vocabulary ** (1 / 3)))


# --- counts -----------------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words."""
    counts: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])
        counts.clear()

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(tokens(text))
        if len(counts) > PARTIAL:
            yield from out()
    yield from out()


class _Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Lexicon:
    """The words of the training texts."""

    vocabulary: int  # distinct ones
    held: dict[bytes, int]  # numbers of the most frequent ones
    held_n: np.ndarray  # their counts

    @property
    def frequent(self) -> int:
        """How many of the held words are units of their own."""
        return min(len(self.held), CLUSTERED - 1)


def lexicon(texts: DataFrame) -> Lexicon:
    """Count the words of every row of ``texts`` (text)."""
    counts = materialize(map_pieces(texts.select(utf8()), _word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "brown-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(HELD).toArrow()  # HELD rows
    out = Lexicon(counts.count(), {w: i for i, w in enumerate(top["word"].to_pylist())}, top["n"].to_numpy())
    discard(counts)
    return out


def _codes(shared):
    """A row for each text: a sum over the words that are held, the numbers of its words, and the words that aren't held; word j of these has -1 - j for a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_log = shared.value
        for batch in batches:
            logs, known, codes, rare = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                code = np.fromiter(map(held.get, words, repeat(-1)), np.int32, len(words))
                at, others = np.flatnonzero(code < 0), _Numbers()
                if len(at):
                    code[at] = [-1 - others[words[k]] for k in at.tolist()]
                logs.append(float(held_log[code[code >= 0]].sum()))
                known.append(len(words) - len(at))
                codes.append(code.tobytes())
                rare.append(list(others))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(logs, pa.float64()), pa.array(known, pa.int64()), pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary()))],
                ["row", "doc_id", "held_out", "logs", "known", "codes", "rare"],
            )

    return run


def coded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """row, doc_id, held_out (as they are), logs (of the held words' counts), known (how many are held), codes (numbers of the words) and rare (words that aren't held) for every row of ``docs``: a written table."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", utf8())
    shared = docs.sparkSession.sparkContext.broadcast((words.held, np.log10(words.held_n + ALPHA)))
    return materialize(map_pieces(named, _codes(shared), f"row long, doc_id {id_type}, held_out boolean, logs double, known long, codes binary, rare array<binary>"), "brown-texts")


def _unit_ids(batch: pa.RecordBatch, held_units: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all texts in order, an end before the first and after each: units, numbers (-2 for an end, word j of the words that aren't held has -3 - j), and these words."""
    sizes = pc.binary_length(batch.column("codes")).to_numpy() // 4
    code = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int32).astype(np.int64)
    rare, lists = batch.column("rare").flatten(), pc.list_value_length(batch.column("rare")).to_numpy()
    units, inner = np.zeros(len(code) + len(sizes) + 1, np.int64), np.ones(len(code) + len(sizes) + 1, bool)
    inner[np.concatenate(([0], np.cumsum(sizes + 1)))] = False
    others = np.flatnonzero(code < 0)
    j = -1 - code[others] + np.repeat(np.cumsum(lists) - lists, sizes)[others]
    own = held_units[np.maximum(code, 0)] if len(held_units) else code.copy()
    own[others] = np.fromiter(map(ending, rare.to_pylist()), np.int64, len(rare))[j]
    code[others] = -3 - j
    numbers = np.full(len(units), -2, np.int64)
    units[inner], numbers[inner] = own, code
    return units, numbers, rare


_ENTRY = np.dtype([("slot", "<u2"), ("n", "<u4")])


def _bigrams(held_units: np.ndarray):
    """Partial counts of the units after each unit, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.uint32)
        for batch in batches:
            for part in pieces(batch, "codes", CUT):
                ids, _, _ = _unit_ids(part, held_units)
                pair, n = np.unique(ids[:-1] * UNITS + ids[1:], return_counts=True)
                total[pair] += n.astype(np.uint32)
        for unit, row in enumerate(total.reshape(UNITS, UNITS)):
            at = np.flatnonzero(row)
            if len(at):
                entries = np.empty(len(at), _ENTRY)
                entries["slot"], entries["n"] = at, row[at]
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([entries.tobytes()], pa.binary())], ["unit", "packed"])

    return run


def _sum_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows of the bigram table; the partial ones come by unit."""
    unit, total = None, np.zeros(UNITS, np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["unit", "row"])
    for batch in batches:
        for u, packed in zip(*(batch.column(c).to_pylist() for c in ("unit", "packed")), strict=True):
            if u != unit:
                if unit is not None:
                    yield out()
                unit, total = u, np.zeros(UNITS, np.int64)
            entries = np.frombuffer(packed, _ENTRY)
            total[entries["slot"]] += entries["n"]
    if unit is not None:
        yield out()


# --- clustering -------------------------------------------------------------------------------------------------


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit. n: unit bigram counts. Units move, one at a time, to the class where the class-bigram likelihood is highest."""
    size = len(n)
    n = n.astype(np.float64)
    frequency = n.sum(axis=1) + n.sum(axis=0)
    order = np.argsort(-frequency, kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    c = member.T @ n @ member
    rows, columns = n @ member, member.T @ n  # unit -> class after it, class -> unit after it
    out_u, in_u = n.sum(axis=1), n.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not frequency[u]:
                continue
            k, self_n = of[u], n[u, u]
            r, q = rows[u].copy(), columns[:, u].copy()
            r[k] -= self_n
            q[k] -= self_n
            # without the unit
            c[k] -= r
            c[:, k] -= q
            c[k, k] -= self_n
            left, right = c.sum(axis=1), c.sum(axis=0)
            after, before = np.flatnonzero(r), np.flatnonzero(q)
            gain = (_phi(c[:, after] + r[after]) - _phi(c[:, after])).sum(axis=1) + (_phi(c[before] + q[before, None]) - _phi(c[before])).sum(axis=0)
            own = np.diag(c)
            gain += _phi(own + r + q + self_n) - _phi(own + r) - _phi(own + q) + _phi(own)
            gain -= _phi(left + out_u[u]) - _phi(left) + _phi(right + in_u[u]) - _phi(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            c[best] += r
            c[:, best] += q
            c[best, best] += self_n
            if best != k:
                moved += 1
                of[u] = best
                rows[:, k] -= n[:, u]
                rows[:, best] += n[:, u]
                columns[k] -= n[u]
                columns[best] += n[u]
        if not moved:
            break
    return of


# --- placing ----------------------------------------------------------------------------------------------------

def _neighbours(shared, buckets: int):
    """Partial counts of the classes before and after each word that isn't frequent: rows of a bucket's words, how many entries each has, and the entries; slot k is class k before the word, slot classes + k class k after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held_units, of, classes = shared.value
        numbers = _Numbers()
        seen: list[np.ndarray] = [np.zeros(0, np.int64)]
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(seen), return_counts=True)
            del seen[1:]
            word = keys // (2 * classes)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
            own, sizes = word[first], np.diff(np.append(first, len(word)))
            others = list(numbers)
            words = [names[i] if i < len(names) else others[i - len(names)] for i in own.tolist()]
            numbers.clear()
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            entries = np.empty(len(keys), _ENTRY)
            entries["slot"], entries["n"] = keys % (2 * classes), counts
            ends = np.concatenate(([0], np.cumsum(sizes[order])))
            entries = entries[np.repeat(first[order] - ends[:-1], sizes[order]) + np.arange(len(keys))]
            heads = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0))) if len(order) else order
            cuts = np.append(heads, len(order))
            for at in range(0, len(heads), 256):
                c = cuts[at : at + 257]
                named = pa.array([words[i] for i in order[c[0] : c[-1]].tolist()], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array((c - c[0]).astype(np.int32)), named)
                lengths = pa.ListArray.from_arrays(pa.array((c - c[0]).astype(np.int32)), pa.array(sizes[order[c[0] : c[-1]]].astype(np.int32)))
                packed = [entries[ends[i] : ends[j]].tobytes() for i, j in pairwise(c.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order[c[:-1]]].astype(np.int32)), lists, lengths, pa.array(packed, pa.binary())], ["bucket", "words", "sizes", "packed"])

        frequent = min(len(names), CLUSTERED - 1)
        for batch in batches:
            for part in pieces(batch, "codes", CUT):
                ids, code, rare = _unit_ids(part, held_units)
                at, c = np.flatnonzero((code >= frequent) | (code < -2)), of[ids]
                own = code[at]
                unheld = own < 0
                local = np.fromiter(map(numbers.__getitem__, rare.to_pylist()), np.int64, len(rare))
                own[unheld] = len(names) + local[-3 - own[unheld]]
                own *= 2 * classes
                seen.append(np.concatenate((own + c[at - 1], own + classes + c[at + 1])))
                size += 2 * len(at)
                if len(numbers) > PARTIAL or size > NEIGHBOURS:
                    yield from out()
                    size = 0
        yield from out()

    return run


def best_classes(group: np.ndarray, slot: np.ndarray, n: np.ndarray, own: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's count, and the class where its neighbours raise the likelihood most when it is taken out of its own.

    group, slot, n: counts of neighbours, ordered by word; own: the word's class so far; c: class bigrams with all words
    in them.
    """
    classes = len(c)
    table = np.concatenate((c, c.T))  # slot -> the bigrams that a word in class k adds to
    once = (_phi(table + 1) - _phi(table)).astype(np.float32)
    total = np.bincount(group[slot < classes], n[slot < classes], len(own))
    left, right = c.sum(axis=1), c.sum(axis=0)
    starts = np.searchsorted(group, np.arange(len(own) + 1))
    best, at = np.empty(len(own), np.int64), 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + WEIGHED, "right")) - 1)
        e = slice(starts[at], starts[to])
        s, k, own_k, t = slot[e], n[e].astype(np.float64), own[group[e]], total[at:to]
        gain = once[s]
        more = np.flatnonzero(k > 1)
        gain[more] = _phi(table[s[more]] + k[more, None]) - _phi(table[s[more]])
        there = table[s, own_k]
        gain[np.arange(len(s)), own_k] = _phi(there) - _phi(np.maximum(there - k, 0))
        gain = np.add.reduceat(gain, starts[at:to] - starts[at], axis=0)
        rows, mine = np.arange(to - at), own[at:to]
        each, of_each = np.unique(t, return_inverse=True)
        for side in (left, right):
            lost = (_phi(side + each[:, None]) - _phi(side))[of_each]
            lost[rows, mine] = _phi(side[mine]) - _phi(np.maximum(side[mine] - t, 0))
            gain -= lost
        gain[rows, mine] += 1e-9
        gain[:, (left == 0) & (right == 0)] = -np.inf  # all words would go to the same empty class
        best[at:to] = gain.argmax(axis=1)
        at = to
    return total.astype(np.int64), best


def _place(of: np.ndarray, c: np.ndarray):
    """word, n, class from partial counts that come by bucket."""

    def placed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        words = pa.concat_arrays([r.column("words").flatten() for r in rows]).dictionary_encode()
        first, index = words.dictionary, words.indices.to_numpy()
        sizes = np.concatenate([r.column("sizes").flatten().to_numpy() for r in rows])
        entries = np.frombuffer(b"".join(x for r in rows for x in r.column("packed").to_pylist()), _ENTRY)
        keys, inverse = np.unique(np.repeat(index.astype(np.int64), sizes) * (2 * len(c)) + entries["slot"], return_inverse=True)
        n = np.bincount(inverse, entries["n"], len(keys))
        own = of[np.fromiter(map(ending, first.to_pylist()), np.int64, len(first))]
        total, best = best_classes(keys // (2 * len(c)), keys % (2 * len(c)), n, own, c)
        return pa.RecordBatch.from_arrays([first, pa.array(total), pa.array(best.astype(np.int32))], ["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in pairwise(ends):
                if a == b:
                    continue
                if held and held[0].column("bucket")[0].as_py() != bucket[a]:
                    yield placed(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield placed(held)

    return run


# --- model ------------------------------------------------------------------------------------------------------


@dataclass
class Words:
    table: DataFrame  # word (binary), n, class: every word of the training texts
    held_class: np.ndarray  # of the held words by their numbers
    classes: int
    end_class: int
    unseen: int  # the class of words that aren't in the table
    class_total: np.ndarray  # denominators of P(word | class)
    ends: int
    tokens: int
    vocabulary: int

    @property
    def base_total(self) -> float:
        return self.tokens + ALPHA * (self.vocabulary + 1)


def learn(docs: DataFrame) -> Words:
    """The words of every row of ``docs`` (doc_id, text) with their counts and classes."""
    lex = lexicon(docs)
    return classes_of(coded(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), lex), lex)


def classes_of(texts: DataFrame, lex: Lexicon) -> Words:
    """The classes of a lexicon's words, from the coded texts that it has counted."""
    spark, classes, frequent = texts.sparkSession, class_count(lex.vocabulary), lex.frequent
    names = list(lex.held)
    held_units = np.array([*range(1, frequent + 1), *map(ending, names[frequent:])], np.int64)
    codes = texts.select("codes", "rare")

    partial = codes.mapInArrow(_bigrams(held_units), "unit int, packed binary").repartition("unit").sortWithinPartitions("unit")
    rows = partial.mapInArrow(_sum_bigrams, "unit int, row binary").toArrow()  # UNITS rows of UNITS numbers at most
    bigrams = np.zeros((UNITS, UNITS))
    for unit, row in zip(rows["unit"].to_pylist(), rows["row"].to_pylist(), strict=True):
        bigrams[unit] = np.frombuffer(row, np.int64)
    ends = int(bigrams[:, END].sum())
    of = exchange(bigrams, classes)
    member = np.zeros((UNITS, classes))
    member[np.arange(UNITS), of] = 1

    partitions = max(texts.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast((names, held_units, of, classes))
    counted = codes.mapInArrow(_neighbours(shared, BUCKETS * partitions), "bucket int, words array<binary>, sizes array<int>, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    placed = counted.mapInArrow(_place(of, member.T @ bigrams @ member), "word binary, n long, class int")
    first = spark.createDataFrame([(w, int(n), int(of[i])) for i, (w, n) in enumerate(zip(names[:frequent], lex.held_n[:frequent], strict=True), 1)], "word binary, n long, class int")
    table = materialize(first.unionByName(placed), "brown-classes")
    held = table.orderBy(F.desc("n"), "word").limit(HELD).toArrow()  # HELD rows
    held_class = np.zeros(len(names), np.int32)
    held_class[[lex.held[w] for w in held["word"].to_pylist()]] = held["class"].to_numpy()
    n, v = np.zeros(classes), np.zeros(classes)
    for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row for each class at most
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    unseen, end_class = int(v.argmax()), int(of[END])
    n[end_class] += ends
    v[end_class] += ends > 0
    return Words(table, held_class, classes, end_class, unseen, n + ALPHA * (v + 1), ends, int(n.sum()), int(v.sum()))


def _resolve(shared, unseen: int):
    """The classes of all words, with what the words that aren't held add to the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_class = shared.value
        for batch in batches:
            found = batch.column("found")
            js, ns, cs = (found.values.field(k).to_numpy() for k in range(3))
            ends = found.offsets.to_numpy()
            logs, known, codes = [], [], []
            for i, (packed, s, more, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("codes", "logs", "known", "n_rare")), strict=True)):
                own = np.frombuffer(packed, np.int32)
                code = held_class[np.maximum(own, 0)]
                if size:
                    n, of, part = np.zeros(size, np.int64), np.full(size, unseen, np.int32), slice(ends[i], ends[i + 1])
                    n[js[part]], of[js[part]] = ns[part], cs[part]
                    at = np.flatnonzero(own < 0)
                    j = -1 - own[at]
                    code[at] = of[j]
                    s += float(np.log10(n[j] + ALPHA).sum())
                    more += int((n[j] > 0).sum())
                logs.append(s)
                known.append(more)
                codes.append(code.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(logs, pa.float64()), pa.array(known, pa.int64()), pa.array(codes, pa.binary())], ["doc_id", "held_out", "logs", "known", "codes"])

    return run


def classed(texts: DataFrame, words: Words) -> DataFrame:
    """doc_id, held_out, logs (of the words' counts), known, codes (classes of the words) for every coded text: a written table."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rare = texts.select("row", F.posexplode("rare").alias("j", "word"))
    found = rare.join(words.table, "word").groupBy("row").agg(F.collect_list(F.struct("j", "n", "class")).alias("found"))
    none = F.array().cast("array<struct<j:int,n:bigint,class:int>>")
    whole = texts.select("row", "doc_id", "held_out", "logs", "known", "codes", F.size("rare").alias("n_rare")).join(found, "row", "left").withColumn("found", F.coalesce("found", none))
    shared = texts.sparkSession.sparkContext.broadcast(words.held_class if len(words.held_class) else np.zeros(1, np.int32))
    return materialize(whole.mapInArrow(_resolve(shared, words.unseen), f"doc_id {id_type}, held_out boolean, logs double, known long, codes binary"), "brown-coded")


def _class_bigrams(classes: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        last = np.array([end], np.uint16).tobytes()
        for part in (part for batch in batches for part in pieces(batch, "codes", CUT)):
            c = np.frombuffer(last + b"".join([x + last for x in part.column("codes").to_pylist()]), np.uint16).astype(np.int64)
            total += np.bincount(c[:-1] * classes + c[1:], minlength=classes * classes)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(total[pairs])], ["pair", "n"])

    return run


def transitions(texts: DataFrame, words: Words) -> np.ndarray:
    """log10 P(class | class before), of coded texts."""
    k = words.classes
    pairs = texts.select("codes").mapInArrow(_class_bigrams(k, words.end_class), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # the square of the classes at most
    c = np.zeros(k * k)
    c[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    c = c.reshape(k, k)
    class_n = c.sum(axis=0)
    prior = (class_n + 1) / (class_n.sum() + k)
    return np.log10((c + BIGRAM * prior) / (c.sum(axis=1, keepdims=True) + BIGRAM))


def score(texts: DataFrame, words: Words, transition: np.ndarray) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every coded text."""
    shared = texts.sparkSession.sparkContext.broadcast(transition - np.log10(words.class_total))
    end, end_log, base_log, ends, train = words.end_class, float(np.log10(words.ends + ALPHA)), float(np.log10(words.base_total)), words.ends > 0, words.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            sums, size = [], []
            for packed in batch.column("codes").to_pylist():
                c = np.concatenate(([end], np.frombuffer(packed, np.uint16), [end])).astype(np.int64)
                sums.append(steps[c[:-1], c[1:]].sum())
                size.append(len(c) - 1)
            n, logs = np.array(size, np.int64), batch.column("logs").to_numpy() + end_log
            s = np.array(sums, np.float64) + logs
            columns = [n, batch.column("known").to_numpy() + int(ends), np.full(len(n), train, np.int64), logs - base_log * n, s, 10.0 ** (-s / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def judge(docs: DataFrame) -> DataFrame:
    """Score every row; learn from rows that are not held out."""
    held_out = id_remainder(10) == 0
    lex = lexicon(docs.where(~held_out))
    numbers = coded(docs.select("doc_id", held_out.alias("held_out"), "text"), lex)
    words = classes_of(numbers.where("NOT held_out"), lex)
    texts = classed(numbers, words)
    discard(numbers, words.table)
    return score(texts, words, transitions(texts.where("NOT held_out"), words))
