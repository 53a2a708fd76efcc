"""Substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document. Every word is removed that is covered by a window whose words
also start anywhere else, in the same document too. Whole texts are judged, and all windows on the input.

1. Phrases. Every window has an anchor, the first in an order by hash of its ``PHRASE``-word runs, leftmost on ties.
   Equal windows have equal anchors. Anchors are counted over the corpus by a 64-bit key; a window whose anchor occurs
   once can't recur.
2. Confirmation. The other windows are counted over the corpus by 95 bits of hash of all their words. A row has the
   windows of one anchor in one shard, packed; rows of one anchor meet, and the windows that start at least twice are
   the confirmed recurring passages. Where these are all windows that the anchor has in the shard, the anchor says it
   all and the windows aren't listed.
3. Automata. Documents are dealt into shards. The phrases of the confirmed windows that a shard has are compiled into an
   Aho-Corasick automaton, all of the shard's documents are streamed through it, and it locates every occurrence of the
   phrases. A window around a located anchor goes if all of the anchor's are confirmed, or it is by its 95 bits. A word is written
   as one of 65536 letters, so a phrase is eight letters, two longs. The automaton looks for a node's child in a list,
   so a letter is spelled as four signs of 16 each, different ones for each of the four places: no node has over 16
   children, and matches begin at words.

All data structures belong to a shard, whose documents are a bounded share of the corpus, or are tables. An anchor has
at most a row for each shard and ``ENTRIES`` windows after pre-aggregation; the windows of a hot one are dealt by their
hash into parts of about ``HOT`` occurrences, so that no task gathers them all. Two different windows would be taken for
one with a chance of about n^2 / 2^96 for n distinct candidates (10^12 candidates: 13 in a million that it happens once).

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, unchanged.

Cases: null and empty texts have no words; documents of under ``WINDOW`` words lose nothing. Repeated rows repeat their
windows, so they lose them. Kept words are joined by one blank; a text that loses nothing stays as it is. Extra columns
are carried along; where they have the names of result columns, ``remove_repeats`` drops them and ``strip_repeats``
keeps them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import map_pieces, pieces, utf8

WINDOW, PHRASE = 35, 8
#: Runs of PHRASE words in a window.
RUNS = WINDOW - PHRASE + 1
#: Shards for each partition of the input.
SHARDS = 3
#: Windows in one packed row at most, occurrences of an anchor whose windows are confirmed together, and windows that a shard holds before it hands them on.
ENTRIES, HOT, HELD = 512, 4096, 1 << 20

_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFTS, _PLACES = np.array([12, 8, 4, 0], np.uint16), np.array([0, 16, 32, 48], np.uint16)
#: A window: 95 bits, and the highest bit of x if it starts more than once.
_ENTRY = np.dtype([("w", "<u8"), ("x", "<u4")])
_MORE, _HASH = np.uint32(0x80000000), np.uint32(0x7FFFFFFF)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def letters(hashes: np.ndarray) -> np.ndarray:
    """One of 65536 letters for each word."""
    return (hashes >> np.uint64(32)).astype(np.uint16)


def spelled(letter: np.ndarray) -> str:
    """Four signs for each letter, for the automaton."""
    return (((letter[:, None] >> _SHIFTS) & np.uint16(15)) + _PLACES).astype(np.uint8).tobytes().decode("latin-1")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrase_keys(letter: np.ndarray) -> np.ndarray:
    """A 64-bit key of the phrase at each position."""
    x = letter.astype(np.uint64)
    n = len(x) - PHRASE + 1
    key = np.zeros(n, np.uint64)
    for i in range(PHRASE):
        key = key * _ODD + x[i : i + n] + np.uint64(1)
    return _mixed(key)


def anchors(keys: np.ndarray) -> np.ndarray:
    """The position of each window's anchor: the least by the keys' upper half, leftmost on ties."""
    low = np.uint64(0xFFFFFFFF)
    return (_sliding_least(keys & ~low | np.arange(len(keys), dtype=np.uint64), RUNS) & low).astype(np.int64)


class _Powers:
    """Powers of odd numbers and of their inverses modulo 2^64, as many as the longest document so far needs."""

    def __init__(self):
        self.tables = [np.ones(1, np.uint64)] * 4

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]))
            factors = [y for x in (_ODD, _ODD2) for y in (x, np.uint64(pow(int(x), -1, 1 << 64)))]
            self.tables = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x)))) for x in factors]
        return [t[:n] for t in self.tables]


_POWERS = _Powers()


def window_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits of hash of the words of each window, by differences of running sums of hash * power."""
    powers, n, out = _POWERS.upto(len(hashes)), len(hashes) - WINDOW + 1, []
    for up, down, x in ((powers[0], powers[1], hashes), (powers[2], powers[3], _mixed(hashes + _ODD2))):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up)))
        out.append(_mixed((sums[WINDOW:] - sums[:-WINDOW]) * down[:n]))
    return out[0], (out[1] >> np.uint64(33)).astype(np.uint32)


class Passages:
    """Confirmed windows, and the automaton of their phrases."""

    def __init__(self, codes: np.ndarray, whole: np.ndarray, entries: np.ndarray):
        """codes: rows of two longs, the eight letters of each phrase; whether all windows of each are confirmed; entries: the confirmed windows of the others."""
        order = np.lexsort((entries["x"], entries["w"]))
        self.w, self.x = entries["w"][order], entries["x"][order]
        self.automaton = None
        if len(codes):
            self.automaton = ahocorasick.Automaton()
            signs, marks = spelled(np.ascontiguousarray(codes).view(np.uint16).reshape(-1)), whole.tolist()
            for i, mark in enumerate(marks):
                self.automaton.add_word(signs[4 * PHRASE * i : 4 * PHRASE * (i + 1)], mark)
            self.automaton.make_automaton()

    def occurrences(self, hashes: np.ndarray) -> np.ndarray:
        """Starts of the windows whose anchor the automaton locates and which are confirmed."""
        none = np.zeros(0, np.int64)
        if self.automaton is None or len(hashes) < WINDOW:
            return none
        letter = letters(hashes)
        matches = list(self.automaton.iter(spelled(letter)))
        if not matches:
            return none
        ends, whole = np.array(matches).T
        located = np.zeros(len(letter), np.int8)
        located[ends // 4 - (PHRASE - 1)] = 1 + whole
        anchored = located[anchors(phrase_keys(letter))]
        known = anchored == 2
        at = np.flatnonzero(anchored == 1)
        if len(at):
            w, x = (h[at] for h in window_hashes(hashes))
            first = np.searchsorted(self.w, w)
            open_ = np.flatnonzero(first < len(self.w))
            while len(open_):  # a second round only where two windows have the same 64 bits
                open_ = open_[self.w[first[open_]] == w[open_]]
                same = self.x[first[open_]] == x[open_]
                known[at[open_[same]]] = True
                open_ = open_[~same]
                first[open_] += 1
                open_ = open_[first[open_] < len(self.w)]
        return np.flatnonzero(known)


def covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words lie in a window with one of the starts."""
    step = np.zeros(n + 1, np.int64)
    step[starts] += 1
    step[starts + WINDOW] -= 1
    return np.cumsum(step[:n]) > 0


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the anchors in each shard with their number, added up over a piece."""
    for batch in batches:
        found, shards = [], []
        for text, shard in zip(batch.column("text").to_pylist(), batch.column("shard").to_pylist(), strict=True):
            words = (text or b"").split()
            if len(words) < WINDOW:
                continue
            keys = phrase_keys(letters(word_hashes(words)))
            at = anchors(keys)
            found.append(keys[at[np.concatenate(([True], at[1:] != at[:-1]))]])
            shards.append(np.full(len(found[-1]), shard, np.int32))
        if not found:
            continue
        key, shard = np.concatenate(found), np.concatenate(shards)
        order = np.lexsort((shard, key))
        key, shard = key[order], shard[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))))
        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(shard[first]), pa.array(np.diff(np.append(first, len(key))))], ["key", "shard", "n"])


def _by_shard(batches: Iterator[pa.RecordBatch], start, each) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, those of kind 0 first. start(shard, rows of kind 0) gives a state; each(state, batch) yields for bounded slices of kind 1; a state's ``end`` follows."""
    shard, keys, state = None, [], None
    for batch in batches:
        s, k = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(s)], strict=True):
            if a == b:
                continue
            if s[a] != shard:
                if state is not None:
                    yield from state.end()
                shard, keys, state = int(s[a]), [], None
            part = batch.slice(a, b - a)
            if k[a] == 0:
                keys.append(part.drop_columns(["text"]))
            else:
                if state is None:
                    state, keys = start(shard, keys), []
                for piece in pieces(part):
                    yield from each(state, piece)
    if state is not None:
        yield from state.end()


def _numbers(keys: list[pa.RecordBatch], column: str, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([k.column(column).to_numpy() for k in keys]) if keys else np.zeros(0, kind)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A row for each stretch of ``values`` between neighbouring ends."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(((ends - ends[0]) * size).astype(np.int32).tobytes()), pa.py_buffer(values[ends[0] : ends[-1]].tobytes())])


class _Candidates:
    """Of one shard: the windows whose anchors recur in the corpus."""

    def __init__(self, shard: int, keys: list[pa.RecordBatch]):
        self.shard, self.held, self.flushed = shard, 0, False
        key, parts = _numbers(keys, "key").view(np.uint64), _numbers(keys, "parts")
        order = np.argsort(key)
        self.key, self.parts = key[order], parts[order].astype(np.uint64)
        self.found: list[tuple[np.ndarray, ...]] = []

    def each(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text in rows.column("text").to_pylist():
            words = (text or b"").split()
            if len(words) < WINDOW or not len(self.key):
                continue
            hashes = word_hashes(words)
            letter = letters(hashes)
            keys = phrase_keys(letter)
            at = anchors(keys)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            place = np.minimum(np.searchsorted(self.key, keys[at[first]]), len(self.key) - 1)
            size = np.diff(np.append(first, len(at)))
            hit = self.key[place] == keys[at[first]]
            window = np.flatnonzero(np.repeat(hit, size))
            if not len(window):
                continue
            w, x = window_hashes(hashes)
            code = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letter, PHRASE)[at[first[hit]]]).view(np.uint64).reshape(-1, 2)
            own = np.repeat(np.arange(int(hit.sum())), size[hit])
            parts = self.parts[place[hit]][own]
            self.found.append((code[own, 0], code[own, 1], w[window] % parts, w[window], x[window], parts == 1))
            self.held += len(window)
            if self.held > HELD:
                self.flushed = True
                yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        a, b, part, w, x, alone = (np.concatenate(c) for c in zip(*self.found, strict=True))
        self.found, self.held = [], 0
        order = np.lexsort((x, w, part, b, a))
        a, b, part, w, x, alone = (c[order] for c in (a, b, part, w, x, alone))
        group = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (part[1:] != part[:-1])))
        first = np.flatnonzero(group | np.concatenate(([True], (w[1:] != w[:-1]) | (x[1:] != x[:-1]))))
        entries = np.empty(len(first), _ENTRY)
        entries["w"], entries["x"] = w[first], x[first] | np.where(np.diff(np.append(first, len(w))) > 1, _MORE, np.uint32(0))
        heads = np.flatnonzero(group[first])
        rows = np.concatenate([np.arange(i, j, ENTRIES) for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(first)], strict=True)])
        at, single = first[rows], np.isin(rows, heads) & np.isin(np.append(rows, len(first))[1:], np.append(heads, len(first)))
        columns = [np.full(len(rows), self.shard, np.int32), a[at].view(np.int64), b[at].view(np.int64), part[at].astype(np.int32), single & alone[at] & (not self.flushed)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _binary(entries, np.append(rows, len(first)))], ["shard", "a", "b", "part", "alone", "entries"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _by_shard(batches, _Candidates, _Candidates.each)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor and part; of each row the windows that start at least twice in all of them, null if these are all that the anchor has in the shard (``alone``: the row has them all)."""

    def confirmed(rows: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        entries = np.frombuffer(b"".join(rows.column("entries").to_pylist()), _ENTRY)
        sizes = pc.binary_length(rows.column("entries")).to_numpy() // _ENTRY.itemsize
        row = np.repeat(np.arange(rows.num_rows), sizes)
        x, more = entries["x"] & _HASH, entries["x"] > _HASH
        order = np.lexsort((x, entries["w"], group[row]))
        g, w, x = group[row[order]], entries["w"][order], x[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (x[1:] != x[:-1])))
        twice = np.add.reduceat(1 + more[order].astype(np.int64), np.flatnonzero(new)) > 1
        keep = np.zeros(len(entries), bool)
        keep[order] = twice[np.cumsum(new) - 1]
        left = np.bincount(row[keep], minlength=rows.num_rows)
        some, whole = pa.array(left > 0), (left == sizes) & rows.column("alone").to_numpy(zero_copy_only=False)
        keep &= ~whole[row]
        kept = entries[keep]
        kept["x"] &= _HASH
        listed = _binary(kept, np.concatenate(([0], np.cumsum(np.where(whole, 0, left)))))
        columns = [*(rows.column(c) for c in ("shard", "a", "b")), pc.if_else(pa.array(whole), pa.scalar(None, pa.binary()), listed)]
        return pa.RecordBatch.from_arrays([c.filter(some) for c in columns], ["shard", "a", "b", "entries"])

    pending: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if pending is None else pa.concat_batches([pending, batch])
        change = np.zeros(rows.num_rows, bool)
        for c in ("a", "b", "part"):
            x = rows.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:  # the last anchor may go on
            yield confirmed(rows.slice(0, last), np.cumsum(change[:last]))
        pending = rows.slice(last)
    if pending is not None:
        yield confirmed(pending, np.zeros(pending.num_rows, np.int64))


def _shape(docs: DataFrame) -> tuple[int, int]:
    """Shards, and partitions that hold them."""
    inputs = max(docs.rdd.getNumPartitions(), 1)
    shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(SHARDS * inputs, shuffle), max(2 * inputs, shuffle)


def _deal(keys: DataFrame, texts: DataFrame, partitions: int) -> DataFrame:
    both = keys.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(partitions, "shard").sortWithinPartitions("shard", "kind")


def _removed(docs: DataFrame, digest: bool) -> DataFrame:
    """row (a struct of the columns but text), text (of the kept words; null with ``digest``), n_words, n_removed, kept_sha256 (with ``digest``)."""
    rest = [x for x in docs.columns if x != "text"]
    shards, partitions = _shape(docs)
    key = [F.col(f"`{x}`") for x in ("doc_id", "text") if x in docs.columns]
    source = docs.select(F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard"), F.struct(*[F.col(f"`{x}`") for x in rest]).alias("row"), utf8())
    texts = source.select("shard", "text")

    phrases = map_pieces(texts, _phrases, "key long, shard int, n long").groupBy("key", "shard").agg(F.sum("n").alias("n"))
    everywhere = phrases.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list("shard").alias("shards")).where("all > 1")  # a row has a number for each shard at most
    recurring = everywhere.select(F.explode("shards").alias("shard"), "key", F.ceil(F.col("all") / F.lit(HOT)).cast("long").alias("parts"))

    found = _deal(recurring, texts, partitions).mapInArrow(_candidates, "shard int, a long, b long, part int, alone boolean, entries binary")
    by_anchor = found.repartition(partitions, "a", "b", "part").sortWithinPartitions("a", "b", "part")
    confirmed = by_anchor.mapInArrow(_confirm, "shard int, a long, b long, entries binary")

    out = f"row {source.schema['row'].dataType.simpleString()}, text binary, n_words bigint, n_removed bigint, kept_sha256 string"
    return _deal(confirmed, source, partitions).mapInArrow(_remove(digest), out)


def _remove(digest: bool):
    class Shard(Passages):
        def __init__(self, shard: int, keys: list[pa.RecordBatch]):
            entries = [x for k in keys for x in k.column("entries").to_pylist()]
            codes, row = np.unique(np.stack((_numbers(keys, "a"), _numbers(keys, "b")), axis=1), axis=0, return_index=True)
            super().__init__(codes, np.array([entries[i] is None for i in row.tolist()], bool), np.frombuffer(b"".join(x for x in entries if x), _ENTRY))

        def end(self) -> Iterator[pa.RecordBatch]:
            return iter(())

    def each(state: Shard, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, sizes, removed, sha = [], [], [], []
        for text in rows.column("text").to_pylist():
            words = (text or b"").split()
            starts = state.occurrences(word_hashes(words)) if state.automaton is not None and len(words) >= WINDOW else ()
            kept = words
            if len(starts):
                gone = covered(len(words), starts)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            sizes.append(len(words))
            removed.append(len(words) - len(kept))
            out.append(None if digest else b" ".join(kept) if len(starts) else text)
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest() if digest else None)
        yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(out, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["row", "text", "n_words", "n_removed", "kept_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_shard(batches, Shard, each)

    return run


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """The columns of ``docs`` with the kept text; n_words, n_removed.

    With ``digest`` the text is replaced by kept_sha256, the SHA-256 of the kept words joined by one blank.
    """
    own = {"n_words", "n_removed"} | ({"kept_sha256"} if digest else set())
    names = [x for x in docs.columns if x.lower() not in own]
    done = _removed(docs.select(*[f"`{x}`" for x in names]), digest)
    columns = [F.col(f"row.`{x}`").alias(x) if x != "text" else F.col("text").cast("string").alias("text") for x in names if x != "text" or not digest]
    return done.select(*columns, *(["kept_sha256"] if digest else []), "n_words", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    return remove_repeats(docs.select("doc_id", "text"), digest=True)


def strip_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every row, its text without repeated passages; n_chars follows where a text changed."""
    done, text = _removed(docs, digest=False), F.col("text").cast("string")
    columns = {x: F.col(f"row.`{x}`") for x in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*[c.alias(x) for x, c in columns.items()])
