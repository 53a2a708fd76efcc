"""SentencePiece encoding and decoding with seeded merge-dropout.

The model is a byte-fallback BPE of the SentencePiece kind, read from its file; it isn't trained here. A text gets one
blank in front, blanks become the meta symbol, and symbols are merged by an agenda: the adjacent pair whose piece has
the best score, leftmost on ties, comes first. When a candidate comes off the agenda it is skipped if a hash of (seed,
variant, text, position of the part in the text, place, piece) falls under the dropout share: a skipped pair is lost
unless other merges make it anew. So every occurrence of a word is cut by a draw of its own. With share 0 the ids are
those of the SentencePiece library. Other seeds, and the variants that rows are dealt into, give other segmentations of
the same text; all decode to the same bytes.

Merges never pass from a word into the blanks after it, and no piece holds a line feed with other characters, so a text
is cut into chunks (blanks and the word after them; line feeds), and these further where no piece has their two
neighbouring characters side by side. The agendas of all parts of about ``AT_ONCE`` characters are worked off side by
side in arrays: each round takes the best candidate off every agenda, draws for it, and merges it or strikes it out. A
part of over ``SHORT`` characters has a heap of its own. Nothing is remembered from one text to the next, so time and
memory follow the characters alone; a text of more than ``AT_ONCE`` characters is cut at blanks and line feeds.

Lossless: characters outside the vocabulary, bytes that aren't UTF-8 and literal meta symbols become byte pieces.

Cases: null and empty texts have no ids and decode to the empty text. Equal texts in equal variants get equal ids. Very
long words go through their heap in n log n. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import PIECE_BYTES, map_pieces, pieces, utf8

#: Production parameters: share of merges dropped, seed, and variants that rows are dealt into by id.
DROPOUT, SEED, VARIANTS = 0.1, 20, 2
META = "▁"
#: Parts of up to this many characters are merged side by side, longer ones have a heap each.
SHORT = 64
#: Characters (or bytes of text) that are encoded at once.
AT_ONCE = 1 << 19

_NONE = np.int32(0x7FFFFFFF)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the 32k one of the public tokenizers that are installed."""
    if path is None:
        try:
            import public_tokenizers
        except ModuleNotFoundError as e:
            raise FileNotFoundError("no tokenizer is installed: give the path or the bytes of a SentencePiece model") from e

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class _Pairs:
    """Numbers by pairs of symbols: an open-addressed table that is asked for many pairs at once."""

    def __init__(self, numbers: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(numbers)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers = np.full(1 << bits, _EMPTY), np.full(1 << bits, _NONE)
        pairs = np.array(list(numbers), np.uint64).reshape(-1, 2)
        for at, key, n in zip(self._slots(keys := self._keys(pairs[:, 0], pairs[:, 1])).tolist(), keys, numbers.values(), strict=True):
            while self.keys[at] != _EMPTY:
                at = (at + 1) & self.last
            self.keys[at], self.numbers[at] = key, n

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _ODD >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' numbers, _NONE for those that have none. left, right: from 0."""
        keys = self._keys(left, right)
        at = self._slots(keys)
        there = self.keys[at]
        found = self.numbers[at]
        open_ = np.flatnonzero((there != keys) & (there != _EMPTY))
        found[there != keys] = _NONE
        while len(open_):
            at_open = (at[open_] + 1) & self.last
            at[open_] = at_open
            there = self.keys[at_open]
            hit = there == keys[open_]
            found[open_[hit]] = self.numbers[at_open[hit]]
            open_ = open_[~hit & (there != _EMPTY)]
        return found


class Vocabulary:
    """Pieces, their scores and bytes, from a SentencePiece model.

    A symbol is the number of a piece, or a number beyond them for a character that is only met within pieces.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte_ids, self.ids, self.raw = [0] * 256, {}, [b""] * n
        for i, name in enumerate(names):
            if sp.is_byte(i):
                value = int(name[3:5], 16)
                byte_ids[value], self.raw[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[name], self.raw[i] = i, name.replace(META, " ").encode()
        if any(META in x.lstrip(META) or ("\n" in x and len(x) > 1) for x in self.ids):
            raise ValueError("pieces that pass a word's end aren't supported")
        self.byte_ids = np.array(byte_ids, np.int32)
        #: Better scores have lower ranks.
        order = sorted(self.ids, key=lambda x: (-sp.get_score(self.ids[x]), self.ids[x]))
        self.ranks = {name: k for k, name in enumerate(order)}
        if len(order) >= 1 << 23:
            raise ValueError("vocabularies of over eight million pieces aren't supported")
        self.by_rank = np.array([self.ids[x] for x in order], np.int32)
        symbols = dict(self.ids)
        for c in sorted({c for x in self.ids for c in x}):
            symbols.setdefault(c, n + len(symbols) - len(self.ids))
        self.symbols = symbols
        #: Symbol by code point; blanks stand for the meta symbol, and a literal one is outside the vocabulary.
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.of_char[ord(" ")], self.of_char[ord(META)] = self.of_char[ord(META)], -1
        merges = {(symbols[x[:i]], symbols[x[i:]]): self.ranks[x] for x in self.ids for i in range(1, len(x)) if x[:i] in symbols and x[i:] in symbols}
        self.merges = _Pairs(merges)
        #: Characters that stand side by side in some piece.
        self.neighbours = _Pairs({(symbols[a], symbols[b]): 1 for a, b in {x[i : i + 2] for x in self.ids for i in range(len(x) - 1)}})
        self.blob = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(x) for x in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size


def _candidates(places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return places.astype(np.uint32) * np.uint32(0x9E3779B1) ^ ranks.astype(np.uint32) * np.uint32(0x85EBCA6B)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.limit, self.seed = vocabulary, int(dropout * 2**32), seed

    def skipped(self, key: int, place: int, rank: int) -> bool:
        """Whether the dropout takes the candidate whose left symbol begins at ``place``."""
        x = key & 0xFFFFFFFF ^ (place * 0x9E3779B1 ^ rank * 0x85EBCA6B) & 0xFFFFFFFF
        x = (x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return x ^ x >> 15 < self.limit

    def skips(self, keys: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """``skipped`` of many candidates."""
        x = keys ^ _candidates(places, ranks)
        x = (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        return (x ^ x >> np.uint32(15)).astype(np.int64) < self.limit

    def text_key(self, text: bytes, variant: int) -> int:
        return xxhash.xxh64_intdigest(text, (self.seed << 32 | variant) & 0xFFFFFFFFFFFFFFFF)

    @staticmethod
    def part_keys(text_keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The keys of parts by their texts' keys and their numbers (from 0) in these."""
        x = (numbers + 1).astype(np.uint64) * _ODD + text_keys
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)).astype(np.uint32)

    def merge(self, part: str, key: int) -> list[str]:
        """The agenda of one part as a heap: its pieces."""
        symbols: list[str | None] = [META if c == " " else c for c in part]
        n, ranks, limit = len(symbols), self.v.ranks, self.limit
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(ranks[a + b], i, i + 1, 2) for i, (a, b) in enumerate(pairwise(symbols)) if a + b in ranks]
        heapq.heapify(agenda)
        while agenda:
            rank, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j] if after[i] == j else None
            if left is None or right is None or len(left) + len(right) != size or (limit and self.skipped(key, i, rank)):
                continue
            piece = symbols[i] = left + right
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := ranks.get(piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (found, i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0 and (found := ranks.get(symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (found, h, i, size + len(symbols[h])))
        return [s for s in symbols if s is not None]

    def merge_all(self, symbols: np.ndarray, first: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Work the agendas of all parts off, side by side. symbols: of all characters, changed to those of pieces at the pieces' first characters; first, size: the parts, which don't overlap. Whether a piece begins at each character."""
        v, n = self.v, len(symbols)
        begins = np.ones(n, bool)
        if not len(first):
            return begins
        offsets = np.cumsum(size) - size
        place = (np.arange(int(size.sum())) - np.repeat(offsets, size)).astype(np.int32)
        at = np.repeat(first, size) + place
        ends = first + size
        inner = np.flatnonzero(np.append(place[1:] > 0, False))  # characters with a next one in their part
        # An agenda is its part's stretch of ranks, each with its place: the least is the best, leftmost on ties.
        agenda = np.full(len(at), _NONE)
        rank = v.merges.get(symbols[at[inner]], symbols[at[inner] + 1])
        agenda[inner] = np.where(rank == _NONE, _NONE, rank << 8 | place[inner])
        after, before = np.ones(n, np.int32), np.ones(n, np.int32)  # steps to the neighbouring pieces
        before[first] = 0
        while len(offsets):
            best = np.minimum.reduceat(agenda, offsets)
            going = np.flatnonzero(best != _NONE)
            if not len(going):
                break
            if len(going) < 0.8 * len(best):  # finished parts go
                stay = best != _NONE
                agenda = agenda[np.repeat(stay, size)]
                first, ends, size, keys, best = first[going], ends[going], size[going], keys[going], best[going]
                offsets = np.cumsum(size) - size
                going = np.arange(len(first))
            best = best[going]
            places, ranks, base = best & 255, best >> 8, offsets[going]
            agenda[base + places] = _NONE
            if self.limit:
                kept = np.flatnonzero(~self.skips(keys[going], places, ranks))
                going, places, ranks, base = going[kept], places[kept], ranks[kept], base[kept]
            left = first[going] + places
            step = after[left]
            right = left + step
            agenda[base + places + step] = _NONE
            begins[right] = False
            symbols[left] = v.by_rank[ranks]
            step = step + after[right]
            after[left] = step
            next_, back = left + step, before[left]
            a, b = np.flatnonzero(next_ < ends[going]), np.flatnonzero(back > 0)
            before[next_[a]] = step[a]
            rank = v.merges.get(symbols[np.concatenate((left[a], left[b] - back[b]))], symbols[np.concatenate((next_[a], left[b]))])
            where = np.concatenate((places[a], places[b] - back[b]))
            agenda[np.concatenate((base[a], base[b])) + where] = np.where(rank == _NONE, _NONE, rank << 8 | where)
        return begins

    def encode_parts(self, text: str, starts: np.ndarray, text_keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of texts that stand one after the other, cut at ``starts``: ids, how many belong to each start, and the parts of each. numbers: of the first part of each."""
        v = self.v
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = v.of_char[c]
        feed, blank = c == 10, c == 32
        cut = np.empty(len(c), bool)
        cut[0] = True
        cut[1:] = feed[1:] | feed[:-1] | (blank[1:] & ~blank[:-1]) | (symbols[1:] < 0) | (symbols[:-1] < 0)
        whole = np.flatnonzero(~cut)
        cut[whole] = v.neighbours.get(symbols[whole - 1], symbols[whole]) == _NONE
        cut[starts] = True
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(c)))
        owner = np.searchsorted(starts, first, "right") - 1
        parts = np.bincount(owner, minlength=len(starts))
        keys = self.part_keys(text_keys[owner], np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts) + numbers[owner])
        chosen = np.flatnonzero((size > 1) & (size <= SHORT))
        begins = self.merge_all(symbols, first[chosen], size[chosen], keys[chosen])
        for k in np.flatnonzero(size > SHORT).tolist():
            a, b = int(first[k]), int(first[k] + size[k])
            begins[a:b] = False
            for piece in self.merge(text[a:b], int(keys[k])):
                begins[a], symbols[a] = True, v.symbols[piece]
                a += len(piece)
        at = np.flatnonzero(begins)
        ids, widths = symbols[at], np.ones(len(at), np.int64)
        bare = np.flatnonzero((ids < 0) | (ids >= v.size))  # single characters without a piece
        if len(bare):
            x = c[at[bare]].astype(np.int64)
            raw = np.where((x >= 0xDC80) & (x <= 0xDCFF), x - 0xDC00, -1)  # a byte that isn't UTF-8
            n = 1 + (x > 0x7F) + (x > 0x7FF) + (x > 0xFFFF)
            n[raw >= 0] = 1
            widths[bare] = n
            ids = np.repeat(ids, widths)
            begin = (np.cumsum(widths) - widths)[bare]
            for k in range(4):
                own = np.flatnonzero(n > k)
                y, m = x[own], n[own]
                tail = 0x80 | (y >> (6 * np.maximum(m - 1 - k, 0)) & 0x3F)
                head = np.where(m == 1, y, (0xF00 >> m & 0xFF) | y >> (6 * (m - 1)))
                ids[begin[own] + k] = v.byte_ids[np.where(raw[own] >= 0, raw[own], head if k == 0 else tail)]
        return ids, np.bincount(np.searchsorted(starts, at, "right") - 1, widths, len(starts)).astype(np.int64), parts

    def encode(self, text: bytes, variant: int = 0) -> np.ndarray:
        """The ids of a text."""
        return self.encode_all([text], [variant])[0]

    def encode_all(self, texts: list[bytes], variants: list[int]) -> list[np.ndarray]:
        """The ids of each text; a text's ids don't depend on the others."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        own: list[int] = []
        strings: list[str] = []
        keys: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if own:
                starts = np.cumsum([0, *map(len, strings[:-1])])
                ids, sizes, _ = self.encode_parts("".join(strings), starts, np.array(keys, np.uint64), np.zeros(len(own), np.int64))
                for i, part in zip(own, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    out[i] = part
                own.clear()
                strings.clear()
                keys.clear()
            held = 0

        for i, (text, variant) in enumerate(zip(texts, variants, strict=True)):
            if not text:
                continue
            key, string = self.text_key(text, variant), " " + text.decode("utf-8", "surrogateescape")
            if len(string) > AT_ONCE:
                found, number = [], np.zeros(1, np.int64)
                for part in _slices(string, AT_ONCE):
                    ids, _, parts = self.encode_parts(part, np.zeros(1, np.int64), np.array([key], np.uint64), number)
                    found.append(ids)
                    number = number + parts
                out[i] = np.concatenate(found)
                continue
            if held + len(string) > AT_ONCE:
                flush()
            own.append(i)
            strings.append(string)
            keys.append(key)
            held += len(string)
        flush()
        return out


def _slices(text: str, most: int) -> Iterator[str]:
    """The text in slices of about ``most`` characters, cut before blanks and line feeds where no merge passes."""
    at = 0
    while at < len(text):
        to = at + most
        while to < len(text) and not (text[to] == "\n" or (text[to] == " " and text[to - 1] != " ")):
            to += 1
        yield text[at:to]
        at = to


_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(model: bytes, dropout: float, seed: int) -> Encoder:
    """The worker's encoder of these parameters; one is kept. It holds the vocabulary's tables (about 20 MB), nothing of the texts."""
    key = (hashlib.sha256(model).digest(), dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(model), dropout, seed)
    return _ENCODERS[key]


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> bytes:
    """The text's bytes: those of the pieces, without the blank in front."""
    v, out = vocabulary, []
    for at in range(0, len(ids), AT_ONCE):
        part = ids[at : at + AT_ONCE]
        size = v.raw_size[part]
        out.append(v.blob[np.arange(int(size.sum())) + np.repeat(v.raw_start[part] - (np.cumsum(size) - size), size)].tobytes())
    return b"".join(out)[1:]


def encode_texts(docs: DataFrame, model: bytes | None = None, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """The columns of ``docs`` but text; variant, ids, n_tokens, decoded_sha256 and lossless, of a decoding of the ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model_bytes() if model is None else model)
    own = ("text", "variant", "ids", "n_tokens", "decoded_sha256", "lossless")
    variant = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(variants)).cast("int")
    kept = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in own], variant.alias("variant"), utf8())
    rest = [f for f in kept.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, dropout, seed)
        vocabulary = encoder.v
        for batch in batches:
            for part in pieces(batch, most=4 * AT_ONCE):
                texts = [x or b"" for x in part.column("text").to_pylist()]
                ids = encoder.encode_all(texts, part.column("variant").to_pylist())
                sha, same = [], []
                for text, own in zip(texts, ids, strict=True):
                    back = decode(own, vocabulary)
                    sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), lists, pa.array(sizes), pa.array(sha), pa.array(same)], [*(f.name for f in rest), "ids", "n_tokens", "decoded_sha256", "lossless"])

    return map_pieces(kept, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ids array<int>, n_tokens bigint, decoded_sha256 string, lossless boolean"]))


def decode_ids(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """The columns of ``encoded`` but ids, and text, decoded from the ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes() if model is None else model)
    kept = encoded.select(*[F.col(f"`{x}`") for x in encoded.columns if x.lower() not in ("text", "ids")], F.col("ids").cast("array<int>").alias("ids"))
    rest = [f for f in kept.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(shared.value, 0.0, 0).v
        for batch in batches:
            for part in pieces(batch, "ids", PIECE_BYTES):
                texts = [None if x is None else decode(x.values.to_numpy(), vocabulary).decode("utf-8", "replace") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(texts, pa.string())], [*(f.name for f in rest), "text"])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "text string"]))


def tokenize(docs: DataFrame) -> DataFrame:
    """doc_id, variant, ids, n_tokens, decoded_sha256, lossless for every row."""
    return encode_texts(docs.select("doc_id", "text"))
