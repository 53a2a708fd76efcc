"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: 4-word shingles of the ASCII-lower-cased text, repeats included, each hashed with XXH64 (seed 42); a bit
is set if over half of the hashes have it. A text of fewer words is one shingle; one without words has fingerprint 0.

Links: equal fingerprints are one node. Distinct ones are dealt into tables: the 64 bits are cut into ``BLOCKS``
blocks, and for every choice of ``BLOCKS - radius`` of them there is a table keyed by those blocks' bits. Two
fingerprints within the radius differ in at most ``radius`` blocks, so they share a bucket of some table, whatever the
data: nothing is missed. Inside a bucket the members' bits are stored as vertical planes (one big integer for each bit
position, one bit for each member), a member is compared with all others at once by carry-save counters over the
planes, and the comparison stops once every distance exceeds the radius. A bucket gives a spanning forest of its links,
not all pairs, found by breadth-first search in which every member is queried once, against members not yet reached.
Buckets of over ``BUCKET`` members are known before anything is dealt: they go out as pairs of parts, so that no task
gets more than two parts of one. Their list has at most a row for every ``BUCKET`` rows of the tables.

``keep_first``, the pipeline's stage, links by similarity instead: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. 64 bits can't tell that apart, so it takes ``BITS`` bits of each shingle, one bit each of the
text where over half of its distinct shingles have it. Texts of similarity s and equal size differ in a share of
arccos(2s / (1 + s)) / pi of them on average: 0.8 stands for 38.8 of 256 bits, with a deviation of 5.7, and the radius
``WIDE`` lies three deviations beyond. No choice of bits covers such a radius: tables keyed by drawn bits would have to
grow in number as n^0.23, each with a row for every text. The blocks that are compared come from the shingles' hashes
instead: a table's key is the least hash in each of ``DRAWN`` orders, which two texts of similarity s share with a
probability of s^3; with ``TABLES`` tables a pair at 0.8 never meets in 0.7 % of the cases, however many texts there are.
A bucket of over ``BUCKET`` texts falls apart by ``FINER`` further keys of two orders each (1.7 %), and what is still
larger goes out as pairs of parts.

In a bucket the fingerprints are compared by vertical planes, pairs of two side by side, larger ones by one member
against all others, in ``SHELLS`` of growing radius: each shell joins what the ones before have left apart. So a bucket
gives a spanning forest of its links within the radius, near ones first, and each text's ``NEAREST`` ones outside the
group that the first shell gives it, never all pairs. Every link is then checked
exactly, by the sets of shingles of its two texts, a text with many links being sent to several tasks; only links of 0.8 or
more count. Checks go in rounds: first each text's nearest link; then, of the links that are left between different
classes of good ones, the nearest for each pair of classes, and four times as many with each round, until no more are left
than have been checked; these are checked together. Each round contracts its own good links alone, between the classes
that the ones before have made.
What the forest and ``NEAREST`` have passed over is made up for: the buckets whose texts are still in different classes
are searched again, for each text's ``APART`` nearest in other classes, and eight times as many with each round, until no
text has more. In the end every pair within the radius that shares a bucket is in one class or has been checked.

Classes: the forests' links are contracted by alternating large-star and small-star steps, in DataFrame joins and
aggregates with a written table for each round.

Rows get their class by their fingerprint. Fingerprints of over ``HOT`` rows (at most one for every ``HOT`` rows of the
input) are broadcast, so that their rows stay where they are; all others are joined.

Cases: null and empty texts have fingerprint 0 and are linked like any other. Rows with equal texts, and repeated ids,
get a row each; the class id is the smallest doc_id of the class, null ids counting as largest. An empty table gives an
empty result. Extra columns are ignored. ``keep_first`` decides by row: see there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulesift.llm.common import discard, free_names, map_pieces, materialize, utf8

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Blocks of the fingerprint beyond the radius, and distinct fingerprints from which there is one more: smaller buckets, more tables.
BLOCKS, MANY = 2, 1 << 27
#: Rows from which a fingerprint's class is broadcast.
HOT = 100_000
#: Members of a bucket that are compared in one task with at most as many others.
BUCKET = 4096
#: Shingles hashed and counted at once.
SLICE = 1 << 16
#: The stage: words of a shingle, similarity that it looks for, bits of a fingerprint and radius.
STAGE_SHINGLE, SIMILARITY, BITS, WIDE = 5, 0.8, 256, 56
#: Its tables, orders that key one, and further keys, of two orders each, of the texts in large buckets.
TABLES, DRAWN, FINER = 7, 3, 4
#: Radii within which a bucket's texts are joined one after the other (the first one makes its groups), and links of one text that are checked in one task.
SHELLS, LINKS = (26, 36, 46, WIDE), 1024
#: Members of other groups that a bucket's texts are linked with, besides the forest.
NEAREST = 8
#: Members of other classes that a bucket's texts are linked with, in the first round after the forests' links are checked.
APART = 64
#: Planes from one look at who is still within the radius to the next, where they are many.
PAUSE = 8
#: Large buckets that are listed to all tasks; more of them are joined.
LISTED = 1 << 20

#: Factors that put shingle hashes into other orders.
_ORDERS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, TABLES * DRAWN + 2 * FINER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, repeats included, in slices; nothing for a text without words."""
    words = text.lower().split()
    if not words:
        return
    line, n = b" ".join(words), len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(size + 1) - size - 1
    first = starts[: max(n - width + 1, 1)]
    last = (starts + size)[min(width, n) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), SLICE):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + SLICE].tolist(), last[at : at + SLICE].tolist(), strict=True)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in _shingles(text, SHINGLE):
        ones += _ones(h)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def shingle_hashes(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    parts = list(_shingles(text, STAGE_SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """BITS bits of the set of shingles, as uint64."""
    out = np.zeros(BITS // 64, np.uint64)
    for k in range(len(out) if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), SLICE):
            ones += _ones(_stirred(hashes[at : at + SLICE] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        out[k] = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")
    return out


def table_keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's key in each table, and its further keys; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.array([(hashes * x).min() for x in _ORDERS])

    def joined(parts: np.ndarray) -> np.ndarray:
        keys = np.arange(len(parts), dtype=np.uint64)
        for column in parts.T:
            keys = _stirred(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return keys.view(np.int64)

    return joined(least[: TABLES * DRAWN].reshape(TABLES, DRAWN)), joined(least[TABLES * DRAWN :].reshape(FINER, 2))


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp (long, the fingerprint's 64 bits) for every row, beside the other columns but text."""
    kept = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in ("text", "fp")], utf8())
    rest = [f for f in kept.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"") for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(fps)], [*(f.name for f in rest), "fp"])

    return map_pieces(kept, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "fp long"]))


def _masks(radius: int, blocks: int) -> list[int]:
    """The bits that key each table."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Planes:
    """The members' bits, one big integer for each bit position; member i is bit i of each."""

    def __init__(self, members: np.ndarray):
        """members: a uint64 each, or a row of them."""
        self.n = len(members)
        bits = np.unpackbits(np.ascontiguousarray(members, np.uint64).view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little")
        packed = np.packbits(bits, axis=0, bitorder="little")
        self.planes = [int.from_bytes(packed[:, b].tobytes(), "little") for b in range(bits.shape[1])]

    def near(self, query: int, radius: int, among: int) -> int:
        """The members of the bit set ``among`` within the radius of ``query``, as a bit set.

        Distances are kept as bit-sliced counters that carry-save adders update. They start so that a distance over the
        radius carries out of them; such members drop out, and the block is abandoned once none is left.
        """
        top = radius.bit_length()
        start = (1 << top) - 1 - radius
        counters = [among if start >> k & 1 else 0 for k in range(top)]
        over, alive, pause = 0, among, 1 if len(self.planes) == 64 else PAUSE
        for b, plane in enumerate(self.planes):
            carry = (plane ^ among if query >> b & 1 else plane) & alive
            for k, c in enumerate(counters):
                if not carry:
                    break
                counters[k], carry = c ^ carry, c & carry
            over |= carry
            if b >= radius and b % pause == pause - 1:
                alive &= ~over
                if not alive:
                    return 0
        return alive & ~over


def near_pairs(x: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of uint64 have at most ``radius`` bits set: the planes of all rows, counted side by side in blocks that are abandoned once all exceed it."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1)
    lanes = -(-len(x) // 64)
    planes = np.zeros((bits.shape[1], lanes * 8), np.uint8)
    planes[:, : -(-len(x) // 8)] = np.packbits(bits.T, axis=1)
    planes = planes.view(np.uint64)
    top = radius.bit_length()
    start = (1 << top) - 1 - radius
    over, going = np.zeros(lanes, np.uint64), np.arange(lanes)
    full = ~np.uint64(0)
    counters = [np.full(lanes, full if start >> k & 1 else 0, np.uint64) for k in range(top)]
    for b in range(len(planes)):
        carry = planes[b, going]
        for k in range(top):
            carry, counters[k] = counters[k] & carry, counters[k] ^ carry
        over[going] |= carry
        if b % PAUSE == PAUSE - 1 and b >= radius:
            left = np.flatnonzero(over[going] != full)
            if len(left) < 0.7 * len(going):
                going, counters = going[left], [c[left] for c in counters]
                if not len(going):
                    break
    return np.unpackbits(over.view(np.uint8))[: len(x)] == 0


def spanning_links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius, as places in ``members``."""
    planes, found = Planes(members), []
    values = [int.from_bytes(m.tobytes(), "little") for m in np.ascontiguousarray(members, np.uint64)]
    unreached = (1 << planes.n) - 1
    while unreached:
        low = unreached & -unreached
        unreached ^= low
        frontier = [low.bit_length() - 1]
        while frontier and unreached:
            at = frontier.pop()
            near = planes.near(values[at], radius, unreached)
            unreached &= ~near
            while near:
                low = near & -near
                near ^= low
                found.append((at, low.bit_length() - 1))
                frontier.append(low.bit_length() - 1)
    return found


def _buckets(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[dict, np.ndarray]]:
    """Columns of rows that come by their keys, and the bounds of whole buckets in them."""
    pending = None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if pending is not None:
            rows = {c: np.concatenate((pending[c], x)) for c, x in rows.items()}
        change = np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in keys], axis=0)) + 1
        if len(change):
            yield rows, np.concatenate(([0], change))
        pending = {c: x[change[-1] if len(change) else 0 :] for c, x in rows.items()}
    if pending is not None and len(pending[keys[0]]):
        yield pending, np.array([0, len(pending[keys[0]])])


def _linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _dealt(keyed: DataFrame, keys: list[str], node: str, bucket: int) -> DataFrame:
    """``keyed`` with i, j: a large bucket falls into parts, and each pair of parts is searched by itself; rows come by keys, i, j and node."""
    large = keyed.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(bucket)).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64(node), parts).cast("int")
    dealt = keyed.join(large, keys, "left").select(*keyed.columns, parts.alias("parts"), own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.where((F.col("own") != F.col("other")) | (F.col("parts") == 1)).select(*keyed.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", node)


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints ``nodes.fp`` that span every class of the radius. blocks: by the number of fingerprints, if none is given."""
    if blocks is None:
        blocks = radius + BLOCKS + int(nodes.count() > MANY)
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(radius, blocks)])
    keyed = nodes.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in _buckets(batches, ("t", "key", "i", "j")):
            fp = rows["fp"].view(np.uint64)
            found = [(fp[a + x], fp[a + y]) for a, b in pairwise(ends.tolist()) if b - a > 1 for x, y in spanning_links(fp[a:b], radius)]
            if found:
                yield _linked(*np.array(found, np.uint64).view(np.int64).T)

    return _dealt(keyed, ["t", "key"], "fp", bucket).mapInArrow(run, "a long, b long").distinct()


def near_links(members: np.ndarray, shells: tuple[int, ...]) -> list[tuple[int, int]]:
    """Pairs within the last radius, as places in ``members``: a spanning forest, in which each shell joins what those before have left apart, and each member's ``NEAREST`` beyond the first shell."""
    planes = Planes(members)
    values = [int.from_bytes(m.tobytes(), "little") for m in np.ascontiguousarray(members, np.uint64)]
    groups, of, found = {i: 1 << i for i in range(planes.n)}, list(range(planes.n)), []

    def places(mask: int) -> Iterator[int]:
        while mask:
            low = mask & -mask
            mask ^= low
            yield low.bit_length() - 1

    for shell, radius in enumerate(shells):
        if len(groups) == 1:
            break
        if shell == 1:
            for at in range(planes.n):
                if near := planes.near(values[at], shells[-1], (1 << planes.n) - 1 & ~groups[of[at]]):
                    others = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(-(-planes.n // 8), "little"), np.uint8), bitorder="little"))
                    bits = np.bitwise_count(members[others] ^ members[at]).sum(axis=1)
                    found += [(at, x) for x in others[np.argsort(bits, kind="stable")[:NEAREST]].tolist()]
        unreached = (1 << planes.n) - 1
        for start in list(groups):
            if start not in groups or not unreached >> start & 1:
                continue
            whole = groups[start]
            unreached &= ~whole
            frontier = list(places(whole))
            while frontier and unreached:
                at = frontier.pop()
                near = planes.near(values[at], radius, unreached)
                while near:
                    other = (near & -near).bit_length() - 1
                    found.append((at, other))
                    new = groups.pop(of[other])
                    near, unreached, whole = near & ~new, unreached & ~new, whole | new
                    frontier += places(new)
            groups[start] = whole
            for i in places(whole):
                of[i] = start
    return found


def apart_links(members: np.ndarray, classes: np.ndarray, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For each member, as places in ``members``: it, its ``most`` nearest within the radius that have another class, and whether there are more."""
    planes, of = Planes(members), np.unique(classes, return_inverse=True)[1].tolist()
    masks: dict[int, int] = {}
    for i, c in enumerate(of):
        masks[c] = masks.get(c, 0) | 1 << i
    for at, m in enumerate(np.ascontiguousarray(members, np.uint64)):
        if near := planes.near(int.from_bytes(m.tobytes(), "little"), radius, (1 << planes.n) - 1 & ~masks[of[at]]):
            others = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(-(-planes.n // 8), "little"), np.uint8), bitorder="little"))
            bits = np.bitwise_count(members[others] ^ m).sum(axis=1)
            nearest = others[np.argsort(bits, kind="stable")[:most]]
            yield np.full(len(nearest), at), nearest, len(others) > most


def similar_links(nodes: DataFrame, radius: int = WIDE, bucket: int = BUCKET, *, most: int | None = None) -> DataFrame:
    """a, b (the smaller id first) and bits: links between ``nodes`` (id, w0, w1, ...: a wide fingerprint, keys, finer) that some table has brought together.

    With ``most``, ``nodes`` have a column root: the links are those of each text with its ``most`` nearest of other roots,
    and a column more tells whether one of the two has further ones.
    """
    words, shells = [f"w{k}" for k in range(BITS // 64)], tuple(x for x in SHELLS if x < radius) + (radius,)
    if most:
        words.append("root")
    rows = nodes.select("id", *words, "finer", F.explode("keys").alias("key"))
    if most:
        mixed = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        rows = rows.join(mixed, "key", "left_semi")
    large = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key", F.lit(True).alias("large")), "simhash-large")
    n = large.count()
    marked = rows.join(F.broadcast(large) if n <= LISTED else large, "key", "left") if n else rows.withColumn("large", F.lit(None).cast("boolean"))
    plain = marked.where("large IS NULL").select("key", "id", *words).repartition("key").sortWithinPartitions("key", "id")
    finer = marked.where("large").select(F.explode(F.transform("finer", lambda x: F.xxhash64("key", x))).alias("key"), "id", *words)

    def linked(columns: dict, fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        ids = columns["id"]
        return pa.RecordBatch.from_arrays([*map(pa.array, (np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1).astype(np.int32)))], ["a", "b", "bits"])

    def again(keys: tuple[str, ...]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns, ends in _buckets(batches, keys):
                fp = np.stack([columns[w] for w in words[:-1]], axis=1).view(np.uint64)
                found, size = [], 0
                for a, b in pairwise(ends.tolist()):
                    if (columns["root"][a:b] == columns["root"][a]).all():
                        continue
                    for i, j, more in apart_links(fp[a:b], columns["root"][a:b], radius, most):
                        found.append((i + a, j + a, np.full(len(i), more)))
                        size += len(i)
                        if size > SLICE:
                            x, y, z = map(np.concatenate, zip(*found, strict=True))
                            yield linked(columns, fp, x, y).append_column("more", pa.array(z))
                            found, size = [], 0
                if found:
                    x, y, z = map(np.concatenate, zip(*found, strict=True))
                    yield linked(columns, fp, x, y).append_column("more", pa.array(z))

        return work

    def run(keys: tuple[str, ...]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns, ends in _buckets(batches, keys):
                sizes, fp = np.diff(ends), np.stack([columns[w] for w in words], axis=1).view(np.uint64)
                two = ends[:-1][sizes == 2]
                near = np.concatenate([near_pairs(fp[two[i : i + SLICE]] ^ fp[two[i : i + SLICE] + 1], radius) for i in range(0, len(two), SLICE)]) if len(two) else np.zeros(0, bool)
                one, other = [two[near]], [two[near] + 1]
                for a, b in zip(ends[:-1][sizes > 2].tolist(), ends[1:][sizes > 2].tolist(), strict=True):
                    if found := near_links(fp[a:b], shells):
                        pairs = np.array(found) + a
                        one.append(pairs[:, 0])
                        other.append(pairs[:, 1])
                i, j = np.concatenate(one), np.concatenate(other)
                if len(i):
                    yield linked(columns, fp, i, j)

        return work

    search, kinds = (again, "a long, b long, bits int, more boolean") if most else (run, "a long, b long, bits int")
    out = plain.mapInArrow(search(("key",)), kinds)
    if n:
        out = out.unionByName(_dealt(finer, ["key"], "id", bucket).mapInArrow(search(("key", "i", "j")), kinds))
    return out.groupBy("a", "b", "bits").agg(F.max("more").alias("more")) if most else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each class that ``edges`` (a, b) joins; isolated nodes are absent.

    Alternating large-star and small-star steps: every round hooks nodes to the smallest neighbour, and the longest
    path shrinks by a constant factor. Each round is a few shuffles over links alone; it ends when every link leads to
    the smallest node of its class, for links that do from the start before the first round.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    while True:
        # stars: no node with a link to a smaller one has a second link
        seen = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if seen.groupBy("x").agg(F.max("up").alias("up"), F.count("*").alias("n")).where("up = 1 AND n > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: the larger neighbours of a node go to the smallest of it and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        discard(last)


def between(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` (a, b, bits) between different classes of ``roots`` (node, root), with the classes x and y."""
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return links.where("root_a <> root_b").select("a", "b", "bits", F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y"))


def merged(roots: DataFrame, good: DataFrame) -> DataFrame:
    """``roots`` (node, root) after the links ``good`` (x, y) between roots and nodes without a class have joined them.

    Only the new links are contracted; the nodes of a class follow its root.
    """
    heads = components(good.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = roots.join(heads.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(moved.unionByName(heads), "simhash-roots")


def good_classes(met: DataFrame, sets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """node and root of the classes ``roots`` (none: every node by itself) after those of the links ``met`` (a, b, bits) have joined them whose texts' sets are similar enough.

    A link is checked unless the good ones have joined its ends before. Once no more links are left than have been
    checked, all of them are: that costs at most as much again, and saves the rounds for a few links each.
    """
    if roots is None:
        left = met.select("a", "b", "bits", F.col("a").alias("x"), F.col("b").alias("y"))
        roots = met.where(F.lit(False)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        left = materialize(between(met, roots), "simhash-left")
    n, checked, most = left.count(), 0, 1
    while n:
        if n <= checked:
            tested = left
        elif not checked:
            ends = left.select("*", F.col("a").alias("end")).unionByName(left.select("*", F.col("b").alias("end")))
            tested = materialize(ends.groupBy("end").agg(F.min(F.struct("bits", "a", "b", "x", "y")).alias("best")).select("best.*").distinct(), "simhash-tested")
        else:
            nearest = F.row_number().over(Window.partitionBy("x", "y").orderBy("bits", "a", "b"))
            tested, most = materialize(left.withColumn("place", nearest).where(F.col("place") <= most).drop("place"), "simhash-tested"), 4 * most
        good = materialize(tested.select("a", "b", "x", "y").join(alike(tested.select("a", "b"), sets), ["a", "b"]).select("x", "y").distinct(), "simhash-good")
        if not good.isEmpty():
            last, roots = roots, merged(roots, good)
            discard(last)
        discard(good)
        if n <= checked:
            break
        checked += tested.count()
        last, left = left, materialize(between(left.select("a", "b", "bits").join(tested.select("a", "b"), ["a", "b"], "left_anti"), roots), "simhash-left")
        n = left.count()
        discard(last, tested)
    discard(left)
    return roots


def similar_classes(nodes: DataFrame, met: DataFrame, sets: DataFrame) -> DataFrame:
    """node and root of the classes of ``nodes`` (as ``similar_links`` takes them) by all pairs within the radius that share a bucket.

    met: the first links, in which every text with such a pair has one, and sets: the sets of their ends. The links that
    they have left out are looked for between different classes alone: copies are not expanded into pairs.
    """
    roots = good_classes(met, sets)
    own = nodes.select("id", *[f"w{k}" for k in range(BITS // 64)], "keys", "finer").join(sets.select("id"), "id", "left_semi")
    done, most = met.select("a", "b"), APART
    while True:
        labelled = own.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        more = materialize(similar_links(labelled, most=most), "simhash-more")
        fresh = materialize(more.join(done, ["a", "b"], "left_anti").select("a", "b", "bits"), "simhash-fresh")
        last = more.where("more").isEmpty()
        discard(more)
        # links that were met before are checked or within a class
        roots = good_classes(fresh, sets, roots)
        if last:
            return roots
        done, most = done.unionByName(fresh.select("a", "b")), 8 * most


def _sets(texts: DataFrame) -> DataFrame:
    """id and set: the sorted hashes of the distinct shingles, packed, for every row of ``texts`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t or b"").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    return map_pieces(texts.select("id", utf8()), run, "id long, set binary")


def alike(links: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, most: int = LINKS) -> DataFrame:
    """The links a, b whose texts' sets (id, set) have at least that Jaccard similarity."""
    hubs = links.groupBy("a").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts"))
    first = sets.join(hubs, sets["id"] == hubs["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    other = links.join(hubs.where("parts > 1"), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "b")
    rows = first.unionByName(other.join(sets, other["b"] == sets["id"]).select("a", "part", "b", "set"))
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, packed in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set")), strict=True):
                x = np.frombuffer(packed, np.uint64)
                if b is None:
                    own = x
                    continue
                both = len(np.intersect1d(own, x, assume_unique=True))
                if both >= similarity * (len(own) + len(x) - both):
                    found.append((a, b))
            if found:
                yield _linked(*np.array(found, np.int64).T)

    return ordered.mapInArrow(run, "a long, b long")


def _class_table(nodes: DataFrame, node: str, roots: DataFrame, least: list[str]) -> DataFrame:
    """``nodes`` (node, rows and others) with the least of each of the columns ``least`` in the class that ``roots`` tells."""
    # Only linked nodes need a second look: the class's least, by way of its root.
    linked = nodes.join(roots.select(F.col("node").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))
    smallest = linked.groupBy("root").agg(*[F.min(c).alias(c) for c in least])
    return linked.select(node, "root", "rows").join(smallest, "root").select(node, "rows", *least)


def classes(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """The columns of ``docs`` but text, fp, and component_id, the smallest doc_id of the row's class."""
    names = [x for x in docs.columns if x.lower() not in ("text", "fp", "component_id")]
    prints = materialize(fingerprints(docs.select(*[f"`{x}`" for x in names], "text")), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("component_id")), "simhash-nodes")
    of = materialize(_class_table(nodes, "fp", components(links(nodes.select("fp"), radius)), ["component_id"]), "simhash-classes")
    common, rare = of.where(F.col("rows") > hot).drop("rows"), of.where(F.col("rows") <= hot).drop("rows")
    here = prints.join(F.broadcast(common), "fp")
    rest = prints.join(F.broadcast(common.select("fp")), "fp", "left_anti").join(rare, "fp")
    return here.unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    found = classes(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_prints(docs: DataFrame) -> DataFrame:
    """row (a column of ``docs``), t0 and t1 (128 bits of hash of the lower-cased words), w0, w1, ... (the wide fingerprint), keys and finer, for every row."""
    kept, words = docs.select("row", utf8()), [f"w{k}" for k in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts), np.int64).reshape(len(texts), 2)
            prints, keys, finer = np.zeros((len(texts), len(words)), np.uint64), [], []
            for i, t in enumerate(texts):
                hashes = shingle_hashes(t)
                prints[i] = wide_fingerprint(hashes)
                for x, y in zip((keys, finer), table_keys(hashes), strict=True):
                    x.append(y)
            columns = [*own.T, *prints.view(np.int64).T]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(np.ascontiguousarray(x)) for x in columns), pa.array(keys, pa.list_(pa.int64())), pa.array(finer, pa.list_(pa.int64()))], ["row", "t0", "t1", *words, "keys", "finer"])

    return map_pieces(kept, run, f"row {kept.schema['row'].dataType.simpleString()}, t0 long, t1 long, {', '.join(f'{w} long' for w in words)}, keys array<long>, finer array<long>")


def keep_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one row of each class of similar texts, with its columns as they were, whatever their names.

    Texts with the same words are one (told by 128 bits of hash); the others are linked where their similarity is 0.8 or
    more. The row is the one with the smallest doc_id (rows without an id come last); of several with that id
    the one that is smallest by hashes of its text and of its other columns, so that the choice doesn't depend on the
    order of rows. Of rows that are equal in all columns, one stays. Texts without words are one text.
    """
    names = docs.columns
    plain = [F.col(f"`{f.name}`") if "map<" not in f.dataType.simpleString() else F.col(f"`{f.name}`").cast("string") for f in docs.schema if f.name != "text"]
    key = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.xxhash64(F.lit(2), *plain).alias("c")]
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), *key)
    words, own = [f"w{k}" for k in range(BITS // 64)], free_names(docs, "row_a", "row_b", "row_c")
    prints = wide_prints(docs.select(row.alias("row"), "text"))
    nodes = prints.groupBy("t0", "t1").agg(F.count("*").alias("rows"), F.min("row").alias("row"), *[F.first(x).alias(x) for x in (*words, "keys", "finer")])
    nodes = materialize(nodes.drop("t0", "t1").withColumn("id", F.monotonically_increasing_id()), "simhash-texts")
    met = materialize(similar_links(nodes.select("id", *words, "keys", "finer")), "simhash-met")
    of_row = [F.col(f"row.{x[0]}").alias(x[1]) for x in zip("abc", own, strict=True)]
    keyed = docs.select("*", *[k.alias(x) for k, x in zip(key, own, strict=True)])
    ends = met.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", *of_row), "id")
    sets = materialize(_sets(keyed.select(*own, "text").dropDuplicates(own).join(ends, own).select("id", "text")), "simhash-sets")
    roots = similar_classes(nodes, met, sets)
    first = materialize(_class_table(nodes.select("id", "rows", "row"), "id", roots, ["row"]).select(*of_row).distinct(), "simhash-first")
    discard(nodes, met, sets)
    return keyed.dropDuplicates(own).join(first, own, "left_semi").select(*[f"`{x}`" for x in names])
