"""Exact top-k search by inner product: ball trees, branch and bound.

Components are turned into integers, floor(``SCALE`` * x), so scores are exact. The rows are dealt evenly into shards,
whatever they hold, and every shard orders its vectors as a ball tree: a node's vectors are halved along the line between
two far ones, down to leaves of ``LEAF``; as halves are halves by count, the order alone is stored, and repeated vectors
are split like any other. Each node is a ball, its mean and the largest distance from it. A query q scores at most
q * mean + |q| * radius in it.

Queries go in blocks to every shard. In a shard a block descends the tree level by level, and a (query, node) pair is left
out once its bound is under the query's k-th score so far. The leaves that remain are visited in the order of their
bounds, the best one first, then twice as many each time, and the k-th score rises between. It is shared: a first round
takes each block to one shard alone, and the k-th scores found there go with it to all others.

Ties go to the smaller vec_id, so leaves whose bound equals the k-th score are visited. A query's own row is left out at
the end: the search keeps one more, and one result with the query's id and its score with itself goes, whichever of equal
rows it was.

Cases: rows without an id, and vectors that are null or hold a null or a non-finite component, take no part. Vectors of
different lengths don't meet. Repeated rows are candidates, and queries, each for itself. Components of any size are
exact (large ones are counted in Python's integers); scores beyond a long count as its largest or smallest number. Extra columns are ignored.
An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulesift.llm.common import discard, materialize, small_batches

SCALE, LEAF, K = 256, 64, 5
#: Components in one shard, queries in one block, and rows that a shard has at least where there are few.
SHARD, BLOCK, LEAST = 1 << 22, 1024, 512
_LONG = (1 << 63) - 1


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): float64 as long as all inner products are exact in it, else Python's integers."""
    scaled = np.floor(SCALE * vectors) if not vectors.size or np.abs(vectors).max() < 1e300 else None
    if scaled is not None and (not scaled.size or scaled.shape[1] * float(np.abs(scaled).max()) ** 2 < 2**52):
        return scaled
    return np.array([[SCALE * int(n) // d for n, d in map(float.as_integer_ratio, row)] for row in vectors.tolist()], object).reshape(vectors.shape)


class Tree:
    """Vectors, in the order of a ball tree, and its balls."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, integers(vectors)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # bounds of the nodes, their means and radii, from the root
        self.large = self.vectors.dtype == object and _most(self.vectors) > 1e100  # squares would pass a double: no bounds
        plain = np.zeros(self.vectors.shape) if self.large else self.vectors.astype(np.float64, copy=False)
        for depth in range(_depth(len(ids)) + 1):
            edges = _edges(len(ids), depth)
            size = np.diff(edges)
            means = np.add.reduceat(plain, edges[:-1], axis=0) / size[:, None]
            away = np.sqrt(np.square(plain - np.repeat(means, size, axis=0)).sum(axis=1))
            self.levels.append((edges, means, np.maximum.reduceat(away, edges[:-1])))

    def search(self, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, vec_ids and scores: what the shard has among the best k, none under ``least``."""
        exact = queries.dtype != object and self.vectors.dtype != object and queries.shape[1] * _most(queries) * _most(self.vectors) < 2**52
        left, right = (queries, self.vectors) if exact else (queries.astype(object), self.vectors.astype(object))
        large = self.large or queries.dtype == object and _most(queries) > 1e100
        floats = np.zeros(queries.shape) if large else queries.astype(np.float64, copy=False)
        length = np.sqrt(np.square(floats).sum(axis=1))
        bound = np.zeros((len(queries), 1))
        for depth, (_, means, radii) in enumerate(self.levels):
            parents = np.arange(len(means)) // 2 if depth else np.zeros(1, np.int64)
            going = bound[:, parents] >= least[:, None] if depth else np.ones((len(queries), 1), bool)
            seen = np.flatnonzero(going.any(axis=0))
            bound = np.full((len(queries), len(means)), -np.inf)
            size = np.sqrt(np.square(means[seen]).sum(axis=1)) + radii[seen]
            bound[:, seen] = np.inf if large else floats @ means[seen].T + length[:, None] * (radii[seen] + 1e-9 * size) + 1e-6
            bound[~going] = -np.inf
        edges = self.levels[-1][0]
        order = np.argsort(-bound, axis=1, kind="stable")
        found = [np.zeros(0, np.int64)] * 3
        at, step, least = 0, 1, least.copy()
        while at < order.shape[1]:
            wave = order[:, at : at + step]
            query, leaf = np.nonzero(np.take_along_axis(bound, wave, axis=1) >= np.maximum(least, -1e308)[:, None])
            leaf = wave[query, leaf]
            if not len(query):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            query, leaf = query[by_leaf], leaf[by_leaf]
            starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
            new = [found]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True):
                own, begin, end = query[a:b], edges[leaf[a]], edges[leaf[a] + 1]
                scores = left[own] @ right[begin:end].T
                scores = scores if exact else cut(scores)
                q, v = np.nonzero(scores >= least[own, None])
                new.append([own[q], self.ids[begin + v], scores[q, v].astype(np.int64)])
            found = best(*map(np.concatenate, zip(*new, strict=True)), k)
            last = np.flatnonzero(np.bincount(found[0], minlength=len(queries)) == k)
            ends = np.cumsum(np.bincount(found[0], minlength=len(queries)))[last] - 1
            least[last] = np.maximum(least[last], under(found[2][ends]))
            at, step = at + step, 2 * step
        return tuple(found)


def _most(x: np.ndarray) -> float:
    return float(min(np.abs(x).max(), 10**300)) if x.size else 0.0


def cut(scores: np.ndarray) -> np.ndarray:
    """Python's integers as longs, those beyond as the largest or smallest."""
    return np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in scores.ravel().tolist()], np.int64).reshape(scores.shape)


def under(scores: np.ndarray) -> np.ndarray:
    """Longs as doubles that aren't above them."""
    x = scores.astype(np.float64)
    return np.where(np.abs(x) < 2**52, x, x - np.abs(x) * 2.0**-51)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """The first k of each query by score, then vec_id."""
    order = np.lexsort((ids, ~scores, query))
    query = query[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(query)]))))
    kept = place < k
    return [query[kept], ids[order][kept], scores[order][kept]]


def _depth(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def _edges(n: int, depth: int) -> np.ndarray:
    return np.arange((1 << depth) + 1, dtype=np.int64) * n >> depth


def tree_order(vectors: np.ndarray) -> np.ndarray:
    """The order of a ball tree: each node's part is halved along the line between two of its vectors that are far apart."""
    n = len(vectors)
    order = np.arange(n)
    for depth in range(_depth(n)):
        edges, halves = _edges(n, depth), _edges(n, depth + 1)
        for node in range(1 << depth):
            a, b, half = edges[node], edges[node + 1], halves[2 * node + 1]
            own = vectors[order[a:b]]
            one = own[np.argmax(np.square(own - own.mean(axis=0)).sum(axis=1))]
            other = own[np.argmax(np.square(own - one).sum(axis=1))]
            order[a:b] = order[a:b][np.argpartition(own @ (other - one), half - a)] if half < b else order[a:b]
    return order


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)


def _packed(rows: DataFrame, most: int, tree: bool) -> DataFrame:
    """number, dim, ids and vectors (packed): at most ``most`` components of one length together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size: dict[int, int] = {}
        count = 0

        def out(dim: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            nonlocal count
            ids, vectors = np.concatenate(parts[0]), np.concatenate(parts[1])
            if tree:
                with np.errstate(over="ignore", invalid="ignore"):
                    order = tree_order(vectors)
                ids, vectors = ids[order], vectors[order]
            count += 1
            return pa.RecordBatch.from_arrays([pa.array([count]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], ["number", "dim", "ids", "vectors"])

        for batch in batches:
            lists = batch.column("vector")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            starts, all_ids = np.concatenate(([0], np.cumsum(sizes))), batch.column("vec_id").to_numpy()
            for dim in np.unique(sizes).tolist():
                rows_ = np.flatnonzero(sizes == dim)
                values = flat[starts[rows_][:, None] + np.arange(dim)] if dim else np.zeros((len(rows_), 0))
                each = max(1, most // max(dim, 1))
                while len(rows_):
                    parts = held.setdefault(dim, [[], []])
                    take = min(len(rows_), each - size.get(dim, 0))
                    parts[0].append(all_ids[rows_[:take]])
                    parts[1].append(values[:take])
                    size[dim] = size.get(dim, 0) + take
                    rows_, values = rows_[take:], values[take:]
                    if size[dim] == each:
                        yield out(dim, held.pop(dim))
                        size.pop(dim)
        for dim, parts in held.items():
            yield out(dim, parts)

    part = rows.withColumn("part", F.spark_partition_id())  # numbers of tasks make those of their shards unique
    made = part.select("vec_id", "vector").mapInArrow(run, "number long, dim int, ids binary, vectors binary")
    return made.select(((F.spark_partition_id().cast("long") * (1 << 32)) + F.col("number")).alias("number"), "dim", "ids", "vectors")


def _round(shards: DataFrame, asked: DataFrame, k: int, partitions: int) -> DataFrame:
    """query (block and place), query_id, vec_id, score and own (the query's score with itself) of ``asked`` (shard, block, dim, ids, vectors, least) in its shards."""
    trees = shards.select(F.col("number").alias("shard"), F.lit(None).cast("long").alias("block"), "dim", "ids", "vectors", F.lit(None).cast("binary").alias("least"))
    rows = trees.unionByName(asked).repartition(partitions, "shard").sortWithinPartitions("shard", F.col("block").isNotNull())
    names = ["block", "place", "query_id", "own", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]) if row["dim"] else np.zeros((len(row["ids"]) // 8, 0))
                if row["block"] is None:
                    tree = Tree(ids, vectors)
                    continue
                queries = integers(vectors)
                own = (queries * queries).sum(axis=1) if queries.size else np.zeros(len(ids))
                own = cut(own) if own.dtype == object else own.astype(np.int64)
                least = under(np.frombuffer(row["least"], np.int64)) if row["least"] else np.full(len(ids), -np.inf)
                place, vec, score = tree.search(queries, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), row["block"])), pa.array(place), pa.array(ids[place]), pa.array(own[place]), pa.array(vec), pa.array(score)], names)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "block long, place long, query_id long, own long, vec_id long, score long")


def top(vectors: DataFrame, query: Column, k: int = K, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``vectors`` (vec_id and ``column``) that ``query`` is true of, the k other rows with the highest scores."""
    spark = vectors.sparkSession
    rows = materialize(_usable(vectors, column), "vectors")
    n, wide = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    asked = rows.where(query)
    tasks = spark.sparkContext.defaultParallelism
    parts = max(-(-wide // SHARD), min(2 * tasks, n // LEAST), 1)
    shards = materialize(_packed(rows.repartition(parts), SHARD, True), "ball-trees")
    wanted = asked.count()
    blocks = _packed(asked.repartition(max(1, -(-wanted // BLOCK))), BLOCK * max(1, wide // max(n, 1)), False).withColumnRenamed("number", "block")
    blocks = materialize(blocks, "query-blocks")
    # Numbers of shards by length, so that a block can name one of them and all others: a row for each 32 MB of vectors.
    numbers = shards.groupBy("dim").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    paired = blocks.join(numbers, "dim").withColumn("home", F.get("numbers", F.pmod(F.xxhash64("block"), F.size("numbers")).cast("int")))
    parts = max(parts, tasks)
    home = paired.select(F.col("home").alias("shard"), "block", "dim", "ids", "vectors", F.lit(None).cast("binary").alias("least"))
    first = materialize(_round(shards, home, k + 1, parts), "first-round")
    packed = _least(blocks, first, k + 1)
    others = paired.join(packed, "block").select(F.explode(F.filter("numbers", lambda x: x != F.col("home"))).alias("shard"), "block", "dim", "ids", "vectors", "least")
    found = first.unionByName(_round(shards, others, k + 1, parts))
    by = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    gone = F.min(F.when(itself, F.col("rank"))).over(Window.partitionBy("block", "place"))
    ranked = ranked.withColumn("gone", F.coalesce(gone, F.lit(k + 1)))
    out = ranked.where(F.col("rank") != F.col("gone")).select("query_id", (F.col("rank") - (F.col("rank") > F.col("gone")).cast("int")).cast("int").alias("rank"), "vec_id", "score")
    discard(rows)
    return out


def _least(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """block and least: of each query the k-th score so far, packed in the order of the block's places."""
    kth = found.groupBy("block", "place").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    each = kth.select("block", "place", F.when(F.col("n") >= k, F.col("score")).otherwise(-_LONG - 1).alias("least"))
    packed = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "least"))).alias("each"))
    sizes = blocks.select("block", (F.octet_length("ids") / 8).cast("int").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, each in zip(batch.column("n").to_pylist(), batch.column("each").to_pylist(), strict=True):
                least = np.full(n, -_LONG - 1, np.int64)
                for x in each or ():
                    least[x["place"]] = x["least"]
                out.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "least"])

    return sizes.join(packed, "block", "left").mapInArrow(run, "block long, least binary")
