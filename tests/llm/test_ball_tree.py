"""Top-k search against brute force: ties, repeated rows, a vector that a third of the rows have, odd components."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulesift.llm import ball_tree
from rulesift.llm.queries import op12_ball_tree

LONG = (1 << 63) - 1


def brute(rows, modulus, k=5):
    """rows: (vec_id, vector). Every result row, by plain sorting."""
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [256 * n // d for n, d in map(float.as_integer_ratio, map(float, v))]) for i, v in usable]
    out = []
    for a, (i, q) in enumerate(whole):
        if i % modulus == 0:
            scored = [(-max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(q, v, strict=True)))), j) for b, (j, v) in enumerate(whole) if a != b and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def search(spark, rows, modulus, parts=3, **more):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score int, block string").repartition(parts)
    return sorted(map(tuple, ball_tree.top(df, F.col("vec_id") % modulus == 0, **more).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(7, 12))
    rows = [(i, (centres[i % 7] + 0.2 * rng.normal(size=12)).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[4][1]) for i in range(700)]  # a third of the rows
    rows += [(i, rows[i][1]) for i in (0, 0, 7, 50)]  # repeated rows, queries among them
    rows += [(50, rows[9][1]), (2**62, rows[3][1]), (-100, rows[3][1]), (0, [0.0] * 12)]
    assert search(spark, rows, 50) == brute(rows, 50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, nan]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (10, []), (6, [1.0]), (20, [1.0, 2.0, 3.0]), (7, [0.001, -0.001]), (8, [1e30, -1e30]), (30, [-1e17, 5.0]), (9, [3.7e8, 1e9]), (40, [1.7e308, 1e300]), (11, [1e-320, 0.0])]
    rows += [(100 + i, [float(i % 3), 0.5]) for i in range(40)]
    assert search(spark, rows, 10) == brute(rows, 10)


def test_few_rows_and_none(spark):
    assert search(spark, [], 50) == []
    assert search(spark, [(50, [1.0])], 50) == []
    assert search(spark, [(51, [1.0]), (52, [1.0])], 50) == []
    assert search(spark, [(50, [1.0]), (51, [2.0])], 50) == [(50, 1, 51, 256 * 512)]


@pytest.mark.parametrize("clusters", [1, 40])
def test_tree_leaves_out_what_cannot_win(clusters):
    """The search gives the best of all; with clusters it hardly looks at other leaves."""
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(clusters, 16))[np.arange(4000) % clusters] + 0.02 * rng.normal(size=(4000, 16))).round(3)
    order = ball_tree.tree_order(vectors)
    assert sorted(order.tolist()) == list(range(4000))
    tree = ball_tree.Tree(np.arange(4000)[order], vectors[order])
    queries = ball_tree.integers(vectors[:20])
    seen = 0

    class Counted(np.ndarray):
        def __getitem__(self, at):
            nonlocal seen
            out = super().__getitem__(at)
            seen += len(out) if isinstance(at, slice) else 0
            return out

    tree.vectors = tree.vectors.view(Counted)
    place, ids, scores = tree.search(queries, np.full(20, -np.inf), 5)
    every = queries @ ball_tree.integers(vectors).T
    for q in range(20):
        want = sorted(range(4000), key=lambda i: (-every[q, i], i))[:5]
        assert ids[place == q].tolist() == want and scores[place == q].tolist() == every[q, want].astype(int).tolist()
    seen = 0
    for q in range(20):
        tree.search(queries[q : q + 1], np.full(1, -np.inf), 5)
    assert clusters == 1 or seen < 20 * 4000 / 3


def test_kth_score_of_the_first_round_is_shared():
    rng = np.random.default_rng(6)
    tree = ball_tree.Tree(np.arange(500), rng.normal(size=(500, 8)))
    queries = ball_tree.integers(rng.normal(size=(9, 8)))
    place, ids, scores = tree.search(queries, np.full(9, -np.inf), 4)
    least = ball_tree.under(scores[3::4])
    again = tree.search(queries, least, 4)
    assert [x.tolist() for x in again] == [place.tolist(), ids.tolist(), scores.tolist()]
    assert len(tree.search(queries, least + 1e9, 4)[0]) == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).astype(np.float32).astype(float).tolist()) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_ball_tree(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows, 50)
