import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphcq.llm import search


def brute(rows, mod, k):
    sound = [(i, [math.floor(float(x) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(sound):
        if q % mod == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(sound) if m != n)[:k]  # noqa: B905: the components that both have
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")


def run(spark, rows, mod=5, k=4):
    return sorted(tuple(r) for r in search.exact_top_k(table(spark, rows), query_mod=mod, k=k).collect())


def vectors(n, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 60, 400])
def test_against_brute_force(spark, n):
    assert run(spark, vectors(n)) == brute(vectors(n), 5, 4)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAST_ROWS", 30)
    rows = vectors(300, seed=2)
    assert run(spark, rows, k=7) == brute(rows, 5, 7)
    monkeypatch.setattr(search, "SHARD_ROWS", 9)
    assert run(spark, rows, k=12) == brute(rows, 5, 12)  # fewer in a shard than are asked for


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40 + i, [0.5, 0.5]) for i in range(20)]
    assert run(spark, rows) == brute(rows, 5, 4)


def test_odd_vectors_take_no_part(spark):
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (105, [float("nan")] * 6), (106, [float("inf")] + [0.0] * 5), (107, []), (None, [1.0] * 6)]
    assert run(spark, vectors(50) + odd) == brute(vectors(50) + odd, 5, 4)


def test_widths_may_differ(spark):
    rows = [*vectors(50), (200, [1.0, 2.0]), (201, []), (205, [0.5] * 9), (210, [2.0])]
    assert run(spark, rows) == brute(rows, 5, 4)


def test_repeated_rows_count_each(spark):
    assert run(spark, vectors(30) * 3) == brute(vectors(30) * 3, 5, 4)


def test_sums_beyond_a_product_of_longs(spark):
    big = [(i, [3.0e4 * (i + 1), -2.0e4, 1.0, float(i), 0.0, float(2**17 // (i + 1))]) for i in range(40)]
    assert run(spark, big) == brute(big, 5, 4)
    huge = [(0, [1e30] * 2), (1, [1e30] * 2), (2, [-1e30] * 2)]
    assert run(spark, huge) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 16)) * 1000
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 50 for c in centers]).astype(np.int64)
    tree, ids, seen = search.BallTree(x), np.arange(len(x)), []
    for i in range(0, len(x), 100):
        assert sorted((s, -n) for s, n, _ in search.top_k(tree, ids, ids, x[i], i, 5, None, seen=seen)) == sorted((int(x[j] @ x[i]), j) for j in sorted(set(ids) - {i}, key=lambda j: (-(x[j] @ x[i]), j))[:5])
    assert len(seen) < 0.1 * 40 * sum(left < 0 for _, _, left, _ in tree.nodes)


def test_sql_agrees(spark):
    rows = [*vectors(300, seed=4), (300, None), (305, [float("nan")] * 6), (None, [1.0] * 6), (400, [1.0, 2.0]), (7, [0.0] * 6)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert run(spark, rows, 100, 10) == sorted(con.execute(search.SQL).fetchall())


def test_no_vectors(spark):
    assert run(spark, vectors(3)[1:]) == []
    assert search.exact_top_k(table(spark, vectors(1)).where("false")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.integers(0, 9))
def test_tree_bounds_hold(n, dim, seed):
    x = np.random.default_rng(seed).integers(-50, 50, (n, dim))
    tree, q = search.BallTree(x), np.random.default_rng(seed + 1).integers(-50, 50, dim)
    bounds = tree.bounds(q.astype(float))
    for (lo, hi, _, _), b in zip(tree.nodes, bounds, strict=True):
        assert (tree.x[lo:hi] @ q).max() <= b
    assert sorted(tree.order.tolist()) == list(range(n))
