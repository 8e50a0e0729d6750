import math

import numpy as np
import pytest

from glyphmend.llm.kmeans_tree import Tree, approximate_neighbours, leaf_shards
from glyphmend.llm.pivots import annuli, choose_pivots, exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k, scale=None):
    """Nearest by inner product, in whole numbers if scale is given."""
    fine = [(i, [math.floor(scale * float(c)) for c in v] if scale else [float(c) for c in v]) for i, v in rows]
    out = {}
    for i, q in fine:
        if i % every == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in fine if j != i))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    return rows + [(900 + i, rows[0][1]) for i in range(300)]


def test_exact_top_k_against_brute_force(spark, clustered):
    df = spark.createDataFrame([(i, v, 0) for i, v in clustered], SCHEMA)
    assert results(exact_top_k(df)) == brute(clustered, 50, 5, 256)


def test_exact_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (50, [1.0, 2.0], 1), (100, None, 1), (150, [1.0, None], 1), (200, [float("nan"), 1.0], 1), (250, [float("inf"), 1.0], 1), (300, [], 1), (None, [1.0, 1.0], 1), (350, [1.0, 2.0, 3.0], 1), (7, [0.0, 0.0], 2), (8, [3.0, 3.0], 2), (8, [3.0, 3.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = results(exact_top_k(df))
    assert got == {0: [(8, 589824), (8, 589824), (50, 327680), (7, 0)], 50: [(8, 589824), (8, 589824), (0, 327680), (7, 0)]}
    assert exact_top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [3e12, 1.0], 0), (1, [1e13, 2.0], 0), (2, [3e38, 0.0], 0)], SCHEMA)
    top = 2**63 - 1
    assert results(exact_top_k(huge)) == {0: [(2, top), (1, top)]}, "ranked by the true products, clipped after"
    wide = spark.createDataFrame([(0, [-1e100, 2.0]), (50, [1e100, 2.0]), (1, [1e100, 3.0]), (2, [1e100, 5.0]), (3, [1e300, 1.0])], "vec_id long, embedding array<double>")
    assert results(exact_top_k(wide)) == {0: [(2, -top - 1), (1, -top - 1), (50, -top - 1)], 50: [(2, top), (1, top), (0, -top - 1)]}
    small = spark.createDataFrame([(0, [2.0**27, 1.0], 0), (1, [2.0**27, 2.0], 0), (2, [2.0**27, 3.0], 0)], SCHEMA)
    assert results(exact_top_k(small)) == {0: [(2, top), (1, top)]}


def hot_rows(clustered):
    """The clustered rows with one id, of one vector, in a third of all rows, and another, of many vectors, in a tenth."""
    return clustered + [(40, clustered[3][1])] * 600 + [(100, clustered[k][1]) for k in range(180)]


def by_id(rows, every, k, scale=None):
    """brute, where rows that share an id are the query's own, and the smallest of them asks."""
    asks = {}
    for i, v in rows:
        if i % every == 0:
            asks[i] = min(asks.get(i, v), v)
    out = {}
    whole = lambda v: [math.floor(scale * float(c)) if scale else float(c) for c in v]
    fine = [(i, whole(v)) for i, v in rows]
    for i, q in asks.items():
        q = whole(q)
        out[i] = [(j, -s) for s, j in sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in fine if j != i)[:k]]
    return out


def test_one_id_in_a_third_of_the_rows(spark, clustered):
    rows = hot_rows(clustered)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(7)
    assert results(exact_top_k(df, shard=100)) == by_id(rows, 50, 5, 256)
    got, true = results(approximate_neighbours(df, shard=100)), by_id(rows, 20, 20)
    assert got.keys() == true.keys() and all(len(v) == 20 for v in got.values())
    assert sum(s >= true[i][-1][1] for i, v in got.items() for _, s in v) >= 0.9 * 20 * len(true)
    sizes = np.array([3, 500, 20, 20, 70, 1])
    first, subs = leaf_shards(sizes, 100)
    assert first.tolist() == [0, 1, 6, 6, 7, 7] and subs.tolist() == [1, 5, 1, 1, 1, 1]


def test_equal_results_however_the_rows_are_partitioned(spark, clustered):
    df = spark.createDataFrame([(i, v, 0) for i, v in hot_rows(clustered)], SCHEMA)
    for search in (exact_top_k, approximate_neighbours):
        first = results(search(df))
        assert first == results(search(df.repartition(5))) == results(search(df.repartition(3).sortWithinPartitions("vec_id"), shard=50))


def test_extra_columns_with_clashing_names(spark, clustered):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in clustered[:200]], "vec_id long, embedding array<float>, shard int, id long, v string")
    assert results(exact_top_k(df)) == brute(clustered[:200], 50, 5, 256)
    assert results(approximate_neighbours(df, recall=1.0)).keys() == brute(clustered[:200], 20, 20).keys()


def test_annuli_and_pivots():
    pivot = np.repeat([0, 1, 2], [5, 1, 300])
    assert annuli(pivot, pivot, 128) == [(0, 5), (5, 6), (6, 134), (134, 262), (262, 306)]
    assert len(choose_pivots(np.ones((9, 3)), 4)) == 1


def test_tree_walk_visits_every_leaf_once():
    rng = np.random.default_rng(2)
    tree = Tree.fit(rng.normal(size=(2000, 6)))
    assert sorted(next(tree.walks(rng.normal(size=(1, 6))))) == list(range(len(tree.leaves)))


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_recall_of_neighbours(spark, size):
    df = spark.read.parquet(f"/root/testdata/sf{size}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    out = approximate_neighbours(df)
    got, reached = results(out), out.first().calibrated_recall
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and all(len(v) == 20 for v in got.values())
    hits = 0
    for i, found in got.items():
        q = x[ids == i][0]
        score = np.zeros(len(x))
        for d in range(x.shape[1]):
            score += q[d] * x[:, d]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:20]
        hits += len({j for j, _ in found} & set(ids[order].tolist()))
        assert all(s == score[ids == j][0] for j, s in found), "the measure, to the last bit"
    assert hits >= 0.9 * 20 * len(got) and reached >= 0.9


def test_neighbours_with_many_copies_and_odd_rows(spark, clustered):
    rows = [(i, v, 0) for i, v in clustered] + [(5000, [0.0] * 8, 0), (5020, None, 0), (5040, [1.0], 0), (None, [1.0] * 8, 0)]
    got = results(approximate_neighbours(spark.createDataFrame(rows, SCHEMA)))
    true = brute(clustered, 20, 20)
    assert got.keys() == true.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(s >= true[i][-1][1] - 1e-9 for i, v in got.items() for _, s in v)
    assert hits >= 0.9 * 20 * len(true)
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], SCHEMA)
    assert results(approximate_neighbours(few)) == {0: [(1, 0.5), (2, 0.5)]}
    assert approximate_neighbours(few.limit(0)).count() == 0
