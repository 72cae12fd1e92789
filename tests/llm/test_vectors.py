import math
import random

import brute
import numpy as np
import pytest

from rastermill.llm import clustering, negatives, queries

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string, cluster int, block int"


def vectors(spark, tmp_path, rows):
    """A table in three files, with further columns whose names operators use inside; rows: (id, vector, label)."""
    path = str(tmp_path / "v")
    spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def some(n, width, seed=0, spread=2.0):
    """Vectors on a coarse grid, so that distances and scores tie often; every third row is a copy."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [float(r.randint(-4, 4)) / 8 * spread for _ in range(width)] if i % 3 or not rows else rows[0][1]
        rows.append((i, v, r.randint(0, 2)))
    return rows


def test_reassignment_compares_only_what_changed():
    r = np.random.default_rng(1)
    block, centroids = r.integers(-9, 9, (300, 3)), r.integers(-9, 9, (7, 3))
    none = np.full(300, -1)
    owner, distance = clustering.reassigned(block, centroids, np.ones(7, bool), none, np.zeros(300, np.int64))
    for _ in range(20):
        new, changed = centroids.copy(), r.random(7) < 0.3
        new[changed] = r.integers(-9, 9, (changed.sum(), 3))
        owner, distance = clustering.reassigned(block, new, changed, owner, distance)
        whole = ((block[:, None] - new[None]) ** 2).sum(axis=2)
        assert (owner == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
        centroids = new


def test_transfers_carry_the_sums():
    r = np.random.default_rng(2)
    block, before, after = r.integers(-9, 9, (200, 4)), r.integers(-1, 3, 200), r.integers(0, 3, 200)
    sums = {c: block[before == c].sum(axis=0) for c in range(3)}
    for t in clustering.transfers(block, before, after):
        sums[t["c"]] = sums[t["c"]] + np.array(t["s"])
        assert t["n"] == (after == t["c"]).sum() - (before == t["c"]).sum()
    assert all((sums[c] == block[after == c].sum(axis=0)).all() for c in range(3))


def test_distances_are_exact_for_large_components():
    a = np.array([[1 << 26, -(1 << 26)], [(1 << 26) - 1, 1]])
    assert clustering.distances(a, a).tolist() == [[0, 1 + ((1 << 26) + 1) ** 2], [1 + ((1 << 26) + 1) ** 2, 0]]
    with pytest.raises(ValueError):
        clustering.quantised(np.array([[1e30]]), 1024)


@pytest.mark.parametrize("block", [7, 2048])
def test_clustering_is_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rows = some(90, 5) + [(7, [0.5] * 5, 1), (None, [0.25] * 5, 1)]
    odd = [(900, None, 1), (901, [0.1, None, 0.1, 0.1, 0.1], 1), (902, [0.1, NAN, 0.1, 0.1, 0.1], 1), (903, [INF] * 5, 1), (904, [0.1] * 4, 1), (905, [], 1)]
    found = clustering.delta_lloyd(vectors(spark, tmp_path, rows + odd), k=6, rounds=4, width=5).collect()
    expected, centroids = brute.lloyd([(i, v) for i, v, _ in rows], 6, 4)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found), key=key) == sorted(expected, key=key)
    total = sum(d for *_, d in expected)
    for r in found:
        assert r["centroid"] == centroids[r["cluster"]] and r["inertia"] == total
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("blocks_", "assignments_"))]


def test_clustering_of_few_and_of_none(spark, tmp_path):
    one = clustering.delta_lloyd(vectors(spark, tmp_path, [(3, [0.5, 0.5], 1), (3, [0.5, 0.5], 1)]), k=8, rounds=10, width=2).collect()
    assert sorted((r["id"], r["cluster"], r["distance"]) for r in one) == [(3, 0, 0), (3, 0, 0)]
    empty = clustering.delta_lloyd(vectors(spark, tmp_path, [(1, None, 0)]), width=2)
    assert empty.columns == one[0].__fields__ and empty.count() == 0


def test_tiles_on_the_wire():
    for most in (1, 1 << 14, 1 << 20, 1 << 40):
        x = np.array([-most, 0, most])
        assert (negatives.widened(negatives.narrow(x)) == x).all()
    a = np.array([[1 << 26] * 3, [-5, 7, 1 << 26]])
    assert negatives.product(a, a).tolist() == [[sum(x * y for x, y in zip(p, q, strict=True)) for q in a.tolist()] for p in a.tolist()]


@pytest.mark.parametrize("sizes,window", [((4, 8, 2, 2), (80, 100)), ((256, 1024, 4, 32), (80, 100)), ((5, 9, 1, 3), (35, 90))])
def test_hard_negatives_are_brute_force(spark, tmp_path, monkeypatch, sizes, window):
    for name, x in zip(("ANCHORS", "ROWS", "PANEL"), sizes, strict=False):
        monkeypatch.setattr(negatives, name, x)
    rows = some(70, 5, seed=3)
    rows += [(200 + i, [0.25 * (i % 3)] * 5, 2) for i in range(30)]  # a hot label of ties
    rows += [(300, [0.5, 0.5], 1), (301, [], 0)]  # missing components are zeros
    odd = [(400, None, 1), (401, [0.1] * 5, None), (None, [0.1] * 5, 1), (402, [NAN] * 5, 1), (403, [0.1, None], 1), (404, [INF], 1)]
    repeated = [(0, [9.0] * 5, 9)]  # the one with the smaller label counts
    padded = [(i, label, [*v, *[0.0] * (5 - len(v))]) for i, v, label in rows]
    df = vectors(spark, tmp_path, rows + odd + repeated)
    found = negatives.hard_negatives(df, negatives.F.col("id") % 10 == 0, negatives.F.col("label"), low=window[0], high=window[1], chunk=sizes[3]).collect()
    expected = brute.negatives(padded, lambda i: i % 10 == 0, low=window[0], high=window[1])
    assert expected and sorted(tuple(r) for r in found) == expected


def test_hard_negatives_of_none(spark, tmp_path):
    ask = lambda rows: negatives.hard_negatives(vectors(spark, tmp_path, rows), negatives.F.col("id") % 10 == 0, negatives.F.col("label")).collect()
    assert ask([(1, None, 0)]) == []
    assert ask([(10, [1.0], 0), (11, [1.0], 1)]) == []  # an anchor without positives
    assert [tuple(r) for r in ask([(10, [1.0], 0), (11, [1.0], 0), (12, [0.9], 1)])] == [(10, 11, 1, 12, 256 * 256, 256 * math.floor(np.float32(0.9) * 256.0))]


def test_windows_of_negative_and_zero_scores(spark, tmp_path):
    rows = [(10, [1.0], 0), (11, [-1.0], 0), (12, [-0.9], 1), (13, [0.0], 0), (14, [0.0], 2)]
    found = negatives.hard_negatives(vectors(spark, tmp_path, rows), negatives.F.col("id") % 10 == 0, negatives.F.col("label")).collect()
    assert sorted(tuple(r) for r in found) == brute.negatives([(i, label, v) for i, v, label in rows], lambda i: i % 10 == 0) == [(10, 13, 1, 14, 0, 0)]


def test_queries_carry_their_columns(spark, sf):
    assert queries.op11_centroid_clustering(spark, sf).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert queries.op12_hard_negatives(spark, sf).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
