"""Neighbour joins, density clustering and mixtures against plain versions; contributions on deep trees; short passages; error rates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark.operators import cluster, neighbours, retrieval, risk, text


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def blobs(seed, n, centres=12, dims=6):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * 20 + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_join_equals_all_pairs(spark, clustered):
    x = blobs(1, 1500) if clustered else np.random.default_rng(2).random((1500, 3))
    x[700:760] = x[0]  # equal vectors
    rows = frame(spark, x).union(spark.createDataFrame([(5000, None)], "id long, v array<double>"))
    work = []
    got = {}
    for r in neighbours.nearest_join(rows.where("id % 3 = 0"), rows, "id", "id", "v", 7, work=work).collect():
        got.setdefault(r.query, {})[r.rank] = (r.chunk, r.distance)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for q in range(0, 1500, 3):
        want = sorted((d[q, i], i) for i in range(1500))[:7]
        assert [got[q][k + 1][0] for k in range(7)] == [i for _, i in want] and np.allclose([got[q][k + 1][1] for k in range(7)], [v for v, _ in want])
    assert sum(work) < (0.5 if clustered else 1.01) * 500 * 1500


def test_nearest_join_over_many_tasks(spark):
    """Groups of a cell's queries and stored vectors meet in one task where adaptive execution leaves the tasks as they are, too."""
    x = np.random.default_rng(9).random((300, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.query: r.distance for r in neighbours.nearest_join(frame(spark, x), frame(spark, x), "id", "id", "v", 5).where("rank = 5").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.allclose([got[i] for i in range(300)], np.sort(d, 1)[:, 4])


def test_nearest_join_of_little(spark):
    x = frame(spark, np.zeros((3, 2)))
    assert sorted((r.query, r.chunk) for r in neighbours.nearest_join(x, x, "id", "id", "v", 5).collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert neighbours.nearest_join(x, x.limit(0), "id", "id", "v", 5).count() == 0 and neighbours.nearest_join(x.limit(0), x, "id", "id", "v", 5).count() == 0


def plain_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core, label = near.sum(1) >= least, {}
    for i in np.flatnonzero(core).tolist():
        if i not in label:
            open_, label[i] = [i], i
            while open_:
                for j in np.flatnonzero(near[open_.pop()] & core).tolist():
                    if j not in label:
                        label[j] = i
                        open_.append(j)
    return core, [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core).tolist()), default=None) for i in range(len(x))]


def test_density_clusters_equal_a_plain_run_on_5000_rows(spark):
    rng = np.random.default_rng(4)
    angle = rng.uniform(0, 2 * math.pi, 4200)
    x = np.concatenate([np.stack([np.cos(angle), np.sin(angle)], 1) * rng.choice([3.0, 6.0], 4200)[:, None] + rng.normal(size=(4200, 2)) * 0.08, rng.uniform(-8, 8, (500, 2)), np.repeat([[1.0, 1.0]], 300, 0)])
    core, want = plain_dbscan(x, 0.25, 25)
    found = neighbours.density_clusters(frame(spark, x), "id", "v", 0.25, 25, cell_rows=300)
    got = {r.id: r for r in found.collect()}
    assert [got[i].core for i in range(5000)] == core.tolist() and [got[i].cluster for i in range(5000)] == want and len({c for c in want if c is not None}) >= 3
    profile = neighbours.noise_profile(found.withColumn("y", (F.col("id") % 2).cast("double")), "y").first()
    assert profile.noise_share == pytest.approx(np.mean([c is None for c in want])) and profile.core_rate == pytest.approx(np.mean(np.flatnonzero(core) % 2))
    assert neighbours.density_clusters(frame(spark, x[:1]).limit(0), "id", "v", 0.25, 25).count() == 0


def test_mixtures_in_shared_passes(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 3)) * 0.5 + m for m in ([0, 0, 0], [6, 0, 0], [0, 6, 0], [6, 6, 3])])
    rows = frame(spark, x).union(spark.createDataFrame([(9999, None)], "id long, v array<double>"))
    mixture, scored = cluster.choose_mixture(rows, "id", "v", ks=range(2, 7))
    assert len(mixture.weights) == 4 and [k for k, _ in scored] == [2, 3, 4, 5, 6] and np.allclose(sorted(mixture.weights), 0.25, atol=0.01)
    got = {r.id: r for r in cluster.mixture_labels(rows, "id", "v", mixture).collect()}
    assert got[9999].cluster is None and len({got[i].cluster for i in range(400)}) == 1 and all(got[i].certainty > 0.9 for i in range(1600))
    # a plain expectation step does not move the means, and its likelihood is the one that the BIC uses
    logs = mixture.log_densities(x)
    share = np.exp(logs - np.log(np.exp(logs).sum(1))[:, None])
    assert np.allclose((share.T @ x) / share.sum(0)[:, None], mixture.means, atol=0.02)
    assert dict(scored)[4] == pytest.approx(-2 * np.log(np.exp(logs).sum(1)).sum() + mixture.free() * math.log(len(x)))


def test_contributions_on_deep_paths():
    """A chain of 24 features: contributions add up to the tree's value, and equal features share alike."""
    n = 24
    feature = np.array([k if b == 0 else -1 for k in range(n) for b in (0, 1)] + [-1])
    left, right = np.zeros(2 * n + 1, int), np.zeros(2 * n + 1, int)
    for k in range(n):
        left[2 * k], right[2 * k] = 2 * k + 1, 2 * k + 2
    weight = np.array([2.0 ** (n - k // 2) if k % 2 == 0 else 2.0 ** (n - k // 2 - 1) for k in range(2 * n + 1)])
    value = np.zeros(2 * n + 1)
    value[2 * n] = 1.0
    tree = feature, np.zeros(2 * n + 1), left, right, value, weight
    x = np.ones((3, n))
    x[1, ::2] = -1
    got = risk.shapley(risk.leaf_paths(tree), x)
    assert np.allclose(got.sum(1) + risk.expected(tree), [1.0, 0.0, 1.0]) and np.allclose(got[0], got[0, 0])


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "hello big world"), (2, "a bigworld"), (3, "gbig worlds"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "big world"), (2, "orl"), (3, "hello big world"), (4, "nowhere"), (5, "!"), (6, None), (7, "big world")], "item_id int, query string")
    got = {(r.item_id, r.doc_id) for r in retrieval.holders(docs, asked, "doc_id", "item_id").collect()}
    assert got == {(1, 1), (1, 3), (7, 1), (7, 3), (2, 1), (2, 2), (2, 3), (3, 1)}


def test_error_rates_of_empty_and_many_words(spark):
    many = " ".join(f"w{i}" for i in range(41_000))
    pairs = spark.createDataFrame([(1, "", ""), (2, "", "ab c"), (3, None, None), (4, "ab", None), (5, many, many)], "id int, a string, b string")
    got = {r.id: (r.cer, r.wer) for r in text.error_rates(pairs.where("id < 5"), "a", "b").collect()}
    assert got == {1: (0.0, 0.0), 2: (4.0, 2.0), 3: (0.0, 0.0), 4: (1.0, 1.0)}
    short = " ".join(f"w{i}" for i in range(40_990, 41_000))
    assert text.error_rates(spark.createDataFrame([(short, many)], "a string, b string"), "a", "b").first().wer == pytest.approx(40_990 / 10)


def test_matrix_of_sliced_and_chunked_vectors():
    import pyarrow as pa

    rows = [[float(i), None if i == 3 else i / 3] for i in range(6)]
    column = pa.array(rows, pa.list_(pa.float64()))
    want = np.array(rows, np.float64)
    assert np.array_equal(neighbours.matrix(column.slice(2, 3)), want[2:5], equal_nan=True) and neighbours.matrix(column[:0]).size == 0
    assert np.array_equal(neighbours.matrix(pa.chunked_array([column.slice(1, 2), column.slice(3, 2)])), want[1:5], equal_nan=True)


def test_density_clusters_of_crowded_boxes(spark, monkeypatch):
    """A grid serves few dimensions: a box of many vectors is not compared with itself, gaps near eps and all of one to three dimensions agree with a plain run."""
    rng = np.random.default_rng(11)
    two = np.concatenate([rng.normal(size=(1500, 2)) * 0.2, rng.normal(size=(600, 2)) * 0.2 + [1.55, 0.1], rng.uniform(-3, 5, (500, 2)), [[0.31 * i, 4.0] for i in range(12)]])
    arcs = np.array([[r * math.cos(a), r * math.sin(a)] for r in (1.0, 1.299, 1.601) for a in np.linspace(0, 1.5, 300)])
    cases = [(two, 0.3, 8), (arcs, 0.3, 4), (rng.normal(size=(700, 3)), 0.35, 6), (rng.normal(size=(500, 1)) * 30, 0.4, 3), (np.array([[1.0, 2.0]]), 0.5, 1), (two[:50] + 5e4, 0.3, 4)]
    monkeypatch.setattr(neighbours, "pivots_of", None)  # no cells of pivots
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    for x, eps, least in cases:
        core, want = plain_dbscan(x, eps, least)
        got = {r.id: r for r in neighbours.density_clusters(frame(spark, x), "id", "v", eps, least).collect()}
        assert [got[i].core for i in range(len(x))] == core.tolist() and [got[i].cluster for i in range(len(x))] == want


def test_touch_equals_all_pairs():
    rng = np.random.default_rng(2)
    for k in range(40):
        a, b = rng.uniform(size=(400, 2)), rng.uniform(size=(300, 2)) + [1.0 + 0.01 * k, 0.3]
        least = math.sqrt(((a[:, None] - b[None]) ** 2).sum(2).min())
        assert neighbours._touch(a, b, least * (1 + 1e-9)) and not neighbours._touch(a, b, least * (1 - 1e-9))


def test_queries_are_sent_once_to_each_region(spark, monkeypatch):
    """Where nearly all cells are visited, a query's vector goes to a few regions of cells, not to every cell."""
    sent, own = [], neighbours._nearest_in_cells

    def counted(asked, *more):
        sent.append(asked.count())
        return own(asked, *more)

    monkeypatch.setattr(neighbours, "_nearest_in_cells", counted)
    x = np.random.default_rng(11).random((2000, 16))
    work = []
    got = {r.query: r.distance for r in neighbours.nearest_join(frame(spark, x), frame(spark, x), "id", "id", "v", 9, work=work).where("rank = 9").collect()}
    assert sum(work) > 0.8 * 2000 * 2000 and sum(sent) <= 5 * 2000
    for q in range(0, 2000, 97):
        assert got[q] == pytest.approx(np.sort(np.sqrt(((x - x[q]) ** 2).sum(1)))[9])


def test_keys_of_text_and_short_blocks(spark, monkeypatch):
    """Ties go to the smaller key, regions of several blocks and cells of several slices lose nothing."""
    monkeypatch.setattr(neighbours, "GROUP", 4096)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    x = np.random.default_rng(12).integers(0, 4, (400, 3)).astype(float)
    rows = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    got = {}
    for r in neighbours.nearest_join(rows, rows, "id", "id", "v", 6).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.chunk
    for q in range(0, 400, 13):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[i], f"k{i:03d}") for i in range(400) if i != q)[:6]
        assert [got[f"k{q:03d}"][j + 1] for j in range(6)] == [n for _, n in want]
