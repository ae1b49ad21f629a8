import numpy as np
import pytest

from threadloom.llm import neighbours
from threadloom.llm.neighbours import Options

SCHEMA = "id long, embedding array<float>, q string, class int, asks int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "q", 1, 2) for i, e in rows], SCHEMA)


def topics(n, per, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // per, dim))
    x = np.repeat(centres, per, axis=0) + 0.15 * rng.normal(size=(n // per * per, dim))
    return x * rng.uniform(0.1, 40, size=(len(x), 1))


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k]


def test_recall_over_many_regions(spark):
    x = topics(3000, 12)
    found = neighbours.neighbours(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), Options(region=200)).toPandas()
    assert (found.groupby("id").size() == 5).all() and found.id.nunique() == 3000
    truth = brute(x, 5)
    got = found.groupby("id").other.apply(set)
    assert np.mean([len(set(truth[i]) & got[i]) / 5 for i in range(3000)]) >= 0.95


def test_a_cell_above_the_region_is_answered_in_blocks(spark):
    x = topics(600, 600)
    options = Options(region=50, per_cell=1000, candidates=10)
    found = neighbours.neighbours(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), options).toPandas()
    truth, got = brute(x, 5), found.groupby("id").other.apply(set)
    assert np.mean([len(set(truth[i]) & got[i]) / 5 for i in range(600)]) >= 0.99


def test_copies_of_one_vector(spark):
    x = topics(60, 6, seed=3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(40)]
    found = neighbours.neighbours(frame(spark, rows)).toPandas().groupby("id").other.apply(set)
    assert all(len(v) == 5 for v in found)
    assert found[1039] == {0, 1000, 1001, 1002, 1003}  # the lowest ids among equals
    assert found[0] == {1000, 1001, 1002, 1003, 1004}
    assert found[1] == {0, 1000, 1001, 1002, 1003} or 0 in found[1]


def test_unusable_vectors_take_no_part(spark):
    good = [(i, [1.0 + i] + [0.5] * 63) for i in range(3)]
    bad = [(10, None), (11, []), (12, [0.0] * 64), (13, [1.0] * 63), (14, [1.0] * 65), (15, [float("nan")] * 64), (16, [float("inf")] + [1.0] * 63), (17, [None] + [1.0] * 63)]
    found = neighbours.neighbours(frame(spark, good + bad + [(None, [1.0] * 64)])).toPandas()
    assert sorted(zip(found.id, found.other)) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert found.similarity.between(-1.001, 1.001).all()
    pairs = neighbours.pairs(spark.createDataFrame(found)).collect()
    assert sorted((p["id_a"], p["id_b"]) for p in pairs) == [(0, 1), (0, 2), (1, 2)]


@pytest.mark.parametrize("n", [0, 1])
def test_too_few(spark, n):
    assert neighbours.neighbours(frame(spark, [(i, [1.0] * 64) for i in range(n)])).count() == 0


def test_traversal_visits_cells_by_rising_distance():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(9, 4)).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32)
    index = neighbours.Index(neighbours.Codebooks(a, b), counts=np.ones(81, np.int64))
    point = rng.normal(size=8).astype(np.float32)
    met = index.traverse(point, Options(candidates=10**6))
    assert sorted(met) == list(range(81))
    d = [float(((point[:4] - a[c // 9]) ** 2).sum() + ((point[4:] - b[c % 9]) ** 2).sum()) for c in met]
    assert np.allclose(d, sorted(d), atol=1e-4)


def test_full_cells_are_divided_again(spark):
    """A crowd that one cell takes in; the traversal goes on inside it and around it."""
    rng = np.random.default_rng(1)
    crowd = 1.0 + np.repeat(0.3 * rng.normal(size=(200, 64)), 12, axis=0) + 0.05 * rng.normal(size=(2400, 64))
    x = np.concatenate([crowd, topics(600, 12, seed=2)])
    options = Options(full=60, per_small_cell=20, region=300, per_cell=100, candidates=200)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = neighbours.build_index(neighbours.unit_vectors(rows), options)
    assert index.inner and index.counts.sum() == len(x) and np.bincount(index.region_of[index.region_of >= 0]).size > 5
    found = neighbours.neighbours(rows, options).toPandas()
    truth, got = brute(x, 5), found.groupby("id").other.apply(set)
    assert (found.groupby("id").size() == 5).all()
    assert np.mean([len(set(truth[i]) & got[i]) / 5 for i in range(len(x))]) >= 0.9


def test_ties_at_the_edge_go_to_the_lower_ids():
    y = np.zeros((100, 2), np.float32)
    y[:, 0] = 1
    ids, values = neighbours.best_of(y[:1], y, np.array([0]), np.arange(100)[::-1].copy(), 3)
    assert ids.tolist() == [[1, 2, 3]] and (values == 1).all()
