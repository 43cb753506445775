import numpy as np
import pytest

from sparkselect.operators.embedding import LandmarkSpace, landmark_embedding, path_lengths, spread


def _frame(spark, x):
    rows = [(i, *map(float, r), i % 2) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])) + ", y int").repartition(4)


def _coords(rows, k):
    got = rows.orderBy("id").collect()
    return np.array([[r[f"e{i + 1}"] for i in range(k)] for r in got])


def test_straight_distances_are_kept(spark):
    x = np.random.default_rng(3).normal(size=(400, 3)) * [1, 10, 100]
    rows, shares, space = landmark_embedding(_frame(spark, x), ["f0", "f1", "f2"], "y", "id", k=3, landmarks=40)
    e = _coords(rows, 3)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(((e[:, None] - e) ** 2).sum(-1), ((z[:, None] - z) ** 2).sum(-1), atol=1e-6)
    assert len(space.points) == 40 and sum(r["share"] for r in shares.collect()) == pytest.approx(1)
    # every row's distances to the landmarks, those not among them too
    there = space.place(space.points)
    assert np.allclose(np.linalg.norm(e[:, None] - there, axis=-1), np.linalg.norm(z[:, None] - space.points, axis=-1), atol=1e-6)


def test_paths_unroll_an_arc(spark):
    """On three quarters of a circle the length of the arc is known; one dimension holds it."""
    t = np.linspace(0, 1.5 * np.pi, 1000)
    x = np.stack((np.cos(t), np.sin(t)), axis=1)
    rows, _, _ = landmark_embedding(_frame(spark, x), ["f0", "f1"], "y", "id", k=2, landmarks=120, neighbors=3)
    e = _coords(rows, 2)
    assert abs(np.corrcoef(e[:, 0], t)[0, 1]) > 0.995
    straight = _coords(landmark_embedding(_frame(spark, x), ["f0", "f1"], "y", "id", k=2, landmarks=120)[0], 2)
    assert abs(np.corrcoef(straight[:, 0], t)[0, 1]) < 0.95


def test_paths_on_a_line_are_its_lengths():
    x = np.sort(np.random.default_rng(1).random(60))[:, None]
    x[30:] += 5  # a gap that neighbours do not bridge
    d = np.abs(x - x.T)
    assert np.allclose(path_lengths(d, 2), d)
    space = LandmarkSpace(x, 1, 2)
    assert np.allclose(np.abs(space.place(x) - space.place(x).T), d, atol=1e-7)


def test_points_are_spread():
    x = np.concatenate((np.zeros((50, 2)), np.random.default_rng(0).normal(size=(30, 2)) * 0.01, [[9.0, 0.0], [0.0, 9.0]]))
    got = spread(x, 3)
    assert {(9.0, 0.0), (0.0, 9.0)} <= {tuple(p) for p in got} and len(spread(x, 500)) == 33


def test_edges(spark):
    same = np.ones((20, 2))
    rows, shares, space = landmark_embedding(_frame(spark, same), ["f0", "f1"], "y", "id", neighbors=2)
    assert not _coords(rows, 2).any() and len(space.points) == 1 and {r["share"] for r in shares.collect()} == {0.0}
    df = _frame(spark, same)
    assert landmark_embedding(df.limit(0), ["f0", "f1"], "y", "id")[0].count() == 0
    with pytest.raises(ValueError, match="impute"):
        landmark_embedding(df.selectExpr("id", "f0", "if(id = 3, null, f1) f1", "y"), ["f0", "f1"], "y", "id")
