"""k-means with all starts at once against separate fits and by definition."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from fovea.operators import states


def rows_of(n=900, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.random((6, 4)) * 4
    return middle[rng.integers(6, size=n)] + rng.normal(scale=0.35, size=(n, 4))


def test_cost_is_at_most_that_of_separate_fits(spark):
    x = rows_of()
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(5).cache()
    centroids, cost = states.fit_states(frame, 5, n_starts=20)
    vectors = frame.select(array_to_vector("features").alias("features")).cache()
    separate = min(KMeans(k=5, seed=42 + s, maxIter=50).fit(vectors).summary.trainingCost for s in range(20))
    assert cost <= separate * (1 + 1e-4)
    c = np.array([r.features for r in centroids.collect()])
    near = ((x[:, None] - c[None]) ** 2).sum(2)
    assert near.min(1).sum() == pytest.approx(cost)
    for k in range(5):
        assert np.allclose(x[near.argmin(1) == k].mean(0), c[k], atol=1e-2)
    assert c.tolist() == sorted(c.tolist())


def test_sums_of_one_job_equal_the_definition(spark):
    x = rows_of(300, 2)
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(7)
    centers = states.seed_centers(x, 3, 4, 1)
    sums, counts, cost = states.lloyd_sums(frame, centers)
    for s in range(4):
        near = ((x[:, None] - centers[s][None]) ** 2).sum(2)
        for k in range(3):
            assert counts[s, k] == (near.argmin(1) == k).sum()
            assert np.allclose(sums[s, k], x[near.argmin(1) == k].sum(0))
        assert cost[s] == pytest.approx(near.min(1).sum())


def test_fewer_different_rows_than_states(spark):
    frame = spark.createDataFrame([([1.0, 2.0],)] * 5 + [([3.0, 4.0],)], "features array<double>")
    centroids, cost = states.fit_states(frame, 4, n_starts=3)
    assert centroids.count() == 4 and cost == pytest.approx(0)
    with pytest.raises(ValueError):
        states.fit_states(frame.where("false"), 2)


def test_many_copies_of_few_rows(spark):
    """Copies of one row must not fill the rows that the starts are drawn from, and travel as one."""
    base = [[float(i == j) for j in range(4)] for i in range(4)] + [[0.5, 0.5, 0.0, 0.0], [0.0, 0.0, 0.5, 0.5]]
    copies = [5000, 6000, 7000, 5000, 4500, 9000]
    one = spark.createDataFrame(list(zip(base, copies)), "features array<double>, n int")
    frame = one.selectExpr("explode(array_repeat(features, n)) AS features")
    centroids, cost = states.fit_states(frame, 6, n_starts=20)
    assert cost == pytest.approx(0) and sorted(map(list, base)) == [r.features for r in centroids.orderBy("state_id").collect()]
    counted = states.row_counts(frame)
    assert counted.count() == 6
    again = states.fit_states(counted, 6, n_starts=20)
    assert again[1] == pytest.approx(cost) and again[0].collect() == centroids.collect()
