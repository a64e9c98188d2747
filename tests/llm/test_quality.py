"""Quality learns from every labelled row, however many and however rare."""

import numpy as np
import pytest

from loomgraph.llm import quality


@pytest.mark.parametrize("good", [9000, 3])
def test_all_labelled_rows_are_learnt_from(spark, good):
    rng, n = np.random.default_rng(4), 9500
    label = (np.arange(n) < good).astype(int)
    x = rng.normal(size=(n, len(quality.FEATURES)))
    x[:, 0] += 1.5 * label
    rows = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "doc_id long, label int, x array<double>").repartition(3)
    model = quality.learn(rows)
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    order, k = np.sort(model.raw(x)), n - good
    assert model.cut == pytest.approx((order[k - 1] + order[k]) / 2, rel=1e-6)
    assert model.weights[0] > 0.5
    assert np.array_equal(model.weights, quality.learn(rows.repartition(5)).weights)


def test_each_row_is_in_a_pair():
    z, label = np.eye(101), np.array([1] + [0] * 100)
    assert (quality.differences(z, label, 1) != 0).any(axis=0).all()
