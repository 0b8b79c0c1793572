import random

import numpy as np
import pytest

from tessel.operators.quantiles import exact_quantiles, quantile_values

QS = [0, 0.01, 0.25, 0.5, 0.5, 0.9, 0.99, 1]


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_against_sorting(spark, buckets):
    r = random.Random(3)
    values = [r.gauss(0, 1) for _ in range(3000)] + [0.25] * 500 + [1e-310, -1e-310, 1.7e308, -1.7e308, float("nan"), None]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, part int").repartition(3)
    real = [v for v in values if v is not None and v == v]
    assert quantile_values(df, "v", QS, buckets) == pytest.approx(np.quantile(real, QS), rel=1e-12)


def test_few_values(spark):
    one = spark.createDataFrame([(5,)], "n long")
    assert quantile_values(one, "n", [0, 0.3, 1]) == [5.0, 5.0, 5.0]
    assert [tuple(r) for r in exact_quantiles(one.limit(0), "n", [0.5]).collect()] == [(0.5, None)]
    two = spark.createDataFrame([(1,), (2,)], "n long")
    assert quantile_values(two, "n", [0.25]) == [1.25]
