"""Mean and deviation over all values of a block are the correctly rounded ones, not put together from rounded columns."""

from fractions import Fraction

import numpy as np

from assay.operators import features as fe


def test_last_digit_of_blocks(spark):
    x = np.random.default_rng(17).normal(0.3, 0.125, (300, 48)).astype(np.float32).astype(float)
    d = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    rep = fe.fit_representation(d.repartition(5), "per_block", dims=[16, 32])
    for block in (slice(0, 16), slice(16, 48)):
        values = [Fraction(v) for v in x[:, block].ravel()]
        mean = sum(values) / len(values)
        variance = sum((v - mean) ** 2 for v in values) / len(values)
        assert set(rep.mean[block]) == {float(mean)}
        assert set(rep.sd[block]) == {float(np.sqrt(np.longdouble(variance.numerator) / np.longdouble(variance.denominator)))}
