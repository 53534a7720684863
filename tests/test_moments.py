"""Means and deviations are the correctly rounded ones, whatever the order of rows and the number of tasks."""

from fractions import Fraction

import numpy as np

from assay.operators import features as fe


def test_last_digit(spark):
    x = np.random.default_rng(11).normal(0.3, 0.125, (400, 12)).astype(np.float32).astype(float)
    x[:, 0] += 1000.0
    x[:, 1] = 0.1
    d = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>")
    mean = [float(sum(map(Fraction, c)) / len(x)) for c in x.T]
    var = [sum((Fraction(v) - sum(map(Fraction, c)) / len(x)) ** 2 for v in c) / len(x) for c in x.T]
    sd = [float(np.sqrt(np.longdouble(v.numerator) / np.longdouble(v.denominator))) for v in var]
    for tasks in (1, 7):
        n, m, s = fe.column_moments(d.repartition(tasks))
        assert n == 400 and m.tolist() == mean and s.tolist() == sd
