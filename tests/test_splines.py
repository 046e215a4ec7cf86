"""Splines at any parameter."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkdraw.functions import geometry as G

SCHEMA = "i int, degree int, knots array<double>, control_points array<struct<x:double,y:double>>, weights array<double>, t double"


def quarter(i, t, weights=(1.0, math.sqrt(0.5), 1.0), points=((1.0, 0.0), (1.0, 1.0), (0.0, 1.0))):
    return (i, 2, [0.0, 0.0, 0.0, 1.0, 1.0, 1.0], list(points), None if weights is None else list(weights), t)


def test_rational_quarter_circle(spark):
    """Every point is on the circle; the ends are the ends; outside there is nothing."""
    at = [0.0, 0.2, 0.5, 0.9, 1.0, -0.1, 1.1, None]
    rows = [quarter(i, t) for i, t in enumerate(at)] + [quarter(20, 0.5, None), quarter(21, 0.5, points=[(1.0, 0.0), None, (0.0, 1.0)]), quarter(22, 0.5, (0.0, 0.0, 0.0)), quarter(23, 0.5, (1.0, 2.0))]
    got = {r.i: r.p for r in spark.createDataFrame(rows, SCHEMA).select("i", G.evaluate(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(at[:5]):
        assert math.isclose(math.hypot(*got[i]), 1.0, rel_tol=1e-12)
    assert tuple(got[0]) == (1.0, 0.0) and tuple(got[4]) == (0.0, 1.0)
    assert np.allclose(tuple(got[2]), (math.sqrt(0.5), math.sqrt(0.5))) and tuple(got[20]) == (0.75, 0.75)
    assert all(got[i] is None for i in (5, 6, 7, 21, 22, 23))


def test_agrees_with_one_spline_at_many_parameters():
    rng = np.random.default_rng(3)
    for degree in (1, 2, 3, 5):
        n = degree + 4
        knots = np.sort(rng.integers(0, 6, n + degree + 1)).astype(float)
        if knots[degree] == knots[n]:
            continue
        c, w = rng.random((n, 2)), rng.random(n) + 0.5
        at = np.linspace(knots[degree], knots[n], 23)[:-1]
        one = G.spline_points(degree, knots, c, at, w)
        many = G.spline_values(degree, np.tile(knots, (len(at), 1)), np.tile(c, (len(at), 1, 1)), np.tile(w, (len(at), 1)), at)
        assert np.allclose(one, many)
