"""Plane geometry as Column builders: points, angles, affine maps, and spline evaluation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAU = 2 * math.pi
AFFINE = ("a", "b", "c", "d", "tx", "ty")
#: Names of colours and line types by code.
COLORS = ("black", "red", "green", "yellow", "blue", "magenta", "cyan", "white")
LINETYPES = (
    "solid", "dashed", "dotted", "dot_center", "dash_dot_dot", "long_dashed", "dash_center", "phantom", "legacy_phantom", "short_dash", "center_dash_dash", "long_dash_short_dash", "long_dash_two_short_dash",
)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(q.x - p.x, q.y - p.y)


def angle(origin: Column, p: Column) -> Column:
    """Direction from origin to p, in [0, 2 pi)."""
    return F.pmod(F.atan2(p.y - origin.y, p.x - origin.x), F.lit(TAU))


def _name(code: Column, names: tuple[str, ...]) -> Column:
    return F.when(code.between(0, len(names) - 1), F.get(F.array(*map(F.lit, names)), code.cast("int")))


def color_name(code: Column) -> Column:
    return _name(code, COLORS)


def linetype_name(code: Column) -> Column:
    return _name(code, LINETYPES)


def affine(a, b, c, d, tx, ty) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip(AFFINE, (a, b, c, d, tx, ty), strict=True)])


def identity() -> Column:
    return affine(1, 0, 0, 1, 0, 0)


def is_affine(values: Column) -> Column:
    """Whether nine numbers end in a row near (0, 0, 1)."""
    at = lambda i: F.get(values, F.lit(i))
    near_one = F.abs(at(8) - 1) <= F.greatest(F.greatest(F.abs(at(8)), F.lit(1.0)) * 1e-9, F.lit(1e-12))
    return F.coalesce((F.size(values) == 9) & (F.abs(at(6)) <= 1e-12) & (F.abs(at(7)) <= 1e-12) & near_one, F.lit(False))


def from_values(values: Column) -> Column:
    """The map of nine row-major numbers, or null."""
    at = lambda i: F.get(values, F.lit(i))
    return F.when(is_affine(values), affine(at(0), at(3), at(1), at(4), at(2), at(5)))


def to_values(m: Column) -> Column:
    return F.array(m.a, m.c, m.tx, m.b, m.d, m.ty, F.lit(0.0), F.lit(0.0), F.lit(1.0))


def apply(m: Column, p: Column) -> Column:
    return point(m.a * p.x + m.c * p.y + m.tx, m.b * p.x + m.d * p.y + m.ty)


def apply_vector(m: Column, v: Column) -> Column:
    return point(m.a * v.x + m.c * v.y, m.b * v.x + m.d * v.y)


def compose(m: Column, n: Column) -> Column:
    """m after n."""
    return affine(
        m.a * n.a + m.c * n.b, m.b * n.a + m.d * n.b, m.a * n.c + m.c * n.d, m.b * n.c + m.d * n.d, m.a * n.tx + m.c * n.ty + m.tx, m.b * n.tx + m.d * n.ty + m.ty
    )


def determinant(m: Column) -> Column:
    return m.a * m.d - m.b * m.c


def mirrored(m: Column) -> Column:
    return determinant(m) < 0


def inverse(m: Column) -> Column:
    """Null where the determinant is within 1e-15 of zero."""
    k = determinant(m)
    return F.when(F.abs(k) > 1e-15, affine(m.d / k, -m.b / k, -m.c / k, m.a / k, (m.c * m.ty - m.d * m.tx) / k, (m.b * m.tx - m.a * m.ty) / k))


def spline_points(degree: int, knots: np.ndarray, controls: np.ndarray, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray | None:
    """Points of a spline at parameters ``at`` (all at once); None outside the domain or at a zero weight."""
    n = len(controls)
    if n <= degree or len(knots) != n + degree + 1 or (at < knots[degree]).any() or (at > knots[n]).any():
        return None
    span = np.clip(np.searchsorted(knots, at, "right") - 1, degree, n - 1)
    span = np.where(at == knots[n], n - 1, span)
    w = np.ones(n) if weights is None else weights
    h = np.column_stack([controls * w[:, None], w])
    work = h[span[:, None] - degree + np.arange(degree + 1)]
    for level in range(1, degree + 1):
        k = span[:, None] - degree + np.arange(level, degree + 1)
        low, high = knots[k], knots[k + degree - level + 1]
        wide = high != low
        alpha = np.where(wide, (at[:, None] - low) / np.where(wide, high - low, 1.0), 0.0)[:, :, None]
        work[:, level:] = (1 - alpha) * work[:, level - 1 : -1] + alpha * work[:, level:]
    last = work[:, -1]
    if (np.abs(last[:, 2]) <= 1e-15).any():
        return None
    return last[:, :2] / last[:, 2:]


def spline_values(degree: int, knots: np.ndarray, controls: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A point for each of several splines of one degree and size, each at a parameter of its own; NaN outside its domain or at a zero weight."""
    rows, n = np.arange(len(at)), controls.shape[1]
    inside = (at >= knots[:, degree]) & (at <= knots[:, n])
    span = np.clip((knots <= at[:, None]).sum(axis=1) - 1, degree, n - 1)
    # At the end of the domain the last span that is not empty counts.
    end = at == knots[:, n]
    span = np.where(end, np.clip((knots < at[:, None]).sum(axis=1) - 1, degree, n - 1), span)
    h = np.concatenate([controls * weights[:, :, None], weights[:, :, None]], axis=2)
    work = h[rows[:, None], span[:, None] - degree + np.arange(degree + 1)]
    for level in range(1, degree + 1):
        k = span[:, None] - degree + np.arange(level, degree + 1)
        low, high = knots[rows[:, None], k], knots[rows[:, None], k + degree - level + 1]
        wide = high != low
        alpha = np.where(wide, (at[:, None] - low) / np.where(wide, high - low, 1.0), 0.0)[:, :, None]
        work[:, level:] = (1 - alpha) * work[:, level - 1 : -1] + alpha * work[:, level:]
    last = work[:, -1]
    good = inside & (np.abs(last[:, 2]) > 1e-15)
    return np.where(good[:, None], last[:, :2] / np.where(good, last[:, 2], 1.0)[:, None], np.nan)


def _array(values) -> np.ndarray | None:
    """Numbers of an array column's value; null if it is or has null."""
    if values is None or pd.isna(np.asarray(values, object)).any():
        return None
    return np.asarray(values, float)


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _evaluated(degree: pd.Series, knots: pd.Series, xs: pd.Series, ys: pd.Series, weights: pd.Series, at: pd.Series) -> pd.DataFrame:
    out = np.full((len(at), 2), np.nan)
    groups: dict[tuple[int, int], list] = {}
    for i, (d, k, x, y, w, t) in enumerate(zip(degree, knots, xs, ys, weights, at, strict=True)):
        k, x, y, w = _array(k), _array(x), _array(y), np.ones(0) if w is None else _array(w)
        if k is None or x is None or y is None or w is None or pd.isna(d) or pd.isna(t) or len(x) <= d or len(k) != len(x) + d + 1 or len(w) not in (0, len(x)):
            continue
        groups.setdefault((int(d), len(x)), []).append((i, k, np.column_stack([x, y]), w if len(w) else np.ones(len(x)), t))
    for (d, _), rows in groups.items():
        at_, k, c, w, t = zip(*rows, strict=True)
        out[list(at_)] = spline_values(d, np.stack(k), np.stack(c), np.stack(w), np.array(t, float))
    return pd.DataFrame({"x": out[:, 0], "y": out[:, 1]})


def evaluate(parameter: Column, degree: str = "degree", knots: str = "knots", points: str = "control_points", weights: str | None = "weights") -> Column:
    """The point of a spline at a parameter; null outside its domain, with a control point missing, or at a zero weight.

    Rows of one degree and size are evaluated together. Without weights, or with null ones, the spline is not rational.
    """
    w = F.col(weights) if weights else F.lit(None).cast("array<double>")
    made = _evaluated(F.col(degree), F.col(knots), F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]), w, parameter.cast("double"))
    return F.transform(F.array(made), lambda p: F.when(~F.isnan(p["x"]) & p["x"].isNotNull(), p))[0]


@F.pandas_udf(T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.DoubleType()))]))
def _sampled(degree: pd.Series, knots: pd.Series, xs: pd.Series, ys: pd.Series, weights: pd.Series, segments: pd.Series) -> pd.DataFrame:
    out = []
    for d, k, x, y, w, n in zip(degree, knots, xs, ys, weights, segments, strict=True):
        points = None
        if k is not None and x is not None and not pd.isna(np.asarray(x, object)).any() and not pd.isna(np.asarray(y, object)).any():
            k, c = np.asarray(k, float), np.column_stack([np.asarray(x, float), np.asarray(y, float)])
            at = k[d] + (k[len(c)] - k[d]) * np.arange(n + 1) / n
            points = spline_points(int(d), k, c, np.minimum(at, k[len(c)]), None if w is None else np.asarray(w, float))
        out.append((None, None) if points is None else (points[:, 0], points[:, 1]))
    return pd.DataFrame({"x": pd.Series([x for x, _ in out], dtype=object), "y": pd.Series([y for _, y in out], dtype=object)})


def spline_samples(degree, knots, xs, ys, segments, weights=None) -> Column:
    """segments + 1 points over the domain; null if a control point is missing."""
    both = _sampled(degree, knots, xs, ys, F.lit(None).cast("array<double>") if weights is None else weights, segments)
    return F.arrays_zip(both["x"].alias("x"), both["y"].alias("y"))
