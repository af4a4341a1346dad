"""Vector and numeric column expressions; sums run in double and in order, so results repeat exactly."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_scalar(xs: Column, scalar: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(x, scalar) of each element; unlike in a lambda, the scalar is worked out once a row."""
    return F.zip_with(xs, F.array_repeat(scalar, F.size(xs)), f)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of equal length."""
    terms = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def unit(v: Column | str, floor: bool = True) -> Column:
    """V over max(length, 1e-12), or over length + 1e-12 without ``floor``."""
    n = F.greatest(norm(v), F.lit(EPS)) if floor else norm(v) + EPS
    return with_scalar(_c(v), n, lambda x, y: x.cast("double") / y)


def clip(x: Column, low: float, high: float) -> Column:
    """P12."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine, within [-1, 1]; 0 if a vector is zero."""
    return clip(dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS)), -1.0, 1.0)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, within [0, 2]."""
    return clip(F.lit(1.0) - cosine(a, b), 0.0, 2.0)


def total(xs: Column | str) -> Column:
    """Sum of an array of doubles, in order."""
    return F.aggregate(_c(xs), F.lit(0.0), lambda s, x: s + x)


def softmax(xs: Column | str, temperature: float) -> Column:
    """Shares by exp(x / temperature), stable; by x itself if the temperature isn't positive."""
    xs = _c(xs)
    if temperature <= 0:
        return with_scalar(xs, total(xs) + EPS, lambda x, t: x / t)
    e = with_scalar(xs, F.array_max(xs), lambda x, top: F.exp((x - top) / temperature))
    return with_scalar(e, total(e) + EPS, lambda x, t: x / t)


def entropy(ps: Column | str) -> Column:
    """Shannon entropy in nats of an array of shares."""
    return -total(F.transform(_c(ps), lambda p: p * F.ln(p + EPS)))


def npmi(pi: Column, pj: Column, pij: Column) -> Column:
    """Normalised pointwise mutual information; -1 if a probability is 0 or the pair's is 1."""
    low = -F.ln(pij + EPS)
    none = (pi <= 0) | (pj <= 0) | (pij <= 0) | (low <= 0)
    return F.when(none, -1.0).otherwise(F.ln(F.when(none, 1.0).otherwise(pij / (pi * pj)) + EPS) / F.when(none, 1.0).otherwise(low))


def erf(x: Column, terms: int = 120) -> Column:
    """The error function by its series of positive terms; 1 in size beyond 6."""
    a = F.least(F.abs(x), F.lit(6.0))
    start = F.struct(a.alias("term"), a.alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * a * a / (2 * n + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step)["sum"]
    return F.signum(x) * F.least(F.lit(2 / math.sqrt(math.pi)) * F.exp(-a * a) * series, F.lit(1.0))


def two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal z."""
    return clip(F.lit(1.0) - erf(F.abs(z) / math.sqrt(2)), 0.0, 1.0)
