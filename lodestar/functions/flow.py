"""Flow matching arithmetic on feature arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(a, lambda x: x * k)


def diffuse(x0: Column, noise: Column, t: Column, s: float) -> Column:
    """(1 - t) x0 + (s + (1 - s) t) noise"""
    return F.zip_with(x0, noise, lambda x, e: (1 - t) * x + (F.lit(s) + (1 - s) * t) * e)


def velocity(x0: Column, noise: Column, s: float) -> Column:
    return F.zip_with(x0, noise, lambda x, e: (1 - s) * e - x)


def recovered_x0(xt: Column, v: Column, t: Column, s: float) -> Column:
    """x0 from a place on the way and the velocity there."""
    return F.zip_with(xt, v, lambda x, w: (1 - s) * x - (F.lit(s) + (1 - s) * t) * w)


def guided(pos: Column, neg: Column, g: Column) -> Column:
    """g pos + (1 - g) neg; strengths of 1 and 0 take one side as it is."""
    return F.when(g == 1, pos).when(g == 0, neg).otherwise(F.zip_with(pos, neg, lambda p, n: g * p + (1 - g) * n))


def gate(t: Column, low: float, high: float, g: float) -> Column:
    """The guidance strength inside an interval of t, else 1."""
    return F.when(t.between(low, high), F.lit(float(g))).otherwise(F.lit(1.0))


def schedule(i: Column, steps: int, rescale: float) -> Column:
    """The i-th of steps + 1 times from 1 to 0, warped: r u / (1 + (r - 1) u)."""
    u = 1 - i / F.lit(float(steps))
    return rescale * u / (1 + (rescale - 1) * u)


def euler(x: Column, v: Column, t: Column, t_prev: Column) -> Column:
    return F.zip_with(x, v, lambda a, b: a - (t - t_prev) * b)


def logit_normal(normal: Column, mean: float, std: float) -> Column:
    return 1 / (1 + F.exp(-(normal * std + mean)))


def sinusoidal(t: Column, dim: int, period: float = 10_000.0, cos_first: bool = True) -> Column:
    half = dim // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: t * F.exp(F.lit(-math.log(period)) * i / half))
    c, s = F.transform(angles, F.cos), F.transform(angles, F.sin)
    return F.concat(c, s) if cos_first else F.concat(s, c)


def warm_up(step: Column, steps: int) -> Column:
    return F.when(step < steps, (step + 1) / F.lit(float(steps))).otherwise(1.0)


def memory_ratio(available: Column, target: float, k: Column, b: Column, n: Column, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0.0), (available * target - b) / (k * n)))


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once a row; inside a lambda it would be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sample_std(a: Column) -> Column:
    """Standard deviation with n - 1 in the denominator."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    around = lambda v, mean: F.sqrt(total(F.transform(v, lambda x: (x - mean) * (x - mean))) / (F.size(v) - 1))
    return bound(a, lambda v: bound(total(v) / F.size(v), lambda mean: around(v, mean)))


def guided_rescaled(xt: Column, pos: Column, neg: Column, g: Column, t: Column, s: float, share: float) -> Column:
    """`guided`, then x0 brought `share` of the way to the spread it has without guidance. Strengths of 1 and 0 stay as they are."""
    mixed = guided(pos, neg, g)
    spread = share * sample_std(recovered_x0(xt, pos, t, s))
    back = lambda x0, factor: F.zip_with(xt, x0, lambda x, y: ((1 - s) * x - y * factor) / (F.lit(s) + (1 - s) * t))
    rescaled = bound(recovered_x0(xt, mixed, t, s), lambda x0: bound(spread / sample_std(x0) + (1 - share), lambda factor: back(x0, factor)))
    return F.when((g == 1) | (g == 0), mixed).otherwise(rescaled)


def rotary(feats: Column, at: list[Column], width: int, scale: float = 1.0, period: float = 10_000.0) -> Column:
    """Neighbouring pairs of a head of `width` features turned by phases of its coordinates.

    Each axis has width // 2 // axes frequencies, scale / period**(i / their number); pairs left over aren't turned.
    """
    n = width // 2 // len(at)
    axes = F.array(*(a.cast("double") for a in at))
    phase = lambda j: F.when(j < n * len(at), F.get(axes, F.floor(j / n).cast("int")) * scale / F.pow(F.lit(period), (j % n) / n)).otherwise(0.0)

    turn = lambda x, y, p: F.array(x * F.cos(p) - y * F.sin(p), x * F.sin(p) + y * F.cos(p))
    pairs = F.sequence(F.lit(0), F.lit(width // 2 - 1))
    return bound(feats, lambda f: F.flatten(F.transform(pairs, lambda j: bound(phase(j), lambda p: turn(F.get(f, 2 * j), F.get(f, 2 * j + 1), p)))))
