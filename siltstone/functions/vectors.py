"""Functions of array columns, in double precision."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, or either vector is empty or zero."""
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fit, F.try_divide(dot(a, b), norm(a) * norm(b))).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def gauss_planes(dim: int, n: int = 8, seed: int = 42) -> list[list[float]]:
    rng = random.Random(seed)
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def normal_planes(dim: int, n: int = 16, seed: int = 42) -> list[list[float]]:
    return np.random.default_rng(seed).standard_normal((n, dim)).tolist()


def literal(planes: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in planes])


def signature(v: Column, planes: list[list[float]]) -> Column:
    """A character per plane: 1 on its side or on it."""
    return F.concat(*[F.when(dot(v, F.array(*[F.lit(float(x)) for x in p])) >= 0, "1").otherwise("0") for p in planes])


def bucket(v: Column, planes: list[list[float]]) -> Column:
    """A bit per plane, set strictly on its side."""
    bits = [F.when(dot(v, F.array(*[F.lit(float(x)) for x in p])) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out.cast("int")


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / total(e))


def argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(p: Column, floor: float = 1e-12) -> Column:
    return -total(F.transform(p, lambda x: F.greatest(x, F.lit(floor)) * F.log(F.greatest(x, F.lit(floor)))))
