"""Vector functions over array columns; sums are taken in double precision, in array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def gaussian_kl(mu_q: Column, var_q: Column, mu_p: Column, var_p: Column) -> Column:
    """KL divergence of diagonal Gaussians q and p."""
    both = F.arrays_zip(mu_q.alias("mq"), var_q.alias("vq"), mu_p.alias("mp"), var_p.alias("vp"))
    term = lambda z: F.log(z["vp"]) - F.log(z["vq"]) + (z["vq"] + (z["mq"] - z["mp"]) * (z["mq"] - z["mp"])) / z["vp"] - 1.0
    return F.lit(0.5) * total(F.transform(both, term))
