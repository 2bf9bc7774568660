"""Dense vectors as ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector has no direction and stays zero."""
    vector = _col(v)
    return let(
        norm(vector),
        lambda n: F.transform(
            vector, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)
        ),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
