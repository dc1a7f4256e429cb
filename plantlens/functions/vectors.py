"""Vector columns (``array<float>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector is left as it is."""
    norm = l2_norm(v)
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    # The one-element array binds the norm once instead of once per vector element.
    scaled = F.transform(F.array(safe), lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float")))
    return F.element_at(scaled, 1)
