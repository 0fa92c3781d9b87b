"""Vector column expressions (higher-order functions, JVM-side) and
their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Inner product in double precision."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_norm_sql(a: str) -> str:
    return f"sqrt({dot_sql(a, a)})"


def l2_normalize(a) -> Column:
    """Divide by the L2 norm; a zero vector stays zero."""
    # the norm is bound once for each row, not once for each element
    scaled = F.transform(F.array(l2_norm(a)), lambda n: F.transform(
        _c(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)))
    return F.get(scaled, F.lit(0))


def l2_normalize_sql(a: str) -> str:
    n = l2_norm_sql(a)
    return f"list_transform({a}::DOUBLE[], lambda x: CASE WHEN {n} = 0 THEN 0.0 ELSE x / {n} END)"
