"""Division that does not end a job: Spark's ANSI mode raises on a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN = float("nan")


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """``a / b``; ``empty`` where ``b`` is 0 (null by default). A null side gives ``empty`` as well."""
    return F.coalesce(F.try_divide(a, b), F.lit(empty).cast("double"))
