"""Registry of this subpackage's queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: One word of a text, as Java, Python and RE2 all read it.
WORD = r"[^\x20\x09-\x0D]+"
#: What lies between words.
GAP = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, **others: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, next to ``others``: no name of a document clashes with a working one."""
    return docs.select(F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in others.items()])


def unboxed(rows: DataFrame, columns: list[str], **others: Column) -> list[Column]:
    """The ``columns`` out of the struct again, those named in ``others`` replaced or added."""
    return [others.get(c, F.col("row").getField(c)).alias(c) for c in columns] + [c.alias(n) for n, c in others.items() if n not in columns]
