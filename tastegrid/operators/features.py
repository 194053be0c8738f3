"""Multimodal item features as vector tables ``(id, vec)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.ratios import ratio
from tastegrid.functions.vectors import mean_vector


def impute_mean(vectors: DataFrame, items: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of every item, the mean vector where there is none, and the ids that had none."""
    ids = items.select(F.col("item").alias("id"))
    known = vectors.join(ids, "id", "left_semi")
    mean = mean_vector(known, "vec", dim).scalar()
    filled = ids.join(known, "id", "left").select("id", F.coalesce("vec", mean).alias("vec"))
    return filled, ids.join(known, "id", "left_anti")


def overlay_imputed(vectors: DataFrame, missing: DataFrame, imputed: DataFrame) -> DataFrame:
    """Imputed vectors in place of those of the missing ids."""
    replaced = missing.select("id").withColumn("_m", F.lit(True))
    new = imputed.select("id", F.col("vec").alias("_new"))
    rows = vectors.join(replaced, "id", "left").join(new, "id", "left")
    return rows.select("id", F.when(F.col("_m"), F.coalesce("_new", "vec")).otherwise(F.col("vec")).alias("vec"))


def fuse(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """concat, sum, mul or mean of two vectors per id; the last three raise on unequal lengths."""
    rows = a.select("id", F.col("vec").alias("x")).join(b.select("id", F.col("vec").alias("y")), "id")
    if how == "concat":
        return rows.select("id", F.concat("x", "y").alias("vec"))
    ops = {"sum": lambda x, y: x + y, "mul": lambda x, y: x * y, "mean": lambda x, y: (x + y) / 2}
    equal = F.size("x") == F.size("y")
    both = F.when(equal, F.zip_with("x", "y", ops[how])).otherwise(F.raise_error(F.lit("vectors differ in length")))
    return rows.select("id", both.alias("vec"))


def minmax_normalise(vec: str = "vec") -> Column:
    """Elements between 0 and 1; all 0 for a constant vector."""
    low, high = F.array_min(vec), F.array_max(vec)
    return F.transform(vec, lambda x: ratio(x - low, high - low, 0.0))


def zscore(mean: Sequence[float], std: Sequence[float], vec: str = "vec") -> Column:
    """Per dimension, with given means and deviations; 0 where the deviation is 0."""
    def numbers(values: Sequence[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    centred = F.zip_with(F.col(vec), numbers(mean), lambda x, m: x - m)
    return F.zip_with(centred, numbers(std), lambda x, s: ratio(x, s, 0.0))


def dimension_moments(vectors: DataFrame, dim: int) -> DataFrame:
    """One row: arrays of the mean and population deviation of each dimension."""
    both = Summarizer.metrics("mean", "variance").summary(array_to_vector(F.col("vec").cast("array<double>")))
    row = vectors.where("vec IS NOT NULL").agg(both.alias("m"), F.count(F.lit(1)).alias("n"))
    population = F.transform(vector_to_array("m.variance"), lambda v: F.sqrt(v * (F.col("n") - 1) / F.greatest("n", F.lit(1))))
    return row.select(vector_to_array("m.mean").alias("mean"), population.alias("std"))


def concat_modalities(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both vectors in a row, or whichever there is."""
    rows = a.select("id", F.col("vec").alias("x")).join(b.select("id", F.col("vec").alias("y")), "id", "full_outer")
    empty = F.array().cast("array<double>")
    return rows.select("id", F.concat(F.coalesce("x", empty), F.coalesce("y", empty)).alias("vec"))


def remap_embeddings(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors under dense ids ``(item, idx)``."""
    return vectors.join(ids.select(F.col("item").alias("id"), "idx"), "id").select(F.col("idx").alias("id"), "vec")


def word_vectors(vocabulary: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(word, vec): the word's vector, or the mean of all vectors."""
    mean = mean_vector(vectors, "vec", dim).scalar()
    return vocabulary.join(vectors, "word", "left").select("word", F.coalesce("vec", mean).alias("vec"))
