"""Aesthetic scores from vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumika.functions.vectors import products


def prompt_centroid(vectors: np.ndarray) -> np.ndarray:
    """Mean of encoded prompts, of unit length."""
    mean = np.asarray(vectors, np.float64).mean(axis=0)
    return mean / (np.linalg.norm(mean) + 1e-12)


def scale(raw: Column) -> Column:
    """5.5 at no difference, 1 point for 1/30 of it, between 1 and 10."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), 5.5 + 30 * raw))


def scores(vectors: DataFrame, positive: np.ndarray, negative: np.ndarray) -> DataFrame:
    """(photo_id, aesthetic): the scaled difference of the similarities to the two centroids, unrounded."""
    gap = products(vectors, "photo_id", np.stack([positive - negative]), ["gap"])
    return gap.select("photo_id", scale(F.col("similarity")).alias("aesthetic")).dropDuplicates(["photo_id"])


def unscored(photo: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of the photos that have no score yet."""
    return vectors.join(photo.where("aesthetic is null").select(F.col("id").alias("photo_id")), "photo_id", "left_semi")


def rating(aesthetic: Column) -> Column:
    """0 to 5 stars: half the score, rounded half to even; none without a score."""
    return F.when(aesthetic.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.rint(aesthetic / 2)))).cast("int")
