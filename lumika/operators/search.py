"""Nearest-neighbour search by a stored, an encoded or a given vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.functions.vectors import nearest, one_vector
from lumika.sources.hooks import Encode, normalise

SHOWN = ("path", "captured_at", "thumb_small")


def _ranked(near: DataFrame, photo: DataFrame) -> DataFrame:
    """The top list first, then the photos: a vector without a photo shortens the result instead of making room for another."""
    rows = photo.join(F.broadcast(near.select("photo_id")), photo["id"] == near["photo_id"], "left_semi")
    shown = rows.select(F.col("id").alias("photo_id"), *SHOWN).dropDuplicates(["photo_id"])
    score = F.greatest(F.lit(0.0), 1 - 0.5 * F.col("distance"))
    return F.broadcast(near).join(shown, "photo_id").select("photo_id", *SHOWN, "distance", score.alias("score")).orderBy("distance", "photo_id")


def _empty(photo: DataFrame) -> DataFrame:
    return photo.limit(0).select(F.col("id").alias("photo_id"), *SHOWN, F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"))


def by_vector(photo: DataFrame, vectors: DataFrame, query: np.ndarray, limit: int = 50, metric: str = "l2") -> DataFrame:
    """Photos by distance of their vector; score is 1 less half the distance, at least 0."""
    return _ranked(nearest(vectors, "photo_id", query, limit, metric), photo)


def similar(photo: DataFrame, vectors: DataFrame, photo_id: int, limit: int = 50, metric: str = "l2", dim: int = 768) -> DataFrame:
    """The photos most like a given one, itself left out; without a vector of its own there are none."""
    query = one_vector(vectors, "photo_id", photo_id, dim)
    if query is None:
        return _empty(photo)
    return _ranked(nearest(vectors.where(F.col("photo_id") != photo_id), "photo_id", query, limit, metric), photo)


def by_text(photo: DataFrame, vectors: DataFrame, text: str, encode: Callable[[str], np.ndarray], limit: int = 50) -> DataFrame:
    """Photos for a text, encoded by the given model; a blank text finds nothing."""
    return by_vector(photo, vectors, encode(text), limit) if text and text.strip() else _empty(photo)


def by_image(photo: DataFrame, vectors: DataFrame, content: bytes, load: Callable[[], Encode], limit: int = 50) -> DataFrame:
    """Photos like a picture that need not be in the catalog, given as the bytes of its file; one the model can't read finds nothing."""
    if not content:
        return _empty(photo)
    query = np.asarray(load()([content]), np.float32)
    if query.shape[0] != 1 or not np.isfinite(query).all() or not query.any():
        return _empty(photo)
    return by_vector(photo, vectors, normalise(query)[0], limit)
