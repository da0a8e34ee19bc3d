"""Vectors in list columns: decoding in bulk, and ranking by distance as partial top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(column: pa.Array, ids: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of the rows of a list column that have an id and `dim` finite values, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    have = ids.is_valid().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fine = np.flatnonzero((sizes == dim) & have)
    flat = column.take(pa.array(fine)).flatten().to_numpy(zero_copy_only=False)
    x = np.asarray(flat, np.float32).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids.take(pa.array(fine[good])).to_numpy(zero_copy_only=False).astype(np.int64), np.ascontiguousarray(x[good])


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow on the way to the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((x.astype(np.float64) - query) ** 2).sum(axis=1))
    return 1.0 - unit(x) @ unit(query[None, :])[0]


def nearest(vectors: DataFrame, key: str, query: np.ndarray, k: int, metric: str = "l2") -> DataFrame:
    """(key, distance): the k nearest usable vectors of `vectors(key, embedding)`; the smaller key wins ties.

    Every task keeps only its own k nearest, so no more than k rows a task are ranked at the end. Unusable vectors are
    left out, repeated rows count once, an empty table gives an empty result.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be l2 or cosine")
    if k < 0:
        raise ValueError("k must not be negative")
    query = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            own, x = clean(batch.column(1), batch.column(0), len(query))
            ids, best = np.concatenate([ids, own]), np.concatenate([best, distances(x, query, metric)])
            ids, first = np.unique(ids, return_index=True)
            best = best[first]
            keep = np.lexsort((ids, best))[:k]
            ids, best = ids[keep], best[keep]
        yield pa.record_batch([pa.array(ids), pa.array(best)], names=[key, "distance"])

    near = vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(run, f"`{key}` long, distance double")
    return near.dropDuplicates([key]).orderBy("distance", key).limit(k)


def products(vectors: DataFrame, key: str, targets: np.ndarray, names: list[str]) -> DataFrame:
    """(key, name, similarity): inner product of every usable vector with each target, by matrix products over batches."""
    targets = np.asarray(targets, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                ids, x = clean(part.column(1), part.column(0), targets.shape[1])
                s = x.astype(np.float64) @ targets.T
                yield pa.record_batch([pa.array(np.repeat(ids, len(names))), pa.array(names * len(ids), pa.string()), pa.array(s.ravel())], names=[key, "name", "similarity"])

    return vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(run, f"`{key}` long, name string, similarity double")


def one_vector(vectors: DataFrame, key: str, value: int, dim: int) -> np.ndarray | None:
    """The usable vector of one key, or None."""
    row = vectors.where((F.col(key) == value) & (F.size("embedding") == dim)).select("embedding").first()
    if row is None or any(v is None for v in row[0]):
        return None
    found = np.array(row[0], np.float64)
    return found if np.isfinite(found).all() and found.any() else None


def mean_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """(group, centroid): the element-wise mean, not normalised, of the usable vectors of each group.

    Sums are taken per position with partial aggregation, so no group is ever gathered in one place.
    """
    usable = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    each = usable.select(group, F.posexplode("embedding").alias("pos", "v"))
    means = each.groupBy(group, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
