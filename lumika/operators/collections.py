"""Saved searches: each kind of query is a function from its parameters to a live DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.operators import color, listing, people, search


@dataclass
class Catalog:
    """The tables a saved search may need, and the model that encodes texts."""

    photo: DataFrame
    vectors: DataFrame
    faces: DataFrame
    encode: Callable[[str], np.ndarray] | None = None
    dim: int = 768


def _filter(c: Catalog, q: dict, limit: int) -> DataFrame:
    wanted = q.get("filters", {})
    where = listing.predicate(year=wanted.get("year") or None, camera=wanted.get("camera"))
    return listing.photo_list(c.photo, q.get("sort", "newest"), limit, where=where)


def _text(c: Catalog, q: dict, limit: int) -> DataFrame:
    if c.encode is None:
        raise ValueError("a text search needs an encoder")
    return search.by_text(c.photo, c.vectors, q["q"], c.encode, limit)


KINDS: dict[str, Callable[[Catalog, dict, int], DataFrame]] = {
    "text": _text,
    "similar": lambda c, q, limit: search.similar(c.photo, c.vectors, q["photo_id"], limit, dim=c.dim),
    "cluster": lambda c, q, limit: people.cluster_photos(c.faces, c.photo, q["cluster_id"], limit),
    "color": lambda c, q, limit: color.color_search(c.photo, color.rgb(q["hex"]), q.get("tolerance", 60), limit),
    "filter": _filter,
}


def resolve(catalog: Catalog, query: str | dict, limit: int = 200) -> DataFrame:
    """The present result of a saved query; a query without a kind is a filter, one of an unknown kind is empty."""
    q = json.loads(query) if isinstance(query, str) else query
    kind = KINDS.get(q.get("kind", "filter"))
    return kind(catalog, q, limit) if kind else catalog.photo.limit(0).select(*listing.SHOWN)


def create(collections: DataFrame, name: str, query: dict, at: str) -> DataFrame:
    """`collections(id, name, is_smart, query_json, created_at)` with a new one; names are unique."""
    if collections.where(F.col("name") == name).limit(1).count():
        raise ValueError("the name is taken")
    new = (collections.agg(F.max("id")).first()[0] or 0) + 1
    row = [(new, name, 1, json.dumps(query), at)]
    return collections.unionByName(collections.sparkSession.createDataFrame(row, "id long, name string, is_smart int, query_json string, created_at string"))


def listed(collections: DataFrame) -> DataFrame:
    return collections.orderBy(F.desc("id"))


def delete(collections: DataFrame, collection_id: int) -> tuple[DataFrame, bool]:
    """(`collections` without it, whether it was there)."""
    there = collections.where(F.col("id") == collection_id).limit(1).count() > 0
    return collections.where(F.col("id") != collection_id), there
