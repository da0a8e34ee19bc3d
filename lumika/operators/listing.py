"""Lists, filters, facets and counts over the photo table.

Repeated rows of a photo are whole-row copies, so each operator filters and narrows first, down at the scan, and then
takes each id once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumika.operators.instants import exif_tags

# The columns a list shows.
SHOWN = ("id", "path", "captured_at", "width", "height", "thumb_small", "thumb_large", "aesthetic")
DATED = ("captured_at", "indexed_at")


def _when() -> Column:
    return F.coalesce(*DATED)


ORDERS = {
    "newest": lambda: [F.desc_nulls_last(_when())],
    "oldest": lambda: [F.asc_nulls_first(_when())],
    "best": lambda: [F.desc_nulls_last("aesthetic"), F.desc_nulls_last(_when())],
    "worst": lambda: [F.asc_nulls_last("aesthetic"), F.desc_nulls_last(_when())],
}


def predicate(year: int | None = None, camera: str | None = None, date_from: str | None = None, date_to: str | None = None, whole_day: bool = False) -> Column:
    """Conjunction of the given conditions. Dates compare as text, so a bare day as `date_to` ends at its start, unless `whole_day`."""
    parts = [F.lit(True)]
    if year is not None:
        parts.append(F.substring(_when(), 1, 4) == str(year))
    if camera:
        # a pattern over the JSON text, without regard to case and with the pattern's own wildcards
        parts.append(F.col("exif_json").ilike(f'%"Image Model": "{camera}"%'))
    if date_from:
        parts.append(_when() >= date_from)
    if date_to:
        parts.append(_when() <= (date_to + "￿" if whole_day else date_to))
    return reduce(lambda a, b: a & b, parts)


def photo_list(photo: DataFrame, sort: str = "newest", limit: int | None = 100, offset: int = 0, where: Column | None = None) -> DataFrame:
    """A page of photos; an unknown sort counts as newest, ties are in order of id."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset must not be negative")
    rows = _once(photo, where, *SHOWN, "indexed_at").orderBy(*ORDERS.get(sort, ORDERS["newest"])(), "id")
    rows = rows.offset(offset) if offset else rows
    return (rows.limit(limit) if limit is not None else rows).select(*SHOWN)


def _once(photo: DataFrame, where: Column | None, *columns: str | Column) -> DataFrame:
    """The columns of the photos that meet the condition, each photo once."""
    rows = photo.where("id is not null")
    return (rows if where is None else rows.where(where)).select(*columns).dropDuplicates(["id"])


def lookup(photo: DataFrame, photo_id: int) -> DataFrame:
    """The whole row of one photo."""
    return photo.where(F.col("id") == photo_id).dropDuplicates(["id"])


def total(photo: DataFrame, where: Column | None = None) -> DataFrame:
    return _once(photo, where, "id").agg(F.count("*").alias("total"))


def best_photos(photo: DataFrame, limit: int = 50) -> DataFrame:
    return _once(photo, F.col("aesthetic").isNotNull(), *SHOWN).orderBy(F.desc("aesthetic"), "id").limit(limit)


def years(photo: DataFrame) -> DataFrame:
    rows = _once(photo, None, "id", F.substring(_when(), 1, 4).alias("year"))
    return rows.where("year <> ''").groupBy("year").agg(F.count("*").alias("n")).orderBy(F.desc("year"))


def cameras(photo: DataFrame, limit: int = 30) -> DataFrame:
    camera = exif_tags(F.col("exif_json"), {"camera": "Image Model"})["camera"]
    rows = _once(photo, F.col("exif_json").isNotNull(), "id", camera.alias("camera")).where("camera is not null")
    return rows.groupBy("camera").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "camera").limit(limit)


def embedding_status(photo: DataFrame, vectors: DataFrame) -> DataFrame:
    """(total_photos, with_embedding, missing, percent_done); both sides are single rows."""
    all_, done = _once(photo, None, "id").agg(F.count("*").alias("total_photos")), vectors.agg(F.count_distinct("photo_id").alias("with_embedding"))
    both = all_.join(F.broadcast(done))
    share = F.round(100.0 * F.col("with_embedding") / F.greatest("total_photos", F.lit(1)), 1)
    return both.select("*", (F.col("total_photos") - F.col("with_embedding")).alias("missing"), share.alias("percent_done"))


def next_batch(photo: DataFrame, marker: str, limit: int | None = None) -> DataFrame:
    """(id, path) of the photos whose work marker (face_count, aesthetic, dominant_colors, phash) is null, in order of id."""
    rows = _once(photo, F.col(marker).isNull(), "id", "path").orderBy("id")
    return rows if limit is None else rows.limit(limit)


def hash_state(photo: DataFrame) -> DataFrame:
    """(hashed, last_id): what tells whether a duplicate search is out of date."""
    return _once(photo, F.col("phash").isNotNull(), "id").agg(F.count("*").alias("hashed"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))
