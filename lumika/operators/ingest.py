"""Incremental scan, upserts, backfills and the import of an external catalog, each as one set-based pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumika.operators.instants import exif_tags

VERSION = 1
MOST_TAGS, LONGEST_TAG = 12, 40


def needs_index(candidates: DataFrame, photo: DataFrame) -> DataFrame:
    """Candidates (path, mtime, size_bytes) that are new, changed, or lack a feature of the present version."""
    known = photo.select(F.col("path").alias("known"), F.col("mtime").alias("m"), F.col("size_bytes").alias("s"), "embedding_ver", "phash", "dominant_colors")
    rows = candidates.join(known, candidates["path"] == known["known"], "left")
    falsy = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    stale = ~F.col("mtime").eqNullSafe(F.col("m")) | ~F.col("size_bytes").eqNullSafe(F.col("s"))
    lacking = (F.coalesce("embedding_ver", F.lit(0)) < VERSION) | falsy("phash") | falsy("dominant_colors")
    return rows.where(F.col("known").isNull() | stale | lacking).select(*candidates.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` put in by `key`: a column that `new` lacks or leaves null keeps its old value."""
    fresh = [c for c in new.columns if c != key]
    right = new.dropDuplicates([key]).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in fresh])
    joined = old.join(right, old[key] == F.col("__k"), "full")
    return joined.select(*[
        F.coalesce(F.col(c), F.col("__k")).alias(c) if c == key else F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fresh else F.col(c) for c in old.columns
    ])


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order.desc_nulls_last())))
    return ranked.where("__rn = 1").drop("__rn")


def add_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` and those rows of `new` whose key it lacks."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def missing_embedding(photo: DataFrame, vectors: DataFrame) -> DataFrame:
    """Photos without a vector or with one of an older version."""
    have = vectors.select("photo_id").distinct()
    rows = photo.join(have, photo["id"] == have["photo_id"], "left")
    return rows.where(F.col("photo_id").isNull() | (F.coalesce("embedding_ver", F.lit(0)) < VERSION)).select("id", "path").orderBy("id")


def exif_captured(exif: Column) -> Column:
    """Capture time of an EXIF text as a scan records it: DateTimeOriginal or else Image DateTime, in one notation, tagged UTC."""
    tags = exif_tags(exif, {"taken": "EXIF DateTimeOriginal", "changed": "Image DateTime"})
    text = F.coalesce(F.nullif(tags["taken"], F.lit("")), tags["changed"])
    return F.when(text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), import_time(text))


def import_time(text: Column) -> Column:
    """Three notations of a local time as ISO text tagged UTC, null otherwise."""
    text = F.trim(text)
    shape = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$") | text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$")
    day = F.translate(F.substring(text, 1, 10), ":", "-")
    clock = F.substring(text, 12, 8)
    iso = F.concat(day, F.lit("T"), clock, F.lit("+00:00"))
    real = F.try_to_timestamp(F.concat(day, F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return F.when(shape & real, iso)


def import_tags(text: Column) -> Column:
    """Tags of a JSON list: strings only, trimmed and in lower case, each once in order, without the debris of captions."""
    items = F.from_json(text, "array<string>")
    tags = F.transform(items, lambda t: F.lower(F.trim(t)))
    # fixed values: what a caption's debris starts with and ends in, and its length
    debris = lambda t: t.rlike(r"^(:|//|\[|/|\\|\{)") | t.endswith(":") | (F.length(t) > LONGEST_TAG) | t.contains("\n")
    return F.coalesce(F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != "") & ~debris(t))), F.array().cast("array<string>"))


def import_rows(files: DataFrame, photo: DataFrame, provenance: str = "photos.db", present: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The photos that an import of tagged external files adds: one for each new path, that of the smallest id.

    With `present(path)` only files that exist are taken, with `limit` exactly so many, in order of their ids.
    """
    path = F.trim("path")
    rows = files.where("tagged_at is not null").select("id", path.alias("path"), "source", "size", "mtime", "sha256", "phash", "width", "height", "exif_dt", "caption", "tags_json")
    rows = rows.where("path <> ''").join(photo.select("path"), "path", "left_anti")
    rows = rows if present is None else rows.join(present.select("path"), "path", "left_semi")
    first = Window.partitionBy("path").orderBy("id")
    rows = rows.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    rows = rows if limit is None else rows.orderBy("id").limit(limit)
    caption = F.trim("caption")
    return rows.select(
        F.col("id").alias("file_id"), "path", F.coalesce("mtime", F.lit(0.0)).alias("mtime"), F.coalesce("size", F.lit(0)).alias("size_bytes"), "sha256", "phash", "width", "height",
        import_time(F.col("exif_dt")).alias("captured_at"), F.when(caption != "", caption).alias("caption"),
        F.concat(F.lit(f"{provenance}:"), F.coalesce("source", F.lit("unknown"))).alias("imported_from"), import_tags(F.col("tags_json")).alias("tags"),
    )


def imported_tags(rows: DataFrame) -> DataFrame:
    """(file_id, pos, label, score): the first tags of each imported photo, at full score."""
    kept = rows.select("file_id", F.posexplode(F.slice("tags", 1, MOST_TAGS)).alias("pos", "label"))
    return kept.select("file_id", "pos", "label", F.lit(1.0).alias("score"))


def import_summary(files: DataFrame, photo: DataFrame) -> DataFrame:
    """(seen, imported, existing, repeated, without_path): what an import does with the tagged rows."""
    rows = files.where("tagged_at is not null").select("id", F.trim("path").alias("path"))
    have = photo.select(F.col("path").alias("known")).distinct()
    rows = rows.join(have, F.col("path") == F.col("known"), "left")
    blank = F.coalesce(F.col("path"), F.lit("")) == ""
    new = ~blank & F.col("known").isNull()
    sums = rows.agg(
        F.count("*").alias("seen"), F.count_distinct(F.when(new, F.col("path"))).alias("imported"),
        F.count_if(F.col("known").isNotNull()).alias("existing"), F.count_if(new).alias("fresh"), F.count_if(blank).alias("without_path"),
    )
    return sums.select("seen", "imported", "existing", (F.col("fresh") - F.col("imported")).alias("repeated"), "without_path")


def tags_of_photos(rows: DataFrame, photo: DataFrame) -> DataFrame:
    """(photo_id, label, score): the first tags of each imported file as tags of the photo that now has its path."""
    ids = photo.where("path is not null and id is not null").select("path", F.col("id").alias("photo_id")).dropDuplicates(["path"])
    kept = rows.select("path", F.explode(F.slice("tags", 1, MOST_TAGS)).alias("label")).join(ids, "path")
    return kept.select("photo_id", "label", F.lit(1.0).alias("score")).distinct()
