"""Incremental scans and backfills as one set-based pass each: what is new or lacking, its features, the tables after it, and counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.operators.ingest import VERSION, exif_captured, needs_index, upsert
from lumika.operators.listing import next_batch
from lumika.session import Scratch, materialize, shuffle_width
from lumika.sources.files import fingerprints
from lumika.sources.hooks import Encode, encode_files
from lumika.sources.pictures import DECODERS, picture_features


@dataclass
class Outcome:
    """The tables after a pass, the rows that failed, as (path, error), and the counters as one row."""

    photo: DataFrame
    vectors: DataFrame | None
    errors: DataFrame
    summary: DataFrame


def numbered(rows: DataFrame, order: str, first: int) -> DataFrame:
    """`rows` with id: consecutive numbers from `first` in order of a unique column, counted per partition, so no task sees all rows."""
    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), order).sortWithinPartitions(order)
    placed = materialize(ordered.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    starts, total = [], first
    for row in counts:
        starts.append((row["part"], total))
        total += row["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    mask = F.lit((1 << 33) - 1).cast("long")
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn("id", F.col("__start") + F.col("__place").bitwiseAND(mask)).drop("__part", "__start", "__place")


def next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id")).first()[0] or 0) + 1


def replace_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old(photo_id, embedding)` with the vectors of `new` in place of those of the same photos."""
    return old.select("photo_id", "embedding").join(new.select("photo_id"), "photo_id", "left_anti").unionByName(new.select("photo_id", "embedding"))


def _shuffled(rows: DataFrame) -> DataFrame:
    """`rows` for a join by sort and merge. Written tables are planned by the size of their files, and of vectors or paths
    that repeat these are a hundredth of the rows; a join that broadcast them for that would bring all of them to the driver."""
    return rows.hint("merge")


def scan(files: DataFrame, photo: DataFrame, vectors: DataFrame, load: Callable[[], Encode], at: str, decoders: dict = DECODERS) -> Outcome:
    """Bring new and changed files into the catalog: predicate, encoding, EXIF, hash, palette, fingerprint, upserts, counters.

    `files(path, mtime, size_bytes, content)`; contents are read only of the files that need it. A file that can't be
    encoded or decoded changes nothing and is an error; a second scan of the same files finds nothing to do but those.
    Photos keep their id; new ones get the next ids in order of path. Summary: (candidates, todo, indexed, errors).
    """
    with Scratch() as made:
        todo = made.table(needs_index(files.select("path", "mtime", "size_bytes"), photo).dropDuplicates(["path"]))
        chosen = files.join(_shuffled(todo.select("path")), "path", "left_semi")
        features = made.table(picture_features(chosen, decoders).dropDuplicates(["path"]), arrow_rows=256)
        encoded = made.table(encode_files(chosen, load).dropDuplicates(["path"]), arrow_rows=256)
        prints = fingerprints(chosen).select("path", "sha256").dropDuplicates(["path"])
        rows = made.table(todo.join(_shuffled(features), "path").join(_shuffled(encoded), "path").join(_shuffled(prints), "path"))
        reason = F.when(F.col("embedding").isNull(), F.coalesce("error", F.lit("not encoded"))).otherwise(F.col("error"))
        errors = materialize(rows.where(reason.isNotNull()).select("path", reason.alias("error")))
        good = rows.where(reason.isNull())
        known = photo.where("path is not null").select("path", "id")
        fresh = made.keep(materialize(numbered(good.join(_shuffled(known), "path", "left_anti").select("path"), "path", next_id(photo)))).select("path", "id")
        ids = known.join(_shuffled(good.select("path")), "path", "left_semi").dropDuplicates(["path"]).unionByName(fresh.select("path", "id"))
        good = made.table(good.join(_shuffled(ids), "path"))
        new = good.select(
            "path", "id", "mtime", "size_bytes", "sha256", "width", "height", "orientation", "exif_json", exif_captured(F.col("exif_json")).alias("captured_at"),
            F.lit(at).alias("indexed_at"), F.lit(VERSION).alias("embedding_ver"), "phash", "dominant_colors",
        )
        new = new.select(*[F.col(c).cast(photo.schema[c].dataType).alias(c) for c in new.columns if c in photo.columns])
        after = materialize(upsert(photo, new, "path"))
        moved = materialize(replace_vectors(vectors, good.select(F.col("id").alias("photo_id"), "embedding")))
        counts = (files.select("path").distinct().count(), todo.count(), good.count(), errors.count())
        summary = files.sparkSession.createDataFrame([counts], "candidates long, todo long, indexed long, errors long")
        return Outcome(after, moved, errors, summary)


def backfill_vectors(photo: DataFrame, vectors: DataFrame, files: DataFrame, load: Callable[[], Encode], at: str, limit: int | None = None) -> Outcome:
    """Encode the photos without a vector of the present version, in order of id up to `limit`; a missing or unreadable file is an error.

    Summary: (todo, encoded, errors).
    """
    with Scratch() as made:
        have = vectors.select("photo_id").distinct()
        old = F.col("photo_id").isNull() | (F.coalesce("embedding_ver", F.lit(0)) < VERSION)
        todo = photo.where("id is not null").join(have, photo["id"] == have["photo_id"], "left").where(old).select("id", "path").dropDuplicates(["id"]).orderBy("id")
        todo = made.table(todo if limit is None else todo.limit(limit))
        encoded = encode_files(files.join(todo.select("path"), "path", "left_semi"), load).where("embedding is not null").dropDuplicates(["path"])
        done = made.table(todo.join(encoded, "path"), arrow_rows=256)
        errors = materialize(todo.join(done.select("id"), "id", "left_anti").select("path", F.lit("not encoded").alias("error")))
        marks = done.select(F.col("id").alias("__id")).withColumn("__done", F.lit(True))
        rows = photo.join(marks, photo["id"] == F.col("__id"), "left")
        mark = lambda c, v: F.when(F.col("__done"), F.lit(v).cast(photo.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        after = materialize(rows.select(*[mark("embedding_ver", VERSION) if c == "embedding_ver" else mark("indexed_at", at) if c == "indexed_at" else F.col(c) for c in photo.columns]))
        moved = materialize(replace_vectors(vectors, done.select(F.col("id").alias("photo_id"), "embedding")))
        summary = photo.sparkSession.createDataFrame([(todo.count(), done.count(), errors.count())], "todo long, encoded long, errors long")
        return Outcome(after, moved, errors, summary)


def backfill_colors(photo: DataFrame, files: DataFrame, limit: int | None = None, decoders: dict = DECODERS) -> Outcome:
    """Palettes of the photos that were never tried, in order of id up to `limit`; a failed one gets an empty list. Summary: (todo, colored, failed)."""
    with Scratch() as made:
        todo = made.table(next_batch(photo, "dominant_colors", limit))
        found = picture_features(files.join(todo.select("path"), "path", "left_semi"), decoders).select("path", F.col("dominant_colors").alias("colors"), "error").dropDuplicates(["path"])
        done = made.table(todo.join(found, "path", "left").select(F.col("id").alias("__id"), "path", F.coalesce("colors", F.lit("[]")).alias("__colors"), F.when(F.col("colors").isNull(), "no file").otherwise(F.col("error")).alias("error")))
        rows = photo.join(done.select("__id", "__colors"), photo["id"] == F.col("__id"), "left")
        after = materialize(rows.select(*[F.coalesce("dominant_colors", "__colors").alias(c) if c == "dominant_colors" else F.col(c) for c in photo.columns]))
        errors = materialize(done.where("error is not null").select("path", "error"))
        summary = photo.sparkSession.createDataFrame([(todo.count(), todo.count() - errors.count(), errors.count())], "todo long, colored long, failed long")
        return Outcome(after, None, errors, summary)
