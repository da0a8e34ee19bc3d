"""Folders of media files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The file name extensions that count as pictures.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".heic", ".heif", ".avif", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".dng", ".rw2", ".orf")
HEAD = 65536


def _shaped(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    path = F.regexp_replace(F.url_decode("path"), "^file:/*", "/")
    rows = files.withColumn("path", path).where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*extensions))
    return rows.select("path", F.unix_millis("modificationTime").cast("double").__truediv__(1000).alias("mtime"), F.col("length").alias("size_bytes"), "content")


def media_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, mtime, size_bytes, content) of all pictures below `root`; unless content is asked for, only metadata is read."""
    return _shaped(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), extensions)


def media_stream(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger)
    return _shaped(reader.load(root), extensions)


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, mtime, size_bytes, sha256): the digest of the first 64 KiB."""
    return files.select("path", "mtime", "size_bytes", F.sha2(F.substring("content", 1, HEAD), 256).alias("sha256"))
