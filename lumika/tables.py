"""Readers of the catalog tables and the row-level rules all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHOTO_DIM, FACE_DIM = 768, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_by(df: DataFrame, key: str) -> DataFrame:
    """One row per `key`. Repeated rows are whole-row copies, so any of them will do.

    For rows that are wide whatever is asked of them, such as whole texts: they are shuffled only if a key really occurs
    twice, which one job finds out when the query is built, moving nothing but keys. Elsewhere `dropDuplicates` after the
    filter and on the columns asked for is better.
    """
    if df.groupBy(key).count().where(F.col("count") > 1).limit(1).count() == 0:
        return df
    return df.dropDuplicates([key])


def usable_phash(column: Column | str = "phash") -> Column:
    """The hash as a signed 64-bit number, or null: 16 hex digits in either case, blanks around them ignored, not all zeros."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.regexp_replace(column, r"^\s+|\s+$", "")
    number = F.conv(text, 16, -10).cast("long")
    return F.when(text.rlike("^[0-9a-fA-F]{16}$") & ~text.rlike("^0{16}$"), number)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def photo_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, h): every photo with a usable phash, once."""
    photo = table(spark, sf_dir, "photo").select("id", usable_phash().alias("h"))
    return photo.where(F.col("id").isNotNull() & F.col("h").isNotNull()).dropDuplicates(["id"])
