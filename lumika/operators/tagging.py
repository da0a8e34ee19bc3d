"""Zero-shot labels from vectors, and what is asked of the labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumika.functions.vectors import products

TOP, LEAST = 5, 0.18


def label(prompt: str) -> str:
    """A prompt without its article; each is stripped once, in this order."""
    for article in ("an ", "a ", "the "):
        prompt = prompt.removeprefix(article)
    return prompt


def label_column(prompt: Column) -> Column:
    for article in ("an ", "a ", "the "):
        prompt = F.regexp_replace(prompt, f"^{article}", "")
    return prompt


def zero_shot(vectors: DataFrame, concepts: np.ndarray, prompts: list[str], top: int = TOP, least: float = LEAST) -> DataFrame:
    """(photo_id, label, score): each photo's `top` most similar concepts with a similarity of at least `least`; ties by label.

    The concepts are a fixed vocabulary, so they travel with the code and meet every batch in one matrix product.
    """
    scored = products(vectors, "photo_id", concepts, [label(p) for p in prompts]).where(F.col("similarity") >= least).dropDuplicates(["photo_id", "name"])
    order = Window.partitionBy("photo_id").orderBy(F.desc("similarity"), "name")
    ranked = scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)
    return ranked.select("photo_id", F.col("name").alias("label"), F.col("similarity").alias("score"))


def untagged(photo: DataFrame, tags: DataFrame) -> DataFrame:
    return photo.join(tags, photo["id"] == tags["photo_id"], "left_anti")


def top_labels(tags: DataFrame, limit: int = 30) -> DataFrame:
    return tags.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(limit)


def photos_for_label(tags: DataFrame, photo: DataFrame, name: str, limit: int = 200) -> DataFrame:
    """Photos of one label, best score first."""
    own = tags.where(F.col("label") == name)
    rows = own.join(photo.select("id", "path", "captured_at"), own["photo_id"] == photo["id"])
    return rows.select("photo_id", "path", "captured_at", "score").orderBy(F.desc("score"), "photo_id").limit(limit)


def latest_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace on (photo_id, label): the new score wins over the old, the higher one among rows of one side."""
    both = old.select("photo_id", "label", "score", F.lit(0).alias("side")).unionByName(new.select("photo_id", "label", "score", F.lit(1).alias("side")))
    return both.groupBy("photo_id", "label").agg(F.max(F.struct("side", "score"))["score"].alias("score"))
