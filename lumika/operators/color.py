"""Search by colour over stored palettes, and palettes of pixels."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumika.operators.listing import next_batch

PALETTE = "array<struct<r: int, g: int, b: int, weight: double>>"


def rgb(text: str) -> tuple[int, int, int]:
    """Six hex digits, with or without a hash sign."""
    if not re.fullmatch(r"#?[0-9a-fA-F]{6}", text):
        raise ValueError("a colour is six hex digits")
    digits = text.lstrip("#")
    return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:], 16)


def palette(column: str = "dominant_colors") -> Column:
    """The palette of a JSON text; null where it is not one. Entries that lack a part are skipped by the scoring."""
    return F.from_json(F.col(column), PALETTE)


def color_score(colors: Column, target: tuple[int, int, int], tolerance: int) -> Column:
    """Sum over the entries within `tolerance` of weight / (1 + distance)."""

    def square(c: Column) -> Column:
        r, g, b = target
        return (c["r"] - r) * (c["r"] - r) + (c["g"] - g) * (c["g"] - g) + (c["b"] - b) * (c["b"] - b)

    near = F.filter(colors, lambda c: (square(c) <= tolerance * tolerance) & c["weight"].isNotNull())
    return F.aggregate(near, F.lit(0.0), lambda total, c: total + c["weight"] / (1 + F.sqrt(square(c).cast("double"))))


def color_search(photo: DataFrame, target: tuple[int, int, int], tolerance: int = 60, limit: int = 100) -> DataFrame:
    """(id, path, score): photos with a colour near `target`, best first, then by id. Malformed palettes are skipped."""
    if not 0 <= tolerance <= 255:
        raise ValueError("tolerance must be between 0 and 255")
    rows = photo.where("id is not null and dominant_colors is not null").select("id", "path", color_score(palette(), target, tolerance).alias("score"))
    # repeated rows are copies: each photo once, after the filter
    return rows.where("score > 0").dropDuplicates(["id"]).orderBy(F.desc("score"), "id").limit(limit)


def needs_palette(photo: DataFrame) -> DataFrame:
    """Photos whose palette was never tried; a failed one is an empty list and is not tried again."""
    return next_batch(photo, "dominant_colors")


def median_cut(pixels: np.ndarray, k: int = 5) -> list[dict]:
    """Palette of an (n, 3) pixel array: at most k colours with their share, by repeatedly halving the widest box at its median."""
    boxes = [np.asarray(pixels, np.int64).reshape(-1, 3)]
    if not len(boxes[0]):
        return []
    while len(boxes) < k:
        spans = [np.ptp(b, axis=0).max() * (len(b) > 1) for b in boxes]
        widest = int(np.argmax(spans))
        if spans[widest] == 0:
            break
        box = boxes.pop(widest)
        axis = int(np.argmax(np.ptp(box, axis=0)))
        box = box[np.argsort(box[:, axis], kind="stable")]
        cut = int(np.clip(np.searchsorted(box[:, axis], np.median(box[:, axis]), "right"), 1, len(box) - 1))
        if box[cut - 1, axis] == box[cut:, axis].max():  # all of the upper half is one value: cut below it
            cut = int(np.searchsorted(box[:, axis], box[-1, axis], "left"))
        boxes += [box[:cut], box[cut:]]
    n = sum(map(len, boxes))
    colors = [(len(b), *map(int, np.rint(b.mean(axis=0)))) for b in boxes if len(b)]
    return [{"r": r, "g": g, "b": b, "weight": round(c / n, 4)} for c, r, g, b in sorted(colors, reverse=True)]


def palette_histogram(pixels: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, rank, r, g, b, weight): of `pixels(key, r, g, b)` each picture's k most frequent colours and their share of its pixels.

    Counts are aggregated before they are ranked, so a picture of any size is a few rows by then. Ties go to the darker colour.
    """
    counts = pixels.groupBy(key, "r", "g", "b").agg(F.count("*").alias("n"))
    totals = pixels.groupBy(key).agg(F.count("*").alias("pixels"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "r", "g", "b"))).where(F.col("rank") <= k)
    return ranked.join(totals, key).select(key, "rank", "r", "g", "b", F.round(F.col("n") / F.col("pixels"), 4).alias("weight"))
