"""Duplicate clusters over perceptual hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumika.operators.buckets import bucket_pairs
from lumika.operators.components import connected_components
from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize, release
from lumika.tables import usable_phash

MOST = 20


def chunks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of `count` stretches that cover 64 bits: as even as it goes."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def chunk_keys(h: Column, threshold: int) -> list[Column]:
    """One key for every two of threshold + 2 chunks of a hash, with their values.

    So many flipped bits leave at least two chunks alone, and two together are a key of about 128 / (threshold + 2) bits:
    18 at five, so that unlike hashes seldom share one.
    """
    mask = lambda w: F.lit(-1 if w == 64 else (1 << w) - 1).cast("long")
    parts = [F.shiftrightunsigned(h, s).bitwiseAND(mask(w)) for s, w in chunks(threshold + 2)]
    return [F.xxhash64(F.lit(i), F.lit(j), parts[i], parts[j]) for i in range(len(parts)) for j in range(i + 1, len(parts))]


def clamp_threshold(t: int) -> int:
    return max(0, min(t, MOST))


def hash_links(hashes: DataFrame, threshold: int, forest: bool = True) -> DataFrame:
    """(a, b, d): links between distinct hash values at most `threshold` bits apart that connect all that are linked at all.

    Two hashes so near share one of the keys of `chunk_keys`. Buckets of one key give a spanning forest of their links,
    so a key that many hashes share adds links in proportion to their number, and none is capped. Without `forest` all
    links come, each once.
    """
    values = hashes.select("h").where("h is not null").distinct()
    rows = values.select(F.explode(F.array(*chunk_keys(F.col("h"), threshold))).alias("key"), F.col("h").alias("id"), F.col("h").alias("bits"))

    def check(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
        return (d <= threshold) & (a != b), d

    found = bucket_pairs(rows, ["bits"], check, forest)
    distinct = materialize(found.distinct())
    release(found)
    return distinct


def hash_pairs(photo: DataFrame, threshold: int = 5) -> DataFrame:
    """(id_a, id_b, distance): all pairs of different hashes at most `threshold` bits apart, each hash by its smallest id; id_a < id_b."""
    rows = photo.select("id", usable_phash().alias("h")).where("id is not null and h is not null")
    least = rows.groupBy("h").agg(F.min("id").alias("least"))
    links = hash_links(rows, clamp_threshold(threshold), forest=False)
    links = links.join(least.select(F.col("h").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("h").alias("b"), F.col("least").alias("y")), "b")
    return links.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.col("d").alias("distance"))


def cluster_keys(members: DataFrame) -> DataFrame:
    """(cluster_id, size, cluster_key): the digest of each cluster's sorted ids, taken as they stream by, so none is held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, n = None, None, 0
        for batch in batches:
            cluster, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows: list[tuple] = []
            heads = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]]) if len(cluster) else []
            for low, high in zip(heads, [*heads[1:], len(cluster)]):
                if cluster[low] != at:
                    if digest is not None:
                        rows.append((at, n, digest.hexdigest()))
                    at, digest, n = int(cluster[low]), hashlib.sha256(), 0
                digest.update((("," if n else "") + ",".join(map(str, ids[low:high].tolist()))).encode())
                n += int(high - low)
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["cluster_id", "size", "cluster_key"])
        if digest is not None:
            yield pa.record_batch([pa.array([at]), pa.array([n]), pa.array([digest.hexdigest()])], names=["cluster_id", "size", "cluster_key"])

    ordered = members.select("cluster_id", "id").repartition("cluster_id").sortWithinPartitions("cluster_id", "id")
    return ordered.mapInArrow(run, "cluster_id long, size long, cluster_key string")


def memberships(photo: DataFrame, threshold: int = 5) -> DataFrame:
    """(id, cluster_id): every photo with a usable hash in a cluster of at least two, with the cluster's smallest id.

    Equal hashes are one node of the graph; a hash that many photos share is split in the joins that bring them back.
    """
    threshold = clamp_threshold(threshold)
    with Scratch() as made:
        rows = made.table(photo.select("id", usable_phash().alias("h")).where("id is not null and h is not null").dropDuplicates(["id"]))
        least = made.table(rows.groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("n")))
        labels = least.select("h", F.col("least").alias("cluster_id"), "n")
        if threshold:
            links = made.keep(hash_links(rows, threshold))
            left = least.select(F.col("h").alias("a"), F.col("least").alias("src"))
            right = least.select(F.col("h").alias("b"), F.col("least").alias("dst"))
            linked = made.keep(connected_components(links.join(left, "a").join(right, "b").select("src", "dst")))
            linked = linked.select(F.col("node").alias("cluster_id"), "component")
            labels = labels.join(linked, "cluster_id", "left").select("h", F.coalesce("component", "cluster_id").alias("cluster_id"), F.when(F.col("component").isNotNull(), 2).otherwise(F.col("n")).alias("n"))
        labels = labels.where("n > 1").select("h", "cluster_id")
        return materialize(split_join(rows, labels, "h", rows=rows.count()).select("id", "cluster_id"))


def clusters(photo: DataFrame, threshold: int = 5, ignored: DataFrame | None = None, include_ignored: bool = False, limit: int | None = None) -> DataFrame:
    """(cluster_id, size, cluster_key, ignored): clusters, largest first, then by smallest id; the limit applies after the ignore filter."""
    found = cluster_keys(memberships(photo, threshold))
    if ignored is None:
        found = found.withColumn("ignored", F.lit(False))
    else:
        marks = ignored.select("cluster_key").distinct().withColumn("ignored", F.lit(True))
        found = found.join(marks, "cluster_key", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
        found = found if include_ignored else found.where(~F.col("ignored"))
    found = found.select("cluster_id", "size", "cluster_key", "ignored").orderBy(F.desc("size"), "cluster_id")
    return found if limit is None else found.limit(limit)


def ignore(ignored: DataFrame, key: str, created_at: str) -> DataFrame:
    """`ignored` with a key added, unless it is there."""
    new = ignored.sparkSession.createDataFrame([(key, created_at)], "cluster_key string, created_at string")
    return ignored.unionByName(new.join(ignored, "cluster_key", "left_anti"))


def unignore(ignored: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """(`ignored` without the key, whether it was there)."""
    there = ignored.where(F.col("cluster_key") == key).limit(1).count() > 0
    return ignored.where(F.col("cluster_key") != key), there
