"""Records whose 64-bit hashes differ in a few bits, by a token-group matrix.

A hash is a set of 64 tokens, one for each bit position and its value; two hashes differ in at most t bits if and only
if they share at least 64 - t tokens. The hashes are partitioned into groups of similar ones: at most GROUP of those that
agree in two of t + 2 chunks of their bits, in order of their bits. The matrix row of a group is its token union, kept as
two masks (positions where some member has a one, and where some member has a zero). A query's overlap with a group is at
most the number of its tokens in that union; a group is opened only if this bound reaches 64 - t, first for all members
of another group together, then for each of them. Hashes within t bits agree in two chunks at least, so a group that
could qualify is never missed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumika.operators.buckets import bucket_pairs
from lumika.operators.dupes import chunk_keys
from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize, release

GROUP = 64

def _ones(members: Column) -> Column:
    return F.aggregate(members, F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(h))


def _zeros(members: Column) -> Column:
    return F.aggregate(members, F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(F.bitwise_not(h)))


def tokens_unshared(left: list[Column], right: list[Column]) -> Column:
    """Positions where all of one group have a one and all of the other a zero, or the other way round: tokens no pair shares."""
    (ones, zeros), (ones2, zeros2) = left, right
    alone = lambda zero, one: F.bit_count(F.bitwise_not(zero).bitwiseAND(F.bitwise_not(one)))
    return alone(zeros, ones2) + alone(zeros2, ones)


def overlap_bound(queries: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Upper bound of the tokens that each of the hashes shares with any member of a group."""
    ones, zeros = np.bitwise_or.reduce(group), np.bitwise_or.reduce(~group)
    return np.bitwise_count(queries & ones).astype(np.int64) + np.bitwise_count(~queries & zeros)


def near_hashes(hashes: DataFrame, t: int = 5, group: int = GROUP, report: list | None = None) -> DataFrame:
    """(ha, hb, d): all pairs of different values of `hashes(h long)` that differ in at most `t` bits, ha < hb, each once.

    Nulls are ignored and repeated values count once. Nothing is capped: a key that many hashes share only gives more
    groups, which are spread by range partitioning and compared group against group. `report` gets how many pairs of
    groups met and how many of them the bound left closed.
    """
    if not 0 <= t <= 20:
        raise ValueError("t must be between 0 and 20")
    values = hashes.select("h").where("h is not null").distinct()
    rows = values.select(F.explode(F.array(*chunk_keys(F.col("h"), t))).alias("key"), F.col("h").alias("id"), F.col("h").alias("bits"))

    def check(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
        return (d <= t) & (a != b), d

    def count(meet: DataFrame) -> None:
        row = meet.agg(F.count("*"), F.count_if(~F.col("opened"))).first()
        report.append((row[0], row[1]))

    found = bucket_pairs(
        rows, ["bits"], check, forest=False, block=group, summary=[_ones, _zeros], opens=lambda x, y: tokens_unshared(x, y) <= t,
        qualify=lambda x, y: overlap_bound(x[:, 0], y[:, 0]) >= 64 - t, meets=None if report is None else count,
    )
    # near hashes share several keys
    distinct = materialize(found.distinct().select(F.col("a").alias("ha"), F.col("b").alias("hb"), "d"))
    release(found)
    return distinct


def _usable(records: DataFrame) -> DataFrame:
    return records.where("id is not null and h is not null").select("id", "h").distinct()


def near_records(records: DataFrame, t: int = 5) -> DataFrame:
    """(a, b): pairs of ids, a < b, of `records(id, h)` whose hashes differ in at most `t` bits; equal hashes are pairs too.

    Rows with a null id or hash are ignored, repeated rows count once; an empty table gives an empty result. A hash of
    many records is split, on whichever side of the join it lies.
    """
    with Scratch() as made:
        records = made.table(_usable(records))
        near, rows = made.keep(near_hashes(records, t)), records.count()
        other = records.select(F.col("id").alias("id2"), F.col("h").alias("hb"))
        left = split_join(records.withColumnRenamed("h", "ha"), near, "ha", rows=rows).select("id", "hb")
        unlike = split_join(left, other, "hb", rows=max(rows, near.count())).select("id", "id2")
        alike = split_join(records, other.withColumnRenamed("hb", "h"), "h", rows=rows, hot=2_000).where("id < id2").select("id", "id2")
        return materialize(unlike.unionByName(alike).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")))


def near_classes(records: DataFrame, t: int = 5) -> DataFrame:
    """(id, class_id, copies, links): every record with a usable hash, its class, the records of the class, and its links to others.

    A class is all records of one hash, named by the smallest id, so the result grows with the records and not with
    their pairs; `links` counts the other classes within `t` bits.
    """
    with Scratch() as made:
        records = made.table(_usable(records))
        near = made.keep(near_hashes(records, t))
        links = near.select(F.explode(F.array("ha", "hb")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
        classes = records.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).join(links, "h", "left")
        found = split_join(records, classes, "h", rows=records.count())
        return materialize(found.select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links")))
