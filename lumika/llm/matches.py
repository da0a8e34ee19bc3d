"""Recorded pairwise matches consolidated into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.operators.components import connected_components
from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize
from lumika.tables import hamming


def borne_out(matches: DataFrame, hashes: DataFrame, t: int = 5) -> DataFrame:
    """(a, b): the distinct pairs of `matches(a, b)` whose ids differ and whose hashes, `hashes(id, h)`, are at most `t` bits apart."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    left = hashes.select(F.col("id").alias("a"), F.col("h").alias("ha"))
    right = hashes.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    with Scratch() as made:
        pairs = made.table(matches.where("a is not null and b is not null and a <> b").select(low.alias("a"), high.alias("b")).distinct())
        rows = pairs.count()
        both = split_join(split_join(pairs, left, "a", rows=rows), right, "b", rows=rows, counted=pairs)
        return materialize(both.where(hamming(F.col("ha"), F.col("hb")) <= t).select("a", "b"))


def match_groups(matches: DataFrame, hashes: DataFrame, t: int = 5) -> DataFrame:
    """(id, group_id): every record of a pair that counts, with the smallest id linked to it directly or through others.

    Rows with a null side, pairs of a record with itself and pairs of unknown records are ignored; reversed and repeated
    pairs count once; without any pair the result is empty. `hashes` has each id once.
    """
    with Scratch() as made:
        found = connected_components(made.keep(borne_out(matches, hashes, t)), "a", "b")
        return found.select(F.col("node").alias("id"), F.col("component").alias("group_id"))
