"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.operators.joins import HOT_KEY, split_join
from lumika.session import materialize, release

#: Edges that a task contracts at a time, 16 bytes each.
CHUNK = 2_000_000


def _jump(parents: DataFrame, hot: int) -> DataFrame:
    """Replace every parent by the root of its tree; the distance to the root halves in each round."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        joined = split_join(parents.select("node", "parent"), up, "parent", "left", parents.count(), hot)
        after = materialize(joined.select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
        release(parents)
        parents = after
        if parents.where("moved").limit(1).count() == 0:
            return parents


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node linked to each of the nodes 0..n-1 by the edges (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """The edges (hi, lo), each chunk of a task's edges as stars around its components' smallest nodes.

    What is linked stays linked, and fewer edges go through the shuffles that follow, as with a combiner.
    """

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hi, lo = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        label = local_labels(len(nodes), at[: len(hi)], at[len(hi) :])
        moved = label != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= chunk:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return edges.select("hi", "lo").mapInArrow(run, "hi long, lo long")


def _composed(live: DataFrame, labels: DataFrame | None, parents: DataFrame, hot: int) -> DataFrame:
    """Labels after a round that moved nodes to the roots in `parents`."""
    if labels is None:
        nodes = live.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
        new = nodes.join(parents.select("node", "parent"), "node", "left").select("node", F.coalesce("parent", "node").alias("component"))
    else:
        up = parents.select(F.col("node").alias("component"), "parent")
        new = split_join(labels, up, "component", "left", labels.count(), hot).select("node", F.coalesce("parent", "component").alias("component"))
    return materialize(new)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", chunk: int = CHUNK, hot: int = HOT_KEY) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it is linked to, directly or through others.

    Each round every node takes the smallest label among its neighbours, pointer jumping flattens the resulting trees,
    and the edges are rewritten to the trees' roots; this goes on until no label changes, which takes a number of
    rounds logarithmic in the number of nodes whatever the diameter. Every round ends in a written table. Before and
    after a shuffle each task contracts its own edges, `chunk` at a time. Nodes, parents and labels with more than `hot` rows
    are split in every join.

    Nulls, self-loops and repeated edges are ignored; an empty input gives an empty result.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("ok"))
    live = materialize(_contracted(_contracted(pairs.where("ok"), chunk).distinct(), chunk))
    labels = None
    while (rows := live.count()) > 0:
        parents = _jump(materialize(live.groupBy("hi").agg(F.min("lo").alias("parent")).select(F.col("hi").alias("node"), "parent")), hot)
        for end in ("hi", "lo"):
            up = parents.select(F.col("node").alias(end), F.col("parent").alias("up"))
            joined = split_join(live if end == "hi" else ends, up, end, "left", rows, hot)
            ends = joined.withColumn(end, F.coalesce("up", end)).drop("up")
        ends = ends.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        after = materialize(_contracted(ends.distinct(), chunk))
        new = _composed(live, labels, parents, hot)
        release(live, labels, parents)
        live, labels = after, new
    release(live)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return labels
