"""Pairs within hash buckets of any size, without a task that holds a whole bucket.

Rows (key, id, pay) are range-partitioned by (key, id), so that even one hot key spreads over many tasks. Each task
streams its rows and compares those of every bucket that lies wholly within it and fits one block. Buckets that are
cut by a partition's edge or exceed a block come out as blocks of bounded size, and a join of blocks by key compares
them block against block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumika.operators.components import local_labels
from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize, shuffle_width

BLOCK = 512
#: Blocks of one key that a task holds against the key's other blocks; a key with more is split.
BLOCKS_A_TASK = 16
#: (left ids, left payloads, right ids, right payloads) of candidate pairs -> (mask of pairs kept, their distances)
Check = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


_NONE = np.iinfo(np.int32).max


def spanning_forest(d: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, i, j) of the edges of a minimum spanning forest of each run of distances `d[run, i, j]`; _NONE is no edge.

    With `same` both sides of a run are the same rows and d is symmetric. In each round every tree takes its shortest way
    out; among equally short ones a few edges too many may be taken.
    """
    runs, rows, columns = d.shape
    left = np.arange(runs * rows).reshape(runs, rows)
    right = left if same else runs * rows + np.arange(runs * columns).reshape(runs, columns)
    label = np.arange(runs * rows + (0 if same else runs * columns))
    found: list[np.ndarray] = []
    while True:
        way = np.where(label[left][:, :, None] != label[right][:, None, :], d, _NONE)
        j = way.argmin(axis=2)
        run, i = np.divmod(np.arange(runs * rows), rows)
        best = [np.stack([label[left].ravel(), way.min(axis=2).ravel(), run, i, j.ravel()])]
        if not same:
            i = way.argmin(axis=1)
            run, j = np.divmod(np.arange(runs * columns), columns)
            best.append(np.stack([label[right].ravel(), way.min(axis=1).ravel(), run, i.ravel(), j]))
        ways = np.concatenate(best, axis=1)
        ways = ways[:, ways[1] < _NONE]
        if not ways.shape[1]:
            edges = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
            return edges[0], edges[1], edges[2]
        ways = ways[:, np.lexsort((ways[4], ways[3], ways[1], ways[0]))]
        ways = ways[:, np.r_[True, ways[0, 1:] != ways[0, :-1]]]  # each tree's shortest
        run, i, j = ways[2:]
        if same:
            i, j = np.minimum(i, j), np.maximum(i, j)
        found.append(np.stack([run, i, j]))
        trees, at = np.unique(np.concatenate([label[left[run, i]], label[right[run, j]]]), return_inverse=True)
        merged = local_labels(len(trees), at[: len(run)], at[len(run) :])
        into = np.arange(len(label))
        into[trees] = trees[merged]
        label = into[label]


def _within(starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, pay: np.ndarray, check: Check, forest: bool) -> Iterator[tuple]:
    """Pairs of every run; runs of one length go through the check together."""
    for size in np.unique(sizes[sizes > 1]):
        first = starts[sizes == size]
        x, y = np.triu_indices(size, 1)
        for part in np.array_split(first, max(1, len(first) * len(x) // 400_000)):
            i, j = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
            keep, d = check(ids[i], pay[i], ids[j], pay[j])
            if forest and size > 2:
                keep, d = keep.reshape(len(part), -1), d.reshape(len(part), -1)
                some = keep.any(axis=1)
                if not some.any():
                    continue
                way = np.full((int(some.sum()), size, size), _NONE, np.int32)
                way[:, x, y] = np.where(keep[some], d[some], _NONE)
                way = np.minimum(way, way.transpose(0, 2, 1))
                # rows, not ids, are the nodes: one id may lie in many runs
                run, p, q = spanning_forest(way, True)
                i, j, d = part[some][run] + p, part[some][run] + q, way[run, p, q]
            else:
                i, j, d = i[keep], j[keep], d[keep]
            if len(i):
                yield ids[i], ids[j], d


def _pairs_batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    a, b, d = (np.concatenate(x) for x in zip(*found))
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.record_batch([pa.array(low), pa.array(high), pa.array(d.astype(np.int32))], names=names)


def bucket_pairs(
    rows: DataFrame, pay: list[str], check: Check, forest: bool, block: int = BLOCK, summary: list[Callable[[Column], Column]] = (), opens: Callable[[list[Column], list[Column]], Column] | None = None,
    qualify: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, meets: Callable[[DataFrame], None] | None = None, order: list[str] = (), reach: int | None = None,
) -> DataFrame:
    """(a, b, d): pairs of ids, a < b, that share a key and pass `check`, with their distance; a pair may come several times.

    `rows` has key long, id long and the payload columns `pay`, all long; none is null. With `forest` a bucket gives a minimum spanning forest of
    its passing pairs instead of all of them, which keeps every connection and stays linear in the bucket's size.
    Rows of one id in one bucket are compared too; `check` has to reject them. An empty input gives an empty result.
    A bucket beyond `block` rows meets itself block against block. Two different blocks are compared only if `opens` is
    true of their summaries, each function of which makes a column of a block's ids, and only those rows of the left one
    that `qualify`, of its payloads and the right one's; both must be true wherever a pair could pass. `meets` gets the
    pairs of different blocks, with whether they are opened, before they are sifted.

    For approximate searches `reach` bounds the work of a bucket of any size: rows of one key lie in the order of the
    payload columns `order`, such as further hashes, and a block meets only the `reach` blocks that follow it.
    """
    spark, width = rows.sparkSession, len(pay)

    def words(batch: pa.RecordBatch) -> np.ndarray:
        columns = [batch.column(2 + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(width)]
        return np.stack(columns, axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ids", "pays", "seq", "a", "b", "d"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

        def emit(found: list[tuple], blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if blocks:
                n = len(blocks)
                cols = [pa.array([x[i] for x in blocks], kinds[i]) for i in range(3)] + [pa.array(number + np.arange(n))]
                number += n
                yield pa.record_batch(cols + [pa.nulls(n, k) for k in kinds[4:]], names=names)
            if found:
                p = _pairs_batch(found, ["a", "b", "d"])
                yield pa.record_batch([pa.nulls(len(p), k) for k in kinds[:4]] + p.columns, names=names)

        def cut(key: int, ids: np.ndarray, load: np.ndarray) -> list[tuple]:
            return [(int(key), ids[s : s + block], load[s : s + block].view(np.int64).ravel()) for s in range(0, len(ids), block)]

        number = 0
        keys, ids, load = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint64)
        shared: set[int] = set()  # the first key, which another task may hold too, and keys cut into blocks
        for batch in batches:
            if len(batch) == 0:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, batch.column(1).to_numpy(zero_copy_only=False)])
            load = np.concatenate([load, words(batch)])
            shared = shared or {int(keys[0])}
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[heads, len(keys)])
            inner = ~np.isin(keys[heads], list(shared)) & (sizes <= block)
            inner[-1] = False  # the last run may go on in the next batch
            outer = ~inner[:-1]
            blocks = [x for h, s in zip(heads[:-1][outer], sizes[:-1][outer]) for x in cut(keys[h], ids[h : h + s], load[h : h + s])]
            rest = heads[-1]
            if (whole := sizes[-1] // block * block) > 0:  # a long run leaves in whole blocks as it comes
                blocks += cut(keys[rest], ids[rest : rest + whole], load[rest : rest + whole])
                shared = {*shared, int(keys[rest])}
                rest += whole
            yield from emit(list(_within(heads[inner], sizes[inner], ids, load, check, forest)), blocks)
            keys, ids, load = keys[rest:], ids[rest:], load[rest:]
        if len(keys):
            yield from emit([], cut(keys[0], ids, load))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, lp, right, rp, same in zip(*(batch.column(k).to_pylist() for k in range(5))):
                x, y = np.array(left, np.int64), np.array(right, np.int64)
                p, q = np.array(lp, np.int64).view(np.uint64).reshape(len(x), -1), np.array(rp, np.int64).view(np.uint64).reshape(len(y), -1)
                if same:
                    found += list(_within(np.array([0]), np.array([len(x)]), x, p, check, forest))
                    continue
                own = np.arange(len(x)) if qualify is None else np.flatnonzero(qualify(p, q))
                if not len(own):
                    continue
                i, j = np.repeat(own, len(y)), np.tile(np.arange(len(y)), len(own))
                keep, d = check(x[i], p[i], y[j], q[j])
                if forest and keep.any():
                    way = np.where(keep, d, _NONE).astype(np.int32).reshape(1, len(own), len(y))
                    _, i, j = spanning_forest(way, False)
                    i, d = own[i], way[0, i, j]
                else:
                    i, j, d = i[keep], j[keep], d[keep]
                if len(i):
                    found.append((x[i], y[j], d))
            if found:
                yield _pairs_batch(found, ["a", "b", "d"])

    n = shuffle_width(spark)
    ordered = rows.select("key", "id", *pay).repartitionByRange(n, "key", *order, "id").sortWithinPartitions("key", *order, "id")
    with Scratch() as made:
        scanned = ordered.mapInArrow(scan, "key long, ids array<long>, pays array<long>, seq long, a long, b long, d int")
        # tasks hold ranges of the order, so a task's number and the block's in it give the block's place
        out = made.table(scanned.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("seq")))
        inside = out.where("a is not null").select("a", "b", "d")
        blocks = made.table(out.where("key is not null").select("key", "block", "ids", "pays"))
        notes = [(f"u{i}", f"v{i}") for i in range(len(summary))]
        right = blocks.select("key", F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("pays").alias("pays2"), *[f(F.col("ids")).alias(v) for f, (_, v) in zip(summary, notes)])
        left = blocks.select("*", *[f(F.col("ids")).alias(u) for f, (u, _) in zip(summary, notes)])
        if reach is None:
            meet = split_join(left, right, "key", hot=BLOCKS_A_TASK, counted=blocks).where("block <= other")
        else:
            places = made.table(blocks.select("key", "block").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("block"))))
            steps = F.explode(F.sequence(F.lit(0), F.lit(reach)))
            near = places.select("key", "block", "place", steps.alias("step")).select("key", "block", (F.col("place") + F.col("step")).alias("place"))
            near = near.join(places.select("key", F.col("block").alias("other"), "place"), ["key", "place"]).select("block", "other")
            meet = near.join(left, "block").join(right.drop("key"), "other")
        same = F.col("block") == F.col("other")
        if opens is not None:
            opened = opens([F.col(u) for u, _ in notes], [F.col(v) for _, v in notes])
            if meets is not None:
                meets(meet.where(~same).select(opened.alias("opened")))
            meet = meet.where(same | opened)
        # a row holds two blocks, so batches are kept to a few of them
        across = made.table(meet.select("ids", "pays", "ids2", "pays2", same.alias("same")).mapInArrow(cross, "a long, b long, d int"), arrow_rows=64)
        return materialize(inside.unionByName(across))
