"""Similar vectors: pseudo-rotations, sketches, candidates from hash buckets, and exact comparison in units of bounded size.

The way from a table of vectors to exact similarities, shared by neighbours and face groups:

1. `sketch` reads every vector once and writes a small record: bits that estimate its cosines and the codes that its
   bucket keys are made of. Vectors with other than `dim` finite values, or all zero, end here.
2. `candidates` puts the records into buckets and keeps, per bucket, a spanning forest of the pairs whose sketches agree.
   Every block of a bucket meets every other, whatever the bucket's size.
3. `units_of` forms the units in which vectors meet: a connected component of candidates of at most CELL vectors is one
   unit. A larger one is dealt to blocks of nearly WINDOW vectors, and every two of its blocks are a unit, so that in it
   too each vector meets each other.
4. `in_units` brings each unit's vectors together and compares them exactly.

So no partner within a component is lost, and the price is work that grows with the square of a bucket or component
beyond one block; no list of all pairs of a group is ever made, and a vector travels only if it has a likely partner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumika.functions.vectors import clean, unit
from lumika.operators.buckets import bucket_pairs
from lumika.operators.components import connected_components
from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize, release, shuffle_width

SHORT = 4  # 64-bit words of a sketch that travel into the buckets
CELL = 8192
WINDOW = 4096
DEPTH = 8  # codes by which it is sorted
FILTER_BITS = 26
_SLICE = 1024


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


class Rotation:
    """Fast Hadamard pseudo-rotation: twice random signs and a Hadamard transform, done as two small matrix products."""

    def __init__(self, dim: int, seed: int, rounds: int = 2):
        bits = max(1, int(np.ceil(np.log2(dim))))
        self.dim, self.n, self.a, self.b = dim, 1 << bits, 1 << (bits // 2), 1 << (bits - bits // 2)
        random = np.random.default_rng(seed)
        self.signs = [random.choice(np.array([-1, 1], np.float32), self.n) for _ in range(rounds)]
        self.ha, self.hb = hadamard(self.a), hadamard(self.b)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.zeros((len(x), self.n), np.float32)
        z[:, : self.dim] = x
        for signs in self.signs:
            z *= signs
            z = (z.reshape(-1, self.b) @ self.hb).reshape(-1, self.a, self.b).transpose(0, 2, 1).reshape(-1, self.a)
            z = (z @ self.ha).reshape(len(x), self.n) * np.float32(1 / np.sqrt(self.n))
        return z


def sign_words(z: np.ndarray, words: int) -> np.ndarray:
    return np.packbits(z[:, : words * 64] > 0, axis=1, bitorder="little").view(np.int64)


def signs(dim: int, words: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Signs of as many pseudo-rotated coordinates as fill `words` words."""
    n = Rotation(dim, seed).n
    rotations = [Rotation(dim, seed + i) for i in range(-(-words * 64 // n))]
    return lambda x: sign_words(np.concatenate([r(x) for r in rotations], axis=1), words)


def sketch(vectors: DataFrame, key: str, dim: int, words: int, seed: int, codes: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, f0, f1, s0.., codes): fingerprints of the exact values, sign bits, and hash codes of each usable vector."""
    names = ["id", "f0", "f1", *(f"s{i}" for i in range(words)), "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = signs(dim, words, seed)
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                ids, x = clean(part.column(1), part.column(0), dim)
                if not len(ids):
                    continue
                raw = [v.tobytes() for v in x]
                prints = np.array([[xxhash.xxh64_intdigest(v, 1), xxhash.xxh64_intdigest(v, 2)] for v in raw], np.uint64).view(np.int64)
                x = unit(x).astype(np.float32)
                c = codes(x).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(c.ravel()))
                yield pa.record_batch([pa.array(np.ascontiguousarray(v)) for v in (ids, *prints.T, *bits(x).T)] + [lists], names=names)

    schema = ", ".join(f"{n} {'array<smallint>' if n == 'codes' else 'long'}" for n in names)
    return vectors.select(F.col(key).cast("long").alias("id"), "embedding").mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def near_bits(limit: int):
    def check(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
        return (d <= limit) & (a != b), d

    return check


def candidates(sketches: DataFrame, keys: Callable[[np.ndarray], np.ndarray], limit: int) -> DataFrame:
    """(a, b): pairs that share a bucket and whose short sketches differ in at most `limit` bits, thinned to spanning forests."""
    pay = [f"s{i}" for i in range(SHORT)]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = keys(_matrix(batch.column(1 + SHORT)))
            n = found.shape[1]
            columns = [found.ravel(), *(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n) for i in range(1 + SHORT))]
            for at in range(0, len(columns[0]), 50_000):
                yield pa.record_batch([pa.array(c[at : at + 50_000]) for c in columns], names=["key", "id", *pay])

    rows = sketches.select("id", *pay, "codes").mapInArrow(expand, "key long, id long, " + ", ".join(f"{p} long" for p in pay))
    found = bucket_pairs(rows, pay, near_bits(limit), forest=True)
    distinct = materialize(found.select("a", "b").distinct())
    release(found)
    return distinct


def confirmed(pairs: DataFrame, sketches: DataFrame, columns: list[str], score: Callable[[list[Column], list[Column]], Column]) -> DataFrame:
    """The pairs whose sketches pass `score`, of their `columns`."""
    left = sketches.select(F.col("id").alias("a"), *(F.col(c).alias(f"l_{c}") for c in columns))
    right = sketches.select(F.col("id").alias("b"), *(F.col(c).alias(f"r_{c}") for c in columns))
    rows = pairs.count()
    both = split_join(split_join(pairs, left, "a", rows=rows), right, "b", rows=rows, counted=pairs)
    return both.where(score([F.col(f"l_{c}") for c in columns], [F.col(f"r_{c}") for c in columns])).select("a", "b")


def _sorted_windows(large: DataFrame, window: int, tables: int) -> DataFrame:
    """(id, cell, part, turn) of `large(id, cell, codes)`: in each table consecutive windows in order of the codes."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = _matrix(batch.column(2)) & 0xFFFF
            for turn in range(tables):
                own = np.roll(codes, -(turn * codes.shape[1] // tables), axis=1)[:, :DEPTH]
                own = np.pad(own, ((0, 0), (0, DEPTH - own.shape[1])))
                deep = [sum(own[:, i + j] << (48 - 16 * j) for j in range(4)) for i in (0, 4)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.full(len(batch), turn, np.int32)), *map(pa.array, deep)], names=["id", "cell", "turn", "k0", "k1"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, part = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            cell, turn = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            heads = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (turn[1:] != turn[:-1])])
            parts = np.empty(len(cell), np.int64)
            for low, high in zip(heads, [*heads[1:], len(cell)]):
                if (cell[low], turn[low]) != run:
                    run, at, part = (cell[low], turn[low]), 0, part + 1
                number = (at + np.arange(high - low)) // window - at // window + part
                parts[low:high], at, part = number, at + high - low, int(number[-1])
                part += at % window == 0  # the next row opens a window
            task = batch.column(3).to_numpy().astype(np.int64) << 32
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(task + parts), batch.column(2)], names=["id", "cell", "part", "turn"])

    rows = large.mapInArrow(expand, "id long, cell long, turn int, k0 long, k1 long")
    order = ["cell", "turn", "k0", "k1", "id"]
    ordered = rows.repartitionByRange(shuffle_width(large.sparkSession), *order).sortWithinPartitions(*order)
    return ordered.select("id", "cell", "turn", F.spark_partition_id().alias("task")).mapInArrow(cut, "id long, cell long, part long, turn int")


def _block_pairs(large: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """(id, cell, part, turn) of `large(id, cell)`: one unit for every two of a component's blocks, of turn 1.

    Blocks are filled by hash to nine tenths of a window on the mean, so that two of them fit a cell. `part` is negative.
    """
    many = F.ceil(F.col("n") / (0.9 * window)).cast("long")
    rows = large.join(F.broadcast(sizes.select("cell", many.alias("many"))), "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("many")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("other")
    met = rows.select("id", "cell", "many", "own", other).where("own <> other or many = 1")
    part = -1 - (F.least("own", "other") * F.col("many") + F.greatest("own", "other"))
    return met.select("id", "cell", part.alias("part"), F.lit(1).alias("turn"))


def units_of(edges: DataFrame, sketches: DataFrame, cell: int = CELL, window: int = WINDOW, tables: int = 1) -> DataFrame:
    """units(id, cell, part, turn): the units in which the linked vectors meet, every two of a component in one at least.

    A vector of a component beyond `cell` is in one unit of turn 0, a window in order of the codes, and in those of turn 1
    that its block forms with each other block; every other vector is in one unit, of turn 0. The windows of further
    `tables` add no pairs.
    """
    with Scratch() as made:
        labels = made.keep(connected_components(edges, "a", "b")).select(F.col("node").alias("id"), F.col("component").alias("cell"))
        # at most one in `cell` of the vectors' number
        big = made.table(labels.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell))
        small = labels.join(F.broadcast(big.select("cell")), "cell", "left_anti").select("id", "cell", F.lit(0).cast("long").alias("part"), F.lit(0).alias("turn"))
        if big.count() == 0:
            return materialize(small)
        large = made.table(labels.join(F.broadcast(big.select("cell")), "cell", "left_semi"))
        cuts = _sorted_windows(large.join(sketches.select("id", "codes"), "id").select("id", "cell", "codes"), window, tables).where("turn = 0")
        return materialize(small.unionByName(cuts).unionByName(_block_pairs(large, big, window)))


def _planes(x: np.ndarray) -> list[bytes]:
    """Each vector's bytes, plane by plane: lossless, and the shuffle's compression then sees the bytes that say little."""
    return [np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T).tobytes() for v in x]


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), 4, dim)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(np.float32).reshape(len(packed), dim)


def packed_vectors(vectors: DataFrame, key: str, dim: int, wanted: DataFrame) -> DataFrame:
    """(id, v): the packed vectors of the ids in `wanted(id)`, and a few others.

    A bitmap of hashed ids, of fixed size however many there are, keeps most other vectors out of the shuffle.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    word, bit = F.shiftrightunsigned(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    bitmap = F.broadcast(wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), "embedding").where(F.size("embedding") == dim)
    rows = rows.join(bitmap, word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select("id", "embedding")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = clean(batch.column(1), batch.column(0), dim)
            yield pa.record_batch([pa.array(ids), pa.array(_planes(x), pa.binary())], names=["id", "v"])

    return rows.mapInArrow(pack, "id long, v binary")


def in_units(units: DataFrame, packed: DataFrame, dim: int, compare: Callable, schema: str, extra: str | None = None) -> DataFrame:
    """Apply compare(ids, x) to each of `units(id, cell, part)` with at least two members; it returns a list of columns.

    The ids ascend, x holds unit vectors in double precision. With `extra`, a long column of `units`, compare gets it third.
    A unit has at most CELL members, so a task holds no more than one unit and one batch.
    """
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, part = t.column(0).to_numpy(), t.column(1).to_numpy()
            heads = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
            ids, got = t.column(2).to_numpy(), []
            for s, e in zip(heads, np.r_[heads[1:], len(cell)]):
                own, first = np.unique(ids[s:e], return_index=True)  # repeated rows end here
                if len(own) > 1:
                    x = unit(unpack(t.column(3).slice(s, e - s).take(pa.array(first)).to_pylist(), dim))
                    more = () if extra is None else (t.column(4).to_numpy()[s:e][first],)
                    got.append(compare(own, x, *more))
            if got:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*got)], names=names)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cell, part = held.column(0).to_numpy(), held.column(1).to_numpy()
            ends = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))
            if len(ends):
                yield from flush(held.slice(0, int(ends[-1]) + 1))
                held = held.slice(int(ends[-1]) + 1)
        if held is not None and len(held):
            yield from flush(held)

    columns = ["cell", "part", "id", "v", *([extra] if extra else [])]
    rows = units.join(packed, "id").select(*columns).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return materialize(rows.mapInArrow(run, schema), arrow_rows=_SLICE)
