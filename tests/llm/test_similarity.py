"""Face groups, neighbours, near hashes and match groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumika.llm import all_pairs, neighbours
from lumika.llm import near_hashes as nh
from lumika.llm.bpe import PairTable
from lumika.llm.face_groups import face_clusters, face_groups
from lumika.llm.matches import match_groups
from lumika.llm.neighbours import neighbour_pairs
from lumika.llm.vectors import _sorted_windows, candidates, units_of

DIM = 512
VECTORS = "face_id long, embedding array<float>, id string, cell int"


def clustered(seed: int, people: int, least: int, most: int, noise: float) -> np.ndarray:
    r = np.random.default_rng(seed)
    out = []
    for _ in range(people):
        centre = r.standard_normal(DIM)
        out += [centre + noise * r.standard_normal(DIM) for _ in range(r.integers(least, most + 1))]
    return np.array(out, np.float32)


def frame(spark, x, odd=True):
    rows = [(i * 3 + 1, [float(v) for v in row], "clash", 0) for i, row in enumerate(x)]
    known = [(r[0],) for r in rows]
    if odd:
        n = 3 * len(x) + 100
        rows += rows[:5]
        rows += [(n, None, None, None), (n + 1, [], "", 0), (n + 2, [0.0] * DIM, "", 0), (n + 3, [float("nan")] * DIM, "", 0), (n + 4, [1.0] * (DIM - 1), "", 0)]
        rows += [(n + 5, [None] + [1.0] * (DIM - 1), "", 0), (None, rows[0][1], "", 0), (n + 6, rows[0][1], "gone", 0)]
        known += [(n + k,) for k in range(6)] + [(None,)] + known[:3]
    return spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame(known, "id long")


def brute_groups(ids, near):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        x, y = find(ids[a]), find(ids[b])
        label[max(x, y)] = min(x, y)
    roots = {i: find(i) for i in ids}
    sizes = {}
    for r in roots.values():
        sizes[r] = sizes.get(r, 0) + 1
    return {i: r for i, r in roots.items() if sizes[r] > 1}


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


@pytest.mark.parametrize("noise", [0.3, 0.6])
def test_face_groups_are_those_of_brute_force(spark, noise):
    x = clustered(1, 60, 1, 8, noise)
    x = np.concatenate([x, x[:4] * 2, x[7:8]])  # scaled and exact copies
    vectors, known = frame(spark, x)
    got = {r["id"]: r["group_id"] for r in face_groups(vectors, "face_id", known, DIM).collect()}
    want = brute_groups([3 * i + 1 for i in range(len(x))], cosines(x) >= 0.6)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)
    assert set(got) <= set(want) or len(set(got) - set(want)) <= 0.03 * len(want)


@pytest.mark.parametrize("cell", [100, 8192])
def test_a_group_larger_than_a_cell_and_many_copies(spark, cell):
    r = np.random.default_rng(2)
    centre = r.standard_normal(DIM)
    x = np.array([centre + 0.4 * r.standard_normal(DIM) for _ in range(700)] + [centre] * 40, np.float32)
    vectors, known = frame(spark, x, odd=False)
    got = face_groups(vectors, "face_id", known, DIM, cell=cell).collect()
    assert len(got) == len(x) and {row["group_id"] for row in got} == {1}


def test_a_cut_component_keeps_its_groups(spark):
    """Chains of groups: the windows of a component beyond the limit and its candidates give the same groups."""
    x = clustered(9, 25, 3, 60, 0.5)
    vectors, known = frame(spark, x)
    want = brute_groups([3 * i + 1 for i in range(len(x))], cosines(x) >= 0.6)
    got = {r["id"]: r["group_id"] for r in face_groups(vectors, "face_id", known, DIM, cell=20).collect()}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want)


def test_windows_cover_each_vector_once_a_table(spark):
    r = np.random.default_rng(3)
    rows = [(i, 7 if i % 3 else 8, [int(v) for v in r.integers(0, 6, 12)]) for i in range(1000)]
    large = spark.createDataFrame(rows, "id long, cell long, codes array<smallint>").repartition(5)
    got = _sorted_windows(large, 64, 3).toPandas()
    assert len(got) == 3000 and not got.duplicated(["id", "turn"]).any()
    sizes = got.groupby(["cell", "part"]).agg(n=("id", "size"), turns=("turn", "nunique"))
    assert sizes["n"].max() <= 64 and (sizes["turns"] == 1).all() and len(sizes) <= 3000 // 64 + 40


def test_loose_groups_are_split_around_medoids(spark):
    r = np.random.default_rng(6)
    a, b, c = np.linalg.qr(r.standard_normal((DIM, 3)))[0].T
    turn = np.deg2rad(40)  # neighbours on the chain have a cosine of 0.77, others of less than 0.6
    chain = [np.cos(k * turn) * a + np.sin(k * turn) * b for k in range(5)]
    ball = [c + 0.01 * r.standard_normal(DIM) for _ in range(4)]
    x = np.array(chain + ball + ball[:1], np.float32)
    vectors, known = frame(spark, x, odd=False)
    got = {row["cluster_id"]: row for row in face_clusters(vectors, "face_id", known, DIM).collect()}
    ids = [3 * i + 1 for i in range(len(x))]
    assert sum(row["size"] for row in got.values()) == len(x)
    whole = got[ids[5]]
    assert whole["size"] == 5 and whole["group_id"] == ids[5] and len(whole["typical"]) == 3
    parts = [row for row in got.values() if row["group_id"] == ids[0]]
    assert len(parts) == 2 and {row["medoid_id"] for row in parts} <= set(ids[:5]) and sorted(row["size"] for row in parts) == [2, 3]


def test_empty_vectors(spark):
    vectors, known = frame(spark, np.zeros((0, DIM), np.float32), odd=False)
    assert face_groups(vectors, "face_id", known, DIM).count() == 0
    assert neighbour_pairs(vectors, "face_id", known, DIM).count() == 0


def brute_pairs(x, k=5, least=0.6):
    s = np.round(cosines(x), 9)
    np.fill_diagonal(s, -2)
    found = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                found.add((3 * min(i, j) + 1, 3 * max(i, j) + 1))
    return found


def test_neighbours_reach_nearly_all_pairs_and_no_wrong_one(spark):
    x = clustered(3, 80, 1, 12, 0.45)
    vectors, known = frame(spark, x)
    got = {(r["a"], r["b"]) for r in neighbour_pairs(vectors, "face_id", known, DIM).collect()}
    want = brute_pairs(x)
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.03 * len(want)


def test_neighbours_in_a_cut_component(spark, monkeypatch):
    x = clustered(12, 3, 250, 300, 0.5)
    vectors, known = frame(spark, x, odd=False)
    want = brute_pairs(x)
    monkeypatch.setattr(neighbours, "units_of", lambda edges, sketches: units_of(edges, sketches, 100, 64, 6))
    got = {(r["a"], r["b"]) for r in neighbour_pairs(vectors, "face_id", known, DIM).collect()}
    s = cosines(x)
    assert all(s[a // 3, b // 3] >= 0.6 - 1e-6 for a, b in got) and len(got & want) >= 0.3 * len(want)


def test_neighbours_and_groups_of_a_cut_component_lose_nothing(spark, monkeypatch):
    """One dense group beyond a cell's size: all of its neighbours, as in one unit."""
    x = clustered(13, 1, 900, 900, 0.5)
    vectors, known = frame(spark, x, odd=False)
    monkeypatch.setattr(neighbours, "units_of", lambda edges, sketches: units_of(edges, sketches, 100, 64, 6))
    got = {(r["a"], r["b"]) for r in neighbour_pairs(vectors, "face_id", known, DIM).collect()}
    assert got == brute_pairs(x)


@pytest.mark.parametrize("block, tile, dense", [(4096, 1024, 64), (150, 64, 64), (150, 64, 10**6)])
def test_neighbours_are_exactly_those_of_brute_force(spark, monkeypatch, block, tile, dense):
    """Isolated pairs near the limit, which hardly share a bucket, a dense group, and copies of a vector at several lengths."""
    r = np.random.default_rng(21)
    base, other = (np.linalg.qr(r.standard_normal((DIM, 480)))[0].T.reshape(2, 240, DIM))
    c = r.uniform(0.601, 0.7, (240, 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other, clustered(14, 1, 200, 200, 0.2), np.repeat(base[:1], 30, axis=0) * r.integers(1, 4, (30, 1))])
    vectors, known = frame(spark, x.astype(np.float32))
    monkeypatch.setattr(all_pairs, "TILE", tile)
    monkeypatch.setattr(all_pairs, "DENSE", dense)
    monkeypatch.setattr(neighbours, "all_partners", lambda *args: all_pairs.all_partners(*args, block=block))
    got = [(p["a"], p["b"]) for p in neighbour_pairs(vectors, "face_id", known, DIM).collect()]
    assert set(got) == brute_pairs(x.astype(np.float32)) and len(got) == len(set(got))


def test_vectors_of_topics_meet_along_few_axes_and_nothing_is_lost():
    """Unlike topics are told apart by fewer axes than 192; of coordinates in a random order 272 of 512 had to lead."""
    r = np.random.default_rng(22)
    centres = r.standard_normal((40, DIM))
    x = centres[r.integers(0, 40, 5000)] * 0.8 + r.standard_normal((5000, DIM))
    x[2500:2560] = x[:60] + 0.8 * r.standard_normal((60, DIM))  # similar ones
    x = x.astype(np.float32)
    axes = all_pairs.Axes(x[1000:], DIM, 0.6)
    assert axes.axes.shape[1] < 192
    x, blocks = x[:3000], []
    for at in range(0, 3000, 600):
        own = x[at : at + 600]
        cells = axes.cells(axes.along(own))
        order = np.argsort(cells, kind="stable")
        inverse = (1 / np.linalg.norm(own[order], axis=1)).astype(np.float32)
        blocks.append(all_pairs.Block(at + order, np.full(600, 0.6), cells[order], inverse, own[order].tobytes(), axes))
    right = all_pairs.Block.merged(blocks)
    found = [all_pairs.compare(b, b, True, 600, 0.6) for b in blocks]
    found += [all_pairs.compare(b, right.take(np.flatnonzero(right.source > i)), False, 3000, 0.6) for i, b in enumerate(blocks[:-1])]
    got = {(a, b) for ids, others, _ in found for a, b in zip(ids.tolist(), others.tolist())}
    s = np.round(cosines(x), 9)
    np.fill_diagonal(s, -2)
    assert len(got) > 100 and got == set(zip(*(v.tolist() for v in np.nonzero(s >= 0.6))))


def test_each_two_of_a_large_bucket_are_compared(spark):
    """Twins whose sketches are far apart in the order of the bucket's rows, which holds many blocks."""
    n, full = 6000, np.random.default_rng(8).integers(0, 2, (6000, 256)).astype(np.uint8)
    full[n // 2 :] = full[: n // 2]
    full[n // 2 :, 63] ^= 1  # the highest bit of the first word
    words = np.packbits(full, axis=1, bitorder="little").view(np.int64)
    sketches = spark.createDataFrame([(i, *map(int, w), [0]) for i, w in enumerate(words)], "id long, s0 long, s1 long, s2 long, s3 long, codes array<smallint>")
    got = {(r["a"], r["b"]) for r in candidates(sketches, lambda codes: codes[:, :1], 20).collect()}
    assert got == {(i, i + n // 2) for i in range(n // 2)}


def test_neighbours_of_exact_copies_are_the_smallest_ids(spark):
    x = np.concatenate([clustered(4, 5, 2, 3, 0.3), np.repeat(clustered(5, 1, 1, 1, 0.1), 30, axis=0)])
    vectors, known = frame(spark, x, odd=False)
    got = [(r["a"], r["b"]) for r in neighbour_pairs(vectors, "face_id", known, DIM).collect()]
    assert len(got) == len(set(got))
    copies = {3 * i + 1 for i in range(len(x) - 30, len(x))}
    assert {p for p in got if p[0] in copies} == {p for p in brute_pairs(x) if p[0] in copies}


def flip(h, bits):
    for b in bits:
        h ^= 1 << b
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("t", [0, 1, 5, 9])
def test_near_hashes_are_all_pairs(spark, t):
    r = random.Random(42 + t)
    values = [r.getrandbits(64) for _ in range(150)]
    values += [flip(v, r.sample(range(64), k)) for v in values[:60] for k in (1, t, t + 1)]
    values += [flip(values[0], [31]), flip(values[0], [32]), flip(values[0], [0]), flip(values[0], [31, 32])]
    rows = [(i, signed(v), "x") for i, v in enumerate(values)]
    rows += rows[:4] + [(None, 5, "x"), (9999, None, "x")]
    records = spark.createDataFrame(rows, "id long, h long, a string")
    got = [(x["a"], x["b"]) for x in nh.near_records(records, t).collect()]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= t}
    assert set(got) == want and len(got) == len(want)


def test_near_hashes_of_one_hot_value_use_many_groups(spark):
    r = random.Random(7)
    values = sorted({(r.getrandbits(24) << 40) | 0xABCDE for _ in range(600)})  # the low 40 bits are all alike
    records = spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "id long, h long")
    got = {(x["a"], x["b"]) for x in nh.near_records(records, 5).collect()}
    assert got == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 5}


def test_the_bound_closes_groups_of_one_key_and_loses_nothing(spark):
    r = random.Random(11)
    low = r.getrandbits(28)
    bases = [r.getrandbits(36) << 28 for _ in range(12)]  # all share their low chunks, so one key holds everything
    values = sorted({flip(b | low, r.sample(range(28, 64), 2)) for b in bases for _ in range(120)})
    report: list = []
    got = {(x["ha"], x["hb"]) for x in nh.near_hashes(spark.createDataFrame([(signed(v),) for v in values], "h long"), 5, 16, report).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 5}
    met, closed = report[0]
    assert got == want and met > 1000 and closed > 0.1 * met


def test_classes_of_near_hashes(spark):
    records = spark.createDataFrame([(1, 0b1), (2, 0b1), (3, 0b11), (4, 2**62 - 1), (4, 2**62 - 1), (None, 1), (5, None)], "id long, h long")
    assert {tuple(x) for x in nh.near_classes(records).collect()} == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)}
    assert nh.near_classes(records.limit(0)).count() == 0


def test_near_hashes_of_nothing(spark):
    assert nh.near_records(spark.createDataFrame([], "id long, h long")).count() == 0


def test_match_groups(spark):
    hashes = spark.createDataFrame([(i, i if i < 50 else 2**50 - 1) for i in range(60)], "id long, h long")
    rows = [(1, 2), (2, 1), (2, 3), (2, 3), (5, 5), (7, None), (None, 8), (9, 999), (10, 55), (20, 21), (3, 4)]
    got = {r["id"]: r["group_id"] for r in match_groups(spark.createDataFrame(rows, "a long, b long"), hashes, 5).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 20, 21: 20}
    assert match_groups(spark.createDataFrame([], "a long, b long"), hashes).count() == 0


def test_pair_table_finds_what_it_holds():
    r = np.random.default_rng(0)
    pairs = np.unique(r.integers(0, 50_000, (20_000, 2)), axis=0)
    table = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    rank, merged = table.find(pairs[:, 0], pairs[:, 1])
    assert (rank == np.arange(len(pairs))).all() and (merged == np.arange(len(pairs))).all()
    rank, _ = table.find(pairs[:, 1] + 60_000, pairs[:, 0])
    assert (rank >= 2**40).all()
