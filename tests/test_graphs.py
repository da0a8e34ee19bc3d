"""Components, bucket pairs and duplicate clusters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumika.operators import dupes
from lumika.operators.buckets import _NONE, bucket_pairs, spanning_forest
from lumika.operators.components import connected_components
from lumika.operators.joins import split_join


def brute(edges):
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {x: find(x) for x in label}


def components(spark, edges, chunk, hot):
    df = spark.createDataFrame(edges, "src long, dst long")
    return {r["node"]: r["component"] for r in connected_components(df, chunk=chunk, hot=hot).collect()}


@pytest.mark.parametrize("chunk, hot", [(1, 10), (40, 20), (10**6, 10**6)])
def test_components_of_chains_stars_and_random_graphs(spark, chunk, hot):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    r.shuffle(chain)
    star = [(5000, i) for i in range(6000, 6080)]
    other = [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)]
    zigzag = [(2000 + i, 2100 - i) for i in range(20)] + [(2001 + i, 2100 - i) for i in range(20)]
    edges = [(a, b) for a, b in chain + star + other + zigzag if a != b]
    assert components(spark, edges + edges[:9] + [(b, a) for a, b in edges[:9]], chunk, hot) == brute(edges)


def test_components_ignore_nulls_and_loops(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (3, None), (4, 5)], "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {4: 4, 5: 4}
    assert connected_components(df.limit(0)).count() == 0


def test_split_join_is_the_plain_join(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(300)] + [(None, 1), (None, 2)], "k long, i long")
    table = spark.range(0, 400, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.createDataFrame([(7, 70), (7, 71)], "k long, v long"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(str, rows.join(table, "k", how).collect()))
        assert sorted(map(str, split_join(rows, table, "k", how, hot=20).collect())) == plain
        assert sorted(map(str, split_join(rows, table, ["k"], how, 302, 20).collect())) == plain
        assert split_join(rows.limit(0), table, "k", how).count() == 0


def test_split_join_bounds_the_rows_of_a_task(spark):
    """Of 40,000 rows of one key no task of the join gets more than a few times `hot`."""
    rows = spark.range(40_000, numPartitions=8).select(F.lit(1).cast("long").alias("k"), "id")
    table = spark.createDataFrame([(1, "x")], "k long, v string")
    wide = spark.sparkContext.defaultParallelism * 8
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, (str(wide), "-1", "false")):
            spark.conf.set(k, v)
        tasks = split_join(rows, table, "k", hot=1000).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 40_000 and max(r["count"] for r in tasks) <= 8_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("same", [True, False])
def test_spanning_forest_keeps_connections_and_prefers_short_edges(same):
    r = np.random.default_rng(1)
    for n, m in ((2, 2), (30, 30), (40, 40)) if same else ((1, 1), (20, 35), (40, 7)):
        d = np.where(r.random((5, n, m)) < 0.08, r.integers(0, 1000, (5, n, m)), _NONE).astype(np.int32)
        if same:
            d = np.minimum(d, d.transpose(0, 2, 1))
            d[:, np.arange(n), np.arange(n)] = _NONE
        run, i, j = spanning_forest(d, same)
        right = 0 if same else n
        for k in range(5):
            a, b = np.nonzero(d[k] < _NONE)
            own = run == k
            assert (d[k][i[own], j[own]] < _NONE).all()
            whole, tree = brute(zip(a.tolist(), (b + right).tolist())), brute(zip(i[own].tolist(), (j[own] + right).tolist()))
            assert whole == tree and own.sum() <= len(whole)  # ties may add a few edges to a forest's
            for node in {*a.tolist()}:  # the shortest edge of each node is in the forest
                assert d[k][node].min() in [d[k][p, q] for p, q in zip(i[own], j[own]) if p == node or (same and q == node)]
    assert len(spanning_forest(np.full((2, 3, 3), _NONE, np.int32), same)[0]) == 0


def test_a_bucket_of_bounded_reach(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(1 if i % 9 else 2, i, r.getrandbits(40)) for i in range(1500)], "key long, id long, bits long").repartition(6)
    check = lambda a, x, b, y: (a != b, np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32))
    found = [(p["a"], p["b"]) for p in bucket_pairs(df, ["bits"], check, True, block=64, order=["bits"], reach=1).collect()]
    parts = brute(found)
    assert len(parts) == 1500 and len(set(parts.values())) == 2 and len(found) < 6 * 1500
    every = bucket_pairs(df, ["bits"], check, False, block=64, order=["bits"], reach=2).count()
    assert 1500 * 64 < every < 1500 * 64 * 4


@pytest.mark.parametrize("forest", [False, True])
def test_bucket_pairs_with_hot_keys(spark, forest):
    r = random.Random(3)
    rows = [(0 if i % 3 == 0 else r.randrange(1, 40), i, r.getrandbits(5)) for i in range(900)]
    df = spark.createDataFrame(rows, "key long, id long, bits long").repartition(5)

    def check(a, x, b, y):
        d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
        return (d <= 1) & (a != b), d

    got = [(p["a"], p["b"]) for p in bucket_pairs(df, ["bits"], check, forest, block=32).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and (a[2] ^ b[2]).bit_count() <= 1}
    assert set(got) <= want
    assert brute(got) == brute(want) if forest else sorted(got) == sorted(want)


def hashes(spark, values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "id long, phash string")


def test_chunks_cover_all_bits():
    for n in (2, 3, 7, 8, 22):
        layout = dupes.chunks(n)
        assert len(layout) == n and layout[0][0] == 0 and all(s + w == t for (s, w), (t, _) in zip(layout, layout[1:] + [(64, 0)]))


def test_equal_hashes_of_very_many_photos(spark):
    same = [(i, "f" * 15 + "0") for i in range(1, 20_001)] + [(30_000, "f" * 16), (30_001, "0123456789abcdef")]
    rows = spark.createDataFrame(same, "id long, phash string")
    got = dupes.memberships(rows, 5)
    assert got.count() == 20_001 and got.agg(F.max("cluster_id")).first()[0] == 1


@pytest.mark.parametrize("t", [1, 5])
def test_clusters_equal_brute_force(spark, t):
    r = random.Random(42)
    values = []
    for _ in range(30):
        base = r.getrandbits(64)
        for flips in (0, 2, 5, 9):
            v = base
            for b in r.sample(range(64), flips):
                v ^= 1 << b
            values.append(v)
    edge = r.getrandbits(64)
    values += [edge, edge ^ 1 << 31, edge ^ 1 << 32, edge ^ 1, edge ^ 1 << 31 ^ 1 << 32]
    got = {r["id"]: r["cluster_id"] for r in dupes.memberships(hashes(spark, [f"{v:016x}" for v in values]), t).collect()}
    pairs = [(i + 1, j + 1) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= t]
    assert got == brute(pairs)


def test_identical_null_and_malformed_hashes(spark):
    df = hashes(spark, ["a" * 16, " " + "A" * 16, None, "", "0" * 16, "0" * 16, "xyz", "0x" + "b" * 16, "a" * 15])
    rows = dupes.clusters(df, 0).collect()
    assert [(r["cluster_id"], r["size"]) for r in rows] == [(1, 2)]
    assert dupes.clusters(df.limit(0), 5).count() == 0


def test_ignore_round_trip(spark):
    df = hashes(spark, ["a" * 16, "a" * 16, "b" * 16, "b" * 16, "b" * 16])
    key = dupes.clusters(df, 0).collect()[0]["cluster_key"]
    none = spark.createDataFrame([], "cluster_key string, created_at string")
    ignored = dupes.ignore(dupes.ignore(none, key, "t"), key, "t")
    assert ignored.count() == 1
    assert [r["size"] for r in dupes.clusters(df, 0, ignored).collect()] == [2]
    assert [r["ignored"] for r in dupes.clusters(df, 0, ignored, include_ignored=True).collect()] == [True, False]
    assert [r["size"] for r in dupes.clusters(df, 0, ignored, limit=1).collect()] == [2]
    after, there = dupes.unignore(ignored, key)
    assert there and after.count() == 0 and dupes.unignore(after, "unknown")[1] is False
    assert dupes.clamp_threshold(99) == 20 and dupes.clamp_threshold(-3) == 0


def test_pairs_of_hashes_are_all_pairs(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(6)]
    values += values[:5]
    got = [tuple(x) for x in dupes.hash_pairs(hashes(spark, [f"{v:016x}" for v in values]), 5).select("id_a", "id_b", "distance").collect()]
    first = {v: i + 1 for i, v in reversed(list(enumerate(values)))}
    want = {(i, j, (a ^ b).bit_count()) for a, i in first.items() for b, j in first.items() if i < j and (a ^ b).bit_count() <= 5}
    assert sorted(got) == sorted(want)
    links = dupes.hash_links(spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "h long"), 5)
    assert links.count() < len(want)


def test_an_operator_leaves_only_its_result(spark):
    import glob

    from lumika.session import _table_root, release

    root = _table_root(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/*"))
    found = dupes.memberships(hashes(spark, ["a" * 16, "a" * 15 + "b", "c" * 16]), 5)
    assert found.count() == 2 and len(set(glob.glob(f"{root}/*")) - before) == 1
    release(found)
    assert set(glob.glob(f"{root}/*")) == before
