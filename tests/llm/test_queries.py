"""The registered queries p1 to p10 on the smallest tables: their columns, their SQL, and brute force where there is no SQL."""

import glob
import os

import duckdb
import numpy as np
import pytest

from lumika.llm import queries as llm

COLUMNS = {
    "p1_found": ["face_id", "group_id"], "p2_found": ["group_id", "field_name", "photo_id"], "p3_found": ["photo_id", "group_id"], "p4_found": ["photo_id", "file_id"],
    "p5_found": ["kind", "id_a", "id_b"], "p6_found": ["photo_id_a", "photo_id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "reading_level"],
}
#: Approximate searches: the share of the rows of brute force that they must find.
RECALL = {"p1_found": 0.9, "p5_found": 0.95}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_query(spark, small, duck, name):
    got = llm.QUERIES[name](spark, small)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]
    rows = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in got.collect()]
    assert rows and (name == "p9_coverage" or len(rows) == len(set(rows)))
    text = llm.SQL.get(name) or llm.BRUTE.get(name)
    if text:
        found = duck.execute(f"select {', '.join(got.columns)} from ({text})").fetchall()
        if name in RECALL:
            assert set(rows) <= set(found) and len(set(rows)) >= RECALL[name] * len(found)
        else:
            assert set(rows) == set(found) and len(rows) == len(found)


def test_every_face_of_a_cluster_is_described_once(spark, small):
    clusters, groups = llm.p1_clusters(spark, small).collect(), llm.p1_found(spark, small).collect()
    assert sum(r["size"] for r in clusters) == len(groups) and len({r["medoid_id"] for r in clusters}) == len(clusters)
    assert all(r["medoid_id"] == r["typical"][0] and np.isin(r["group_id"], [g["group_id"] for g in groups]) for r in clusters)


def test_confidences_are_those_of_the_matches(spark, small):
    links = {(r["photo_id"], r["file_id"]): r["posterior"] for r in llm.p4_links(spark, small).collect()}
    assert set(links) == {tuple(r) for r in llm.p4_found(spark, small).collect()} and all(0.5 <= v <= 1 for v in links.values())
    classes = {r["photo_id"]: r["class_id"] for r in llm.p4_classes(spark, small).collect()}
    assert all(classes[v] == v <= k for k, v in classes.items())
