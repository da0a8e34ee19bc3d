"""Search, listing, colour, tags, people, collections, ingest and sidecars on small fixtures."""

import json
import sqlite3
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumika.functions.vectors import mean_vectors, nearest
from lumika.operators import aesthetic, collections, color, ingest, jobs, listing, people, search, sidecar, tagging
from lumika.sources import files, hooks, sqlite

PHOTO = "id long, path string, mtime double, size_bytes long, width int, height int, exif_json string, captured_at string, indexed_at string, embedding_ver int, thumb_small string, thumb_large string, phash string, aesthetic double, dominant_colors string, caption string"
BLANK = dict.fromkeys([x.split()[0] for x in PHOTO.split(", ")])


def photos(spark, *rows):
    made = [{**BLANK, "mtime": 0.0, "size_bytes": 0, "indexed_at": "2026-01-01T00:00:00Z", "path": f"/p/{r['id']}.jpg", **r} for r in rows]
    return spark.createDataFrame([tuple(r[k] for k in BLANK) for r in made], PHOTO)


def faces(spark, *rows):
    return spark.createDataFrame(rows, "id long, photo_id long, bbox_json string, cluster_id long, person_id long")


def persons(spark, *rows):
    return spark.createDataFrame([(i, n, "t") for i, n in rows], "id long, name string, created_at string")


def test_nearest_ties_repeats_and_bad_vectors(spark):
    rows = [(i, [float(i % 4), 1.0]) for i in range(20)] + [(3, [3.0, 1.0]), (50, None), (51, [1.0]), (52, [float("nan"), 1.0]), (53, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "photo_id long, embedding array<float>").repartition(4)
    got = [r["photo_id"] for r in nearest(df, "photo_id", np.array([0.0, 1.0]), 7).collect()]
    assert got == [0, 4, 8, 12, 16, 1, 5]
    assert nearest(df, "photo_id", np.array([1.0, 1.0]), 0).count() == 0 and nearest(df.limit(0), "photo_id", np.array([1.0, 1.0]), 3).count() == 0
    with pytest.raises(ValueError):
        nearest(df, "photo_id", np.array([1.0, 1.0]), 3, "other")


def test_similar_leaves_itself_out_and_needs_a_vector(spark):
    p = photos(spark, {"id": 1}, {"id": 2})
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [1.0, 0.1])], "photo_id long, embedding array<float>")
    rows = search.similar(p, v, 1, 2, dim=2).collect()
    assert [r["photo_id"] for r in rows] == [2]  # the vector without a photo took a place
    assert rows[0]["score"] == pytest.approx(1 - 0.5 * 2**0.5)
    assert search.similar(p, v, 77, 2, dim=2).count() == 0 and search.by_text(p, v, "  ", lambda _: 1 / 0).count() == 0
    assert [r["photo_id"] for r in search.by_text(p, v, "x", lambda _: np.array([0.0, 1.0]), 1).collect()] == [2]


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (2, None), (None, [1.0, 1.0])], "g long, embedding array<float>")
    assert {r["g"]: r["centroid"] for r in mean_vectors(df, "g").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0], None: [1.0, 1.0]}


def test_listing(spark):
    p = photos(spark, {"id": 1, "captured_at": "2020-05-01T00:00:00Z", "aesthetic": 3.0, "exif_json": '{"Image Model": "X1"}'}, {"id": 2, "aesthetic": 9.0, "exif_json": '{"Image Model": "x1", '}, {"id": 3, "captured_at": "2020-05-01T00:00:00Z"})
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(listing.photo_list(p)) == [2, 1, 3] and ids(listing.photo_list(p, "oldest")) == [1, 3, 2]
    assert ids(listing.photo_list(p, "best")) == [2, 1, 3] and ids(listing.photo_list(p, "worst")) == [1, 2, 3] and ids(listing.photo_list(p, "odd", 1, 1)) == [1]
    assert ids(listing.photo_list(p, where=listing.predicate(year=2020, camera="X1"))) == [1]
    assert ids(listing.photo_list(p, where=listing.predicate(date_to="2020-05-01"))) == [] and ids(listing.photo_list(p, where=listing.predicate(date_to="2020-05-01", whole_day=True))) == [1, 3]
    assert [tuple(r) for r in listing.cameras(p).collect()] == [("X1", 1)] and [tuple(r) for r in listing.years(p).collect()] == [("2026", 1), ("2020", 2)]
    v = spark.createDataFrame([(1,)], "photo_id long")
    assert tuple(listing.embedding_status(p, v).first()) == (3, 1, 2, 33.3) and tuple(listing.embedding_status(p.limit(0), v).first())[3] == 100.0
    with pytest.raises(ValueError):
        listing.photo_list(p, limit=-1)


def test_color(spark):
    p = photos(spark, {"id": 1, "dominant_colors": '[{"r":10,"g":10,"b":10,"weight":0.5},{"r":13,"g":14,"b":10,"weight":0.5}]'}, {"id": 2, "dominant_colors": "[]"}, {"id": 3, "dominant_colors": "broken"}, {"id": 4}, {"id": 5, "dominant_colors": '[{"r":10,"weight":1.0}]'})
    rows = color.color_search(p, (10, 10, 10), 5).collect()
    assert [(r["id"], round(r["score"], 6)) for r in rows] == [(1, round(0.5 + 0.5 / 6, 6))]
    assert [r["id"] for r in color.needs_palette(p).collect()] == [4]
    assert color.rgb("#0a0B0c") == (10, 11, 12)
    with pytest.raises(ValueError):
        color.rgb("12345")
    palette = color.median_cut(np.array([[200, 30, 30]] * 75 + [[0, 0, 255]] * 25))
    assert palette == [{"r": 200, "g": 30, "b": 30, "weight": 0.75}, {"r": 0, "g": 0, "b": 255, "weight": 0.25}] and color.median_cut(np.zeros((0, 3))) == []


def test_tags_and_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (1, [1.0, 0.0]), (3, None)], "photo_id long, embedding array<float>")
    got = tagging.zero_shot(v, np.eye(2), ["a dog", "the sea"], 1, 0.18).collect()
    assert sorted((r["photo_id"], r["label"]) for r in got) == [(1, "dog"), (2, "sea")]
    assert tagging.label("an an apple") == "an apple" and tagging.label("a the road") == "road"
    got = aesthetic.scores(v, np.array([1.0, 0.0]), np.array([0.0, 0.0])).collect()
    assert sorted((r["photo_id"], r["aesthetic"]) for r in got) == [(1, 10.0), (2, 10.0)]
    stars = spark.createDataFrame([(None,), (1.0,), (5.0,), (10.0,), (99.0,)], "a double").select(aesthetic.rating(F.col("a")).alias("r")).collect()
    assert [r["r"] for r in stars] == [None, 0, 2, 5, 5]
    old = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5)], "photo_id long, label string, score double")
    new = spark.createDataFrame([(1, "a", 0.2), (1, "a", 0.3)], "photo_id long, label string, score double")
    assert sorted(map(tuple, tagging.latest_tags(old, new).collect())) == [(1, "a", 0.3), (1, "b", 0.5)]


def test_person_operations(spark):
    f = faces(spark, (1, 1, "[0, 0, 10, 10]", 10, None), (2, 1, "[0, 0, 10, 10]", 10, None), (3, 2, None, 20, None))
    p = persons(spark)
    f, p, audit = people.name_cluster(f, p, 10, " Ann ", "t")
    assert json.loads(audit.first()["detail"])["name"] == "Ann" and [r["name"] for r in p.collect()] == ["Ann"]
    f, p, _ = people.name_cluster(f, p, 20, "Ann", "t")
    assert p.count() == 1 and {r["person_id"] for r in f.collect()} == {1}
    f, p, _ = people.name_cluster(f, p, 20, "Bob", "t")
    with pytest.raises(ValueError):
        people.rename_person(p, 2, "Ann", "t")
    with pytest.raises(KeyError):
        people.rename_person(p, 9, "Eve", "t")
    with pytest.raises(KeyError):
        people.name_cluster(f, p, 99, "Eve", "t")
    with pytest.raises(ValueError):
        people.name_cluster(f, p, 10, "  ", "t")
    with pytest.raises(ValueError):
        people.merge_clusters(f, 10, 10, "t")
    merged, _ = people.merge_clusters(f, 10, 20, "t")
    assert {(r["cluster_id"], r["person_id"]) for r in merged.collect()} == {(20, 2)}
    f, p, _ = people.unname_person(f, p, 2, "t")
    assert {(r["id"], r["person_id"]) for r in f.collect()} == {(1, 1), (2, 1), (3, None)}
    carried, _ = people.merge_clusters(f, 10, 20, "t")
    assert {r["person_id"] for r in carried.collect()} == {1}
    rows = people.people(f, p, 2).collect()
    assert [(r["cluster_id"], r["person_name"], r["face_count"], r["photo_count"]) for r in rows] == [(10, "Ann", 2, 1)]
    assert [(r["name"], r["face_count"]) for r in people.persons(persons(spark, (5, "bob"), (6, "Abe")), f).collect()] == [("Abe", 0), ("bob", 0)]


def test_crop_boxes(spark):
    f = faces(spark, (1, 1, "[100, 100, 200, 100]", 1, None), (2, 1, "[1, 2]", 1, None), (3, 2, "[0, 0, 1, 1]", 1, None), (4, 1, "broken", 1, None))
    p = photos(spark, {"id": 1, "width": 2048, "height": 1024}, {"id": 2, "width": None, "height": 3})
    assert [tuple(r) for r in people.crop_boxes(f, p).collect()] == [(1, 25, 0, 175, 150)]


def test_online_clusters_follow_the_order(spark):
    rows = [("r", 1, [1.0, 0.0]), ("r", 2, [0.8, 0.6]), ("r", 3, [0.0, 1.0]), ("s", 4, [0.0, 1.0]), ("r", 1, [1.0, 0.0]), ("r", 9, None)]
    df = spark.createDataFrame(rows, "root string, face_id long, embedding array<float>")
    got = {(r["root"], r["face_id"]): r["cluster"] for r in people.online_clusters(df, "root").collect()}
    assert got == {("r", 1): 1, ("r", 2): 1, ("r", 3): 2, ("s", 4): 1}


def test_collections(spark):
    p = photos(spark, {"id": 1, "captured_at": "2020-01-01T00:00:00Z"}, {"id": 2})
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "photo_id long, embedding array<float>")
    c = collections.Catalog(p, v, faces(spark, (1, 2, None, 7, None)), lambda _: np.array([0.0, 1.0]), dim=2)
    ids = lambda q: [r[0] for r in collections.resolve(c, q).collect()]
    assert ids('{"filters": {"year": 2020}}') == [1] and ids({"kind": "cluster", "cluster_id": 7}) == [2] and ids({"kind": "similar", "photo_id": 1}) == [2]
    assert ids({"kind": "text", "q": "x"}) == [2, 1] and ids({"kind": "color", "hex": "#000000"}) == [] and ids({"kind": "what"}) == []
    none = spark.createDataFrame([], "id long, name string, is_smart int, query_json string, created_at string")
    some = collections.create(collections.create(none, "a", {}, "t"), "b", {"kind": "filter"}, "t")
    assert [r["name"] for r in collections.listed(some).collect()] == ["b", "a"]
    after, there = collections.delete(some, 1)
    assert there and [r["name"] for r in after.collect()] == ["b"] and not collections.delete(after, 1)[1]
    with pytest.raises(ValueError):
        collections.create(some, "a", {}, "t")


def test_ingest(spark):
    full = {"embedding_ver": 1, "phash": "aa", "dominant_colors": "[]"}
    p = photos(spark, {"id": 1, **full}, {"id": 2, **full, "phash": ""}, {"id": 3, **full, "embedding_ver": None})
    c = spark.createDataFrame([("/p/1.jpg", 0.0, 0), ("/p/2.jpg", 0.0, 0), ("/p/3.jpg", 0.0, 0), ("/p/4.jpg", 0.0, 0)], "path string, mtime double, size_bytes long")
    assert sorted(r["path"] for r in ingest.needs_index(c, p).collect()) == ["/p/2.jpg", "/p/3.jpg", "/p/4.jpg"]
    assert [r["path"] for r in ingest.needs_index(c.withColumn("mtime", F.lit(5.0)).where("path = '/p/1.jpg'"), p).collect()] == ["/p/1.jpg"]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("b", 5, None), ("c", 6, "z")], "k string, n int, s string")
    assert sorted(map(tuple, ingest.upsert(old, new, "k").collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, "z")]
    v = spark.createDataFrame([(1,), (3,)], "photo_id long")
    assert [r["id"] for r in ingest.missing_embedding(p, v).collect()] == [2, 3]


def test_import(spark):
    rows = [
        (1, " /p/1.jpg", "s", 1, 1.0, "2020:01:02 03:04:05", " hi ", '["Dog", "dog ", "//x", "x:", "", "a\\nb", 3, "' + "y" * 41 + '", "cat"]', "t"), (2, "/n.jpg", "s", 1, 1.0, "2020-13-02 03:04:05", " ", "broken", "t"),
        (3, "/n.jpg", "s", 1, 1.0, "2020-01-02T03:04:05", None, None, "t"), (4, "/m.jpg", None, None, None, "junk", None, '["Dog", "dog ", "//x", "x:", "", "cat"]', "t"), (5, "/q.jpg", "s", 1, 1.0, None, None, None, None), (6, " ", "s", 1, 1.0, None, None, None, "t"),
    ]
    f = spark.createDataFrame(rows, "id long, path string, source string, size long, mtime double, exif_dt string, caption string, tags_json string, tagged_at string")
    f = f.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("sha256", "string"), ("phash", "string"), ("width", "int"), ("height", "int"))])
    p = photos(spark, {"id": 1})
    got = {r["file_id"]: r for r in ingest.import_rows(f, p).collect()}
    assert set(got) == {2, 4} and got[4]["tags"] == ["dog", "cat"] and got[2]["tags"] == [] and got[2]["captured_at"] is None and got[4]["imported_from"] == "photos.db:unknown"
    assert tuple(ingest.import_summary(f, p).first()) == (5, 2, 1, 1, 1)
    assert [(r["pos"], r["label"], r["score"]) for r in ingest.imported_tags(ingest.import_rows(f, p)).collect()] == [(0, "dog", 1.0), (1, "cat", 1.0)]


def test_sidecars(spark, tmp_path):
    p = photos(spark, {"id": 1, "path": "/a/b.jpg", "caption": "x < y & z", "aesthetic": 9.0, "captured_at": "2020"}, {"id": 2, "path": "/a/b.cr2"}, {"id": 3, "path": "/safe/../../evil/escape.jpg"}, {"id": 4, "path": "/c/d.jpg"})
    manual = spark.createDataFrame([(2, "Dog")], "photo_id long, name string")
    auto = spark.createDataFrame([(2, "dog", 0.9), (2, "weak", 0.2), (2, "strong", 0.8), (1, "cat", 0.7)], "photo_id long, label string, score double")
    tags = sidecar.sidecar_tags(manual, auto)
    assert {r["photo_id"]: r["tags"] for r in tags.collect()} == {1: ["cat"], 2: ["Dog", "strong"]}
    names = sidecar.sidecar_persons(faces(spark, (1, 2, None, 1, 5), (2, 2, None, 1, 5), (3, 2, None, 1, 6)), persons(spark, (5, "Zed"), (6, "Amy")))
    assert names.first()["persons"] == ["Amy", "Zed"]
    made = sidecar.sidecars(p, tags, names)
    rows = {r["target"]: r for r in made.collect()}
    assert rows["a/b.xmp"]["photo_id"] == 2 and set(rows) == {"a/b.xmp", "safe/../../evil/escape.xmp", "c/d.xmp"}
    one = sidecar.sidecars(p.where("id = 1"), tags, names).first()["packet"]
    body = ET.fromstring(one.split("\n")[1])
    assert "x < y & z" in "".join(body.itertext()) and body.find(".//{%s}Rating" % sidecar.SPACES["xmp"]).text == "4"
    (tmp_path / "c").mkdir()
    (tmp_path / "c/d.xmp").write_text("somebody else's")
    assert tuple(sidecar.write_sidecars(made, str(tmp_path)).first()) == (1, 1, 1, 3)
    assert (tmp_path / "a/b.xmp").stat().st_mode & 0o777 == 0o600 and (tmp_path / "c/d.xmp").read_text() == "somebody else's"
    assert tuple(sidecar.write_sidecars(made, str(tmp_path)).first()) == (1, 1, 1, 3) and not (tmp_path.parent / "evil").exists()
    assert sidecar.export_selection(p, ids=[]).count() == 0 and [r["id"] for r in sidecar.export_selection(p, prefix="/a/").collect()] == [1, 2]
    with pytest.raises(ValueError):
        sidecar.write_sidecars(made, "relative")


def test_files_and_hooks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b c.JPG").write_bytes(b"x" * 70_000)
    (tmp_path / "a.png").write_bytes(b"?")
    (tmp_path / "n.txt").write_text("no")
    f = files.media_files(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.fingerprints(f).collect()}
    import hashlib

    assert set(rows) == {"b c.JPG", "a.png"} and rows["b c.JPG"]["sha256"] == hashlib.sha256(b"x" * 65536).hexdigest() and rows["b c.JPG"]["size_bytes"] == 70_000
    broken = f.withColumn("content", F.when(~F.col("path").endswith("a.png"), F.col("content")))
    got = {r["path"].rsplit("/", 1)[1]: r["embedding"] for r in hooks.encode_files(broken, lambda: hooks.fake_encoder(8)).collect()}
    assert got["a.png"] is None and np.linalg.norm(got["b c.JPG"]) == pytest.approx(1)
    face = {"corners": (1, 2, 11, 22), "score": 0.9, "embedding": [1.0]}
    rows = hooks.detect_faces(f, lambda: lambda content: [face, face]).collect()
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in rows] == [(1, 2, 10, 20)] * 4
    gray = np.add.outer(np.arange(64), np.arange(80)).astype(float)
    assert len(hooks.perceptual_hash(gray)) == 16 and hooks.perceptual_hash(gray) == hooks.perceptual_hash(gray * 2)


def test_external_catalog(spark, tmp_path):
    path = tmp_path / "photos.db"
    with sqlite3.connect(path) as c:
        c.execute("create table files (id integer primary key, path text, tagged_at text, tags_json text, size integer)")
        c.executemany("insert into files values (?, ?, ?, ?, ?)", [(i * 7, f"/x/{i}.jpg", "t" if i % 2 else None, '["a"]', i) for i in range(1, 101)])
    df = sqlite.external_files(spark, str(path), 5)
    assert df.count() == 100 and df.where("tagged_at is not null").count() == 50 and df.select(F.sum("size")).first()[0] == 5050


def test_jobs(spark):
    table, one = jobs.queue(spark.createDataFrame([], jobs.SCHEMA), 3)
    table, two = jobs.queue(table, None)
    table = jobs.progress(jobs.start(table, one, "2026-01-01T00:00:00Z", 10), one, 8)
    with pytest.raises(ValueError):
        jobs.start(table, one, "t")
    table = jobs.finish(jobs.finish(table, one, "2026-01-01T00:00:04Z"), two, "t", "lost")
    assert {r["id"]: (r["state"], r["total"], r["processed"], r["error"]) for r in table.collect()} == {one: ("done", 10, 8, None), two: ("failed", None, 0, "lost")}
    assert [tuple(r) for r in jobs.throughput(table).collect()] == [(one, 4.0, 2.0)]
