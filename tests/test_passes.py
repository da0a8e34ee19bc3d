"""Pictures from bytes, scans, backfills, imports, online clustering and the plans of lists."""

import functools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumika import session
from lumika.operators import color, ingest, listing, people, scan, search, sidecar
from lumika.plans import catalog
from lumika.sources import pictures
from lumika.sources.hooks import fake_encoder, perceptual_hash
from lumika.streaming import watch

PHOTO = (
    "id long, path string, mtime double, size_bytes long, sha256 string, width int, height int, orientation int, exif_json string, captured_at string, indexed_at string,"
    " embedding_ver int, thumb_small string, phash string, face_count int, aesthetic double, dominant_colors string, caption string, x string"
)
NAMES = [c.split()[0] for c in PHOTO.split(", ")]


def picture(seed, h=20, w=30):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def png(pixels, kind, tags=b""):
    """A PNG whose lines all have one filter, written the plain way."""
    h, w, _ = pixels.shape
    flat, out = pixels.reshape(h, -1).astype(int), b""
    for y in range(h):
        line = []
        for x in range(w * 3):
            left, up = (flat[y, x - 3] if x > 2 else 0), (flat[y - 1, x] if y else 0)
            corner = flat[y - 1, x - 3] if y and x > 2 else 0
            paeth = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            line.append((flat[y, x] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *line])
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + (part(b"eXIf", tags) if tags else b"") + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


def tiff(order="<"):
    """Model, orientation, and in the EXIF directory a time and an exposure."""
    make, taken, p = b"X-100\0", b"2021:05:06 07:08:09\0", struct.pack
    first = p(order + "H", 3) + p(order + "HHII", 0x0110, 2, len(make), 100) + p(order + "HHIHH", 0x0112, 3, 1, 6, 0) + p(order + "HHII", 0x8769, 4, 1, 60) + p(order + "I", 0)
    second = p(order + "H", 2) + p(order + "HHII", 0x9003, 2, len(taken), 110) + p(order + "HHII", 0x829A, 5, 1, 140) + p(order + "I", 0)
    block = (b"II*\0" if order == "<" else b"MM\0*") + p(order + "I", 8) + first
    block = block.ljust(60, b"\0") + second
    return block.ljust(100, b"\0") + make.ljust(10, b"\0") + taken.ljust(30, b"\0") + p(order + "II", 1, 250)


@pytest.mark.parametrize("kind", range(5))
def test_png_with_each_filter(kind):
    assert (pictures.decode(png(picture(kind), kind)) == picture(kind)).all()
    assert (pictures.decode(pictures.encode_png(picture(kind))) == picture(kind)).all()


def test_pixmaps_and_unknown_files():
    gray = b"P5\n# c\n3 2\n255\n" + bytes(range(6))
    assert pictures.decode(gray)[1, 2].tolist() == [5, 5, 5]
    assert pictures.decode(b"Q!", {b"Q": lambda d: np.zeros((1, 1, 3))}).shape == (1, 1, 3)
    with pytest.raises(ValueError):
        pictures.decode(b"nothing")


@pytest.mark.parametrize("order", "<>")
def test_exif_of_each_container(order):
    want = {"Image Model": "X-100", "Image Orientation": "6", "EXIF DateTimeOriginal": "2021:05:06 07:08:09", "EXIF ExposureTime": "1/250"}
    block = tiff(order)
    app = b"Exif\0\0" + block
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda\x00\x02"
    assert pictures.exif(block) == pictures.exif(jpeg) == pictures.exif(png(picture(1), 0, block)) == want
    assert pictures.exif(block[:40]) == {k: want[k] for k in pictures.exif(block[:40])} and pictures.exif(b"") == pictures.exif(b"\xff\xd8") == {}


def test_upright_and_shrunk():
    p = picture(2, 4, 6)
    assert pictures.upright(p, 6).shape == (6, 4, 3) and (pictures.upright(pictures.upright(p, 6), 8) == p).all() and (pictures.upright(p, 99) == p).all()
    assert all((pictures.upright(pictures.upright(p, k), k) == p).all() for k in (2, 3, 4, 5, 7))
    small = pictures.shrink(picture(3, 100, 50), 20)
    assert small.shape == (20, 10, 3) and (pictures.shrink(p, 6) == p).all()
    assert perceptual_hash(picture(5, 320, 192)[..., 0]) == perceptual_hash(np.repeat(np.repeat(picture(5, 320, 192)[..., 0], 2, 0), 2, 1))
    assert pictures.crop_pixels(picture(1, 50, 50), (10, 5, 40, 45), 20).shape == (20, 15, 3)


def catalog_of(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], PHOTO)


def files_of(spark, rows):
    return spark.createDataFrame([(p, float(m), len(c or b""), c, "x") for p, m, c in rows], "path string, mtime double, size_bytes long, content binary, id string").repartition(2)


encoder = functools.partial(fake_encoder, 8)


def test_a_scan_and_the_next_one(spark):
    rows = [(f"/r/{k}.png", k, png(picture(k), k % 5, tiff() if k % 2 else b"")) for k in range(8)] + [("/r/bad.png", 1, b"broken"), ("/r/empty.png", 1, None)]
    old = catalog_of(spark, {"id": 7, "path": "/r/3.png", "mtime": 99.0, "caption": "kept", "phash": "old"}, {"id": 2, "path": "/gone.png", "mtime": 1.0})
    vectors = spark.createDataFrame([(7, [0.0] * 8), (2, [1.0] * 8)], "photo_id long, embedding array<float>")
    files = files_of(spark, rows + rows[:2])
    out = scan.scan(files, old, vectors, encoder, "2026-01-01T00:00:00Z")
    assert tuple(out.summary.first()) == (10, 10, 8, 2) and {r["path"] for r in out.errors.collect()} == {"/r/bad.png", "/r/empty.png"}
    got = {r["path"]: r for r in out.photo.collect()}
    assert len(got) == 9 and got["/r/3.png"]["id"] == 7 and got["/r/3.png"]["caption"] == "kept" and got["/r/3.png"]["phash"] != "old" and got["/gone.png"]["id"] == 2
    assert sorted(r["id"] for r in got.values()) == [2, 7, 8, 9, 10, 11, 12, 13, 14] and [got[f"/r/{k}.png"]["id"] for k in (0, 1, 2, 4)] == [8, 9, 10, 11]
    assert got["/r/1.png"]["captured_at"] == "2021-05-06T07:08:09+00:00" and got["/r/1.png"]["orientation"] == 6 and got["/r/0.png"]["captured_at"] is None and got["/r/1.png"]["width"] == 30
    kept = {r["photo_id"]: r["embedding"] for r in out.vectors.collect()}
    assert set(kept) == set(range(7, 15)) | {2} and kept[2] == [1.0] * 8 and any(kept[7])
    again = scan.scan(files, out.photo, out.vectors, encoder, "2026-02-01T00:00:00Z")
    assert tuple(again.summary.first()) == (10, 2, 0, 2) and again.photo.where("indexed_at like '2026-02%'").count() == 0
    none = scan.scan(files.limit(0), old.limit(0), vectors.limit(0), encoder, "t")
    assert tuple(none.summary.first()) == (0, 0, 0, 0) and none.photo.count() == 0


def test_a_scan_brings_no_file_s_features_to_the_driver(spark, monkeypatch):
    """Features that repeat are small as files; their joins must not be planned as broadcasts for that."""
    plans, write = [], session.materialize

    def spy(df, arrow_rows=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, arrow_rows)

    monkeypatch.setattr(session, "materialize", spy)
    files = files_of(spark, [(f"/r/{k}.png", k, png(picture(k), 0)) for k in range(4)])
    scan.scan(files, catalog_of(spark), spark.createDataFrame([], "photo_id long, embedding array<float>"), encoder, "t")
    joined = [p for p in plans if "Join" in p and "embedding" in p]
    assert len(joined) >= 2 and not any("Broadcast" in p for p in joined)


def test_backfills_write_and_mark_failures(spark):
    photo = catalog_of(spark, *[{"id": k, "path": f"/r/{k}.png", "dominant_colors": "[]" if k == 5 else None, "embedding_ver": 1 if k < 3 else None} for k in range(1, 7)])
    files = files_of(spark, [(f"/r/{k}.png", 1, png(picture(k), 0) if k != 2 else b"bad") for k in range(1, 5)])
    out = scan.backfill_colors(photo, files)
    got = {r["id"]: r["dominant_colors"] for r in out.photo.collect()}
    assert tuple(out.summary.first()) == (5, 3, 2) and got[2] == got[6] == got[5] == "[]" and "weight" in got[1]
    assert {r["path"] for r in out.errors.collect()} == {"/r/2.png", "/r/6.png"} and scan.backfill_colors(out.photo, files).summary.first()[0] == 0
    assert tuple(scan.backfill_colors(photo, files, limit=2).summary.first()) == (2, 1, 1)
    vectors = spark.createDataFrame([(1, [0.0] * 8)], "photo_id long, embedding array<float>")
    out = scan.backfill_vectors(photo, vectors, files, encoder, "now")
    assert tuple(out.summary.first()) == (5, 3, 2) and {r["photo_id"] for r in out.vectors.collect()} == {1, 2, 3, 4}
    assert {r["id"] for r in out.photo.where("indexed_at = 'now'").collect()} == {2, 3, 4} and out.photo.where("embedding_ver = 1").count() == 4
    assert tuple(scan.backfill_vectors(photo, vectors, files, encoder, "now", limit=1).summary.first()) == (1, 1, 0)


def test_numbers_follow_the_order(spark):
    names = [f"n{k:04d}" for k in range(500)]
    random.Random(1).shuffle(names)
    got = scan.numbered(spark.createDataFrame([(n,) for n in names], "path string").repartition(7), "path", 41).collect()
    assert sorted((r["path"], r["id"]) for r in got) == [(f"n{k:04d}", 41 + k) for k in range(500)]


def test_imported_tags_reach_their_photos(spark):
    kinds = "id long, path string, source string, size long, mtime double, sha256 string, phash string, width int, height int, exif_dt string, caption string, tags_json string, tagged_at string"
    rows = [(k, f" /e/{k}.jpg ", "s", 1, 1.0, None, None, 1, 1, None, None, '["Sea", "sun", "sea"]', "t") for k in range(1, 6)]
    files, photo = spark.createDataFrame(rows, kinds), catalog_of(spark, {"id": 9, "path": "/e/1.jpg"})
    taken = ingest.import_rows(files, photo)
    after = photo.select("id", "path").unionByName(scan.numbered(taken.select("path"), "path", scan.next_id(photo)).select("id", "path"))
    assert sorted(tuple(r) for r in ingest.tags_of_photos(taken, after).collect()) == sorted((i, t, 1.0) for i in (10, 11, 12, 13) for t in ("sea", "sun"))
    present = spark.createDataFrame([("/e/3.jpg",), ("/e/5.jpg",), ("/e/1.jpg",)], "path string")
    assert [r["file_id"] for r in ingest.import_rows(files, photo, present=present).orderBy("file_id").collect()] == [3, 5]
    assert {r["file_id"] for r in ingest.import_rows(files, photo, limit=2).collect()} == {2, 3} and ingest.import_rows(files, photo, limit=0).count() == 0


def plain_clusters(x, centroids, next_id, threshold=people.THRESHOLD):
    names, rows, out = list(centroids), [np.array(v, float) for v in centroids.values()], []
    for v in x:
        sims = [r @ v for r in rows]
        best = int(np.argmax(sims)) if sims else -1
        if best >= 0 and sims[best] >= threshold:
            rows[best] = (rows[best] + v) / 2
            rows[best] /= np.linalg.norm(rows[best])
        else:
            best = len(rows)
            rows.append(v)
            names.append(next_id)
            next_id += 1
        out.append(names[best])
    return out


def unit_rows(seed, n, people_, dim=16, noise=0.25):
    r = np.random.default_rng(seed)
    x = r.standard_normal((people_, dim))[r.integers(0, people_, n)] + noise * r.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def test_centroids_in_chunks_are_those_one_by_one():
    x = unit_rows(1, 900, 150)
    held = people.Centroids(16)
    got = [c for at in range(0, 900, 130) for c in held.place(x[at : at + 130])]
    assert got == plain_clusters(x, {}, 1)


def test_new_faces_start_from_the_stored_clusters(spark):
    x = unit_rows(3, 120, 12)
    faces = spark.createDataFrame([(i, 1, None, (5 if i < 4 else 8) if i < 8 else None, None) for i in range(120)], "id long, photo_id long, bbox_json string, cluster_id long, person_id long")
    vectors = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)] + [(3, [float(v) for v in x[3]]), (50, [float(v) for v in x[50]]), (500, None), (7, [1.0])], "face_id long, embedding array<float>").repartition(3)
    start = {5: x[:4].mean(0), 8: x[4:8].mean(0)}
    got = {r["face_id"]: r["cluster_id"] for r in people.index_faces(faces, vectors, 16).collect()}
    assert [got[i] for i in range(8, 120)] == plain_clusters(x[8:], start, 9) and len(got) == 112
    assert people.next_cluster_id(faces) == 9 and people.next_cluster_id(faces.limit(0)) == 1 and people.index_faces(faces.limit(0), vectors, 16).count() == 0


def test_online_clusters_skip_unusable_vectors(spark):
    x = unit_rows(4, 60, 6)
    rows = [("a" if i % 2 else None, i, [float(v) for v in x[i]]) for i in range(60)]
    odd = [("a", 100, None), ("a", 101, [1.0]), ("a", 102, [0.0] * 16), (None, None, [1.0] * 16), ("a", 103, [float("inf")] * 16)]
    got = people.online_clusters(spark.createDataFrame(rows + rows[:9] + odd, "g string, face_id long, embedding array<float>").repartition(4), "g", dim=16).collect()
    for g, own in (("a", [i for i in range(60) if i % 2]), (None, [i for i in range(60) if not i % 2])):
        assert [r["cluster"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["face_id"])] == plain_clusters(x[own], {}, 1)


def test_exports_need_a_selector(spark):
    photo = catalog_of(spark, {"id": 1, "path": "/a/1.jpg"}, {"id": 2, "path": "/b/2.jpg"})
    for none in ({}, {"ids": []}, {"prefix": ""}):
        with pytest.raises(ValueError):
            sidecar.chosen_for_export(photo, **none)
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(sidecar.chosen_for_export(photo, everything=True)) == [1, 2] and ids(sidecar.chosen_for_export(photo, ids=[2])) == [2]
    put = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, None)], "collection_id long, photo_id long")
    assert ids(sidecar.chosen_for_export(photo, members=sidecar.members_of(put, 1))) == [2]
    tags = sidecar.manual_tags(spark.createDataFrame([(1, 7), (1, 7), (1, 9), (None, 7)], "photo_id long, tag_id long"), spark.createDataFrame([(7, "Dog", "x"), (8, "Cat", "x")], "id long, name string, photo_id string"))
    assert [tuple(r) for r in tags.collect()] == [(1, "Dog")]


def test_palette_histogram(spark):
    rows = [("a", 1, 2, 3)] * 6 + [("a", 9, 9, 9)] * 3 + [("a", 0, 0, 0)] * 3 + [("b", 5, 5, 5)]
    got = [tuple(r) for r in color.palette_histogram(spark.createDataFrame(rows, "path string, r int, g int, b int"), "path", 2).orderBy("path", "rank").collect()]
    assert got == [("a", 1, 1, 2, 3, 0.5), ("a", 2, 0, 0, 0, 0.25), ("b", 1, 5, 5, 5, 1.0)]


def test_search_by_an_image_file(spark):
    photo = catalog_of(spark, {"id": 1, "path": "/a"}, {"id": 2, "path": "/b"})
    wanted = fake_encoder(8)([b"pixels"])[0]
    vectors = spark.createDataFrame([(1, [float(v) for v in -wanted]), (2, [float(v) for v in wanted])], "photo_id long, embedding array<float>")
    got = search.by_image(photo, vectors, b"pixels", encoder, 1).collect()
    assert [r["photo_id"] for r in got] == [2] and got[0]["score"] == pytest.approx(1, abs=1e-6)
    assert search.by_image(photo, vectors, b"", encoder).count() == 0


def executed(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_lie_below_the_aggregate(spark, small):
    rows = catalog.rows(spark, small)
    for df in (listing.photo_list(rows, where=listing.predicate(year=2019)), listing.total(rows, listing.predicate(year=2019)), listing.lookup(rows, 60)):
        plan = executed(df)
        assert plan.index("Aggregate [id") < plan.index("Filter"), plan
    physical = listing.total(rows, listing.predicate(year=2019))._jdf.queryExecution().executedPlan().toString()
    assert "exif_json" not in physical.split("ReadSchema")[1]


def test_building_a_list_runs_no_job(spark, small):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name in ("photo_list_newest", "photo_filter_camera", "photo_total", "photo_lookup", "facet_years", "color_search"):
            catalog.QUERIES[name](spark, small)
        # readers of files list them, which is no job of ours
        assert all(info is None or info.numTasks <= 1 for j in tracker.getJobIdsForGroup("building") for s in tracker.getJobInfo(j).stageIds for info in [tracker.getStageInfo(s)])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_streams_agree_with_batches_and_report_progress(spark, tmp_path):
    events = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:00:03"), (1, "2026-01-01 00:01:00"), (2, "2026-01-01 00:00:01"), (None, "2026-01-01 00:00:01")], "root long, at string")
    events = events.select("root", F.col("at").cast("timestamp").alias("at"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in watch.drain(watch.debounce(stream, "root", "at", late="1 hour"), "t").collect())
    assert got == sorted(tuple(r) for r in watch.debounce(events, "root", "at").collect()) and len(got) == 3
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = watch.progress(query).collect()
    assert rows and sum(r["rows"] for r in rows) == 5
