"""Survivors with source quality, and record linkage."""

import random

from pyspark.sql import functions as F

from lumika.llm.linkage import best_names, file_evidence, link, name_similarity, photo_evidence, picture_classes, shared_keys, transitive, with_leads
from lumika.llm.survivors import claim_truth, survivors, true_values

PHOTO = "id long, path string, size_bytes long, sha256 string, width int, height int, exif_json string, captured_at string, phash string, h string"
FILE = "id long, path string, size long, sha256 string, width int, height int, exif_dt string, phash string, h string"


def test_claims_of_good_sources_are_believed(spark):
    r = random.Random(1)
    claims, present, truth = [], [], {}
    for g in range(150):
        truth[g] = f"v{g}"
        for source, right in (("good", 0.97), ("fair", 0.9), ("fair2", 0.9), ("bad", 0.15)):
            present.append((g, source))
            claims.append((g, "f", truth[g] if r.random() < right else f"w{g}-{source}", source))
    claims += claims[:5] + [(0, "f", None, "good"), (None, "f", "x", "good"), (1, "f", "y", None)]
    c = spark.createDataFrame(claims, "group_id long, field_name string, value string, source string")
    p = spark.createDataFrame(present + present[:3], "group_id long, source string")
    rows = claim_truth(c, p).collect()
    right = [x["posterior"] for x in rows if x["value"] == truth[x["group_id"]]]
    wrong = [x["posterior"] for x in rows if x["value"].startswith("w") and x["value"].endswith("bad")]
    assert sum(right) / len(right) > 0.9 and sum(wrong) / len(wrong) < 0.2
    got = {x["group_id"]: x["value"] for x in true_values(c, p).where("best").collect()}
    assert sum(got.get(g) == truth[g] for g in truth) >= 0.95 * len(truth)
    assert claim_truth(c.limit(0), p).count() == 0


def test_a_field_may_keep_several_true_values(spark):
    claims = [(g, "tag", t, s) for g in range(60) for s in ("a", "b", "c") for t in ("x", "y")] + [(g, "tag", "z", "d") for g in range(60)]
    present = [(g, s) for g in range(60) for s in "abcd"]
    c, p = spark.createDataFrame(claims, "group_id long, field_name string, value string, source string"), spark.createDataFrame(present, "group_id long, source string")
    got = true_values(c, p, ("tag",)).collect()
    assert sorted((r["group_id"], r["value"]) for r in got) == [(g, t) for g in range(60) for t in "xy"]
    assert sum(r["best"] for r in got) == 60
    # of a single-valued field two values that as many sources state can't both be true, nor is one of them more probable
    assert true_values(c, p).count() == 0


def test_planted_truth_is_found_with_few_errors(spark):
    """Sources of known quality; precision and recall of the values judged true, for single- and multi-valued fields."""
    r = random.Random(5)
    quality = {"archive": (0.95, 0.02), "phone": (0.9, 0.1), "mirror": (0.85, 0.05), "scraper": (0.5, 0.5), "cloud": (0.8, 0.1)}
    claims, present, truth = [], [], set()
    for g in range(400):
        sources = r.sample(sorted(quality), r.randrange(3, 6))
        present += [(g, s) for s in sources]
        tags = r.sample(range(40), r.randrange(1, 4))
        truth |= {(g, "width", f"{1000 + g}")} | {(g, "tag", f"t{t}") for t in tags}
        for s in sources:
            hit, false = quality[s]
            claims.append((g, "width", f"{1000 + g}" if r.random() < hit else f"{r.randrange(10)}", s))
            claims += [(g, "tag", f"t{t}", s) for t in tags if r.random() < hit]
            claims += [(g, "tag", f"t{t}", s) for t in r.sample(range(40), 2) if t not in tags and r.random() < false]
    c, p = spark.createDataFrame(claims, "group_id long, field_name string, value string, source string"), spark.createDataFrame(present, "group_id long, source string")
    rows = true_values(c, p, ("tag",)).collect()
    stated = {tuple(x[:3]) for x in claims}
    for field, precision, recall in (("width", 0.97, 0.95), ("tag", 0.93, 0.9)):
        got = {(x["group_id"], field, x["value"]) for x in rows if x["field_name"] == field}
        want = {t for t in truth if t[1] == field and t in stated}
        print(field, len(got & want) / len(got), len(got & want) / len(want))
        assert len(got & want) >= precision * len(got) and len(got & want) >= recall * len(want)
    assert len({(x["group_id"]) for x in rows if x["field_name"] == "width"}) == sum(x["field_name"] == "width" for x in rows)


def test_survivors_follow_the_order_and_smallest_id(spark):
    rows = [(5, 1, "s", 10, 7), (3, 1, "t", 10, 9), (9, 1, "s", None, 2), (4, 2, "s", 1, 1), (7, 3, "s", None, None), (8, 3, "t", None, 5), (2, None, "s", 1, 1)]
    copies = spark.createDataFrame(rows, "id long, h long, source string, x long, y long").where("h is not null")
    got = {(r["group_id"], r["field_name"]): r["photo_id"] for r in survivors(copies, {"x": (F.col("x"), F.col("x")), "y": (F.col("y"), -F.col("y"))}).collect()}
    assert got == {(3, "x"): 3, (3, "y"): 9, (7, "y"): 8}
    assert survivors(copies.limit(0), {"x": (F.col("x"), F.col("x"))}).count() == 0


def test_links_of_moved_resized_and_renamed_pictures(spark):
    r = random.Random(4)
    photo, files, want = [], [], set()
    for i in range(1, 121):
        h, size, sha = r.getrandbits(64), r.randrange(500_000, 9_000_000), f"{r.getrandbits(256):064x}"
        at = f"2019:{r.randrange(1, 13):02d}:{r.randrange(1, 29):02d} {r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}"
        photo.append((i, f"/vault/2019/IMG_{4000 + i}.jpg", size, sha, 4000, 3000, '{"EXIF DateTimeOriginal": "%s"}' % at, None, f"{h:016x}", "x"))
        kind = i % 4
        if kind == 0:  # renamed, the same bytes
            files.append((1000 + i, f"D:\\x\\untitled_{r.randrange(10**6)}.jpg", size, sha.upper(), 4000, 3000, at, None, "x"))
        elif kind == 1:  # scaled and saved again
            files.append((1000 + i, f"/nas/IMG_{4000 + i} (1).webp", size // 4, None, 2000, 1500, at.replace(":", "-", 2), f"{h ^ (1 << r.randrange(64)):016X}", "x"))
        elif kind == 2:  # moved, with a clock an hour off and little else known
            hour = (int(at[11:13]) + 1) % 24
            files.append((1000 + i, f"/old/IMG_{4000 + i}.jpg", size, None, None, None, f"{at[:11]}{hour:02d}{at[13:]}" if hour else at, f"{h:016x}", "x"))
        else:  # the next shot of the scene
            late = f"{at[:14]}{(int(at[14:16]) + 7) % 60:02d}:{(int(at[17:]) + 13) % 60:02d}"
            files.append((1000 + i, f"/nas/IMG_{4001 + i}.jpg", int(size * r.choice([0.8, 1.3])), f"{r.getrandbits(256):064x}", 4000, 3000, late, f"{h ^ 0b10110:016x}", "x"))
        if kind < 3:
            want.add((i, 1000 + i))
    photo += photo[:3] + [(900, None, None, None, None, None, None, None, None, None), (None, "/x", 1, None, 1, 1, None, None, None, None)]
    files += files[:3] + [(9000, None, None, None, None, None, None, None, None), (None, "/x", 1, None, 1, 1, None, None, None)]
    p, f = spark.createDataFrame(photo, PHOTO), spark.createDataFrame(files, FILE)
    rows = link(p, f).collect()
    got = {(x["photo_id"], x["file_id"]) for x in rows}
    assert len(rows) == len({x["file_id"] for x in rows}) and len(got & want) >= 0.97 * len(want) and len(got - want) <= 3
    assert all(0.5 <= x["posterior"] <= 1 for x in rows)
    assert link(p.limit(0), f).count() == 0 and link(p, f.limit(0)).count() == 0


def test_files_of_a_copy_get_the_copy_by_its_name(spark):
    r = random.Random(6)
    photo, files, want = [], [], set()
    for i in range(1, 81):
        h, size, sha, at = r.getrandbits(64), r.randrange(500_000, 9_000_000), f"{r.getrandbits(256):064x}", f"2019:0{i % 9 + 1}:{i % 28 + 1:02d} {i % 24:02d}:{i % 60:02d}:{i * 7 % 60:02d}"
        for k, name in ((i, f"holiday{1000 + 7 * i}"), (500 + i, f"IMG_{4000 + i}")):  # copies alike but for their names
            photo.append((k, f"/vault/{name}.jpg", size, sha, 4000, 3000, '{"EXIF DateTimeOriginal": "%s"}' % at, None, f"{h:016x}", "x"))
        name, taken = ((f"IMG_{4000 + i} (1)", at), (f"IMG_{4000 + i}", None))[i % 2]  # contains the second copy's name, or has it without a time
        files.append((1000 + i, f"/nas/{name}.webp", size // 4, None, 2000, 1500, taken, f"{h:016x}", "x"))
        want.add((500 + i, 1000 + i))
    rows = link(spark.createDataFrame(photo, PHOTO), spark.createDataFrame(files, FILE)).collect()
    assert {(x["photo_id"], x["file_id"]) for x in rows} == want and len(rows) == len(want)


def test_best_names_are_those_of_all_copies(spark):
    r = random.Random(7)
    core = lambda: r.choice(["", "img", "imgx", "dsc", "holiday"]) + r.choice(["", "1", "1234", "12345", "2345", "91234"]) + r.choice(["", "a", "copy"])
    copies = [(lead, 10 * lead + k, core() if r.random() < 0.95 else None) for lead in range(1, 60) for k in range(r.randrange(1, 6))]
    asked = sorted({(lead, core()) for lead in range(1, 60) for _ in range(8)})
    c, a = spark.createDataFrame(copies, "lead long, id long, core string"), spark.createDataFrame(asked, "lead long, f_core string")
    score = F.coalesce(name_similarity(F.col("core"), F.col("f_core")), F.lit(0.5))
    brute = a.join(c, "lead").groupBy("lead", "f_core").agg(F.max_by("id", F.struct(score, -F.col("id"))).alias("id"))
    got = {(x["lead"], x["f_core"]): x["best"]["id"] for x in best_names(a, c).collect()}
    assert got == {(x["lead"], x["f_core"]): x["id"] for x in brute.collect()} and len(got) == len(asked)


def test_equal_rivals_share_the_probability_and_copies_do_not(spark):
    rows = [(1, 10 + k, k, 9.0) for k in range(4)] + [(2, 20, 0, 9.0), (2, 21, 0, 9.0), (3, 30, 0, 9.0), (3, 31, 1, 0.001)]
    got = {r["photo_id"]: r["posterior"] for r in transitive(spark.createDataFrame(rows, "file_id long, photo_id long, picture long, odds double")).collect()}
    assert all(abs(got[10 + k] - 9 / 37) < 1e-9 for k in range(4))  # four pictures: none is more probable than not
    assert abs(got[20] - 0.9) < 1e-9 and abs(got[21] - 0.9) < 1e-9  # two copies of one picture
    assert got[30] > 0.89 and got[31] < 0.001


def test_pairs_with_far_hashes_stay_candidates_if_another_key_agrees(spark):
    at = '{"EXIF DateTimeOriginal": "2019:05:01 10:20:30"}'
    far = f"{0xF0F0F0F0F0F0F0F0:016x}", f"{0xF0F0F0F00F0F0F0F:016x}"
    photo = spark.createDataFrame([(1, "/v/IMG_4001.jpg", 1000, None, 40, 30, at, None, far[0], "x"), (2, "/v/other.jpg", 999, "a" * 64, 40, 30, None, None, f"{2**40 + 5:016x}", "x")], PHOTO)
    files = spark.createDataFrame([(10, "/n/IMG_4001.jpg", 500, None, 20, 15, "2019:05:01 10:20:30", far[1], "x"), (11, "/n/q.jpg", 5, "a" * 16 + "b" * 48, 1, 1, None, f"{2**40 + 5 + 0b111:016x}", "x")], FILE)
    found = shared_keys(with_leads(photo_evidence(photo)), file_evidence(files)).collect()
    assert {(r["p_id"], r["f_id"]) for r in found} == {(1, 10), (2, 11)}


def test_classes_of_photos_alike_but_for_their_names(spark):
    rows = [(5, "/a/x.jpg", 9, None, 4, 3, None, None, "00000000000000ff", "c"), (3, "/b/y.jpg", 9, None, 4, 3, None, None, "00000000000000FF", "c"), (7, "/a/z.jpg", 8, None, 4, 3, None, None, "00000000000000ff", "c"), (8, None, None, None, None, None, None, None, None, None), (9, None, None, None, None, None, None, None, None, None)]
    got = {r["id"]: r["class_id"] for r in picture_classes(spark.createDataFrame(rows + rows[:1], PHOTO)).collect()}
    assert got == {3: 3, 5: 3, 7: 7, 8: 8, 9: 9}
