"""Records of two tables that describe the same picture, matched without a common key.

Candidates share one of several blocking keys; each is a vector of similarities of the attributes both tables have. Two
Gaussians, one of matched and one of unmatched vectors, are fitted without labels by expectation-maximisation, with a
ridge on their covariances. Transitivity holds in every expectation step: if a file matches two photos, these match each
other. So a file's candidates are weighed by picture: copies of one picture, which have one hash, may match it together,
while different pictures rival for it. What comes out is each candidate's own posterior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumika.operators.dupes import chunk_keys
from lumika.operators.instants import MICROS, exif_tags, with_stated
from lumika.operators.joins import split_join
from lumika.session import Scratch, materialize
from lumika.tables import hamming, usable_phash

FEATURES = ("taken", "density", "name", "hash", "digest", "shape")
UNKNOWN = 0.5
RIDGE = 0.02
TOLERANCE, MOST_ROUNDS = 1e-4, 50
#: Hashes at most so many bits apart are candidates for that alone.
NEAR_BITS = 5
_QUARTER = 900


def _core(path: Column) -> Column:
    """Letters and digits of the file name without its extension, in lower case."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")), r"[^\p{L}\p{N}]", "")


def _hex(digest: Column) -> Column:
    """The hex digits of a digest, cut-off ones from 16 digits on."""
    text = F.regexp_replace(F.lower(F.trim(digest)), "^sha256:", "")
    return F.when(text.rlike("^[0-9a-f]{16,64}$") & ~text.rlike("^0+$"), text)


def _photo_rows(photo: DataFrame) -> DataFrame:
    """The evidence of each row of `photo` that has an id."""
    rows = photo.where("id is not null").select(
        "id", _core(F.col("path")).alias("core"), _hex(F.col("sha256")).alias("digest"), usable_phash().alias("h"),
        F.when(F.col("size_bytes") > 0, F.col("size_bytes")).alias("size"), F.when(F.col("width") > 0, F.col("width")).alias("w"),
        F.when(F.col("height") > 0, F.col("height")).alias("ht"), "captured_at", exif_tags(F.col("exif_json"), {"taken": "EXIF DateTimeOriginal"})["taken"].alias("taken"),
    )
    rows = with_stated(with_stated(rows, "captured_at", "c"), "taken", "e")
    second = lambda x: F.floor(x / MICROS)
    return rows.select("id", "core", "digest", "h", "size", "w", "ht", second(F.col("e.local")).alias("t1"), second(F.coalesce("c.local", "c.utc")).alias("t2"))


def photo_evidence(photo: DataFrame) -> DataFrame:
    """One row for each distinct picture record of `photo`: id (the smallest of records alike in all evidence) and evidence."""
    rows = _photo_rows(photo)
    alike = [c for c in rows.columns if c != "id"]
    return materialize(rows.groupBy(*alike).agg(F.min("id").alias("id")))


def picture_classes(photo: DataFrame) -> DataFrame:
    """(id, class_id): for every photo the smallest id of those alike in all but their names, which blocking takes as one record.

    With a file's photo it gives every copy of that photo, so that copies need not be expanded into pairs.
    """
    with Scratch() as made:
        rows = _with_alike(_photo_rows(photo)).select("id", "alike").distinct()
        rows = made.table(rows)
        least = rows.groupBy("alike").agg(F.min("id").alias("class_id"))
        return materialize(split_join(rows, least, "alike", rows=rows.count()).select("id", "class_id"))


def file_evidence(files: DataFrame) -> DataFrame:
    rows = files.where("id is not null").select(
        "id", _core(F.col("path")).alias("core"), _hex(F.col("sha256")).alias("digest"), usable_phash().alias("h"),
        F.when(F.col("size") > 0, F.col("size")).alias("size"), F.when(F.col("width") > 0, F.col("width")).alias("w"),
        F.when(F.col("height") > 0, F.col("height")).alias("ht"), "exif_dt",
    )
    rows = with_stated(rows.dropDuplicates(["id"]), "exif_dt", "e")
    return materialize(rows.select("id", "core", "digest", "h", "size", "w", "ht", F.floor(F.col("e.local") / MICROS).alias("t1"), F.lit(None).cast("long").alias("t2")))


def _named_keys(df: DataFrame) -> DataFrame:
    """(key, id): blocking keys of a record's name with its size or time, and of size and time."""
    tag = lambda name, *parts: F.xxhash64(F.lit(name), *parts)
    both = lambda name, a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), tag(name, a, b))
    df = df.withColumn("core", F.when(F.length("core") >= 4, F.col("core")))
    keys = [both("core size", "core", "size")] + [both(f"{x} t", x, t) for x in ("core", "size") for t in ("t1", "t2")]
    return df.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))


def _with_alike(records: DataFrame) -> DataFrame:
    """`records` with alike: the digest of all their evidence but the name; their id if there is none to go by."""
    alike = [c for c in records.columns if c not in ("id", "core")]
    known = F.col("digest").isNotNull() | F.col("h").isNotNull() | F.col("size").isNotNull()
    text = F.to_json(F.struct(*alike), {"ignoreNullFields": "false"})
    return records.withColumn("alike", F.md5(F.when(known, text).otherwise(F.concat(F.lit("id "), F.col("id").cast("string")))))


def with_leads(records: DataFrame) -> DataFrame:
    """`records` with lead: the smallest id of the records alike in all but their names, whose pictures are the same evidence."""
    with Scratch() as made:
        rows = made.table(_with_alike(records))
        least = rows.groupBy("alike").agg(F.min("id").alias("lead"))
        return materialize(split_join(rows, least, "alike", rows=rows.count()).drop("alike"))


def _parts(text: Column, lengths: Column) -> Column:
    """The distinct parts of a text that have one of the lengths."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(text)), cut)))


def _digits(core: Column) -> Column:
    return F.regexp_extract(core, r"(\d{4,})\D*$", 1)


def _letters(core: Column) -> Column:
    return F.regexp_replace(core, r"\d", "")


def name_similarity(p: Column, f: Column) -> Column:
    """One if a name holds the other, less if it holds only the other's number; zero for another number after the same letters."""
    enough, held = (F.length(p) >= 4) & (F.length(f) >= 4), f.contains(p) | p.contains(f)
    return F.when(enough & held, 1.0).when((_digits(p) != "") & f.contains(_digits(p)), 0.9).when(_letters(p) == _letters(f), 0.0)


def best_names(asked: DataFrame, copies: DataFrame) -> DataFrame:
    """(lead, f_core, best): of the `copies(lead, id, core)` the one, as (id, core), whose name is most similar to each name
    of `asked(lead, f_core)`, the smallest id of equal ones.

    Names are looked up by their parts of the lengths that occur, so that copies and names don't multiply.
    """
    names = copies.groupBy("lead", "core").agg(F.min("id").alias("id"))
    copy = F.struct("id", "core")
    long_core, number = F.when(F.length("core") >= 4, F.col("core")), F.when(_digits(F.col("core")) != "", _digits(F.col("core")))
    sought = names.select("lead", copy.alias("copy"), F.explode(F.array(F.struct(long_core.alias("part"), F.lit(1.0).alias("score")), F.struct(number.alias("part"), F.lit(0.9).alias("score")))).alias("s"))
    sought = sought.where("s.part is not null").groupBy("lead", "s.part", "s.score").agg(F.min("copy").alias("copy"))
    lengths = lambda df, c: df.groupBy("lead").agg(F.collect_set(F.length(c)).alias("lengths"))
    inner = asked.join(lengths(sought, "part"), "lead").select("lead", "f_core", F.explode(_parts(F.col("f_core"), F.col("lengths"))).alias("part"))
    inner = inner.join(sought, ["lead", "part"]).select("lead", "f_core", "score", "copy")
    whole = asked.where(F.length("f_core") >= 4)
    outer = names.join(lengths(whole, "f_core"), "lead").select("lead", copy.alias("copy"), F.explode(_parts(F.col("core"), F.col("lengths"))).alias("f_core"))
    outer = outer.groupBy("lead", "f_core").agg(F.min("copy").alias("copy")).join(whole, ["lead", "f_core"]).select("lead", "f_core", F.lit(1.0).alias("score"), "copy")
    # without any of that, a name of other letters says more for a copy than one of the same letters with another number
    first = names.groupBy("lead").agg(F.min(copy).alias("first"))
    differs = ~F.coalesce(_letters(F.col("core")) == _letters(F.col("first.core")), F.lit(False))
    other = names.join(first, "lead").where(differs & (F.col("id") != F.col("first.id"))).groupBy("lead").agg(F.min(copy).alias("other"))
    same = F.coalesce(_letters(F.col("first.core")) == _letters(F.col("f_core")), F.lit(False))
    rest = asked.join(first.join(other, "lead", "left"), "lead").select("lead", "f_core", F.lit(0.0).alias("score"), F.when(same, F.coalesce("other", "first")).otherwise(F.col("first")).alias("copy"))
    found = inner.unionByName(outer).unionByName(rest)
    order = F.struct((-F.col("score")).alias("score"), "copy")
    return found.groupBy("lead", "f_core").agg(F.min(order).alias("m")).select("lead", "f_core", F.col("m.copy").alias("best"))


def _picture_keys(df: DataFrame) -> DataFrame:
    """(key, id, hashed): blocking keys of a record's digest, and of every two chunks of its hash, which near hashes share."""
    digest = F.when(F.col("digest").isNotNull(), F.xxhash64(F.lit("digest"), F.substring("digest", 1, 16)))
    near = F.when(F.col("h").isNotNull(), F.array(*[F.xxhash64(F.lit("hash"), k) for k in chunk_keys(F.col("h"), NEAR_BITS)]))
    of = lambda keys, hashed: df.select("id", F.explode(keys).alias("key"), F.lit(hashed).alias("hashed"))
    return of(F.array_compact(F.array(digest)), False).unionByName(of(near, True))


#: Blocking keys of a record at the most: pairs of chunks, digest, name, size and time.
_KEYS = 27


def shared_keys(photos: DataFrame, files: DataFrame) -> DataFrame:
    """(p_id, f_id): the pairs that share a blocking key, `photos` with their leads.

    Names, sizes and times are keys of every copy, digests and hashes of the leads. A shared pair of chunks alone is no
    reason to look closer, so hashes must be near; every other key stands for itself, whatever the hashes.
    """
    first = photos.where("id = lead")
    named = _named_keys(photos.drop("id").withColumnRenamed("lead", "id")).distinct().withColumn("hashed", F.lit(False))
    hashes = lambda df, i, h: df.select(F.col("id").alias(i), F.col("h").alias(h))
    with Scratch() as made:
        left = _picture_keys(first).unionByName(named).withColumnRenamed("id", "p_id").join(hashes(first, "p_id", "ph"), "p_id")
        right = _picture_keys(files).unionByName(_named_keys(files).withColumn("hashed", F.lit(False))).withColumnRenamed("id", "f_id").join(hashes(files, "f_id", "fh"), "f_id")
        right = right.select("key", "f_id", "fh")
        met = split_join(made.table(left), right, "key", rows=_KEYS * photos.count())
        return materialize(met.where(~F.col("hashed") | (hamming(F.col("ph"), F.col("fh")) <= NEAR_BITS)).select("p_id", "f_id").distinct())


def candidate_pairs(photo: DataFrame, files: DataFrame) -> DataFrame:
    """(photo_id, file_id, picture, features): pairs that share a blocking key, with the similarity of each attribute; UNKNOWN where a side lacks it."""
    with Scratch() as made:
        photos = made.keep(with_leads(photo))
        first = photos.where("id = lead").drop("lead")
        p, f = first.select(*[F.col(c).alias(f"p_{c}") for c in first.columns]), files.select(*[F.col(c).alias(f"f_{c}") for c in files.columns])
        shared = made.keep(shared_keys(photos, files))
        rows = shared.count()
        both = made.table(split_join(split_join(shared, p, "p_id", rows=rows), f, "f_id", rows=rows, counted=shared))
        # copies are searched as one record; each file then gets the copy whose name tells most
        several = photos.where("id <> lead").select("lead").distinct()
        asked = both.select(F.col("p_id").alias("lead"), "f_core").where("f_core is not null").distinct().join(several, "lead", "left_semi")
        best = best_names(asked, photos.join(several, "lead", "left_semi").select("lead", "id", "core")).withColumnRenamed("lead", "p_id")
        known = F.col("best").isNotNull()
        named = both.join(best, ["p_id", "f_core"], "left").withColumn("p_id", F.coalesce("best.id", "p_id")).withColumn("p_core", F.when(known, F.col("best.core")).otherwise(F.col("p_core")))
        return materialize(_features(named))


def _features(both: DataFrame) -> DataFrame:
    distance = hamming(F.col("p_h"), F.col("f_h"))
    length = F.least(F.length("p_digest"), F.length("f_digest"))
    # all digits both sides have
    digest = F.when(F.substring(F.col("p_digest"), F.lit(1), length) == F.substring(F.col("f_digest"), F.lit(1), length), 1.0).when(length.isNotNull(), 0.35)
    log_size = F.log(F.col("f_size") / F.col("p_size"))
    area = F.log((F.col("f_w").cast("double") * F.col("f_ht")) / (F.col("p_w").cast("double") * F.col("p_ht")))
    # a picture that was only scaled keeps its bytes per pixel; one that was only renamed its size
    gap = F.least(F.abs(log_size), F.abs(log_size - area))
    long_side = lambda s: F.greatest(f"{s}_w", f"{s}_ht") / F.least(f"{s}_w", f"{s}_ht")
    # recorded dimensions are often stale, so a different shape says little
    shape = F.greatest(F.lit(0.7), 1 - 5 * F.abs(long_side("p") - long_side("f")))
    # ... but of a picture that was cropped they say nothing
    density = F.when(gap.isNotNull() & ((gap < 0.005) | F.coalesce(shape > 0.9, F.lit(True))), F.greatest(F.lit(0.0), 1 - 40 * gap))
    name = name_similarity(F.col("p_core"), F.col("f_core"))
    lag = lambda t: F.abs(F.col("f_t1") - F.col(t))
    zone = lambda t: (lag(t) % _QUARTER == 0) & (lag(t) <= 14 * 3600)
    taken = F.when((lag("p_t1") == 0) | (lag("p_t2") == 0), 1.0).when(zone("p_t1") | zone("p_t2"), 0.9)
    taken = taken.when(F.least(lag("p_t1"), lag("p_t2")).isNotNull(), 0.0)
    vector = {"taken": taken, "density": density, "name": name, "hash": 1 - F.greatest(F.lit(0), distance - 1) / 8, "digest": digest, "shape": shape}
    # photos of one hash are one picture; without a hash each is its own
    picture = F.xxhash64(F.col("p_h").isNull(), F.coalesce("p_h", "p_id"))
    return both.select(F.col("p_id").alias("photo_id"), F.col("f_id").alias("file_id"), picture.alias("picture"), *[F.coalesce(vector[n], F.lit(UNKNOWN)).cast("double").alias(n) for n in FEATURES])


def _log_density(mean: np.ndarray, covariance: np.ndarray) -> Column:
    inverse, (_, log_det) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
    total = F.lit(float(-0.5 * log_det))
    for i, a in enumerate(FEATURES):
        for j, b in enumerate(FEATURES[: i + 1]):
            weight = float(inverse[i, j]) * (1.0 if i == j else 2.0)
            total = total - 0.5 * weight * (F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j]))
    return total


def _moments(df: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Weight, mean and covariance of the matched and of the unmatched vectors: a few sums, whatever the number of candidates."""
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]
    sums = []
    for side, weight in (("m", F.col("posterior")), ("u", 1 - F.col("posterior"))):
        sums += [F.sum(weight).alias(side)] + [F.sum(weight * F.col(a)).alias(f"{side}_{a}") for a in FEATURES]
        sums += [F.sum(weight * F.col(a) * F.col(b)).alias(f"{side}_{a}_{b}") for a, b in pairs]
    row = df.agg(*sums).first()
    out = []
    for side in "mu":
        n, d = row[side] or 0.0, len(FEATURES)
        mean, covariance = np.full(d, UNKNOWN), np.eye(d)
        if n > 1e-6:
            mean = np.array([row[f"{side}_{a}"] for a in FEATURES]) / n
            for a, b in pairs:
                i, j = FEATURES.index(a), FEATURES.index(b)
                covariance[i, j] = covariance[j, i] = row[f"{side}_{a}_{b}"] / n - mean[i] * mean[j]
        out.append((n, mean, covariance))
    return out


def fit_and_score(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """`pairs(file_id, picture, ...)` with their posterior: the probability that both records are of one picture.

    Rounds end when no parameter of the mixture moves by more than `tolerance`, after MOST_ROUNDS at the latest.
    """
    start = F.when((F.col("taken") + F.col("density") + F.col("name") + F.col("digest")) / 4 > 0.6, 0.9).otherwise(0.1)
    scored, before = pairs.withColumn("posterior", start), None
    for _ in range(MOST_ROUNDS):
        (n, mean, covariance), (m, mean0, covariance0) = _moments(scored)
        if n + m < 1e-6:
            return scored
        now = np.concatenate([mean, mean0, [n / (n + m)]])
        if before is not None and np.abs(now - before).max() < tolerance:
            break
        before = now
        ridge = RIDGE * np.eye(len(FEATURES))
        prior = float(np.clip(n / (n + m), 0.02, 0.98))
        odds = _log_density(mean, covariance + ridge) - _log_density(mean0, covariance0 + ridge) + float(np.log(prior / (1 - prior)))
        odds = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds)))
        scored = transitive(pairs.withColumn("odds", odds)).drop("odds")
    return scored


def transitive(pairs: DataFrame) -> DataFrame:
    """`pairs(file_id, picture, odds, ...)` with the posterior of each: a file has at most one picture, of which all photos match it.

    So each picture rivals with the odds of its best photo, shared by its photos, and a photo's posterior is its own odds against all.
    """
    one = Window.partitionBy("file_id", "picture")
    share = pairs.withColumn("__share", F.max("odds").over(one) / F.count("*").over(one))
    return share.withColumn("posterior", F.col("odds") / (1 + F.sum("__share").over(Window.partitionBy("file_id")))).drop("__share")


def link(photo: DataFrame, files: DataFrame) -> DataFrame:
    """(photo_id, file_id, posterior): the picture of each file that has one, with the confidence of the match.

    A photo may have several files, a file has at most one photo: the most probable, if it is more probable than not,
    and of equal ones that with the smallest id. Missing attributes are neutral; rows without an id are left out;
    repeated rows count once; records alike in all evidence are represented by the smallest id; empty tables give none.
    """
    with Scratch() as made:
        evidence, other = made.keep(photo_evidence(photo)), made.keep(file_evidence(files))
        # each round reads the pairs in the order of its windows; what is lost of them comes again from the written table
        pairs = made.keep(candidate_pairs(evidence, other)).repartition("file_id").sortWithinPartitions("file_id", "picture").persist()
        scored = fit_and_score(pairs)
        best = scored.where("posterior >= 0.5").groupBy("file_id").agg(F.max(F.struct("posterior", (-F.col("photo_id")).alias("p"))).alias("b"))
        found = materialize(best.select((-F.col("b.p")).alias("photo_id"), "file_id", F.col("b.posterior").alias("posterior")))
        pairs.unpersist()
        return found
