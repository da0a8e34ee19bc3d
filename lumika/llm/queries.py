"""The queries p1 to p10 (without p7, which is general) and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumika.operators.instants import capture_instants
from lumika.operators.joins import split_join
from lumika.plans.timeline import SQL as INSTANTS
from lumika.session import Scratch, materialize
from lumika.tables import FACE_DIM, PHOTO_DIM, distinct_by, photo_hashes, table, usable_phash


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos linked by recorded matches that their hashes bear out, each with its group's smallest id."""
    from lumika.llm.matches import match_groups

    matches = table(spark, sf_dir, "photo_match").select(F.col("photo_id_a").alias("a"), F.col("photo_id_b").alias("b"))
    return match_groups(matches, photo_hashes(spark, sf_dir)).select(F.col("id").alias("photo_id"), "group_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos and imported files that record the same picture."""
    from lumika.llm.linkage import link

    return link(table(spark, sf_dir, "photo"), table(spark, sf_dir, "import_files")).select("photo_id", "file_id")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence."""
    from lumika.llm.linkage import link

    found = link(table(spark, sf_dir, "photo"), table(spark, sf_dir, "import_files"))
    return found.select("photo_id", "file_id", F.round("posterior", 4).alias("posterior"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos alike in all but their names: each with the smallest id of them."""
    from lumika.llm.linkage import picture_classes

    return picture_classes(table(spark, sf_dir, "photo")).withColumnRenamed("id", "photo_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar photos and of similar faces, one among the five most similar of the other."""
    from lumika.llm.neighbours import neighbour_pairs

    photos = neighbour_pairs(table(spark, sf_dir, "photo_embedding"), "photo_id", table(spark, sf_dir, "photo").select("id"), PHOTO_DIM)
    faces = neighbour_pairs(table(spark, sf_dir, "face_embedding"), "face_id", table(spark, sf_dir, "face_detection").select("id"), FACE_DIM)
    both = photos.select(F.lit("photo").alias("kind"), "a", "b").unionByName(faces.select(F.lit("face").alias("kind"), "a", "b"))
    return both.select("kind", F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of photos whose usable hashes differ in at most five bits."""
    from lumika.llm.near_hashes import near_records

    return near_records(photo_hashes(spark, sf_dir)).select(F.col("a").alias("photo_id_a"), F.col("b").alias("photo_id_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with a usable hash by class of equal hashes, with the number of classes within five bits."""
    from lumika.llm.near_hashes import near_classes

    return near_classes(photo_hashes(spark, sf_dir)).withColumnRenamed("id", "photo_id")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of faces as clusters, loose ones split, each with its size, most typical faces, and the recorded cluster most of it bears."""
    from lumika.llm.face_groups import face_clusters

    known = table(spark, sf_dir, "face_detection").select("id", F.col("cluster_id").alias("recorded_id"))
    return face_clusters(table(spark, sf_dir, "face_embedding"), "face_id", known, FACE_DIM, recorded=known)


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with a usable hash, once each, with what their survivor's fields may be taken from."""
    photo = table(spark, sf_dir, "photo")
    root = F.concat(F.lit("scan:"), F.regexp_extract("path", r"^/[^/]+/[^/]+", 0))
    columns = [
        F.col("id"), usable_phash().alias("h"), F.coalesce("imported_from", root).alias("source"),
        F.when(F.col("size_bytes") > 0, F.col("size_bytes")).alias("size_bytes"), F.when(F.col("width") > 0, F.col("width")).alias("width"),
        F.when(F.col("aesthetic").between(1, 10), F.col("aesthetic")).alias("aesthetic"), F.try_to_timestamp("indexed_at").alias("indexed"), "caption",
    ]
    rows = photo.select(*columns).where("id is not null and h is not null").dropDuplicates(["id"])
    with Scratch() as made:
        taken = made.keep(capture_instants(photo)).select(F.col("photo_id").alias("id"), F.col("micros").alias("captured_at"))
        return materialize(rows.join(taken, "id", "left"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces in groups of at least two, each with its group's smallest id."""
    from lumika.llm.face_groups import face_groups

    known = table(spark, sf_dir, "face_detection").select("id")
    return face_groups(table(spark, sf_dir, "face_embedding"), "face_id", known, FACE_DIM).select(F.col("id").alias("face_id"), "group_id")


def _rules() -> dict:
    # a copy without indexing time still offers its score, after those that have one
    indexed = F.coalesce(F.unix_micros("indexed"), F.lit(-(2**62)))
    return {
        "size_bytes": (F.col("size_bytes"), F.col("size_bytes")),
        "width": (F.col("width"), F.col("width")),
        "aesthetic": (F.col("aesthetic"), indexed),
        "captured_at": (F.col("captured_at"), -F.col("captured_at")),
    }


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group of copies and each field, the copy that supplies the value."""
    from lumika.llm.survivors import survivors

    with Scratch() as made:
        return materialize(survivors(made.keep(_copies(spark, sf_dir)), _rules()).select("group_id", "field_name", "photo_id"))


def _claims(made: Scratch, copies: DataFrame) -> DataFrame:
    """What each copy's source states of its group's fields."""
    groups = copies.groupBy("h").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n >= 2").select("h", "group_id")
    fields = [F.struct(F.lit(n).alias("field_name"), F.col(n).cast("string").alias("value")) for n in ("size_bytes", "width", "aesthetic", "captured_at", "caption")]
    rows = split_join(copies, groups, "h", rows=copies.count())
    return made.table(rows.select("group_id", "source", F.explode(F.array(*fields)).alias("f")).select("group_id", "source", "f.*"))


def p2_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of each group's fields that the source quality model judges true, with its posterior; captions may keep several."""
    from lumika.llm.survivors import true_values

    with Scratch() as made:
        claims = _claims(made, made.keep(_copies(spark, sf_dir)))
        return true_values(claims, claims.select("group_id", "source"), multi=("caption",))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of each group's fields with its value and the model's posterior that this value is true."""
    from lumika.llm.survivors import claim_truth, survivors

    with Scratch() as made:
        copies = made.keep(_copies(spark, sf_dir))
        claims = _claims(made, copies)
        truth = made.keep(claim_truth(claims, claims.select("group_id", "source"), ("caption",)))
        return materialize(survivors(copies, _rules()).join(truth, ["group_id", "field_name", "value"], "left").select("group_id", "field_name", "photo_id", "value", "posterior"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once with the ids of its text."""
    from lumika.llm.bpe import encode

    return encode(distinct_by(table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text"), "doc_id"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least twelve successive words of a test item."""
    from lumika.llm.leaks import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), 12).where("longest_tile >= 12").select("doc_id", "item_id")


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a test item's words in tiles of at least six, in whatever order."""
    from lumika.llm.leaks import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), 6)
    return found.where(F.col("shared_words") * 2 >= F.col("item_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of each prose document."""
    from lumika.llm.reading import reading_levels

    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_truth": p2_truth, "p2_survivors": p2_survivors, "p3_found": p3_found, "p4_found": p4_found, "p4_links": p4_links, "p4_classes": p4_classes, "p5_found": p5_found, "p6_found": p6_found, "p6_classes": p6_classes, "p8_ids": p8_ids, "p9_found": p9_found, "p9_coverage": p9_coverage, "p10_found": p10_found}
_HASHES = "h as (select distinct id, ('0x' || trim(phash, ' ' || chr(9) || chr(10) || chr(13)))::ubigint as h from photo where regexp_full_match(trim(phash, ' ' || chr(9) || chr(10) || chr(13)), '[0-9a-fA-F]{16}') and not regexp_full_match(trim(phash, ' ' || chr(9) || chr(10) || chr(13)), '0{16}'))"
_USABLE = "embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_FACES = f"v as (select face_id as id, any_value(embedding::double[]) as e from face_embedding where face_id in (select id from face_detection) and {_USABLE.format(dim=FACE_DIM)} group by 1)"
_PHOTOS = f"v as (select photo_id as id, any_value(embedding::double[]) as e from photo_embedding where photo_id in (select id from photo) and {_USABLE.format(dim=PHOTO_DIM)} group by 1)"


def _nearest(kind: str, vectors: str) -> str:
    return f"""select '{kind}' as kind, id_a, id_b from (with {vectors}, s as (select a.id as i, b.id as j, round(list_cosine_similarity(a.e, b.e), 9) as s from v a join v b on a.id <> b.id),
        r as (select i, j, row_number() over (partition by i order by s desc, j) as rn from s where s >= 0.6) select distinct least(i, j) as id_a, greatest(i, j) as id_b from r where rn <= 5)"""


def _best(field: str, condition: str, order: str) -> str:
    return f"select '{field}' as field_name, h, id, row_number() over (partition by h order by {order}, id) as rn from c where {condition}"


SQL = {
    "p2_found": f"""
        with {_HASHES}, g as (select h, min(id) as group_id from h group by h having count(*) > 1), t as ({INSTANTS["p7_found"]}),
        c as (select distinct h.id, h.h, size_bytes, width, aesthetic, try_cast(indexed_at as timestamptz) as indexed, t.captured_utc from h join photo p on p.id = h.id left join t on t.photo_id = h.id),
        b as ({_best("size_bytes", "size_bytes > 0", "size_bytes desc")} union all {_best("width", "width > 0", "width desc")}
            union all {_best("aesthetic", "aesthetic between 1 and 10", "indexed desc nulls last")} union all {_best("captured_at", "captured_utc is not null", "captured_utc")})
        select g.group_id, b.field_name, b.id as photo_id from b join g on g.h = b.h where rn = 1""",
    "p3_found": f"""
        with recursive {_HASHES},
        e as (select distinct a.id as x, b.id as y from photo_match m join h a on a.id = m.photo_id_a join h b on b.id = m.photo_id_b
              where a.id <> b.id and bit_count(xor(a.h, b.h)) <= 5),
        g as (select x, y from e union select y, x from e),
        r as (select x as photo_id, x as reached from g union select r.photo_id, g.y from r join g on g.x = r.reached)
        select photo_id, min(reached) as group_id from r group by photo_id""",
    "p6_found": f"""
        with {_HASHES}
        select a.id as photo_id_a, b.id as photo_id_b from h a join h b on a.id < b.id where bit_count(xor(a.h, b.h)) <= 5""",
    "p6_classes": f"""
        with {_HASHES}, c as (select h, min(id) as class_id, count(*) as copies from h group by h),
        l as (select a.h, count(*) as links from c a join c b on a.h <> b.h and bit_count(xor(a.h, b.h)) <= 5 group by a.h)
        select h.id as photo_id, c.class_id, c.copies, coalesce(l.links, 0) as links from h join c on c.h = h.h left join l on l.h = h.h""",
    "p9_found": """
        with d as (select distinct doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
        i as (select distinct item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_item where text is not null),
        g as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as gram from i, range(1, 5000) t(k) where k + 11 <= len(w)),
        h as (select doc_id, array_to_string(w[k:k + 11], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12))
        select distinct h.doc_id, g.item_id from h join g on g.gram = h.gram""",
}
#: Brute force of the approximate searches, for tests that measure recall.
BRUTE = {
    "p1_found": f"""
        with recursive {_FACES}, g as (select a.id as x, b.id as y from v a join v b on a.id <> b.id and list_cosine_similarity(a.e, b.e) >= 0.6),
        r as (select x as id, x as reached from g union select r.id, g.y from r join g on g.x = r.reached)
        select id as face_id, min(reached) as group_id from r group by id""",
    "p5_found": f"{_nearest('photo', _PHOTOS)} union all {_nearest('face', _FACES)}",
}
