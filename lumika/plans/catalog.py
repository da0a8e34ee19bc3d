"""Listing, search, colour, scores and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumika.functions.vectors import nearest, one_vector
from lumika.operators import aesthetic, color, listing, people, search, tagging
from lumika.tables import PHOTO_DIM, table

ASKED = 60  # the photo that searches start from
LAYMEN = [f"a {n}" for n in ("dog", "cat", "beach", "mountain", "car", "train", "bridge", "flower")]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photo table as it is, for operators that take each photo once after their filter."""
    return table(spark, sf_dir, "photo")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each photo once; only the columns that are asked for are shuffled."""
    return table(spark, sf_dir, "photo").where("id is not null").dropDuplicates(["id"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "photo_embedding").select("photo_id", "embedding")


def concepts() -> np.ndarray:
    """Unit vectors that stand for encoded prompts: the same simple rule here and in SQL."""
    i, j = np.arange(len(LAYMEN))[:, None], np.arange(PHOTO_DIM)[None, :]
    x = ((j * 31 + i * 17) % 7 - 3) + np.where(j % (i + 2) == 0, 9.0, 0.0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _list(sort: str, **wanted):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listing.photo_list(rows(spark, sf_dir), sort, 500, where=listing.predicate(**wanted) if wanted else None)

    query.__doc__ = f"A page of photos, {sort} first."
    return query


def photo_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.photo_list(rows(spark, sf_dir), "newest", 50, 100)


def photo_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.total(rows(spark, sf_dir), listing.predicate(year=2019))


def photo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.lookup(rows(spark, sf_dir), ASKED)


def knn_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similar(rows(spark, sf_dir), vectors(spark, sf_dir), ASKED, 50).select("photo_id", "path", F.round("distance", 5).alias("distance"), F.round("score", 5).alias("score"))


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similar(rows(spark, sf_dir), vectors(spark, sf_dir), ASKED, 50, "cosine").select("photo_id", F.round("distance", 5).alias("distance"))


def knn_before_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top list alone: it is taken before photos are joined, so vectors whose photo is gone are in it."""
    query = one_vector(vectors(spark, sf_dir), "photo_id", ASKED, PHOTO_DIM)
    query = concepts()[0] if query is None else query
    return nearest(vectors(spark, sf_dir), "photo_id", query, 100).select("photo_id", F.round("distance", 5).alias("distance"))


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text search whose encoder is the rule of `concepts`."""
    found = search.by_text(rows(spark, sf_dir), vectors(spark, sf_dir), "a dog", lambda _: concepts()[0], 50)
    return found.select("photo_id", "path", F.round("distance", 5).alias("distance"))


def color_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color.color_search(rows(spark, sf_dir), color.rgb("#4060a0"), 60, 500).select("id", "path", F.round("score", 6).alias("score"))


def color_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return color.needs_palette(rows(spark, sf_dir))


def aesthetic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all photos that have none."""
    good, bad = aesthetic.prompt_centroid(concepts()[:3]), aesthetic.prompt_centroid(concepts()[3:6])
    found = aesthetic.scores(aesthetic.unscored(photos(spark, sf_dir), vectors(spark, sf_dir)), good, bad)
    return found.select("photo_id", F.round("aesthetic", 4).alias("aesthetic"))


def rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).select("id", aesthetic.rating(F.col("aesthetic")).alias("rating"))


def auto_tag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagging.zero_shot(vectors(spark, sf_dir), concepts(), LAYMEN, 5, 0.02)
    return found.select("photo_id", "label", F.round("score", 5).alias("score"))


def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.top_labels(table(spark, sf_dir, "photo_tag_auto").distinct(), 30)


def photos_for_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.photos_for_label(table(spark, sf_dir, "photo_tag_auto").distinct(), photos(spark, sf_dir), "beach", 200)


def untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.untagged(photos(spark, sf_dir), table(spark, sf_dir, "photo_tag_auto")).select("id", "path")


def replace_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags after labels were brought to one form: the newer form's score replaces the older's."""
    tags = table(spark, sf_dir, "photo_tag_auto").where("photo_id is not null and label is not null")
    clean = F.lower(F.trim("label"))
    return tagging.latest_tags(tags.where(F.col("label") == clean), tags.where(F.col("label") != clean).withColumn("label", clean))


def face_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each face cluster, by its length and by three of its products with a fixed pattern."""
    own = table(spark, sf_dir, "face_embedding").where(F.size("embedding") == 512)
    means = people.stored_centroids(table(spark, sf_dir, "face_detection"), own)
    slant = lambda m: F.aggregate(F.transform("centroid", lambda v, i: v * (i % m - 2)), F.lit(0.0), lambda a, v: a + v)
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, v: a + v * v))
    # the vectors are short binary fractions, so halves at the last digit are pushed to one side
    return means.select("cluster_id", F.round(length, 5).alias("length"), *[F.round(slant(m) + 1e-7, 4).alias(f"slant{m}") for m in (5, 7, 11)])


def needs_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next photos whose faces were not looked for yet."""
    return listing.next_batch(rows(spark, sf_dir), "face_count", 200)


def search_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos like a picture outside the catalog, by a model that is the rule of `concepts`."""
    found = search.by_image(rows(spark, sf_dir), vectors(spark, sf_dir), b"a picture", lambda: lambda items: concepts()[1 : 1 + len(items)], 50)
    return found.select("photo_id", "path", F.round("distance", 4).alias("distance"))


QUERIES = {
    "photo_list_newest": _list("newest"), "photo_list_oldest": _list("oldest"), "photo_list_best": _list("best"), "photo_list_worst": _list("worst"),
    "photo_filter_year": _list("newest", year=2019), "photo_filter_camera": _list("newest", camera="Lumora X3"), "photo_filter_dates": _list("oldest", date_from="2018-01-01", date_to="2018-12-31"),
    "photo_page": photo_page, "photo_total": photo_total, "photo_lookup": photo_lookup,
    "best_photos": lambda s, d: listing.best_photos(rows(s, d), 200), "facet_years": lambda s, d: listing.years(rows(s, d)), "facet_cameras": lambda s, d: listing.cameras(rows(s, d)),
    "backfill_status": lambda s, d: listing.embedding_status(rows(s, d), vectors(s, d)), "hash_state": lambda s, d: listing.hash_state(rows(s, d)),
    "knn_similar": knn_similar, "knn_cosine": knn_cosine, "knn_before_join": knn_before_join, "search_text": search_text,
    "color_search": color_search, "color_missing": color_missing, "aesthetic_score": aesthetic_score, "sidecar_rating": rating,
    "auto_tag_topk": auto_tag_topk, "top_labels": top_labels, "photos_for_label": photos_for_label, "untagged": untagged, "replace_tags": replace_tags, "face_centroids": face_centroids,
    "needs_faces": needs_faces, "search_image": search_image,
}

_P = "p as (select distinct * from photo where id is not null)"
_SHOWN = "id, path, captured_at, width, height, thumb_small, thumb_large, aesthetic"
_AT = "coalesce(captured_at, indexed_at)"
_ORDER = {"newest": f"{_AT} desc nulls last, id", "oldest": f"{_AT} asc nulls first, id", "best": f"aesthetic desc nulls last, {_AT} desc nulls last, id", "worst": f"aesthetic asc nulls last, {_AT} desc nulls last, id"}
_USABLE = "embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_V = f"v as (select photo_id, any_value(embedding::double[]) as e from photo_embedding where photo_id is not null and {_USABLE.format(dim=768)} group by photo_id)"
_C = f"""c0 as (select i, list_transform(range({PHOTO_DIM}), lambda j: ((j * 31 + i * 17) % 7 - 3 + case when j % (i + 2) = 0 then 9.0 else 0.0 end)::double) as x from range({len(LAYMEN)}) t(i)),
        c as (select i, list_transform(x, lambda a: a / sqrt(list_inner_product(x, x))) as e from c0)"""
_MEAN = "(select list(m order by j) as e from (select j, avg(c.e[j]) as m from c, range(1, 769) t(j) where c.i between {low} and {high} group by j))"


def _listed(sort: str, where: str = "true", page: str = "limit 500") -> str:
    return f"with {_P} select {_SHOWN} from p where {where} order by {_ORDER[sort]} {page}"


SQL = {
    "photo_list_newest": _listed("newest"), "photo_list_oldest": _listed("oldest"), "photo_list_best": _listed("best"), "photo_list_worst": _listed("worst"),
    "photo_filter_year": _listed("newest", f"substr({_AT}, 1, 4) = '2019'"), "photo_filter_camera": _listed("newest", """exif_json ilike '%"Image Model": "Lumora X3"%'"""),
    "photo_filter_dates": _listed("oldest", f"{_AT} >= '2018-01-01' and {_AT} <= '2018-12-31'"), "photo_page": _listed("newest", page="limit 50 offset 100"),
    "photo_total": f"with {_P} select count(*) as total from p where substr({_AT}, 1, 4) = '2019'", "photo_lookup": f"with {_P} select * from p where id = {ASKED}",
    "best_photos": f"with {_P} select {_SHOWN} from p where aesthetic is not null order by aesthetic desc, id limit 200",
    "facet_years": f"with {_P} select substr({_AT}, 1, 4) as year, count(*) as n from p group by 1 having substr({_AT}, 1, 4) <> '' order by 1 desc",
    "facet_cameras": f"""with {_P}, q as (select case when json_valid(exif_json) then json_extract_string(exif_json, '$."Image Model"') end as camera from p)
        select camera, count(*) as n from q where camera is not null group by 1 order by n desc, camera limit 30""",
    "backfill_status": f"""with {_P}, a as (select count(*) as t from p), b as (select count(distinct photo_id) as e from photo_embedding)
        select t as total_photos, e as with_embedding, t - e as missing, round(100.0 * e / greatest(t, 1), 1) as percent_done from a, b""",
    "hash_state": f"with {_P} select count(*) as hashed, coalesce(max(id), 0) as last_id from p where phash is not null",
    "knn_similar": f"""with {_P}, {_V}, n as (select v.photo_id, list_distance(v.e, q.e) as d from v, (select e from v where photo_id = {ASKED}) q where v.photo_id <> {ASKED} order by d, v.photo_id limit 50)
        select n.photo_id, p.path, round(d, 5) as distance, round(greatest(0, 1 - 0.5 * d), 5) as score from n join p on p.id = n.photo_id""",
    "knn_cosine": f"""with {_P}, {_V}, n as (select v.photo_id, 1 - list_cosine_similarity(v.e, q.e) as d from v, (select e from v where photo_id = {ASKED}) q where v.photo_id <> {ASKED} order by d, v.photo_id limit 50)
        select n.photo_id, round(d, 5) as distance from n join p on p.id = n.photo_id""",
    "knn_before_join": f"with {_V}, q as (select e from v where photo_id = {ASKED}) select v.photo_id, round(list_distance(v.e, q.e), 5) as distance from v, q order by list_distance(v.e, q.e), v.photo_id limit 100",
    "search_text": f"""with {_P}, {_V}, {_C}, n as (select v.photo_id, list_distance(v.e, c.e) as d from v, c where c.i = 0 order by d, v.photo_id limit 50)
        select n.photo_id, p.path, round(d, 5) as distance from n join p on p.id = n.photo_id""",
    "color_search": f"""with {_P}, j as (select id, path, unnest(from_json(dominant_colors, '[{{"r":"INTEGER","g":"INTEGER","b":"INTEGER","weight":"DOUBLE"}}]')) as c from p where dominant_colors is not null and json_valid(dominant_colors)),
        d as (select id, path, c.weight as w, (c.r - 64) ** 2 + (c.g - 96) ** 2 + (c.b - 160) ** 2 as s from j)
        select id, path, round(sum(w / (1 + sqrt(s))), 6) as score from d where s <= 3600 group by id, path having sum(w / (1 + sqrt(s))) > 0 order by sum(w / (1 + sqrt(s))) desc, id limit 500""",
    "color_missing": f"with {_P} select id, path from p where dominant_colors is null",
    "aesthetic_score": f"""with {_P}, {_V}, {_C}, a as {_MEAN.format(low=0, high=2)}, b as {_MEAN.format(low=3, high=5)},
        g as (select list_transform(list_zip(a.e, b.e), lambda z: z[1] / (sqrt(list_inner_product(a.e, a.e)) + 1e-12) - z[2] / (sqrt(list_inner_product(b.e, b.e)) + 1e-12)) as e from a, b)
        select v.photo_id, round(greatest(1, least(10, 5.5 + 30 * list_inner_product(v.e, g.e))), 4) as aesthetic from v, g where v.photo_id in (select id from p where aesthetic is null)""",
    "sidecar_rating": f"with {_P} select id, case when aesthetic is not null then least(5, greatest(0, round_even(aesthetic / 2, 0))) end::int as rating from p",
    "auto_tag_topk": f"""with {_V}, {_C}, s as (select v.photo_id, [{', '.join(repr(x[2:]) for x in LAYMEN)}][c.i + 1] as label, list_inner_product(v.e, c.e) as s from v, c),
        r as (select *, row_number() over (partition by photo_id order by s desc, label) as rn from s where s >= 0.02) select photo_id, label, round(s, 5) as score from r where rn <= 5""",
    "top_labels": "with t as (select distinct * from photo_tag_auto) select label, count(*) as n from t group by 1 order by n desc, label limit 30",
    "photos_for_label": f"""with {_P}, t as (select distinct * from photo_tag_auto) select t.photo_id, p.path, p.captured_at, t.score from t join p on p.id = t.photo_id where label = 'beach' order by score desc, photo_id limit 200""",
    "untagged": f"with {_P} select id, path from p where not exists (select 1 from photo_tag_auto t where t.photo_id = p.id)",
    "replace_tags": """with t as (select photo_id, lower(trim(label)) as label, score, (label <> lower(trim(label)))::int as side from photo_tag_auto where photo_id is not null and label is not null)
        select photo_id, label, max(struct_pack(s := side, x := score)).x as score from t group by 1, 2""",
    "face_centroids": f"""with f as (select distinct id, cluster_id from face_detection where cluster_id is not null),
        v as (select face_id, any_value(embedding::double[]) as e from face_embedding where embedding is not null and len(embedding) = 512 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by face_id),
        m as (select cluster_id, j, avg(e[j]) as m from v join f on f.id = v.face_id, range(1, 513) t(j) group by 1, 2)
        select cluster_id, round(sqrt(sum(m * m)), 5) as length, round(sum(m * ((j - 1) % 5 - 2)) + 1e-7, 4) as slant5, round(sum(m * ((j - 1) % 7 - 2)) + 1e-7, 4) as slant7, round(sum(m * ((j - 1) % 11 - 2)) + 1e-7, 4) as slant11 from m group by 1""",
    "needs_faces": f"with {_P} select id, path from p where face_count is null order by id limit 200",
    "search_image": f"""with {_P}, {_V}, {_C}, n as (select v.photo_id, list_distance(v.e, c.e) as d from v, c where c.i = 1 order by d, v.photo_id limit 50)
        select n.photo_id, p.path, round(d, 4) as distance from n join p on p.id = n.photo_id""",
}
