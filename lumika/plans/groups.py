"""Duplicates, people and saved searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumika.operators import collections, dupes, people
from lumika.plans.catalog import _P, _SHOWN, ASKED, SQL as CATALOG_SQL, concepts, photos, vectors
from lumika.tables import FACE_DIM, table, usable_phash

NOW = "2026-01-01T00:00:00Z"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "face_detection").where("id is not null").dropDuplicates(["id"])


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "person").dropDuplicates(["id"])


def dupe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many photos each cluster of five bits holds, by its smallest id."""
    return dupes.memberships(photos(spark, sf_dir), 5).select("id", "cluster_id")


def dupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos whose hash has another within five bits, with the number of photos that share theirs."""
    rows = photos(spark, sf_dir).select("id", usable_phash().alias("h")).where("h is not null")
    links = dupes.hash_links(rows, 5)
    ends = links.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    return rows.join(ends, "h").groupBy("h").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).select("first_id", "n")


def dupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different hashes within five bits, each hash by its smallest photo, with their distance."""
    return dupes.hash_pairs(photos(spark, sf_dir), 5)


def dupe_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupes.clusters(photos(spark, sf_dir), 5).select("cluster_id", "size", "cluster_key")


def dupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dupes.clusters(photos(spark, sf_dir), 0).select("cluster_id", "size", "cluster_key")


def dupe_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal hashes without those that were ignored, which here are all of two."""
    found = dupes.clusters(photos(spark, sf_dir), 0)
    ignored = found.where("size = 2").select("cluster_key", F.lit(NOW).alias("created_at"))
    return dupes.clusters(photos(spark, sf_dir), 0, ignored, limit=50).select("cluster_id", "size")


def _busiest(spark: SparkSession, sf_dir: str) -> list[int]:
    rows = faces(spark, sf_dir).where("cluster_id is not null").groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").limit(2).collect()
    return [r[0] for r in rows] + [0] * (2 - len(rows))


def cluster_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.cluster_photos(faces(spark, sf_dir), photos(spark, sf_dir), _busiest(spark, sf_dir)[0])


def name_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces after the largest cluster got a name."""
    after, _, _ = people.name_cluster(faces(spark, sf_dir), person(spark, sf_dir), _busiest(spark, sf_dir)[0], " New Name ", NOW)
    return after.select("id", "cluster_id", "person_id")


def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces after the second largest cluster was merged into the largest."""
    target, source = _busiest(spark, sf_dir)
    return people.merge_clusters(faces(spark, sf_dir), source, target, NOW)[0].select("id", "cluster_id", "person_id")


def rename_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.rename_person(person(spark, sf_dir), 8, "Renamed", NOW)[0].select("id", "name")


def unname_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.unname_person(faces(spark, sf_dir), person(spark, sf_dir), 8, NOW)[0].select("id", "person_id")


def online_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential clustering of the faces of each photo's scan root, which are fixed in number."""
    where = faces(spark, sf_dir).join(photos(spark, sf_dir).select(F.col("id").alias("photo_id"), F.regexp_extract("path", r"^/[^/]+/[^/]+", 0).alias("root")), "photo_id")
    rows = table(spark, sf_dir, "face_embedding").join(where.select(F.col("id").alias("face_id"), "root"), "face_id")
    return people.online_clusters(rows, "root", dim=FACE_DIM)


def index_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the faces that have none, from the recorded clusters' means on."""
    return people.index_faces(faces(spark, sf_dir), table(spark, sf_dir, "face_embedding"), FACE_DIM)


def _collection(query: dict, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = collections.Catalog(photos(spark, sf_dir), vectors(spark, sf_dir), faces(spark, sf_dir), lambda _: concepts()[0])
        found = collections.resolve(catalog, query, 50)
        rounded = {"score": 6, "distance": 5}
        return found.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in columns]) if columns else found

    run.__doc__ = f"A saved search of kind {query.get('kind', 'filter')}."
    return run


def collection_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = collections.Catalog(photos(spark, sf_dir), vectors(spark, sf_dir), faces(spark, sf_dir))
    return collections.resolve(catalog, {"kind": "cluster", "cluster_id": _busiest(spark, sf_dir)[0]}, 200)


QUERIES = {
    "dupe_memberships": dupe_links, "dupe_edges_banded": dupe_edges, "dupe_pairs_banded": dupe_pairs, "dupe_clusters": dupe_clusters, "dupe_exact": dupe_exact, "dupe_ignore_filter": dupe_ignore_filter,
    "people": lambda s, d: people.people(faces(s, d), person(s, d), 2, 100), "cluster_photos": cluster_photos,
    "persons": lambda s, d: people.persons(person(s, d), faces(s, d)), "face_crop_box": lambda s, d: people.crop_boxes(faces(s, d), photos(s, d)),
    "name_cluster": name_cluster, "merge_clusters": merge_clusters, "rename_person": rename_person, "unname_person": unname_person, "online_clusters": online_clusters, "index_faces": index_faces,
    "collection_filter": _collection({"kind": "filter", "filters": {"year": 2019, "camera": "Lumora X3"}, "sort": "best"}),
    "collection_color": _collection({"kind": "color", "hex": "#4060a0", "tolerance": 60}, "id", "path", "score"),
    "collection_similar": _collection({"kind": "similar", "photo_id": ASKED}, "photo_id", "distance"),
    "collection_text": _collection({"kind": "text", "q": "a dog"}, "photo_id", "path", "distance"),
    "collection_cluster": collection_cluster,
}

_TRIM = "trim(phash, ' ' || chr(9) || chr(10) || chr(13))"
_H = f"h as (select distinct id, ('0x' || {_TRIM})::ubigint as h from photo where regexp_full_match({_TRIM}, '[0-9a-fA-F]{{16}}') and not regexp_full_match({_TRIM}, '0{{16}}'))"
_F = "f as (select distinct id, photo_id, bbox_json, cluster_id, person_id from face_detection where id is not null)"
_BUSY = "b as (select cluster_id, row_number() over (order by count(*) desc, cluster_id) as rn from f where cluster_id is not null group by 1)"
_OWN = "(select min(person_id) from f where cluster_id = (select cluster_id from b where rn = {}) and person_id is not null)"


def _clustered(bits: int, columns: str, tail: str = "") -> str:
    return f"""with recursive {_H}, g as (select a.id as x, b.id as y from h a join h b on a.id <> b.id and bit_count(xor(a.h, b.h)) <= {bits}),
        r as (select x as id, x as reached from g union select r.id, g.y from r join g on g.x = r.reached), m as (select id, min(reached) as cluster_id from r group by 1),
        s as (select cluster_id, count(*) as size, sha256(string_agg(id::varchar, ',' order by id)) as cluster_key from m group by 1) select {columns} {tail}"""


_CLUSTER_PHOTOS = f"with {_P}, {_F}, {_BUSY} select id, path, captured_at from p where id in (select photo_id from f where cluster_id = (select cluster_id from b where rn = 1)) order by captured_at desc nulls last, id limit 200"
SQL = {
    "dupe_edges_banded": f"with {_H} select min(a.id) as first_id, count(*) as n from h a where exists (select 1 from h b where a.h <> b.h and bit_count(xor(a.h, b.h)) <= 5) group by a.h",
    "dupe_pairs_banded": f"with {_H}, u as (select h, min(id) as id from h group by h) select a.id as id_a, b.id as id_b, bit_count(xor(a.h, b.h))::int as distance from u a join u b on a.id < b.id and bit_count(xor(a.h, b.h)) <= 5",
    "dupe_memberships": _clustered(5, "id, cluster_id", "from m"), "dupe_clusters": _clustered(5, "*", "from s"), "dupe_exact": _clustered(0, "*", "from s"),
    "dupe_ignore_filter": _clustered(0, "cluster_id, size", "from s where size <> 2 order by size desc, cluster_id limit 50"),
    "people": f"""with {_F}, n as (select distinct id as person_id, name as person_name from person) select f.cluster_id, n.person_id, n.person_name, count(*) as face_count, count(distinct f.photo_id) as photo_count,
        min(f.id) as sample_face_id, min(f.photo_id) as sample_photo_id from f left join n on n.person_id = f.person_id where f.cluster_id is not null group by 1, 2, 3 having count(*) >= 2
        order by face_count desc, f.cluster_id, n.person_id nulls first limit 100""",
    "cluster_photos": _CLUSTER_PHOTOS, "collection_cluster": _CLUSTER_PHOTOS,
    "persons": f"with {_F}, n as (select distinct * from person) select n.id, n.name, n.created_at, count(f.id) as face_count, count(distinct f.photo_id) as photo_count from n left join f on f.person_id = n.id group by 1, 2, 3",
    "face_crop_box": f"""with {_P}, {_F}, j as (select id, photo_id, from_json(bbox_json, '["DOUBLE"]') as b from f where json_valid(bbox_json)),
        s as (select j.id, b, p.width as w, p.height as h, floor(p.width * least(1.0, 1024.0 / greatest(p.width, p.height))) as tw, floor(p.height * least(1.0, 1024.0 / greatest(p.width, p.height))) as th
            from j join p on p.id = j.photo_id where p.width > 0 and p.height > 0 and len(b) = 4 and len(list_filter(b, lambda x: x is null)) = 0),
        c as (select id, tw, th, (b[1] + b[3] / 2) * (tw / w) as cx, (b[2] + b[4] / 2) * (th / h) as cy, greatest(b[3] * (tw / w), b[4] * (th / h)) * 1.5 as side from s)
        select id, greatest(0, trunc(cx - side / 2)::int) as x1, greatest(0, trunc(cy - side / 2)::int) as y1, least(tw::int, trunc(cx + side / 2)::int) as x2, least(th::int, trunc(cy + side / 2)::int) as y2 from c""",
    "name_cluster": f"with {_F}, {_BUSY} select id, cluster_id, case when cluster_id = (select cluster_id from b where rn = 1) then (select max(id) + 1 from person) else person_id end as person_id from f",
    "merge_clusters": f"""with {_F}, {_BUSY}, k as (select coalesce({_OWN.format(1)}, {_OWN.format(2)}) as pid) select id, case when cluster_id = (select cluster_id from b where rn = 2) then (select cluster_id from b where rn = 1) else cluster_id end as cluster_id,
        case when cluster_id in (select cluster_id from b where rn <= 2) then coalesce((select pid from k), person_id) else person_id end as person_id from f""",
    "rename_person": "select distinct id, case when id = 8 then 'Renamed' else name end as name from person",
    "unname_person": f"with {_F} select id, case when person_id = 8 then null else person_id end as person_id from f",
    "collection_filter": f"""with {_P} select {_SHOWN} from p where substr(coalesce(captured_at, indexed_at), 1, 4) = '2019' and exif_json ilike '%"Image Model": "Lumora X3"%'
        order by aesthetic desc nulls last, coalesce(captured_at, indexed_at) desc nulls last, id limit 50""",
    "collection_color": CATALOG_SQL["color_search"].replace("limit 500", "limit 50"),
    "collection_similar": CATALOG_SQL["knn_similar"].replace("n.photo_id, p.path, round(d, 5) as distance, round(greatest(0, 1 - 0.5 * d), 5) as score", "n.photo_id, round(d, 5) as distance"),
    "collection_text": CATALOG_SQL["search_text"],
}
