"""Whole passes over the catalog: scan and backfills, and the small tables of administration."""

from __future__ import annotations

import os
import sqlite3
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumika.operators import collections, dupes, jobs, people, scan
from lumika.plans.catalog import _P, PHOTO_DIM, photos, vectors
from lumika.plans.flows import candidates
from lumika.plans.groups import _H, NOW, _busiest, faces, person
from lumika.session import materialize, shared_root
from lumika.sources.sqlite import COLUMNS, external_files
from lumika.streaming.watch import debounce, drain, event_counts
from lumika.tables import table


def _encoder():
    """Stands for a model: the same unit vector for every file."""
    return lambda items: np.ones((len(items), PHOTO_DIM), np.float32)


def _contents(paths: DataFrame) -> DataFrame:
    """Files with contents for a catalog that keeps none: pictures of eight by eight grey pixels from the digest of their path.

    Files of a raw format have contents that no decoder knows.
    """
    digest = F.concat(*[F.unhex(F.sha2(F.concat(F.lit(k), F.col("path")), 256)) for k in "ab"])
    picture = F.concat(F.encode(F.lit("P5 8 8 255\n"), "UTF-8"), digest)
    raw = F.lower("path").rlike(r"\.(cr2|cr3|nef|arw|raf|dng|rw2|orf)$")
    return paths.withColumn("content", F.when(raw, F.encode(F.lit("raw"), "UTF-8")).otherwise(picture))


def _scanned(spark: SparkSession, sf_dir: str) -> scan.Outcome:
    found = candidates(spark, sf_dir).dropDuplicates(["path"]).where("path is not null")
    return scan.scan(_contents(found), photos(spark, sf_dir), vectors(spark, sf_dir).where("photo_id is not null"), _encoder, NOW)


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a scan over the photos' own and the imported files."""
    return _scanned(spark, sf_dir).summary


def scan_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths and ids of the photo table after that scan, and which were indexed by it."""
    after = _scanned(spark, sf_dir).photo
    return after.select("id", "path", (F.col("indexed_at") == NOW).alias("indexed"), "width")


def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).errors.select("path")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos' own files, those of photos with an even size being gone."""
    return _contents(photos(spark, sf_dir).where("path is not null and size_bytes % 2 = 1").select("path", "mtime", "size_bytes").dropDuplicates(["path"]))


def color_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos without a palette, and whether the backfill found one."""
    lacking = photos(spark, sf_dir).where("dominant_colors is null").select("id")
    after = scan.backfill_colors(photos(spark, sf_dir), _stored(spark, sf_dir)).photo
    return after.join(lacking, "id", "left_semi").select("id", (F.col("dominant_colors") != "[]").alias("found"))


def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of encoding what has no vector of the present version."""
    return scan.backfill_vectors(photos(spark, sf_dir), vectors(spark, sf_dir).where("photo_id is not null"), _stored(spark, sf_dir), _encoder, NOW).summary


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What naming, merging, renaming and unnaming leave in the audit log, one after the other."""
    f, p = faces(spark, sf_dir), person(spark, sf_dir)
    first, second = _busiest(spark, sf_dir)
    _, _, named = people.name_cluster(f, p, first, " New Name ", NOW)
    _, merged = people.merge_clusters(f, second, first, NOW)
    _, renamed = people.rename_person(p, 8, "Renamed", NOW)
    _, _, gone = people.unname_person(f, p, 8, NOW)
    return named.unionByName(merged).unionByName(renamed).unionByName(gone)


def ignored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys ignored after the three largest clusters of equal hashes were, the first of them twice, and the second no longer."""
    keys = [r["cluster_key"] for r in dupes.clusters(photos(spark, sf_dir), 0, limit=3).select("cluster_key").collect()]
    ignored = spark.createDataFrame([], "cluster_key string, created_at string")
    for key in [*keys, *keys[:1]]:
        ignored = dupes.ignore(ignored, key, NOW)
    return dupes.unignore(ignored, keys[1])[0] if len(keys) > 1 else ignored


def collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches after one for each year with photos of 2018 and later was put in and one was deleted."""
    years = [r[0] for r in photos(spark, sf_dir).select(F.substring("captured_at", 1, 4).alias("y")).where("y in ('2018', '2019', '2020', '2021')").distinct().orderBy("y").collect()]
    held = spark.createDataFrame([], "id long, name string, is_smart int, query_json string, created_at string")
    for y in years:
        held = collections.create(held, f"Year {y}", {"kind": "filter", "filters": {"year": int(y)}}, NOW)
    return collections.listed(collections.delete(held, 2)[0])


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each scan root: started, told of the root's photos, and ended, those of disabled roots as failed."""
    roots = table(spark, sf_dir, "scan_root").where("id is not null").dropDuplicates(["id"])
    own = photos(spark, sf_dir).select("id", F.explode(F.array(*[F.struct(F.lit(r["id"]).alias("root"), F.lit(r["path"].rstrip("/") + "/").alias("under")) for r in roots.orderBy("id").collect()])).alias("r"), "path")
    count = {r[0]: r[1] for r in own.where("startswith(path, r.under)").groupBy("r.root").count().collect()}
    held = spark.createDataFrame([], jobs.SCHEMA)
    for r in roots.orderBy("id").collect():
        held, job = jobs.queue(held, r["id"])
        held = jobs.start(held, job, "2026-01-01T00:00:00Z", count.get(r["id"], 0))
        held = jobs.progress(held, job, count.get(r["id"], 0))
        held = materialize(jobs.finish(held, job, "2026-01-01T00:00:40Z", None if r["enabled"] else "disabled"))
    return held


def job_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir)


def job_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.throughput(_journal(spark, sf_dir))


def external_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged files of an external catalog, read from its SQLite file in ranges of ids."""
    folder = shared_root(spark).removeprefix("file://") + "/catalogs"
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}.db"
    rows = table(spark, sf_dir, "import_files").where("id is not null").dropDuplicates(["id"]).select(*COLUMNS)
    with sqlite3.connect(path) as held:
        held.execute(f"create table files ({', '.join(COLUMNS)})")
        held.executemany(f"insert into files values ({', '.join('?' * len(COLUMNS))})", (tuple(r) for r in rows.toLocalIterator()))
    held.close()
    return external_files(spark, path).where("tagged_at is not null").select("id", "path", "source", "size", "mtime", "tags_json", "tagged_at")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling counts as a stream finds them."""
    found = drain(event_counts(_event_stream(spark, sf_dir), "ts", "event_type"), "windows")
    return found.select(F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "kind", "n")


def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debounced sessions as a stream finds them."""
    found = drain(debounce(_event_stream(spark, sf_dir), "user_id", "ts", "6 hours", late="1 hour"), "sessions")
    return found.select(F.col("root").alias("root_id"), F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "changes")


QUERIES = {
    "scan_summary": scan_summary, "scan_photos": scan_photos, "scan_errors": scan_errors, "color_backfill": color_backfill, "vector_backfill": vector_backfill,
    "audit_log": audit_log, "ignored_clusters": ignored_clusters, "collection_list": collection_list, "job_journal": job_journal, "job_rates": job_rates,
    "external_catalog": external_catalog, "event_windows_stream": event_windows_stream, "debounce_stream": debounce_stream,
}

_RAW = "regexp_matches(lower(path), '\\.(cr2|cr3|nef|arw|raf|dng|rw2|orf)$')"
_TODO = f"""{_P}, fi as (select distinct * from import_files where id is not null), a as (select path, mtime, size as size_bytes, 0 as own from fi where path is not null
            union all select path, case when id % 3 = 0 then mtime + 1 else mtime end, size_bytes, 1 from p where path is not null),
        c as (select path, count(*) as n from a group by 1), t as (select c.path from c left join p on p.path = c.path where p.path is null or exists (select 1 from a where a.path = c.path and
            (a.mtime is distinct from p.mtime or a.size_bytes is distinct from p.size_bytes)) or coalesce(p.embedding_ver, 0) < 1 or coalesce(p.phash, '') = '' or coalesce(p.dominant_colors, '') = '')"""
_F2 = "f as (select distinct id, photo_id, bbox_json, cluster_id, person_id from face_detection where id is not null)"
_TOP2 = "b as (select cluster_id, row_number() over (order by count(*) desc, cluster_id) as rn from f where cluster_id is not null group by 1)"
_YEARS = "y as (select y, row_number() over (order by y) as id from (select distinct substr(captured_at, 1, 4) as y from photo where id is not null) where y in ('2018', '2019', '2020', '2021'))"
_JOBS = f"""{_P}, r as (select id, path, enabled, row_number() over (order by id) as job from (select distinct * from scan_root where id is not null)),
        n as (select r.id, count(p.id) as n from r left join p on starts_with(p.path, rtrim(r.path, '/') || '/') group by 1)"""
SQL = {
    "scan_summary": f"with {_TODO} select (select count(*) from c) as candidates, count(*) as todo, count(*) filter (not {_RAW}) as indexed, count(*) filter ({_RAW}) as errors from t",
    "scan_photos": f"""with {_TODO}, g as (select path from t where not {_RAW}), n as (select path, row_number() over (order by path) + (select max(id) from p) as id from g where path not in (select path from p where path is not null))
        select p.id, p.path, coalesce(g.path is not null or p.indexed_at = '{NOW}', false) as indexed, case when g.path is not null then 8 else p.width end as width from p left join g on g.path = p.path
        union all select id, path, true, 8 from n""",
    "scan_errors": f"with {_TODO} select path from t where {_RAW}",
    "color_backfill": f"with {_P} select id, coalesce(path is not null and size_bytes % 2 = 1 and not {_RAW}, false) as found from p where dominant_colors is null",
    "vector_backfill": f"""with {_P}, t as (select id, path, size_bytes from p where id not in (select photo_id from photo_embedding where photo_id is not null) or coalesce(embedding_ver, 0) < 1)
        select count(*) as todo, count(*) filter (coalesce(path is not null and size_bytes % 2 = 1, false)) as encoded, count(*) filter (not coalesce(path is not null and size_bytes % 2 = 1, false)) as errors from t""",
    "audit_log": f"""with {_F2}, {_TOP2}, x as (select (select cluster_id from b where rn = 1) as c1, (select cluster_id from b where rn = 2) as c2, (select max(id) + 1 from person) as pid)
        select 'name' as action, '{{"cluster_id":"' || c1 || '","person_id":"' || pid || '","name":"New Name"}}' as detail, '{NOW}' as created_at from x
        union all select 'merge', '{{"source":"' || c2 || '","target":"' || c1 || '"}}', '{NOW}' from x
        union all select 'rename', '{{"person_id":"8","name":"Renamed"}}', '{NOW}' union all select 'unname', '{{"person_id":"8"}}', '{NOW}'""",
    "ignored_clusters": f"""with {_H}, m as (select h, min(id) as cluster_id, count(*) as size, sha256(string_agg(id::varchar, ',' order by id)) as cluster_key from h group by h having count(*) > 1),
        r as (select *, row_number() over (order by size desc, cluster_id) as rn from m) select cluster_key, '{NOW}' as created_at from r where rn in (1, 3)""",
    "collection_list": f"""with {_YEARS} select id, 'Year ' || y as name, 1 as is_smart, '{{"kind": "filter", "filters": {{"year": ' || y || '}}}}' as query_json, '{NOW}' as created_at from y where id <> 2""",
    "job_journal": f"""with {_JOBS} select job as id, r.id as root_id, case when enabled <> 0 then 'done' else 'failed' end as state, '2026-01-01T00:00:00Z' as started_at, '2026-01-01T00:00:40Z' as finished_at, n as total, n as processed,
        case when enabled <> 0 then null else 'disabled' end as error from r join n on n.id = r.id""",
    "job_rates": f"with {_JOBS} select job as id, 40.0::double as seconds, n / 40.0 as per_second from r join n on n.id = r.id where enabled <> 0",
    "external_catalog": "select distinct id, path, source, size, mtime, tags_json, tagged_at from import_files where id is not null and tagged_at is not null",
    "event_windows_stream": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as opened, event_type as kind, count(*) as n from events where ts is not null group by 1, 2",
    "debounce_stream": """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as n from events where user_id is not null and ts is not null),
        s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id as root_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as opened, count(*) as changes from s group by user_id, k""",
}
