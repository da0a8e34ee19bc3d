"""Ingest, import, sidecars and change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumika.operators import ingest, sidecar
from lumika.operators.scan import next_id, numbered
from lumika.plans.catalog import _P, photos, vectors
from lumika.plans.groups import faces, person
from lumika.streaming.watch import debounce, event_counts
from lumika.tables import distinct_by, table

ROOT = "/vault/photos"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the imported files' folders, as if they lay under a root, beside the photos there already."""
    files = distinct_by(table(spark, sf_dir, "import_files").where("id is not null"), "id").where("path is not null")
    fresh = files.select("path", "mtime", F.col("size").alias("size_bytes"))
    known = photos(spark, sf_dir).select("path", F.when(F.col("id") % 3 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size_bytes")
    return fresh.unionByName(known)


def needs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.needs_index(candidates(spark, sf_dir), photos(spark, sf_dir))


def photo_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photo table, all of its columns but the id, after the changed and the imported files were put in by path."""
    old = photos(spark, sf_dir).drop("id")
    rows = ingest.import_rows(_files(spark, sf_dir), photos(spark, sf_dir)).drop("file_id", "tags")
    changed = photos(spark, sf_dir).where("id % 7 = 0").select("path", (F.col("mtime") + 60).alias("mtime"), F.lit("changed").alias("caption"))
    return ingest.upsert(old, rows.unionByName(changed, allowMissingColumns=True), "path")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each photo's latest vector, of two rows of a photo the longer one: its length, and its sum and slope over the finite values."""
    long = vectors(spark, sf_dir).where("photo_id is not null").select("photo_id", "embedding", F.coalesce(F.size("embedding"), F.lit(-1)).alias("n"))
    sum_ = lambda f: F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda a, v: a + v)
    fine = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v.cast("double"))
    total, slope = sum_(lambda v: fine(v)), sum_(lambda v, i: fine(v) * (i % 5 - 2))
    latest = ingest.latest(long, "photo_id", F.struct("n", F.hash("embedding")))
    # repeated rows are copies but for how often they come, so sums tell which vector it is
    return latest.select("photo_id", "n", F.round(total + 1e-7, 4).alias("total"), F.round(slope + 1e-7, 4).alias("slope"))


def root_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan roots after two were added, one of which was there."""
    roots = table(spark, sf_dir, "scan_root").select("path", "enabled").distinct()
    new = spark.createDataFrame([(ROOT, 1), ("/vault/new", 1)], "path string, enabled int")
    return ingest.add_missing(roots, new, "path")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_by(table(spark, sf_dir, "import_files").where("id is not null"), "id")


def import_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.import_rows(_files(spark, sf_dir), photos(spark, sf_dir))
    return rows.select("file_id", "path", "captured_at", "caption", "imported_from")


def import_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.imported_tags(ingest.import_rows(_files(spark, sf_dir), photos(spark, sf_dir)))


def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.import_summary(_files(spark, sf_dir), photos(spark, sf_dir))


def import_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred files of an import that takes only what is there, here the pictures of one format."""
    present = _files(spark, sf_dir).select(F.trim("path").alias("path")).where(F.lower("path").endswith(".jpg"))
    return ingest.import_rows(_files(spark, sf_dir), photos(spark, sf_dir), present=present, limit=100).select("file_id", "path")


def import_photo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of the imported files under the ids that their photos got: the next ones in order of path."""
    have = photos(spark, sf_dir).select("id", "path")
    rows = ingest.import_rows(_files(spark, sf_dir), have)
    new = numbered(rows.select("path"), "path", next_id(have))
    return ingest.tags_of_photos(rows, have.unionByName(new.select("id", "path")))


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(photo_tag, tag): tags given by hand, as the catalog keeps them: labels in capitals, linked by id."""
    rows = table(spark, sf_dir, "photo_tag_auto").where("photo_id % 5 = 0 and score >= 0.25").select("photo_id", F.initcap(F.trim("label")).alias("name")).where("name is not null")
    tag = rows.select("name").distinct().select(F.xxhash64("name").alias("id"), "name")
    return rows.select("photo_id", F.xxhash64("name").alias("tag_id")), tag


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar.manual_tags(*_tagged(spark, sf_dir))


def sidecar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sidecar.sidecar_tags(_manual(spark, sf_dir), table(spark, sf_dir, "photo_tag_auto").distinct(), 0.22)
    return found.select("photo_id", F.array_join("tags", "|").alias("tags"))


def sidecar_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecar.sidecar_persons(faces(spark, sf_dir), person(spark, sf_dir)).select("photo_id", F.array_join("persons", "|").alias("persons"))


def export_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos of a collection that lie under one root."""
    put = table(spark, sf_dir, "photo_tag_auto").select(F.when(F.col("label") == "beach", 1).otherwise(2).alias("collection_id"), "photo_id")
    return sidecar.chosen_for_export(photos(spark, sf_dir), prefix=ROOT + "/", members=sidecar.members_of(put, 1)).select("id", "path")


def sidecar_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecars of all photos."""
    chosen = sidecar.chosen_for_export(photos(spark, sf_dir), everything=True)
    tags = sidecar.sidecar_tags(_manual(spark, sf_dir), table(spark, sf_dir, "photo_tag_auto").distinct())
    return sidecar.sidecars(chosen, tags, sidecar.sidecar_persons(faces(spark, sf_dir), person(spark, sf_dir)))


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debounce(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return found.select(F.col("root").alias("root_id"), F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "changes")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(table(spark, sf_dir, "events"), "ts", "event_type").select(F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "kind", "n")


def exif_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photos(spark, sf_dir).select("id", ingest.exif_captured(F.col("exif_json")).alias("captured"))


QUERIES = {
    "exif_captured": exif_captured, "needs_index": needs_index, "missing_embedding": lambda s, d: ingest.missing_embedding(photos(s, d), vectors(s, d)), "photo_upsert": photo_upsert, "vector_upsert": vector_upsert,
    "root_add": root_add, "import_dedup": import_dedup, "import_tags": import_tags, "import_summary": import_summary, "import_limited": import_limited, "import_photo_tags": import_photo_tags, "manual_tags": _manual,
    "sidecar_tags": sidecar_tags, "sidecar_persons": sidecar_persons, "export_selection": export_selection, "sidecar_packets": sidecar_packets,
    "debounce_sessions": debounce_sessions, "event_windows": event_windows,
}

_FILES = "fi as (select distinct * from import_files where id is not null)"
_IMPORT = f"""{_P}, {_FILES}, t as (select *, trim(path) as pa from fi where tagged_at is not null and trim(path) <> ''), n as (select *, row_number() over (partition by pa order by id) as rn from t where pa not in (select path from p where path is not null)),
        i as (select * from n where rn = 1)"""
_ISO = """case when regexp_full_match(trim(exif_dt), '[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}')
        and try_strptime(replace(substr(trim(exif_dt), 1, 10), ':', '-') || ' ' || substr(trim(exif_dt), 12, 8), '%Y-%m-%d %H:%M:%S') is not null
        then replace(substr(trim(exif_dt), 1, 10), ':', '-') || 'T' || substr(trim(exif_dt), 12, 8) || '+00:00' end"""
_IMPORTED = ("mtime", "size_bytes", "sha256", "width", "height", "captured_at", "phash", "caption", "imported_from")
_KEPT = ("orientation", "exif_json", "indexed_at", "embedding_ver", "thumb_small", "thumb_large", "face_count", "aesthetic", "dominant_colors")
_MANUAL = "hand as (select distinct photo_id, upper(left(trim(label), 1)) || lower(substr(trim(label), 2)) as tag from photo_tag_auto where photo_id % 5 = 0 and score >= 0.25)"
_TAGGED = """e as (select id as file_id, pa, unnest(from_json(tags_json, '["VARCHAR"]')) as raw, generate_subscripts(from_json(tags_json, '["VARCHAR"]'), 1) as k from i where json_valid(tags_json) and json_type(tags_json) = 'ARRAY'),
        g as (select file_id, pa, lower(trim(raw)) as label, min(k) as k from e where trim(raw) <> '' and not regexp_matches(lower(trim(raw)), '^(:|//|\\[|/|\\\\|\\{)') and not ends_with(trim(raw), ':') and length(trim(raw)) <= 40 and raw not like '%' || chr(10) || '%' group by 1, 2, 3),
        r as (select *, row_number() over (partition by file_id order by k) as rn from g)"""
_SPACES = " ".join(f'xmlns:{k}="{v}"' for k, v in sidecar.SPACES.items())
_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TAKEN = """coalesce(nullif(json_extract_string(exif_json, '$."EXIF DateTimeOriginal"'), ''), json_extract_string(exif_json, '$."Image DateTime"'))"""
SQL = {
    "exif_captured": f"""with {_P}, t as (select id, case when json_valid(exif_json) then {_TAKEN} end as t from p) select id, case when regexp_full_match(t, '[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
        and try_strptime(t, '%Y:%m:%d %H:%M:%S') is not null then replace(substr(t, 1, 10), ':', '-') || 'T' || substr(t, 12, 8) || '+00:00' end as captured from t""",
    "needs_index": f"""with {_P}, {_FILES}, c as (select path, mtime, size as size_bytes from fi where path is not null union all select path, case when id % 3 = 0 then mtime + 1 else mtime end, size_bytes from p)
        select c.* from c left join p on p.path = c.path where p.path is null or c.mtime is distinct from p.mtime or c.size_bytes is distinct from p.size_bytes or coalesce(p.embedding_ver, 0) < 1
        or coalesce(p.phash, '') = '' or coalesce(p.dominant_colors, '') = ''""",
    "missing_embedding": f"with {_P} select id, path from p where id not in (select photo_id from photo_embedding where photo_id is not null) or coalesce(embedding_ver, 0) < 1",
    "photo_upsert": f"""with {_IMPORT}, w as (select pa as path, coalesce(mtime, 0.0) as mtime, coalesce(size, 0) as size_bytes, sha256, width, height, {_ISO} as captured_at, phash, case when trim(caption) <> '' then trim(caption) end as caption,
        'photos.db:' || coalesce(source, 'unknown') as imported_from from i union all select path, mtime + 60, null, null, null, null, null, null, 'changed', null from p where id % 7 = 0)
        select coalesce(p.path, w.path) as path, {', '.join(f"coalesce(w.{c}, p.{c}) as {c}" for c in _IMPORTED)}, {', '.join(f"p.{c}" for c in _KEPT)} from p full join w on w.path = p.path""",
    "vector_upsert": """with v as (select photo_id, coalesce(len(embedding), -1)::int as n, round(coalesce(list_sum(list_transform(embedding, lambda x: case when x is null or not isfinite(x) then 0.0::double else x::double end)), case when embedding is not null then 0.0::double end) + 1e-7, 4) as total,
        round(coalesce(list_sum(list_transform(embedding, lambda x, i: case when x is null or not isfinite(x) then 0.0::double else x::double * ((i - 1) % 5 - 2) end)), case when embedding is not null then 0.0::double end) + 1e-7, 4) as slope from photo_embedding where photo_id is not null)
        select distinct photo_id, n, total, slope from v w where n = (select max(n) from v where v.photo_id = w.photo_id)""",
    "root_add": f"select distinct path, enabled from scan_root union all select * from (values ('{ROOT}', 1), ('/vault/new', 1)) t(path, enabled) where path not in (select path from scan_root)",
    "import_dedup": f"with {_IMPORT} select id as file_id, pa as path, {_ISO} as captured_at, case when trim(caption) <> '' then trim(caption) end as caption, 'photos.db:' || coalesce(source, 'unknown') as imported_from from i",
    "import_tags": f"""with {_IMPORT}, e as (select id as file_id, unnest(from_json(tags_json, '["VARCHAR"]')) as raw, generate_subscripts(from_json(tags_json, '["VARCHAR"]'), 1) as k from i where json_valid(tags_json) and json_type(tags_json) = 'ARRAY'),
        g as (select file_id, lower(trim(raw)) as label, min(k) as k from e where trim(raw) <> '' and not regexp_matches(lower(trim(raw)), '^(:|//|\\[|/|\\\\|\\{{)') and not ends_with(trim(raw), ':') and length(trim(raw)) <= 40 and raw not like '%' || chr(10) || '%' group by 1, 2),
        r as (select *, row_number() over (partition by file_id order by k) as rn from g) select file_id, (rn - 1)::int as pos, label, 1.0::double as score from r where rn <= 12""",
    "import_summary": f"""with {_P}, {_FILES}, t as (select trim(path) as pa from fi where tagged_at is not null), m as (select pa, coalesce(pa, '') = '' as blank, exists (select 1 from p where p.path = pa) as known from t)
        select count(*) as seen, count(distinct pa) filter (not blank and not known) as imported, count(*) filter (known) as existing,
        count(*) filter (not blank and not known) - count(distinct pa) filter (not blank and not known) as repeated, count(*) filter (blank) as without_path from m""",
    "import_limited": f"""with {_IMPORT} select id as file_id, pa as path from i where ends_with(lower(pa), '.jpg') order by id limit 100""",
    "import_photo_tags": f"""with {_IMPORT}, {_TAGGED}, q as (select pa, row_number() over (order by pa) + (select max(id) from p) as photo_id from i) select distinct q.photo_id, r.label, 1.0::double as score from r join q on q.pa = r.pa where rn <= 12""",
    "manual_tags": f"with {_MANUAL} select photo_id, tag as name from hand where tag is not null and photo_id is not null",
    "sidecar_packets": f"""with {_P}, {_MANUAL}, b as (select photo_id, tag, 0 as side, 0.0::double as rk from hand where tag is not null union all select photo_id, label, 1, -score from (select distinct * from photo_tag_auto) where score >= 0.5 and label is not null),
        u as (select *, row_number() over (partition by photo_id, lower(tag) order by side, rk, tag) as rn from b),
        t as (select photo_id, '<dc:subject><rdf:Bag>' || string_agg('<rdf:li>' || {_ESC.format("tag")} || '</rdf:li>', '' order by side, rk, tag) || '</rdf:Bag></dc:subject>' as x from u where rn = 1 group by 1),
        n as (select photo_id, '<Iptc4xmpExt:PersonInImage><rdf:Bag>' || string_agg('<rdf:li>' || {_ESC.format("name")} || '</rdf:li>', '' order by name) || '</rdf:Bag></Iptc4xmpExt:PersonInImage>' as x
            from (select distinct f.photo_id, q.name from face_detection f join person q on q.id = f.person_id) group by 1),
        s as (select p.id, regexp_replace(regexp_replace(path, '^/+', ''), '([^/])\\.[^./]*$', '\\1') || '.xmp' as target,
            '<?xpacket begin="' || chr(65279) || '" id="{sidecar.PACKET_ID}"?>' || chr(10) || '<x:xmpmeta {_SPACES}><rdf:RDF><rdf:Description rdf:about="">' || coalesce(t.x, '')
            || case when coalesce(caption, '') <> '' then '<dc:description><rdf:Alt><rdf:li xml:lang="x-default">' || {_ESC.format("caption")} || '</rdf:li></rdf:Alt></dc:description>' else '' end
            || case when aesthetic is not null then '<xmp:Rating>' || least(5, greatest(0, round_even(aesthetic / 2, 0)))::int || '</xmp:Rating>' else '' end || coalesce(n.x, '')
            || case when coalesce(captured_at, '') <> '' then '<photoshop:DateCreated>' || {_ESC.format("captured_at")} || '</photoshop:DateCreated>' else '' end
            || '</rdf:Description></rdf:RDF></x:xmpmeta>' || chr(10) || '<?xpacket end="w"?>' || chr(10) as packet
            from p left join t on t.photo_id = p.id left join n on n.photo_id = p.id)
        select max(id) as photo_id, target, arg_max(packet, id) as packet from s group by target""",
    "sidecar_tags": f"""with {_MANUAL}, b as (select photo_id, tag, 0 as side, 0.0::double as rk from hand where tag is not null union all select photo_id, label, 1, -score from (select distinct * from photo_tag_auto) where score >= 0.22 and label is not null),
        u as (select *, row_number() over (partition by photo_id, lower(tag) order by side, rk, tag) as rn from b) select photo_id, string_agg(tag, '|' order by side, rk, tag) as tags from u where rn = 1 group by 1""",
    "sidecar_persons": "select photo_id, string_agg(name, '|' order by name) as persons from (select distinct f.photo_id, p.name from face_detection f join person p on p.id = f.person_id) group by 1",
    "export_selection": f"with {_P} select id, path from p where starts_with(path, '{ROOT}/') and id in (select photo_id from photo_tag_auto where label = 'beach')",
    "debounce_sessions": """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as n from events where user_id is not null and ts is not null),
        s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id as root_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as opened, count(*) as changes from s group by user_id, k""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as opened, event_type as kind, count(*) as n from events where ts is not null group by 1, 2",
}
