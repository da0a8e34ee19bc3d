"""Face clusters, the persons they are named after, and online clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumika.functions.vectors import clean, mean_vectors, unit

THRESHOLD = 0.55


def people(faces: DataFrame, person: DataFrame, min_size: int = 2, limit: int = 100) -> DataFrame:
    """One row per cluster and the person its faces bear; a cluster with faces of several persons has several rows."""
    named = person.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    rows = faces.where("cluster_id is not null").select("id", "photo_id", "cluster_id", F.col("person_id").alias("pid"))
    rows = rows.join(named, F.col("pid") == F.col("person_id"), "left")
    found = rows.groupBy("cluster_id", "person_id", "person_name").agg(
        F.count("*").alias("face_count"), F.count_distinct("photo_id").alias("photo_count"), F.min("id").alias("sample_face_id"), F.min("photo_id").alias("sample_photo_id")
    )
    return found.where(F.col("face_count") >= min_size).orderBy(F.desc("face_count"), "cluster_id", F.asc_nulls_first("person_id")).limit(limit)


def cluster_photos(faces: DataFrame, photo: DataFrame, cluster_id: int, limit: int = 200) -> DataFrame:
    """Photos with a face of the cluster, newest first."""
    own = faces.where(F.col("cluster_id") == cluster_id)
    rows = photo.join(own, photo["id"] == own["photo_id"], "left_semi")
    return rows.select("id", "path", "captured_at").orderBy(F.desc_nulls_last("captured_at"), "id").limit(limit)


def persons(person: DataFrame, faces: DataFrame) -> DataFrame:
    """Every person with the number of their faces and photos, by name without regard to case."""
    own = faces.select(F.col("person_id").alias("pid"), F.col("id").alias("face_id"), "photo_id")
    rows = person.join(own, person["id"] == own["pid"], "left")
    counted = rows.groupBy("id", "name", "created_at").agg(F.count("face_id").alias("face_count"), F.count_distinct("photo_id").alias("photo_count"))
    return counted.orderBy(F.collate("name", "UTF8_LCASE"), "id")


def crop_boxes(faces: DataFrame, photo: DataFrame, largest: int = 1024, pad: float = 0.25) -> DataFrame:
    """(id, x1, y1, x2, y2): the square around each face in the large thumbnail, `pad` wider on each side, within the picture.

    A thumbnail keeps the shape and is at most `largest` on its long side; boxes that are no four numbers, and photos
    without size, have none.
    """
    box = F.from_json("bbox_json", "array<double>")
    rows = faces.select("id", "photo_id", box.alias("b")).where((F.size("b") == 4) & ~F.exists("b", lambda v: v.isNull()))
    rows = rows.join(photo.where("width > 0 and height > 0").select(F.col("id").alias("photo_id"), "width", "height"), "photo_id")
    shrink = F.least(F.lit(1.0), largest / F.greatest("width", "height"))
    rows = rows.select("id", "b", "width", "height", F.floor(F.col("width") * shrink).alias("tw"), F.floor(F.col("height") * shrink).alias("th"))
    sx, sy = F.col("tw") / F.col("width"), F.col("th") / F.col("height")
    x, y, w, h = (F.col("b")[i] for i in range(4))
    rows = rows.select("id", "tw", "th", ((x + w / 2) * sx).alias("cx"), ((y + h / 2) * sy).alias("cy"), (F.greatest(w * sx, h * sy) * (1 + 2 * pad)).alias("side"))
    low = lambda c: F.greatest(F.lit(0), (F.col(c) - F.col("side") / 2).cast("int"))
    high = lambda c, most: F.least(F.col(most).cast("int"), (F.col(c) + F.col("side") / 2).cast("int"))
    return rows.select("id", low("cx").alias("x1"), low("cy").alias("y1"), high("cx", "tw").alias("x2"), high("cy", "th").alias("y2"))


def audit_row(spark, action: str, detail: dict, at: str) -> DataFrame:
    """One row for the audit log: the action and its detail as JSON."""
    values = F.create_map(*[x for k, v in detail.items() for x in (F.lit(k), F.lit(str(v)))]) if detail else F.create_map()
    return spark.range(1).select(F.lit(action).alias("action"), F.to_json(values).alias("detail"), F.lit(at).alias("created_at"))


def _need(df: DataFrame, condition, message: str) -> None:
    if df.where(condition).limit(1).count() == 0:
        raise KeyError(message)


def _clean_name(name: str) -> str:
    if not name or not name.strip():
        raise ValueError("a name must not be empty")
    return name.strip()


def name_cluster(faces: DataFrame, person: DataFrame, cluster_id: int, name: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, person, audit): all faces of the cluster bear the person of that name, who is created if need be."""
    name = _clean_name(name)
    _need(faces, F.col("cluster_id") == cluster_id, "unknown cluster")
    row = person.where(F.col("name") == name).agg(F.min("id")).first()
    pid = row[0]
    if pid is None:
        pid = (person.agg(F.max("id")).first()[0] or 0) + 1
        person = person.unionByName(person.sparkSession.createDataFrame([(pid, name, at)], "id long, name string, created_at string"))
    faces = faces.withColumn("person_id", F.when(F.col("cluster_id") == cluster_id, F.lit(pid).cast("long")).otherwise(F.col("person_id")))
    return faces, person, audit_row(person.sparkSession, "name", {"cluster_id": cluster_id, "person_id": pid, "name": name}, at)


def rename_person(person: DataFrame, person_id: int, name: str, at: str) -> tuple[DataFrame, DataFrame]:
    name = _clean_name(name)
    _need(person, F.col("id") == person_id, "unknown person")
    if person.where((F.col("name") == name) & (F.col("id") != person_id)).limit(1).count():
        raise ValueError("the name is taken")
    after = person.withColumn("name", F.when(F.col("id") == person_id, F.lit(name)).otherwise(F.col("name")))
    return after, audit_row(person.sparkSession, "rename", {"person_id": person_id, "name": name}, at)


def unname_person(faces: DataFrame, person: DataFrame, person_id: int, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _need(person, F.col("id") == person_id, "unknown person")
    faces = faces.withColumn("person_id", F.when(F.col("person_id") == person_id, F.lit(None)).otherwise(F.col("person_id")))
    return faces, person.where(F.col("id") != person_id), audit_row(person.sparkSession, "unname", {"person_id": person_id}, at)


def merge_clusters(faces: DataFrame, source: int, target: int, at: str) -> tuple[DataFrame, DataFrame]:
    """All faces of `source` move to `target`; the target's person, or else the source's, is that of all of them."""
    if source == target:
        raise ValueError("a cluster can't be merged with itself")
    for cluster in (source, target):
        _need(faces, F.col("cluster_id") == cluster, "unknown cluster")
    owner = lambda c: faces.where((F.col("cluster_id") == c) & F.col("person_id").isNotNull()).agg(F.min("person_id")).first()[0]
    pid = owner(target) if owner(target) is not None else owner(source)
    inside = F.col("cluster_id").isin(source, target)
    person = F.when(inside, F.lit(pid).cast("long")).otherwise(F.col("person_id")) if pid is not None else F.col("person_id")
    cluster = F.when(F.col("cluster_id") == source, F.lit(target).cast("long")).otherwise(F.col("cluster_id"))
    after = faces.withColumn("person_id", person).withColumn("cluster_id", cluster)
    return after, audit_row(faces.sparkSession, "merge", {"source": source, "target": target}, at)


class Centroids:
    """Clusters as rows of one growing matrix, for sequential assignment.

    A vector goes to the most similar centroid if that is similar enough, which then moves half-way to it and is
    normalised; otherwise it opens a cluster. Similarities of a chunk come from one matrix product and are renewed only
    for the rows that changed since.
    """

    def __init__(self, dim: int, names: list[int] = (), rows: np.ndarray | None = None, next_id: int = 1, threshold: float = THRESHOLD):
        self.names, self.next_id, self.threshold = list(names), next_id, threshold
        self.matrix = np.zeros((max(64, 2 * len(self.names)), dim))
        if len(self.names):
            self.matrix[: len(self.names)] = rows

    @property
    def rows(self) -> np.ndarray:
        return self.matrix[: len(self.names)]

    def place(self, chunk: np.ndarray) -> list[int]:
        """The clusters of the chunk's vectors, one after the other."""
        likeness = chunk @ self.rows.T
        out, changed = [], {}
        for vector, row in zip(chunk, likeness):
            full = np.full(len(self.names), -np.inf)
            full[: len(row)] = row
            if changed:
                at = np.fromiter(changed, np.int64, len(changed))
                full[at] = self.matrix[at] @ vector
            best = int(np.argmax(full)) if len(full) else -1
            if best >= 0 and full[best] >= self.threshold:
                moved = (self.matrix[best] + vector) / 2
                size = np.linalg.norm(moved)
                self.matrix[best] = moved / size if size > 0 else moved
            else:
                best = len(self.names)
                if best == len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[best] = vector
                self.names.append(self.next_id)
                self.next_id += 1
            changed[best] = True
            out.append(self.names[best])
        return out


_CHUNK = 256


def online_clusters(faces: DataFrame, group: str, threshold: float = THRESHOLD, first_id: int = 1, dim: int | None = None) -> DataFrame:
    """(group, face_id, cluster): sequential clustering in order of face_id within each `group`.

    `faces(group, face_id, embedding)`. The result depends on the order, so each group is one task, through which its
    faces stream in batches; what the task holds is one batch and the centroids. Groups such as scan roots run side by
    side. The order-free alternative over all faces is a threshold graph with its components. Null, short, long, zero and
    non-finite vectors are left out, repeated faces count once. Without `dim` vectors have the length that most of them have.
    """
    if dim is None:
        most = faces.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = most["n"] if most else 1
    kind = faces.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last = None, None, None
        for batch in batches:
            at, x = clean(batch.column(2), pa.array(np.arange(len(batch))), dim)
            names, ids = batch.column(0).take(pa.array(at)).to_pylist(), batch.column(1).to_numpy()[at]
            fresh = np.array([(n, i) != (m, j) for n, i, m, j in zip(names, ids, [now, *names], [last, *ids])], bool)
            at, x, ids, names = at[fresh], x[fresh], ids[fresh], [n for n, f in zip(names, fresh) if f]
            if not len(at):
                continue
            x, out = unit(x), np.zeros(len(at), np.int64)
            heads = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for low, high in zip(heads, [*heads[1:], len(names)]):
                if state is None or names[low] != now:
                    now, state = names[low], Centroids(dim, next_id=first_id, threshold=threshold)
                for i in range(low, high, _CHUNK):
                    out[i : min(high, i + _CHUNK)] = state.place(x[i : min(high, i + _CHUNK)])
            last = ids[-1]
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(ids), pa.array(out)], names=[group, "face_id", "cluster"])

    usable = faces.where(F.col("embedding").isNotNull() & F.col("face_id").isNotNull()).select(group, F.col("face_id").cast("long"), "embedding")
    ordered = usable.repartition(F.col(group)).sortWithinPartitions(group, "face_id")
    return ordered.mapInArrow(run, f"`{group}` {kind}, face_id long, cluster long")


def stored_centroids(faces: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the mean of each recorded cluster's usable vectors."""
    own = faces.where("id is not null and cluster_id is not null").select(F.col("id").alias("face_id"), "cluster_id").dropDuplicates(["face_id"])
    return mean_vectors(vectors.dropDuplicates(["face_id"]).join(own, "face_id"), "cluster_id")


def next_cluster_id(faces: DataFrame) -> int:
    return (faces.agg(F.max("cluster_id")).first()[0] or 0) + 1


def index_faces(faces: DataFrame, vectors: DataFrame, dim: int, threshold: float = THRESHOLD) -> DataFrame:
    """(face_id, cluster_id): clusters of the faces that have none yet, over the whole catalog, in order of their ids.

    It starts from the recorded clusters' means and numbers new clusters after the largest there is. As each face depends
    on those before it, the new faces stream through one task, which holds the centroids; it is meant for the faces that
    came since the last run. Faces without a usable vector get no cluster.
    """
    start = stored_centroids(faces, vectors.where(F.size("embedding") == dim))
    names, rows = [], []
    for r in start.orderBy("cluster_id").toLocalIterator():
        names.append(r[0])
        rows.append(np.array(r[1], np.float64))
    first = next_cluster_id(faces)
    fresh = faces.where("id is not null and cluster_id is null").select(F.col("id").alias("face_id")).distinct()
    todo = vectors.where(F.size("embedding") == dim).join(fresh, "face_id").select(F.col("face_id").cast("long"), "embedding")
    held = faces.sparkSession.sparkContext.broadcast(np.array(rows) if rows else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = Centroids(dim, names, held.value, first, threshold), None
        for batch in batches:
            ids, x = clean(batch.column(1), batch.column(0), dim)
            fine = np.r_[ids[:1] != last, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
            ids, x = ids[fine], unit(x[fine]) if fine.any() else x[fine]
            out: list[int] = []
            for at in range(0, len(ids), _CHUNK):
                out += state.place(x[at : at + _CHUNK])
            last = ids[-1] if len(ids) else last
            yield pa.record_batch([pa.array(ids), pa.array(out, pa.int64())], names=["face_id", "cluster_id"])

    return todo.repartition(1).sortWithinPartitions("face_id").mapInArrow(run, "face_id long, cluster_id long")
