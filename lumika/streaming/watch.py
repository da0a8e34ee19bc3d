"""Change streams: debounced rescans, incremental scans and online face clusters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumika.functions.vectors import unit
from lumika.operators.ingest import needs_index
from lumika.operators.people import THRESHOLD, Centroids
from lumika.session import materialize, release, shared_root

GAP = "5 seconds"


def debounce(events: DataFrame, root: str, at: str, gap: str = GAP, late: str | None = None) -> DataFrame:
    """(root, opened, fires_at, changes): a rescan per burst of changes, due once a root has been quiet for `gap`.

    Works on a batch and on a stream alike; a stream needs `late`, how long a change may be delayed, so that its state ends.
    """
    rows = events.select(F.col(root).alias("root"), F.col(at).cast("timestamp").alias("at")).where("root is not null and at is not null")
    if late:
        rows = rows.withWatermark("at", late)
    burst = rows.groupBy(F.session_window("at", gap).alias("burst"), "root").agg(F.count("*").alias("changes"))
    return burst.select("root", F.col("burst.start").alias("opened"), F.col("burst.end").alias("fires_at"), "changes")


def event_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(opened, kind, n): tumbling counts; late events count while the watermark allows."""
    rows = events.select(F.col(at).cast("timestamp").alias("at"), F.col(kind).alias("kind")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("opened"), "kind", "n")


def scan_stream(files: DataFrame, read_photo: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch's new or changed files to `write`; a replayed batch finds nothing to do once it was written."""

    def each(batch: DataFrame, number: int) -> None:
        write(needs_index(batch, read_photo()), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_clusters(faces: DataFrame, group: str, dim: int, threshold: float = THRESHOLD) -> DataFrame:
    """(group, face_id, cluster): online clustering with the centroids of each group as state, faces of a batch in order of id."""
    state_schema = "names array<long>, flat array<double>, next_id long"
    kind = faces.schema[group].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, flat, next_id = state.get if state.exists else ([], [], 1)
        held = Centroids(dim, list(map(int, names)), np.array(flat, np.float64).reshape(-1, dim), next_id, threshold)
        frame = pd.concat(list(frames)).sort_values("face_id")
        out = held.place(unit(np.stack([np.asarray(v, np.float64) for v in frame["embedding"]]))) if len(frame) else []
        state.update((held.names, held.rows.ravel().tolist(), held.next_id))
        yield pd.DataFrame({group: key[0], "face_id": frame["face_id"].to_numpy(), "cluster": out})

    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = (F.size("embedding") == dim) & ~F.exists("embedding", odd) & F.exists("embedding", lambda v: v != 0)
    usable = faces.where(F.col("face_id").isNotNull() & fine).select(group, "face_id", "embedding")
    return usable.groupBy(group).applyInPandasWithState(run, f"`{group}` {kind}, face_id long, cluster long", state_schema, "append", GroupStateTimeout.NoTimeout)


PROGRESS = "id string, name string, batch long, at string, rows long, rows_per_second double, state_rows long"


def progress(query: StreamingQuery) -> DataFrame:
    """(id, name, batch, at, rows, rows_per_second, state_rows): what a stream has reported of its latest batches, for a change feed."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    rows = []
    for p in query.recentProgress:
        state = sum(s["numRowsTotal"] for s in p["stateOperators"])
        rows.append((str(p["id"]), p["name"], p["batchId"], p["timestamp"], p["numInputRows"], float(p["processedRowsPerSecond"] or 0.0), state))
    return spark.createDataFrame(rows, PROGRESS)


def drain(stream: DataFrame, key: str, mode: str = "complete") -> DataFrame:
    """What an aggregating stream has found once it has read all there is, as a table in the shared folder."""
    spark, last = stream.sparkSession, []

    def keep(batch: DataFrame, number: int) -> None:
        # in complete mode each batch holds the whole result, so the latest stands for all
        release(*last)
        last[:] = [materialize(batch)]

    if mode != "complete":
        raise ValueError("only a complete result can be drained")
    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{shared_root(spark)}/streams/{key}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return last[0] if last else spark.createDataFrame([], stream.schema)
