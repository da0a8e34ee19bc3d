"""The journal of long jobs: queued, running, done or failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, root_id long, state string, started_at string, finished_at string, total long, processed long, error string"


def queue(jobs: DataFrame, root_id: int | None) -> tuple[DataFrame, int]:
    """(`jobs` with a queued one, its id)."""
    new = (jobs.agg(F.max("id")).first()[0] or 0) + 1
    return jobs.unionByName(jobs.sparkSession.createDataFrame([(new, root_id, "queued", None, None, None, 0, None)], SCHEMA)), new


def _change(jobs: DataFrame, job: int, allowed: tuple[str, ...], **values) -> DataFrame:
    if jobs.where((F.col("id") == job) & F.col("state").isin(*allowed)).limit(1).count() == 0:
        raise ValueError(f"no job {job} that is {' or '.join(allowed)}")
    own = F.col("id") == job
    kinds = dict(jobs.dtypes)
    return jobs.select(*[F.when(own, F.lit(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])


def start(jobs: DataFrame, job: int, at: str, total: int | None = None) -> DataFrame:
    return _change(jobs, job, ("queued",), state="running", started_at=at, total=total)


def progress(jobs: DataFrame, job: int, processed: int, total: int | None = None) -> DataFrame:
    return _change(jobs, job, ("running",), processed=processed, **({} if total is None else {"total": total}))


def finish(jobs: DataFrame, job: int, at: str, error: str | None = None) -> DataFrame:
    return _change(jobs, job, ("queued", "running"), state="failed" if error else "done", finished_at=at, error=error)


def throughput(jobs: DataFrame) -> DataFrame:
    """(id, seconds, per_second) of the jobs that ran to an end; a job of no time has no rate."""
    seconds = F.unix_micros(F.try_to_timestamp("finished_at")) / 1e6 - F.unix_micros(F.try_to_timestamp("started_at")) / 1e6
    rows = jobs.where("state = 'done'").select("id", seconds.alias("seconds"), "processed").where("seconds is not null")
    return rows.select("id", "seconds", F.when(F.col("seconds") > 0, F.col("processed") / F.col("seconds")).alias("per_second"))
