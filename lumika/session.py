"""Session set-up and the shared folder in which iterative operators cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_TABLE_ROOTS: set[str] = set()
_SETTING = threading.RLock()


def get_session(app: str = "lumika", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, as the cluster names it.

    Only a local master without that setting gets a temporary folder; on a cluster an unset folder is an error,
    because a machine-local one would not survive the loss of an executor.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        made = tempfile.mkdtemp(prefix="lumika-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _LOCAL_ROOTS[context.applicationId] = f"file://{made}"
    return _LOCAL_ROOTS[context.applicationId]


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _delete(path: str) -> None:
    jvm, context = SparkContext._jvm, SparkContext._active_spark_context
    live = context is not None and context._jsc is not None
    settings = context._jsc.hadoopConfiguration() if live else jvm.org.apache.hadoop.conf.Configuration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(settings).delete(target, True)


def _forget_tables() -> None:
    """At the driver's end no table of its applications is left."""
    for root in _TABLE_ROOTS:
        with contextlib.suppress(Exception):
            _delete(root)


def _table_root(spark: SparkSession) -> str:
    """The folder of this application's tables; one whose driver was killed is known by the application's id."""
    root = f"{shared_root(spark)}/tables/{spark.sparkContext.applicationId}"
    if not _TABLE_ROOTS:
        atexit.register(_forget_tables)
    _TABLE_ROOTS.add(root)
    return root


def materialize(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there and survives lost executors.

    `arrow_rows` bounds the rows of an Arrow batch while `df` is computed, for plans that hand wide rows to Python; such
    writes of one driver take turns, as the bound is a setting of the session. The table is deleted by `release`, by the
    end of a `Scratch` it was made in, or at the driver's end.
    """
    spark = df.sparkSession
    path = f"{_table_root(spark)}/{uuid.uuid4().hex}"
    if arrow_rows:
        with _SETTING:
            before = spark.conf.get(ARROW_ROWS)
            try:
                spark.conf.set(ARROW_ROWS, str(min(arrow_rows, int(before)) if int(before) > 0 else arrow_rows))
                df.write.parquet(path)
            finally:
                spark.conf.set(ARROW_ROWS, before)
    else:
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lumika_path = path
    return back


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by `materialize` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_lumika_path", None)
        if path:
            _delete(path)


class Scratch:
    """Intermediate tables of one operator: deleted at the end of the block, when the result has been written."""

    def __enter__(self) -> Scratch:
        self._made: list[DataFrame] = []
        return self

    def table(self, df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
        return self.keep(materialize(df, arrow_rows))

    def keep(self, df: DataFrame) -> DataFrame:
        """Take over a table that another operator wrote."""
        self._made.append(df)
        return df

    def __exit__(self, *_) -> None:
        release(*self._made)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for explicit range or hash partitioning."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
