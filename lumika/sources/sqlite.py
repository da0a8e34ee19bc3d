"""The external catalog, an SQLite file, as a data source read in ranges of ids."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = {
    "id": "bigint", "path": "string", "source": "string", "size": "bigint", "mtime": "double", "ext": "string", "sha256": "string", "phash": "string",
    "dhash": "string", "width": "int", "height": "int", "exif_dt": "string", "caption": "string", "tags_json": "string", "model": "string",
    "cluster_id": "bigint", "tagged_at": "string",
}


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options.get("table", "files"), int(options.get("partitions", 8))
        if not self.table.isidentifier():
            raise ValueError("not the name of a table")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as c:
            low, high = c.execute(f"select min(id), max(id) from {self.table}").fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with self._open() as c:
            have = {row[1] for row in c.execute(f"pragma table_info({self.table})")}
            names = ", ".join(n if n in have else f"null as {n}" for n in COLUMNS)
            yield from c.execute(f"select {names} from {self.table} where id >= ? and id < ? order by id", (partition.low, partition.high))


class CatalogSource(DataSource):
    """format("lumika_sqlite"), options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "lumika_sqlite"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in COLUMNS.items())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def external_files(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """The `files` table of an external catalog; columns it lacks are null."""
    spark.dataSource.register(CatalogSource)
    return spark.read.format("lumika_sqlite").option("path", path).option("partitions", partitions).load()
