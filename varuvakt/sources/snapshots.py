"""Versioned Parquet tables for micro-batch writers.

Plain Parquet has no MERGE. A table is a base version plus one folder of
changed row images per committed batch; readers take the newest image per key.
A micro-batch therefore writes only the rows it touched, and ``compact`` folds
the images into a new base now and then. Folders are written first and become
visible through a commit file, so a batch that died half-way leaves nothing
readable. The store counts its versions itself; the commit file also names the
writer and the writer's own batch number, so a batch that is delivered again is
skipped, while another stream, or one with a new checkpoint, may start at zero.
One writer commits at a time.

A base may be laid out by a column: its rows lie in folders by a hash of that column, and a
batch that looks up some keys reads the folders of these keys only. A folder that outgrows a task
is written by several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BEFORE_ANY_BATCH = -1
#: Folders of a base that is laid out by a column, and the column of their number.
BUCKETS, BUCKET = 256, "_bucket"


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, list[str] | None], layout: dict[str, str] | None = None, buckets: int = BUCKETS):
        """``keys[name]`` is the table's key, or None for an append-only table; ``layout[name]`` the column its base is laid out by."""
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys
        self.layout, self.buckets = layout or {}, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._staged: set[tuple[str, int]] = set()

    def _names(self, kind: str) -> list[str]:
        """What follows ``kind=`` in the names of commit files: a version, for batches then the writer's number and the writer."""
        log = self._path(f"{self.root}/_commits")
        if not self._fs.exists(log):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(log)]
        return [n.split("=", 1)[1] for n in names if n.startswith(f"{kind}=")]

    def _marks(self, kind: str) -> list[int]:
        return sorted(int(n.split("_")[0]) for n in self._names(kind))

    def _mark(self, name: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        self._fs.create(self._path(f"{self.root}/_commits/{name}"), True).close()

    def _next_version(self) -> int:
        return max(self._marks("base") + self._marks("batch")) + 1

    def base_batch(self) -> int:
        """The last version the newest base contains."""
        return max(self._marks("base"))

    def pending_batches(self) -> list[int]:
        """Committed versions newer than the base."""
        return [b for b in self._marks("batch") if b > self.base_batch()]

    def is_committed(self, batch: int, writer: str = "") -> bool:
        return any(n.split("_", 1)[1] == f"{batch}_{writer}" for n in self._names("batch"))

    def create(self, tables: dict[str, DataFrame]) -> None:
        """The first base; tables that are not given are empty."""
        absent = {n: self.spark.createDataFrame([], schema) for n, schema in self.schemas.items() if n not in tables}
        self._write("base", BEFORE_ANY_BATCH, tables | absent)
        self._mark(f"base={BEFORE_ANY_BATCH}")

    def commit(self, batch: int, changes: dict[str, DataFrame], writer: str = "") -> bool:
        """Store changed and staged rows per table as one version; False when the writer's batch is committed already."""
        if self.is_committed(batch, writer):
            return False
        version = self._next_version()
        for name in self.schemas:
            if name not in changes and (name, version) not in self._staged:
                # What a batch that died half-way may have left under this version.
                self._fs.delete(self._path(f"{self.root}/{name}/batch={version}"), True)
        self._write("batch", version, changes)
        self._mark(f"batch={version}_{batch}_{writer}")
        self._staged.clear()
        return True

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Write one table's changes ahead of the commit and read them back, which cuts their lineage."""
        version = self._next_version()
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={version}")
        self._staged.add((name, version))
        return self._load(name, [f"batch={version}"])

    def compact(self, least: int = 1) -> None:
        """Fold all committed changes, if ``least`` versions or more, into a new base. Older folders stay for readers that still use them."""
        pending = self.pending_batches()
        if len(pending) >= least:
            self._write("base", max(pending), {name: self.read(name) for name in self.schemas})
            self._mark(f"base={max(pending)}")

    def lookup(self, name: str, wanted: DataFrame) -> DataFrame:
        """Current rows that may have a value of the only column of ``wanted`` in the column the table is laid out by.

        The folders to read are told by at most ``buckets`` numbers; tables without that layout are read whole.
        """
        if self.layout.get(name) != wanted.columns[0]:
            return self.read(name)
        numbers = wanted.select(self._bucket(name).alias(BUCKET)).distinct().collect()
        return self.read(name, sorted(row[0] for row in numbers))

    def _bucket(self, name: str) -> Column:
        column = self.layout[name]
        kind = StructType.fromDDL(self.schemas[name])[column].dataType
        return F.pmod(F.xxhash64(F.col(column).cast(kind)), F.lit(self.buckets)).cast("int")

    def _base(self, name: str, buckets: list[int] | None) -> DataFrame:
        folder = f"{self.root}/{name}/base={self.base_batch()}"
        if name not in self.layout:
            return self.spark.read.schema(self.schemas[name]).parquet(folder)
        rows = self.spark.read.schema(f"{self.schemas[name]}, {BUCKET} int").parquet(folder)
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Current rows of a table: per key the image of the newest batch. With ``buckets`` only these folders of the base are read."""
        current = self._base(name, buckets)
        folders = [f"batch={b}" for b in self.pending_batches() if self._fs.exists(self._path(f"{self.root}/{name}/batch={b}"))]
        if not folders:
            return current
        changed = self._load(name, folders)
        key = self.keys[name]
        if key is None:
            return current.unionByName(changed)
        batch = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/batch=", -1), "/", 1).cast("long")
        # A batch holds a key once, so images meet first after the shuffle; they are sorted there once.
        newer = Window.partitionBy(*key).orderBy(F.col("_batch").desc())
        images = changed.withColumn("_batch", batch).withColumn("_newer", F.lag("_batch").over(newer))
        newest = images.where("_newer IS NULL").drop("_batch", "_newer")
        return current.join(changed.select(*key).distinct(), key, "left_anti").unionByName(newest)

    def _write(self, kind: str, number: int, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            location = f"{self.root}/{name}/{kind}={number}"
            if kind == "base" and name in self.layout:
                # Rebalanced, so that a folder with many rows is split over tasks.
                rows.withColumn(BUCKET, self._bucket(name)).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(location)
            else:
                rows.write.mode("overwrite").parquet(location)

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.root}/{name}/{f}" for f in folders])
