"""Parquet tables: writing, looking datasets up in the files catalog, and named table sets."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> str:
    """Overwrite `path` with snappy Parquet; parent folders are created."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


# The file that names the version to read.
POINTER = "CURRENT"


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """What the pointer below `path` says, if there is one."""
    where, system = file_system(spark, f"{path}/{POINTER}")
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def switch_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Makes the pointer below `path` say `text`, in one rename."""
    draft, system = file_system(spark, f"{path}/.{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    mode = spark.sparkContext._gateway.new_array(options, 1)
    mode[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(draft, file_system(spark, f"{path}/{POINTER}")[0], mode)


def write_snapshot(table: DataFrame, key: str, path: str) -> str:
    """The whole table as JSON lines `{"key": …, "record": {…}}` in a version of its own below `path`.

    The pointer to the version is switched by a rename after all rows are written. A write that fails or is lost leaves the version
    before as it was; of older versions all but one are removed. One writer at a time.
    """
    spark = table.sparkSession
    rows = table.select(F.col(key).cast("string").alias("key"), F.struct(*table.columns).alias("record"))
    before, version = read_pointer(spark, path), f"version-{uuid.uuid4().hex}"
    rows.write.json(f"{path}/{version}")
    switch_pointer(spark, path, version)
    system = file_system(spark, path)[1]
    others = [e.getPath() for e in system.listStatus(file_system(spark, path)[0]) if e.getPath().getName().startswith("version-")]
    for old in others:
        if old.getName() not in (version, before):
            system.delete(old, True)
    return path


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the version that the pointer names now."""
    version = read_pointer(spark, path)
    if version is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.schema(schema).json(f"{path}/{version}")


def list_datasets(files: DataFrame, user: str | None = None, file_type: str | None = None) -> DataFrame:
    """(user_id, file_id, original_filename) of files with an artifact, in (user, file) order."""
    rows = files.where(F.col("artifact_path").isNotNull())
    if user is not None:
        rows = rows.where(F.col("user") == user)
    if file_type is not None:
        rows = rows.where(F.col("file_type") == file_type)
    listed = rows.select(F.col("user").alias("user_id"), "file_id", "original_filename")
    return listed.orderBy(F.coalesce("user_id", F.lit("")), "file_id")


def find_dataset(files: DataFrame, file_id: str, user: str | None = None) -> tuple[str, str | None]:
    """(artifact_path, owner) of a file id. An exact (user, id) hit wins; else the id must belong to one user only."""
    hits = files.where((F.col("file_id") == file_id) & F.col("artifact_path").isNotNull())
    exact: Column = F.lit(False) if user is None else F.coalesce(F.col("user") == user, F.lit(False))
    # Two rows are enough to tell none, one and several apart.
    rows = hits.select("artifact_path", "user", exact.alias("exact")).orderBy(F.desc("exact")).limit(2).collect()
    if not rows:
        raise FileNotFoundError(f"no dataset is stored for {file_id!r}")
    if len(rows) > 1 and not rows[0].exact:
        raise ValueError(f"{file_id!r} belongs to several users; say which")
    return rows[0].artifact_path, rows[0].user


def read_dataset(files: DataFrame, file_id: str, user: str | None = None) -> DataFrame:
    """The Parquet artifact of a file id."""
    path, _ = find_dataset(files, file_id, user)
    return files.sparkSession.read.parquet(path)


class TableSet(dict[str, DataFrame]):
    """Named tables of one database; `register` makes them visible to SQL."""

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, names: list[str] | None = None) -> TableSet:
        """Every `<name>.parquet` (file or folder) below `folder`, or just `names`."""
        if names is None:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
            entries = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
            found = [e.getPath().getName() for e in entries]
            names = [n[: -len(".parquet")] for n in found if n.endswith(".parquet")]
        return cls({n: spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in sorted(names)})

    def list_tables(self) -> list[str]:
        """User tables in name order; names starting with `sqlite_` are internal."""
        return sorted(n for n in self if not n.startswith("sqlite_"))

    def table(self, name: str) -> DataFrame:
        if name not in self:
            raise ValueError(f"Table '{name}' not found")
        return self[name]

    def register(self) -> TableSet:
        for name in self.list_tables():
            self[name].createOrReplaceTempView(name)
        return self
