"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("helixplan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a single-machine session (``local[...]``) may go without one; it then gets a temporary folder. On
    a cluster a missing setting is an error, because a machine-local folder would not survive a lost executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="helixplan-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor costs a re-read, not a re-run.

    ``keep`` writes a DataFrame and reads it back; ``drop`` deletes tables that a loop no longer needs and
    ``clear`` all that are left. A lazy result reads its tables when it is run, so its caller clears, or
    ``sweep`` does once the results of a session are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/helixplan/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def clear(self) -> None:
        """Deletes every table; for work whose result does not read them."""
        self.paths.clear()
        _delete(self.spark, self.base)

    def folder(self) -> str:
        """A new folder for files of any format; it goes with the tables."""
        self.count += 1
        return f"{self.base}/{self.count}"

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = self.paths.pop(id(table), None) if table is not None else None
            if path is not None:
                _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def file_stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a file or folder, as its file system tells them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(where)
    return size.getLength(), size.getFileCount(), files.getFileStatus(where).getModificationTime()


def sweep(spark: SparkSession) -> None:
    """Deletes all intermediate tables under the session's shared folder; call it when no result is still to be read."""
    _delete(spark, f"{shared_dir(spark)}/helixplan")
