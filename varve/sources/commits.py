"""A table as a log of commits: appends that are whole or not there, in an order that all writers agree on.

Data files go to a folder of their own first. A commit is a numbered file,
moved into place only if no other writer took the number; who loses reads the
log again and takes the next one. Each commit names its application and
transaction, so the same append again adds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.sources.files import list_files


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole unless it is there; false if it is. Of several writers one succeeds."""
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    files = name.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(name.getParent())
    if files.exists(name):
        return False
    part = jvm.org.apache.hadoop.fs.Path(name.getParent(), f".{uuid.uuid4().hex}.part")
    out = files.create(part)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), spark._jsc.hadoopConfiguration()) if name.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context.rename(part, name, spark.sparkContext._gateway.new_array(kinds, 0))
    except Exception as e:  # py4j wraps what the file system says
        files.delete(part, False)
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    return True


class Commits:
    """<path>/log/<number>.json and <path>/data/<folder>."""

    ENTRY = "version long, app string, txn long, folder string, rows long, covers long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        if not list_files(self.spark, f"{self.path}/log", "*.json"):
            return self.spark.createDataFrame([], self.ENTRY)
        return self.spark.read.schema(self.ENTRY).json(f"{self.path}/log/*.json")

    def append(self, df: DataFrame, app: str, txn: int, covers: int | None = None) -> bool:
        """Commit the rows of `df`; false where this or a later transaction of the application is there.

        A writer that dies leaves a folder that no commit names.
        """
        folder, rows = None, 0
        while True:
            log = self.log()
            seen = log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"), F.max(F.when(F.col("app") == app, F.col("txn"))).alias("txn")).first()
            if seen.txn is not None and seen.txn >= txn:
                return False
            if folder is None:
                folder = f"{app}-{txn}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/data/{folder}")
                rows = self.spark.read.parquet(f"{self.path}/data/{folder}").count()
            entry = {"version": seen.version + 1, "app": app, "txn": txn, "folder": folder, "rows": rows, "covers": covers}
            if put_if_absent(self.spark, f"{self.path}/log/{seen.version + 1:020d}.json", json.dumps(entry)):
                return True

    def live(self) -> DataFrame:
        """The last compaction and the commits that it doesn't cover, among them those made while it ran."""
        log = self.log()
        last = log.where("covers IS NOT NULL").agg(F.max(F.struct("version", "covers")).alias("c")).first().c
        if last is None:
            return log
        return log.where((F.col("version") == last.version) | (F.col("covers").isNull() & (F.col("version") > last.covers)))

    def read(self) -> DataFrame:
        """All rows committed so far; folders without a commit aren't read."""
        folders = [f"{self.path}/data/{r.folder}" for r in self.live().orderBy("version").collect()]
        if not folders:
            raise PySparkException(f"{self.path}: nothing was committed")
        return self.spark.read.option("mergeSchema", "true").parquet(*folders)

    def compact(self, txn: int) -> bool:
        """One commit with the rows of those so far, so a log of many small appends is read as few files."""
        covers = self.log().agg(F.max("version")).first()[0]
        return self.append(self.read(), "compaction", txn, covers)
