"""A tier by hour whose keys may change their hour: merge on read.

Rows are appended under the run that landed them. An index, cut into buckets
of the key, tells where the newest row of each key is; where a run replaces
it, a delete (key, hour, run) is written. Readers leave out rows that a later
run deleted, which is an anti join with the deletes alone; compaction
rewrites the hours that have any and drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varve.operators.tiers import HOUR, _read, in_hours, latest, write_hours
from varve.session import written


class KeyedTier:
    """<path>/rows/_run=N/<hour>=H, <path>/index/_bucket=B, <path>/deletes/_run=N."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], schema: StructType, hour: str = HOUR, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.order, self.schema, self.hour, self.buckets = spark, path.rstrip("/"), keys, order, schema, hour, buckets
        self._key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in keys)
        self._order = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in order)

    def _all(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/rows", StructType(list(self.schema)).add("_run", "long"))

    def deletes(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/deletes", f"{self._key}, `{self.hour}` long, _run long")

    def _index(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/index", f"{self._key}, {self._order}, _at long, _since long, _bucket int")

    def stored(self) -> int:
        return self._all().count()

    def land(self, changes: DataFrame, run: int) -> None:
        """The last row of each key by `order` that isn't older than the one there; runs ascend, the same run again changes nothing.

        Only the buckets of the index that hold changed keys are read and
        rewritten. What was there before is written last, so a run that broke
        off is repeated by landing it again.
        """
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = written(latest(changes.select(*self.schema.names), self.keys, self.order).withColumn("_bucket", bucket), "changes")
        index = written(in_hours(self._index(), new, "_bucket"), "index")
        there = index.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), F.struct(*self.order).alias("_old"), "_at", "_since")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        met = written(new.join(there, same, "left").where(F.col("_old").isNull() | (F.struct(*self.order) >= F.col("_old"))), "met")
        once = lambda df, kind, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run", *by).parquet(f"{self.path}/{kind}")
        replaced = met.where(F.col("_since") < run).select(*self.keys, F.col("_at").alias(self.hour), F.lit(run).cast("long").alias("_run"))
        once(met.select(*self.schema.names).withColumn("_run", F.lit(run).cast("long")).hint("rebalance", self.hour), "rows", self.hour)
        once(replaced, "deletes")
        fresh = met.select(*self.keys, *self.order, F.col(self.hour).cast("long").alias("_at"), F.lit(run).cast("long").alias("_since"), "_bucket")
        kept = index.join(fresh.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))), same, "left_anti")
        write_hours(kept.select(*fresh.columns).unionByName(fresh), f"{self.path}/index", self.keys, "_bucket")

    def rows(self, hours: DataFrame | None = None) -> DataFrame:
        """One row for each key; of `hours` only those folders and their deletes are read."""
        rows, gone = self._all(), self.deletes()
        if hours is not None:
            rows, gone = in_hours(rows, hours, self.hour), gone.join(hours.select(self.hour).distinct(), self.hour, "left_semi")
        gone = gone.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)), F.col(self.hour).alias("_at"), F.col("_run").alias("_by"))
        dead = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)] + [F.col(self.hour).eqNullSafe(F.col("_at")), F.col("_run") < F.col("_by")]
        return rows.join(gone, dead, "left_anti").select(*self.schema.names)

    def compact(self) -> None:
        """Rewrite hours that hold deleted rows as those of run 0 and drop the deletes; the index stays right, as run 0 is before every run."""
        spark, hours = self.spark, written(self.deletes().select(self.hour).distinct(), "deleted")
        live = written(self.rows(hours).withColumn("_run", F.lit(0).cast("long")), "live")
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        runs = [r[0] for r in in_hours(self._all(), hours, self.hour).select("_run").distinct().collect()]
        live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run", self.hour).parquet(f"{self.path}/rows")
        for run in runs:
            for row in hours.toLocalIterator():
                if run != 0:
                    files.delete(path(f"{self.path}/rows/_run={run}/{self.hour}={row[0]}"), True)
        files.delete(path(f"{self.path}/deletes"), True)
