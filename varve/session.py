"""Session helpers used by tests, the benchmark and the entry points."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", app: str = "varve", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Only on one machine (tests) a temporary folder may take its place; a
    cluster that names none is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(Path(tempfile.mkdtemp(prefix="spark-varve-")).as_uri())
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor takes nothing along."""
    path = f"{shared_dir(df.sparkSession)}/varve-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "varve_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((root / "varve").rglob("*.py")):
            archive.write(path, path.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
