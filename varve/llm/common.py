"""What the operators of this subpackage share: folders, written tables, names."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.session import shared_dir
from varve.session import ship as send_package

#: Words are runs of bytes outside these (space and 9 to 13), in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch, instead of Spark's defaults: texts are long.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors and bound what a Python worker is handed at once.

    A session that already asks for smaller batches keeps them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    send_package(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI below the shared one; nothing else writes there."""
    return f"{shared_dir(spark)}/varve-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    Unlike a local checkpoint the files outlive the executors that wrote them.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted(uri: str) -> str:
    """The POSIX path of a shared folder that workers open or map themselves."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: workers map these files, so spark.checkpoint.dir has to be a mounted folder (file:)")
    return parts.path


def publish(path: str, data: bytes) -> None:
    """Write a file whole or not at all; a repeated task leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as out:
        out.write(data)
    os.replace(part, path)


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names.

    Further columns, whatever their names, can't clash with what is added.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def below(cuts: Column, value: Column, count: int) -> Column:
    """How many of `count` sorted cuts are less than the value, by bisection; count is 2 ** k - 1."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(count.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.element_at(cuts, at + step) < value, step).otherwise(0))


def give_back() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks, and an executor counts all of theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about `most` bytes of text.

    A text longer than that comes alone and whole. After the last one, what the
    worker has freed is given back.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(n):
            if i > start and total + sizes[i] > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += sizes[i]
        yield batch.slice(start, n - start)
    give_back()
