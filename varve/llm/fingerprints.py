"""MinHash fingerprints: universal hash permutations over 5-word shingles in numpy.

h_k(x) = (a_k * x + b_k) >> 32 on 64-bit shingle hashes (multiply-shift, a_k
odd); the minimum over the shingles is the k-th slot. A fingerprint shows 16
bits of each of 128 slots as hex; likeness is the share of equal slots. For
pairs, signatures go through the bands, hubs and exact verification of
near_dedup (`linked`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType, StructType

from varve.llm.common import ship, slices, with_text, written
from varve.llm.near_dedup import near_duplicates
from varve.llm.text import mix, shingles, word_hashes

SLOTS = 128
#: Input for a task.
TASK_BYTES = 64 << 20
#: Spark's estimate for what isn't read from files is beyond that.
UNKNOWN_BYTES = 1 << 52
_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


def permutations(slots: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed).integers(0, 2**64, (2, slots), dtype=np.uint64)
    return random[0] | _U(1), random[1]


def minhash(elements: np.ndarray, row: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots); `row` ascends. Empty sets keep the largest value."""
    out = np.full((rows, slots), _EMPTY, dtype=np.uint64)
    if len(elements):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        hashed, least = np.empty_like(elements), np.empty((slots, len(starts)), dtype=np.uint64)
        for k, (a, b) in enumerate(zip(*permutations(slots))):
            np.multiply(elements, a, out=hashed)
            np.add(hashed, b, out=hashed)
            # the minimum of the whole has the least upper half too
            np.minimum.reduceat(hashed, starts, out=least[k])
        out[row[starts]] = (least >> _U(32)).T
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """rows x SLOTS of 16 bits. Texts without words have the same one."""
    values, at = shingles(*word_hashes(texts))
    n = np.diff(at)
    return mix(minhash(values, np.repeat(np.arange(len(n)), n), len(n))).astype(">u2")


def linked(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Groups of similar documents by banded MinHash signatures, see near_duplicates."""
    return near_duplicates(docs, percent=percent, signer=minhash)


#: Digest and fingerprints as bytes; the result shows them as hex, twice as long.
_ROW = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(ids: pa.Array, texts: list[str], after: list[str], own: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
    """Results of texts, each with the text after it and both fingerprints."""
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after)]
    new = fingerprints(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
            pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in new], pa.binary()),
            pa.array((own == new).mean(axis=1)), pa.array((own == following).mean(axis=1)),
        ],
        names=["doc_id", *(c.split()[0] for c in _ROW.split(", "))],
    )


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, and likeness.

    The edited text has its last floor(n / 4) code points replaced by the
    first as many (or all) of the next document in ascending order of the id
    (after the last: the first). Rows that share an id follow each other by a
    hash of the text; null ids come first; a single row is its own next one.
    Null texts count as empty; texts without words have all slots empty and
    are alike. An empty table gives an empty result; ids that aren't numbers
    are an error.

    Spark deals rows out by ranges of (id, hash, place), so a frequent id is
    split too. A range gives the results of all its rows but the last one,
    and its first and last row with their texts; the written table of both
    is what the last rows find their next ones in. No number of ranges goes
    into a plan.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = with_text(docs, id_col, text_col)
    if not isinstance(texts.schema["doc_id"].dataType, NumericType):
        raise TypeError(f"{id_col}: ids have to be numbers, which are cut into ranges")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES) if size < UNKNOWN_BYTES else 1)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, {_ROW}, part int, edge string, text string")
    arrow = to_arrow_schema(schema)

    def padded(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in arrow], schema=arrow)

    def edge(row: pa.Table, name: str) -> pa.RecordBatch:
        return padded(pa.RecordBatch.from_arrays([row["doc_id"].combine_chunks(), row["part"].combine_chunks(), pa.array([name]), row["text"].combine_chunks()], names=["doc_id", "part", "edge", "text"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in slices(batches):
            here = pa.Table.from_batches([batch])
            if carried is None:
                yield edge(here.slice(0, 1), "first")
            else:
                here = pa.concat_tables([carried, here]).combine_chunks()
            n = here.num_rows - 1
            carried = here.slice(n)
            if n:
                text, own = here["text"].to_pylist(), fingerprints(here["text"].combine_chunks())
                yield padded(_compared(here["doc_id"].combine_chunks().slice(0, n), text[:n], text[1:], own[:n], own[1:]))
        if carried is not None:
            yield edge(carried, "last")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a pair at a time: texts may be long
                one = batch.slice(i, 1)
                text, after = one.column("text").to_pylist(), one.column("after").to_pylist()
                yield _compared(one.column("doc_id"), text, after, fingerprints(one.column("text")), fingerprints(one.column("after")))

    order = ["doc_id", "tie", "place"]
    ranged = texts.withColumn("tie", F.xxhash64("text")).withColumn("place", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(tasks, *order)
    dealt = ranged.sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    found = written(dealt.mapInArrow(rows, schema), "fingerprints")
    first, last = (found.where(F.col("edge") == e) for e in ("first", "last"))
    # ranges with rows, a number for each; the one after the last is the first
    parts = first.select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("_next"))
    met = last.select("part", "doc_id", "text").join(following, "part").join(first.select(F.col("part").alias("_next"), F.col("text").alias("after")), "_next")
    columns = ["doc_id", *(c.split()[0] for c in _ROW.split(", "))]
    both = found.where("edge IS NULL").select(*columns).unionByName(met.select("doc_id", "text", "after").mapInArrow(pairs, f"doc_id {kind}, {_ROW}"))
    return both.select(*(F.lower(F.hex(c)).alias(c) if dict(both.dtypes)[c] == "binary" else c for c in columns))
