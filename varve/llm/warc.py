"""WARC archives: written as one gzip stream, normalised to a member per record.

Crawlers often leave archives as one gzip stream, which can't be entered at a
record. `write_archives` makes such files from a table, `normalise` inflates
each stream once and writes every record as a gzip member of its own with a
sidecar index (offset, length, record), `read_back` enters the members by the
index. Files lie in the shared folder; a file appears whole or not at all and
under a name of its own, and the next step only knows the files that a task
which ended well has reported.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import mounted, publish, shared_folder, ship, written

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Bytes of records after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html and payload_digest, record_type, refers_to.

    Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id is
    the response, the others revisit it. A null html is an empty payload; a
    null page_id can't be referred to: its row is a revisit if another has
    the payload, else a response. Rows that repeat the smallest page_id are
    all responses. An empty table gives an empty result. A record is held
    whole in memory by the task that writes or reads it.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).alias("n"))
    long = keyed.where(F.col("n") >= LEAST_REVISIT).select("page_id", "payload_digest")
    copies = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    # a table of its own, so that Spark can split what a frequent payload is joined with
    copies = written(copies.where("rows > 1 AND first IS NOT NULL").drop("rows"), "copies")
    found = long.join(copies, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = found.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "first").distinct()
    # pages are dealt by their id, not by their payload
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest"))
    revisit = F.col("first").isNotNull()
    return keyed.join(revisits, same, "left").select(
        "page_id", "url", "html", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"),
    )


def _urn(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page {page_id}')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: object) -> bytes:
    """One WARC 1.1 record. A revisit has the HTTP header without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",  # the table has no dates
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    if record_type == "revisit":
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(refers_to), "WARC-Refers-To-Page-ID": str(refers_to)}
    else:
        block += payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header, block, whole record) of each record of an inflated stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        raw, head = [line], {}
        while (line := stream.readline()).strip():
            raw.append(line)
            name, _, value = line.decode().partition(":")
            head[name.strip()] = value.strip()
        raw.append(line)
        block = stream.read(int(head["Content-Length"]))
        if len(block) < int(head["Content-Length"]):
            raise ValueError("the stream ends within a record")
        yield head, block, b"".join([*raw, block, b"\r\n\r\n"])


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(path) of monolithic archives with a record for each row of roles()."""
    place = mounted(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, out, zipper, size = [], None, None, 0

        def close() -> None:
            nonlocal out, size
            if out is not None:
                path = f"{place}/raw/{uuid.uuid4().hex}.warc.gz"
                publish(path, out.getvalue() + zipper.flush())
                paths.append(path)
            out, size = None, 0

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    out, zipper = io.BytesIO(), zlib.compressobj(6, zlib.DEFLATED, 31)
                page = None if pd.isna(row.page_id) else int(row.page_id)
                data = record(page, row.url, row.html.encode(), row.payload_digest, row.record_type, None if pd.isna(row.refers_to) else int(row.refers_to))
                out.write(zipper.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pd.DataFrame({"path": paths}, dtype=object)

    return rows.mapInPandas(write, "path string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index, records): each stream inflated once, a member per record."""
    place = mounted(folder)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for source in batch["path"]:
                path = f"{place}/records/{uuid.uuid4().hex}.warc.gz"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                index, at = [], 0
                with gzip.open(source) as stream, open(f"{path}.part", "wb") as out:
                    for head, _, whole in records(stream):
                        member = gzip.compress(whole, 6, mtime=0)
                        out.write(member)
                        index.append(json.dumps({"offset": at, "length": len(member), "id": head["WARC-Record-ID"], "type": head["WARC-Type"], "digest": head["WARC-Payload-Digest"]}))
                        at += len(member)
                os.replace(f"{path}.part", path)
                publish(f"{path}.idx", "\n".join(index).encode())
                made.append((path, f"{path}.idx", len(index)))
            yield pd.DataFrame(made, columns=["path", "index", "records"])

    return archives.mapInPandas(rewrite, "path string, index string, records long")


def read_back(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records.

    The payload of a response is hashed anew; a revisit has its digest in the
    record and its length in the HTTP header.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, index in zip(batch["path"], batch["index"]):
                rows = []
                with open(index) as lines, open(path, "rb") as file:
                    for entry in map(json.loads, lines):
                        file.seek(entry["offset"])
                        head, block, _ = next(records(io.BytesIO(gzip.decompress(file.read(entry["length"])))))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = head["WARC-Type"] == "response"
                        size = len(payload) if response else int(http.rpartition(b"Content-Length:")[2])
                        digest = hashlib.sha256(payload).hexdigest() if response else head["WARC-Payload-Digest"].removeprefix("sha256:")
                        rows.append((head["WARC-Page-ID"] or None, size, digest, head["WARC-Type"], head.get("WARC-Refers-To-Page-ID")))
                yield pd.DataFrame(rows, columns=["page", "payload_bytes", "payload_digest", "record_type", "refers"])

    rows = archives.mapInPandas(read, "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    return rows.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast("long").alias("refers_to"))


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write, normalise and read back the whole table; empty tables give no rows."""
    ship(spark)
    folder = shared_folder(spark, "warc")
    raw = written(write_archives(roles(pages), folder), "raw")
    tasks = max(1, min(raw.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    made = written(normalise(raw.repartition(tasks), folder), "records")
    return read_back(made.repartition(tasks))


#: DuckDB SQL for the result.
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE n >= {LEAST_REVISIT} GROUP BY payload_digest
)
SELECT p.page_id, p.n AS payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.n >= {LEAST_REVISIT}
"""
