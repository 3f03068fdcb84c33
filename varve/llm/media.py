"""Media columns of progressive JPEG: store bytes, read tensors and features back.

`stored` turns whole texts into media (one or more JPEG frames, one after the
other), `tensors` gives the full-resolution RGB of each frame, `described`
reads the stored bytes back and computes digests and features. Work is by row
in slices of about two megabytes; a longer text takes more frames, so memory
doesn't depend on the number of rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varve.llm import jpeg
from varve.llm.common import ship, slices, with_text

UNIT = 64
FRAME_BYTES = jpeg.FRAME_MCUS * jpeg.BLOCKS_PER_MCU * UNIT
SLICE_BYTES = 2 << 20
#: Brightness classes of the histogram in a feature.
CLASSES = 8


def payload(text: str) -> bytes:
    """UTF-8 with zeros up to a positive multiple of UNIT."""
    data = text.encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media of each row (null text: empty, one block of zeros)."""
    ship(docs.sparkSession)
    texts = with_text(docs, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            parts, owner = [], []
            for i, text in enumerate(texts):
                data = np.frombuffer(payload(text), np.uint8)
                for at in range(0, len(data), FRAME_BYTES):
                    parts.append(data[at : at + FRAME_BYTES])
                    owner.append(i)
            media = [b""] * len(texts)
            for i, frame in zip(owner, jpeg.encode(parts)):
                media[i] += frame
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(encode, f"doc_id {kind}, n_bytes long, media binary")


def _decoded(media: list[bytes]) -> tuple[jpeg.Decoder, np.ndarray]:
    """All frames of all media, and the row of each frame."""
    decoder = jpeg.Decoder(b"".join(media))
    ends = np.cumsum([len(m) for m in media])
    begins = np.array([f.scans[0].begin for f in decoder.frames])
    return decoder, np.searchsorted(ends, begins, "right")


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, frame, height, width, rgb (height x width x 3 bytes) of (doc_id, media)."""
    ship(media.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE_BYTES):
            decoder, row = _decoded(batch.column("media").to_pylist())
            frame = np.arange(len(row)) - np.searchsorted(row, row)
            images = [np.broadcast_to(x, (*x.shape[:2], 3)) for x in decoder.pixels()]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(frame, pa.int32()), *(pa.array([x.shape[k] for x in images], pa.int32()) for k in (0, 1)), pa.array([x.tobytes() for x in images], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "frame", "height", "width", "rgb"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(decode, f"doc_id {kind}, frame int, height int, width int, rgb binary")


def _features(images: list[np.ndarray], row: np.ndarray, rows: int) -> list[str]:
    """Size, mean colour (hundredths) and brightness histogram of each row's RGB."""
    flat = np.concatenate([x.reshape(-1, 3) for x in images])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    pixels = np.array([x.shape[0] * x.shape[1] for x in images])
    n = np.add.reduceat(pixels, first)
    starts = np.cumsum(n) - n
    sums = np.add.reduceat(flat, starts, axis=0, dtype=np.int64)
    brightness = flat.sum(axis=1, dtype=np.int16) // (768 // CLASSES)
    owner = np.repeat(np.arange(rows), n)
    classes = np.bincount(owner * CLASSES + brightness, minlength=rows * CLASSES).reshape(rows, CLASSES)
    height = np.add.reduceat([x.shape[0] for x in images], first)
    mean = sums * 100 // n[:, None]
    return [f"{images[f].shape[1]}x{h} rgb {r},{g},{b} light {'-'.join(map(str, c))}" for f, h, (r, g, b), c in zip(first, height, mean.tolist(), classes.tolist())]


def described(media: DataFrame) -> DataFrame:
    """Digests, features and RGB tensors of (doc_id, n_bytes, media), all from the stored bytes.

    rgb holds height x width x 3 bytes, the frames of a long text below each
    other. Repeated rows and null ids are read like others, each row for
    itself; an empty table gives an empty result. A row is decoded whole.
    """
    ship(media.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE_BYTES):
            media = batch.column("media").to_pylist()
            decoder, row = _decoded(media)
            data, images = [b""] * len(media), [np.broadcast_to(x, (*x.shape[:2], 3)) for x in decoder.pixels()]
            height, width, tensor = [0] * len(media), [0] * len(media), [b""] * len(media)
            for i, image in zip(row, images):
                height[i] += image.shape[0]
                width[i] = image.shape[1]
                tensor[i] += image.tobytes()
            for i, frame in zip(row, decoder.frames):
                blocks = decoder.blocks(frame)[: int.from_bytes(frame.note, "big") // UNIT]
                data[i] += (blocks + 128).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array([len(x) for x in data], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data]),
                    pa.array([zlib.crc32(x[-UNIT:]) for x in data], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(_features(images, row, len(media))),
                    pa.array(height, pa.int32()),
                    pa.array(width, pa.int32()),
                    pa.array(tensor, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"],
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary")
