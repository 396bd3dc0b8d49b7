"""Operator 1: media columns of baseline JPEG images.

`thumbnails` reads any JPEG column and stores dimensions and thumbnail hashes. `to_media` keeps
bytes in a JPEG column without loss: 64 bytes are one 8 x 8 block, each byte, as a signed number,
one quantised coefficient under a quantiser of ones; `from_media` reads them back. The image's
comment says how many bytes it holds.

Null media: status "null" and null columns. Damaged or non-baseline images: their status, no
hash. A null or empty text is 64 zero bytes. Equal bytes give equal images. A long text is coded
and decoded in slices: beside its bytes and coefficients it takes constant memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larchgraph.llm import jpeg
from larchgraph.llm.token_counts import by_bytes

UNIT = 64
#: Bytes of payload worked on at once.
CHUNK = 750_000


def padded(body: bytes) -> bytes:
    """body with zero bytes up to a positive multiple of 64."""
    return body + bytes(-len(body) % UNIT or (0 if body else UNIT))


def to_media(payloads: list[bytes]) -> list[bytes]:
    blocks = [np.frombuffer(p, np.int8).reshape(-1, UNIT) for p in payloads]
    return jpeg.encode(blocks, [b"bytes=%d" % len(p) for p in payloads])


def from_media(media: list[bytes]) -> list[tuple[jpeg.Image, np.ndarray, bytes]]:
    out = []
    for im, thumb, coef in jpeg.decode(media, whole=True):
        if coef is None:
            raise ValueError(f"stored media cannot be read back: {im.status}")
        out.append((im, thumb, coef.astype(np.int8).tobytes()[: int(im.comment.removeprefix(b"bytes="))]))
    return out


def feature(im: jpeg.Image, thumb: np.ndarray) -> str:
    return f"{im.width}x{im.height}:{jpeg.thumbnail_hash(thumb)}"


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every text as a stored image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", CHUNK):
                bodies = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = to_media([padded(b) for b in bodies])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(b) for b in bodies], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def read_back(df: DataFrame) -> DataFrame:
    """Digests and features of text_media's column, from the bytes read back out of the images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "media", CHUNK):
                media = part.column("media").to_pylist()
                read = from_media(media)
                columns = (
                    pa.array([len(b) for _, _, b in read], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for _, _, b in read]),
                    pa.array([zlib.crc32(b[-UNIT:]) for _, _, b in read], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([feature(im, thumb) for im, thumb, _ in read]),
                )
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def thumbnails(df: DataFrame, key: str, media: str) -> DataFrame:
    """key, status, width, height, thumb_width, thumb_height, thumb_hash and the DC-only luminance
    thumbnail (bytes, row by row) of a column of JPEG images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "media", CHUNK):
                read = jpeg.decode(part.column("media").to_pylist())
                ok = [t is not None for _, t, _ in read]
                pick = lambda f, kind: pa.array([f(im, t) if good else None for (im, t, _), good in zip(read, ok, strict=True)], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"), pa.array([im.status for im, _, _ in read]), pick(lambda im, t: im.width, pa.int32()), pick(lambda im, t: im.height, pa.int32()),
                        pick(lambda im, t: t.shape[1], pa.int32()), pick(lambda im, t: t.shape[0], pa.int32()), pick(lambda im, t: jpeg.thumbnail_hash(t), pa.string()), pick(lambda im, t: t.tobytes(), pa.binary()),
                    ],
                    ["key", "status", "width", "height", "thumb_width", "thumb_height", "thumb_hash", "thumbnail"],
                )

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, status string, width int, height int, thumb_width int, thumb_height int, thumb_hash string, thumbnail binary"
    return df.selectExpr(f"`{key}` as key", f"`{media}` as media").mapInArrow(run, schema).withColumnRenamed("key", key)
