"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

A payload is stored losslessly as 8-bit samples of a grey PNG, WIDTH samples a line.  Every task of the writing job
appends each distinct medium it meets once to a tar shard of its own, under the medium's SHA-256 as the member's name,
in the folder that the cluster shares.  A shard's name holds the task's attempt, and only rows of attempts that Spark
committed name shards, so a task that is lost and run again can't damage what rows point to.  Where shards hold the same
medium, all rows take the first place of its digest; others can be swept.  Metadata columns come from range reads of the
PNG's header alone; features read the whole member.

Cases: a null payload counts as empty, and every payload is filled up to a positive multiple of WIDTH with byte 255;
equal payloads have equal values; repeated rows and null ids are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import documents_only, new_folder, stored
from .words import chunks

WIDTH = 576
LEVEL = 6
HEADER = 33  # signature and IHDR
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _block(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % WIDTH if payload else WIDTH)


def encode(samples: bytes) -> bytes:
    """A grey PNG of 8 bits a sample; the length is a positive multiple of WIDTH."""
    height = len(samples) // WIDTH
    lines = np.zeros((height, WIDTH + 1), np.uint8)  # each line's filter is 0, none
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _block(b"IHDR", header) + _block(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _block(b"IEND", b"")


def metadata(header: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER bytes."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR" or zlib.crc32(header[12:29]) != struct.unpack(">I", header[29:33])[0]:
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", header[16:25])


def decode(media: bytes) -> bytes:
    """The samples of a grey 8-bit PNG whose lines have no filter."""
    width, height, _ = metadata(media[:HEADER])
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    h = bytearray(512)
    h[0 : len(name)] = name.encode()
    h[100:108], h[108:116], h[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    h[124:136], h[136:148], h[148:156] = b"%011o\0" % size, b"%011o\0" % 0, b" " * 8
    h[156:157], h[257:265] = b"0", b"ustar\x0000"
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


def filesystem(uri: str):
    """Arrow's file system of a folder's URI, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _write(folder: str):
    def run(batches):
        files, path = filesystem(folder)
        task = TaskContext.get()
        shard = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tar"
        out, at, places = None, 0, {}
        try:
            for chunk in chunks(batches):
                rows = []
                for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
                    text = chunk.data[a:b].tobytes()
                    key = hashlib.sha256(text).digest()
                    if key not in places:
                        media = encode(padded(text))
                        digest = hashlib.sha256(media).hexdigest()
                        if out is None:
                            files.create_dir(path)
                            out = files.open_output_stream(f"{path}/{shard}")
                        out.write(tar_header(f"{digest}.png", len(media)))
                        out.write(media + bytes(-len(media) % 512))
                        places[key] = digest, at + 512, len(media)
                        at += 512 + len(media) + -len(media) % 512
                    rows.append((b - a, *places[key]))
                size, digest, offset, length = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [chunk.rows.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest), pa.array([shard] * len(size)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                    ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                )
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    return run


def store(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Rows (doc_id, n_bytes, digest, shard, offset, length) of docs' texts stored in tar shards, and their folder."""
    folder = folder or new_folder(docs.sparkSession, "media")
    docs = documents_only(docs)
    schema = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
    return stored(docs.mapInArrow(_write(folder), schema), "media-index"), folder


def feature(samples: np.ndarray) -> str:
    """Mean, spread and an 8 x 8 mean hash of the image, its lines and columns cut into nearly equal parts."""
    image = samples.reshape(-1, WIDTH).astype(np.int64)
    total = image.sum()
    rows = np.array_split(np.arange(len(image)), 8)
    blocks = [image[r[0] : r[-1] + 1, c : c + WIDTH // 8] for r in rows if len(r) for c in range(0, WIDTH, WIDTH // 8)]
    bits = "".join("1" if int(b.sum()) * image.size > int(total) * b.size else "0" for b in blocks).ljust(64, "0")
    spread = int((image * image).sum()) // image.size - (int(total) // image.size) ** 2
    return f"mean={int(total) // image.size};var={spread};hash={int(bits, 2):016x}"


def _read(folder: str, whole: bool):
    def run(batches):
        files, path = filesystem(folder)
        shard, file = None, None
        try:
            for batch in batches:
                rows = []
                for name, digest, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "digest", "offset", "length"))):
                    if name != shard:
                        if file is not None:
                            file.close()
                        shard, file = name, files.open_input_file(f"{path}/{name}")
                    width, height, bits = metadata(bytes(file.read_at(HEADER, offset)))
                    row = (digest, width, height, bits, width * height)
                    if whole:
                        media = bytes(file.read_at(length, offset))
                        samples = decode(media)
                        row += (hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(samples, np.uint8)))
                    rows.append(row)
                if rows:
                    names = ["digest", "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names[: len(rows[0])])
        finally:
            if file is not None:
                file.close()

    return run


def places(index: DataFrame) -> DataFrame:
    """One place of each digest: the first of its shards."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return stored(first.select("digest", "at.*"), "media-places").repartition("shard").sortWithinPartitions("shard", "offset")


def headers(index: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits and payload_bytes of each medium, from its header alone."""
    return places(index).mapInArrow(_read(folder, False), "digest string, width long, height long, bits long, payload_bytes long")


def features(index: DataFrame, folder: str) -> DataFrame:
    """What headers() gives, and digests, sizes and features of what is read back, for each medium."""
    schema = "digest string, width long, height long, bits long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return places(index).mapInArrow(_read(folder, True), schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """docs' payloads stored and read back: the index's columns with those of features()."""
    index, folder = store(docs)
    return index.join(stored(features(index, folder), "media-features"), "digest")
