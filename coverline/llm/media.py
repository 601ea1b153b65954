"""Operator 8: media columns, kept in archives and read by a Spark data source.

Every payload is stored as an 8-bit grey image, 64 samples wide, in the lossless PNG form. Images go into archive files,
one for each writing task: members end to end, then a directory of their offsets, then the directory's place. The data
source plans a partition for each byte range of each archive in a folder; a partition reads the directory, takes the
members that start in its range, and yields them in Arrow batches. A member that cannot be read or fails its checksum is
tried again alone, at its offset, before the task gives up.

Writers put archives under names of their own and only then list them, as rows that Spark commits; what a lost task left
behind is in no list and is never read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import scratch_path

WIDTH = 64
MAGIC = b"CLARCH01"
#: Of the directory: offset, length, crc32, whether there is an id, the id, bytes before padding.
ENTRY = "<QQIBqQ"
TAIL = "<QQ8s"
RANGE = 8 << 20
ARCHIVE = 128 << 20
RETRIES = 3
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (WIDTH if not data else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """8-bit grey samples, WIDTH to a line, as a PNG without line filters."""
    lines = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of such a PNG; anything else is an error."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:4] != (8, 0) or size[6]:
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("line filters are not supported")
    return lines[:, 1:].tobytes()


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _written(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, entries, names, counts = None, "", 0, [], [], []

        def close() -> None:
            directory = b"".join(struct.pack(ENTRY, *e) for e in entries)
            out.write(directory + struct.pack(TAIL, at, len(entries), MAGIC))
            out.close()
            names.append(name)
            counts.append(len(entries))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    name, at, entries = f"{uuid.uuid4().hex}.arc", 0, []
                    out = fs.open_output_stream(f"{root}/{name}")
                value = text.as_py()
                raw = value.encode() if value else b""
                image = to_png(padded(raw))
                out.write(image)
                entries.append((at, len(image), zlib.crc32(image), key is not None, key or 0, len(raw)))
                at += len(image)
                if at >= ARCHIVE:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "members"])

    return write


def write_archives(docs: DataFrame, folder: str) -> None:
    """Payloads of doc_id and text go to archives in ``folder``/data; ``folder``/list names the ones that count."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(_written(f"{folder}/data"), "archive string, members long").write.parquet(f"{folder}/list")


class Range(InputPartition):
    def __init__(self, archive: str, first: int, stop: int):
        self.archive, self.first, self.stop = archive, first, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range = options["path"], int(options.get("range", RANGE))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[Range]:
        """Byte ranges of the listed archives; file names and sizes are all that is read here."""
        import pyarrow.dataset as ds

        fs, root = _filesystem(self.folder)
        files = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{root}/list")) if x.path.endswith(".parquet")]
        names = ds.dataset(files, filesystem=fs, format="parquet").to_table(["archive"]).column(0).to_pylist() if files else []
        out = []
        for info in fs.get_file_info([f"{root}/data/{n}" for n in sorted(names)]):
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(info.path)
            out += [Range(info.path, a, min(a + self.range, info.size)) for a in range(0, max(info.size, 1), self.range)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        fs, _ = _filesystem(self.folder)
        with fs.open_input_file(partition.archive) as f:
            size = f.size()
            f.seek(size - struct.calcsize(TAIL))
            start, count, magic = struct.unpack(TAIL, f.read(struct.calcsize(TAIL)))
            if magic != MAGIC:
                raise ValueError(f"{partition.archive} is no archive")
            f.seek(start)
            table = np.frombuffer(f.read(count * struct.calcsize(ENTRY)), np.dtype([("offset", "<u8"), ("length", "<u8"), ("crc", "<u4"), ("known", "u1"), ("id", "<i8"), ("bytes", "<u8")]))
            mine = table[(table["offset"] >= partition.first) & (table["offset"] < partition.stop)]
            ids, sizes, images, held = [], [], [], 0
            for entry in mine:
                image = member(fs, f, partition.archive, int(entry["offset"]), int(entry["length"]), int(entry["crc"]), self.retries)
                ids.append(int(entry["id"]) if entry["known"] else None)
                sizes.append(int(entry["bytes"]))
                images.append(image)
                held += len(image)
                if held > 4 << 20 or len(ids) >= 2048:
                    yield _members(ids, sizes, images)
                    ids, sizes, images, held = [], [], [], 0
            yield _members(ids, sizes, images)


def _members(ids: list, sizes: list, images: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])


def member(fs: pafs.FileSystem, f: pa.NativeFile, path: str, offset: int, length: int, crc: int, retries: int) -> bytes:
    """One member by its offset; a failed read or checksum opens the archive anew, after a short wait."""
    for attempt in range(retries + 1):
        try:
            if attempt:
                time.sleep(0.05 * 2**attempt)
                with fs.open_input_file(path) as again:
                    again.seek(offset)
                    data = again.read(length)
            else:
                f.seek(offset)
                data = f.read(length)
            if len(data) == length and zlib.crc32(data) == crc:
                return data
            error: Exception = ValueError(f"{path}: member at {offset} is damaged")
        except OSError as e:
            error = e
    raise error


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: doc_id, n_bytes and the stored image of each member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(folder)


def features(media: Column) -> Column:
    """Of a stored image, decoded: payload_bytes, payload_sha256, tail_crc32 and a feature.

    The feature is the image's height, the mean and deviation of its samples in hundredths, the share of samples that are
    zero in thousandths, and 63 bits that say which of two neighbouring columns is brighter on the whole.
    """

    @F.arrow_udf("struct<payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, feature: string>")
    def decode(images: pa.Array) -> pa.Array:
        out: tuple[list, ...] = ([], [], [], [])
        for image in images:
            payload = from_png(image.as_py())
            x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
            columns = x.sum(axis=0, dtype=np.int64)
            total, square = int(columns.sum()), int((x.astype(np.int64) ** 2).sum())
            mean = 100 * total // x.size
            spread = math.isqrt(10000 * (square * x.size - total * total)) // x.size
            bits = int("".join("1" if b else "0" for b in columns[1:] > columns[:-1]), 2)
            out[0].append(len(payload))
            out[1].append(hashlib.sha256(payload).hexdigest())
            out[2].append(zlib.crc32(payload[-WIDTH:]))
            out[3].append(f"h={len(x)};mean={mean};dev={spread};zero={1000 * int((x == 0).sum()) // x.size};columns={bits:016x}")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return decode(media)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text is one line of zeros. Repeated rows
    are stored and returned as often. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "media")
    write_archives(docs, folder)
    found = read_archives(spark, folder).withColumn("x", features(F.col("media")))
    return found.select("doc_id", "n_bytes", "x.payload_bytes", "x.payload_sha256", "x.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "x.feature")
