"""Media columns: payloads kept as images in archives, read through a Spark data source of byte ranges.

``write_media`` stores each payload, filled up with blanks to whole rows of ROW bytes, as an 8-bit grey PNG
(lossless) that is a member of a ZIP archive in a folder that driver and executors share.
A manifest, written when all tasks are done, names the archives that count: what a lost attempt has left behind is never read.
``archive_members`` is a data source over such a folder: it plans byte ranges of the archives from the manifest's
sizes, and each task takes from its archive's directory the members that start in its range.  Members are
read one by one at their offsets and checked against the directory's CRC-32; one that fails is tried again on a newly
opened file, without the others, and the rest stream on in Arrow batches of bounded size.

Nulls, ties and odd rows: a null text counts as empty, and an empty payload is one row of blanks; a null id stays
null; rows of one id are members of their own; equal texts give equal bytes.  An empty table writes no archive and
gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spreadlab.llm._session import ROOT, shared_dir, shipped
from spreadlab.llm.token_store import _partition_id, filesystem

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The table of a folder's archives.
MANIFEST = "manifest"
#: Bytes after which a new archive is begun, and of one range.
ARCHIVE, RANGE = 64 << 20, 16 << 20
#: Ranges that the driver plans at most, about; beyond that they become longer.
RANGES = 100_000
#: Bytes of payload in one Arrow batch.
BATCH = 4 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """The bytes, filled up with blanks to a positive multiple of ROW, as grey samples; their own number goes along."""
    full = data + b" " * (-len(data) % ROW or (0 if data else ROW))
    rows = np.frombuffer(full, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    packed = zlib.compress(raw, 1)
    parts = [_chunk(b"IDAT", packed[i : i + (1 << 30)]) for i in range(0, len(packed), 1 << 30)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)), _chunk(b"tEXt", b"Bytes\0%d" % len(data)), *parts, _chunk(b"IEND", b"")])


def from_png(image: bytes) -> tuple[bytes, int]:
    """(samples, number of bytes that were stored) of an image that to_png made."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, packed, width, n = len(SIGNATURE), [], 0, 0
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"PNG chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", data)[0]
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(b"Bytes\0"):
            n = int(data[6:])
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("PNG rows are filtered")
    return raw[:, 1:].tobytes(), n


# ---- writing --------------------------------------------------------------------------------


def write_archives(batches, folder: str):
    """One row for each archive of this partition; an archive appears under its name, which no other attempt uses, when it is whole."""
    files, root = filesystem(folder)
    part, number, at, archive, own = _partition_id(), 0, 0, None, uuid.uuid4().hex[:12]

    def finish():
        archive.close()
        stream.close()
        files.move(draft, f"{root}/{name}")
        return pa.record_batch({"name": pa.array([name]), "members": pa.array([at], pa.int64()), "size": pa.array([files.get_file_info(f"{root}/{name}").size], pa.int64())})

    for batch in batches:
        ids, text = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        for key, x in zip(ids.to_pylist(), text, strict=True):
            if archive is None:
                files.create_dir(root, recursive=True)
                name, at = f"media-{part:06d}-{number:04d}-{own}.zip", 0
                draft = f"{root}/.{name}"
                stream = files.open_output_stream(draft)
                archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
            member = zipfile.ZipInfo(f"{at:09d}_{'null' if key is None else key}.png")  # a fixed date: equal rows, equal bytes
            archive.writestr(member, to_png(x.as_buffer().to_pybytes() if x.is_valid else b""))
            at += 1
            if archive.start_dir >= ARCHIVE:
                yield finish()
                archive, number = None, number + 1
    if archive is not None:
        yield finish()


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Stores the texts of docs as archives in ``folder``; returns how many members there are."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows.mapInArrow(shipped(write_archives, folder=folder), "name string, members long, size long").write.parquet(f"{folder}/{MANIFEST}")
    return docs.sparkSession.read.parquet(f"{folder}/{MANIFEST}").agg(F.sum("members")).first()[0] or 0


# ---- reading --------------------------------------------------------------------------------


def plan(options: dict) -> list[tuple[str, int, int]]:
    """(archive, first byte, byte after the last): ranges of each archive by its size; no archive is opened on the driver."""
    from pyarrow import fs, parquet

    files, root = filesystem(options["path"])
    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.Directory:
        table = parquet.read_table(f"{root}/{MANIFEST}", columns=["name", "size"], filesystem=files)
        archives = sorted(zip(table["name"].to_pylist(), table["size"].to_pylist(), strict=True))
    else:  # archives of another origin
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        archives = sorted((f.base_name, f.size) for f in found if f.base_name.endswith(".zip") and not f.base_name.startswith("."))
    size = max(int(options.get("rangebytes", RANGE)), -(-sum(whole for _, whole in archives) // RANGES))
    return [(name, at, min(at + size, whole)) for name, whole in archives for at in range(0, whole, size)] or [("", 0, 0)]


def read_range(options: dict, name: str, start: int, end: int):
    """Batches of the members whose headers are in the range, each tried on its own."""
    if not name:
        return
    tries = int(options.get("tries", 4))
    files, root = filesystem(options["path"])
    path = f"{root}/{name}"
    file = None

    def tried(read):
        """read of the open archive; after an error of the store it is opened anew, ``tries`` times in all."""
        nonlocal file
        for left in reversed(range(tries)):
            try:
                file = file or files.open_input_file(path)
                return read(file)
            except (OSError, ValueError, zipfile.BadZipFile):
                file = None
                if not left:
                    raise
                time.sleep(0.1 * (tries - left))

    held, size = [], 0
    for m in tried(lambda f: [m for m in zipfile.ZipFile(f).infolist() if start <= m.header_offset < end]):
        data = tried(lambda f, m=m: member_at(f, m))
        held.append((name, m.header_offset, m.filename, data))
        size += len(data)
        if size >= BATCH:
            yield _members(held)
            held, size = [], 0
    if held:
        yield _members(held)


def member_at(file, member: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, read at its offset and checked."""
    file.seek(member.header_offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member starts here")
    skip = sum(struct.unpack_from("<HH", head, 26))
    file.seek(member.header_offset + 30 + skip)
    data = file.read(member.compress_size)
    if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
        raise ValueError(f"{member.filename} is damaged")
    return data


def _members(held) -> pa.RecordBatch:
    names, offsets, members, data = zip(*held, strict=True)
    return pa.record_batch({"archive": pa.array(names, pa.string()), "offset": pa.array(offsets, pa.int64()), "member": pa.array(members, pa.string()), "payload": pa.array(data, pa.binary())})


def archive_members() -> type[DataSource]:
    """The data source; its classes go to the workers by value, as ``shipped`` functions do."""
    own = ROOT

    def module():
        import importlib
        import sys

        if own not in sys.path:
            sys.path.append(own)
        return importlib.import_module("spreadlab.llm.media")

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [InputPartition(x) for x in module().plan(self.options)]

        def read(self, partition):
            yield from module().read_range(self.options, *partition.value)

    class ArchiveMembers(DataSource):
        """spark.read.format("archive_members").load(folder); options rangeBytes and tries."""

        @classmethod
        def name(cls):
            return "archive_members"

        def schema(self):
            return "archive string, offset long, member string, payload binary"

        def reader(self, schema):
            return Reader({k.lower(): v for k, v in self.options.items()})

    return ArchiveMembers


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(archive, offset, member, payload) of each member in ``folder``."""
    spark.dataSource.register(archive_members())
    return spark.read.format("archive_members").options(**options).load(folder)


def feature(samples: bytes) -> str:
    """Mean, deviation and a histogram of eight bins of the samples, from whole numbers."""
    n, x = len(samples), np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    level = np.arange(256)
    total, square = int(x @ level), int(x @ (level * level))
    return f"n={n};mean={total / n:.6f};dev={max(square / n - (total / n) ** 2, 0) ** 0.5:.6f};bins={','.join(map(str, x.reshape(8, 32).sum(axis=1).tolist()))}"


def describe(batches):
    """One row of values for each member."""
    for batch in batches:
        out = []
        for name, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            image = image.as_buffer().to_pybytes()
            samples, n = from_png(image)
            key = name.partition("_")[2].removesuffix(".png")
            out.append((None if key == "null" else int(key), n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
        columns = zip(*out, strict=True) if out else [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the texts of docs as media in the shared folder, reads them back and describes each."""
    folder = shared_dir(docs.sparkSession)
    write_media(docs, folder, id_col, text_col)
    rows = read_media(docs.sparkSession, folder).select("member", "payload")
    return rows.mapInArrow(shipped(describe), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
