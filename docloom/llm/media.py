"""Media columns in archives: a Spark data source that writes and reads ZIP archives by byte range.

Writing: every task streams its members into archives of bounded size under names of its own; the driver commits
the list of the finished ones, so a repeated or failed task leaves nothing that a reader would see.

Reading: the driver only needs the archives' names and sizes (some 60 bytes an archive).  It cuts each archive into byte
ranges, at most MAX_RANGES in all, and a range's task reads the archive's directory from its end and streams the members
whose header begins in the range, in Arrow batches of bounded size.  Members that lie side by side are read in one request
of some `block_bytes`, and each is checked against the directory's checksum; one that fails, or whose block does, is fetched
by its own offset and retried alone.

Texts become 8-bit grey images, 64 samples a row, losslessly (PNG): see `encode` and `decode`.

Defined cases: null text is empty; an empty text is one row of zeros; repeated rows are members of their own; a null id
is written as such; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docloom.llm.common import shared_path

FORMAT = "docloom_archive"
SCHEMA = "member string, offset bigint, media binary"
MANIFEST = "_members.json"
WIDTH = 64
#: Partitions of a read, whatever the number of archives.
MAX_RANGES = 100_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(raw: bytes) -> bytes:
    """A grey PNG of `raw`, padded with zeros to a positive multiple of WIDTH; a text chunk keeps the length."""
    height = max(1, -(-len(raw) // WIDTH))
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # column 0: the filter of each row, none
    padded = np.zeros(height * WIDTH, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    rows[:, 1:] = padded.reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(length without padding, samples as a height x WIDTH array); raises ValueError on any damage."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, found = len(SIGNATURE), {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        found[kind] = found.get(kind, b"") + data
        at += 12 + n
    width, height = struct.unpack_from(">II", found[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return int(found[b"tEXt"].partition(b"\0")[2]), np.ascontiguousarray(rows[:, 1:])


def features(samples: np.ndarray) -> str:
    """Mean, deviation and an 8-bin histogram of the samples, and a 64-bit hash of column means above their mean."""
    histogram = np.bincount(samples.reshape(-1) >> 5, minlength=8)
    columns = samples.mean(axis=0)
    bits = np.packbits(columns > columns.mean()).tobytes().hex()
    return f"{samples.mean():.4f} {samples.std():.4f} {','.join(map(str, histogram.tolist()))} {bits}"


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


def _join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


class _Counted(io.RawIOBase):
    """A write-only stream that knows its place, over one that can't seek."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        raise io.UnsupportedOperation("tell")


class ArchiveWriter(DataSourceArrowWriter):
    """Input columns: member string, media binary."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.folder, self.roll_bytes = folder, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = _open(self.folder)
        where.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out = archive = raw = None
        name = ""

        def finish() -> None:
            archive.close()
            raw.close()
            files.append((name, out.at))

        for batch in iterator:
            for member, media in zip(batch.column("member"), batch.column("media"), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    raw = where.open_output_stream(_join(root, name))
                    out = _Counted(raw)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                # a fixed date: equal members give equal archives
                archive.writestr(zipfile.ZipInfo(member.as_py(), (1980, 1, 1, 0, 0, 0)), media.as_py())
                if out.at >= self.roll_bytes:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _open(self.folder)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(_join(root, MANIFEST)) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _open(self.folder)
        for name, _ in (x for m in messages if m for x in m.files):
            where.delete_file(_join(root, name))


class ByteRange(InputPartition):
    def __init__(self, name: str, size: int, start: int, end: int) -> None:
        self.name, self.size, self.start, self.end = name, size, start, end


class Ranges(InputPartition):
    """Neighbouring ranges that one task reads: more than one where archives are small."""

    def __init__(self, parts: list[ByteRange]) -> None:
        self.parts = parts


class _Window(io.RawIOBase):
    """The last bytes of an archive as a seekable file of the archive's length."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at = file, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        data = self.file.read_at(n, self.at) if n > 0 else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, batch_bytes: int, attempts: int, block_bytes: int = 4 << 20) -> None:
        self.folder, self.range_bytes, self.batch_bytes, self.block_bytes, self.attempts = folder, range_bytes, batch_bytes, block_bytes, attempts

    def partitions(self) -> list[InputPartition]:
        where, root = _open(self.folder)
        manifest = where.get_file_info(_join(root, MANIFEST))
        if manifest.type == pafs.FileType.File:
            with where.open_input_stream(manifest.path) as f:
                files = [tuple(x) for x in json.loads(f.read())]
        else:
            found = where.get_file_info(pafs.FileSelector(root))
            files = sorted((x.base_name, x.size) for x in found if x.base_name.endswith(".zip"))
        cut, done = max(self.range_bytes, -(-sum(size for _, size in files) // MAX_RANGES)), 0
        groups: dict[int, list[ByteRange]] = {}
        for name, size in files:
            for a in range(0, size, cut):
                end = min(size, a + cut)
                # by the place of a range's middle among the bytes of all archives, so that there are at most MAX_RANGES groups
                groups.setdefault((2 * done + end - a) // (2 * cut), []).append(ByteRange(name, size, a, end))
                done += end - a
        return [Ranges(parts) for parts in groups.values()] or [Ranges([])]

    @staticmethod
    def _member(data: bytes, info: zipfile.ZipInfo) -> bytes:
        """The media of a member, given its bytes from its header on; checked against the directory."""
        if data[:4] != b"PK\3\4":
            raise ValueError("no member header")
        skip = 30 + sum(struct.unpack_from("<HH", data, 26))
        media = data[skip : skip + info.compress_size]
        media = media if info.compress_type == zipfile.ZIP_STORED else zlib.decompress(media, -15)
        if len(media) != info.file_size or zlib.crc32(media) != info.CRC:
            raise ValueError("member doesn't match its checksum")
        return media

    def _blocks(self, where: pafs.FileSystem, path: str, own: list[tuple[zipfile.ZipInfo, int]]) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
        """The members (given with their ends, in order) with their media, read block by block."""
        first = 0
        while first < len(own):
            last = first + 1
            start = own[first][0].header_offset
            while last < len(own) and own[last][1] - start <= self.block_bytes:
                last += 1
            try:
                with where.open_input_file(path) as f:
                    block = memoryview(f.read_at(own[last - 1][1] - start, start))
            except OSError:
                block = memoryview(b"")
            for info, end in own[first:last]:
                try:
                    media = self._member(bytes(block[info.header_offset - start : end - start]), info)
                except (ValueError, struct.error, zlib.error):
                    media = self._fetch(where, path, info, end)
                yield info, media
            first = last

    def _fetch(self, where: pafs.FileSystem, path: str, info: zipfile.ZipInfo, end: int) -> bytes:
        """One member by its offset, opened anew for each attempt."""
        for attempt in range(self.attempts):
            try:
                with where.open_input_file(path) as f:
                    return self._member(f.read_at(end - info.header_offset, info.header_offset), info)
            except (OSError, ValueError, struct.error, zlib.error) as e:
                if attempt + 1 == self.attempts:
                    raise ValueError(f"{path} at {info.header_offset}: {e}") from e
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    def _members(self, part: ByteRange) -> Iterator[tuple[zipfile.ZipInfo, bytes]]:
        where, root = _open(self.folder)
        path = _join(root, part.name)
        with where.open_input_file(path) as f, zipfile.ZipFile(io.BufferedReader(_Window(f, part.size), 1 << 16)) as z:
            every = sorted(z.infolist(), key=lambda i: i.header_offset)
            ends = [*(i.header_offset for i in every[1:]), z.start_dir][: len(every)]
        yield from self._blocks(where, path, [(i, end) for i, end in zip(every, ends, strict=True) if part.start <= i.header_offset < part.end])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, bytes]] = []
        room = self.batch_bytes
        for part in partition.parts:
            for info, media in self._members(part):
                held.append((info.filename, info.header_offset, media))
                room -= info.file_size
                if room <= 0:
                    yield self._batch(held)
                    held, room = [], self.batch_bytes
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        member, offset, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(member, pa.string()), pa.array(offset, pa.int64()), pa.array(media, pa.binary())], names=["member", "offset", "media"])


class ArchiveSource(DataSource):
    """Options: path; range_bytes, batch_bytes and block_bytes (reading), attempts a member, roll_bytes (writing)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _number(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self._number("range_bytes", 16 << 20), self._number("batch_bytes", 8 << 20), self._number("attempts", 4), self._number("block_bytes", 4 << 20))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], self._number("roll_bytes", 64 << 20))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            media = [encode((t or "").encode()) for t in part.column(1).to_pylist()]
            members = ["null.png" if i is None else f"{i}.png" for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.string()), pa.array(media, pa.binary())], names=["member", "media"])


READ_BACK = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ_BACK.split(", ")]
    for batch in batches:
        rows = []
        for member, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = media.as_py()
            n, samples = decode(media)
            payload = samples.tobytes()
            doc = member.removesuffix(".png")
            rows.append((None if doc == "null" else int(doc), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def store_texts(docs: DataFrame, folder: str, text: str = "text") -> None:
    """Writes every text as an image member named by its doc_id."""
    register(docs.sparkSession)
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(_encoded, "member string, media binary")
    rows.write.format(FORMAT).mode("append").save(folder)


def read_media(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """member, offset, media of all members."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(folder)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores the texts, reads them back and measures what was read."""
    folder = shared_path(docs.sparkSession, "media")
    store_texts(docs, folder, text)
    return read_media(docs.sparkSession, folder).select("member", "media").mapInArrow(_read_back, READ_BACK)
