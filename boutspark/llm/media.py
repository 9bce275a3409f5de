"""Documents as media files in archives, and a data source that reads archives back.

Writing: every text's bytes, padded with zeros to a positive multiple of 64, become the
samples of a mono 8-bit PCM wave file; the wave files are deflated members of zip
archives of about `ARCHIVE_BYTES`, written by the tasks straight into the shared folder
under a name of their own and renamed when complete, so a repeated task leaves the same.

Reading: `ArchiveSource` lists the folder, plans byte ranges over the archives, and a
task reads an archive's directory and the members whose headers start in its range. It
streams Arrow batches of bounded size and retries each member by itself, from its
offset, over a fresh handle; a member that stays unreadable becomes a row with `error`
set and no media, and the others are not held up.

Defined results: a null or empty text is 64 zero bytes; null ids stay null; repeated rows
give repeated members; an empty table gives an empty folder and no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from boutspark.llm.lean import lean
from boutspark.shipping import ship
from boutspark.staging import stage, staging_root

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
TRIES = 4
RATE = 8000
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def to_wave(payload: bytes) -> bytes:
    n = len(payload)
    return _HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def from_wave(media: bytes) -> bytes:
    """The samples; raises ValueError if the bytes are no such wave file."""
    if len(media) < _HEADER.size:
        raise ValueError("too short for a wave file")
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = _HEADER.unpack_from(media)
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data"):
        raise ValueError("not a mono 8-bit wave file")
    if len(media) != _HEADER.size + n:
        raise ValueError("wave file cut short")
    return media[_HEADER.size :]


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_archives(docs: DataFrame, folder: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Write every text as a member; returns the written (archive, members, bytes) table."""

    @lean
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = _filesystem(folder)
        count, out, zipped, members, size = 0, None, None, 0, 0
        made = []

        def close():
            nonlocal out, zipped, count
            zipped.close()
            out.close()
            final = f"{root}/part-{part:06d}-{count:04d}.zip"
            system.move(pending, final)
            made.append((final.rsplit("/", 1)[1], members, size))
            out, zipped, count = None, None, count + 1

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    pending = f"{root}/_{part:06d}-{count:04d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(pending)
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                    members = size = 0
                media = to_wave(payload_of(text))
                name = f"{members}_{'' if doc is None else doc}_{len((text or '').encode())}.wav"
                zipped.writestr(zipfile.ZipInfo(name), media, zipfile.ZIP_DEFLATED, 1)
                members, size = members + 1, size + len(media)
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] for m in made], pa.int64()),
                pa.array([m[2] for m in made], pa.int64()),
            ],
            ["archive", "members", "bytes"],
        )

    ship(docs.sparkSession)
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    return stage(rows.mapInArrow(run, "archive string, members bigint, bytes bigint"), "archives")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def read_member(opened, info: zipfile.ZipInfo, again, tries: int = TRIES) -> bytes:
    """A member's bytes, checked against the directory's sum; `again` gives a fresh archive."""
    for left in range(tries - 1, -1, -1):
        try:
            with opened.open(info) as member:
                return member.read()
        except (OSError, EOFError, zipfile.BadZipFile, zlib.error):
            if not left:
                raise
            time.sleep(0.05 * (tries - left))
            opened = again()


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self):
        from pyarrow import fs

        system, root = _filesystem(self.folder)
        files = [
            f
            for f in system.get_file_info(fs.FileSelector(root))
            if f.type == fs.FileType.File and f.base_name.endswith(".zip") and not f.base_name.startswith("_")
        ]
        return [
            _Range(f.path, s, s + self.range_bytes)
            for f in sorted(files, key=lambda f: f.path)
            for s in range(0, max(f.size, 1), self.range_bytes)
        ] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _filesystem(self.folder)

        def again():
            return zipfile.ZipFile(system.open_input_file(partition.path))

        archive = again()
        rows: list[tuple] = []
        size = 0
        for info in archive.infolist():
            if not partition.start <= info.header_offset < partition.end:
                continue
            try:
                media, error = read_member(archive, info, again), None
            except (OSError, EOFError, zipfile.BadZipFile, zlib.error) as e:
                media, error = None, f"{type(e).__name__}: {e}"
            rows.append((partition.path.rsplit("/", 1)[1], info.filename, info.header_offset, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        names = ["archive", "member", "offset", "media", "error"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )


class ArchiveSource(DataSource):
    """`spark.read.format("zip_archives").load(folder)`: one row per member of every archive."""

    @classmethod
    def name(cls) -> str:
        return "zip_archives"

    def schema(self) -> str:
        return "archive string, member string, offset bigint, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("zip_archives").option("rangeBytes", range_bytes).load(folder)


def describe(payload: bytes) -> str:
    """Level, loudness, sign changes and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256) - 128.0
    n = len(x)
    mean = float(counts @ level) / n
    rms = float(np.sqrt((counts @ (level * level)) / n))
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    signs = x >= 128
    changes = int(np.count_nonzero(signs[1:] != signs[:-1]))
    return f"mean={mean:.4f} rms={rms:.4f} changes={changes} entropy={entropy:.4f} peak={int(x.max())}"


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of the members' payloads as read back; unreadable ones keep nulls."""

    @lean
    def run(batches):
        for batch in batches:
            out = []
            for name, blob, error in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, doc, n = name.removesuffix(".wav").split("_")
                row = [int(doc) if doc else None, int(n)]
                if blob is None:
                    out.append((*row, None, None, None, None, None, None, error))
                    continue
                payload = from_wave(blob)
                out.append(
                    (
                        *row,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-64:]),
                        len(blob),
                        hashlib.sha256(blob).hexdigest(),
                        describe(payload),
                        None,
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds
            ) if out else pa.RecordBatch.from_pylist([], schema=kinds)

    i64, text = pa.int64(), pa.string()
    kinds = pa.schema(
        [
            (id_col, i64),
            ("n_bytes", i64),
            ("payload_bytes", i64),
            ("payload_sha256", text),
            ("tail_crc32", i64),
            ("media_bytes", i64),
            ("media_sha256", text),
            ("feature", text),
            ("error", text),
        ]
    )
    return media.select("member", "media", "error").mapInArrow(
        run,
        f"`{id_col}` bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string, error string",
    )


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
