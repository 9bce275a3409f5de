"""Single files opened inside tasks: first lines of device files, and writing them."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import ArrowInvalid, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutspark.params import REC
from boutspark.shipping import ship

BLOCK = 65_536
# a header starts with a letter, whatever signs (such as a byte order mark) come before
_HEADER = re.compile(r"^\W*[^\W\d_]")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in there."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def can_open(path: str) -> bool:
    """Is there a file system for paths of this kind? Nothing is opened."""
    try:
        file_system(path)
    except (ArrowInvalid, OSError, ImportError):
        return False
    return True


def header_of(path: str, block: int = BLOCK, first: bool = False) -> str | None:
    """The first line that starts with a letter; reads no block after it.

    With `first` a line before it that is not blank is an error.
    """
    system, place = file_system(path)
    before = False
    with system.open_input_file(place) as f:
        rest = b""
        while True:
            piece = f.read(block)
            *lines, rest = (rest + piece).split(b"\n")
            if not piece:
                lines, rest = [rest], b""
            for line in lines:
                text = line.decode("utf-8", "replace").strip()
                if _HEADER.match(text):
                    if first and before:
                        raise ValueError(f"lines before the header of {path}")
                    return text
                before |= bool(text)
            if not piece:
                return None


def with_headers(files: DataFrame) -> DataFrame:
    """`files` with the column `header`, null where a file has none.

    Each task opens its share of the files and reads their first blocks; the bytes
    behind them are read once, by the scan itself.
    """
    spark = files.sparkSession
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(header=[header_of(p, first=True) for p in batch["path"]])

    schema = files.withColumn("header", F.lit(None).cast("string")).schema
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(read, schema)


def write_device_files(
    ticks: DataFrame, root: str, ticks_per_file: int = 65_536, first_part: int = 1, form: str = "DFM{dfm}_{part}.csv"
) -> int:
    """Ticks as the device files that `read_ticks` reads; returns the number of files.

    Files are cut every `ticks_per_file` positions, so no task holds a whole
    recording. A file appears under its name only when it is whole, and a repeated
    task writes the same one again. `root` is a folder all executors reach. Columns
    other than project, dfm and pos are written as they are, nulls as nothing.
    """
    ship(ticks.sparkSession)
    columns = [c for c in ticks.columns if c not in (*REC, "pos")]
    schema = "project string, dfm bigint, part bigint, ticks bigint"
    place = [*REC, "_part"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        system, base = file_system(root)

        def put(key: tuple, pieces: list[pa.RecordBatch]) -> tuple:
            project, dfm, part = key
            folder = f"{base.rstrip('/')}/{project}/data"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            rows = pa.Table.from_batches(pieces).to_pandas(coerce_temporal_nanoseconds=True)
            aside = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as out:
                out.write(rows.to_csv(index=False, columns=columns).encode())
            system.move(aside, f"{folder}/{form.format(dfm=dfm, part=part)}")
            return project, dfm, part, len(rows)

        # a file may go on in the next batch
        key, pieces = None, []
        for batch in batches:
            written = []
            for now, a, b in _stretches(batch, place):
                if pieces and now != key:
                    written.append(put(key, pieces))
                    pieces = []
                key = now
                pieces.append(batch.slice(a, b - a))
            yield _told(written)
        yield _told([put(key, pieces)] if pieces else [])

    # times are written as the session's clock shows them
    times = [f.name for f in ticks.schema if f.dataType == T.TimestampType()]
    cut = ticks.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c in times})
    cut = cut.withColumn("_part", F.expr(f"pos div {int(ticks_per_file)} + {int(first_part)}"))
    # files of a task one after the other: many are small, and a group each would cost more than its file
    return cut.repartition(*place).sortWithinPartitions(*place, "pos").mapInArrow(write, schema).count()


def _stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of the stretches of equal keys of a batch."""
    columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
    start = 0
    for key, same in itertools.groupby(zip(*columns, strict=True)):
        stop = start + sum(1 for _ in same)
        yield key, start, stop
        start = stop


def _told(written: list[tuple]) -> pa.RecordBatch:
    names = {"project": pa.string(), "dfm": pa.int64(), "part": pa.int64(), "ticks": pa.int64()}
    arrays = [pa.array([w[i] for w in written], type=t) for i, t in enumerate(names.values())]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))
