"""Device files of many experiments, read in one scan.

Layout: <root>/<project>/data/DFM<id>_<part>.csv (version 3), or DFM_<id>.csv
or DFM_<id>_<part>.csv (version 2). A device with version 3 files ignores its
version 2 files; a single version 2 file wins over linked ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutspark.functions.scalars import well_is_lit, without_training_mark
from boutspark.operators.access import wells_long
from boutspark.operators.scan import CHUNK_ROWS, chunk_of, ordered_scan, spread_join
from boutspark.params import REC, WELLS_PER_DEVICE
from boutspark.sources.files import can_open, with_headers
from boutspark.staging import stage

# File name patterns and clock formats.
V3_NAME = r"DFM(\d+)_([^/]*)\.csv$"
V2_NAME = r"DFM_(\d+)(?:_([^/]*))?\.csv$"
CLOCK_12H = "M/d/yyyy h:mm:ss a X"
CLOCK_24H = "M/d/yyyy H:mm:ss X"

WELL_COLUMNS = [f"W{w}" for w in range(1, WELLS_PER_DEVICE + 1)]


def natural_key(name: Column) -> Column:
    """Text that sorts numbers inside names by value: part 2 before part 10.

    A number is written as the length of its digits and the digits, whatever their
    count; the name itself comes last, so no two names share a key.
    """
    pieces = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    sized = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))
    by_value = F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), sized(p)).otherwise(F.lower(p)))
    return F.concat(F.array_join(by_value, ""), F.lit("\u0001"), name)


def _file_columns() -> dict[str, Column]:
    """project, dfm, rank and part of a file from its path.

    rank 3 is version 3, rank 2 a single and rank 1 a linked version 2 file.
    """
    path = F.col("path")
    v3 = F.regexp_extract(path, V3_NAME, 1)
    v2, linked = F.regexp_extract(path, V2_NAME, 1), F.regexp_extract(path, V2_NAME, 2)
    project = F.coalesce(
        F.nullif(F.regexp_extract(path, r"([^/]+)/data/[^/]+$", 1), F.lit("")),
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1),
    )
    return {
        "project": project,
        "dfm": F.when(v3 != "", v3).when(v2 != "", v2).cast("bigint"),
        "rank": F.when(v3 != "", 3).when((v2 != "") & (linked == ""), 2).when(v2 != "", 1),
        "part": natural_key(F.regexp_extract(path, r"([^/]+)$", 1)),
    }


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All device files below `root` (a listing; contents are not read)."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "DFM*.csv")
        .load(root)
        .select("path")
    )
    return found.withColumns(_file_columns()).filter(F.col("rank").isNotNull())


def chosen_files(files: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """The files that count: best rank per device, configured devices only."""
    best = files.groupBy(*REC).agg(F.max("rank").alias("rank"))
    chosen = files.join(best, [*REC, "rank"])
    return chosen if devices is None else chosen.join(devices.select(*REC), list(REC), "left_semi")


def _number(c: str) -> Column:
    x = F.expr(f"try_cast(`{c}` as double)")
    return F.when(~F.isnan(x), x)


def read_ticks(
    spark: SparkSession,
    root: str,
    devices: DataFrame | None = None,
    start: float | None = None,
    end: float | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per tick, wells side by side, in recording order (`pos`).

    Everything is read as text and cast, so no pass infers types. All files are read
    by one scan and written once; the result has the columns of all headers. The
    place in the files is the order, and their own counter (`sample`) is data. The
    load window is open, start < minutes < end, and is applied before numbering.
    """
    # listed once; what follows reads the written list
    chosen = chosen_files(stage(list_files(spark, root), "files"), devices)
    newest = F.col("rank") == 3
    headed = stage(_headers(chosen.withColumn("newest", newest), root).where("header is not null"), "headed")
    # the scan is planned from folders and distinct headers, however many files there are
    kinds = headed.groupBy("newest", "header").agg(F.min("path").alias("path")).orderBy("newest", "header").collect()
    if not kinds:
        raise ValueError(f"no device files to load below {root}")
    named = [_names(spark, path) for _, _, path in kinds]
    lines = _lines(spark, headed, max(map(len, named)))
    parts = [
        _scan(lines.where((F.col("newest") == newest) & (F.col("header") == header)), names, 3 if newest else 2)
        for (newest, header, _), names in zip(kinds, named, strict=True)
    ]
    ticks = parts[0]
    for other in parts[1:]:
        ticks = ticks.unionByName(other, allowMissingColumns=True)
    if start is not None:
        ticks = ticks.filter(F.col("minutes") > float(start))
    if end is not None:
        ticks = ticks.filter(F.col("minutes") < float(end))
    # a piece of a file as Spark reads it bounds the windows
    numbered = ordered_scan(
        ticks.withColumn("_block", F.struct("part", "_split")),
        list(REC),
        ["part", "_split", "_row"],
        "_block",
        sums={"_nr": F.lit(1).cast("bigint")},
    )
    return (
        numbered.withColumn("pos", F.col("_nr") - 1)
        .withColumn("sample", F.coalesce(F.col("sample"), F.col("_nr")))
        .withColumn("chunk", chunk_of("pos", chunk_rows))
        .drop("_nr", "_block", "_split", "_row", "part")
    )


def _headers(files: DataFrame, root: str) -> DataFrame:
    """(path, newest, header): the first line that starts with a letter, null without one.

    From the first blocks of the files; where the tasks cannot open files of this kind
    themselves, from a scan of their lines.
    """
    if can_open(root):
        return with_headers(files)
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return files.withColumn("header", F.lit(None).cast("string"))
    lines = files.sparkSession.read.text(paths).where(F.col("value").rlike(r"\S"))
    placed = lines.select(
        _decoded(F.col("_metadata.file_path")).alias("path"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("_place"),
        F.trim("value").alias("value"),
    )
    told = F.col("value").rlike(r'^\W*\p{L}')
    first = placed.groupBy("path").agg(
        F.min_by("value", F.when(told, F.col("_place"))).alias("header"), F.min_by("value", "_place").alias("_top")
    )
    late = F.raise_error(F.concat(F.lit("lines before the header of "), "path")).cast("string")
    first = first.select("path", F.when(F.col("header") != F.col("_top"), late).otherwise(F.col("header")).alias("header"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.join(first.withColumnRenamed("path", "_path"), plain(F.col("path")) == plain(F.col("_path")), "left").drop("_path")


def _decoded(path: Column) -> Column:
    """A path of the scan's metadata, where blanks and the like are escaped, as files are listed."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file as Spark tells them apart."""
    return spark.read.option("header", "true").csv(path).columns


def _lines(spark: SparkSession, headed: DataFrame, width: int) -> DataFrame:
    """Every line after the headers of the files in `headed`, its fields as text by their place.

    Written once: each file is opened by one scan, and its name is taken apart once per
    file. Folders are listed, not files, so the plan does not grow with their number.
    """
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    folders = sorted(r[0] for r in headed.select(parent).distinct().collect())
    known = set(folders)
    # a folder below another one is read with it
    tops = [f for f in folders if not any(f[:i] in known for i, c in enumerate(f) if c == "/")]
    fields = [f"_c{i}" for i in range(width)]
    rows = (
        spark.read.option("header", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "DFM*.csv")
        .schema(", ".join(f"{c} string" for c in fields))
        .csv(tops)
        .select(
            *fields,
            _decoded(F.col("_metadata.file_path")).alias("_path"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = headed.select(plain(F.col("path")).alias("path"), *REC, "part", "newest", "header")
    # one row per file, in no task and not in the driver as a whole
    met = rows.withColumn("path", plain(F.col("_path"))).drop("_path").join(files.hint("merge"), "path")
    return stage(met.drop("path"), "lines")


def _scan(lines: DataFrame, names: Sequence[str], version: int) -> DataFrame:
    """Ticks of the files with one header, whose columns are `names`."""
    described = lines.select(
        *REC, "part", "_split", "_row", *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n not in REC]
    )
    index = next((c for c in ("Sample", "Index") if c in names), None)
    if "Seconds" in names:
        seconds = _number("Seconds")
    elif {"Date", "Time", "MSec"} <= set(names):
        seconds = None
    else:
        raise ValueError("time columns are missing: Seconds, or Date, Time and MSec")
    # clocks are read as UTC, whatever the zone of the session
    written = F.concat_ws(" ", "Date", "Time", F.lit("Z"))
    clock = (
        F.coalesce(
            F.try_to_timestamp(written, F.lit(CLOCK_12H)),
            F.try_to_timestamp(written, F.lit(CLOCK_24H)),
        )
        if {"Date", "Time"} <= set(names)
        else F.lit(None).cast("timestamp")
    )
    msec = F.coalesce(_number("MSec"), F.lit(0.0)) if "MSec" in names else F.lit(0.0)
    errors = [c for c in names if "error" in c.lower()]
    ticks = described.select(
        *REC,
        "part",
        "_split",
        "_row",
        F.lit(version).alias("version"),
        (_number(index).cast("bigint") if index else F.lit(None).cast("bigint")).alias("sample"),
        clock.alias("_clock"),
        msec.alias("_msec"),
        *([seconds.alias("seconds")] if seconds is not None else []),
        *[_number(w).alias(w) for w in WELL_COLUMNS if w in names],
        *[_number(c).cast("bigint").alias(c) for c in ("OptoCol1", "OptoCol2") if c in names],
        *([F.expr(f"try_cast(`{errors[0]}` as bigint)").alias("error_code")] if errors else []),
        # every error column as it is written, numbers or words
        (
            F.create_map(*[x for c in errors for x in (F.lit(c), F.col(f"`{c}`"))])
            if errors
            else F.lit(None).cast("map<string,string>")
        ).alias("errors"),
    )
    if seconds is None:
        # time starts with the first row; its milliseconds are not taken off
        first = ticks.groupBy(*REC).agg(
            F.min_by("_clock", F.struct("part", "_split", "_row")).alias("_first")
        )
        # dealt to the pieces of the files: a device is not one task
        ticks = spread_join(ticks, first, REC, chunk=["part", "_split"]).withColumn(
            "seconds",
            (F.unix_micros("_clock") - F.unix_micros("_first")) / 1e6 + F.col("_msec") / 1000.0,
        )
        ticks = ticks.drop("_first")
    millis = F.make_dt_interval(secs=F.col("_msec") / 1000.0)
    return (
        ticks.withColumn("minutes", F.col("seconds") / 60.0)
        .withColumn("ts", F.col("_clock") + millis)
        .drop("_clock", "_msec")
    )


def samples_from_ticks(ticks: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per well and tick: training mark removed, light bit decoded; error columns stay."""
    carried = [c for c in ("error_code", "errors") if c in ticks.columns and c not in extra]
    keep = [*REC, "version", "chunk", "pos", "sample", "seconds", "minutes", *carried, *extra]
    opto = F.col("OptoCol1") if "OptoCol1" in ticks.columns else F.lit(None).cast("bigint")
    rows = wells_long(ticks.withColumn("opto", opto), [*keep, "opto"])
    signal = F.when(
        F.col("version") == 3, without_training_mark(F.col("raw_signal"))
    ).otherwise(F.col("raw_signal"))
    return rows.withColumn("signal", signal).withColumn(
        "lit", well_is_lit(F.col("opto"), F.col("well"))
    )


def coverage(devices: DataFrame, files: DataFrame) -> DataFrame:
    """Devices named but without files, files of devices not named, and neither."""
    have = files.select(*REC).distinct()
    want = devices.select(*REC).distinct()
    told = lambda df, severity, text: df.select(
        "project",
        F.lit(severity).alias("severity"),
        F.col("dfm").cast("string").alias("subject"),
        F.lit(text).alias("message"),
    )
    none_left = (
        want.select("project")
        .distinct()
        .join(want.join(have, list(REC), "left_semi").select("project").distinct(), "project", "left_anti")
        .select(
            "project",
            F.lit("error").alias("severity"),
            F.lit("").alias("subject"),
            F.lit("no device left to load").alias("message"),
        )
    )
    return (
        told(want.join(have, list(REC), "left_anti"), "warning", "configured device without files")
        .unionByName(
            told(have.join(want, list(REC), "left_anti"), "warning", "files of a device not configured")
        )
        .unionByName(none_left)
    )
