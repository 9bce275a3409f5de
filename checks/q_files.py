"""Exclusions and results written as files and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boutspark.sources.exclusions import read_exclusions, write_exclusions
from boutspark.sources.files import write_device_files
from boutspark.sources.recordings import read_ticks, samples_from_ticks
from boutspark.sources.sinks import write_included
from boutspark.sources.tables import event_recording
from boutspark.staging import run_folder, stage
from checks.oracle import oracle, part, r6
from checks.q_summary import summary_designed
from checks.queries import query
from checks.workspace import shown

SEEN = ["dfm", "chamber", "Treatment", "Sex", "LicksA", "LicksB"]


def written_exclusions(spark, sf):
    """(chambers, folder): two groups, of which the first was written whole and then replaced."""
    folder = f"{run_folder(spark)}/files-{uuid.uuid4().hex}"
    table = stage(summary_designed(spark, sf, transform_licks=False).select(*SEEN), "chambers")
    named = table.withColumn("note", F.concat_ws(", ", "Treatment", "Sex"))
    write_exclusions(f"{folder}/exclusions", "prefers B", named)
    write_exclusions(f"{folder}/exclusions", "A alone", named.where("LicksB = 0"))
    write_exclusions(f"{folder}/exclusions", "prefers B", named.where("LicksA < LicksB"))
    return table, folder


@query
def exclusion_files(spark, sf):
    """Every group of excluded chambers as its files tell after one was replaced."""
    _, folder = written_exclusions(spark, sf)
    return shown(read_exclusions(spark, f"{folder}/exclusions"))


oracle(
    "exclusion_files",
    """select g as "group", dfm, chamber, Treatment || ', ' || Sex as note from (
select 'A alone' as g, * from designed where LicksB = 0
union all select 'prefers B', * from designed where LicksA < LicksB)""",
    "designed",
)


@query
def included_files(spark, sf):
    """Rows of the chambers that no group of the files excludes, written as CSV and read again."""
    table, folder = written_exclusions(spark, sf)
    write_included(table, read_exclusions(spark, f"{folder}/exclusions"), f"{folder}/included")
    return shown(spark.read.option("header", "true").schema(table.schema).csv(f"{folder}/included"))


oracle(
    "included_files",
    f"""select dfm, chamber, Treatment, Sex, {r6('cast(LicksA as double)')} as LicksA, {r6('cast(LicksB as double)')} as LicksB
from designed where not coalesce(LicksB = 0, false) and not coalesce(LicksA < LicksB, false)""",
    "designed",
)


def device_folder(spark, sf):
    """The event recording as device files: odd devices of version 3 with seconds and an error
    column of words, even ones linked files of version 2 with a clock that starts before noon."""
    folder = f"{run_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = event_recording(spark, sf)
    wells = [F.max(F.when(F.col("well") == w, F.col("raw_signal"))).alias(f"W{w}") for w in range(1, 13)]
    ticks = stage(
        rows.groupBy("project", "dfm", "chunk", "pos").agg(*wells, F.max("opto").alias("OptoCol1")), "ticks"
    ).drop("chunk")
    sample = F.col("pos") + 1
    newest = ticks.where("dfm % 2 = 1").withColumns(
        {"Sample": sample, "Seconds": F.col("pos") * 60, "ErrorText": F.when(F.col("pos") % 10 == 9, "E9").otherwise("0")}
    )
    clock = F.lit("2024-02-28 11:30:00").cast("timestamp") + F.make_dt_interval(mins=F.col("pos").cast("int"))
    older = ticks.where("dfm % 2 = 0").withColumns(
        {"Index": sample, "Date": F.date_format(clock, "M/d/yyyy"), "Time": F.date_format(clock, "h:mm:ss a"), "MSec": F.lit(250)}
    )
    # part 10 comes after part 9
    write_device_files(newest, folder, ticks_per_file=20, first_part=9)
    write_device_files(older, folder, ticks_per_file=20, first_part=9, form="DFM_{dfm}_{part}.csv")
    return folder


SAMPLE = ["dfm", "well", "pos", "sample", "seconds", "minutes", "signal", "opto", "lit"]


@query
def device_files(spark, sf):
    """All samples of the device files, both versions and clocks, in the order of their parts."""
    samples = samples_from_ticks(read_ticks(spark, device_folder(spark, sf)))
    told = F.coalesce(F.col("errors")["ErrorText"], F.lit("")).alias("error_text")
    return shown(samples.where("raw_signal is not null").select(*SAMPLE, "version", told))


@query
def device_files_window(spark, sf):
    """The samples of the device files strictly inside a load window, numbered anew."""
    ticks = read_ticks(spark, device_folder(spark, sf), start=2.0, end=45.0)
    return shown(samples_from_ticks(ticks).where("raw_signal is not null").select(*SAMPLE))


# the milliseconds of the clock are not taken off; only version 3 has a training mark to remove
part(
    "read_back",
    ("sig",),
    """
select dfm, well, sample - 1 as pos, sample, (sample - 1) * 60 + ms as seconds, (sample - 1) + ms / 60 as minutes,
       case when dfm % 2 = 1 then signal else raw_signal end as signal, opto, lit,
       cast(case when dfm % 2 = 1 then 3 else 2 end as bigint) as version,
       case when dfm % 2 = 0 then '' when sample % 10 = 0 then 'E9' else '0' end as error_text
from (select *, case when dfm % 2 = 1 then 0.0 else 0.25 end as ms from sig)""",
)
_READ = f"""dfm, well, sample, {r6('cast(seconds as double)')} as seconds, {r6('cast(minutes as double)')} as minutes,
{r6('signal')} as signal, opto, lit"""
oracle("device_files", f"select {_READ}, pos, version, error_text from read_back", "read_back")
oracle(
    "device_files_window",
    f"""select {_READ}, pos - (select min(r.pos) from read_back r where r.dfm = b.dfm and r.minutes > 2) as pos
from read_back b where minutes > 2 and minutes < 45""",
    "read_back",
)
