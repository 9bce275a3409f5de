"""Runs, baseline, detection, bouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutspark.operators import baseline, bouts, detect, runs
from boutspark.params import REC
from boutspark.sources.tables import EVENT_PARAMS, EVENT_WINDOW, event_recording
from checks.oracle import false_runs, islands, linked, oracle, part, r6
from checks.queries import query
from checks.workspace import baselined, labelled, shown

WELL = [*REC, "well"]
# levels used directly on the raw signal in the run queries
ABOVE = "signal > 20"
REACHED = "signal > 60"


def signal_runs(spark, sf):
    rec = event_recording(spark, sf).select(*WELL, "chunk", "pos", "minutes", "signal")
    return runs.flag_runs(rec, F.expr(ABOVE), WELL, confirm=F.expr(REACHED))


def starts(df):
    return df.select("dfm", "well", (F.col("start") + 1).alias("sample"), F.col("length").alias("len"))


part("sigruns", ("sig",), islands("sig", "signal", "20", "-1"))
part("sigsurv", ("sig",), islands("sig", "signal", "20", "60", "count(*) >= 2"))
part("sigone", ("sig",), islands("sig", "signal", "20", "60"))
part("siglink", ("sigone",), linked("sigone", 2))


@query
def flagship_contacts(spark, sf):
    """Licks and bouts per well straight from the signal."""
    found = runs.surviving_runs(signal_runs(spark, sf))
    joined = runs.link_runs(found, WELL, 2)
    licks = found.groupBy(*WELL).agg(F.sum("length").alias("licks"))
    events = joined.groupBy(*WELL).agg(F.count(F.lit(1)).alias("events"))
    return shown(licks.join(events, WELL))


oracle(
    "flagship_contacts",
    """select dfm, well, licks, events
from (select dfm, well, cast(sum(n) as bigint) as licks from sigone group by all)
join (select dfm, well, count(*) as events from siglink group by all) using (dfm, well)""",
    "siglink",
)


@query
def runs_get_events(spark, sf):
    return shown(starts(signal_runs(spark, sf)))


oracle("runs_get_events", "select dfm, well, first_s as sample, n as len from sigruns", "sigruns")


@query
def runs_expand(spark, sf):
    found = signal_runs(spark, sf).select(*WELL, "start", "end")
    return shown(runs.expand_runs(found).select("dfm", "well", (F.col("pos") + 1).alias("sample")))


oracle("runs_expand", "select dfm, well, sample from sig where signal > 20", "sig")


@query
def runs_surviving(spark, sf):
    return shown(starts(runs.surviving_runs(signal_runs(spark, sf), 2)))


oracle("runs_surviving", "select dfm, well, first_s as sample, n as len from sigsurv", "sigsurv")


@query
def runs_link(spark, sf):
    found = runs.link_runs(runs.surviving_runs(signal_runs(spark, sf)), WELL, 2)
    return shown(
        found.select(
            "dfm", "well", (F.col("start") + 1).alias("sample"), (F.col("end") - F.col("start") + 1).alias("len")
        )
    )


oracle("runs_link", "select dfm, well, first_s as sample, last_s - first_s + 1 as len from siglink", "siglink")


@query
def runs_intervals(spark, sf):
    rec = event_recording(spark, sf).select(*WELL, "chunk", "pos", "minutes", "signal")
    return shown(starts(runs.flag_runs(rec, ~F.expr(ABOVE), WELL)))


oracle(
    "runs_intervals",
    f"select dfm, well, sample, cast(sec as bigint) as len from ({false_runs('sig', 'not signal > 20')})",
    "sig",
)


@query
def baseline_median(spark, sf):
    rec = event_recording(spark, sf).select(*WELL, "pos", "sample", "signal")
    med = baseline.running_median(rec, REC, EVENT_WINDOW)
    return shown(
        med.select("dfm", "well", "sample", "median", (F.col("signal") - F.col("median")).alias("base"))
    )


oracle(
    "baseline_median",
    f"select dfm, well, sample, {r6('signal - base')} as median, {r6('base')} as base from bas",
    "bas",
)


@query
def adaptive_thresholds(spark, sf):
    relative = EVENT_PARAMS.with_updates(
        feeding_threshold=-0.5, feeding_minimum=-0.25, tasting_minimum=-0.05, tasting_maximum=-0.2
    )
    return shown(baseline.thresholds(baselined(spark, sf), relative))


oracle(
    "adaptive_thresholds",
    """select dfm, well, round_even(mx * 0.5, 0) as feeding_max, round_even(mx * 0.25, 0) as feeding_min,
       round_even(mx * 0.2, 0) as tasting_max, round_even(mx * 0.05, 0) as tasting_min
from (select dfm, well, max(base) as mx from bas group by all)""",
    "bas",
)


@query
def feeding_detect(spark, sf):
    """Licks (unlinked) and bouts (linked) of every sample, after correction."""
    rows = labelled(spark, sf)
    return shown(
        rows.select(
            "dfm", "well", "sample", "lick", (F.col("bout") + 1).alias("bout"), "bout_head", "lick_before"
        )
    )


oracle(
    "feeding_detect",
    """select dfm, well, sample, lick, bout, coalesce(bout = sample, false) as bout_head,
       lick1 as lick_before from lab""",
    "lab",
)


@query
def tasting_detect(spark, sf):
    """Tasting licks per well, and events of at least two samples."""
    rows = labelled(spark, sf)
    two = EVENT_PARAMS.with_updates(tasting_minevents=2)
    licks = rows.groupBy(*WELL).agg(F.sum(F.col("taste").cast("bigint")).alias("licks"))
    events = detect.tasting_runs(rows, two).groupBy(*WELL).agg(F.count(F.lit(1)).alias("events"))
    return shown(
        licks.join(events, WELL, "left").withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))
    )


part(
    "tasteruns",
    ("lab",),
    """
select dfm, chamber, side, well, min(minutes) as minutes, min(sample) as sample, count(*) as n,
       sum(base) as total, avg(base) as mean, min(base) as low, max(base) as high,
       case when count(*) > 1 then var_samp(base) end as variance
from (select *, sample - row_number() over (partition by dfm, well order by sample) as g
      from lab where taste)
group by dfm, chamber, side, well, g""",
)
oracle(
    "tasting_detect",
    """select l.dfm, l.well, l.licks, coalesce(e.events, 0) as events
from (select dfm, well, cast(sum(case when taste then 1 else 0 end) as bigint) as licks from lab group by all) l
left join (select dfm, well, count(*) as events from tasteruns where n >= 2 group by all) e
  on l.dfm = e.dfm and l.well = e.well""",
    "tasteruns",
)


def bout_columns(df):
    return shown(
        df.select("dfm", "well", (F.col("start") + 1).alias("sample"), *bouts.MEASURES)
    )


@query
def bout_measures(spark, sf):
    return bout_columns(bouts.feeding_bouts(labelled(spark, sf), EVENT_PARAMS))


oracle(
    "bout_measures",
    f"""select dfm, well, bout as sample, {r6('minutes')} as Minutes, licks as Licks, {r6('duration')} as Duration,
       {r6('total')} as TotalIntensity, {r6('mean')} as AvgIntensity, {r6('low')} as MinIntensity,
       {r6('high')} as MaxIntensity, {r6('variance')} as VarIntensity from bouts""",
    "bouts",
)


@query
def tasting_bouts(spark, sf):
    return bout_columns(bouts.tasting_bouts(labelled(spark, sf), EVENT_PARAMS))


oracle(
    "tasting_bouts",
    f"""select dfm, well, sample, {r6('minutes')} as Minutes, n as Licks, {r6('n / 1.0')} as Duration,
       {r6('total')} as TotalIntensity, {r6('mean')} as AvgIntensity, {r6('low')} as MinIntensity,
       {r6('high')} as MaxIntensity, {r6('variance')} as VarIntensity from tasteruns""",
    "tasteruns",
)


@query
def feeding_intervals(spark, sf):
    got = bouts.feeding_intervals(labelled(spark, sf), EVENT_PARAMS)
    return shown(got.select("dfm", "well", "Minutes", "Sample", "IntervalSec"))


oracle(
    "feeding_intervals",
    f"select dfm, well, {r6('minutes')} as Minutes, sample as Sample, {r6('sec')} as IntervalSec from gaps",
    "gaps",
)


@query
def tasting_intervals(spark, sf):
    got = bouts.tasting_intervals(labelled(spark, sf), EVENT_PARAMS)
    return shown(got.select("dfm", "well", "Minutes", "Sample", "IntervalSec"))


oracle(
    "tasting_intervals",
    f"""select dfm, well, {r6('minutes')} as Minutes, sample as Sample, {r6('sec')} as IntervalSec
from ({false_runs('lab', 'not lick')})""",
    "lab",
)

part(
    "pairs",
    ("lab",),
    """
select dfm, chamber, sample, bool_or(well % 2 = 1 and lick) as l1, bool_or(well % 2 = 0 and lick) as l2,
       bool_or(well % 2 = 1 and lick1) as k1, bool_or(well % 2 = 0 and lick1) as k2,
       max(case when well % 2 = 1 then base end) as b1, max(case when well % 2 = 0 then base end) as b2
from lab group by all""",
)


def pair_sql(a, b, stage):
    return f"""select dfm, chamber, '{stage}' as stage,
       cast(sum(case when {a} then 1 else 0 end) as double) as Licks1,
       cast(sum(case when {b} then 1 else 0 end) as double) as Licks2,
       cast(sum(case when {a} and {b} then 1 else 0 end) as double) as "Both",
       {r6(f"coalesce(max(case when {a} and {b} then least(b1, b2) end), 0.0)")} as MaxMinSignalAtBoth,
       cast(sum(case when {a} and {b} and b1 > b2 then 1 else 0 end) as double) as HigherInCol1AtBoth
from pairs group by dfm, chamber"""


@query
def simultaneous_matrix(spark, sf):
    """Shared licks per chamber, before and after the correction."""
    return shown(detect.simultaneous_matrices(labelled(spark, sf)))


oracle(
    "simultaneous_matrix",
    pair_sql("k1", "k2", "before") + "\nunion all\n" + pair_sql("l1", "l2", "after"),
    "pairs",
)


@query
def dual_correction(spark, sf):
    """Samples licked in both wells at once, and what remains of the licks."""
    return shown(
        detect.dual_rows(labelled(spark, sf)).select("dfm", "chamber", "well", "sample", "base", "lick")
    )


oracle(
    "dual_correction",
    f"select dfm, chamber, well, sample, {r6('base')} as base, lick from lab where dual",
    "lab",
)

