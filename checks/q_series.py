"""Light, cumulative series, progressive ratio, quality checks, accessors."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutspark.functions.scalars import ERROR_BITS, epoch_micros
from boutspark.operators import access, detect, light, quality, ratio
from boutspark.operators.bouts import feeding_bouts
from boutspark.params import REC
from boutspark.plans.experiment import quality_results
from boutspark.sources.tables import EVENT_PARAMS, event_design, event_recording
from checks.oracle import detection, oracle, part, r6
from checks.q_detect import pair_sql
from checks.queries import query
from checks.workspace import baselined, labelled, shown

WELL = [*REC, "well"]


@query
def light_phase(spark, sf):
    design = event_design(spark, sf)
    got = light.light_phases(labelled(spark, sf), EVENT_PARAMS, design=design, factors=["Sex"])
    return shown(got)


oracle(
    "light_phase",
    f"""select g.dfm, g.chamber, g.Phase, d.Treatment, d.Sex, coalesce(sec, 0.0) as PhaseSeconds,
       {r6('power(coalesce(la, 0), 0.25)')} as LicksA, coalesce(ea, 0) as EventsA,
       {r6('power(coalesce(lb, 0), 0.25)')} as LicksB, coalesce(eb, 0) as EventsB
from (select dfm, chamber, Phase from (select distinct dfm, chamber from lab), (values ('light'), ('dark')) p(Phase)) g
left join (select dfm, case when opto <> 0 then 'light' else 'dark' end as Phase,
                  count(distinct sample) / 1.0 as sec from lab group by all) t using (dfm, Phase)
left join (select dfm, chamber, case when opto <> 0 then 'light' else 'dark' end as Phase,
                  count(*) filter (side = 'A' and lick) as la, count(*) filter (side = 'B' and lick) as lb,
                  count(*) filter (side = 'A' and bout = sample) as ea,
                  count(*) filter (side = 'B' and bout = sample) as eb from lab group by all) c
  using (dfm, chamber, Phase)
join design d using (dfm, chamber)""",
    "lab",
    "design",
)


@query
def cumulative_pi(spark, sf):
    return shown(light.cumulative_pi(labelled(spark, sf)), "pos")


@query
def cumulative_pi_range(spark, sf):
    """The same from minute 5 on."""
    return shown(light.cumulative_pi(labelled(spark, sf), start=5), "pos")


def ticks(mark: str, where: str) -> str:
    return f"""
select dfm, chamber, sample, min(minutes) as minutes, max(case when side = 'A' then 1 else 0 end) as a,
       max(case when side = 'B' then 1 else 0 end) as b
from lab where {mark} and {where} group by dfm, chamber, sample"""


def so_far(src: str) -> str:
    return f"""
select *, sum(a) over w as ca, sum(b) over w as cb, row_number() over w as nr
from ({src}) window w as (partition by dfm, chamber order by sample)"""


for name, where in (("cumulative_pi", "true"), ("cumulative_pi_range", "minutes > 5")):
    oracle(
        name,
        f"""select dfm, chamber, {r6('minutes')} as Minutes, {r6('(ca - cb) / (ca + cb)')} as PI,
       cast(ca + cb as bigint) as Licks from ({so_far(ticks('lick', where))})""",
        "lab",
    )


@query
def cumulative_event_pi(spark, sf):
    return shown(light.cumulative_event_pi(labelled(spark, sf)), "pos")


@query
def cumulative_event_pi_first(spark, sf):
    """The first eight bouts of every chamber."""
    got = light.cumulative_event_pi(labelled(spark, sf), events_limit=8)
    return shown(got, "pos")


for name, where in (("cumulative_event_pi", "true"), ("cumulative_event_pi_first", "nr <= 8")):
    oracle(
        name,
        f"""select dfm, chamber, {r6('minutes')} as Minutes, {r6('(ca - cb) / (ca + cb)')} as PI, nr as EventNum
from ({so_far(ticks('bout = sample', 'true'))}) where {where}""",
        "lab",
    )


def curve(spark, sf, **kw):
    rows = labelled(spark, sf)
    return light.cumulative_licks(rows, feeding_bouts(rows, EVENT_PARAMS), **kw)


def curve_sql(where: str) -> str:
    return f"""
select dfm, chamber, well, minutes, power(sum(licks) over (partition by dfm, well order by bout), 0.25) as y
from bouts where {where}
union all
select dfm, chamber, well, unnest([min(minutes), max(minutes)]) as minutes, 0.0 as y
from lab anti join (select * from bouts where {where}) using (dfm, well)
where {where} group by dfm, chamber, well"""


part("curve", ("bouts", "lab"), curve_sql("minutes > 20 and minutes <= 30"))
part("curve_all", ("bouts", "lab"), curve_sql("true"))


@query
def cumulative_licks(spark, sf):
    return shown(curve(spark, sf), "pos")


@query
def cumulative_licks_range(spark, sf):
    """Within (20, 30], so that some wells have no bout at all."""
    return shown(curve(spark, sf, start=20, end=30), "pos")


for name, src in (("cumulative_licks", "curve_all"), ("cumulative_licks_range", "curve")):
    oracle(
        name,
        f"select dfm, chamber, well, {r6('minutes')} as Minutes, {r6('y')} as CumLicks from {src}",
        src,
    )


@query
def light_marks(spark, sf):
    return shown(light.light_marks(labelled(spark, sf), curve(spark, sf)), "pos")


oracle(
    "light_marks",
    f"""select dfm, chamber, well, {r6('m')} as Minutes,
       {r6('case when x0 is null then y1 when x1 is null or x1 = x0 then y0 else y0 + (y1 - y0) * ((m - x0) / (x1 - x0)) end')}
         as CumLicks
from (select l.dfm, l.chamber, l.well, l.minutes as m, a.minutes as x0, a.y as y0, b.minutes as x1, b.y as y1
      from (select * from lab where lit) l
      join (select dfm, well from curve_all group by all having count(*) >= 2) ok using (dfm, well)
      asof left join curve_all a on l.dfm = a.dfm and l.well = a.well and l.minutes >= a.minutes
      asof left join curve_all b on l.dfm = b.dfm and l.well = b.well and l.minutes <= b.minutes)""",
    "curve_all",
)


@query
def training_end(spark, sf):
    return shown(ratio.training_end(event_recording(spark, sf)))


oracle(
    "training_end",
    f"""select dfm, well, {r6('max(case when raw_signal > 40000 then minutes end)')} as Minutes,
       max(case when raw_signal > 40000 then sample end) as Sample from sig group by dfm, well""",
    "sig",
)


def breaks_of(spark, sf):
    ends = ratio.training_end(event_recording(spark, sf))
    return ratio.breaking_points(labelled(spark, sf), ends, wiring=1)


part(
    "switches",
    ("lab",),
    """
select * from (
  select *, lag(lit) over (partition by dfm, well order by sample) as was
  from (select l.*, coalesce(e.m, 0.0) as e_m,
               sum(case when lick then 1 else 0 end) over (partition by l.dfm, l.well order by sample) as cum
        from lab l left join (select dfm, well, max(case when raw_signal > 40000 then minutes end) as m
                              from lab group by all) e
          on l.dfm = e.dfm and e.well = case when l.well <= 4 then 1 when l.well <= 8 then 5 else 9 end)
  where minutes > e_m)
where was is not null and was <> lit""",
)
part(
    "points",
    ("switches",),
    """
select * from (
  select dfm, well, sample, minutes, lit, cum,
         coalesce(minutes - lag(minutes) over w, 0.0) as dm, coalesce(cum - lag(cum) over w, 0) as dl
  from switches window w as (partition by dfm, well order by sample))
where lit""",
)


@query
def breaking_point(spark, sf):
    return shown(breaks_of(spark, sf), "pos")


oracle(
    "breaking_point",
    f"""select dfm, well, {r6('minutes')} as Minutes, lit as Lights, cast(cum as bigint) as CumLicks,
       {r6('dm')} as DeltaMinutes, cast(dl as bigint) as DeltaLicks from points""",
    "points",
)


@query
def breaking_table(spark, sf):
    return shown(ratio.breaking_table(breaks_of(spark, sf)))


oracle(
    "breaking_table",
    """select dfm, well, count(*) as Trials, cast(arg_max(dl, sample) as bigint) as LastDeltaLicks,
       cast(max(dl) as bigint) as MaxDeltaLicks from points group by dfm, well""",
    "points",
)


@query
def opto_decode(spark, sf):
    """Lit samples and seconds of every well from the light word."""
    rows = event_recording(spark, sf)
    return shown(
        rows.groupBy("dfm", "well").agg(
            F.sum(F.col("lit").cast("bigint")).alias("Lit"),
            (F.sum(F.col("lit").cast("bigint")) / F.lit(1.0)).alias("OptoOn_sec"),
            F.sum((F.col("opto") != 0).cast("bigint")).alias("DeviceLit"),
        )
    )


oracle(
    "opto_decode",
    """select dfm, well, count(*) filter (lit) as Lit, count(*) filter (lit) / 1.0 as OptoOn_sec,
       count(*) filter (opto <> 0) as DeviceLit from sig group by dfm, well""",
    "sig",
)


@query
def light_transitions(spark, sf):
    rows = event_recording(spark, sf).select(*WELL, "chunk", "pos", "sample", "minutes", "lit")
    return shown(ratio.light_transitions(rows, WELL).select("dfm", "well", "sample", "lit"))


oracle(
    "light_transitions",
    """select dfm, well, sample, lit
from (select *, lag(lit) over (partition by dfm, well order by sample) as was from sig)
where was is not null and was <> lit""",
    "sig",
)

# ---- quality ---------------------------------------------------------------

BREAK_RATE = 1.0 / 21600.0  # so that four steps make one day


def clocked(spark, sf):
    rows = event_recording(spark, sf)
    return rows.withColumn("seconds", epoch_micros(rows, "ts") / F.lit(1e6))


def breaks(spark, sf):
    """Gaps of the device clock: the earliest of its wells' clocks at each position."""
    rows = clocked(spark, sf).select(*REC, "chunk", "pos", "seconds")
    return quality.data_breaks(quality.device_ticks(rows), REC, BREAK_RATE)


part(
    "steps",
    ("sig",),
    """
select *, sec - lag(sec) over (partition by dfm order by sample) as step
from (select dfm, sample, min(epoch_us(ts) / 1e6) as sec from sig group by dfm, sample)""",
)


@query
def data_breaks(spark, sf):
    """All breaks of every device."""
    got = breaks(spark, sf)
    return shown(got.select("dfm", "Index", F.round("Interval", 3).alias("Interval")))


@query
def first_data_breaks(spark, sf):
    """The first ten breaks of every device."""
    got = quality.first_breaks(breaks(spark, sf), REC)
    return shown(got.select("dfm", "Index", F.round("Interval", 3).alias("Interval"), "BreakNr"))


oracle(
    "data_breaks",
    f"select dfm, sample as Index, {r6('round(step, 3)')} as Interval from steps where step > 86400",
    "steps",
)
oracle(
    "first_data_breaks",
    f"""select dfm, sample as Index, {r6('round(step, 3)')} as Interval, nr as BreakNr
from (select *, row_number() over (partition by dfm order by sample) as nr from steps where step > 86400)
where nr <= 10""",
    "steps",
)


@query
def error_bits(spark, sf):
    return shown(quality.error_counts(event_recording(spark, sf), REC))


oracle(
    "error_bits",
    "\nunion all\n".join(
        f"""select dfm, count(error_code) as NonNull, count(*) filter (error_code <> 0) as Flagged,
       '{n}' as ErrorType, count(*) filter (error_code & {1 << i} > 0) as Count from sig group by dfm"""
        for i, n in enumerate(ERROR_BITS)
    ),
    "sig",
)


# the code of the events, and a column of words made from it
STATE = "case when error_code = 0 then 'na' when error_code % 3 = 0 then '' when error_code % 3 = 1 then 'bad' else 'worse' end"


@query
def error_columns(spark, sf):
    """Two error columns, one of them words; rows that either flags."""
    rows = event_recording(spark, sf).withColumn(
        "errors", F.expr(f"map('Code', cast(error_code as string), 'State', {STATE})")
    )
    counts = quality.error_columns(rows, REC).select(*REC, "Column", "NonMissing", "Missing", "Flagged")
    flagged = quality.integrity(rows, REC, index=None, errors="errors").select(*REC, F.col("Flagged").alias("AnyFlagged"))
    return shown(counts.join(flagged, list(REC)))


oracle(
    "error_columns",
    f"""select c.*, a.n as AnyFlagged from (
select dfm, 'Code' as "Column", count(error_code) as NonMissing, count(*) - count(error_code) as Missing,
       count(*) filter (error_code <> 0) as Flagged from sig group by dfm
union all
select dfm, 'State', count(*) filter (state <> ''), count(*) filter (state = ''),
       count(*) filter (state in ('bad', 'worse')) from (select dfm, {STATE} as state from sig) group by dfm
) c join (select dfm, count(*) filter (error_code <> 0) as n from sig group by dfm) a using (dfm)""",
    "sig",
)


def checked(spark, sf):
    return quality.integrity(event_recording(spark, sf), WELL)


@query
def integrity(spark, sf):
    got = checked(spark, sf)
    return shown(got.withColumn("Elapsed", F.round("Elapsed", 4)))


oracle(
    "integrity",
    f"""select dfm, well, count(*) as Rows, {r6('max(minutes) - min(minutes)')} as ElapsedFromMinutes,
       arg_min(ts, sample) as StartTime, arg_max(ts, sample) as EndTime,
       count(*) filter (error_code <> 0) as Flagged, true as IndexByOne,
       {r6('round((epoch_us(arg_max(ts, sample)) - epoch_us(arg_min(ts, sample))) / 60e6, 4)')} as Elapsed
from sig group by dfm, well""",
    "sig",
)


@query
def overview(spark, sf):
    """Rows and minutes per device and overall, beside the chambers of each treatment."""
    per_device = quality.overview(event_recording(spark, sf))
    table = quality.design_table(event_design(spark, sf))
    return shown(per_device.join(table, list(REC), "left"))


oracle(
    "overview",
    f"""select s.dfm, "Rows", {r6('f')} as FirstMin, {r6('l')} as LastMin, Treatment, Chambers, ChamberList
from (select dfm, count(*) as "Rows", min(minutes) as f, max(minutes) as l from sig group by dfm
      union all select null, count(*), min(minutes), max(minutes) from sig) s
left join (select dfm, Treatment, count(*) as Chambers, string_agg(cast(chamber as varchar), ',' order by chamber) as ChamberList
           from design group by all) d on s.dfm = d.dfm""",
    "sig",
    "design",
)

CUT = 100.0


@query
def bleeding_matrix(spark, sf):
    matrix, overall = quality.bleeding_matrix(baselined(spark, sf), CUT)
    means = overall.groupBy(*REC).pivot("well", list(range(1, 13))).agg(F.first("MeanBase"))
    for w in range(1, 13):
        means = means.withColumnRenamed(str(w), f"W{w}Resp")
    return shown(matrix.unionByName(means.withColumn("Signal", F.lit("AllData"))))


part(
    "wide",
    ("bas",),
    "select dfm, sample, "
    + ", ".join(f"max(case when well = {w} then base end) as W{w}" for w in range(1, 13))
    + " from bas group by dfm, sample",
)
oracle(
    "bleeding_matrix",
    "\nunion all\n".join(
        f"select dfm, 'W{i}Sig' as Signal, "
        + ", ".join(
            f"{r6(f'coalesce(avg(W{j}) filter (W{i} > {CUT}), 0.0)')} as W{j}Resp" for j in range(1, 13)
        )
        + " from wide group by dfm"
        for i in range(1, 13)
    )
    + "\nunion all select dfm, 'AllData', "
    + ", ".join(r6(f"avg(W{j})") for j in range(1, 13))
    + " from wide group by dfm",
    "wide",
)


@query
def qc_results(spark, sf):
    """One line per device with what every check found."""
    rows = event_recording(spark, sf)
    per_device = quality.integrity(rows, REC, clock=None, index=None)
    matrix, _ = quality.bleeding_matrix(baselined(spark, sf), CUT)
    shared = detect.simultaneous_matrix(labelled(spark, sf), stage_name="before")
    got = quality.qc_table(per_device, breaks(spark, sf), shared, matrix)
    return shown(got)


STRONG = "greatest(" + ", ".join(
    f"avg(W{j}) filter (W{i} > {CUT})" for i in range(1, 13) for j in range(1, 13) if i != j
) + ", 0.0)"
oracle(
    "qc_results",
    f"""select s.dfm, s.n as "Rows", {r6('s.e')} as ElapsedFromMinutes, s.f as Flagged, coalesce(b.n, 0) as Breaks,
       p.SharedLicks, {r6('p.MaxMinSignalAtBoth')} as MaxMinSignalAtBoth, {r6('w.strong')} as StrongestResponse
from (select dfm, count(*) as n, max(minutes) - min(minutes) as e, count(*) filter (error_code <> 0) as f
      from sig group by dfm) s
left join (select dfm, count(*) as n from steps where step > 86400 group by dfm) b on s.dfm = b.dfm
left join (select dfm, sum("Both") as SharedLicks, max(MaxMinSignalAtBoth) as MaxMinSignalAtBoth
           from ({pair_sql('k1', 'k2', 'before')}) group by dfm) p on s.dfm = p.dfm
left join (select dfm, {STRONG} as strong from wide group by dfm) w on s.dfm = w.dfm""",
    "steps",
    "pairs",
    "wide",
)


def long_rows(table, part_name, item, values):
    """(dfm, part, item, name, value) of every column of values."""
    typed = table.select("dfm", F.col(item).cast("string").alias("item"), *[F.col(c).cast("double").alias(c) for c in values])
    long = typed.unpivot(["dfm", "item"], values, "name", "value")
    return long.select("dfm", F.lit(part_name).alias("part"), "item", "name", "value")


QC_COUNTS = ["Rows", "ElapsedFromMinutes", "Flagged", "Breaks", "SharedLicks", "MaxMinSignalAtBoth", "StrongestResponse"]
LICK_COUNTS = ["Licks1", "Licks2", "Both", "MaxMinSignalAtBoth", "HigherInCol1AtBoth"]
RESPONSES = [f"W{w}Resp" for w in range(1, 13)]


@query
def qc_full(spark, sf):
    """All a device's checks: counts, first ten breaks, shared licks, both matrices, as long rows."""
    base = baselined(spark, sf)
    base = base.withColumn("seconds", epoch_micros(base, "ts") / F.lit(1e6))
    got = quality_results(base, labelled(spark, sf), EVENT_PARAMS, rate=BREAK_RATE, bleeding_cutoff=CUT)
    breaks = got.first_breaks.withColumn("Interval", F.round("Interval", 3))
    shared = got.simultaneous.withColumn("where", F.concat_ws(" ", "stage", F.col("chamber").cast("string")))
    means = got.mean_base.withColumn("W", F.concat(F.lit("W"), F.col("well").cast("string")))
    parts = [
        long_rows(got.devices.withColumn("all", F.lit("")), "device", "all", QC_COUNTS),
        long_rows(breaks, "break", "BreakNr", ["Index", "Interval"]),
        long_rows(shared, "shared", "where", LICK_COUNTS),
        long_rows(got.bleeding, "bleeding", "Signal", RESPONSES),
        long_rows(means, "mean", "W", ["MeanBase"]),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return shown(rows)


def long_sql(rows, part_name, item, values):
    return "\nunion all\n".join(
        f"select dfm, '{part_name}' as part, {item} as item, '{c}' as name, "
        f"{r6(f'cast({v} as double)')} as value from ({rows})"
        for c, v in values
    )


oracle(
    "qc_full",
    "\nunion all\n".join(
        [
            long_sql("select dfm, count(*) as n, max(minutes) - min(minutes) as e, "
                     "count(*) filter (error_code <> 0) as f from sig group by dfm",
                     "device", "''", [("Rows", "n"), ("ElapsedFromMinutes", "e"), ("Flagged", "f")]),
            long_sql("select d.dfm, count(b.dfm) as n from (select distinct dfm from sig) d "
                     "left join (select dfm from steps where step > 86400) b on b.dfm = d.dfm group by d.dfm",
                     "device", "''", [("Breaks", "n")]),
            long_sql(f"select dfm, sum(\"Both\") as s, max(MaxMinSignalAtBoth) as m from ({pair_sql('k1', 'k2', 'before')}) group by dfm",
                     "device", "''", [("SharedLicks", "s"), ("MaxMinSignalAtBoth", "m")]),
            long_sql(f"select dfm, {STRONG} as strong from wide group by dfm", "device", "''", [("StrongestResponse", "strong")]),
            long_sql("select * from (select dfm, sample, step, row_number() over (partition by dfm order by sample) as nr "
                     "from steps where step > 86400) where nr <= 10",
                     "break", "cast(nr as varchar)", [("Index", "sample"), ("Interval", "round(step, 3)")]),
            *[
                long_sql(pair_sql(a, b, name), "shared", "stage || ' ' || chamber",
                         [(c, f'"{c}"') for c in LICK_COUNTS])
                for a, b, name in (("k1", "k2", "before"), ("l1", "l2", "after"))
            ],
            *[
                long_sql("select dfm, " + ", ".join(f"coalesce(avg(W{j}) filter (W{i} > {CUT}), 0.0) as r{j}" for j in range(1, 13))
                         + " from wide group by dfm", "bleeding", f"'W{i}Sig'", [(f"W{j}Resp", f"r{j}") for j in range(1, 13)])
                for i in range(1, 13)
            ],
            long_sql("select dfm, well, avg(base) as m from bas group by dfm, well", "mean", "'W' || well", [("MeanBase", "m")]),
        ]
    ),
    "steps",
    "pairs",
    "wide",
    "bas",
)

# ---- accessors -------------------------------------------------------------


@query
def signal_range(spark, sf):
    """Raw and baselined signal within (10, 20]."""
    rows = access.signals(baselined(spark, sf), start=10, end=20)
    return shown(rows.select("dfm", "well", "sample", "minutes", "raw_signal", "base"))


oracle(
    "signal_range",
    f"""select dfm, well, sample, {r6('minutes')} as minutes, {r6('raw_signal')} as raw_signal, {r6('base')} as base
from bas where minutes > 10 and minutes <= 20""",
    "bas",
)


@query
def well_access(spark, sf):
    """Everything known about well B of chamber 2 on every device."""
    rows = access.well_of(labelled(spark, sf), chamber=2, side="b")
    counts = rows.groupBy("dfm", "well").agg(
        F.sum(F.col("lick").cast("bigint")).alias("licks"),
        F.sum(F.col("bout_head").cast("bigint")).alias("events"),
        F.sum(F.col("lit").cast("bigint")).alias("lit"),
        F.max("base").alias("peak"),
    )
    return shown(counts)


oracle(
    "well_access",
    f"""select dfm, well, count(*) filter (lick) as licks, count(*) filter (bout = sample) as events,
       count(*) filter (lit) as lit, {r6('max(base)')} as peak
from lab where chamber = 2 and side = 'B' group by dfm, well""",
    "lab",
)

# ---- recompute -------------------------------------------------------------

OTHER = {"feeding_threshold": 80.0, "feeding_minimum": 30.0, "feeding_event_link_gap": 4}
detection("_other", "bas", "30", "80", 4)


@query
def recompute(spark, sf):
    """The same recording detected again with other levels; training ends stay."""
    params = EVENT_PARAMS.with_updates(**OTHER)
    rows = labelled(spark, sf, params)
    bouts = feeding_bouts(rows, params).groupBy(*WELL).agg(F.count(F.lit(1)).alias("events"))
    licks = rows.groupBy(*WELL).agg(F.sum(F.col("lick").cast("bigint")).alias("licks"))
    ends = ratio.training_end(event_recording(spark, sf))
    got = licks.join(bouts, WELL, "left").join(ends, WELL).fillna(0, ["events"])
    return shown(got.select("dfm", "well", "licks", "events", F.col("Sample").alias("trained")))


oracle(
    "recompute",
    """select dfm, well, count(*) filter (lick) as licks, count(*) filter (bout = sample) as events,
       max(case when raw_signal > 40000 then sample end) as trained
from lab_other group by dfm, well""",
    "lab_other",
)

