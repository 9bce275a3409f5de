"""Summaries, bins, groups, exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutspark.functions.scalars import within
from boutspark.operators import detect, exclude, groups, summary
from boutspark.operators.bouts import (
    bout_transitions as count_transitions,
    event_number_bins,
    feeding_bouts,
    feeding_intervals,
    tidy_bouts as tidy,
)
from boutspark.params import REC
from boutspark.sources.tables import EVENT_PARAMS, event_design
from checks.oracle import false_runs, oracle, part, r6
from checks.queries import query
from checks.workspace import _once, baselined, labelled, shown

PAIRED = "Licks Events MeanDuration MedDuration MeanTimeBtw MedTimeBtw MeanInt MedianInt MinInt MaxInt".split()


part(
    "seats",
    ("sig",),
    "select distinct dfm, chamber, side from sig",
)
part(
    "design",
    ("seats",),
    """
select s.dfm, s.chamber, case when (s.dfm + s.chamber) % 2 = 0 then 'Ctrl' else 'Exp' end as Treatment,
       case when s.dfm % 2 = 0 then 'Male' else 'Female' end as Sex,
       coalesce(c_mktsegment, '') as Segment, coalesce(r_name, '') as Region
from (select distinct dfm, chamber from seats) s
left join customer on c_custkey = (s.dfm - 1) * 12 + (s.chamber - 1) * 2
left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""",
)


def well_summary(lab: str, bouts: str, gaps: str, grid: str, bin_of=None, where: str = "true") -> str:
    """Measures per well (and bin): one row for every row of `grid`."""
    b = (lambda m: f", {bin_of(m)} as bin") if bin_of else (lambda m: "")
    k = "dfm, chamber, side" + (", bin" if bin_of else "")
    cond = where
    return f"""
select g.*, coalesce(s.licks, 0.0) as Licks, cast(coalesce(o.n, 0) as double) as Events,
       o.mean as MeanDuration, o.med as MedDuration,
       coalesce(i.mean, 0.0) as MeanTimeBtw, coalesce(i.med, 0.0) as MedTimeBtw,
       s.mean as MeanInt, s.med as MedianInt, s.low as MinInt, s.high as MaxInt,
       coalesce(s.lit, 0.0) as Opto
from {grid} g
left join (select {k}, cast(sum(case when lick then 1 else 0 end) as double) as licks,
                  avg(case when bout is not null then base end) as mean,
                  median(case when bout is not null then base end) as med,
                  min(case when bout is not null then base end) as low,
                  max(case when bout is not null then base end) as high,
                  cast(sum(case when lit then 1 else 0 end) as double) / 1.0 as lit
           from (select * {b('minutes')} from {lab} where {cond}) group by {k}) s using ({k})
left join (select {k}, count(*) as n, avg(duration) as mean, median(duration) as med
           from (select * {b('minutes')} from {bouts} where {cond}) group by {k}) o using ({k})
left join (select {k}, avg(sec) as mean, median(sec) as med
           from (select * {b('minutes')} from {gaps} where {cond}) group by {k}) i using ({k})"""


def two_wells(src: str, more: str = "") -> str:
    """Put A and B of `src` (one row per well) side by side; raw licks."""
    cols = ",\n       ".join(
        f"max(case when side = '{s}' then {c} end) as {c}{s}" for s in "AB" for c in PAIRED
    )
    zero = lambda c: f"coalesce({c}, 0.0)"
    filled = ["Licks", "Events", "MeanTimeBtw", "MedTimeBtw"]
    rep = ", ".join(f"{zero(f'{c}{s}')} as {c}{s}" for s in "AB" for c in filled)
    la, lb, ea, eb = "LicksA", "LicksB", "EventsA", "EventsB"
    return f"""
select *, case when {la} + {lb} > 0 then ({la} - {lb}) / ({la} + {lb}) end as PI,
       case when {ea} + {eb} > 0 then ({ea} - {eb}) / ({ea} + {eb}) end as EventPI
from (select * replace ({rep})
      from (select dfm, chamber{more}, {cols},
                   coalesce(max(case when side = 'A' then Opto end), 0.0) as OptoOn_sec_A,
                   coalesce(max(case when side = 'B' then Opto end), 0.0) as OptoOn_sec_B
            from {src} group by dfm, chamber{more}))"""


def shown_two(alias: str = "", transform: bool = True) -> str:
    a = f"{alias}." if alias else ""
    cols = []
    for c in summary.TWO_WELL_COLUMNS:
        x = f"power({a}{c}, 0.25)" if transform and c.startswith("Licks") else f"{a}{c}"
        cols.append(f"{r6(x)} as {c}")
    return ", ".join(cols)


part("wells", ("lab", "bouts", "gaps", "seats"), well_summary("lab", "bouts", "gaps", "seats"))
part("two", ("wells",), two_wells("wells"))
part(
    "wells_range",
    ("lab", "bouts", "gaps", "seats"),
    well_summary("lab", "bouts", "gaps", "seats", where="minutes > 10 and minutes <= 40"),
)
part("two_range", ("wells_range",), two_wells("wells_range"))


def summary_raw(spark, sf, **kw):
    return summary.feeding_summary(labelled(spark, sf), EVENT_PARAMS, **kw)


@query
def summary_two_well(spark, sf):
    return shown(summary_raw(spark, sf))


oracle(
    "summary_two_well",
    f"select dfm, chamber, {shown_two()}, 0.0::double as StartMin, 0.0::double as EndMin from two",
    "two",
)


@query
def summary_range(spark, sf):
    return shown(summary_raw(spark, sf, start=10, end=40, transform_licks=False))


oracle(
    "summary_range",
    f"""select dfm, chamber, {shown_two(transform=False)}, 10.0::double as StartMin, 40.0::double as EndMin
from two_range""",
    "two_range",
)

ONE_WELL = EVENT_PARAMS.with_updates(chamber_size=1, correct_for_dual_feeding=False, chamber_sets=None)


def single_wells(spark, sf):
    def build():
        rows = baselined(spark, sf).withColumn("chamber", F.col("well")).withColumn(
            "side", F.lit("")
        )
        return detect.detect(rows, ONE_WELL)

    return _once(spark, sf, "single wells", build)


@query
def summary_single(spark, sf):
    return shown(summary.feeding_summary(single_wells(spark, sf), ONE_WELL, two_wells=False))


part(
    "lab_one",
    ("lick1", "links1"),
    """
select p.dfm, p.well as chamber, '' as side, p.well, p.sample, p.minutes, p.base, p.lit,
       p.lick1 as lick, l.first_s as bout
from lick1 p left join links1 l
  on p.dfm = l.dfm and p.well = l.well and p.sample between l.first_s and l.last_s""",
)
part(
    "bouts_one",
    ("lab_one",),
    """
select dfm, chamber, side, well, bout, min(minutes) as minutes, count(*) / 1.0 as duration
from lab_one where bout is not null group by all""",
)
part("gaps_one", ("lab_one",), false_runs("lab_one", "bout is null"))
part("seats_one", ("lab_one",), "select distinct dfm, chamber, side from lab_one")
part(
    "wells_one",
    ("lab_one", "bouts_one", "gaps_one", "seats_one"),
    well_summary("lab_one", "bouts_one", "gaps_one", "seats_one"),
)
SINGLE = ", ".join(
    f"{r6('power(Licks, 0.25)' if c == 'Licks' else 'Opto' if c == 'OptoOn_sec' else c)} as {c}"
    for c in summary.SINGLE_COLUMNS
)
oracle(
    "summary_single",
    f"select dfm, chamber, {SINGLE}, 0.0::double as StartMin, 0.0::double as EndMin from wells_one",
    "wells_one",
)


def summary_designed(spark, sf, **kw):
    return summary.with_design(
        summary_raw(spark, sf, **kw), event_design(spark, sf), ["Sex", "Segment", "Region"]
    )


@query
def summary_treatment(spark, sf):
    return shown(summary_designed(spark, sf))


oracle(
    "summary_treatment",
    f"""select Treatment, Sex, Segment, Region, dfm, chamber, {shown_two()},
       0.0::double as StartMin, 0.0::double as EndMin
from two join design using (dfm, chamber)""",
    "two",
    "design",
)


@query
def factor_groups(spark, sf):
    """Compound treatments written as level lists, split, checked, and labelled."""
    raw = event_design(spark, sf).select(
        *REC,
        "chamber",
        F.when(F.col("dfm") % 5 == 0, F.col("Treatment"))
        .otherwise(F.concat_ws(" , ", "Treatment", "Sex"))
        .alias("raw"),
    )
    name, levels, right = groups.split_levels(F.col("raw"), ["Drug", "Sex"])
    rows = raw.select(
        *REC, "chamber", name.alias("Treatment"), *[c.alias(f) for f, c in levels.items()], right.alias("Valid")
    )
    rows = rows.fillna("", ["Drug", "Sex"])
    return shown(rows.withColumn("Group", groups.group_label(["Drug", "Sex"])))


oracle(
    "factor_groups",
    """select dfm, chamber, case when short then Treatment else Treatment || '_' || Sex end as Treatment,
       Treatment as Drug, case when short then '' else Sex end as Sex, not short as Valid,
       Treatment || ' / ' || case when short then '' else Sex end as "Group"
from (select *, dfm % 5 = 0 as short from design)""",
    "design",
)

# ---- bins ------------------------------------------------------------------


def binned(spark, sf, bins, **kw):
    return summary.binned_summary(labelled(spark, sf), EVENT_PARAMS, bins, **kw)


def regular_bins(scope):
    """Numbered bins of 20 minutes with their edges, per device."""
    top = "max(minutes) over ()" if scope == "experiment" else "max(minutes) over (partition by dfm)"
    return f"""
select s.dfm, s.chamber, s.side, cast(k as bigint) as bin, k * 20.0 as bin_start,
       least((k + 1) * 20.0, m) as bin_end
from seats s join (select distinct dfm, {top} as m from sig) d using (dfm),
     unnest(generate_series(0, cast(ceil(m / 20.0) as bigint) - 1)) as g(k)"""


def bin20(m):
    return f"cast(ceil({m} / 20.0) as bigint) - 1"


for tag, scope in (("", "experiment"), ("_dev", "device")):
    part(f"grid{tag}", ("seats", "sig"), regular_bins(scope))
    part(
        f"bwells{tag}",
        ("lab", "bouts", "gaps", f"grid{tag}"),
        well_summary("lab", "bouts", "gaps", f"grid{tag}", bin20),
    )
    part(f"btwo{tag}", (f"bwells{tag}",), two_wells(f"bwells{tag}", ", bin, bin_start, bin_end"))


@query
def binned_regular(spark, sf):
    """Bins of 20 minutes up to the last minute of each device."""
    bins = summary.Bins(size=20, scope="device")
    return shown(binned(spark, sf, bins))


oracle(
    "binned_regular",
    f"""select '(' || cast(bin_start::double as varchar) || ',' || cast(bin_end::double as varchar) || ']' as Interval,
       {r6('(bin_start + bin_end) / 2.0')} as Minutes, dfm, chamber, bin, {shown_two()},
       {r6('bin_start::double')} as StartMin, {r6('bin_end::double')} as EndMin from btwo_dev""",
    "btwo_dev",
)


@query
def binned_edges(spark, sf):
    """Segments from breakpoints, the last one open."""
    bins = summary.Bins.from_breakpoints([15, 40, 60])
    return shown(binned(spark, sf, bins, transform_licks=False), "Minutes", "EndMin")


part(
    "egrid",
    ("seats",),
    """
select s.*, b.bin, b.a as bin_start, b.label
from seats s, (values (cast(0 as bigint), 0.0, '(0,15]'), (1, 15.0, '(15,40]'), (2, 40.0, '(40,60]'),
                      (3, 60.0, '(60,end]')) b(bin, a, label)""",
)
part(
    "ewells",
    ("lab", "bouts", "gaps", "egrid"),
    well_summary(
        "lab",
        "bouts",
        "gaps",
        "egrid",
        lambda m: f"""cast(case when {m} <= 0 then null when {m} <= 15 then 0 when {m} <= 40 then 1
                           when {m} <= 60 then 2 else 3 end as bigint)""",
    ),
)
part("etwo", ("ewells",), two_wells("ewells", ", bin, bin_start, label"))
oracle(
    "binned_edges",
    f"""select label as Interval, dfm, chamber, bin, {shown_two(transform=False)},
       {r6('bin_start::double')} as StartMin from etwo""",
    "etwo",
)


@query
def device_binned_licks(spark, sf):
    bins = summary.Bins(size=20, scope="device")
    got = summary.device_binned_licks(binned(spark, sf, bins))
    return shown(got)


oracle(
    "device_binned_licks",
    f"""select dfm, chamber,
       '(' || cast(bin_start::double as varchar) || ',' || cast(bin_end::double as varchar) || ']' as Interval,
       {r6('(bin_start + bin_end) / 2.0')} as Minutes,
       {r6('power(LicksA, 0.25) + power(LicksB, 0.25)')} as LicksTotal from btwo_dev""",
    "btwo_dev",
)


def binned_designed(spark, sf, **kw):
    return summary.with_design(
        binned(spark, sf, summary.Bins(size=20), transform_licks=False), event_design(spark, sf), ["Sex"]
    )


part(
    "bdesigned",
    ("btwo", "design"),
    "select *, Treatment || ' / ' || Sex as grp from btwo join design using (dfm, chamber)",
)


def mean_sem(value: str, keys: str, src: str) -> str:
    return f"""
select {keys}, avg(v) as m, stddev_samp(v) as sd, count(*) as n
from (select {keys}, {value} as v from {src}) where v is not null group by {keys}"""


SEM = f"""{r6('m')} as Mean, {r6('sd')} as Std, n as N, {r6('sd / sqrt(n)')} as SEM,
       {r6('m - sd / sqrt(n)')} as Lower, {r6('m + sd / sqrt(n)')} as Upper"""


@query
def binned_treatment(spark, sf):
    """Total licks per group and bin: mean, error, limits, largest n."""
    got = groups.time_course(binned_designed(spark, sf), ["Treatment", "Sex"], "Licks")
    return shown(got, "bin")


oracle(
    "binned_treatment",
    f"""select grp as "Group", {r6('mid')} as Minutes, {SEM},
       grp || ' (n=' || cast(max(n) over (partition by grp) as varchar) || ')' as Label
from ({mean_sem('LicksA + LicksB', 'grp, mid', '(select *, (bin_start + bin_end) / 2.0 as mid from bdesigned)')})""",
    "bdesigned",
)


@query
def multi_metric(spark, sf):
    """Several metrics by time at once, one of them unknown."""
    got = groups.time_courses(
        binned_designed(spark, sf),
        ["Treatment", "Sex"],
        ["Licks", "Events", "MedDuration", "PI", "NoSuchMetric"],
        "mean_ab",
    )
    return shown(got, "bin")


MIDS = "(select *, (bin_start + bin_end) / 2.0 as mid from bdesigned)"
oracle(
    "multi_metric",
    f'select grp as "Group", Metric, {r6("mid")} as Minutes, {SEM} from ('
    + "\nunion all\n".join(
        f"select '{m}' as Metric, * from ({mean_sem(v, 'grp, mid', MIDS)})"
        for m, v in (
            ("Licks", "(LicksA + LicksB) / 2.0"),
            ("Events", "(EventsA + EventsB) / 2.0"),
            ("MedDuration", "(MedDurationA + MedDurationB) / 2.0"),
            ("PI", "PI"),
        )
    )
    + ")",
    "bdesigned",
)

# ---- groups ----------------------------------------------------------------

part("designed", ("two", "design"), "select * from two join design using (dfm, chamber)")


@query
def dot_metric(spark, sf):
    """Median durations per chamber by Treatment and Sex, with group means."""
    rows = groups.dot_rows(
        summary_designed(spark, sf), ["Treatment", "Sex"], "MedDuration", "total"
    )
    means = groups.mean_and_error(rows, ["X", "Facet"], "MetricValue")
    return shown(rows.join(means, ["X", "Facet"]))


part(
    "dots",
    ("designed",),
    """
select dfm, chamber, Treatment as X, Sex as Facet,
       case when MedDurationA is not null or MedDurationB is not null
            then coalesce(MedDurationA, 0.0) + coalesce(MedDurationB, 0.0) end as v
from designed""",
)
oracle(
    "dot_metric",
    f"""select X, Facet, dfm, chamber, {r6('v')} as MetricValue, {SEM}
from dots join ({mean_sem('v', 'X, Facet', 'dots')}) using (X, Facet) where v is not null""",
    "dots",
)


@query
def metric_grid(spark, sf):
    """Mean and error of all eighteen figure metrics per group."""
    rows = groups.metric_grid(summary_designed(spark, sf), ["Treatment", "Sex"])
    return shown(groups.mean_and_error(rows, ["Group", "Metric"], "Value"))


oracle(
    "metric_grid",
    f'select "Group", Metric, {SEM} from ('
    + "\nunion all\n".join(
        f"select '{m}' as Metric, * from ("
        + mean_sem(
            f"power({m}, 0.25)" if m.startswith("Licks") else m,
            '"Group"',
            "(select *, Treatment || ' / ' || Sex as \"Group\" from designed)",
        )
        + ")"
        for m in groups.TWO_WELL_FIGURE
    )
    + ")",
    "designed",
)


@query
def well_melt(spark, sf):
    """A and B under each other with event counts as weights."""
    got = groups.well_rows(
        summary_designed(spark, sf), ["Treatment", "Sex"], "MedDuration", names={"A": "Sucrose", "B": "Yeast"}
    )
    return shown(got)


oracle(
    "well_melt",
    "\nunion all\n".join(
        f"""select Treatment || ' / ' || Sex as "Group", dfm, chamber, 'Well{s}' as Well, '{n}' as WellLabel,
       {r6(f'MedDuration{s}')} as MedDuration, {r6(f'Events{s}')} as Weight from designed"""
        for s, n in (("A", "Sucrose"), ("B", "Yeast"))
    ),
    "designed",
)


@query
def weighted_duration(spark, sf):
    return shown(groups.weighted_durations(summary_designed(spark, sf)))


def weighted_sql(s):
    v, w, ok = f"MedDuration{s}", f"Events{s}", f"MedDuration{s} is not null and Events{s} > 0"
    return f"""
select t.Treatment, {r6(f'avg({v})')} as MeanDuration{s},
       {r6(f'stddev_samp({v}) / sqrt(count({v}))')} as SemDuration{s},
       {r6('any_value(wm)')} as WeightedMeanDuration{s},
       {r6(f'sqrt(sum(case when {ok} then {w} * power({v} - wm, 2) end) / any_value(sw)) / sqrt(any_value(n))')}
         as WeightedSemDuration{s},
       any_value(n) as SampleSize{s}
from designed t join (select Treatment, sum({w} * {v}) / sum({w}) as wm, sum({w}) as sw, count(*) as n
                      from designed where {ok} group by Treatment) g on t.Treatment = g.Treatment
group by t.Treatment"""


oracle(
    "weighted_duration",
    f"select * from ({weighted_sql('A')}) join ({weighted_sql('B')}) using (Treatment)",
    "designed",
)


@query
def metric_modes(spark, sf):
    """All rules of turning A and B into one value, side by side."""
    s = summary_raw(spark, sf, transform_licks=False)
    cols = s.columns
    picks = {
        **{f"show_{m}": groups.display_metric(cols, "MedDuration", m) for m in ("A", "B", "mean_ab", "total")},
        **{f"test_{m}": groups.inference_metric(cols, "MedDuration", m) for m in ("A", "B", "total", "diff")},
        "sweep_licks": groups.sweep_metric(cols, "Licks"),
        "sweep_duration": groups.sweep_metric(cols, "MedDuration"),
        "exact": groups.display_metric(cols, "PI"),
    }
    return shown(s.select("dfm", "chamber", *[c.alias(n) for n, c in picks.items()]))


D = "MedDuration"
oracle(
    "metric_modes",
    f"""select dfm, chamber, {r6(D + 'A')} as show_A, {r6(D + 'B')} as show_B,
       {r6(f'({D}A + {D}B) / 2.0')} as show_mean_ab,
       {r6(f'case when {D}A is not null or {D}B is not null then coalesce({D}A, 0.0) + coalesce({D}B, 0.0) end')} as show_total,
       {r6(D + 'A')} as test_A, {r6(D + 'B')} as test_B, {r6(f'{D}A + {D}B')} as test_total,
       {r6(f'{D}A - {D}B')} as test_diff, {r6('LicksA + LicksB')} as sweep_licks,
       {r6(D + 'A')} as sweep_duration, {r6('PI')} as exact from two""",
    "two",
)


@query
def split_gather(spark, sf):
    """Compound treatment taken apart, A and B gathered by food."""
    s = summary_designed(spark, sf).withColumn("Treatment", F.concat_ws("_", "Treatment", "Segment"))
    apart = groups.separate_treatment(s.drop("Sex", "Segment", "Region"), ["Light", "Sugar"])
    parts = [
        groups.gather_foods(apart, m, "Sugar", "Yeast", ["dfm", "chamber", "Light"]).select(
            "dfm", "chamber", "Light", "Food", F.lit(m).alias("Metric"), F.col(m).alias("Value")
        )
        for m in ("Licks", "Events", "MedDuration")
    ]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]))


oracle(
    "split_gather",
    "\nunion all\n".join(
        f"""select dfm, chamber, Treatment as Light, {food} as Food, '{m}' as Metric,
       {r6(f'power({m}{s}, 0.25)' if m == 'Licks' else f'{m}{s}')} as Value from designed"""
        for m in ("Licks", "Events", "MedDuration")
        for s, food in (("A", "Segment"), ("B", "'Yeast'"))
    ),
    "designed",
)


@query
def slim_summary(spark, sf):
    got = summary.slim_summary(summary_designed(spark, sf), ["Sex"])
    return shown(got)


def r3(x):
    return f"(round(round({x}, 3) + 1e-9, 6) + 0.0)"


oracle(
    "slim_summary",
    "select dfm, chamber, Treatment, Sex, "
    + ", ".join(
        f"{r3(f'power({m}, 0.25)' if m.startswith('Licks') else m)} as {m}" for m in summary.REPORT_TWO_WELL
    )
    + " from designed",
    "designed",
)

# ---- exclusions ------------------------------------------------------------


def exclusion_rows(spark, sf):
    """Named exclusions as they would be read from a file."""
    d = event_design(spark, sf)
    return d.filter((F.col("dfm") * 7 + F.col("chamber")) % 11 == 0).select(
        F.lit("general").alias("group"), "project", "dfm", "chamber", F.lit("").alias("note")
    )


@query
def exclusions(spark, sf):
    d = exclude.without_excluded(event_design(spark, sf), exclusion_rows(spark, sf))
    return shown(summary.with_design(summary_raw(spark, sf), d))


oracle(
    "exclusions",
    f"""select Treatment, dfm, chamber, {shown_two()}, 0.0::double as StartMin, 0.0::double as EndMin
from designed where (dfm * 7 + chamber) % 11 <> 0""",
    "designed",
)


@query
def auto_remove(spark, sf):
    raw = summary_designed(spark, sf, transform_licks=False)
    return shown(exclude.low_lick_chambers(raw, 5.0))


def low_why(names, cut):
    return "concat_ws('; ', " + ", ".join(
        f"case when {n} < {cut} then '{n}=' || cast(cast({n} as bigint) as varchar) || "
        f"' < min_untransformed_licks_cutoff={cut:g}' end"
        for n in names
    ) + ")"


part(
    "low",
    ("designed",),
    f"""
select * from (select dfm, chamber, Treatment, {low_why(['LicksA', 'LicksB'], 5.0)} as Reason from designed)
where Reason <> ''""",
)
oracle("auto_remove", "select dfm, chamber, Treatment, Reason from low", "low")


@query
def auto_remove_hedonic(spark, sf):
    raw = summary_designed(spark, sf, transform_licks=False)
    return shown(exclude.hedonic_chambers(raw, summary_designed(spark, sf), 5.0, 5.5, 6))


def short(x):
    return f"regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\\.$', '')"


WHY = "concat_ws('; ', " + ", ".join(
    f"case when {c}{s} > {lim} then '{c}{s}=' || {short(c + s)} || ' > {name}={lim}' end"
    for c, lim, name in (
        ("MedDuration", 5.5, "max_med_duration_cutoff"),
        ("Events", 6, "max_events_cutoff"),
    )
    for s in "AB"
) + ")"
oracle(
    "auto_remove_hedonic",
    f"""select dfm, chamber, Treatment, Reason from low
union all
select * from (select dfm, chamber, Treatment, {WHY} as Reason from designed anti join low using (dfm, chamber))
where Reason <> ''""",
    "low",
)


@query
def adhoc_filters(spark, sf):
    s = summary_designed(spark, sf, transform_licks=False)
    got = exclude.eating_chambers(s, max_duration=5.0, max_events=5)
    return shown(got.select("dfm", "chamber", "Treatment", "LicksA", "LicksB", "MedDurationA", "EventsB"))


oracle(
    "adhoc_filters",
    f"""select dfm, chamber, Treatment, {r6('LicksA')} as LicksA, {r6('LicksB')} as LicksB,
       {r6('MedDurationA')} as MedDurationA, {r6('EventsB')} as EventsB from designed
where not (LicksA < 0.00001 or LicksB < 0.00001) and coalesce(MedDurationA <= 5.0, true) and EventsB <= 5""",
    "designed",
)

# ---- bout tables -----------------------------------------------------------


@query
def tidy_bouts(spark, sf):
    got = tidy(
        feeding_bouts(labelled(spark, sf), EVENT_PARAMS),
        exclude.without_excluded(event_design(spark, sf), exclusion_rows(spark, sf)),
        ["Sex"],
        {"A": "Sucrose", "B": "Yeast"},
    )
    return shown(got)


oracle(
    "tidy_bouts",
    f"""select b.dfm, b.chamber, well, side as WellLabel, case side when 'A' then 'Sucrose' else 'Yeast' end as WellName,
       coalesce(Treatment, '') as Treatment, {r6('minutes')} as StartMin, licks as Licks, {r6('duration')} as Duration,
       {r6('mean')} as AvgIntensity, {r6('high')} as MaxIntensity, coalesce(Sex, '') as Sex
from bouts b left join (select * from design where (dfm * 7 + chamber) % 11 <> 0) d
  on b.dfm = d.dfm and b.chamber = d.chamber""",
    "bouts",
    "design",
)


@query
def interval_data(spark, sf):
    """Gaps and bouts with chamber and side of their wells."""
    return shown(gaps_and_bouts(spark, sf))


@query
def interval_data_range(spark, sf):
    """The same within (10, 40]."""
    return shown(gaps_and_bouts(spark, sf).filter(within(F.col("Minutes"), 10, 40)))


def gaps_and_bouts(spark, sf):
    rows = labelled(spark, sf)
    gaps = feeding_intervals(rows, EVENT_PARAMS).select(
        F.lit("interval").alias("kind"), "dfm", "chamber", F.concat(F.lit("Well"), "side").alias("TCWell"),
        "well", "Minutes", F.col("IntervalSec").alias("Seconds"),
    )
    runs = feeding_bouts(rows, EVENT_PARAMS).select(
        F.lit("duration").alias("kind"), "dfm", "chamber", F.concat(F.lit("Well"), "side").alias("TCWell"),
        "well", "Minutes", F.col("Duration").alias("Seconds"),
    )
    return gaps.unionByName(runs)


for name, where in (("interval_data", "true"), ("interval_data_range", "minutes > 10 and minutes <= 40")):
    oracle(
        name,
        f"""select kind, dfm, chamber, 'Well' || side as TCWell, well, {r6('minutes')} as Minutes, {r6('sec')} as Seconds
from (select 'interval' as kind, dfm, chamber, side, well, minutes, sec from gaps
      union all select 'duration', dfm, chamber, side, well, minutes, duration from bouts)
where {where}""",
        "gaps",
        "bouts",
    )


@query
def transitions(spark, sf):
    rows = labelled(spark, sf)
    got = count_transitions(feeding_bouts(rows, EVENT_PARAMS), summary.seats_of(rows))
    keyed = got.join(event_design(spark, sf).select(*REC, "chamber", "Treatment"), [*REC, "chamber"], "left")
    return shown(keyed)


oracle(
    "transitions",
    """select g.dfm, g.chamber, g.Treatment, f as FromWell, t as ToWell, coalesce(n, 0) as Count
from (select dfm, chamber, Treatment, f, t from design, (values ('A'), ('B')) x(f), (values ('A'), ('B')) y(t)) g
left join (select dfm, chamber, prev, side, count(*) as n
           from (select *, lag(side) over (partition by dfm, chamber order by bout, side) as prev from bouts)
           where prev is not null group by all) c
  on g.dfm = c.dfm and g.chamber = c.chamber and f = prev and t = side""",
    "bouts",
    "design",
)


@query
def event_bins(spark, sf):
    """Every ten consecutive bouts of a chamber."""
    return shown(event_number_bins(feeding_bouts(labelled(spark, sf), EVENT_PARAMS), 10))


oracle(
    "event_bins",
    f"""select dfm, chamber, (nr - 1) // 10 as EventBin, {r6('min(minutes)')} as FirstMin, {r6('max(minutes)')} as LastMin,
       count(*) filter (side = 'A') as EventsA, count(*) filter (side = 'B') as EventsB,
       cast(coalesce(sum(licks) filter (side = 'A'), 0) as bigint) as LicksA,
       cast(coalesce(sum(licks) filter (side = 'B'), 0) as bigint) as LicksB,
       {r6('avg(duration)')} as MeanDuration
from (select *, row_number() over (partition by dfm, chamber order by bout, side) as nr from bouts)
group by dfm, chamber, (nr - 1) // 10""",
    "bouts",
)
