"""Statistics, sweeps, comparisons, the basic analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutspark.operators import compare, groups, stats, summary
from boutspark.params import REC
from boutspark.plans.experiment import basic_analysis as analyse, parameter_sweep
from boutspark.sources.tables import EVENT_PARAMS, EVENT_WINDOW, event_design, event_recording
from checks.oracle import detection, oracle, part, r6
from checks.q_series import OTHER, BREAK_RATE, clocked
from checks.q_summary import binned_designed, summary_designed, two_wells, well_summary
from checks.queries import query
from checks.workspace import baselined, labelled, shown

part(
    "grouped",
    ("designed",),
    "select *, Treatment || ' / ' || Sex as grp, LicksA + LicksB as total from designed",
)


def observed(spark, sf):
    s = summary_designed(spark, sf, transform_licks=False)
    return s.withColumn("Group", groups.group_label(["Treatment", "Sex"])).withColumn(
        "Total", F.col("LicksA") + F.col("LicksB")
    )


@query
def bootstrap(spark, sf):
    """Interval of the mean preference per group, 2000 resamples of its chambers."""
    rows = observed(spark, sf).withColumn("Value", groups.inference_metric(["PI"], "PI"))
    return shown(stats.bootstrap(rows, ["dfm", "chamber"], n_boot=2000, seed=7).summary)


oracle(
    "bootstrap",
    f"""select grp as "Group", n, {r6('m')} as mean, {r6('se')} as sem, {r6('lo')} as ci_low, {r6('hi')} as ci_high
from (select grp, count(*) as n, avg(PI) as m, stddev_samp(PI) / sqrt(count(*)) as se
      from grouped where PI is not null group by grp)
join (select grp, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi
      from (select d.grp, d.it, avg(v.PI) as m
            from (select grp, n, it, ('0x' || substr(md5(concat_ws(':', '7', grp, cast(it as varchar), cast(nr as varchar))), 1, 8))::bigint % n as pick
                  from (select *, count(*) over (partition by grp) as n from ranked), unnest(generate_series(0, 1999)) as g(it)) d
            join ranked v on v.grp = d.grp and v.nr = d.pick group by d.grp, d.it) group by grp) using (grp)""",
    "ranked",
)
part(
    "ranked",
    ("grouped",),
    """
select grp, PI, row_number() over (partition by grp order by dfm, chamber) - 1 as nr
from grouped where PI is not null""",
)


def one_way_sql(y: str, factor: str, src: str, keys: str = "", term: str | None = None) -> str:
    k = f"{keys}, " if keys else ""
    over = f"partition by {keys}" if keys else ""
    return f"""
select {k}unnest(['{term or factor}', 'Residual']) as term, unnest([ssb, ssw]) as ss,
       unnest([dfb, dfw]) as df, unnest([case when dfb > 0 and dfw > 0 and ssw > 0 then (ssb / dfb) / (ssw / dfw) end, null]) as f
from (select {k}sum(power(m - g, 2)) as ssb, cast(count(distinct lv) - 1 as double) as dfb,
             sum(power(y - m, 2)) as ssw, cast(count(*) - count(distinct lv) as double) as dfw
      from (select {k}{factor} as lv, {y} as y, avg({y}) over (partition by {k}{factor}) as m, avg({y}) over ({over}) as g
            from {src} where {y} is not null) {'group by ' + keys if keys else ''})"""


ANOVA = f"{r6('ss')} as sum_sq, {r6('df')} as df, {r6('f')} as F"


@query
def anova_oneway(spark, sf):
    return shown(stats.anova_one_way(observed(spark, sf), "Total", "Treatment"), "p")


oracle("anova_oneway", f"select term, {ANOVA} from ({one_way_sql('total', 'Treatment', 'grouped')})", "grouped")


@query
def anova_two_way(spark, sf):
    return shown(stats.anova(observed(spark, sf), "Total", ["Treatment", "Sex"]), "p")


def given(y: str, a: str, b: str, src: str, w: str = "1.0") -> str:
    """Squares of the two-level factor `a` after `b`, by centring within `b`."""
    return f"""
(select power(sum(w * (x - xm) * (y - ym)), 2) / sum(w * power(x - xm, 2))
 from (select x, y, w, sum(w * x) over p / sum(w) over p as xm, sum(w * y) over p / sum(w) over p as ym
       from (select case when {a} = (select min({a}) from {src}) then 0.0 else 1.0 end as x, {y} as y, {b} as b, {w} as w
             from {src}) window p as (partition by b)))"""


def left_after(y: str, cols: str, src: str, w: str = "1.0") -> str:
    return f"""
(select sum(w * power(y - m, 2)) from (select {y} as y, {w} as w,
   sum({w} * {y}) over (partition by {cols}) / sum({w}) over (partition by {cols}) as m from {src}))"""


oracle(
    "anova_two_way",
    f"""select unnest(['Treatment', 'Sex', 'Treatment:Sex', 'Residual']) as term,
       unnest([{r6('a')}, {r6('b')}, {r6('ab')}, {r6('rest')}]) as sum_sq,
       unnest([1.0::double, 1.0::double, k - 3.0::double, n - k]) as df,
       unnest([{r6('a / (rest / (n - k))')}, {r6('b / (rest / (n - k))')},
              case when k > 3 then {r6('ab / (k - 3) / (rest / (n - k))')} end, null]) as F
from (select *, within_b - a - rest as ab
      from (select {given('total', 'Treatment', 'Sex', 'grouped')} as a,
                   {given('total', 'Sex', 'Treatment', 'grouped')} as b,
                   {left_after('total', 'Treatment, Sex', 'grouped')} as rest,
                   {left_after('total', 'Sex', 'grouped')} as within_b,
                   (select count(*)::double from grouped) as n,
                   (select count(distinct Treatment || Sex)::double from grouped) as k))""",
    "grouped",
)


@query
def anova_binned(spark, sf):
    """One analysis per time bin."""
    rows = binned_designed(spark, sf).withColumn("Total", F.col("LicksA") + F.col("LicksB"))
    return shown(stats.anova_one_way(rows, "Total", "Treatment", ["Interval"]), "p")


oracle(
    "anova_binned",
    f"""select Interval, term, {ANOVA}
from ({one_way_sql('total', 'Treatment', 'binned', 'Interval')})""",
    "binned",
)
part(
    "binned",
    ("bdesigned",),
    """
select *, LicksA + LicksB as total,
       '(' || cast(cast(bin_start as bigint) as varchar) || ',' || cast(cast(bin_end as bigint) as varchar) || ']' as Interval
from bdesigned""",
)


@query
def device_effect(spark, sf):
    """The device as a category and as a number, which is not the same."""
    rows = observed(spark, sf)
    cat = stats.anova_one_way(rows, "Total", "dfm").withColumn("model", F.lit("category"))
    num = stats.regression_anova(rows, "Total", "dfm").withColumn("model", F.lit("number"))
    return shown(cat.unionByName(num), "p")


oracle(
    "device_effect",
    f"""select 'category' as model, term, {ANOVA} from ({one_way_sql('total', 'dfm', 'grouped')})
union all
select 'number', unnest(['dfm', 'Residual']), unnest([{r6('ssb')}, {r6('ssw')}]), unnest([1.0::double, n - 2.0::double]),
       unnest([{r6('ssb / (ssw / (n - 2))')}, null])
from (select *, syy - ssb as ssw
      from (select power(regr_sxy(total, dfm), 2) / regr_sxx(total, dfm) as ssb, regr_syy(total, dfm) as syy,
                   count(*)::double as n from grouped))""",
    "grouped",
)


@query
def anova_weighted(spark, sf):
    """Additive block, treatment, interaction; weighted by event counts, in order."""
    terms = [("Sex",), ("Treatment",), ("Sex", "Treatment")]
    got = stats.weighted_anova(
        observed(spark, sf), "MedDurationA", "EventsA", ["Sex", "Treatment"], terms
    )
    return shown(got, "p")


part("weighed", ("grouped",), "select * from grouped where MedDurationA is not null and EventsA > 0")
Y, W = "MedDurationA", "EventsA"
oracle(
    "anova_weighted",
    f"""select unnest(['Sex', 'Treatment', 'Sex:Treatment', 'Residual']) as term,
       unnest([{r6('a')}, {r6('b')}, {r6('ab')}, {r6('rest')}]) as sum_sq,
       unnest([1.0::double, 1.0::double, k - 3.0::double, n - k]) as df,
       unnest([{r6('a / (rest / (n - k))')}, {r6('b / (rest / (n - k))')},
              case when k > 3 then {r6('ab / (k - 3) / (rest / (n - k))')} end, null]) as F
from (select *, whole - within_sex as a, within_sex - b - rest as ab
      from (select {left_after(Y, '1', 'weighed', W)} as whole,
                   {left_after(Y, 'Sex', 'weighed', W)} as within_sex,
                   {given(Y, 'Treatment', 'Sex', 'weighed', W)} as b,
                   {left_after(Y, 'Treatment, Sex', 'weighed', W)} as rest,
                   (select count(*)::double from weighed) as n,
                   (select count(distinct Treatment || Sex)::double from weighed) as k))""",
    "weighed",
)


@query
def trend(spark, sf):
    """Median duration of A on its event count per treatment."""
    return shown(stats.trend(observed(spark, sf), "MedDurationA", "EventsA", ["Treatment"]))


oracle(
    "trend",
    f"""select Treatment, {r6(f'regr_slope({Y}, {W})')} as slope, {r6(f'regr_intercept({Y}, {W})')} as intercept,
       {r6(f'regr_r2({Y}, {W})')} as r2, cast(regr_count({Y}, {W}) as bigint) as n from grouped group by Treatment""",
    "grouped",
)


@query
def tukey(spark, sf):
    """Mean differences of all pairs of groups."""
    got = stats.tukey(observed(spark, sf), "Total", "Group")
    return shown(got.select("group1", "group2", "meandiff"))


oracle(
    "tukey",
    f"""select a.grp as group1, b.grp as group2, {r6('b.m - a.m')} as meandiff
from (select grp, avg(total) as m from grouped group by grp) a
join (select grp, avg(total) as m from grouped group by grp) b on a.grp < b.grp""",
    "grouped",
)


@query
def tukey_tails(spark, sf):
    """Adjusted p-values and limits (tails are checked against tables in tests)."""
    return shown(stats.tukey(observed(spark, sf), "Total", "Group"))


@query
def lmm(spark, sf):
    """Treatment by sex with a random intercept per device."""
    return shown(stats.mixed_model(observed(spark, sf), "Total", ["Treatment", "Sex"]))


@query
def compare_treatments(spark, sf):
    """The full result with p-values, table and pairs under each other."""
    got = stats.compare_treatments(observed(spark, sf), "Total", ["Treatment"])
    table = got.table.select("term", F.col("sum_sq").alias("estimate"), "p")
    pairs = got.posthoc.select(
        F.concat_ws(" - ", "group2", "group1").alias("term"),
        F.col("meandiff").alias("estimate"),
        F.col("p_adj").alias("p"),
    )
    return shown(table.unionByName(pairs))


# P(F > f) with one degree of freedom between is an incomplete beta function, integrated
# over the angle by Simpson's rule; for two groups the range test has the same tail.
oracle(
    "compare_treatments",
    f"""select * from (
with m as ({one_way_sql('total', 'Treatment', 'grouped')}),
     v as (select max(f) as f, max(case when term = 'Residual' then df end) as d from m),
     x as (select asin(sqrt(d / (d + f))) as top, d - 1 as e,
                  exp(lgamma(d / 2) + lgamma(0.5) - lgamma(d / 2 + 0.5)) as b from v),
     p as (select 2 * max(top) / 20000 / 3 / max(b)
                  * sum(case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end * power(sin(top * i / 20000), e)) as p
           from x, generate_series(0, 20000) as t(i))
select term, {r6('ss')} as estimate, case when term = 'Treatment' then {r6('p')} end as p from m, p
union all
select 'Exp - Ctrl', {r6("avg(total) filter (Treatment = 'Exp') - avg(total) filter (Treatment = 'Ctrl')")}, {r6('max(p)')}
from grouped, p)""",
    "grouped",
)

# ---- sweeps and comparisons --------------------------------------------------


def sweep(spark, sf, field, values):
    got = parameter_sweep(
        event_recording(spark, sf),
        event_design(spark, sf),
        EVENT_PARAMS,
        field,
        values,
        factors=["Treatment", "Sex"],
        window=EVENT_WINDOW,
    )
    return shown(got)


def add_summary(tag: str, seats: str = "seats") -> None:
    part(
        f"wells{tag}",
        (f"lab{tag}", f"bouts{tag}", f"gaps{tag}", seats),
        well_summary(f"lab{tag}", f"bouts{tag}", f"gaps{tag}", seats),
    )
    part(f"two{tag}", (f"wells{tag}",), two_wells(f"wells{tag}"))


def sweep_sql(cases: list[tuple[float, str]]) -> str:
    licks = "power(LicksA, 0.25) + power(LicksB, 0.25)"
    cols = ", ".join(
        f"{r6(f'avg({x})')} as mean_{m}, {r6(f'stddev_samp({x}) / sqrt(count({x}))')} as sem_{m}"
        for m, x in (("Licks", licks), ("Events", "EventsA + EventsB"), ("MedDuration", "MedDurationA"))
    )
    return "\nunion all\n".join(
        f"""select {v}::double as sweep_value, Treatment || ' / ' || Sex as "Group", count(*) as n_chambers, {cols}
from {two} join design using (dfm, chamber) group by Treatment, Sex"""
        for v, two in cases
    )


detection("_g0", "bas", gap=0)
detection("_g5", "bas", gap=5)
detection("_t40", "bas", high="40")
for level in ("10", "35"):
    detection(f"_m{level}", "bas", low=level)
for w in (5, 11, 21, 41, 81):
    part(
        f"bas_w{w}",
        ("sig",),
        f"""
select *, signal - median(signal) over (partition by dfm, well order by sample
                                        rows between {w // 2} preceding and {w // 2} following) as base
from sig""",
    )
    detection(f"_w{w}", f"bas_w{w}")
for t in ("_g0", "_g5", "_t40", "_other", "_m10", "_m35", "_w5", "_w11", "_w21", "_w41", "_w81"):
    add_summary(t)


@query
def sweep_link_gap(spark, sf):
    return sweep(spark, sf, "feeding_event_link_gap", [0, 2, 5])


oracle(
    "sweep_link_gap",
    sweep_sql([(0.0, "two_g0"), (2.0, "two"), (5.0, "two_g5")]),
    "two_g0",
    "two",
    "two_g5",
    "design",
)


@query
def sweep_threshold(spark, sf):
    return sweep(spark, sf, "feeding_threshold", [40, 60])


oracle("sweep_threshold", sweep_sql([(40.0, "two_t40"), (60.0, "two")]), "two_t40", "two", "design")


@query
def sweep_minimum(spark, sf):
    """Lower levels nest: runs above each come from one read."""
    return sweep(spark, sf, "feeding_minimum", [10, 20, 35])


oracle(
    "sweep_minimum",
    sweep_sql([(10.0, "two_m10"), (20.0, "two"), (35.0, "two_m35")]),
    "two_m10",
    "two",
    "two_m35",
    "design",
)

# window lengths in samples at one sample a second
WINDOWS = (5, 11, 21, 41, 81)


@query
def sweep_window(spark, sf):
    """Five baseline windows from one structure."""
    got = parameter_sweep(
        event_recording(spark, sf),
        event_design(spark, sf),
        EVENT_PARAMS,
        "baseline_window_minutes",
        [w / 60.0 for w in WINDOWS],
        factors=["Treatment", "Sex"],
    )
    return shown(got.withColumn("sweep_value", F.col("sweep_value") * 60.0))


oracle(
    "sweep_window",
    sweep_sql([(float(w), f"two_w{w}") for w in WINDOWS]),
    *[f"two_w{w}" for w in WINDOWS],
    "design",
)


@query
def compare_two(spark, sf):
    """Two detections of the same recording."""
    d = event_design(spark, sf)
    params = EVENT_PARAMS.with_updates(**OTHER)
    a = summary_designed(spark, sf)
    b = summary.with_design(
        summary.feeding_summary(labelled(spark, sf, params), params), d, ["Sex"]
    )
    return shown(compare.compare_experiments(a, b, ["Treatment", "Sex"]))


def mean_sql(two: str, where: str = "true") -> str:
    return "\nunion all\n".join(
        f"""select Treatment || ' / ' || Sex as grp, '{m}' as metric, avg({x}) as m, count({x}) as n
from {two} join design using (dfm, chamber) where {where} group by Treatment, Sex"""
        for m, x in (
            ("Licks", "power(LicksA, 0.25) + power(LicksB, 0.25)"),
            ("Events", "EventsA + EventsB"),
            ("MedDuration", "MedDurationA"),
        )
    )


oracle(
    "compare_two",
    f"""select grp as "Group", metric as Metric, {r6('a.m')} as mean_a, {r6('b.m')} as mean_b, {r6('b.m - a.m')} as delta,
       {r6('case when a.m <> 0 then (b.m - a.m) / a.m * 100.0 end')} as pct_change,
       coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b
from ({mean_sql('two')}) a
full join ({mean_sql('two_other')}) b using (grp, metric)""",
    "two",
    "two_other",
    "design",
)


@query
def basic_analysis(spark, sf):
    """What the one-call analysis finds, per device."""
    clock = clocked(spark, sf).select(*REC, "well", "chunk", "pos", "seconds")
    base = baselined(spark, sf).join(clock, [*REC, "well", "chunk", "pos"])
    found = analyse(
        base,
        labelled(spark, sf),
        event_design(spark, sf),
        EVENT_PARAMS.with_updates(samples_per_second=BREAK_RATE),
        factors=["Sex"],
        hedonic=True,
    )
    per = found.overview.filter("dfm is not null")
    for df, name, agg in (
        (found.breaks, "breaks", F.count(F.lit(1))),
        (found.bouts, "bouts", F.count(F.lit(1))),
        (found.intervals, "gaps", F.count(F.lit(1))),
        (found.summary, "licks", F.sum(F.pow("LicksA", F.lit(4.0)) + F.pow("LicksB", F.lit(4.0)))),
        (found.integrity, "wells", F.count(F.lit(1))),
        (found.integrity, "flagged", F.sum("Flagged")),
        (found.integrity, "elapsed", F.round(F.sum("Elapsed"), 2)),
        (found.bleeding, "bleeding_rows", F.count(F.lit(1))),
        (found.well_rows, "well_rows", F.count(F.lit(1))),
    ):
        per = per.join(df.groupBy(*REC).agg(agg.alias(name)), list(REC), "left")
    return shown(per.fillna(0, ["breaks", "bouts", "gaps"]))


oracle(
    "basic_analysis",
    f"""select s.dfm, n as "Rows", {r6('f')} as FirstMin, {r6('l')} as LastMin,
       coalesce(b.c, 0) as breaks, coalesce(o.c, 0) as bouts,
       coalesce(g.c, 0) as gaps, {r6('t.licks')} as licks, s.wells, i.flagged, {r6('i.elapsed')} as elapsed, cast(12 as bigint) as bleeding_rows, t.c * 2 as well_rows
from (select dfm, count(*) as n, min(minutes) as f, max(minutes) as l, count(distinct well) as wells from sig group by dfm) s
join (select dfm, cast(sum(f) as bigint) as flagged, round(sum(e), 2) as elapsed
      from (select dfm, well, count(*) filter (error_code <> 0) as f,
                   (epoch_us(arg_max(ts, sample)) - epoch_us(arg_min(ts, sample))) / 60e6 as e from sig group by dfm, well)
      group by dfm) i on s.dfm = i.dfm
left join (select dfm, count(*) as c from steps where step > 86400 group by dfm) b on s.dfm = b.dfm
left join (select dfm, count(*) as c from bouts group by dfm) o on s.dfm = o.dfm
left join (select dfm, count(*) as c from gaps group by dfm) g on s.dfm = g.dfm
left join (select dfm, sum(LicksA + LicksB) as licks, count(*) as c from designed group by dfm) t on s.dfm = t.dfm""",
    "steps",
    "bouts",
    "gaps",
    "designed",
)
