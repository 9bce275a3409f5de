"""Feeding summaries per chamber, over a range or in time bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.functions.scalars import lick_transform, minute_label, preference, within
from boutspark.operators.bouts import feeding_bouts, feeding_intervals
from boutspark.operators.medians import group_median
from boutspark.params import REC, Settings, carried, value

# Columns of a summary, in order.
SINGLE_COLUMNS = (
    "Licks",
    "Events",
    "MeanDuration",
    "MedDuration",
    "MeanTimeBtw",
    "MedTimeBtw",
    "MeanInt",
    "MedianInt",
    "MinInt",
    "MaxInt",
    "OptoOn_sec",
)
# base names that have an A and a B column in two-well summaries
PAIRED_COLUMNS = SINGLE_COLUMNS[:-1]
TWO_WELL_COLUMNS = [
    "PI",
    "EventPI",
    *[f"{c}{s}" for c in PAIRED_COLUMNS for s in "AB"],
    "OptoOn_sec_A",
    "OptoOn_sec_B",
]


# ---- time bins -----------------------------------------------------------


class Bins:
    """Half-open bins (a, b] of minutes: regular ones or explicit edges."""

    def __init__(
        self,
        size: float | None = None,
        edges: Sequence[float] | None = None,
        start: float = 0.0,
        end: float | None = None,
        scope: str = "experiment",
    ) -> None:
        if (size is None) == (edges is None):
            raise ValueError("give either a bin size or bin edges")
        if size is not None and size <= 0:
            raise ValueError("the bin size must be positive")
        if edges is not None:
            edges = [float(e) for e in edges]
            if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
                raise ValueError("bin edges must be at least two, strictly increasing")
        if end is not None and end <= start:
            raise ValueError("the end of a range must lie after its start")
        if scope not in ("experiment", "device"):
            raise ValueError("scope must be 'experiment' or 'device'")
        self.size, self.edges, self.start, self.end, self.scope = size, edges, float(start), end, scope

    @classmethod
    def from_breakpoints(cls, breakpoints: Sequence[float]) -> Bins:
        """n breakpoints make n + 1 segments, the last one open to the end."""
        points = [float(b) for b in breakpoints]
        if not points or points[0] <= 0:
            raise ValueError("breakpoints must be positive")
        return cls(edges=[0.0, *points, float("inf")])

    def number(self, minutes: Column) -> Column:
        """Bin of a minute, compared with the real edges; null outside."""
        if self.edges is not None:
            grid = F.array(*[F.lit(e) for e in self.edges])
            below = F.size(F.filter(grid, lambda e: e < minutes)) - 1
            return F.when((below >= 0) & (minutes <= self.edges[-1]), below.cast("bigint"))
        size, start = float(self.size), self.start
        guess = F.ceil((minutes - start) / size) - 1
        edge = lambda k: F.lit(start) + k * size
        exact = (
            F.when(minutes <= edge(guess), guess - 1)
            .when(minutes > edge(guess + 1), guess + 1)
            .otherwise(guess)
        )
        inside = minutes > start
        if self.end is not None:
            inside = inside & (minutes <= float(self.end))
        return F.when(inside, exact.cast("bigint"))

    def grid(self, seats: DataFrame, labelled: DataFrame, by: Sequence[str]) -> DataFrame:
        """Every seat with every bin (`bin`, `bin_start`, `bin_end`), empty ones too."""
        if self.edges is not None:
            pairs = F.array(
                *[
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                    for a, b in zip(self.edges, self.edges[1:])
                ]
            )
            spread = seats.select("*", F.posexplode(pairs).alias("bin", "_e"))
            return spread.select(
                *seats.columns,
                F.col("bin").cast("bigint").alias("bin"),
                F.col("_e.a").alias("bin_start"),
                F.col("_e.b").alias("bin_end"),
            )
        if self.end is not None:
            spread = seats.withColumn("_end", F.lit(float(self.end)))
        else:
            scope = list(by) if self.scope == "device" else [c for c in by if c != "dfm"]
            longest = labelled.groupBy(*scope).agg(F.max("minutes").alias("_end"))
            spread = seats.join(longest, scope)
        size, tiny = float(self.size), 1e-9
        # a last bin that is short ends with the recording
        full = F.floor((F.col("_end") + tiny - self.start) / size)
        more = F.when(F.lit(self.start) + full * size < F.col("_end"), 1).otherwise(0)
        spread = (
            spread.withColumn("_bins", full + more)
            .filter("_bins > 0")
            .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_bins") - 1)))
        )
        start = F.lit(self.start) + F.col("bin") * size
        stop = F.when(F.col("bin") < full, start + size).otherwise(F.col("_end"))
        return spread.select(*seats.columns, "bin", start.alias("bin_start"), stop.alias("bin_end"))


def bin_label(scope: str) -> Column:
    a, b = F.col("bin_start"), F.col("bin_end")
    if scope == "device":
        return F.concat(F.lit("("), a.cast("string"), F.lit(","), b.cast("string"), F.lit("]"))
    return F.concat(F.lit("("), minute_label(a), F.lit(","), minute_label(b), F.lit("]"))


# ---- summaries -----------------------------------------------------------


def seats_of(labelled: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    return labelled.select(*by, "chamber", "side").distinct()


def _facts(
    labelled: DataFrame, settings: Settings, by: Sequence[str], keep, slots: list[str]
) -> DataFrame:
    """Everything a summary counts, as rows of one table.

    Samples arrive already aggregated per well, bouts and gaps one row each.
    Putting them under each other lets one shuffle serve all measures.
    """
    keys = [*by, "chamber", "side", *slots]
    samples = keep(labelled, "minutes")
    in_bout = F.when(F.col("bout").isNotNull(), F.col("base"))
    extra = carried(settings, "samples_per_second")
    counted = (
        samples.groupBy(*keys, *extra)
        .agg(
            F.sum(F.col("lick").cast("bigint")).alias("licks"),
            F.avg(in_bout).alias("mean_int"),
            F.min(in_bout).alias("min_int"),
            F.max(in_bout).alias("max_int"),
            F.sum(F.col("lit").cast("bigint")).alias("_lit"),
        )
        .withColumn("lit_sec", F.col("_lit") / value(settings, "samples_per_second"))
        .drop("_lit", *extra)
    )
    median = group_median(
        samples.filter(F.col("bout").isNotNull()).select(*keys, "base"), keys, "base", "median_int"
    )
    bouts = keep(feeding_bouts(labelled, settings, by), "Minutes").select(
        *keys, F.col("Duration").alias("duration")
    )
    gaps = keep(feeding_intervals(labelled, settings, by), "Minutes").select(
        *keys, F.col("IntervalSec").alias("gap")
    )
    facts = counted
    for other in (median, bouts, gaps):
        facts = facts.unionByName(other, allowMissingColumns=True)
    return facts


def _measures(side: str | None) -> dict[str, Column]:
    """The measures of one well; without a side, of the whole chamber."""

    def pick(name: str) -> Column:
        return F.col(name) if side is None else F.when(F.col("side") == side, F.col(name))

    zero = F.lit(0.0)
    return {
        "Licks": F.coalesce(F.max(pick("licks")).cast("double"), zero),
        "Events": F.count(pick("duration")).cast("double"),
        "MeanDuration": F.avg(pick("duration")),
        "MedDuration": F.median(pick("duration")),
        "MeanTimeBtw": F.coalesce(F.avg(pick("gap")), zero),
        "MedTimeBtw": F.coalesce(F.median(pick("gap")), zero),
        "MeanInt": F.max(pick("mean_int")),
        "MedianInt": F.max(pick("median_int")),
        "MinInt": F.max(pick("min_int")),
        "MaxInt": F.max(pick("max_int")),
        "OptoOn_sec": F.coalesce(F.max(pick("lit_sec")), zero),
    }


def _finish(facts: DataFrame, keys: list[str], two_wells: bool, transform: bool) -> DataFrame:
    if not two_wells:
        out = facts.groupBy(*keys).agg(*[c.alias(n) for n, c in _measures(None).items()])
        return out.withColumn("Licks", lick_transform(F.col("Licks"))) if transform else out
    cols = [
        c.alias(f"{n}_{s}" if n == "OptoOn_sec" else f"{n}{s}")
        for s in "AB"
        for n, c in _measures(s).items()
    ]
    out = (
        facts.groupBy(*keys)
        .agg(*cols)
        .withColumn("PI", preference(F.col("LicksA"), F.col("LicksB")))
        .withColumn("EventPI", preference(F.col("EventsA"), F.col("EventsB")))
    )
    if transform:
        for s in "AB":
            out = out.withColumn(f"Licks{s}", lick_transform(F.col(f"Licks{s}")))
    return out


def feeding_summary(
    labelled: DataFrame,
    settings: Settings,
    by: Sequence[str] = REC,
    *,
    two_wells: bool = True,
    start: float | None = None,
    end: float | None = None,
    transform_licks: bool = True,
) -> DataFrame:
    """One row per chamber; a range (start, end] applies to samples and starts."""

    def keep(df: DataFrame, minutes: str) -> DataFrame:
        return df.filter(within(F.col(minutes), start, end))

    facts = _facts(labelled, settings, by, keep, []).unionByName(
        seats_of(labelled, by), allowMissingColumns=True
    )
    out = _finish(facts, [*by, "chamber"], two_wells, transform_licks)
    names = TWO_WELL_COLUMNS if two_wells else SINGLE_COLUMNS
    return out.select(
        *by,
        "chamber",
        *names,
        F.lit(float(start or 0.0)).alias("StartMin"),
        F.lit(float(end) if end is not None else 0.0).alias("EndMin"),
    )


def binned_summary(
    labelled: DataFrame,
    settings: Settings,
    bins: Bins,
    by: Sequence[str] = REC,
    *,
    two_wells: bool = True,
    transform_licks: bool = True,
) -> DataFrame:
    """The feeding summary in every bin at once; the bin is part of the key.

    Samples belong to the bin of their minute, bouts and gaps to the bin of
    their start. Chambers appear in every bin.
    """

    def keep(df: DataFrame, minutes: str) -> DataFrame:
        return df.withColumn("bin", bins.number(F.col(minutes))).filter(F.col("bin").isNotNull())

    grid = bins.grid(seats_of(labelled, by), labelled, by)
    facts = _facts(labelled, settings, by, keep, ["bin"]).unionByName(
        grid.select(*by, "chamber", "side", "bin"), allowMissingColumns=True
    )
    out = _finish(facts, [*by, "chamber", "bin"], two_wells, transform_licks)
    edges = grid.select(*by, "chamber", "bin", "bin_start", "bin_end").distinct()
    names = TWO_WELL_COLUMNS if two_wells else SINGLE_COLUMNS
    return out.join(edges, [*by, "chamber", "bin"]).select(
        bin_label(bins.scope).alias("Interval"),
        ((F.col("bin_start") + F.col("bin_end")) / 2.0).alias("Minutes"),
        *by,
        "chamber",
        "bin",
        *names,
        F.col("bin_start").alias("StartMin"),
        F.col("bin_end").alias("EndMin"),
    )


def device_binned_licks(binned: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Licks of both wells per chamber and bin."""
    total = F.col("LicksA") + F.col("LicksB") if "LicksA" in binned.columns else F.col("Licks")
    return binned.select(*by, "chamber", "Interval", "Minutes", total.alias("LicksTotal"))


def with_design(
    summary: DataFrame,
    design: DataFrame,
    factors: Sequence[str] = (),
    by: Sequence[str] = REC,
) -> DataFrame:
    """Treatment (and factors after it); chambers without treatment drop out."""
    keys = [c for c in by if c in design.columns]
    wanted = design.select(*keys, "chamber", "Treatment", *factors)
    lead = [c for c in ("Interval", "Minutes") if c in summary.columns]
    rest = [c for c in summary.columns if c not in (*lead, *keys, "chamber")]
    joined = summary.join(wanted, [*keys, "chamber"])
    return joined.select(
        *lead,
        "Treatment",
        *[F.coalesce(f, F.lit("")).alias(f) for f in factors],
        *keys,
        "chamber",
        *rest,
    )


# Columns of a printed report, in order.
REPORT_TWO_WELL = (
    "PI",
    "EventPI",
    "LicksA",
    "LicksB",
    "EventsA",
    "EventsB",
    "MedDurationA",
    "MedDurationB",
)
REPORT_SINGLE = ("Licks", "Events", "MedDuration", "MeanInt", "MedTimeBtw")


def slim_summary(
    summary: DataFrame,
    factors: Sequence[str] = (),
    by: Sequence[str] = REC,
    rows: int | None = None,
) -> DataFrame:
    """The columns of a printed report, sorted by treatment and chamber.

    Numbers have three digits; `rows` keeps the first lines only (top-k).
    """
    measures = REPORT_TWO_WELL if "PI" in summary.columns else REPORT_SINGLE
    out = summary.orderBy("Treatment", *by, "chamber").select(
        *by, "chamber", "Treatment", *factors, *[F.round(m, 3).alias(m) for m in measures]
    )
    return out if rows is None else out.limit(rows)
