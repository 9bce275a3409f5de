"""Removing chambers, by name or by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.params import REC

# Names of the limits as they appear in reasons.
MIN_LICKS = "min_untransformed_licks_cutoff"
MAX_DURATION = "max_med_duration_cutoff"
MAX_EVENTS = "max_events_cutoff"


def without_excluded(
    df: DataFrame, exclusions: DataFrame, group: str = "general", by: Sequence[str] = REC
) -> DataFrame:
    """Drop the chambers named in one exclusion group."""
    keys = [c for c in (*by, "chamber") if c in exclusions.columns]
    return df.join(exclusions.filter(F.col("group") == group).select(*keys), keys, "left_anti")


def _number(c: Column) -> Column:
    """Up to six significant digits, without trailing zeros."""
    scale = F.when(c == 0, F.lit(1.0)).otherwise(
        F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.abs(c))))
    )
    short = F.regexp_replace(F.format_string("%.6f", F.rint(c * scale) / scale), "0+$", "")
    return F.regexp_replace(short, "\\.$", "")


def _failed(df: DataFrame, reasons: list[Column], by: Sequence[str]) -> DataFrame:
    given = F.array_compact(F.array(*reasons))
    return (
        df.withColumn("_why", given)
        .filter(F.size("_why") > 0)
        .select(*by, "chamber", "Treatment", F.array_join("_why", "; ").alias("Reason"))
    )


def low_lick_chambers(
    summary: DataFrame, cutoff: float | None, by: Sequence[str] = REC
) -> DataFrame:
    """Chambers with a missing lick count, or one below the cut-off.

    `summary` must hold untransformed licks.
    """
    names = ["Licks"] if "Licks" in summary.columns else ["LicksA", "LicksB"]
    reasons = []
    for n in names:
        c = F.col(n)
        missing = c.isNull() | F.isnan(c)
        why = F.when(missing, F.lit(f"{n} is NaN/undefined"))
        if cutoff is not None:
            why = why.when(
                c < cutoff,
                F.concat(F.lit(f"{n}="), _number(c), F.lit(f" < {MIN_LICKS}={cutoff:.6g}")),
            )
        reasons.append(why)
    return _failed(summary, reasons, by)


def hedonic_chambers(
    raw_summary: DataFrame,
    summary: DataFrame,
    min_licks: float | None,
    max_duration: float | None,
    max_events: float | None,
    by: Sequence[str] = REC,
) -> DataFrame:
    """Low-lick chambers, then, among the rest, too long or too many bouts."""
    low = low_lick_chambers(raw_summary, min_licks, by)
    rest = summary.join(low, [*by, "chamber"], "left_anti")
    reasons = []
    for base, limit, name in (
        ("MedDuration", max_duration, MAX_DURATION),
        ("Events", max_events, MAX_EVENTS),
    ):
        if limit is None:
            continue
        for s in "AB":
            c = F.col(f"{base}{s}")
            reasons.append(
                F.when(
                    c > limit,
                    F.concat(F.lit(f"{base}{s}="), _number(c), F.lit(f" > {name}={limit}")),
                )
            )
    if not reasons:
        return low
    return low.unionByName(_failed(rest, reasons, by))


def survivors(df: DataFrame, removed: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    return df.join(removed.select(*by, "chamber"), [*by, "chamber"], "left_anti")


def eating_chambers(
    summary: DataFrame,
    min_licks: float = 0.00001,
    max_duration: float | None = None,
    max_events: float | None = None,
) -> DataFrame:
    """Ad-hoc filter: both wells licked, no overlong bouts, not too many.

    A missing duration is kept here, as a comparison with it decides nothing.
    """
    ok = ~((F.col("LicksA") < min_licks) | (F.col("LicksB") < min_licks))
    if max_duration is not None:
        ok = ok & F.coalesce(F.col("MedDurationA") <= max_duration, F.lit(True))
    if max_events is not None:
        ok = ok & (F.col("EventsB") <= max_events)
    return summary.filter(ok)
