"""Parameters and designs of many experiments as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.params import PRESET_VALUES, default_chamber_sets

# Accepted parameter names, after normalising, and their meaning.
PARAMETER_NAMES = {
    "baseline_window": "baseline_window_minutes",
    "baseline_window_min": "baseline_window_minutes",
    "baseline_window_minutes": "baseline_window_minutes",
    "chamber_sets": "chamber_sets",
    "chamber_size": "chamber_size",
    "correct_for_dual_feeding": "correct_for_dual_feeding",
    "feeding_event_link_gap": "feeding_event_link_gap",
    "feeding_minevents": "feeding_minevents",
    "feeding_minimum": "feeding_minimum",
    "feeding_threshold": "feeding_threshold",
    "link_gap": "feeding_event_link_gap",
    "pi_direction": "pi_direction",
    "pi_multiplier": "pi_direction",
    "samples_per_sec": "samples_per_second",
    "samples_per_second": "samples_per_second",
    "tasting_high": "tasting_maximum",
    "tasting_low": "tasting_minimum",
    "tasting_maximum": "tasting_maximum",
    "tasting_minevents": "tasting_minevents",
    "tasting_minimum": "tasting_minimum",
}
FIELDS = sorted(set(PARAMETER_NAMES.values()))
INTEGERS = ("chamber_size", "feeding_minevents", "tasting_minevents", "feeding_event_link_gap")


def normal_name(name: Column) -> Column:
    """Lower case, with dots, dashes and blanks as single underscores."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"[.\- ]", "_"), "_+", "_"))


def known_parameter(name: Column) -> Column:
    """The parameter a written name stands for; null when unknown."""
    pairs = [F.lit(x) for item in PARAMETER_NAMES.items() for x in item]
    return F.create_map(*pairs)[normal_name(name)]


def _direction(text: Column) -> Column:
    """left / right; old numeric values mean left for 1 and right otherwise."""
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.when(number.cast("int") == 1, "left").otherwise("right")).otherwise(
        F.lower(F.trim(text))
    )


def _chamber_sets(text: Column) -> Column:
    """`1,2;3,4` as an array of arrays."""
    return F.transform(
        F.split(text, ";"),
        lambda row: F.transform(F.split(row, ","), lambda w: F.trim(w).try_cast("int")),
    )


def resolve_params(devices: DataFrame, written: DataFrame) -> DataFrame:
    """One row of parameters per device: device over experiment over preset.

    `written` has project, dfm (null for the whole experiment), name, value and
    line; of two spellings of one parameter the later line counts.
    """
    named = written.withColumn("field", known_parameter(F.col("name"))).filter(
        F.col("field").isNotNull() & F.col("value").isNotNull()
    )

    def table(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        wide = rows.groupBy(*keys).pivot("field", FIELDS).agg(F.max_by("value", "line"))
        return wide.select(*keys, *[F.col(f).alias(prefix + f) for f in FIELDS])

    own = table(named.filter(F.col("dfm").isNotNull()), ["project", "dfm"], "d_")
    common = table(named.filter(F.col("dfm").isNull()), ["project"], "g_")
    both = (
        devices.select("project", "dfm")
        .distinct()
        .join(own, ["project", "dfm"], "left")
        .join(common, "project", "left")
    )
    given = {f: F.coalesce(f"d_{f}", f"g_{f}") for f in FIELDS}
    size = given["chamber_size"].try_cast("double").cast("int")
    sets = F.when(given["chamber_sets"].isNotNull(), _chamber_sets(given["chamber_sets"]))
    for n in (1, 2):
        usual = F.array(*[F.array(*[F.lit(w) for w in s]) for s in default_chamber_sets(n)])
        sets = F.coalesce(sets, F.when(size == n, usual))
    truth = F.lower(given["correct_for_dual_feeding"]).isin("true", "yes", "on", "1")
    out: dict[str, Column] = {"chamber_size": size, "chamber_sets": sets}
    out["correct_for_dual_feeding"] = F.coalesce(truth, size == 2)
    out["pi_direction"] = F.coalesce(
        _direction(given["pi_direction"]), F.lit(PRESET_VALUES["pi_direction"])
    )
    for f, preset in PRESET_VALUES.items():
        if f == "pi_direction":
            continue
        number = F.coalesce(given[f].try_cast("double"), F.lit(float(preset)))
        out[f] = number.cast("int") if f in INTEGERS else number
    return both.select("project", "dfm", *[c.alias(f) for f, c in sorted(out.items())])
