"""Detection parameters and how they reach the rows.

A run uses either one `Params` for every device (values become literals, no
join) or a table with one row per device (values arrive by a join on the
recording keys).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutspark.operators.scan import spread_join

# Keys of one recording. Further keys (for example the value of a parameter
# sweep) are added by passing a longer `by`.
REC = ("project", "dfm")

# The defaults of both presets.
PRESET_VALUES = {
    "baseline_window_minutes": 3.0,
    "feeding_threshold": 20.0,
    "feeding_minimum": 10.0,
    "tasting_minimum": 5.0,
    "tasting_maximum": 20.0,
    "feeding_minevents": 1,
    "tasting_minevents": 1,
    "samples_per_second": 5.0,
    "feeding_event_link_gap": 5,
    "pi_direction": "left",
}
WELLS_PER_DEVICE = 12

# Parameters a sweep may vary (fixed list).
SWEEPABLE = (
    "baseline_window_minutes",
    "feeding_event_link_gap",
    "feeding_minevents",
    "feeding_minimum",
    "feeding_threshold",
    "samples_per_second",
    "tasting_maximum",
    "tasting_minevents",
    "tasting_minimum",
)


def default_chamber_sets(chamber_size: int) -> tuple[tuple[int, ...], ...]:
    """Wells 1..12 in order, `chamber_size` wells to a chamber."""
    wells = range(1, WELLS_PER_DEVICE + 1, chamber_size)
    return tuple(tuple(range(w, w + chamber_size)) for w in wells)


@dataclass(frozen=True)
class Params:
    """Parameters shared by every device of a run."""

    chamber_size: int = 2
    correct_for_dual_feeding: bool = True
    baseline_window_minutes: float = PRESET_VALUES["baseline_window_minutes"]
    feeding_threshold: float = PRESET_VALUES["feeding_threshold"]
    feeding_minimum: float = PRESET_VALUES["feeding_minimum"]
    tasting_minimum: float = PRESET_VALUES["tasting_minimum"]
    tasting_maximum: float = PRESET_VALUES["tasting_maximum"]
    feeding_minevents: int = PRESET_VALUES["feeding_minevents"]
    tasting_minevents: int = PRESET_VALUES["tasting_minevents"]
    samples_per_second: float = PRESET_VALUES["samples_per_second"]
    feeding_event_link_gap: int = PRESET_VALUES["feeding_event_link_gap"]
    pi_direction: str = PRESET_VALUES["pi_direction"]
    chamber_sets: tuple[tuple[int, ...], ...] | None = None

    def __post_init__(self) -> None:
        if self.chamber_size not in (1, 2):
            raise ValueError("chamber_size must be 1 or 2")
        if self.pi_direction not in ("left", "right"):
            raise ValueError("pi_direction must be 'left' or 'right'")
        sets = self.chamber_sets or default_chamber_sets(self.chamber_size)
        if any(len(s) != self.chamber_size for s in sets):
            raise ValueError("every chamber set needs chamber_size wells")
        if any(not 1 <= w <= WELLS_PER_DEVICE for s in sets for w in s):
            raise ValueError("wells must lie between 1 and 12")
        object.__setattr__(self, "chamber_sets", tuple(tuple(s) for s in sets))

    @classmethod
    def single_well(cls, **changes) -> Params:
        return cls(chamber_size=1, correct_for_dual_feeding=False, **changes)

    @classmethod
    def two_well(cls, **changes) -> Params:
        return cls(chamber_size=2, correct_for_dual_feeding=True, **changes)

    def with_updates(self, **changes) -> Params:
        return replace(self, **changes)


@dataclass(frozen=True)
class Swept:
    """Shared parameters with one field taken from a key column of the rows."""

    params: Params
    field: str
    values: tuple[float, ...]
    column: str = "sweep_value"

    def __post_init__(self) -> None:
        if self.field not in SWEEPABLE:
            raise ValueError(f"{self.field!r} cannot be swept; choose one of {SWEEPABLE}")

    @property
    def ever_relative(self) -> bool:
        """May the feeding threshold be negative, that is relative to the peak?"""
        if self.field == "feeding_threshold":
            return min(self.values) < 0
        return self.params.feeding_threshold < 0


Settings = Params | Swept | DataFrame
_PREFIX = "p_"


def attach(df: DataFrame, settings: Settings, by: Sequence[str] = REC) -> DataFrame:
    """Bring per-device parameters onto `df`; a no-op for shared parameters.

    Samples take them chunk by chunk, so a long recording is not one task. No
    broadcast hint: Spark broadcasts the table when its measured size is below the
    session threshold and otherwise joins by shuffle.
    """
    if not isinstance(settings, DataFrame):
        return df
    if any(_PREFIX + c in df.columns for c in settings.columns):
        return df  # attached before
    keys = [c for c in by if c in settings.columns]
    renamed = settings.select(
        *keys, *[F.col(c).alias(_PREFIX + c) for c in settings.columns if c in _FIELD_NAMES]
    )
    if "chunk" not in df.columns:
        return df.join(renamed, keys)
    return spread_join(df, renamed, keys)


def value(settings: Settings, name: str) -> Column:
    """The parameter as a column: a literal, or what `attach` brought along."""
    if isinstance(settings, Params):
        return F.lit(getattr(settings, name))
    if isinstance(settings, Swept):
        swept = name == settings.field
        return F.col(settings.column) if swept else F.lit(getattr(settings.params, name))
    return F.col(_PREFIX + name)


def carried(settings: Settings, *names: str) -> list[str]:
    """Columns a grouping must keep so that `value` still works after it."""
    return [_PREFIX + n for n in names] if isinstance(settings, DataFrame) else []


def corrects_dual_feeding(settings: Settings) -> bool | None:
    """Whether contacts are corrected; None when it differs by device."""
    if isinstance(settings, DataFrame):
        return None
    p = settings.params if isinstance(settings, Swept) else settings
    return p.correct_for_dual_feeding and p.chamber_size == 2


_FIELD_NAMES = {f.name for f in fields(Params)} - {"chamber_sets"}
