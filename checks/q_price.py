"""The longer recording: line items as samples, suppliers as wells."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutspark.operators import bouts, detect, summary
from boutspark.operators.baseline import subtract_baseline
from boutspark.params import REC, Params
from boutspark.sources.tables import price_seats, price_signal
from boutspark.staging import stage
from checks.oracle import detection, oracle, part, r6
from checks.q_stats import add_summary
from checks.q_summary import shown_two
from checks.queries import query
from checks.workspace import _once, shown

# One sample a second; the window of three minutes is 181 samples.
PRICE_PARAMS = Params(
    feeding_threshold=25.0,
    feeding_minimum=10.0,
    tasting_minimum=5.0,
    tasting_maximum=20.0,
    samples_per_second=1.0,
    feeding_event_link_gap=2,
    baseline_window_minutes=3.0,
)
WELL = [*REC, "well"]


def price_labelled(spark, sf):
    def build():
        base = stage(subtract_baseline(price_signal(spark, sf), PRICE_PARAMS).drop("signal"), "price")
        # detection needs the pairs of wells and the clock; the rest follows from a row
        rows = price_seats(base).select(*base.columns, "chamber", "minutes")
        return price_seats(detect.detect(rows, PRICE_PARAMS))

    return _once(spark, sf, "price", build)


part(
    "psig",
    (),
    """
select cast(floor(l_suppkey / 12) as bigint) + 1 as dfm, cast(floor((l_suppkey % 12) / 2) as bigint) + 1 as chamber,
       l_suppkey % 12 + 1 as well, case when l_suppkey % 2 = 0 then 'A' else 'B' end as side,
       row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as sample,
       l_extendedprice / 1000.0 as signal, false as lit
from lineitem""",
)
part(
    "pbas",
    ("psig",),
    """
select *, cast(sample - 1 as double) as minutes,
       signal - median(signal) over (partition by dfm, well order by sample rows between 90 preceding and 90 following) as base
from psig""",
)
detection("_p", "pbas", "10", "25", 2)


@query
def price_contacts(spark, sf):
    """Licks and bouts per well of the long recording."""
    rows = price_labelled(spark, sf)
    found = bouts.feeding_bouts(rows, PRICE_PARAMS)
    events = found.groupBy(*WELL).agg(
        F.count(F.lit(1)).alias("events"), F.sum("TotalIntensity").alias("total")
    )
    licks = rows.groupBy(*WELL).agg(F.sum(F.col("lick").cast("bigint")).alias("licks"))
    return shown(licks.join(events, WELL))


oracle(
    "price_contacts",
    f"""select dfm, well, licks, events, {r6('total')} as total
from (select dfm, well, count(*) filter (lick) as licks from lab_p group by all)
join (select dfm, well, count(*) as events, sum(total) as total from bouts_p group by all) using (dfm, well)""",
    "bouts_p",
)


@query
def price_summary(spark, sf):
    return shown(summary.feeding_summary(price_labelled(spark, sf), PRICE_PARAMS))


oracle(
    "price_summary",
    f"select dfm, chamber, {shown_two()}, 0.0::double as StartMin, 0.0::double as EndMin from two_p",
    "two_p",
)
part("seats_p", ("psig",), "select distinct dfm, chamber, side from psig")
add_summary("_p", "seats_p")
