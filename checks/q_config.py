"""Parameters, designs and their checks: customers stand for devices, nations
for experiments, orders for chamber assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutspark.operators import checks
from boutspark.operators.config import resolve_params
from boutspark.sources.recordings import coverage
from boutspark.sources.tables import table
from checks.oracle import oracle, part, r6
from checks.queries import query
from checks.workspace import shown

# Written parameters: which customers have them, under which name, with which value.
OWN = (
    ("c_custkey % 3 = 0", "'feeding-threshold'", "cast(c_custkey % 50 + 5 as string)"),
    ("c_custkey % 6 = 0", "'Feeding Minimum'", "cast(c_custkey % 10 + 0.5 as string)"),
    ("c_custkey % 7 = 0", "' pi.direction'", "'Right '"),
    ("c_custkey % 53 = 0", "'pi_direction'", "'sideways'"),
    ("c_custkey % 37 = 0", "'pi_multiplier'", "cast(c_custkey % 2 as string)"),
    ("c_custkey % 97 = 0", "'chamber size'", "'3'"),
    ("c_custkey % 89 = 0", "'chamber_size'", "'1'"),
    ("c_custkey % 41 = 0", "'No Such-Thing'", "'1'"),
    ("c_custkey % 59 = 0", "'chamber_sets'", "'1,2;3,14'"),
    ("c_custkey % 61 = 0", "'chamber_sets'", "'1;2'"),
)
COMMON = (
    ("n_nationkey % 5 <> 4", "'chamber_size'", "'2'"),
    ("n_nationkey % 5 <> 4", "'Link Gap'", "cast(n_nationkey % 7 as string)"),
    ("n_nationkey % 5 = 1", "'samples_per_sec'", "'10'"),
    ("n_nationkey % 5 = 2", "'tasting_low'", "'7.5'"),
)
TYPES = "case n_nationkey % 6 when 0 then 'hedonic' when 1 then 'single_well' when 2 then 'other' end"


def given(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey")
    key = F.col("c_custkey").alias("dfm")
    project = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project")
    once = customer.select(project, key)
    devices = once.unionByName(customer.filter("c_custkey % 101 = 0").select(project, key))
    rows = lambda spec: F.inline(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.expr(cond),
                        F.struct(
                            F.expr(name).alias("name"),
                            F.expr(val).alias("value"),
                            F.lit(i).alias("line"),
                        ),
                    )
                    for i, (cond, name, val) in enumerate(spec)
                ]
            )
        )
    )
    own = customer.select(project, key, rows(OWN))
    common = nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("project"),
        F.lit(None).cast("bigint").alias("dfm"),
        rows(COMMON),
    )
    experiments = nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("project"),
        F.expr(TYPES).alias("experiment_type"),
    )
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"
    )
    design = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        project,
        key,
        (F.col("o_orderkey") % 7 + 1).alias("chamber"),
        F.expr(
            "case when o_orderkey % 11 = 0 then o_orderstatus else concat(o_orderstatus, ' , ', o_orderpriority) end"
        ).alias("levels"),
    )
    factors = nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("project"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("factor"), F.lit(place).alias("place"), F.lit(level).alias("level")
                    )
                    for name, place, levels in (
                        ("Status", 0, ["F", "O"]),
                        ("Priority", 1, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]),
                    )
                    for level in levels
                ]
            )
        ),
    )
    written = own.unionByName(common)
    return devices, written, resolve_params(devices, written), design, factors, experiments


def own_value(cond_names: list[int]) -> str:
    """The later written value among several spellings."""
    cases = " ".join(f"when {OWN[i][0]} then {OWN[i][2]}" for i in sorted(cond_names, reverse=True))
    return f"case {cases} end".replace("as string", "as varchar")


part("cust", (), "select c_custkey, c_nationkey, 'n' || cast(c_nationkey as varchar) as project from customer")
part(
    "resolved",
    ("cust",),
    f"""
select project, c_custkey as dfm, size as chamber_size, gap as feeding_event_link_gap,
       coalesce(try_cast({own_value([0])} as double), 20.0) as feeding_threshold,
       coalesce(try_cast({own_value([1])} as double), 10.0) as feeding_minimum,
       case when c_nationkey % 5 = 2 then 7.5 else 5.0 end as tasting_minimum,
       case when c_nationkey % 5 = 1 then 10.0 else 5.0 end as samples_per_second,
       coalesce(case when {OWN[4][0]} then case when c_custkey % 2 = 1 then 'left' else 'right' end
                     when {OWN[3][0]} then 'sideways' when {OWN[2][0]} then 'right' end, 'left') as pi_direction,
       coalesce(size = 2, false) as correct, sets
from (select *, case when {OWN[6][0]} then 1 when {OWN[5][0]} then 3 when c_nationkey % 5 <> 4 then 2 end as size,
             case when c_nationkey % 5 <> 4 then c_nationkey % 7 else 5 end as gap,
             case when {OWN[9][0]} then '1;2' when {OWN[8][0]} then '1,2;3,14' end as sets
      from cust)""",
)


@query
def param_resolve(spark, sf):
    """Device over experiment over preset, under all spellings."""
    params = given(spark, sf)[2]
    return shown(
        params.select(
            F.col("project").alias("experiment"),
            "dfm",
            "chamber_size",
            "feeding_event_link_gap",
            "feeding_threshold",
            "feeding_minimum",
            "tasting_minimum",
            "samples_per_second",
            "pi_direction",
            F.coalesce("correct_for_dual_feeding", F.lit(False)).alias("correct"),
            F.coalesce(F.size("chamber_sets"), F.lit(-1)).alias("chambers"),
        )
    )


oracle(
    "param_resolve",
    f"""select project as experiment, dfm, chamber_size::bigint as chamber_size,
       feeding_event_link_gap::bigint as feeding_event_link_gap, {r6('feeding_threshold')} as feeding_threshold,
       {r6('feeding_minimum')} as feeding_minimum, {r6('tasting_minimum::double')} as tasting_minimum,
       {r6('samples_per_second::double')} as samples_per_second, pi_direction, correct,
       case when sets is not null then 2 when chamber_size = 1 then 12 when chamber_size = 2 then 6 else -1 end::bigint as chambers
from resolved""",
    "resolved",
)


@query
def validation(spark, sf):
    """Every check over all experiments; equal findings are counted."""
    devices, written, params, design, factors, experiments = given(spark, sf)
    found = checks.all_checks(devices, written, params, design, factors, experiments)
    counted = found.groupBy("project", "severity", "subject", "message").agg(
        F.count(F.lit(1)).alias("times")
    )
    return shown(counted.withColumnRenamed("project", "experiment"))


part(
    "assigned",
    ("cust",),
    """
select project, c_custkey as dfm, o_orderkey % 7 + 1 as chamber, o_orderkey % 11 = 0 as short,
       o_orderstatus as s, o_orderpriority as p
from orders join cust on o_custkey = c_custkey""",
)
SUBJECT = "cast(dfm as varchar)"
SEAT = "cast(dfm as varchar) || ':' || cast(chamber as varchar)"


def issue(severity, subject, message, source):
    return f"select project, '{severity}' as severity, {subject} as subject, '{message}' as message from {source}"


oracle(
    "validation",
    "select project as experiment, severity, subject, message, count(*) as times from (\n"
    + "\nunion all\n".join(
        [
            issue("error", SUBJECT, "chamber_size is missing", "resolved where chamber_size is null"),
            issue("error", SUBJECT, "chamber_size must be 1 or 2", "resolved where chamber_size not in (1, 2)"),
            issue(
                "error",
                "project",
                "devices differ in chamber_size",
                "(select project from resolved group by project having min(chamber_size) <> max(chamber_size))",
            ),
            issue("error", SUBJECT, "pi_direction must be left or right", "resolved where pi_direction = 'sideways'"),
            issue("error", SUBJECT, "device is listed more than once", "resolved where dfm % 101 = 0"),
            issue("error", SEAT, "wrong number of factor levels", "assigned where short"),
            issue("error", SEAT, "factor level is not declared", "assigned where not short and s not in ('F', 'O')"),
            issue(
                "error",
                SEAT,
                "factor level is not declared",
                "assigned where not short and p not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')",
            ),
            issue("warning", f"{SUBJECT} || ':no_such_thing'", "unknown parameter", "resolved where dfm % 41 = 0"),
            issue(
                "error",
                SUBJECT,
                "chamber_sets do not fit chamber_size",
                """resolved where chamber_size is not null and
                   case when sets = '1;2' then chamber_size <> 1 when sets = '1,2;3,14' then chamber_size <> 2 else false end""",
            ),
            issue(
                "error", SUBJECT, "chamber_sets name a well outside 1 to 12", "resolved where sets = '1,2;3,14'"
            ),
            "select 'n' || cast(n_nationkey as varchar), 'error', 'other', 'unknown experiment type' from nation where n_nationkey % 6 = 2",
            issue(
                "error",
                SUBJECT,
                "experiment type does not fit chamber_size",
                """(select r.* from resolved r join cust on c_custkey = dfm
                    where case c_nationkey % 6 when 0 then chamber_size <> 2 when 1 then chamber_size <> 1 else false end)""",
            ),
            issue(
                "warning", SUBJECT, "no chamber assignments",
                "resolved where dfm not in (select dfm from assigned)",
            ),
            issue(
                "error",
                SUBJECT,
                "no parameters for the device or the experiment",
                "(select project, c_custkey as dfm from cust where c_nationkey % 5 = 4 and not ("
                + " or ".join(c for c, _, _ in OWN)
                + "))",
            ),
            issue(
                "error",
                SEAT,
                "device has no such chamber",
                """(select a.* from assigned a join resolved r using (project, dfm)
                    where a.chamber > case when sets is not null then 2 when chamber_size = 1 then 12
                                           when chamber_size = 2 then 6 end)""",
            ),
            issue(
                "error",
                SEAT,
                "chamber is assigned more than once",
                "(select project, dfm, chamber from assigned group by all having count(*) > 1)",
            ),
        ]
    )
    + ") group by all",
    "resolved",
    "assigned",
)


@query
def device_coverage(spark, sf):
    """Devices configured (customers) against devices with files (suppliers), both by nation."""
    devices = given(spark, sf)[0]
    files = table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("project"),
        F.col("s_suppkey").alias("dfm"),
    )
    return shown(coverage(devices, files).withColumnRenamed("project", "experiment"))


oracle(
    "device_coverage",
    """with have as (select distinct 'n' || cast(s_nationkey as varchar) as project, s_suppkey as dfm from supplier),
     want as (select project, c_custkey as dfm from cust)
select project as experiment, 'warning' as severity, cast(dfm as varchar) as subject, 'configured device without files' as message
from want anti join have using (project, dfm)
union all
select project, 'warning', cast(dfm as varchar), 'files of a device not configured' from have anti join want using (project, dfm)
union all
select distinct project, 'error', '', 'no device left to load' from want
where project not in (select project from want semi join have using (project, dfm))""".replace(
        "with have as", "select * from (with have as"
    )
    + ")",
    "cust",
)
