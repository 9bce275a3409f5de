"""The same results in SQL, for DuckDB over the same tables.

Written against whole tables with plain windows; nothing here is chunked.
`sql(body, *parts)` puts the named common table expressions before `body`.
"""

from __future__ import annotations

# Each part: the parts it reads, and its text.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], text: str) -> None:
    PARTS[name] = (needs, text)


def sql(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in PARTS[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} as materialized ({PARTS[n][1]})" for n in ordered)
    return f"with {head}\n{body}" if ordered else body


def r6(expr: str) -> str:
    """Round to 6 digits, a hair off the exact ties; adding zero turns -0.0 into 0.0."""
    return f"(round({expr} + 1e-9, 6) + 0.0)"


part(
    "s0",
    (),
    """
select event_id, user_id, ts, value, event_type,
       cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
       cast(floor(user_id / 12) as bigint) + 1 as dfm,
       user_id % 12 + 1 as well,
       cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as sample
from events""",
)
part(
    "s1",
    ("s0",),
    """
select *, cast(floor((well - 1) / 2) as bigint) + 1 as chamber,
       case when (well % 2 = 1) = (dfm % 2 = 1) then 'A' else 'B' end as side,
       cast(sample - 1 as double) as minutes,
       case when (sample - 1) % 20 < 10
            then (sum(k) over (partition by dfm, sample)) * 37 % 4096 else 0 end as opto,
       value + case when well % 4 = 1 and sample <= 10 + dfm % 5 then 65536.0 else 0.0 end as raw_signal
from s0""",
)
part(
    "sig",
    ("s1",),
    """
select dfm, well, chamber, side, sample, minutes, raw_signal, value as signal,
       cast(opto as bigint) as opto,
       cast(floor(cast(opto as bigint) / power(2, well - 1)) as bigint) % 2 = 1 as lit,
       cast(case when event_type = 'error' then k else 0 end as bigint) as error_code, event_id, ts
from s1""",
)
part(
    "bas",
    ("sig",),
    """
select *, signal - median(signal) over (partition by dfm, well order by sample
                                        rows between 5 preceding and 5 following) as base
from sig""",
)


def islands(src: str, level: str, low: str, high: str, having: str = "true") -> str:
    return f"""
select dfm, well, chamber, side, min(sample) as first_s, max(sample) as last_s, count(*) as n
from (select *, sample - row_number() over (partition by dfm, well order by sample) as g
      from {src} where {level} > {low})
group by dfm, well, chamber, side, g
having max({level}) > {high} and {having}"""


def linked(src: str, gap: int) -> str:
    return f"""
select dfm, well, chamber, side, min(first_s) as first_s, max(last_s) as last_s
from (select *, sum(fresh) over (partition by dfm, well order by first_s) as g
      from (select *, case when first_s - lag(last_s) over (partition by dfm, well order by first_s) - 1 <= {gap}
                           then 0 else 1 end as fresh
            from {src}))
group by dfm, well, chamber, side, g"""


def detection(tag: str, src: str, low: str = "20", high: str = "60", gap: int = 2) -> None:
    """Parts runs/links/lab for one set of levels, without and with correction."""
    part(f"runs1{tag}", (src,), islands(src, "base", low, high))
    part(f"links1{tag}", (f"runs1{tag}",), linked(f"runs1{tag}", gap))
    part(
        f"lick1{tag}",
        (src, f"runs1{tag}"),
        f"""
select b.*, r.first_s is not null as lick1
from {src} b left join runs1{tag} r
  on b.dfm = r.dfm and b.well = r.well and b.sample between r.first_s and r.last_s""",
    )
    part(
        f"pair{tag}",
        (f"lick1{tag}",),
        f"""
select *, case when dual and (base < top or top = low) then 0.0 else base end as fixed
from (select *, sum(case when lick1 then 1 else 0 end) over p = 2 as dual,
             max(base) over p as top, min(base) over p as low
      from lick1{tag} window p as (partition by dfm, chamber, sample))""",
    )
    part(f"runs{tag}", (f"pair{tag}",), islands(f"pair{tag}", "fixed", low, high))
    part(f"links{tag}", (f"runs{tag}",), linked(f"runs{tag}", gap))
    part(
        f"lab{tag}",
        (f"pair{tag}", f"runs{tag}", f"links{tag}"),
        f"""
select p.*, r.first_s is not null as lick, l.first_s as bout,
       p.base > 5 and p.base < 20 and r.first_s is null as taste
from pair{tag} p
left join runs{tag} r on p.dfm = r.dfm and p.well = r.well and p.sample between r.first_s and r.last_s
left join links{tag} l on p.dfm = l.dfm and p.well = l.well and p.sample between l.first_s and l.last_s""",
    )
    part(
        f"bouts{tag}",
        (f"lab{tag}",),
        f"""
select dfm, chamber, side, well, bout, min(minutes) as minutes, count(*) as licks,
       count(*) / 1.0 as duration, sum(base) as total, avg(base) as mean, min(base) as low,
       max(base) as high, case when count(*) > 1 then var_samp(base) end as variance
from lab{tag} where bout is not null group by dfm, chamber, side, well, bout""",
    )
    part(f"gaps{tag}", (f"lab{tag}",), false_runs(f"lab{tag}", "bout is null"))


def false_runs(src: str, cond: str) -> str:
    return f"""
select dfm, chamber, side, well, min(minutes) as minutes, min(sample) as sample, count(*) / 1.0 as sec
from (select *, sample - row_number() over (partition by dfm, well order by sample) as g
      from {src} where {cond})
group by dfm, chamber, side, well, g"""


detection("", "bas")

_BODIES: dict[str, tuple[str, ...]] = {}


def oracle(name: str, body: str, *names: str) -> None:
    _BODIES[name] = (body, *names)


def statements() -> dict[str, str]:
    """Complete statements; parts may be defined in any module."""
    return {name: sql(*given) for name, given in _BODIES.items()}
