"""Statistics from distributed sums.

Spark reduces the observations to cell tables (counts, means, squared
deviations). What is left, a few rows per model, is solved where it lies.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutspark.functions import tails
from boutspark.functions.scalars import standard_error
from boutspark.operators.scan import ordered_scan
from boutspark.shipping import ship
from boutspark.staging import stage


# ---- bootstrap -----------------------------------------------------------


class Bootstrap(NamedTuple):
    summary: DataFrame
    samples: DataFrame


def drawn_index(seed: int, group: Column, iteration: Column, slot: Column, n: Column) -> Column:
    """A reproducible index below n from a hash of everything that names the draw."""
    text = F.concat_ws(
        ":", F.lit(str(seed)), group, iteration.cast("string"), slot.cast("string")
    )
    head = F.substring(F.md5(text.cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % n


def bootstrap(
    values: DataFrame,
    order: Sequence[str],
    *,
    group: str = "Group",
    value: str = "Value",
    n_boot: int = 2000,
    ci: float = 0.95,
    seed: int = 0,
) -> Bootstrap:
    """Percentile intervals of group means, resampling rows (chambers).

    Rows are ranked in `order` (its first column also cuts long groups into
    pieces), so the same seed gives the same table on any partitioning.
    """
    # read three times below, and a summary is dear to plan again
    values = stage(values.select(group, *order, value), "values")
    present = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ranked = ordered_scan(
        present, [group], list(order), order[0], sums={"_nr": F.lit(1).cast("bigint")}
    ).select(group, value, (F.col("_nr") - 1).alias("_rank"))
    sizes = values.groupBy(group).agg(
        F.max(F.when(~F.isnan(value), F.abs(value))).alias("_top"),
        F.count(F.when(~F.isnan(value), F.col(value))).alias("n"),
        F.avg(F.when(~F.isnan(value), F.col(value))).alias("mean"),
        standard_error(F.when(~F.isnan(value), F.col(value))).alias("sem"),
    )
    slots = ranked.join(sizes.select(group, "n"), group).select(
        group, "n", F.col("_rank").alias("_slot")
    )
    # a fixed number of parts: few slots are many draws, which Spark does not foresee
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = (
        slots.repartition(parts, group, "_slot")
        .withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .select(
            group,
            "iter",
            drawn_index(seed, F.col(group), F.col("iter"), F.col("_slot"), F.col("n")).alias("_rank"),
        )
    )
    # sums of whole multiples of a power of two do not depend on the order of the rows
    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_top"))) - 52)
    wholes = ranked.join(sizes.select(group, F.when(F.col("_top") > 0, step).otherwise(1.0).alias("_step")), group)
    wholes = wholes.withColumn("_part", F.round(F.col(value) / F.col("_step")).cast("decimal(20,0)"))
    samples = (
        # the draws are taken for as small as the slots and would be broadcast: they meet
        # the values by shuffle, where the values are the side that is kept
        draws.join(wholes.hint("shuffle_hash"), [group, "_rank"])
        .groupBy(group, "iter")
        .agg(
            F.sum("_part").cast("double").alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
            F.max("_step").alias("_step"),
        )
        .select(group, "iter", (F.col("_sum") * F.col("_step") / F.col("_n")).alias("mean"))
    )
    alpha = (1.0 - ci) / 2.0
    limits = samples.groupBy(group).agg(
        F.percentile("mean", F.lit(alpha)).alias("ci_low"),
        F.percentile("mean", F.lit(1.0 - alpha)).alias("ci_high"),
    )
    return Bootstrap(sizes.drop("_top").join(limits, group, "left"), samples)


# ---- one factor ----------------------------------------------------------


def cell_table(
    df: DataFrame, y: str, factors: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """n, mean and squared deviations per combination of levels."""
    return (
        df.filter(F.col(y).isNotNull() & ~F.isnan(y))
        .groupBy(*keys, *factors)
        .agg(
            F.count(y).cast("double").alias("n"),
            F.avg(y).alias("mean"),
            (F.var_pop(y) * F.count(y)).alias("ss"),
        )
    )


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(b) or pd.isna(c) else tails.f_tail(a, b, c)
            for a, b, c in zip(f, df1, df2)
        ],
        dtype="float64",
    )


def _anova_rows(wide: DataFrame, keys: Sequence[str], term: str) -> DataFrame:
    """Two rows per model from columns ssb, dfb, ssw, dfw."""
    ship(wide.sparkSession)
    ratio = F.when(
        (F.col("dfw") > 0) & (F.col("dfb") > 0) & (F.col("ssw") > 0),
        (F.col("ssb") / F.col("dfb")) / (F.col("ssw") / F.col("dfw")),
    )
    none = F.lit(None).cast("double")
    wide = wide.withColumn("_f", ratio)
    rows = F.array(
        F.struct(
            F.lit(term).alias("term"),
            F.col("ssb").alias("sum_sq"),
            F.col("dfb").alias("df"),
            F.col("_f").alias("F"),
            _f_tail("_f", "dfb", "dfw").alias("p"),
        ),
        F.struct(
            F.lit("Residual").alias("term"),
            F.col("ssw").alias("sum_sq"),
            F.col("dfw").alias("df"),
            none.alias("F"),
            none.alias("p"),
        ),
    )
    return wide.select(*keys, F.inline(rows))


def anova_one_way(
    df: DataFrame, y: str, factor: str, keys: Sequence[str] = ()
) -> DataFrame:
    """One-way analysis of variance, one model per value of `keys`.

    Levels and totals come from one pass with grouping sets; the squares
    between levels are the total ones less those within.
    """
    keys = list(keys)
    sums = (
        df.filter(F.col(y).isNotNull() & ~F.isnan(y))
        .groupingSets([[*keys, factor], keys], *keys, factor)
        .agg(
            F.grouping(factor).alias("_total"),
            F.count(y).alias("n"),
            (F.var_pop(y) * F.count(y)).alias("ss"),
        )
    )
    level, total = F.col("_total") == 0, F.col("_total") == 1
    levels = F.count(F.when(level, F.lit(1)))
    wide = (
        sums.groupBy(*keys)
        .agg(
            F.max(F.when(total, F.col("ss"))).alias("sst"),
            F.sum(F.when(level, F.col("ss"))).alias("ssw"),
            (levels - 1).cast("double").alias("dfb"),
            (F.max(F.when(total, F.col("n"))) - levels).cast("double").alias("dfw"),
        )
        .withColumn("ssb", F.greatest(F.col("sst") - F.col("ssw"), F.lit(0.0)))
    )
    return _anova_rows(wide, keys, factor)


def regression_anova(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Analysis of variance of a straight line (a numeric regressor, one df)."""
    keys = list(keys)
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    wide = (
        df.groupBy(*keys)
        .agg(
            F.regr_sxx(a, b).alias("sxx"),
            F.regr_sxy(a, b).alias("sxy"),
            F.regr_syy(a, b).alias("syy"),
            F.regr_count(a, b).alias("n"),
        )
        .withColumn("ssb", F.when(F.col("sxx") > 0, F.col("sxy") * F.col("sxy") / F.col("sxx")))
        .withColumn("dfb", F.lit(1.0))
        .withColumn("ssw", F.col("syy") - F.col("ssb"))
        .withColumn("dfw", (F.col("n") - 2).cast("double"))
    )
    return _anova_rows(wide, keys, x)


def trend(df: DataFrame, y: str, x: str, keys: Sequence[str]) -> DataFrame:
    """Slope, intercept, r2 and n of y on x per group."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        F.regr_count(a, b).alias("n"),
    )


# ---- several factors -----------------------------------------------------


def crossed_terms(factors: Sequence[str]) -> list[tuple[str, ...]]:
    """Main effects, then interactions of growing order."""
    return [c for r in range(1, len(factors) + 1) for c in combinations(factors, r)]


def _term_columns(cells: pd.DataFrame, term: Sequence[str]) -> np.ndarray:
    cols = np.ones((len(cells), 1))
    for factor in term:
        levels = sorted(cells[factor].unique())[1:]
        dummies = np.column_stack([cells[factor] == lv for lv in levels]) if levels else np.zeros((len(cells), 0))
        cols = (cols[:, :, None] * dummies[:, None, :]).reshape(len(cells), -1)
    return cols.astype(float)


def _term_codes(cells: pd.DataFrame, term: Sequence[str]) -> tuple[np.ndarray, int]:
    """The column of every cell among the columns of a term (-1: at a first level), and their number."""
    code, size = np.zeros(len(cells), np.int64), 1
    outside = np.zeros(len(cells), bool)
    for factor in term:
        levels, index = np.unique(cells[factor].to_numpy(), return_inverse=True)
        outside |= index == 0
        code = code * max(len(levels) - 1, 0) + index - 1
        size *= len(levels) - 1
    return np.where(outside, -1, code), size


def _saturated(terms: Sequence[tuple[str, ...]]) -> bool:
    """True where the terms contain the crossing of all factors with everything below it."""
    given = {frozenset(t) for t in terms}
    every = sorted(frozenset().union(*given)) if given else []
    return len(given) == 2 ** len(every) - 1 and bool(every)


def _residual(cells: pd.DataFrame, terms: Sequence[tuple[str, ...]]) -> tuple[float, int]:
    """Between-cell squares left by a model, and the rank of the model.

    The normal equations are summed from the cells' column numbers, so no
    matrix with a row per cell is made; a model with a parameter for
    every cell leaves nothing and is not solved.
    """
    w, y = cells["w"].to_numpy(float), cells["mean"].to_numpy(float)
    factors = {f for t in terms for f in t}
    if _saturated(terms) and len(cells) == len(cells[sorted(factors)].drop_duplicates()):
        return 0.0, len(cells)
    center = float((w * y).sum() / w.sum())
    y = y - center
    blocks, at = [(np.zeros(len(cells), np.int64), 0)], 1
    for term in terms:
        code, size = _term_codes(cells, term)
        blocks.append((code, at))
        at += size
    xx, xy = np.zeros((at, at)), np.zeros(at)
    for code, start in blocks:
        on = code >= 0
        np.add.at(xy, code[on] + start, (w * y)[on])
        for other, begin in blocks:
            both = on & (other >= 0)
            np.add.at(xx, (code[both] + start, other[both] + begin), w[both])
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    beta, _, rank, _ = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-11)
    beta = beta / scale
    fitted = np.zeros(len(cells))
    for code, start in blocks:
        on = code >= 0
        fitted[on] += beta[code[on] + start]
    return float((w * (y - fitted) ** 2).sum()), int(rank)


def _solve(cells: pd.DataFrame, terms: list[tuple[str, ...]], kind: int) -> pd.DataFrame:
    """Sums of squares by nested models; kind 1 sequential, 2 marginal."""
    full, full_rank = _residual(cells, terms)
    within = float(cells["ss"].sum())
    df_res = float(cells["n"].sum() - full_rank)
    ss_res = full + within
    rows = []
    for i, term in enumerate(terms):
        if kind == 1:
            small = terms[:i]
        else:
            small = [t for t in terms if not set(term) <= set(t)]
        without, r0 = _residual(cells, small)
        with_it, r1 = _residual(cells, [*small, term])
        ss, df = without - with_it, float(r1 - r0)
        f = (ss / df) / (ss_res / df_res) if df > 0 and df_res > 0 and ss_res > 0 else None
        rows.append((":".join(term), ss, df, f, tails.f_tail(f, df, df_res)))
    rows.append(("Residual", ss_res, df_res, None, None))
    return pd.DataFrame(rows, columns=["term", "sum_sq", "df", "F", "p"]).astype(
        {"sum_sq": float, "df": float, "F": float, "p": float}
    )


_RESULT = [
    T.StructField("term", T.StringType()),
    T.StructField("sum_sq", T.DoubleType()),
    T.StructField("df", T.DoubleType()),
    T.StructField("F", T.DoubleType()),
    T.StructField("p", T.DoubleType()),
]


def _fit_cells(
    cells: DataFrame, keys: list[str], terms: list[tuple[str, ...]], kind: int
) -> DataFrame:
    fields = [cells.schema[k] for k in keys]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _solve(pdf, terms, kind)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    ship(cells.sparkSession)
    # the cell table, not the observations, is what meets in one place
    return cells.groupBy(*keys).applyInPandas(fit, T.StructType([*fields, *_RESULT]))


def anova(
    df: DataFrame,
    y: str,
    factors: Sequence[str],
    keys: Sequence[str] = (),
    terms: Sequence[tuple[str, ...]] | None = None,
    kind: int = 2,
) -> DataFrame:
    """Analysis of variance of crossed factors; Type II unless `kind` is 1."""
    keys = list(keys)
    cells = cell_table(df, y, factors, keys).withColumn("w", F.col("n"))
    return _fit_cells(cells, keys, list(terms or crossed_terms(factors)), kind)


def weighted_anova(
    df: DataFrame,
    y: str,
    weight: str,
    factors: Sequence[str],
    terms: Sequence[tuple[str, ...]],
    keys: Sequence[str] = (),
    kind: int = 1,
) -> DataFrame:
    """The same with observation weights; weights of zero do not count.

    Weighted cell means come first and are joined back, so the squares within
    cells are sums of squared distances and lose no digits.
    """
    keys = list(keys)
    where = [*keys, *factors]
    rows = df.filter(F.col(y).isNotNull() & ~F.isnan(y) & (F.col(weight) > 0))
    rows = stage(rows.select(*dict.fromkeys([*where, y, weight])), "weighted")
    means = rows.groupBy(*where).agg(
        F.sum(weight).alias("w"),
        (F.sum(F.col(weight) * F.col(y)) / F.sum(weight)).alias("mean"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    inner = (
        rows.join(means.select(*where, "mean"), where)
        .groupBy(*where)
        .agg(F.sum(F.col(weight) * F.pow(F.col(y) - F.col("mean"), 2)).alias("ss"))
    )
    return _fit_cells(means.join(inner, where), keys, list(terms), kind)


# ---- Tukey ---------------------------------------------------------------


@F.pandas_udf(
    T.StructType([T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType())])
)
def _range_test(q: pd.Series, k: pd.Series, df: pd.Series, tail: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None)
        if pd.isna(a) or d <= 0
        else (tails.range_tail(float(a), int(b), float(d)), tails.range_quantile(float(t), int(b), float(d)))
        for a, b, d, t in zip(q, k, df, tail)
    ]
    return pd.DataFrame(rows, columns=["p", "q"], dtype="float64")


def tukey(
    df: DataFrame, y: str, factor: str, keys: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Honest significant differences between the levels of one factor.

    Every level is compared with every later one: pairs of treatment levels,
    never of observations.
    """
    ship(df.sparkSession)
    keys = list(keys)
    cells = cell_table(df, y, [factor], keys)
    level = F.struct(F.col(factor).alias("level"), "n", "mean")
    models = cells.groupBy(*keys).agg(
        F.collect_list(level).alias("_levels"),
        F.count(F.lit(1)).alias("k"),
        (F.sum("n") - F.count(F.lit(1))).alias("dfw"),
        F.sum("ss").alias("ssw"),
    )
    one, two = F.col("_one"), F.col("_two")
    pairs = (
        models.withColumn("_one", F.explode("_levels"))
        .withColumn("_two", F.explode("_levels"))
        .filter(one["level"] < two["level"])
        .select(
            *keys,
            "k",
            "dfw",
            "ssw",
            one["level"].alias("group1"),
            two["level"].alias("group2"),
            one["n"].alias("n1"),
            two["n"].alias("n2"),
            one["mean"].alias("m1"),
            two["mean"].alias("m2"),
        )
    )
    error = F.sqrt(F.col("ssw") / F.col("dfw") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    tested = (
        pairs.withColumn("meandiff", F.col("m2") - F.col("m1"))
        .withColumn("_se", F.when(F.col("dfw") > 0, error))
        .withColumn("_q", F.when(F.col("_se") > 0, F.abs("meandiff") / F.col("_se")))
        .withColumn("_t", _range_test("_q", "k", "dfw", F.lit(alpha)))
    )
    half = F.col("_t.q") * F.col("_se")
    return tested.select(
        *keys,
        "group1",
        "group2",
        "meandiff",
        F.col("_t.p").alias("p_adj"),
        (F.col("meandiff") - half).alias("lower"),
        (F.col("meandiff") + half).alias("upper"),
        (F.col("_t.p") < alpha).alias("reject"),
    )


# ---- mixed model ---------------------------------------------------------


def mixed_model(
    df: DataFrame,
    y: str,
    factors: Sequence[str],
    device: Sequence[str] = ("project", "dfm"),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Crossed factors with a random intercept per device, fitted by REML.

    One fit per value of `keys` (never null), each in a task of its own; without keys
    one fit of all rows. Per device the model needs only n, the count and the sum of y
    in every cell. Devices of equal size share the inverse covariance, so their moments
    are added up on Spark in a long table (device size, cell, cell). What is left of a
    fit, the squares of the model's cells per device size, is solved when it is read.
    """
    ship(df.sparkSession)
    factors, keys = list(factors), list(keys)
    device = [*keys, *[d for d in device if d not in keys]]
    rows = df.filter(F.col(y).isNotNull() & ~F.isnan(y))
    cell = F.to_json(F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(factors)]))
    inside = rows.groupBy(*dict.fromkeys([*device, *factors])).agg(
        F.count(F.lit(1)).cast("double").alias("s"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v")
    )
    inside = stage(inside.select(*device, cell.alias("cell"), "s", "_m", "_v"), "observations")
    # REML does not depend on the origin, sums of squares do
    middle = F.sum(F.col("s") * F.col("_m")) / F.sum("s")
    if keys:
        centers = inside.groupBy(*keys).agg(middle.alias("_center"))
        centred = lambda table: table.join(centers, keys)
    else:
        center = inside.select(middle).scalar()
        centred = lambda table: table.withColumn("_center", center)
    away = F.col("_m") - F.col("_center")
    per_cell = centred(inside).select(
        *device, "cell", "s", (F.col("s") * away).alias("sy"), (F.col("s") * (F.col("_v") + away * away)).alias("yy")
    )
    devices = per_cell.groupBy(*device).agg(
        F.sum("s").alias("n"), F.sum("sy").alias("t"), F.sum("yy").alias("yy")
    )
    none = F.lit(None).cast("string")
    sizes = devices.groupBy(*keys, "n").agg(
        F.count(F.lit(1)).cast("double").alias("a"), F.sum("yy").alias("b"), F.sum(F.col("t") * F.col("t")).alias("c")
    ).select(*keys, "n", none.alias("i"), none.alias("j"), "a", "b", "c")
    sized = per_cell.drop("yy").join(devices.select(*device, "n", "t"), device)
    singles = sized.groupBy(*keys, "n", "cell").agg(
        F.sum("s").alias("a"), F.sum("sy").alias("b"), F.sum(F.col("s") * F.col("t")).alias("c")
    ).select(*keys, "n", F.col("cell").alias("i"), none.alias("j"), "a", "b", "c")
    # the cells of one device beside each other: pairs of treatments, not of observations
    other = per_cell.select(*device, F.col("cell").alias("j"), F.col("s").alias("s2"))
    crossed = (
        sized.join(other, device)
        .filter(F.col("cell") <= F.col("j"))
        .groupBy(*keys, "n", F.col("cell").alias("i"), "j")
        .agg(F.sum(F.col("s") * F.col("s2")).alias("a"))
        .select(*keys, "n", "i", "j", "a", F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    )
    moments = sizes.unionAll(singles).unionAll(crossed)

    def fit(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        found = [(*key, *row) for row in _mixed_rows(table, factors)]
        return pd.DataFrame(found, columns=[*keys, *[f.name for f in _MIXED]])

    kinds = T.StructType([*[inside.schema[k] for k in keys], *_MIXED])
    found = centred(moments.groupBy(*keys).applyInPandas(fit, kinds))
    origin = F.when(F.col("term") == "Intercept", F.col("_center")).otherwise(F.lit(0.0))
    return (
        found.withColumns({c: F.col(c) + origin for c in ("coef", "lower", "upper")})
        .withColumn("z", F.when(F.col("std_err") > 0, F.col("coef") / F.col("std_err")))
        .withColumn("p", _normal_tail("z"))
        .drop("_center")
    )


_MIXED = [
    T.StructField("term", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("coef", "std_err", "z", "p", "lower", "upper")],
]


@F.pandas_udf(T.DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return z.map(tails.normal_two_sided, na_action="ignore").astype("float64")


def _mixed_rows(table: pd.DataFrame, factors: Sequence[str]) -> list[tuple]:
    single = table[table["i"].notna() & table["j"].isna()]
    names = sorted(single["i"].unique())
    number = {c: k for k, c in enumerate(names)}
    cells = pd.DataFrame([json.loads(c) for c in names])
    cells = cells.reindex(columns=[f"f{i}" for i in range(len(factors))]).set_axis(list(factors), axis=1)
    p = len(names)
    labels, blocks = ["Intercept"], [np.ones((p, 1))]
    for term in crossed_terms(factors):
        blocks.append(_term_columns(cells, term))
        parts = [""]
        for f in term:
            tags = [f"{f}[T.{lv}]" for lv in sorted(cells[f].unique())[1:]]
            parts = [f"{a}:{b}" if a else b for a in parts for b in tags]
        labels += parts
    moments = []
    for n, rows in table.groupby("n"):
        one = rows[rows["i"].notna() & rows["j"].isna()]
        two = rows[rows["j"].notna()]
        size = rows[rows["i"].isna()].iloc[0]
        x, xy, st, cross = np.zeros(p), np.zeros(p), np.zeros(p), np.zeros((p, p))
        at = one["i"].map(number).to_numpy()
        x[at], xy[at], st[at] = one["a"], one["b"], one["c"]
        i, j = two["i"].map(number).to_numpy(), two["j"].map(number).to_numpy()
        cross[i, j] = two["a"]
        cross[j, i] = two["a"]
        moments.append((float(n), size["a"], size["b"], size["c"], x, xy, st, cross))
    result = _reml(moments, np.column_stack(blocks))
    out = [
        (name, float(b), float(se), None, None, float(b - 1.959963984540054 * se), float(b + 1.959963984540054 * se))
        for name, b, se in zip(labels, result["beta"], result["se"])
    ]
    out.append(("Group Var", result["group_var"], None, None, None, None, None))
    out.append(("Residual Var", result["scale"], None, None, None, None, None))
    return out


def _reml(table: list[tuple], design: np.ndarray) -> dict:
    """Search the ratio of variances on the summed moments of every device size."""
    p = design.shape[0]
    total = float(sum(n * m for n, m, *_ in table))
    # empty combinations make columns depend on others: solve in the space of the design
    left, size, right = np.linalg.svd(design, full_matrices=False)
    keep = size > 1e-10 * size[0]
    base, right = left[:, keep] * size[keep], right[keep]
    q = int(keep.sum())
    # squares within devices and between them, so that a large ratio loses no digits
    inner = (np.zeros((p, p)), np.zeros(p), 0.0)
    outer = []
    for n, m, yy, tt, x, xy, st, cross in table:
        inner = (inner[0] + np.diag(x) - cross / n, inner[1] + xy - st / n, inner[2] + yy - tt / n)
        outer.append((n, m, cross / n, st / n, tt / n))

    def moments(theta: float):
        a, b, c, logdet = *inner, 0.0
        for n, m, cross, st, tt in outer:
            share = 1.0 / (1.0 + n * theta)
            a, b, c = a + share * cross, b + share * st, c + share * tt
            logdet += m * np.log1p(n * theta)
        xx = base.T @ a @ base
        xy = base.T @ b
        inverse = np.linalg.inv(xx)
        beta = inverse @ xy
        rss = float(c - beta @ xy)
        return right.T @ beta, right.T @ inverse @ right, rss, logdet, np.linalg.slogdet(xx)[1]

    def loss(log_theta: float) -> float:
        try:
            _, _, rss, logdet, info = moments(np.exp(log_theta))
        except np.linalg.LinAlgError:  # beyond what doubles can tell apart
            return np.inf
        return (total - q) * np.log(max(rss, 1e-300)) + logdet + info

    low, high, best = -14.0, 10.0, 0
    while True:
        grid = np.arange(low, high + 0.125, 0.25)
        values = [loss(g) for g in grid]
        best = int(np.argmin(values))
        # widen while the least value lies on an edge; below, no device effect is the limit
        if best == len(grid) - 1 and high < 300.0:
            high += 6.0
        elif best == 0 and low > -38.0:
            low -= 12.0
        else:
            break
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    golden = (np.sqrt(5.0) - 1.0) / 2.0
    for _ in range(80):
        one, two = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, two) if loss(one) < loss(two) else (one, high)
    log_theta = (low + high) / 2.0
    # no device effect at all is a valid answer
    theta = 0.0 if loss(-40.0) <= loss(log_theta) else float(np.exp(log_theta))
    beta, inverse, rss, _, _ = moments(theta)
    scale = rss / (total - q)
    return {
        "beta": beta,
        "se": np.sqrt(np.clip(np.diag(inverse) * scale, 0.0, None)),
        "scale": float(scale),
        "group_var": float(theta * scale),
    }


# Names of the tests as results carry them, and how a formula is written.
TEST_NAMES = {"aov": "ANOVA (Type II)", "lmm": "Linear mixed model (DFM random intercept)"}
FORMULA, TERM = "Y ~ ", "C({})"


class Comparison(NamedTuple):
    table: DataFrame
    posthoc: DataFrame | None
    model: str
    formula: str


def compare_treatments(
    values: DataFrame,
    y: str,
    factors: Sequence[str] = ("Treatment",),
    model: str = "aov",
    posthoc: str = "tukey",
) -> Comparison:
    """Test a metric between treatments, by analysis of variance or mixed model."""
    if model not in TEST_NAMES:
        raise ValueError(f"{model!r} is no test; choose one of {', '.join(TEST_NAMES)}")
    table = (anova if model == "aov" else mixed_model)(values, y, factors)
    single = len(factors) == 1 and posthoc == "tukey"
    return Comparison(
        table,
        tukey(values, y, factors[0]) if single else None,
        TEST_NAMES[model],
        FORMULA + " * ".join(map(TERM.format, factors)),
    )
