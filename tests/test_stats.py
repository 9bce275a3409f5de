"""Scans, medians and statistics against numpy and published table values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutspark.functions import tails
from boutspark.operators import exclude, stats
from boutspark.operators.medians import group_median
from boutspark.operators.scan import ordered_scan


def test_ordered_scan_in_chunks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(
        [(k, i, float(v) if v > -0.3 else None) for k in "ab" for i, v in enumerate(rng.normal(size=23))],
        columns=["k", "pos", "v"],
    )
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, pos bigint, v double")
    df = df.withColumn("chunk", F.expr("pos div 4"))
    v = F.col("v")
    got = ordered_scan(
        df, ["k"], ["pos"],
        sums={"total": F.coalesce(v, F.lit(0.0)), "nr": F.lit(1)},
        lags={"before": v}, leads={"after": v}, lasts={"last": v}, nexts={"next": v},
    ).toPandas().sort_values(["k", "pos"])
    for k, g in pdf.groupby("k"):
        mine = got[got.k == k]
        assert mine.total.tolist() == pytest.approx(g.v.fillna(0).cumsum().tolist())
        assert mine.nr.tolist() == list(range(1, 24))
        for name, want in (("before", g.v.shift(1)), ("after", g.v.shift(-1)), ("last", g.v.ffill()), ("next", g.v.bfill())):
            assert mine[name].tolist() == pytest.approx(want.tolist(), nan_ok=True), name


def test_exact_medians(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 9, 900), "v": np.round(rng.normal(0, 40, 900), 1)})
    pdf.loc[pdf.k == 3, "v"] = 7.25
    pdf.loc[pdf.k == 4, "v"] *= 1e9
    pdf.loc[pdf.k == 5, "v"] /= 1e6
    got = group_median(spark.createDataFrame(pdf), ["k"], "v", "m").toPandas()
    want = pdf.groupby("k").v.median()
    assert dict(zip(got.k, got.m)) == pytest.approx(want.to_dict())


def test_tail_table_values():
    """Upper 5 % points of F and of the studentized range from printed tables."""
    for df1, df2, f in ((1, 10, 4.965), (2, 12, 3.885), (4, 30, 2.690), (3, 120, 2.680)):
        assert tails.f_tail(f, df1, df2) == pytest.approx(0.05, abs=2e-4)
    for k, df, q in ((2, 5, 3.635), (3, 10, 3.877), (3, 60, 3.399), (4, 20, 3.958), (10, 30, 4.824)):
        assert tails.range_quantile(0.05, k, df) == pytest.approx(q, abs=2e-3)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_tail(0.0, 2, 5) == 1.0 and tails.f_tail(None, 2, 5) is None


@pytest.fixture(scope="module")
def observations():
    rng = np.random.default_rng(8)
    rows = []
    for dfm in range(1, 15):
        shift = rng.normal(0, 2)
        for ch in range(1, int(rng.integers(3, 8))):
            a, b = ("x", "y", "z")[int(rng.integers(3))], ("m", "f")[int(rng.integers(2))]
            y = 10 + 2 * (a == "y") + 1.5 * (b == "m") + 3 * (a == "z") * (b == "f") + shift + rng.normal()
            rows.append(("p", dfm, ch, a, b, float(y), float(rng.integers(0, 5))))
    return pd.DataFrame(rows, columns=["project", "dfm", "chamber", "A", "B", "y", "w"])


def rss(x, y, w=None):
    root = np.ones(len(y)) if w is None else np.sqrt(w)
    beta, *_ = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)
    r = (y - x @ beta) * root
    return float(r @ r)


def columns(df, *terms):
    out = [np.ones(len(df))]
    dummies = {f: [(df[f] == lv).astype(float) for lv in sorted(df[f].unique())[1:]] for f in ("A", "B")}
    for t in terms:
        if ":" in t:
            out += [p * q for p in dummies["A"] for q in dummies["B"]]
        else:
            out += dummies[t]
    return np.column_stack(out)


def test_type_two_anova(spark, observations):
    d, y = observations, observations.y.to_numpy()
    got = stats.anova(spark.createDataFrame(d), "y", ["A", "B"]).toPandas().set_index("term")
    both = rss(columns(d, "A", "B"), y)
    full = rss(columns(d, "A", "B", "A:B"), y)
    assert got.sum_sq["A"] == pytest.approx(rss(columns(d, "B"), y) - both)
    assert got.sum_sq["B"] == pytest.approx(rss(columns(d, "A"), y) - both)
    assert got.sum_sq["A:B"] == pytest.approx(both - full)
    assert got.sum_sq["Residual"] == pytest.approx(full)
    assert got.df.to_dict() == {"A": 2, "B": 1, "A:B": 2, "Residual": len(d) - 6}
    f = got.F["A"]
    assert f == pytest.approx(got.sum_sq["A"] / 2 / (full / (len(d) - 6)))
    assert got.p["A"] == pytest.approx(tails.f_tail(f, 2, len(d) - 6))


def test_one_way_equals_general(spark, observations):
    df = spark.createDataFrame(observations)
    a = stats.anova_one_way(df, "y", "A").toPandas().set_index("term")
    b = stats.anova(df, "y", ["A"]).toPandas().set_index("term")
    assert a.sum_sq.to_dict() == pytest.approx(b.sum_sq.to_dict())
    assert a.p["A"] == pytest.approx(b.p["A"])


def test_weighted_sequential_anova(spark, observations):
    d = observations[observations.w > 0]
    y, w = d.y.to_numpy(), d.w.to_numpy()
    terms = [("B",), ("A",), ("A", "B")]
    got = stats.weighted_anova(spark.createDataFrame(observations), "y", "w", ["A", "B"], terms)
    got = got.toPandas().set_index("term")
    steps = [rss(columns(d), y, w), rss(columns(d, "B"), y, w), rss(columns(d, "A", "B"), y, w), rss(columns(d, "A", "B", "A:B"), y, w)]
    assert got.sum_sq["B"] == pytest.approx(steps[0] - steps[1])
    assert got.sum_sq["A"] == pytest.approx(steps[1] - steps[2])
    assert got.sum_sq["A:B"] == pytest.approx(steps[2] - steps[3])
    assert got.sum_sq["Residual"] == pytest.approx(steps[3])
    assert got.df["Residual"] == len(d) - 6


def test_mixed_model_against_dense_matrices(spark, observations):
    d = observations
    got = stats.mixed_model(spark.createDataFrame(d), "y", ["A", "B"]).toPandas().set_index("term")
    x, y = columns(d, "A", "B", "A:B"), d.y.to_numpy()
    same = (d.dfm.to_numpy()[:, None] == d.dfm.to_numpy()[None, :]).astype(float)
    n, q = x.shape

    def fit(theta):
        inv = np.linalg.inv(np.eye(n) + theta * same)
        info = x.T @ inv @ x
        beta = np.linalg.solve(info, x.T @ inv @ y)
        r = y - x @ beta
        s2 = r @ inv @ r / (n - q)
        value = (n - q) * np.log(s2) - np.linalg.slogdet(inv)[1] + np.linalg.slogdet(info)[1]
        return value, beta, s2, info

    grid = np.exp(np.linspace(-6, 5, 2201))
    best = min(grid, key=lambda t: fit(t)[0])
    _, beta, s2, info = fit(best)
    names = ["Intercept", "A[T.y]", "A[T.z]", "B[T.m]", "A[T.y]:B[T.m]", "A[T.z]:B[T.m]"]
    assert got.coef[names].tolist() == pytest.approx(beta.tolist(), rel=1e-2, abs=1e-3)
    se = np.sqrt(np.diag(np.linalg.inv(info)) * s2)
    assert got.std_err[names].tolist() == pytest.approx(se.tolist(), rel=1e-2)
    assert got.coef["Group Var"] == pytest.approx(best * s2, rel=2e-2)
    assert got.coef["Residual Var"] == pytest.approx(s2, rel=1e-2)


def test_mixed_model_per_key(spark, observations):
    """Every key has the fit it has alone; both are far from the origin."""
    many = pd.concat([observations.assign(metric=m, y=observations.y * f + 1e6) for m, f in (("one", 1.0), ("two", -3.0))])
    many.loc[(many.metric == "two") & (many.dfm == 3), "y"] = np.nan
    df = spark.createDataFrame(many)
    got = stats.mixed_model(df, "y", ["A", "B"], keys=["metric"]).toPandas()
    assert sorted(got.metric.unique()) == ["one", "two"]
    for metric, part in got.groupby("metric"):
        alone = stats.mixed_model(df.where(F.col("metric") == metric), "y", ["A", "B"]).toPandas()
        a, b = part.set_index("term").sort_index(), alone.set_index("term").sort_index()
        assert list(a.index) == list(b.index)
        for c in ("coef", "std_err", "z", "p", "lower", "upper"):
            assert a[c].tolist() == pytest.approx(b[c].tolist(), rel=1e-5, abs=1e-7, nan_ok=True), c


def test_tukey_pairs(spark, observations):
    d = observations
    got = stats.tukey(spark.createDataFrame(d), "y", "A").toPandas()
    assert sorted(zip(got.group1, got.group2)) == [("x", "y"), ("x", "z"), ("y", "z")]
    g = d.groupby("A").y
    mse = (g.var(ddof=1) * (g.count() - 1)).sum() / (len(d) - 3)
    for r in got.itertuples():
        se = np.sqrt(mse / 2 * (1 / g.count()[r.group1] + 1 / g.count()[r.group2]))
        diff = g.mean()[r.group2] - g.mean()[r.group1]
        assert r.meandiff == pytest.approx(diff)
        assert r.p_adj == pytest.approx(tails.range_tail(abs(diff) / se, 3, len(d) - 3))
        assert r.upper - r.meandiff == pytest.approx(tails.range_quantile(0.05, 3, len(d) - 3) * se)
        assert r.reject == (r.p_adj < 0.05)


def test_bootstrap_is_reproducible(spark):
    rng = np.random.default_rng(1)
    rows = [("g", i // 6, i % 6, float(v)) for i, v in enumerate(rng.normal(5, 2, 30))]
    rows += [("h", 1, 1, 4.0), ("none", 1, 2, None)]
    df = spark.createDataFrame(rows, "Group string, dfm int, chamber int, Value double")
    one = stats.bootstrap(df, ["dfm", "chamber"], n_boot=400, seed=3)
    two = stats.bootstrap(df.repartition(1), ["dfm", "chamber"], n_boot=400, seed=3)
    a = one.samples.toPandas().sort_values(["Group", "iter"])["mean"].tolist()
    assert a == two.samples.toPandas().sort_values(["Group", "iter"])["mean"].tolist()
    s = one.summary.toPandas().set_index("Group")
    values = np.array([r[3] for r in rows[:30]])
    assert s.n.to_dict() == {"g": 30, "h": 1, "none": 0}
    assert s["mean"]["g"] == pytest.approx(values.mean())
    # the resampled means spread like the standard error
    spread = np.std([m for m, k in zip(a, one.samples.toPandas().sort_values(["Group", "iter"]).Group) if k == "g"])
    assert spread == pytest.approx(values.std() / np.sqrt(30), rel=0.15)
    assert s.ci_low["h"] == s.ci_high["h"] == 4.0
    assert pd.isna(s["mean"]["none"]) and pd.isna(s.ci_low["none"])


def test_removal_reasons(spark):
    df = spark.createDataFrame(
        [("p", 1, 1, "t", 3.0, None), ("p", 1, 2, "t", 30.0, 5.0), ("p", 1, 3, "t", 1.5, 0.0)],
        "project string, dfm int, chamber int, Treatment string, LicksA double, LicksB double",
    )
    got = {r["chamber"]: r["Reason"] for r in exclude.low_lick_chambers(df, 5.0).collect()}
    cut = "min_untransformed_licks_cutoff=5"
    assert got == {1: f"LicksA=3 < {cut}; LicksB is NaN/undefined", 3: f"LicksA=1.5 < {cut}; LicksB=0 < {cut}"}
    got = exclude.low_lick_chambers(df, None).collect()
    assert [r["chamber"] for r in got] == [1]


def test_bootstrap_draws_are_dealt_and_never_broadcast(spark):
    rows = [(g, i, 1, float(i % 7)) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "Group string, dfm bigint, chamber bigint, Value double")
    plan = stats.bootstrap(df, ["dfm", "chamber"], n_boot=300, seed=3).samples._jdf.queryExecution().executedPlan().toString()
    # the join with the values is the one by shuffle; its draws come from a fixed number of parts
    assert "ShuffledHashJoin" in plan and "REPARTITION_BY_NUM" in plan
