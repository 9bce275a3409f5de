"""What sizes, names and orders must not change."""

import csv

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutspark import staging
from boutspark.functions import tails
from boutspark.operators import access, quality, stats
from boutspark.params import REC, Params
from boutspark.plans.experiment import basic_analysis, detect_contacts, load_window
from boutspark.sources.recordings import natural_key, read_ticks, samples_from_ticks
from boutspark.staging import release, run_folder, stage

WELLS = [f"W{w}" for w in range(1, 13)]


def test_analysis_of_3000_cells(spark):
    rng = np.random.default_rng(5)
    a, b = np.divmod(np.arange(3000).repeat(2), 60)
    d = pd.DataFrame({"A": a, "B": b, "y": rng.normal(size=6000) + a / 10.0})
    got = stats.anova(spark.createDataFrame(d), "y", ["A", "B"]).toPandas().set_index("term")
    means = d.groupby(["A", "B"]).y.mean().unstack()
    grand = means.to_numpy().mean()
    # balanced: the squares of a factor are those of its means
    assert got.sum_sq["A"] == pytest.approx(120 * ((means.mean(axis=1) - grand) ** 2).sum())
    assert got.sum_sq["B"] == pytest.approx(100 * ((means.mean(axis=0) - grand) ** 2).sum())
    assert got.df.to_dict() == {"A": 49.0, "B": 59.0, "A:B": 49.0 * 59, "Residual": 3000.0}


def test_mixed_model_of_70_cells(spark):
    rng = np.random.default_rng(6)
    rows = [
        ("p", d, f"t{k:02d}", f"s{j}", float(k + 3 * j + rng.normal() + 2 * (d % 5)))
        for d in range(1, 13)
        for k in range(35)
        for j in range(2)
    ]
    df = spark.createDataFrame(rows, "project string, dfm int, A string, B string, y double")
    got = stats.mixed_model(df, "y", ["A", "B"]).toPandas().set_index("term")
    assert len(got) == 72 and got.coef["Group Var"] > 3
    assert got.coef["A[T.t34]"] == pytest.approx(34, abs=3)


def test_a_large_device_effect_is_not_clipped(spark):
    rng = np.random.default_rng(7)
    rows = [("p", d, "x" if i % 2 else "y", 1e2 * d + rng.normal(scale=1e-2)) for d in range(1, 9) for i in range(20)]
    df = spark.createDataFrame(rows, "project string, dfm int, A string, y double")
    got = stats.mixed_model(df, "y", ["A"]).toPandas().set_index("term")
    assert got.coef["Group Var"] == pytest.approx(np.var(1e2 * np.arange(1, 9), ddof=1), rel=1e-2)


def test_tails_of_many_degrees_of_freedom():
    assert tails.f_tail(1.0, 1e6, 1e6) == pytest.approx(0.5, abs=1e-7)
    assert tails.f_tail(1.0, 1e8, 1e8) == pytest.approx(0.5, abs=1e-6)


def test_bootstrap_is_equal_on_any_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [("g", i // 6, i % 6, float(v)) for i, v in enumerate(rng.normal(5, 2, 40))]
    df = spark.createDataFrame(rows, "Group string, dfm int, chamber int, Value double")
    found = []
    for n in (1, 4, 8):
        got = stats.bootstrap(df.repartition(n), ["dfm", "chamber"], n_boot=200, seed=3).samples.toPandas()
        found.append(got.sort_values(["Group", "iter"])["mean"].tolist())
    assert found[0] == found[1] == found[2]


def test_long_numbers_in_names(spark):
    names = ["DFM1_" + "9" * 25 + ".csv", "DFM1_1" + "0" * 25 + ".csv", "DFM1_9.csv", "DFM1_10.csv", "DFM1_A.csv", "DFM1_a.csv"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("key", natural_key(F.col("name")))
    got = [r["name"] for r in df.orderBy("key").collect()]
    assert got[:4] == ["DFM1_9.csv", "DFM1_10.csv", "DFM1_" + "9" * 25 + ".csv", "DFM1_1" + "0" * 25 + ".csv"]
    assert df.select("key").distinct().count() == len(names)


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def test_file_order_differing_columns_and_error_columns(spark, tmp_path):
    head = ["Index", "Seconds", *WELLS, "I2CError", "StateError"]
    rows = [
        [1, 0.0, *[1.0] * 12, 0, ""],
        [3, 0.2, *[3.0] * 12, 5, "na"],
        [2, 0.4, *[2.0] * 12, "", "bad"],
        [2, 100.0, *[4.0] * 12, 1, "0"],
    ]
    write(tmp_path / "one" / "data" / "DFM1_1.csv", head, rows)
    write(tmp_path / "two" / "data" / "DFM1_1.csv", ["Sample", "Seconds", *WELLS, "OptoCol1"], [[1, 0.0, *[7.0] * 12, 3]])
    ticks = read_ticks(spark, str(tmp_path)).cache()
    got = ticks.where("project = 'one'").orderBy("pos").collect()
    assert [r["sample"] for r in got] == [1, 3, 2, 2]
    assert [r["W1"] for r in got] == [1.0, 3.0, 2.0, 4.0]
    assert ticks.where("project = 'two'").first()["OptoCol1"] == 3
    one = ticks.where("project = 'one'")
    assert quality.integrity(one, REC, clock=None).first()["IndexByOne"] is False
    counts = {r["Column"]: r for r in quality.error_columns(one, REC).collect()}
    shape = lambda r: (r["NonMissing"], r["Missing"], r["Flagged"])
    assert shape(counts["I2CError"]) == (3, 1, 2)
    assert shape(counts["StateError"]) == (3, 1, 1)
    assert counts["I2CError"]["I2C Error"] == 2 and counts["I2CError"]["PacketType Error"] == 1
    breaks = quality.data_breaks(one, REC, 5.0)
    assert [r["Index"] for r in breaks.collect()] == [4]


def test_one_gap_is_one_break(spark):
    rows = [("p", 1, w, p // 4, p, p / 5 + (50 if p > 6 else 0)) for p in range(10) for w in range(1, 13)]
    df = spark.createDataFrame(rows, "project string, dfm int, well int, chunk long, pos long, seconds double")
    assert quality.data_breaks(quality.device_ticks(df), REC, 5.0).count() == 1


def test_load_window_with_a_clock_that_steps_back(spark):
    minutes = [0, 1, 2, 3, 1.5, 2.5, 9, 2.2]
    rows = [("p", 1, 1, 0, i, float(m)) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "project string, dfm int, well int, chunk long, pos long, minutes double")
    got = load_window(df, REC, 1, 3).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 1, 2, 3]
    assert [r["minutes"] for r in got] == [2.0, 1.5, 2.5, 2.2]


def test_staged_tables_can_be_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path))
    stage(spark.range(3), "numbers")
    folder = tmp_path / run_folder(spark).rsplit("/", 1)[1]
    assert any(folder.glob("numbers-*"))
    assert release(spark) and not folder.exists()
    assert not release(spark)
    assert stage(spark.range(3), "numbers").count() == 3


def test_basic_analysis_judges_every_error_column(spark, tmp_path):
    head = ["Sample", "Seconds", *WELLS, "I2CError", "StateError"]
    states = ["na", "bad", "", "0", "worse", "na"]
    rows = [[i + 1, i / 5, *[1.0] * 12, 5 if i == 5 else 0, states[i]] for i in range(6)]
    write(tmp_path / "one" / "data" / "DFM1_1.csv", head, rows)
    params = Params.two_well()
    samples = samples_from_ticks(read_ticks(spark, str(tmp_path)))
    seated = access.seat_samples(samples, access.seats_from_params(spark, params))
    base, labelled = detect_contacts(seated, params)
    design = spark.createDataFrame([("one", 1, c, "T") for c in range(1, 7)], "project string, dfm int, chamber int, Treatment string")
    found = basic_analysis(base, labelled, design, params)
    assert {r["Flagged"] for r in found.integrity.collect()} == {3}
    counts = {(r["Column"], r["Flagged"], r["Missing"]) for r in found.errors.collect()}
    assert counts == {("I2CError", 1, 0), ("StateError", 2, 1)}
