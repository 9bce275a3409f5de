"""Device files, exclusions and sinks, written to a temporary folder and read back."""

import csv
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boutspark.functions.scalars import epoch_micros
from boutspark.operators.ratio import training_end
from boutspark.params import REC
from boutspark.sources import sinks
from boutspark.sources.exclusions import read_exclusions, write_exclusions
from boutspark.sources.recordings import chosen_files, coverage, list_files, read_ticks, samples_from_ticks
from boutspark.sources.tables import price_recording, price_signal

WELLS = [f"W{w}" for w in range(1, 13)]


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


@pytest.fixture(scope="module")
def projects(tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    head3 = ["Sample", "Seconds", *WELLS, "OptoCol1", "OptoCol2", "Error"]

    def rows(first, count, seconds):
        # wells 1 and 5 are in training for the first samples; one value is unreadable
        for i in range(first, first + count):
            wells = [i + w / 100 for w in range(1, 13)]
            if i <= 3:
                wells[0] += 65536
            if i <= 5:
                wells[4] += 65536
            if i == 8:
                wells[1] = "bad"
            yield [i, seconds(i), *wells, 0b101 if i % 2 else 0, 0, 3 if i == 2 else 0]

    data = root / "alpha" / "data"
    write(data / "DFM1_2.csv", head3, rows(1, 6, lambda i: i / 5))
    write(data / "DFM1_10.csv", head3, rows(7, 6, lambda i: i / 5))
    write(data / "DFM_1.csv", head3, [[99] * len(head3)])
    head2 = ["Index", "Seconds", *WELLS]
    write(data / "DFM_2.csv", head2, [[i, i / 5, *[float(i)] * 12] for i in range(1, 5)])
    write(data / "DFM_2_1.csv", head2, [[i, i / 5, *[-1.0] * 12] for i in range(1, 5)])
    write(data / "notes.csv", ["a"], [[1]])
    clock = ["Index", "Date", "Time", "MSec", *WELLS]
    beta = root / "beta" / "data"
    stamps = [("11:59:58 AM", 250), ("11:59:59 AM", 500), ("12:00:01 PM", 0), ("1:00:00 PM", 750)]
    write(
        beta / "DFM1_a.csv",
        clock,
        [[i, "12/31/2023", t, ms, *[1.0] * 12] for i, (t, ms) in enumerate(stamps, 1)],
    )
    return root


def test_files_chosen_by_version(spark, projects):
    chosen = chosen_files(list_files(spark, str(projects)))
    got = sorted((r["project"], r["dfm"], r["path"].split("/")[-1]) for r in chosen.collect())
    assert got == [
        ("alpha", 1, "DFM1_10.csv"),
        ("alpha", 1, "DFM1_2.csv"),
        ("alpha", 2, "DFM_2.csv"),
        ("beta", 1, "DFM1_a.csv"),
    ]


@pytest.fixture(scope="module")
def alpha(spark, projects):
    return read_ticks(spark, str(projects / "alpha"), chunk_rows=4).cache()


def test_segments_in_natural_order(alpha):
    got = [r for r in alpha.filter("dfm = 1").orderBy("pos").collect()]
    assert [r["pos"] for r in got] == list(range(12))
    assert [r["sample"] for r in got] == list(range(1, 13))
    assert [r["chunk"] for r in got] == [i // 4 for i in range(12)]
    assert got[4]["minutes"] == pytest.approx(5 / 5 / 60)


def test_training_mark_and_light(alpha):
    rows = samples_from_ticks(alpha).filter("dfm = 1")
    w = {(r["well"], r["sample"]): r for r in rows.collect()}
    assert w[1, 2]["signal"] == pytest.approx(2.01) and w[1, 2]["raw_signal"] > 60000
    assert w[2, 8]["signal"] is None
    assert w[1, 3]["lit"] and w[3, 3]["lit"] and not w[2, 3]["lit"] and not w[1, 4]["lit"]
    ends = {r["well"]: (r["Minutes"], r["Sample"]) for r in training_end(rows).collect()}
    assert ends[1] == (pytest.approx(3 / 5 / 60), 3) and ends[5][1] == 5 and ends[2] == (None, None)


def test_old_version_has_no_training(alpha):
    two = samples_from_ticks(alpha).filter("dfm = 2")
    assert two.count() == 48
    assert two.agg(F.min("signal")).first()[0] == 1.0
    assert two.filter("lit").count() == 0


def test_load_window_is_open(spark, projects):
    got = read_ticks(spark, str(projects / "alpha"), start=2 / 5 / 60, end=6 / 5 / 60).filter("dfm = 1")
    rows = got.orderBy("pos").collect()
    assert [r["sample"] for r in rows] == [3, 4, 5]
    assert [r["pos"] for r in rows] == [0, 1, 2]


def test_clock_columns(spark, projects):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    rows = read_ticks(spark, str(projects / "beta")).orderBy("pos").collect()
    spark.conf.set("spark.sql.session.timeZone", zone)
    # the milliseconds of the first row stay in
    assert [r["seconds"] for r in rows] == pytest.approx([0.25, 1.5, 3.0, 3602.75])


def test_only_configured_devices(spark, projects):
    devices = spark.createDataFrame([("alpha", 2), ("alpha", 7)], "project string, dfm bigint")
    assert {r["dfm"] for r in read_ticks(spark, str(projects), devices).collect()} == {2}
    found = coverage(devices, list_files(spark, str(projects))).collect()
    got = sorted((r["project"], r["severity"], r["subject"]) for r in found)
    assert got == [("alpha", "warning", "1"), ("alpha", "warning", "7"), ("beta", "warning", "1")]
    with pytest.raises(ValueError):
        read_ticks(spark, str(projects), devices.filter("dfm = 7"))


def test_exclusions_round_trip(spark, tmp_path):
    path = str(tmp_path / "removed")
    assert read_exclusions(spark, path).count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "dfm bigint, chamber bigint, note string")
    write_exclusions(path, "general", rows((1, 2, "dry"), (1, 3, "")))
    write_exclusions(path, "late", rows((5, 1, "")))
    write_exclusions(path, "general", rows((2, 6, "again")))
    got = sorted((r["group"], r["dfm"], r["chamber"], r["note"]) for r in read_exclusions(spark, path).collect())
    assert got == [("general", 2, 6, "again"), ("late", 5, 1, "")]
    write_exclusions(path, "general", rows((1, 1, "")).limit(0))
    assert {r["group"] for r in read_exclusions(spark, path).collect()} == {"late"}


def test_exclusions_skip_bad_rows(spark, tmp_path):
    write(
        tmp_path / "x.csv",
        ["group", "dfm_id", "chamber", "note"],
        [["general", 1, 2, ""], ["general", 1, 2, ""], ["", 1, 3, ""], ["general", "x", 1, ""], [" a ", 1, 1, "n"]],
    )
    got = sorted((r["group"], r["dfm"], r["chamber"]) for r in read_exclusions(spark, str(tmp_path / "x.csv")).collect())
    assert got == [("a", 1, 1), ("general", 1, 2)]


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, 2, 0.5), ("p", 2, 1, None)], "project string, dfm bigint, chamber bigint, PI double")
    assert sinks.write_tables({"one": df, "none": None}, str(tmp_path / "out")) == ["one"]
    back = spark.read.option("header", "true").csv(str(tmp_path / "out" / "one"))
    assert sorted(r["dfm"] for r in back.collect()) == ["1", "2"]
    sinks.write_quality({"breaks": df}, str(tmp_path / "qc"))
    assert spark.read.parquet(str(tmp_path / "qc" / "breaks")).filter("dfm = 2").count() == 1
    gone = spark.createDataFrame([("p", 1, 2)], "project string, dfm bigint, chamber bigint")
    sinks.write_included(df, gone, str(tmp_path / "kept"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "kept")).count() == 1
    assert REC == ("project", "dfm")


def test_clock_without_zone_ignores_the_session_zone(spark):
    """Hours that New York skips or repeats keep their order."""
    clocks = ["2024-03-10 01:59:00", "2024-03-10 02:30:00.25", "2024-03-10 03:10:00", "2024-11-03 01:30:00"]
    df = spark.sql(
        "select cast(c as timestamp_ntz) as ts from values " + ", ".join(f"('{c}')" for c in clocks) + " as t(c)"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    got = sorted(r[0] for r in df.select(epoch_micros(df, "ts")).collect())
    spark.conf.set("spark.sql.session.timeZone", zone)
    want = [int(datetime.fromisoformat(c + "+00:00").timestamp() * 1e6) for c in clocks]
    assert got == want


def test_replacing_a_group_leaves_the_others_alone(spark, tmp_path):
    """Files of other groups are not touched; a failure half-way loses nothing; a table made by hand is taken over."""
    path = tmp_path / "exclusions"
    path.mkdir()
    (path / "hand.csv").write_text("group,dfm_id,chamber,note\ngeneral,1,2,dry\nlate hours,5,1,\nbad,x,1,\n")

    def rows(*r):
        return spark.createDataFrame(r, "dfm bigint, chamber bigint, note string")

    def now():
        return sorted((r["group"], r["dfm"], r["chamber"], r["note"]) for r in read_exclusions(spark, str(path)).collect())

    write_exclusions(str(path), "general", rows((2, 6, "again")))
    assert now() == [("general", 2, 6, "again"), ("late hours", 5, 1, "")]
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.csv") if "late" in str(f)}
    write_exclusions(str(path), "general", rows((3, 3, "")))
    assert before and before == {f: f.stat().st_mtime_ns for f in path.rglob("*.csv") if "late" in str(f)}
    broken = rows((4, 4, ""), (5, 5, "")).repartition(2).withColumn(
        "note", F.when(F.col("dfm") == 5, F.raise_error(F.lit("lost"))).otherwise("")
    )
    with pytest.raises(Exception, match="lost"):
        write_exclusions(str(path), "general", broken)
    assert now() == [("general", 3, 3, ""), ("late hours", 5, 1, "")]
    write_exclusions(str(path), "general", rows().limit(0))
    assert now() == [("late hours", 5, 1, "")]


def test_price_rows_carry_only_what_the_baseline_needs(spark, tmp_path):
    items = [(s, o, 1, 7, 1000.0 * s + o) for s in (0, 1, 11, 12, 25) for o in (70_000, 3, 9)]
    columns = "l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_partkey bigint, l_extendedprice double"
    spark.createDataFrame(items, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    thin = price_signal(spark, str(tmp_path))
    assert set(thin.columns) == {"project", "dfm", "well", "chunk", "pos", "signal"}
    want = [
        (s // 12 + 1, s % 12 // 2 + 1, s % 12 + 1, "AB"[s % 2], s % 2 + 1, 0, i, i + 1, float(i), s + o / 1000, 0, False)
        for s in (0, 1, 11, 12, 25)
        for i, o in enumerate((3, 9, 70_000))
    ]
    shown = ["dfm", "chamber", "well", "side", "slot", "chunk", "pos", "sample", "minutes", "signal", "opto", "lit"]
    assert sorted(map(tuple, price_recording(spark, str(tmp_path)).select(*shown).collect())) == sorted(want)
