"""First lines of device files, and device files written by tasks."""

import os

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from boutspark.sources import recordings
from boutspark.sources.files import can_open, header_of, with_headers, write_device_files


def test_header_is_the_first_line_with_a_letter(tmp_path):
    texts = {
        "plain": ("Sample,W1\n1,2\n", "Sample,W1"),
        "marked": ("﻿Sample,W1\r\n1,2\r\n", "﻿Sample,W1"),
        "late": ("\n# 12\n1,2\n\"Index\",W1\n3,4\n", '"Index",W1'),
        "short": ("Index", "Index"),
        "none": ("1,2\n3,4\n", None),
        "empty": ("", None),
    }
    for name, (text, want) in texts.items():
        path = tmp_path / name
        path.write_text(text, encoding="utf-8", newline="")
        # also where the line is longer than a block
        assert header_of(str(path), 4) == header_of(f"file:{path}") == want, name


def test_only_first_blocks_are_read(tmp_path):
    path = tmp_path / "long.csv"
    path.write_bytes(b"Sample,W1\n" + b"\xff" * 10_000_000)
    with open(path, "r+b") as f:
        f.truncate(1 << 40)  # a sparse file nobody could read in a test
    assert header_of(str(path)) == "Sample,W1"


def test_kinds_of_paths():
    assert can_open("/a/b") and can_open("file:/a/b") and can_open("file:///a/b")
    assert not can_open("remote-of-somebody://a/b")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("device files+more"))  # blanks and signs are escaped in metadata
    rows = [("my project", d, i, i + 1, i / 5, float(10 * d + i), None if i == 3 else 1.0) for d in (1, 2) for i in range(23)]
    ticks = spark.createDataFrame(rows, "project string, dfm bigint, pos bigint, Sample bigint, Seconds double, W1 double, W2 double")
    assert write_device_files(ticks, root, ticks_per_file=5, first_part=8) == 10
    return root


def test_round_trip(spark, folder):
    data = os.path.join(folder, "my project", "data")
    assert sorted(os.listdir(data)) == sorted(f"DFM{d}_{p}.csv" for d in (1, 2) for p in range(8, 13))
    got = recordings.read_ticks(spark, folder, chunk_rows=4).orderBy("dfm", "pos").collect()
    assert [(r["project"], r["dfm"], r["pos"], r["sample"], r["W1"], r["W2"]) for r in got] == [
        ("my project", d, i, i + 1, float(10 * d + i), None if i == 3 else 1.0) for d in (1, 2) for i in range(23)
    ]


def test_files_are_not_groups_of_their_own(spark, tmp_path, monkeypatch):
    """Many small files are written by one pass over sorted rows, also where they go on in the next batch."""

    def refused(*_):
        raise AssertionError("a group per file")

    monkeypatch.setattr(GroupedData, "applyInPandas", refused)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [("p", d, i, i + 1 if i != 4 else None, 2**53 + i, f'{i},"\n' if i % 2 else None) for d in (1, 2) for i in range(23)]
    try:
        ticks = spark.createDataFrame(rows, "project string, dfm bigint, pos bigint, Sample bigint, Big bigint, Told string")
        times = ticks.withColumn("At", F.timestamp_seconds("Sample"))
        assert write_device_files(times.repartition(5), str(tmp_path), ticks_per_file=7, first_part=9) == 8
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    data = tmp_path / "p" / "data"
    assert sorted(os.listdir(data)) == sorted(f"DFM{d}_{p}.csv" for d in (1, 2) for p in range(9, 13))
    clock = "1970-01-01 00:00:"
    # a file with an empty number has them with a point, as pandas writes such a column
    want = [f'{n},{2**53 + i},{told},{at}' for i, n, told, at in [
        (0, "1.0", "", clock + "01"), (1, "2.0", '"1,""\n"', clock + "02"), (2, "3.0", "", clock + "03"), (3, "4.0", '"3,""\n"', clock + "04"),
        (4, "", "", ""), (5, "6.0", '"5,""\n"', clock + "06"), (6, "7.0", "", clock + "07")]]
    assert (data / "DFM1_9.csv").read_text() == "\n".join(["Sample,Big,Told,At", *want, ""])
    assert (data / "DFM2_12.csv").read_text() == f'Sample,Big,Told,At\n22,{2**53 + 21},"21,""\n",{clock}22\n23,{2**53 + 22},,{clock}23\n'


def test_scan_of_lines_finds_the_same_headers(spark, folder, monkeypatch):
    files = recordings.list_files(spark, folder).select("path", (F.col("rank") == 3).alias("newest"))
    opened = sorted(map(tuple, with_headers(files).collect()))
    monkeypatch.setattr(recordings, "can_open", lambda root: False)
    assert sorted(map(tuple, recordings._headers(files, folder).collect())) == opened
    assert {h for _, _, h in opened} == {"Sample,Seconds,W1,W2"}


def test_nothing_to_load(spark, tmp_path):
    (tmp_path / "p" / "data").mkdir(parents=True)
    (tmp_path / "p" / "data" / "DFM1_1.csv").write_text("")
    with pytest.raises(ValueError, match="no device files"):
        recordings.read_ticks(spark, str(tmp_path))


def test_files_are_opened_by_one_scan_of_their_folders(spark, tmp_path, monkeypatch):
    asked = []
    plain = type(spark.read).csv
    monkeypatch.setattr(type(spark.read), "csv", lambda self, path, *a, **k: (asked.append(path), plain(self, path, *a, **k))[1])
    ticks = spark.createDataFrame(
        [(p, d, i, i + 1, i / 5, float(i)) for p in ("a", "b") for d in (1, 2) for i in range(30)],
        "project string, dfm bigint, pos bigint, Sample bigint, Seconds double, W1 double",
    )
    write_device_files(ticks.where("dfm = 1"), str(tmp_path), ticks_per_file=2)
    write_device_files(ticks.where("dfm = 2").withColumn("W2", F.col("W1") + 1), str(tmp_path), ticks_per_file=2)
    # a file below another folder of files, and one that does not count
    inner = tmp_path / "a" / "data" / "data"
    inner.mkdir()
    (inner / "DFM7_1.csv").write_text("Seconds,W1\n0,5\n\n0.2,6,7\nSeconds,W1\n")
    (tmp_path / "b" / "data" / "DFM_1.csv").write_text("Index,W1\n1,2\n")
    got = recordings.read_ticks(spark, str(tmp_path))
    assert len([p for paths in asked for p in ([paths] if isinstance(paths, str) else paths)]) <= 2 + 3
    rows = got.where("dfm < 7").groupBy("project", "dfm").agg(F.count("W1").alias("n"), F.count("W2").alias("m"), F.max("pos").alias("p"))
    assert sorted(map(tuple, rows.collect())) == [(p, d, 30, 30 * (d - 1), 29) for p in ("a", "b") for d in (1, 2)]
    odd = got.where("dfm = 7").orderBy("pos").collect()
    assert [(r["project"], r["pos"], r["sample"], r["W1"]) for r in odd] == [("data", 0, 1, 5.0), ("data", 1, 2, 6.0), ("data", 2, 3, None)]


@pytest.mark.parametrize("opens", [True, False])
def test_lines_before_a_header_are_an_error(spark, tmp_path, monkeypatch, opens):
    folder = tmp_path / "p" / "data"
    folder.mkdir(parents=True)
    (folder / "DFM1_1.csv").write_text("Sample,Seconds,W1\n1,0,2\n")
    (folder / "DFM1_2.csv").write_text("12\nSample,Seconds,W1\n2,1,2\n")
    monkeypatch.setattr(recordings, "can_open", lambda root: opens)
    with pytest.raises(Exception, match="lines before the header"):
        recordings.read_ticks(spark, str(tmp_path)).collect()
