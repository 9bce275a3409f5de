"""Named groups of excluded chambers, kept as CSV: one folder per group, or one table made by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from boutspark.staging import stage

SCHEMA = "group string, dfm_id string, chamber string, note string"


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """group, dfm, chamber, note; unreadable rows and blank groups drop out."""
    try:
        raw = spark.read.option("header", "true").schema(SCHEMA).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # nothing has been excluded yet
        raw = spark.createDataFrame([], SCHEMA)
    return (
        raw.select(
            F.trim("group").alias("group"),
            F.expr("try_cast(trim(dfm_id) as bigint)").alias("dfm"),
            F.expr("try_cast(trim(chamber) as bigint)").alias("chamber"),
            F.coalesce("note", F.lit("")).alias("note"),
        )
        .filter(F.col("dfm").isNotNull() & F.col("chamber").isNotNull() & (F.col("group") != ""))
        .dropDuplicates(["group", "dfm", "chamber"])
    )


def _in_one_table(spark: SparkSession, path: str) -> bool:
    """Are there rows that do not lie in a folder of their group (a file made by hand)?"""
    try:
        files = spark.read.schema(SCHEMA).csv(path).inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return any("/group=" not in f for f in files)


def write_exclusions(path: str, group: str, chambers: DataFrame) -> None:
    """Replace one group by `chambers` (dfm, chamber[, note]); others stay.

    Every group has a folder of its own, and only this group's is replaced, when
    all its rows are written: a failure before that leaves everything as it was.
    A row without a chamber, which readers drop, stands for the group, so an
    empty table clears it. A single table made by hand is taken apart once.
    """
    spark = chambers.sparkSession
    note = F.coalesce(F.col("note"), F.lit("")) if "note" in chambers.columns else F.lit("")
    new = chambers.select(
        F.lit(group).alias("group"), F.col("dfm").cast("bigint"), F.col("chamber").cast("bigint"), note.alias("note")
    )
    # a row that stands for the group, also when it is empty
    new = new.unionByName(spark.range(1).select(F.lit(group).alias("group")), allowMissingColumns=True)
    mode = "dynamic"
    if _in_one_table(spark, path):
        kept = read_exclusions(spark, path).filter(F.col("group") != group)
        new, mode = stage(kept.unionByName(new), "exclusions"), "static"
    (
        new.select("group", F.col("dfm").alias("dfm_id"), "chamber", "note")
        .write.mode("overwrite")
        .partitionBy("group")
        .option("partitionOverwriteMode", mode)
        .option("header", "true")
        .csv(path)
    )
