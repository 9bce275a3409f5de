"""Connected components of a table of links, by hooking and pointer jumping.

Every node hooks onto its least smaller neighbour, the forest is flattened by jumps, the
links are rewritten to roots, and what is left goes round again. Rounds are few (about
the logarithm of the longest path) and each is written to the shared folder; the driver
sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutspark.staging import stage


def _tidy(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the least node reachable."""
    links = stage(_tidy(links.select("a", "b")), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    while not links.isEmpty():
        hooks = stage(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stage(hooks.join(above, "up", "left").select("node", "up", "top"), "jumps")
            moved = not jumped.where("top is not null").isEmpty()
            hooks = jumped.select("node", F.coalesce("top", "up").alias("up"))
            if not moved:
                break
        root = hooks.select(F.col("node").alias("comp"), F.col("up").alias("root"))
        labels = stage(
            labels.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels"
        )
        left = hooks.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        moved_links = (
            links.join(left, "a", "left")
            .join(right, "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        )
        links = stage(_tidy(moved_links), "links")
    return labels
