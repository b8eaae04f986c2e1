"""Intermediate tables: written once to the folder that driver and executors share, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder in use. Only where neither is set and Spark runs inside one JVM a
    temporary folder serves."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cohortlab-")
        context.setCheckpointDir(folder)
    return folder


class Cuts:
    """Written tables of one computation, by name; a name written again replaces the older table for later reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.made = spark, 0
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str = "part") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{name}{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def smallest_connected(nodes: DataFrame, links: DataFrame, cuts: Cuts) -> DataFrame:
    """node, label: the smallest node that links (a, b) lead to. Each round every label takes its smallest neighbour's and
    the label of that, links inside a label go, and the others are mapped to labels, so labels at least halve."""
    labels = cuts.cut(nodes.select("node", F.col("node").alias("label")), "labels")
    links = cuts.cut(links.select("a", "b").where("a <> b").distinct(), "links")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hook = cuts.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "hooks")
        top = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
        jump = cuts.cut(hook.join(top, "up", "left").select("a", F.coalesce("top", "up").alias("to")), "jumps")
        moved = labels.join(jump.select(F.col("a").alias("label"), "to"), "label", "left")
        labels = cuts.cut(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = links.join(jump.select("a", F.col("to").alias("x")), "a").join(jump.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = cuts.cut(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return labels
