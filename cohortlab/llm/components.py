"""Connected components of a graph of links, by hooking to the smallest neighbour and contracting, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch


class Components:
    """Labels of the nodes that links have named so far; a node without a label is its own component.

    ``add`` takes more links (a, b). Each round maps the links to labels, lets every label take its smallest
    neighbour's, follows that one step further, and drops links inside a component, until none is left: the number of
    labels at least halves, so rounds grow with the logarithm of the largest component. A label is always the
    smallest node that is known to be connected, in the end the smallest of the component.
    """

    def __init__(self, scratch: Scratch, node_type: str = "long"):
        self.scratch = scratch
        self.labels: DataFrame = scratch.spark.createDataFrame([], f"node {node_type}, label {node_type}")
        self.made: list[str] = []
        self.step = 0

    def of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """The frame with the label of a column's node."""
        known = self.labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        joined = df.join(known, df[column] == known["_n"], "left")
        return joined.withColumn(name, F.coalesce("_l", column)).drop("_n", "_l")

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        name = f"{name}{self.step}"
        self.made.append(name)
        return self.scratch.cut(df, name)

    def add(self, links: DataFrame) -> None:
        ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
        fresh = ends.join(self.labels, "node", "left_anti").select("node", F.col("node").alias("label"))
        old, self.made = self.made, []
        self.labels = self._cut(self.labels.unionByName(fresh), "labels")
        self.scratch.drop(*old)
        links = self.of(self.of(links.select("a", "b"), "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = self._cut(links.where("a <> b").distinct(), "links")
        while not links.isEmpty():
            both = links.union(links.select("b", "a"))
            hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
            hook = self._cut(hook, "hooks")
            above = hook.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
            jump = hook.join(above, hook["up"] == above["_a"], "left").select("a", F.coalesce("_up", "up").alias("up"))
            jump = self._cut(jump, "jumps")
            moved = self.labels.join(jump, self.labels["label"] == jump["a"], "left")
            self.labels = self._cut(moved.select("node", F.coalesce("up", "label").alias("label")), "labels")
            left = jump.select(F.col("a").alias("_a"), F.col("up").alias("x"))
            right = jump.select(F.col("a").alias("_b"), F.col("up").alias("y"))
            links = links.join(left, links["a"] == left["_a"]).join(right, F.col("b") == right["_b"])
            links = self._cut(links.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "links")
