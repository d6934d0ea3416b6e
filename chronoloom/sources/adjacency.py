"""Adjacency as a bucketed table: lookups and subgraphs leave the stored side where it is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.events import running_in
from chronoloom.scratch import shared_folder

#: Neighbours in a row at most: a hub is many rows, and no row is large.
BLOCK = 1024


class Adjacency:
    """Out-edges of an event set by node, in ``buckets`` buckets that are read as they are:
    a join by node deals out the asked nodes only, and a bucket is one task's range of
    nodes. The table belongs to the session's catalog and lies in ``path``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def write(cls, edges: DataFrame, buckets: int = 64, name: str | None = None, path: str | None = None) -> Adjacency:
        spark = edges.sparkSession
        name = name or f"adjacency_{uuid.uuid4().hex}"
        placed = running_in(edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "eid"), "node", ["nbr", "eid"], "i")
        rows = placed.groupBy("node", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("nbr", "eid"))).alias("near"), F.count("*").alias("n"))
        writer = rows.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node", "block").mode("overwrite")
        writer.option("path", path or f"{shared_folder(spark)}/{name}").saveAsTable(name)
        return cls(spark, name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def neighbours(self, nodes: DataFrame) -> DataFrame:
        """(node, nbr, eid) of the given nodes."""
        found = self.rows().join(nodes.select("node").distinct(), "node", "left_semi")
        return found.select("node", F.explode("near").alias("x")).select("node", "x.nbr", "x.eid")

    def degrees(self) -> DataFrame:
        """(node, degree): from the blocks' sizes, no list is read."""
        return self.rows().groupBy("node").agg(F.sum("n").alias("degree"))

    def subgraph(self, nodes: DataFrame) -> DataFrame:
        """(node, nbr, eid) with both ends among the nodes."""
        nodes = nodes.select("node").distinct()
        return self.neighbours(nodes).join(nodes.withColumnRenamed("node", "nbr"), "nbr", "left_semi").select("node", "nbr", "eid")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
