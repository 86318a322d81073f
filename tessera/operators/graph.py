"""Graphs given as edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which the edges that are left are written anew, so that each round reads few that are done.
RESTAGE = 8


def _path(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share; a folder of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/graph-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts the lineage of a loop by a table in the shared folder."""
    path = path or _path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """Breadth first from ``roots`` (node): node, degree (hops). Each round only joins the nodes found last, and writes
    only the new ones; cycles end by themselves. Fails if nodes are more than ``most`` hops away."""
    spark, path = edges.sparkSession, _path(edges.sparkSession)
    front = _kept(roots.select("node").distinct().withColumn("degree", F.lit(0)), f"{path}/hop=0")
    kind = front.schema
    step = _kept(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).distinct())
    for hop in count(1):
        seen = spark.read.schema(kind).parquet(f"{path}/hop=*")
        new = front.join(step, "node").select(F.col("to").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = _kept(new.withColumn("degree", F.lit(hop)), f"{path}/hop={hop}")
        if front.isEmpty():
            return seen
        if most is not None and hop > most:
            raise ValueError(f"nodes are more than {most} hops away")
    raise AssertionError


def peeled(edges: DataFrame, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Strips nodes without incoming edges, wave by wave: (node, level) of all that go, and the edges that stay.

    A node's level is its longest path from a root. Edges stay if and only if the graph has a cycle, on it or behind it.
    A wave joins only the nodes that went last and writes only those that go; edges that are done leave every
    ``RESTAGE`` waves.
    """
    spark, path = edges.sparkSession, _path(edges.sparkSession)
    base = left = _kept(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    heads = left.select(F.col("dst").alias("node")).distinct()
    now = left.select(F.col("src").alias("node")).distinct().join(heads, "node", "left_anti")
    now = _kept(now.withColumn("level", F.lit(0)), f"{path}/level=0")
    kind, first = now.schema, 0
    for level in count(1):
        gone = spark.read.schema(kind).parquet(*(f"{path}/level={k}" for k in range(first, level)))
        stay = left.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
        if level % RESTAGE == 0:
            left, first = _kept(stay.select("src", "dst")), level
            stay = left
        after = base.select(F.col("src").alias("node"), F.col("dst").alias("to")).join(now, "node").select(F.col("to").alias("node")).distinct()
        now = after.join(stay.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        now = _kept(now.withColumn("level", F.lit(level)), f"{path}/level={level}")
        if now.isEmpty():
            return spark.read.schema(kind).parquet(f"{path}/level=*"), stay.select("src", "dst")
    raise AssertionError


def levels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Topological levels of a DAG: node, level (longest path from a root). Fails on a cycle."""
    found, left = peeled(edges, src, dst)
    if not left.isEmpty():
        raise ValueError("the graph has a cycle")
    return found


def has_cycle(edges: DataFrame, src: str = "src", dst: str = "dst") -> bool:
    """Whether stripping nodes without incoming edges leaves any edge."""
    return not peeled(edges, src, dst)[1].isEmpty()


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All pairs of a DAG that a path joins: root, node, depth (longest path). Paths of a length that end alike are one,
    so a round's pairs are no more than all pairs. Fails on a cycle."""
    spark, path = edges.sparkSession, _path(edges.sparkSession)
    e = _kept(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).distinct())
    n = e.select("node").union(e.select("to")).distinct().count()
    front = _kept(e.select(F.col("node").alias("root"), F.col("to").alias("node"), F.lit(1).alias("depth")), f"{path}/depth=1")
    kind = front.schema
    for depth in count(2):
        if depth > n + 1:
            raise ValueError("the graph has a cycle")
        new = front.join(e, "node").select("root", F.col("to").alias("node")).distinct()
        front = _kept(new.withColumn("depth", F.lit(depth)), f"{path}/depth={depth}")
        if front.isEmpty():
            return spark.read.schema(kind).parquet(f"{path}/depth=*").groupBy("root", "node").agg(F.max("depth").alias("depth"))
    raise AssertionError


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected connected components: node, component (least node), by minimum labels with shortcuts."""
    both = _kept(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(dst, src)).distinct())
    label = _kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("n"))
        new = label.join(near, "node").select("node", F.least("c", "n").alias("c"))
        jump = new.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = _kept(new.join(jump, "c").select("node", F.least("c", "cc").alias("c")))
        if new.join(label.withColumnRenamed("c", "old"), "node").filter("c <> old").isEmpty():
            return new.withColumnRenamed("c", "component")
        label = new


def shortest_paths(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Least sums of non-negative weights from ``roots`` (node): node, cost. Each round relaxes the edges of the nodes whose cost fell."""
    step = _kept(edges.select(F.col(src).alias("node"), F.col(dst).alias("to"), F.col(weight).cast("double").alias("w")))
    cost = front = _kept(roots.select("node").distinct().withColumn("cost", F.lit(0.0)))
    while True:
        found = front.join(step, "node").groupBy(F.col("to").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("found"))
        front = _kept(found.join(cost, "node", "left").filter("cost IS NULL OR found < cost").select("node", F.col("found").alias("cost")))
        if front.isEmpty():
            return cost
        cost = _kept(cost.join(front.select("node"), "node", "left_anti").unionByName(front))


def semver_suggestion(diff: DataFrame, change: str = "change") -> DataFrame:
    """The version bump that a diff of specs asks for: MAJOR if something went, MINOR if something came, else PATCH."""
    return diff.agg(F.when(F.count_if(F.col(change) == "REMOVED") > 0, "MAJOR").when(F.count_if(F.col(change) == "ADDED") > 0, "MINOR").otherwise("PATCH").alias("bump"))


def longest_paths(edges: DataFrame, weights: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The heaviest path that ends in each node of a DAG, by the nodes' weights (node, weight): node, cost, before (the node ahead on it). Level by level."""
    spark = edges.sparkSession
    e = _kept(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    nodes = _kept(levels(e).join(weights.select("node", F.col("weight").cast("double").alias("w")), "node"))
    path = _path(spark)
    done = _kept(nodes.filter("level = 0").select("node", F.col("w").alias("cost"), F.lit(None).cast("long").alias("before")), f"{path}/level=0")
    kind = done.schema
    for level in range(1, (nodes.agg(F.max("level")).first()[0] or 0) + 1):
        now = nodes.filter(F.col("level") == level).join(e.withColumnRenamed("dst", "node"), "node")
        best = now.join(done.select(F.col("node").alias("src"), "cost"), "src").groupBy("node").agg(F.max(F.struct("cost", F.col("src").alias("before"))).alias("b"), F.first("w").alias("w"))
        _kept(best.select("node", (F.col("b.cost") + F.col("w")).alias("cost"), F.col("b.before").alias("before")), f"{path}/level={level}")
        done = spark.read.schema(kind).parquet(f"{path}/level=*")
    return done
