"""Task graphs: run state machine, catch-up plans, dependency dimensions, lineage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILED, SUCCESS, SKIPPED = "FAILED", "SUCCESS", "UPSTREAM_FAILED"


def simulate(tasks: DataFrame, edges: DataFrame, fails: DataFrame, most: int | None = None) -> DataFrame:
    """Runs a DAG wave by wave: task, wave, status.

    A wave takes all tasks whose dependencies are done. ``fails`` names the tasks that fail; what depends on a failed or
    skipped task is skipped. Tasks on or behind a cycle are never ready: they come out as DEADLOCK with a null wave. Fails if
    more than ``most`` waves are needed.
    """
    from tessera.operators.graph import _kept

    left = _kept(tasks.select("task").distinct())
    done = _kept(tasks.sparkSession.createDataFrame([], tasks.select("task", F.lit(0).alias("wave"), F.lit("").alias("status")).schema))
    bad = fails.select("task", F.lit(True).alias("_fails"))
    for wave in count():
        deps = edges.select("task", "dep").join(left, "task", "left_semi")
        state = done.select(F.col("task").alias("dep"), F.col("status").alias("_s"))
        seen = deps.join(state, "dep", "left").groupBy("task").agg(F.bool_or(F.col("_s").isNull()).alias("_waits"), F.bool_or(F.coalesce(F.col("_s") != SUCCESS, F.lit(False))).alias("_spoilt"))
        ready = left.join(seen, "task", "left").join(bad, "task", "left").filter(~F.coalesce("_waits", F.lit(False)))
        status = F.when(F.coalesce("_spoilt", F.lit(False)), SKIPPED).when(F.coalesce("_fails", F.lit(False)), FAILED).otherwise(SUCCESS)
        now = _kept(ready.select("task", F.lit(wave).alias("wave"), status.alias("status")))
        if now.isEmpty():
            break
        if most is not None and wave >= most:
            raise ValueError(f"the tasks need more than {most} waves")
        done = _kept(done.unionByName(now))
        left = _kept(left.join(now, "task", "left_anti"))
        if left.isEmpty():
            break
    return done.unionByName(left.select("task", F.lit(None).cast("int").alias("wave"), F.lit("DEADLOCK").alias("status")))


def catch_up(runs: DataFrame, first: str, last: str) -> DataFrame:
    """What to do for each day of a range, from runs (day, status): day, action. After a RUNNING day nothing more is done."""
    days = runs.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    d = days.join(runs, "day", "left")
    stop = d.filter("status = 'RUNNING'").agg(F.min("day").alias("_stop"))
    action = F.when(F.col("day") >= F.col("_stop"), "STOP").when(F.col("status") == SUCCESS, "SKIP").when(F.col("status").isNull(), "RUN").otherwise("CLEAR_AND_RERUN")
    return d.crossJoin(F.broadcast(stop)).select("day", action.alias("action"))


def without_runs(df: DataFrame, cleared: DataFrame, key: str = "run_id") -> DataFrame:
    """The rows of runs that are not cleared."""
    return df.join(cleared.select(key).distinct(), key, "left_anti")


def task_dimension(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """task, dependency_count, is_root, is_leaf."""
    up = edges.groupBy("task").agg(F.count(F.lit(1)).alias("dependency_count"))
    down = edges.select(F.col("dep").alias("task"), F.lit(True).alias("_has")).distinct()
    n = F.coalesce("dependency_count", F.lit(0)).cast("long")
    return tasks.select("task").distinct().join(up, "task", "left").join(down, "task", "left").select("task", n.alias("dependency_count"), (n == 0).alias("is_root"), F.col("_has").isNull().alias("is_leaf"))


def lineage(procedures: DataFrame, name: str, body: str) -> DataFrame:
    """Tables that SQL texts read and write: name, mode, object, layer (highest of gold, silver, bronze named in it)."""
    write = F.regexp_extract_all(body, F.lit(r"(?i)(?:insert\s+into|update|merge\s+into|delete\s+from)\s+([a-z_][a-z_0-9.]*)"), F.lit(1))
    read = F.regexp_extract_all(F.regexp_replace(body, r"(?i)delete\s+from\s", "delete "), F.lit(r"(?i)(?:from|join)\s+([a-z_][a-z_0-9.]*)"), F.lit(1))
    both = F.concat(F.transform(read, lambda x: F.struct(F.lit("READ").alias("mode"), F.lower(x).alias("object"))), F.transform(write, lambda x: F.struct(F.lit("WRITE").alias("mode"), F.lower(x).alias("object"))))
    o = F.col("object")
    layer = F.when(o.contains("gold"), "gold").when(o.contains("silver"), "silver").when(o.contains("bronze"), "bronze")
    return procedures.select(name, F.inline(F.array_distinct(both))).withColumn("layer", layer)
