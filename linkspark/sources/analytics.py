"""Request analytics: day windows, nested groups as the service returns them, and the collected paths as JSON.

The service answers one window of at most a day with up to `limit` groups; answers are kept as JSON files, one
line a window: {"start", "end", "groups": [{"count", "dimensions": {host, path, status}}]}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

# The names of the service's fields.
GROUPS = "array<struct<count: bigint, dimensions: struct<clientRequestHTTPHost: string, clientRequestPath: string, edgeResponseStatus: int>>>"
WINDOW = f"start string, end string, groups {GROUPS}"
LIMIT = 10_000


def day_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """start, end of the windows of one day from start on; the last ends with `end`."""
    one = spark.range(1).select(F.to_timestamp(F.lit(start)).alias("a"), F.to_timestamp(F.lit(end)).alias("b"))
    steps = one.select("b", F.explode(F.sequence("a", F.greatest("a", F.col("b") - F.expr("interval 1 microsecond")), F.expr("interval 1 day"))).alias("start")).where("start < b")
    return steps.select("start", F.least(F.col("start") + F.expr("interval 1 day"), F.col("b")).alias("end"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WINDOW).json(path)


def parsed_windows(lines: DataFrame) -> DataFrame:
    """WINDOW columns from a column `value` of JSON lines; lines that are no JSON are dropped."""
    return lines.select(F.from_json("value", WINDOW).alias("w")).where("w.groups is not null").select("w.*")


def window_summary(windows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """start, end, groups, truncated: a window that gave `limit` groups may have had more."""
    n = F.size("groups")
    return windows.select("start", "end", n.cast("long").alias("groups"), (n >= limit).alias("truncated"))


def own_host(host: Column, own: str) -> Column:
    return F.coalesce(host == own, F.lit(False))


def request_counts(windows: DataFrame, own: str) -> DataFrame:
    """path, status, n of the groups of one's own host, one row a group."""
    g = windows.select(F.explode("groups").alias("g")).select("g.count", "g.dimensions.*")
    kept = g.where(own_host(F.col("clientRequestHTTPHost"), own))
    return kept.select(F.col("clientRequestPath").alias("path"), F.col("edgeResponseStatus").alias("status"), F.col("count").alias("n"))


def views(windows: DataFrame, own: str) -> DataFrame:
    """One row: the requests of one's own host whose path counts as a visit; 0 where there are none."""
    counted = request_counts(windows, own).where(U.counts_as_visit(F.col("path")))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("views"))


def visited_paths(rollup: DataFrame) -> DataFrame:
    """rank, path, count, statuses (JSON object, by status) of a path and status rollup, most requested first."""
    sorted_statuses = F.array_sort(F.map_entries("statuses"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(sorted_statuses, lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))
    return rollup.select("path", F.col("n").alias("count"), text.alias("statuses"))


def write_visited_paths(rollup: DataFrame, windows: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Two JSON tables below path: `paths`, in order of count, and `windows`; totals are a sum over the first."""
    visited_paths(rollup).orderBy(F.desc("count"), "path").write.mode("overwrite").json(f"{path}/paths")
    window_summary(windows, limit).orderBy("start").write.mode("overwrite").json(f"{path}/windows")
