"""Request logs: routing, visit counters, snapshots. Batch and stream share the expressions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import urls as U
from ..session import shared_dir

NOT_CANONICAL = "Non-canonical short URL payload"


def route(raw_url: Column, agent: Column) -> Column:
    """struct(action, status, location, counted) of a request.

    Links that decode canonically go to their target, or to a preview page for preview fetchers; aliases and
    pages go to the app; what does not decode is an error with the decoder's text.
    """
    path = F.regexp_extract(raw_url, r"^[^:]+://[^/?#]*(/[^?#]*)?", 1)
    at = F.regexp_extract(path, r"(?s)/([01])/", 1)
    # Requests carry no fragment; a query belongs to the payload.
    tail = F.regexp_extract(raw_url, r"^[^:]+://[^/?#]*([^#]*)", 1)
    payload = U.payload_surface(tail)["payload"]
    link = L.resolve_link(F.when((at != "") & (payload != ""), tail))
    found = F.coalesce(link["canonical"], F.lit(False))
    action = F.when((at == "") | (payload == ""), "asset").when(found & U.is_preview_agent(agent), "embed").when(found, "redirect").when(link["url"].isNotNull(), "app").otherwise("error")
    status = F.when(action == "redirect", 302).when(action == "error", 400).otherwise(200)
    location = F.when(action.isin("redirect", "embed"), link["url"]).when(action == "error", link["error"])
    return F.struct(action.alias("action"), status.alias("status"), location.alias("location"), U.counts_as_visit(path).alias("counted"))


def path_status_rollup(requests: DataFrame) -> DataFrame:
    """path, n, statuses (map of status to count) from path, status, n."""
    by = requests.groupBy("path", "status").agg(F.sum("n").alias("n"))
    return by.groupBy("path").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def views_before(events: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """day (1 the earliest), views: visits that count, in the `days` windows of a day that end with `end`."""
    age = (F.unix_micros(end) - F.unix_micros("ts")) / 86_400_000_000
    inside = events.where(U.counts_as_visit(F.col("path")) & (age > 0) & (age <= days))
    return inside.groupBy((F.lit(days + 1) - F.ceil(age)).cast("long").alias("day")).agg(F.count("*").alias("views"))


def daily(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy("path", F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("views")).select("path", F.col("w.start").alias("day"), "views")


def snapshots(events: DataFrame, every: str = "6 hours", ts: str = "ts") -> DataFrame:
    """path, created_at, value: the running count at the end of every window that had a visit."""
    from pyspark.sql import Window

    w = events.groupBy("path", F.window(ts, every).alias("w")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy("path").orderBy("w.end"))
    return w.select("path", F.col("w.end").alias("created_at"), run.alias("value"))


def seeded(counts: DataFrame, seeds: DataFrame) -> DataFrame:
    """key, value: the larger of a counter and its one-time seed."""
    both = counts.join(seeds.withColumnRenamed("value", "seed"), "key", "full")
    return both.select("key", F.greatest(F.coalesce("value", F.lit(0)), F.coalesce("seed", F.lit(0))).alias("value"))


def latest(updates: DataFrame) -> DataFrame:
    """The upsert's outcome: each key's last value by time, larger value first on equal times."""
    last = F.max(F.struct("updated_at", "value")).alias("last")
    return updates.groupBy("key").agg(last).select("key", F.col("last.value").alias("value"), F.col("last.updated_at").alias("updated_at"))


def stream_daily(events: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of events (path, ts) to its present end, however long it takes; the table of its daily counts.

    Windows are kept by the watermark and written as the complete result of each batch, the last of which
    counts. A failed stream raises. State goes to `checkpoint`, else to a new folder in spark.checkpoint.dir.
    """
    spark = events.sparkSession
    checkpoint = checkpoint or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    counts = daily(events.withWatermark("ts", "1 day"))
    table = f"{checkpoint}/table"
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{table}/batch={i}")).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint).start().awaitTermination()
    return last_version(spark, table, counts.schema, "batch")


def last_version(spark: SparkSession, table: str, schema, name: str) -> DataFrame:
    """The rows of the highest numbered version of a table; empty where none has been written."""
    try:
        every = spark.read.parquet(table)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    newest = every.agg(F.max(name)).first()[0]
    return every.where(F.col(name) == newest).drop(name)


COUNTERS = "key string, value long, updated_at timestamp"


def read_counters(spark: SparkSession, table: str) -> DataFrame:
    """The counters as of the last version that was written whole."""
    return last_version(spark, table, spark.createDataFrame([], COUNTERS).schema, "version")


def counter_sink(counters: str, history: str):
    """A foreachBatch function for batches of key, value, updated_at: an upsert of the counters, and a snapshot.

    The present counters and the batch are merged, the batch winning, into a new version, which readers see
    when it is whole. Keys without news stay. A repeated batch writes its version and its snapshot again,
    so it adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(counters).where(F.col("version") < batch_id)
            newest = old.agg(F.max("version")).first()[0]
            old = old.where(F.col("version") == newest).drop("version")
        except AnalysisException:
            old = spark.createDataFrame([], COUNTERS)
        news = latest(batch.select("key", "value", "updated_at"))
        kept = old.join(news.select("key"), "key", "left_anti")
        kept.unionByName(news).write.mode("overwrite").parquet(f"{counters}/version={batch_id}")
        news.withColumnRenamed("updated_at", "created_at").write.mode("overwrite").parquet(f"{history}/batch={batch_id}")

    return write


def views_endpoint(spark: SparkSession, table: str | None, key: str = "views") -> DataFrame:
    """One row: the counter's value; null where no table is bound, 0 where the key has not been counted."""
    if table is None:
        return spark.range(1).select(F.lit(None).cast("long").alias("views"))
    return read_counters(spark, table).where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(0)).cast("long").alias("views"))
