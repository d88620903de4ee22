"""The corpus report, from links to markdown: whole, or partial while links still arrive.

All statistics are one long table (stat, key, n) that adds up: a part of the corpus gives a table, and the
tables of parts are summed. What reaches the driver are the top rows of each section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import candidates as K
from ..operators import corpus_stats as S
from ..operators import selection as X
from .training import render_report

STATS = "stat string, key string, n bigint"
#: Section title, statistic, rows (None: the report's own number).
SECTIONS = (("Schemes", "scheme", 20), ("Top TLDs", "tld", 50), ("Top path segments", "segment", None), ("Top query keys", "query_key", None))


def corpus_stats(numbered: DataFrame, every: int = 1, heldout_every: int = 10) -> DataFrame:
    """stat, key, n of links numbered from 1 (url, row_no). Segments, keys and candidates are of training links
    only, all else of every sampled link."""
    sampled = S.with_heldout(numbered, every=every, heldout_every=heldout_every)
    training = sampled.where("not heldout")
    parts = {
        "scheme": S.scheme_counts(sampled),
        "tld": S.tld_counts(sampled),
        "char": S.char_counts(sampled),
        "length": S.length_histogram(sampled).select(F.col("length").cast("string").alias("key"), "n"),
        "segment": S.segment_counts(training),
        "query_key": S.key_counts(training),
        "candidate": K.count_candidates(training).withColumnRenamed("candidate", "key"),
        "rows": sampled.groupBy(F.when(F.col("heldout"), "heldout").otherwise("training").alias("key")).agg(F.count("*").alias("n")),
        "seen": numbered.groupBy(F.lit("seen").alias("key")).agg(F.count("*").alias("n")),
    }
    out = None
    for stat, frame in parts.items():
        rows = frame.select(F.lit(stat).alias("stat"), F.col("key"), F.col("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merged(tables: DataFrame) -> DataFrame:
    return tables.groupBy("stat", "key").agg(F.sum("n").alias("n"))


def section(stats: DataFrame, stat: str, k: int) -> DataFrame:
    """The k most frequent keys of a statistic."""
    return K.top_entries(stats.where(F.col("stat") == stat).select("key", "n"), k, "key")


def characters(stats: DataFrame, k: int) -> DataFrame:
    rows = stats.where((F.col("stat") == "char") & (F.octet_length("key") == 1) & (F.col("key") != "`"))
    return rows.select("key", "n").orderBy(F.desc("n"), "key").limit(k)


def report(stats: DataFrame, heldout: DataFrame | None, top: int = 100, pool: int = 512, bodies: int = 20_000, budget: int = 128) -> str:
    """Markdown of merged statistics. With heldout (url, row_no) the dictionary is selected on the `bodies` links of
    smallest hash key; without, the report is a partial one."""
    rows = {r["key"]: r["n"] for r in stats.where("stat in ('rows', 'seen')").select("key", "n").collect()}
    lengths = S.percentiles(stats.where("stat = 'length'").select(F.col("key").cast("long").alias("length"), "n"))
    at = {r["p"]: r["length"] for r in lengths.collect()}
    summary = {"Rows seen": rows.get("seen", 0), "Rows sampled": rows.get("training", 0) + rows.get("heldout", 0), "Training held-out URLs": min(rows.get("heldout", 0), bodies), "Body length p50/p90/p99": " / ".join(str(at.get(p) or 0) for p in (0.5, 0.9, 0.99))}
    tables: dict[str, tuple[list[str], list[tuple]]] = {}
    for title, stat, k in SECTIONS:
        tables[title] = ["value", "count"], [tuple(r) for r in section(stats, stat, k or top).collect()]
    counts = stats.where("stat = 'candidate'").select(F.col("key").alias("candidate"), "n")
    scored = K.scored(counts)
    if heldout is not None:
        chosen = X.select_dictionary(K.best(scored, pool), S.bottom_k(heldout, bodies), budget).orderBy("kind", "rank").collect()
        tables["Selected dictionary entries"] = ["candidate", "train count", "saved bits/use", "held-out gain bits", "dictionary cost bits", "net score"], [(r["candidate"], r["n"], r["saved_bits"], f"{r['gain']:.1f}", r["cost_bits"], f"{r['net_score']:.1f}") for r in chosen if r["kind"] == "selected"]
        tables["Rejected by overlap shadowing"] = ["candidate", "train count", "initial net score", "final net score"], [(r["candidate"], r["n"], f"{r['gain']:.1f}", f"{r['net_score']:.1f}") for r in chosen if r["kind"] == "shadowed"]
    tables["Top candidate dictionary entries"] = ["candidate", "count", "saved bits/use", "total score"], [tuple(r) for r in K.best(scored, top).collect()]
    rejected = K.judged(counts).where("reason is not null").select("candidate", "n", "reason")
    tables["Rejected overfit candidates"] = ["candidate", "count", "reason"], [tuple(r) for r in K.top_entries(rejected, top).collect()]
    tables["Top body characters"] = ["char", "count"], [tuple(r) for r in characters(stats, top).collect()]
    return render_report(summary, tables)


def corpus_report(numbered: DataFrame, every: int = 1, heldout_every: int = 10, top: int = 100, **selection) -> str:
    """The whole report of links numbered from 1 (url, row_no)."""
    held = S.with_heldout(numbered, every=every, heldout_every=heldout_every).where("heldout")
    return report(corpus_stats(numbered, every, heldout_every), held, top, **selection)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file below path, through Spark's writer, so that path may be in any store; written again in full."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def partial_sink(tables: str, path: str, top: int = 100, **sampling):
    """A foreachBatch function for batches of numbered links: adds the batch's statistics below `tables`, and
    writes the partial report of all batches so far to <path>.partial. A repeated batch replaces its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        corpus_stats(batch, **sampling).write.mode("overwrite").parquet(f"{tables}/batch={batch_id}")
        every = merged(spark.read.schema(STATS).parquet(tables))
        write_text(spark, f"{path}.partial", report(every, None, top))

    return write


def stream_report(links: DataFrame, checkpoint: str, path: str, top: int = 100, seconds: int | None = None, **sampling) -> None:
    """Partial reports of a stream of numbered links (url, row_no): after every micro-batch, each `seconds`, or as
    fast as batches come until the present end of the stream."""
    writer = links.writeStream.foreachBatch(partial_sink(f"{checkpoint}/tables", path, top, **sampling)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{max(1, seconds)} seconds") if seconds is not None else writer.trigger(availableNow=True)
    query = writer.start()
    if seconds is None:
        query.awaitTermination()


def coverage(urls: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tier, id, value, links, occurrences: what each entry of a model's dictionary (192 rows at most) covers."""
    body = urls.select(U.compression_body(F.col("url")).alias("body"))
    hit = body.join(F.broadcast(dictionary), F.contains("body", "value"))
    times = F.expr("(length(body) - length(replace(body, value, ''))) div length(value)")
    found = hit.groupBy("tier", "id", "value").agg(F.count("*").alias("links"), F.sum(times).alias("occurrences"))
    full = dictionary.join(found.drop("value"), ["tier", "id"], "left")
    return full.select("tier", "id", "value", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"))
