"""Statistics of a link corpus, samples and splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import urls as U
from .candidates import LONGEST, path_segments, query_keys

BUCKETS = 4096


def tally(keys: DataFrame, key: str = "key") -> DataFrame:
    return keys.groupBy(key).agg(F.count("*").alias("n"))


def _kept(df: DataFrame) -> DataFrame:
    return df.where((F.col("key") != "") & (F.octet_length("key") <= LONGEST))


def scheme_counts(urls: DataFrame) -> DataFrame:
    return tally(_kept(urls.select(U.url_parts(F.col("url"))["scheme"].alias("key"))))


def tld_counts(urls: DataFrame) -> DataFrame:
    return tally(_kept(urls.select(F.try_element_at(U.host_labels(U.url_parts(F.col("url"))["host"]), F.lit(-1)).alias("key")).where("key is not null")))


def host_counts(urls: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_replace(F.regexp_replace(U.url_parts(F.col("url"))["host"], r"(?s)^.*@", ""), r":[0-9]*\z", ""))
    return tally(urls.select(host.alias("key")).where("key <> ''"))


def segment_counts(urls: DataFrame) -> DataFrame:
    return tally(urls.select(F.explode(path_segments(U.url_parts(F.col("url"))["path"])).alias("key")))


def key_counts(urls: DataFrame) -> DataFrame:
    return tally(urls.select(F.explode(query_keys(U.url_parts(F.col("url"))["query"])).alias("key")))


def char_counts(urls: DataFrame) -> DataFrame:
    chars = urls.select(F.explode(F.split(U.compression_body(F.col("url")), "")).alias("key"))
    return tally(chars.where("key <> ''"))


def length_histogram(urls: DataFrame) -> DataFrame:
    """length in bytes, the last bucket holding all longer ones; n."""
    size = F.least(F.octet_length(U.compression_body(F.col("url"))), F.lit(BUCKETS - 1)).cast("long")
    return urls.select(size.alias("length")).groupBy("length").agg(F.count("*").alias("n"))


def percentiles(histogram: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """p, length: the smallest length whose running count reaches floor(total * p); 0 if that is 0.

    The histogram has 4096 rows at most, so its running count is taken in one task.
    """
    run = histogram.withColumn("run", F.sum("n").over(Window.orderBy("length"))).crossJoin(F.broadcast(histogram.agg(F.sum("n").alias("total"))))
    parts = [run.agg(F.lit(p).alias("p"), F.min(F.when(F.col("run") >= F.floor(F.col("total") * p), F.col("length"))).alias("length"), F.max(F.floor(F.col("total") * p)).alias("target")) for p in shares]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("p", F.when(F.coalesce("target", F.lit(0)) == 0, 0).otherwise(F.col("length")).cast("long").alias("length"))


def sorted_percentiles(urls: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """p, length: the element at min(n-1, floor(n*p)) of the sorted lengths in code points.

    Lengths are counted first; the counts, not the links, are put in order.
    """
    h = urls.select(F.length(U.compression_body(F.col("url"))).cast("long").alias("length")).groupBy("length").agg(F.count("*").alias("n"))
    run = h.withColumn("run", F.sum("n").over(Window.orderBy("length"))).crossJoin(F.broadcast(h.agg(F.sum("n").alias("total"))))
    parts = [run.agg(F.lit(p).alias("p"), F.min(F.when(F.col("run") > F.least(F.col("total") - 1, F.floor(F.col("total") * p)), F.col("length"))).alias("length")) for p in shares]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def systematic(row: Column, every: int, limit: int = 0) -> Column:
    """Whether a 1-based row is sampled."""
    keep = F.lit(True) if every == 0 else row % every == 0
    return keep & (F.floor(row / max(every, 1)) <= limit) if limit else keep


def with_heldout(urls: DataFrame, row_col: str = "row_no", every: int = 1, heldout_every: int = 10) -> DataFrame:
    """Sampled rows with their ordinal and whether they are held out. Rows must be numbered from 1 without
    gaps, so that the ordinal is the row number over `every` and needs no global sort."""
    n = max(every, 1)
    kept = urls.where(systematic(F.col(row_col), every)).withColumn("ordinal", F.floor(F.col(row_col) / n))
    return kept.withColumn("heldout", (F.col("ordinal") % heldout_every == 0) if heldout_every else F.lit(False))


@F.arrow_udf(DecimalType(20, 0))
def heldout_key(row: pa.Array) -> pa.Array:
    """A 64-bit hash of the row number: additive step and two multiply-xor rounds, unsigned."""
    x = row.to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return pa.array(x ^ (x >> np.uint64(31))).cast(pa.decimal128(20, 0))


def bottom_k(rows: DataFrame, k: int, row_col: str = "row_no") -> DataFrame:
    return rows.withColumn("hash_key", heldout_key(F.col(row_col))).orderBy("hash_key").limit(k)


def even_positions(spark, n: int, count: int) -> DataFrame:
    """Evenly spaced indexes of n shards, halves rounded to even; all of them when count >= n."""
    if count >= n:
        return spark.range(n).select(F.col("id").alias("position"))
    if count == 1:
        raise ZeroDivisionError("one shard has no even spacing")
    return spark.range(count).select(F.bround(F.col("id") * (n - 1) / (count - 1), 0).cast("long").alias("position")).distinct()
