"""URL filters as a sort-merge range join, with DataFrame functions only.

A host's labels are reversed into a canonical key (a.example.org -> org, example, a, each closed by a
separator), so a rule's host and all its subdomains are one interval of keys, and intervals of rules nest
or are disjoint. The begins and ends of all rule intervals are events; between two events the stack of
active nested rules is constant. The stack of an event is found from the rules alone, by an equi-join on
host suffixes. Events and url keys are then sorted together and swept: a running last value carries
the active stack to each url, whose longest rule with a fitting path decides.

The sweep runs in `lanes` that urls are dealt to evenly by a hash of the url key and row id, each with a copy of the
events, so a host with a third of all rows is no hot group. Events number two a rule host; their copies
(events x lanes) are the cost of that.

The longest rule is the one whose host + path has the most characters; equal lengths cannot both fit
one url with different text; the same rule given twice counts once, and if it is both allowed and blocked it
blocks. Null urls and urls without :// have empty host and path and meet no rule; unmatched urls get the default verdict.
An empty page or rule table works; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules of the query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    # What follows the first :// is cut off before matching, so no later :// can be taken for it.
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by U+0001, so that a host's subdomains follow it at once."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001"))


def events(rules: DataFrame) -> DataFrame:
    """key, kind (0 end, 1 begin), stack: the rules active from this key on."""
    rules = rules.select("host", "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.select("host", F.explode(suffixes).alias("above"))
    item = F.struct(F.length(F.concat("r.host", "r.path")).alias("size"), F.col("r.host").alias("host"), F.col("r.path").alias("path"), F.col("r.verdict").alias("verdict"))
    active = up.alias("u").join(rules.alias("r"), F.col("u.above") == F.col("r.host")).groupBy("u.host").agg(F.collect_list(item).alias("stack"))
    key = host_key(F.col("host"))
    begin = active.select(key.alias("key"), F.lit(1).alias("kind"), "stack")
    # After a host's interval the stack is that of its rules without the host's own.
    outer = F.filter("stack", lambda x: x["host"] != F.col("host"))
    end = active.select(F.concat(F.substring(key, 1, F.length(key) - 1), F.lit("\u0002")).alias("key"), F.lit(0).alias("kind"), outer.alias("stack"))
    return begin.unionByName(end)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", lanes: int | None = None) -> DataFrame:
    """id, host, path, rule, verdict of every row."""
    spark = pages.sparkSession
    lanes = lanes or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stack_type = events(rules).schema["stack"].dataType
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.select(F.pmod(F.xxhash64("id", "host", "path"), F.lit(lanes)).alias("lane"), host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), F.lit(None).cast(stack_type).alias("stack"), "id", "host", "path")
    blank = [F.lit(None).cast(urls.schema[c].dataType).alias(c) for c in ("id", "host", "path")]
    marks = events(rules).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), "key", "kind", "stack", *blank)
    sweep = Window.partitionBy("lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = urls.unionByName(marks).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    # Labels may hold the separators, so the host itself is compared once more.
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]) & ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))))
    best = F.array_max(fits)
    return swept.select(F.col("id").alias(id_col), "host", "path", F.concat(best["host"], best["path"]).alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = f"""
WITH r(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
cut AS (
  SELECT page_id, split_part(split_part(coalesce(x, ''), '?', 1), '#', 1) AS x FROM rest),
u AS (
  SELECT page_id, translate(split_part(x, '/', 1), '{UPPER}', '{LOWER}') AS host,
    substr(x, length(split_part(x, '/', 1)) + 1) AS path
  FROM cut),
m AS (
  SELECT u.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m USING (page_id)
"""
