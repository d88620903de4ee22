"""Link corpora as DataFrames of one `url` column.

Text inputs are read by Spark's own splittable reader; compressed files take one task each. Bad lines are
dropped, as bulk analysis wants; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import domain_index_url

FORMATS = ("externallinks", "cdxj", "plain")
#: One tuple of a dump line: two integers, two quoted strings with backslash escapes.
TUPLE = r"\(([0-9]*),([0-9]*),'((?:\\.|[^'\\])*)','((?:\\.|[^'\\])*)'"
#: The same where both integers and the closing bracket must be there.
STRICT_TUPLE = r"\(([0-9]+),([0-9]+),'((?:\\.|[^'\\])*)','((?:\\.|[^'\\])*)'\)"
_ESCAPES = (("0", "\x00"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("Z", "\x1a"))


def _replaced(parts: Column, old: str, new: str) -> Column:
    return F.transform(parts, lambda p: F.replace(p, F.lit(old), F.lit(new)))


def unescape_sql(text: Column) -> Column:
    """MySQL string escapes; any other escaped character stands for itself."""
    parts = F.split(text, r"\\\\")  # on escaped backslashes
    for code, char in _ESCAPES:
        parts = _replaced(parts, "\\" + code, char)
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1"))
    return F.array_join(parts, "\\")


def externallinks_rows(lines: DataFrame, strict: bool = False) -> DataFrame:
    """domain_index, path of every tuple of INSERT lines; strict skips tuples without integers or closing bracket."""
    form = F.lit(STRICT_TUPLE if strict else TUPLE)
    hits = lines.where(F.col("value").startswith("INSERT INTO"))
    at = F.posexplode(F.regexp_extract_all("value", form, 3)).alias("i", "d")
    paths = F.regexp_extract_all("value", form, 4)
    rows = hits.select(paths.alias("paths"), at).select("d", F.element_at("paths", F.col("i") + 1).alias("p"))
    return rows.select(unescape_sql(F.col("d")).alias("domain_index"), unescape_sql(F.col("p")).alias("path"))


def externallinks_urls(lines: DataFrame, strict: bool = False) -> DataFrame:
    rows = externallinks_rows(lines, strict)
    return rows.select(domain_index_url(F.col("domain_index"), F.col("path")).alias("url")).where("url is not null")


def cdxj_urls(lines: DataFrame) -> DataFrame:
    """The url field of the JSON that follows two blank-separated fields."""
    data = F.split("value", " ", 3)
    return lines.select(F.get_json_object(F.try_element_at(data, F.lit(3)), "$.url").alias("url")).where("url is not null")


def plain_urls(lines: DataFrame) -> DataFrame:
    return lines.select(F.regexp_replace("value", r"^\s+|\s+\z", "").alias("url")).where("url <> ''")


def read_corpus(spark: SparkSession, path: str, form: str = "externallinks") -> DataFrame:
    """url column of a corpus in one of FORMATS. cdxj directories: files cdx-* that end in .gz or have no dot."""
    if form == "externallinks":
        return externallinks_urls(spark.read.text(path))
    if form == "plain":
        return plain_urls(spark.read.text(path))
    if form == "cdxj":
        lines = spark.read.option("pathGlobFilter", "cdx-*").text(path)
        name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
        return cdxj_urls(lines.where(name.endswith(".gz") | ~F.contains(name, F.lit("."))).select("value"))
    raise ValueError(f"unknown corpus format {form!r}; known are {', '.join(FORMATS)}")


def numbered(rows: DataFrame, name: str = "row_no") -> DataFrame:
    """rows with a gapless number from 1, in the order of partitions and of rows in them.

    Two passes: the rows of each partition are counted (one number a partition reaches the driver's plan),
    then each row adds its place to the sum of the partitions before. The input must be read alike both times,
    as files are; a shuffled frame should be written first.
    """
    at = rows.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() % (1 << 33))
    counts = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def binary_visit_order(n: int) -> list[int]:
    """Chunk numbers with the middle first, then the middles of both halves, and so on in depth."""
    order, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            order.append(mid)
            todo += [(mid + 1, hi), (lo, mid)]
    return order


def hrefs(pages: DataFrame) -> DataFrame:
    """Absolute links of the pages' relative hrefs: a second corpus."""
    base = F.regexp_extract("url", r"^[^:]+://[^/?#]*", 0)
    return pages.select(base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("path")).select(F.concat("base", "path").alias("url"))
