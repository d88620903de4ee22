"""From candidates to a dictionary: merge, budgets, model artifact and report."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.candidates import first_by_rank, is_usable_entry

# Entries that are always wanted, in order.
CURATED = (
    "github.", "gitlab.", "bitbucket.", "/tree/", "/blob/", "/issues/", "/pull/", "/commit/", "/releases/", "/src/",
    "/docs/", "x.com/", "twitter.com/", "/status/", "/statuses/",
)
INSERT_AT = 16
POOL = 512
MOST_SYMBOLS, SPECIAL, MOST_EXTENDED, MOST_LITERALS = 64, 5, 128, 48


def ranked(pool: DataFrame) -> DataFrame:
    """candidate, rank from 1, of the POOL best; that bound is why they may pass through the driver."""
    rows = pool.orderBy(F.desc("total_score"), "candidate").limit(POOL).select("candidate").collect()
    return pool.sparkSession.createDataFrame([(r[0], i + 1) for i, r in enumerate(rows)], "candidate string, rank long")


def merge_curated(pool: DataFrame) -> DataFrame:
    """candidate, rank: the curated entries that are missing follow the first 16."""
    spark, top = pool.sparkSession, ranked(pool)
    curated = spark.createDataFrame(list(enumerate(CURATED)), "k long, candidate string")
    extra = curated.join(top, "candidate", "left_anti").select("candidate", F.row_number().over(Window.orderBy("k")).alias("j"))
    n = extra.agg(F.count("*").alias("x")).crossJoin(top.agg(F.count("*").alias("total")))
    moved = top.crossJoin(F.broadcast(n)).select("candidate", F.when(F.col("rank") <= INSERT_AT, F.col("rank")).otherwise(F.col("rank") + F.col("x")).alias("rank"))
    added = extra.crossJoin(F.broadcast(n)).select("candidate", (F.least(F.lit(INSERT_AT), F.col("total")) + F.col("j")).alias("rank"))
    return moved.unionByName(added)


def partition_budget(ranks: DataFrame, literals: int) -> DataFrame:
    """candidate, tier, id: what symbols remain beside the literals are primary, the next 128 extended."""
    primary = MOST_SYMBOLS - SPECIAL - min(literals, MOST_SYMBOLS - SPECIAL)
    r = F.col("rank")
    kept = ranks.where(r <= primary + MOST_EXTENDED)
    return kept.select("candidate", F.when(r <= primary, "primary").otherwise("extended").alias("tier"), F.when(r <= primary, r - 1).otherwise(r - primary - 1).alias("id"))


def literal_characters(chars: DataFrame, most: int = MOST_LITERALS) -> DataFrame:
    """value, id: the most frequent ASCII characters but the backtick, from counts (key, n)."""
    fit = chars.where((F.col("key") != "`") & (F.octet_length("key") == 1))
    best = fit.orderBy(F.desc("n"), "key").limit(min(most, MOST_SYMBOLS - SPECIAL))  # 59 rows at most
    return best.select(F.col("key").alias("value"), (F.row_number().over(Window.orderBy(F.desc("n"), "key")) - 1).cast("long").alias("id"))


def build_model(chars: DataFrame, entries: DataFrame, most_literals: int = MOST_LITERALS) -> DataFrame:
    """tier, id, value of a whole model: literals from character counts, then primary and extended entries.

    entries (candidate, n, total_score) are the selected dictionary, or the best candidates; those that the generator
    refuses are dropped, each is taken once, and the curated ones are merged in. Literals and entries are
    bounded by the symbols there are.
    """
    literals = literal_characters(chars, most_literals)
    usable = first_by_rank(entries.where(is_usable_entry(F.col("candidate"))).withColumn("rank", -F.col("total_score")))
    ranks = merge_curated(usable.select("candidate", (-F.col("rank")).alias("total_score")))
    dictionary = partition_budget(ranks, literals.count())
    return literals.select(F.lit("literal").alias("tier"), "id", "value").unionByName(dictionary.select("tier", "id", F.col("candidate").alias("value")))


def write_model(dictionary: DataFrame, path: str) -> None:
    dictionary.coalesce(1).write.mode("overwrite").json(path)  # 139 rows at most


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("candidate string, tier string, id long").json(path)


def write_tables(model: DataFrame, path: str) -> None:
    """A model of build_model() as JSON, one row a symbol: 64 + 128 at most."""
    model.coalesce(1).write.mode("overwrite").json(path)


def read_tables(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """tier -> values in order of id: what an encoder takes for its tables."""
    out: dict[str, list] = {"literal": [], "primary": [], "extended": []}
    for r in spark.read.schema("tier string, id long, value string").json(path).orderBy("tier", "id").collect():
        out[r["tier"]].append(r["value"])
    return {k: tuple(v) for k, v in out.items()}


def escaped(char: str) -> str:
    """A character as the report writes it: quotes, backslash and line ends escaped, others outside printable
    ASCII by code point."""
    short = {"\t": "\\t", "\r": "\\r", "\n": "\\n", "'": "\\'", '"': '\\"', "\\": "\\\\"}
    return "".join(short.get(c) or (c if " " <= c <= "~" else f"\\u{{{ord(c):x}}}") for c in char)


def render_report(summary: dict[str, int], tables: dict[str, tuple[list[str], list[tuple]]]) -> str:
    """Markdown with counters first and one pipe table a section; values in backticks."""
    lines = ["# Corpus analysis", ""] + [f"- {k}: {v}" for k, v in summary.items()]
    for title, (names, rows) in tables.items():
        lines += ["", f"## {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
        for row in rows:
            first = escaped(str(row[0])) if names[0] == "char" else str(row[0])
            first = first.replace("`", "\\`")
            lines.append("| " + " | ".join([f"`{first}`", *map(str, row[1:])]) + " |")
    return "\n".join(lines) + "\n"


def read_section(markdown: str, title: str) -> list[tuple[str, ...]]:
    """Rows of one section of a report; the first cell unescaped."""
    start = markdown.index(f"## {title}") + len(title) + 3
    end = markdown.find("\n## ", start)
    out = []
    for line in (markdown[start:] if end < 0 else markdown[start:end]).split("\n"):
        m = re.match(r"\| `(.+)` \| (.+) \|$", line)
        if m:
            cell = m[1].replace("\\`", "`")
            try:
                value = ast.literal_eval("'" + cell + "'")
            except (SyntaxError, ValueError):
                value = cell
            out.append((value, *m[2].split(" | ")))
    return out


def report_frame(spark: SparkSession, markdown: str, title: str, columns: str) -> DataFrame:
    """A section as a typed frame; rows with another number of cells belong to another table and are left out."""
    names = [c.strip().split()[0] for c in columns.split(",")]
    rows = [r for r in read_section(markdown, title) if len(r) == len(names)]
    text = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return text.select(*(F.col(c.strip().split()[0]).cast(c.strip().split()[1]) for c in columns.split(",")))


def report_characters(spark: SparkSession, markdown: str) -> DataFrame:
    return report_frame(spark, markdown, "Top body characters", "value string, n bigint")


def report_candidates(spark: SparkSession, markdown: str) -> DataFrame:
    return report_frame(spark, markdown, "Top candidate dictionary entries", "candidate string, n bigint, saved_bits bigint, total_score bigint")


def report_selected(spark: SparkSession, markdown: str) -> DataFrame:
    return report_frame(spark, markdown, "Selected dictionary entries", "candidate string, n bigint, saved_bits bigint, gain double, cost_bits bigint, net_score double")
