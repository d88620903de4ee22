"""Tables that cut lineage, kept in the folder that driver and executors share.

All tables of one application lie in one folder, <spark.checkpoint.dir>/linkspark-<application id>, which can go
when the application has ended. What an operator needs only on its way is discarded by the operator.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

#: Spark's own switch: the shuffle files of a query go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """The tables of one operator's run: those on its way lie in a folder of their own, which close() empties;
    a kept table, which the result reads, lies beside it and stays as long as the application's folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/linkspark-{spark.sparkContext.applicationId}"
        self.run = f"{self.root}/run-{uuid.uuid4().hex}"
        self.used = False

    def stash(self, df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
        """Write df and read it back: later work starts from the files, so a lost executor costs a reread
        instead of a recomputation. The write's shuffle files are of no further use and go with it."""
        path = f"{self.root if keep else self.run}/{tag}-{uuid.uuid4().hex}"
        with _setting(self.spark, CLEANUP, "true"):
            df.write.parquet(path)
        self.used |= not keep
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stashed_at = path
        return out

    def _empty(self, path: str) -> None:
        """Through Spark's own writer, so wherever the folder lies."""
        self.spark.range(0).write.mode("overwrite").parquet(path)

    def discard(self, *frames: DataFrame) -> None:
        """Remove the files of large frames that stash() returned, ahead of close()."""
        for df in frames:
            if path := df.__dict__.get("_stashed_at"):
                self._empty(path)

    def close(self) -> None:
        """Remove all tables of this run that are not kept."""
        if self.used:
            self._empty(self.run)
            self.used = False


def stash(df: DataFrame, tag: str) -> DataFrame:
    """A table that stays as long as the application."""
    return Scratch(df.sparkSession).stash(df, tag, keep=True)
