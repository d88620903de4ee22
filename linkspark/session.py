"""Session defaults for local use and tests; on a cluster the submitted configuration wins."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it. Where it is unset, a temporary folder serves a session
    that is one process (tests); a cluster without it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="linkspark-")
        atexit.register(shutil.rmtree, _own["folder"], ignore_errors=True)
    return _own["folder"]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", more: dict[str, str] | None = None) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linkspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config(map=more or {})
        .getOrCreate()
    )
