"""Session for tests, bench and interactive use; library code takes any session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str = "local[8]", name: str = "lyceum", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is named, a temporary one, for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return (named or f"file://{tempfile.gettempdir()}/lyceum-checkpoints").rstrip("/")
