"""Session factory and the tables an iterative plan writes between its rounds."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and, for local masters only, shuffle partitions from the cores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", str(max(4, os.cpu_count() or 4)))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


class Rounds:
    """Parquet tables of one iterative plan below ``spark.checkpoint.dir``; each round's table cuts the lineage.

    A temporary folder stands in only in local mode; a cluster must name a shared one.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", "")
        if not root:
            if spark.conf.get("spark.master", "local").split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
