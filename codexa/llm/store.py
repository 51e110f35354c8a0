"""Tables and folders that all machines of the cluster share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Parquet pages are compressed one by one.
PAGE_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset and all tasks run on this machine, a temporary folder is
    set; on a cluster that is an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; set it to a folder that all machines of the cluster share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "codexa-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


class Scratch:
    """Writes intermediate tables to the shared folder, so that lineage is cut and lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        self.kept: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "table", level: int = 3) -> DataFrame:
        path = self.path(name)
        schema = df.schema
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")  # once the table is written, nothing reads the shuffle files that led to it
        try:
            df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", PAGE_BYTES).parquet(path)
        finally:
            conf.set(CLEANUP, before)
        out = self.spark.read.schema(schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of kept tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            for path in [p for df, p in self.kept if df is t]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        self.kept = [(df, p) for df, p in self.kept if all(df is not t for t in tables)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
