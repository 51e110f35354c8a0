"""Incremental upserts of a stream of records: each micro-batch goes through the same fold as a batch run, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve as rs
from ..operators.schema import CANONICAL, numbered
from ..operators.versions import place


def upsert_batch(path: str, stream: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds a batch (canonical columns, in any order) into the master at `path`, a table of the
    versioned store around it.

    The store's marks hold the last batch of each stream, by the running query's id or the name given, and change in one step
    with the master: a batch that comes again, after a crash or by a restart from the same checkpoint, is not folded again.
    Rows of a batch are taken in the order of all their columns, so a batch that is tried again folds alike; rows equal in all
    columns stay rows of their own, and the fold decides on them.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = f"batch {stream or spark.sparkContext.getLocalProperty('sql.streaming.queryId') or ''}"
        store, name = place(spark, path)
        base = store.manifest()
        if batch_id <= base["marks"].get(mark, -1):
            return
        text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CANONICAL]
        rows = numbered(batch.select(*text)).withColumnRenamed("position", "seq")
        master = store.read(name)
        master = rows.limit(0) if master is None else master
        first = master.agg(F.max("seq")).first()[0] or 0
        fresh, _ = rs.upsert(master.select("seq", *CANONICAL), rows.withColumn("seq", F.col("seq") + first), base["marks"].get("last_id", 0))
        fresh = rs.keep(fresh, "stream")
        store.commit({name: fresh}, marks={mark: batch_id, "last_id": max(rs.highest_id(fresh), base["marks"].get("last_id", 0))}, base=base["version"])
        store.clean()

    return fold


def start(stream: DataFrame, path: str, checkpoint: str):
    """The running query of a stream into a master."""
    return stream.writeStream.foreachBatch(upsert_batch(path)).option("checkpointLocation", checkpoint).start()
