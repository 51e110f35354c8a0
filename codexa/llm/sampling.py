"""Folds and bounded samples of labelled rows, for the trained operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import slices, tidy


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as fold -1, so it is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def unit(*cols: Column, seed: int) -> Column:
    """A hash of the columns as a number from 0 to below 1."""
    return (F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def training_labels(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of rows whose label may be learned: known, and outside the held-out fold. One row for each id."""
    y = F.col(column).cast("int")
    rows = labels.select("doc_id", y.alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return rows.where(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))


def share(rows: int, bound: int) -> float:
    """The part of `rows` to draw so that about `bound` of them are drawn."""
    return 1.0 if rows <= bound else bound / rows


def drawn_rows(docs: DataFrame, picked: DataFrame, features: Callable, bounds: dict[str, int], max_bytes: int) -> dict[str, list[bytes]]:
    """Of each kind the features, as bytes, of the documents picked for it, at most bounds[kind] documents and about `max_bytes` of all.

    picked: doc_id and a boolean column for each kind, of a bounded number of ids. `features` gives an array for each
    document of a slice. Repeated rows of equal id and text count once. Where an id has many texts, documents are drawn by
    a hash of id and text, and each kind that has documents keeps one at least."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.select(unit(F.col("doc_id"), F.col("text"), seed=11).alias("key"), *bounds, "text").dropDuplicates(["key"])

    def gather(batches):
        for batch in batches:
            for x in slices(batch):
                found = [f.tobytes() for f in features(x)]
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.binary())], [*x.schema.names[:-1], "size", "found"])

    kinds = ", ".join(f"{k} boolean" for k in bounds)
    rows = scratch.keep(rows.mapInArrow(tidy(gather), f"key double, {kinds}, size long, found binary"), "drawn")
    out = {}
    for kind, bound in bounds.items():
        own = rows.where(kind)
        sizes = own.select("key", "size").orderBy("key").limit(bound).collect()  # a bounded number of rows
        last, total = None, 0
        for r in sizes:
            total += r["size"]
            if last is not None and total * len(bounds) > max_bytes:
                break
            last = r["key"]
        got = own.where(F.col("key") <= last).select("key", "found").collect() if sizes else []
        out[kind] = [bytes(r.found) for r in sorted(got, key=lambda r: r.key)]
    scratch.drop(rows)
    return out
