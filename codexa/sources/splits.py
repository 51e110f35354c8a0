"""Records of text files that Spark reads in byte ranges.

Spark's text source cuts files into ranges that end at line ends; this module finds the records in them. A format says by a
`Scan` which lines start a record, given a state at the line before: formats that know it from the line alone have one state, for
delimited text a line end may lie within quotes. Each range is read once for its number of lines and, where there are several
states, for what each of them becomes over it; composing these over a file's ranges gives the state each range starts in. Then
each range gives its records, and what stands before its first one belongs to the last record of an earlier range: only such
pieces are shuffled and joined. Any range size gives the same records and line numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.resolve import keep


@dataclass(frozen=True)
class Scan:
    """states: how many there are; a file starts in state 0. start(line, state, delimiter): whether the line starts a record.
    after(line, state, delimiter): the state at the next line."""

    start: Callable[[str, int, str], bool]
    states: int = 1
    after: Callable[[str, int, str], int] = lambda line, state, delimiter: 0


def text_lines(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, name, begin (of the range) and line, as bytes, of the files of a folder with such names."""
    meta = F.col("_metadata")
    ends = "(" + "|".join(re.escape(s) for s in suffixes) + ")$"
    rows = spark.read.option("recursiveFileLookup", False).text(path).where(F.lower(meta["file_name"]).rlike(ends))
    return rows.select(meta["file_path"].alias("path"), meta["file_name"].alias("name"), meta["file_block_start"].alias("begin"), F.col("value").cast("binary").alias("line"))


def decoded(line: bytes, encoding: str) -> str:
    return line.decode(encoding, "replace")


def heads(lines: DataFrame, size: int = 8192) -> DataFrame:
    """path and the first `size` bytes or so of each file, by whole lines."""

    def run(batches):
        seen: dict[str, list] = {}
        for batch in batches:
            for path, begin, line in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if begin == 0:
                    held = seen.setdefault(path, [0, []])
                    if held[0] < size:
                        held[0] += len(line) + 1
                        held[1].append(line)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([b"\n".join(x) for _, x in seen.values()], pa.binary())], ["path", "head"])

    return lines.where("begin = 0").mapInArrow(run, "path string, head binary")


def ranges(lines: DataFrame, scan: Scan, delimiter: dict[str, str]) -> DataFrame:
    """path, begin, lines, first (number of lines before), state (at its first line) and utf8 (of the whole file) of each range."""

    def count(batches):
        at, n, states, fits = None, 0, [], True
        done = []
        for batch in batches:
            for path, begin, line in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if at != (path, begin):
                    if at:
                        done.append((*at, n, states, fits))
                    at, n, states, fits = (path, begin), 0, list(range(scan.states)), True
                n += 1
                try:
                    text = line.decode("utf-8")
                except UnicodeDecodeError:
                    text, fits = line.decode("latin-1"), False
                if scan.states > 1:
                    states = [scan.after(text, s, delimiter.get(path, ",")) for s in states]
        if at:
            done.append((*at, n, states, fits))
        columns = list(zip(*done, strict=True)) or [[]] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["path", "begin", "lines", "states", "utf8"])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("begin")
        state, found = 0, []
        for states in pdf["states"]:
            found.append(state)
            state = int(states[state])
        out = pdf[["path", "begin", "lines"]].assign(first=pdf["lines"].cumsum() - pdf["lines"], state=found, utf8=bool(pdf["utf8"].all()))
        return out[["path", "begin", "lines", "first", "state", "utf8"]]

    counted = keep(lines.mapInArrow(count, "path string, begin long, lines long, states array<int>, utf8 boolean"), "counted")
    return keep(counted.groupBy("path").applyInPandas(follow, "path string, begin long, lines long, first long, state int, utf8 boolean"), "ranges")


def records(lines: DataFrame, scan: Scan, delimiter: dict[str, str] | None = None) -> DataFrame:
    """path, name, begin, n, line (its first one's number, from 0) and text of each record; begin and n give their order. What stands
    before a file's first record comes as one too, with n = 0."""
    delimiter = delimiter or {}
    at = ranges(lines, scan, delimiter)
    rows = lines.join(F.broadcast(at.select("path", "begin", "first", "state", "utf8")), ["path", "begin"])  # a row for each range
    rows = rows.select("path", "name", "begin", "line", "first", "state", "utf8")

    def cut(batches):
        key, held, out = None, [], []

        def sent():
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["path", "name", "begin", "n", "line", "text"])

        def close():
            if held:
                out.append((*key, n, begun, "\n".join(held)))

        for batch in batches:
            for path, name, begin, line, first, state, utf8 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (path, name, begin):
                    close()
                    key, held, n, number, now, begun = (path, name, begin), [], 0, first, state, first
                text = decoded(line, "utf-8" if utf8 else "latin-1")
                if number == 0:
                    text = text.removeprefix("﻿")
                if scan.start(text, now, delimiter.get(path, ",")):
                    close()
                    held, n, begun = [], n + 1, number
                held.append(text)
                now = scan.after(text, now, delimiter.get(path, ",")) if scan.states > 1 else 0
                number += 1
                if len(out) >= 4096:
                    yield sent()
                    out = []
        close()
        yield sent()

    pieces = keep(rows.mapInArrow(cut, "path string, name string, begin long, n int, line long, text string"), "pieces")
    last = pieces.groupBy("path", "begin").agg(F.max("n").alias("last"))
    before = W.partitionBy("path").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)  # over a file's ranges
    owner = F.last(F.when(F.col("last") > 0, F.struct("begin", "last")), ignorenulls=True).over(before)
    last = keep(last.withColumn("owner", owner), "last")
    rows = pieces.join(F.broadcast(last), ["path", "begin"])
    head = F.col("n") == 0  # of an earlier range's last record; before a file's first record all of it is one
    edge = head | (F.col("n") == F.col("last"))
    whole, moved = rows.where(~edge), rows.where(edge)
    zero = F.struct(F.lit(0).cast("long").alias("begin"), F.lit(0).alias("last"))
    own = F.when(head, F.coalesce("owner", zero)).otherwise(F.struct("begin", F.col("n").alias("last")))
    moved = moved.withColumn("own", own).groupBy("path", "name", "own").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("begin", "text"))).alias("parts"))
    moved = moved.select("path", "name", "own.begin", F.col("own.last").alias("n"), "line", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    return whole.select("path", "name", "begin", "n", "line", "text").unionByName(moved)


def numbered(rows: DataFrame, *inner: str) -> DataFrame:
    """Adds `row`, 0, 1, ... within each file, to rows in the order of begin, n and `inner`: positions within a range and the numbers of
    rows in the ranges before."""
    sizes = rows.groupBy("path", "begin").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy("path").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("path", "begin").orderBy("n", *inner)) - 1
    rows = rows.withColumn("_inside", inside).join(F.broadcast(sizes.select("path", "begin", "_before")), ["path", "begin"])
    return rows.withColumn("row", (F.col("_before") + F.col("_inside")).cast("int")).drop("_before", "_inside")


# Formats

def _blank(line: str) -> bool:
    return not line.strip()


NBIB = Scan(lambda line, state, delimiter: _blank(line))


def quoted_after(line: str, state: int, delimiter: str) -> int:
    """Whether a line of delimited text ends within quotes (1), for the state at its start: quotes open at a field's start only."""
    at, n = 0, len(line)
    while True:
        if state == 0:
            if '"' not in line[at:]:
                return 0
            while at < n and line[at] != '"':
                at = line.find(delimiter, at) + 1
                if at == 0:
                    return 0
            if at >= n:
                return 0
            at += 1
        state = 1
        while True:  # within quotes
            at = line.find('"', at)
            if at < 0:
                return 1
            if line[at + 1 : at + 2] != '"':
                break
            at += 2
        at = line.find(delimiter, at + 1) + 1  # the rest of the field is plain
        if at == 0:
            return 0
        state = 0


DELIMITED = Scan(lambda line, state, delimiter: state == 0, 2, quoted_after)
