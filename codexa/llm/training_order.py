"""Training-order materialisation of token sequences.

Texts are cut to sequences of a fixed number of tokens. A token is a byte of the UTF-8 text; END (254) closes a document
and PAD (255) fills its last sequence; neither byte occurs in UTF-8. All sequences are numbered in the order of document id
and position; a keyed Feistel permutation over the next even power of two, walked along its cycle until it falls below the
count, maps each number to a slot. Ranges of slots become shard files, in which slot s lies at (s - first) * stride, so a
reader finds any slot, and resumes at any, by arithmetic.

Numbers need no global window: documents are sorted in ranges, each range's sequence total is one row, and those totals
(one for each partition) give the ranges' first numbers. As slots are even, the ranges of shards that a partition writes
are known beforehand: sequences go to them at once, in compressed packs, and are written shard by shard.

Defined results: null and empty texts give one sequence of END and PAD; a null id sorts first; rows of equal id are ordered
by text hash, and equal rows are numbered one after the other; a text of any length is cut whole; other columns are not
read; an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch
from .text import column_bytes, slices, tidy

LENGTH = 512
END, PAD = 254, 255
KEY = "2024"
ROUNDS = 6
SHARD_BYTES = 64 << 20
FLUSH_BYTES = 32 << 20
#: Documents whose first numbers (about 140 bytes each on the driver and executors) are broadcast; more are joined.
MAX_BROADCAST = 1_000_000
#: Equal rows that one task cuts.
EQUAL_ROWS = 1000
#: Bytes that are read at once, at most, where sequences lie side by side.
READ_BYTES = 8 << 20


def round_keys(key: str, rounds: int = ROUNDS) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)], np.uint64)


def _walk(x: np.ndarray, n: int, keys: np.ndarray, back: bool) -> np.ndarray:
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(v):
        left, right = v >> half, v & mask
        for k in keys[::-1] if back else keys:
            source = left if back else right
            f = source * np.uint64(0x9E3779B97F4A7C15) + k
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(32))) & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        return left << half | right

    out = once(np.asarray(x).astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def permute(x, n: int, key: str = KEY) -> np.ndarray:
    """The slots of numbers below n: a keyed bijection on 0 to n - 1."""
    return _walk(x, n, round_keys(key), False)


def restore(slots, n: int, key: str = KEY) -> np.ndarray:
    """The numbers at slots."""
    return _walk(slots, n, round_keys(key), True)


def n_sequences(size: F.Column, length: int) -> F.Column:
    return F.floor((size + 1 + length - 1) / length)


def numbered(docs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """doc_id, key (the text's hash), n (sequences of a row), rows (equal ones) and first (the number of their first sequence), and
    the count of sequences."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), n_sequences(F.octet_length(text), length).alias("n"))
    sizes = rows.groupBy("doc_id", "key").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = sizes.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        total = 0
        for b in batches:
            before = np.append(0, np.cumsum(b.column(2).to_numpy() * b.column(3).to_numpy()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total + before[:-1], pa.int64())], ["doc_id", "key", "n", "rows", "before"])
            total += int(before[-1])

    placed = placed.mapInArrow(tidy(run), f"doc_id {kind}, key long, n long, rows long, before long").withColumn("part", F.spark_partition_id())
    placed = scratch.keep(placed, "numbered")
    starts, at = [], 0
    for r in placed.groupBy("part").agg(F.sum(F.col("n") * F.col("rows")).alias("n")).orderBy("part").collect():  # a row for each partition
        starts.append((r.part, at))
        at += r.n
    spark = docs.sparkSession
    starts = spark.createDataFrame(starts, "part int, start long")
    first = placed.join(F.broadcast(starts), "part").select("doc_id", "key", "n", "rows", (F.col("start") + F.col("before")).alias("first"))
    return first, at


def packed(docs: DataFrame, length: int, key: str, per: int, first: DataFrame, total: int) -> DataFrame:
    """shard, slots, ids, nos and the compressed tokens of all sequences; one row for each shard that a flush of a task meets."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = docs.select(F.col("doc_id").alias("own"), text.alias("text")).withColumn("own_key", F.xxhash64("text"))

    def with_numbers(rows: DataFrame, numbers: DataFrame) -> DataFrame:
        numbers = F.broadcast(numbers) if numbers.count() <= MAX_BROADCAST else numbers
        return rows.join(numbers, rows["own"].eqNullSafe(numbers["doc_id"]) & (rows["own_key"] == numbers["key"])).select("doc_id", "text", "first", "rows")

    rows = with_numbers(every, first.where("rows = 1"))
    several = first.where("rows > 1")
    if not several.isEmpty():  # each text once, and its numbers in parts
        part = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / EQUAL_ROWS))).alias("part")
        parts = several.select("doc_id", "key", "n", "rows", "first", part)
        parts = parts.select("doc_id", "key", F.least(F.col("rows") - F.col("part") * EQUAL_ROWS, F.lit(EQUAL_ROWS)).alias("rows"), (F.col("first") + F.col("part") * EQUAL_ROWS * F.col("n")).alias("first"))
        once = every.join(several.select("doc_id", "key"), every["own"].eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key")), "left_semi").dropDuplicates(["own", "own_key"])
        rows = rows.unionByName(with_numbers(once, parts))
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        arrow = None

        def flush(ids, nos, numbers, data):
            slots = permute(np.array(numbers, np.int64), total, key)
            order = np.argsort(slots, kind="stable")
            shards = slots[order] // per
            tokens = np.frombuffer(b"".join(data), np.uint8).reshape(-1, length)[order]
            at = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
            ends = np.append(at[1:], len(order))
            offsets = pa.array(np.append(at, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, a) for a in (pa.array(slots[order]), pa.array(ids, arrow).take(pa.array(order)), pa.array(nos, pa.int32()).take(pa.array(order)))]
            blobs = [pa.compress(tokens[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shards[at].astype(np.int32)), *lists, pa.array(blobs, pa.binary())], ["shard", "slots", "ids", "nos", "data"])

        held = [[], [], [], []]
        for batch in batches:
            arrow = batch.schema.field(0).type
            for x in slices(batch):
                buf, offs = column_bytes(x.column(1))
                for d, (doc, f, equal) in enumerate(zip(*(x.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                    raw = buf[offs[d] : offs[d + 1]].tobytes() + bytes([END])
                    raw += bytes([PAD]) * (-len(raw) % length)
                    k = len(raw) // length
                    for at in range(f, f + k * equal, k):
                        held[0] += [doc] * k
                        held[1] += range(k)
                        held[2] += range(at, at + k)
                        held[3].append(raw)
                        if len(held[2]) * length >= FLUSH_BYTES:
                            yield flush(*held)
                            held = [[], [], [], []]
        if held[0]:
            yield flush(*held)

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(id_type)), T.StructField("nos", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])
    return rows.mapInArrow(tidy(run), schema)


def write(docs: DataFrame, folder: str, length: int = LENGTH, key: str = KEY, shard_bytes: int = SHARD_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Writes the shards and their manifest; slot, doc_id, seq_no, shard, offset of all sequences, kept in the shared folder."""
    scratch = scratch or Scratch(docs.sparkSession)
    first, total = numbered(docs, length, scratch)
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per = max(1, min(shard_bytes // length, -(-total // (4 * tasks))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    shards = max(1, -(-total // per))
    ranges = min(shards, tasks)

    def write_shard(shard: int, packs: list[pa.RecordBatch]) -> pa.RecordBatch:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        slots, ids, nos = (pa.concat_arrays([x.column(c).flatten() for x in packs]) for c in ("slots", "ids", "nos"))
        counts = [len(x.column("slots")[0]) for x in packs]
        tokens = np.concatenate([np.frombuffer(pa.decompress(x.column("data")[0].as_py(), n * length, "zstd"), np.uint8) for x, n in zip(packs, counts, strict=True)]).reshape(-1, length)
        order = np.argsort(slots.to_numpy(), kind="stable")
        start = int(slots[int(order[0])].as_py())
        name = f"{shard:06d}-{start:012d}.bin"
        beside = f"{path}/.{name}-{uuid.uuid4().hex}"  # a retried task writes the same bytes, and moves them in place at once
        with fs.open_output_stream(beside, compression=None) as f:
            f.write(tokens[order].tobytes())
        fs.move(beside, f"{path}/{name}")
        pick = pa.array(order)
        return pa.RecordBatch.from_arrays([slots.take(pick), ids.take(pick), nos.take(pick), pa.array([name] * len(order)), pa.array(np.arange(len(order), dtype=np.int64) * length)], ["slot", "doc_id", "seq_no", "shard", "offset"])

    def run(batches):
        shard, packs = None, []
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                if packs and k != shard:
                    yield write_shard(shard, packs)
                    packs = []
                shard = k
                packs.append(batch.slice(i, 1))
        if packs:
            yield write_shard(shard, packs)

    dealt = packed(docs, length, key, per, first, total).repartitionById(ranges, F.floor(F.col("shard").cast("long") * ranges / shards).cast("int"))
    dealt = dealt.sortWithinPartitions("shard").mapInArrow(tidy(run), f"slot long, doc_id {kind}, seq_no int, shard string, offset long")
    index = scratch.keep(dealt, "index")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json", compression=None) as f:
        f.write(json.dumps({"sequences": total, "length": length, "stride": length, "key": key, "end": END, "pad": PAD}).encode())
    return index


def read(folder: str, start: int = 0):
    """Yields (slot, tokens) from a slot on, shard by shard: a resumable sequential reader."""
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        length = json.loads(f.read())["length"]
    files = sorted((int(x.base_name[7:19]), x) for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".bin") and x.base_name[0] != ".")
    for first, x in files:
        n = x.size // length
        at = max(first, start)
        if first + n <= at:
            continue
        with fs.open_input_file(x.path) as f:
            f.seek((at - first) * length)
            for slot in range(at, first + n, max(1, READ_BYTES // length)):
                for k, raw in enumerate(np.frombuffer(f.read(READ_BYTES // length * length), np.uint8).reshape(-1, length)):
                    yield slot + k, raw


def check(index: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Reads every sequence back by its shard and offset, neighbours at once: its number of text tokens and its bytes' crc32."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        f = opened = None
        for b in batches:
            names, offsets, n, crc = b.column(3).to_pylist(), b.column(4).to_pylist(), [], []
            i = 0
            while i < len(names):
                j = i + 1
                while j < len(names) and names[j] == names[i] and offsets[j] == offsets[j - 1] + length and (j - i) * length < READ_BYTES:
                    j += 1
                if names[i] != opened:
                    f, opened = fs.open_input_file(f"{path}/{names[i]}"), names[i]
                block = f.read_at((j - i) * length, offsets[i])
                for k in range(0, len(block), length):
                    raw = block[k : k + length]
                    end = raw.find(bytes([END]))
                    n.append(length if end < 0 else end)
                    crc.append(zlib.crc32(raw))
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["slot", "doc_id", "seq_no", "n_tokens", "crc32"])

    return index.mapInArrow(tidy(run), f"slot long, doc_id {kind}, seq_no int, n_tokens int, crc32 long")


def op2_training_order(spark, sf_dir: str) -> DataFrame:
    from .store import table

    scratch = Scratch(spark)
    folder = scratch.path("shards")
    return check(write(table(spark, sf_dir, "documents"), folder, scratch=scratch), folder)
