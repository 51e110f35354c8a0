"""Byte-level BPE by recursive DuckDB queries in each task.

A rank file gives each token its bytes and its id, which is also its rank. The merge table has a row for each pair of tokens
whose joined bytes are a token. Texts are pre-split by the usual pattern; each distinct word becomes one row for each of its
bytes: position, word, token, next position. A recursive query keyed by position contracts, in every round and for each word,
the leftmost pair of the least rank: the pair's first row gets the merged token and the place behind the second row, which
goes. A word that no merge changes any more leaves the recursion; the last rows, aggregated in order, are its ids. Words that
are tokens themselves are looked up first, as the library does.

Words beyond WIDE bytes take a second query that contracts many pairs in a round. A token has at most `longest` bytes, so
whatever consumes one of a pair's tokens before the pair's turn begins within that distance: a pair that is the least, by
rank and position, within twice that distance is contracted at once. So are, of pairs of equal rank side by side, every
second one where nothing of a lower rank is near, if no pair with the merged token has a lower rank than it. The result is
that of one contraction after another, in a number of rounds that does not grow with each byte.

Decoding joins the ids with the tokens and aggregates their bytes in the order of positions. `decode_column` does so for whole
lists; `digests` decodes each distinct word's ids, and a text's bytes are its words' one after the other.

Distinct words and what they give are kept by a hash of their bytes, up to MAX_WORDS in a worker; decoded bytes are held
against the text, so two words of one hash are noticed and encoded again by themselves.

Defined results: null texts are empty and give no tokens; equal texts give equal ids, repeated rows a row each; special tokens
are text like any other; texts of any length are taken whole, in a slice of their own; an empty table gives an empty result;
other columns are not read, but for `encode_column` and `decode_column`, which return them and replace a column of the name
they write; null lists of ids give null.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Table, pre_split
from .text import column_bytes, ragged, run_hashes, slices, tidy

MAX_WORDS = 1_000_000
#: Words of one query.
CHUNK = 1 << 13
#: Longer words are contracted at many places in a round.
WIDE = 64
SLICE = 4 << 20
MEMORY = "512MB"

#: Places are unique over all words; a row that a contraction has taken up has no token.
CONTRACT = """
WITH RECURSIVE step(pos, w, token, nxt) USING KEY (pos) AS (
  SELECT pos, w, token, nxt FROM start
  UNION ALL
  (WITH best AS (
     SELECT a.w, arg_min({'pos': a.pos, 'token': merged, 'gone': b.pos, 'nxt': b.nxt}, merged::BIGINT << 32 | a.pos) AS x
     FROM recurring.step a JOIN recurring.step b ON b.pos = a.nxt JOIN merges ON pair = (a.token::BIGINT << 20 | b.token)
     WHERE a.w IN (SELECT w FROM step) GROUP BY a.w)
   SELECT x.pos, w, x.token, x.nxt FROM best UNION ALL SELECT x.gone, w, NULL, NULL FROM best)
)
SELECT w, list(token ORDER BY pos) AS ids FROM step WHERE token IS NOT NULL GROUP BY w ORDER BY w
"""

CONTRACT_WIDE = """
WITH RECURSIVE step(pos, w, token, nxt) USING KEY (pos) AS (
  SELECT pos, w, token, nxt FROM start
  UNION ALL
  (WITH live AS (
     SELECT pos, w, token, row_number() OVER place AS i, lead(token) OVER place AS other, lead(pos) OVER place AS gone, lead(nxt) OVER place AS nxt
     FROM recurring.step WHERE token IS NOT NULL AND w IN (SELECT w FROM step) WINDOW place AS (PARTITION BY w ORDER BY pos)),
   pairs AS (
     SELECT pos, w, i, gone, live.nxt, merged, steady, merged::BIGINT << 32 | pos AS pick, i - row_number() OVER (PARTITION BY w, merged ORDER BY i) AS run
     FROM live JOIN merges ON pair = (token::BIGINT << 20 | other)),
   near AS (SELECT *, min(pick) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN $reach PRECEDING AND $reach FOLLOWING) AS least FROM pairs),
   runs AS (SELECT *, bool_and(least >> 32 = merged) OVER (PARTITION BY w, merged, run) AS free, (row_number() OVER (PARTITION BY w, merged, run ORDER BY i)) % 2 AS odd FROM near),
   best AS MATERIALIZED (SELECT * FROM runs WHERE pick = least OR (free AND steady AND odd = 1))
   SELECT pos, w, merged, nxt FROM best UNION ALL SELECT gone, w, NULL, NULL FROM best)
)
SELECT w, list(token ORDER BY pos) AS ids FROM step WHERE token IS NOT NULL GROUP BY w ORDER BY w
"""

DECODE = "SELECT word, list(bytes ORDER BY pos) AS bytes FROM sequence JOIN tokens USING (token) GROUP BY word ORDER BY word"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def list_lens(col: pa.Array) -> np.ndarray:
    return np.diff(col.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)


class Merges:
    """The merge table of a rank file in a DuckDB database of the task's process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines()) if token}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.longest = max(map(len, ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        self.db.register("ranks", pa.table({"bytes": pa.array(list(ranks), pa.binary()), "token": pa.array(ranks.values(), pa.int32())}))
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM ranks")
        self.db.unregister("ranks")
        parts = [(ranks.get(t[:k]), ranks.get(t[k:]), rank) for t, rank in ranks.items() for k in range(1, len(t))]
        parts = np.array([p for p in parts if p[0] is not None and p[1] is not None], np.int64).reshape(-1, 3)
        lower = np.zeros(max(ranks.values()) + 1, bool)  # tokens that some pair of a lower rank holds
        for side in (0, 1):
            lower[parts[parts[:, 2] < parts[:, side], side]] = True
        self.db.register("parts", pa.table({"pair": parts[:, 0] << 20 | parts[:, 1], "merged": parts[:, 2].astype(np.int32), "steady": ~lower[parts[:, 2]]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM parts")
        self.db.unregister("parts")

    def query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.db.unregister(name)

    def encode(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (byte runs that are not empty), one after the other, and the number of each word's ids."""
        counts, found = np.zeros(len(starts), np.int64), []
        wide = lens > WIDE
        for kind in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            for k in range(0, len(kind), CHUNK):
                found.append(self.encode_some(buf, starts, lens, kind[k : k + CHUNK]))
        ids = np.zeros(sum(len(x) for _, _, x in found), np.int32)
        for which, n, _ in found:
            counts[which] = n
        at = np.cumsum(counts) - counts
        for which, n, x in found:
            ids[ragged(at[which], n)] = x
        return ids, counts

    def encode_some(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words (by their places), their numbers of ids, and the ids: whole tokens first, then the contracted ones."""
        size = lens[which]
        own = buf[ragged(starts[which], size)]
        edge = np.append(0, np.cumsum(size))
        words = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())])
        whole = self.query("SELECT w, token FROM words JOIN tokens USING (bytes)", words=pa.table({"w": np.arange(len(which), dtype=np.int32), "bytes": words}))
        hit = whole["w"].to_numpy()
        left = np.ones(len(which), bool)
        left[hit] = False
        left = np.flatnonzero(left)
        place = ragged(edge[left], size[left])
        nxt = np.arange(1, len(place) + 1, dtype=np.int32)
        nxt[np.cumsum(size[left]) - 1] = -1
        start = pa.table({"pos": np.arange(len(place), dtype=np.int32), "w": np.repeat(left, size[left]).astype(np.int32), "token": self.of_byte[own[place]], "nxt": nxt})
        sql = CONTRACT if not len(which) or size.max() <= WIDE else CONTRACT_WIDE.replace("$reach", str(2 * self.longest))
        done = self.query(sql, start=start)
        lists = done["ids"].combine_chunks()
        n = np.append(np.ones(len(hit), np.int64), list_lens(lists))
        return which[np.append(hit, done["w"].to_numpy())], n, np.append(whole["token"].to_numpy(), lists.flatten().to_numpy()).astype(np.int32)

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the id lists of the given lengths, one after the other, and the number of each list's bytes."""
        word = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        done = self.query(DECODE, sequence=pa.table({"word": word, "pos": np.arange(len(ids), dtype=np.int32), "token": ids.astype(np.int32)}))
        lists = done["bytes"].combine_chunks()
        buf, edge = column_bytes(lists.flatten())
        size = np.zeros(len(lens), np.int64)
        ends = np.append(0, np.cumsum(list_lens(lists)))
        if ends[-1] != len(ids):
            raise ValueError("an id without a token")
        size[done["word"].to_numpy()] = np.diff(edge[ends])
        return buf, size


class Store:
    """Lists of numbers one after the other; a slot's list is added once."""

    def __init__(self, kind: type):
        self.data, self.used, self.n = np.zeros(1 << 16, kind), 0, 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, data: np.ndarray, lens: np.ndarray) -> int:
        """Adds lists; the first one's slot."""
        grown = lambda a, n: np.concatenate((a, np.zeros(max(len(a), n), a.dtype)))
        if self.used + len(data) > len(self.data):
            self.data = grown(self.data, len(data))
        if self.n + len(lens) > len(self.starts):
            self.starts, self.lens = grown(self.starts, len(lens)), grown(self.lens, len(lens))
        k = self.n
        self.data[self.used : self.used + len(data)] = data
        self.starts[k : k + len(lens)] = self.used + np.cumsum(lens) - lens
        self.lens[k : k + len(lens)] = lens
        self.used, self.n = self.used + len(data), k + len(lens)
        return k

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the slots, one after the other, and their lengths."""
        lens = self.lens[slots]
        return self.data[ragged(self.starts[slots], lens)], lens


class Encoder:
    """Encodes slices of text and keeps the ids and decoded bytes of up to `max_words` distinct words."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.merges, self.max_words = Merges(path), max_words
        self.clear()

    def clear(self) -> None:
        self.table, self.ids, self.bytes = Table(self.max_words), Store(np.int32), Store(np.uint8)

    def add(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> int:
        ids, n = self.merges.encode(buf, starts, lens)
        self.bytes.add(*self.merges.decode(ids, n))
        return self.ids.add(ids, n)

    def slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each word."""
        lens = ends - starts
        keys, place, inverse = np.unique((run_hashes(buf, starts, ends) >> np.uint64(1)).astype(np.int64), return_index=True, return_inverse=True)
        if self.table.used + len(keys) > self.max_words and self.table.used:
            self.clear()
        out = self.table.get(keys, -1)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.add(buf, starts[place[new]], lens[place[new]]) + np.arange(len(new))
            if len(new) <= self.max_words:
                self.table.add(keys[new], out[new])
        return out[inverse]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts and each text's bounds in them; their decoded bytes and each text's bounds in those."""
        buf, offs = column_bytes(col)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64), buf, offs
        char = np.flatnonzero((buf & 0xC0) != 0x80)
        first = np.zeros(len(char), bool)
        first[np.searchsorted(char, offs[:-1][offs[:-1] < len(buf)])] = True
        starts = char[pre_split(np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), first)]
        ends = np.append(starts[1:], len(buf))
        slots = self.slots(buf, starts, ends)
        back, size = self.bytes.get(slots)
        if not np.array_equal(back, buf):  # another word of the same hash
            lens = ends - starts
            wrong = size != lens
            same = np.flatnonzero(~wrong)
            differ = self.bytes.get(slots[same])[0] != buf[ragged(starts[same], lens[same])]
            wrong[same[np.unique(np.repeat(np.arange(len(same)), lens[same])[differ])]] = True
            wrong = np.flatnonzero(wrong)
            slots[wrong] = self.add(buf, starts[wrong], lens[wrong]) + np.arange(len(wrong))
            back, size = self.bytes.get(slots)
        at = np.searchsorted(starts, offs)
        ids, n = self.ids.get(slots)
        return ids, np.append(0, np.cumsum(n))[at], back, np.append(0, np.cumsum(size))[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process' encoder of a rank file; what it holds is bounded."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column as array<int>; a column of that name is replaced."""
    path = path or default_path()
    kept = [c for c in docs.columns if c != ids]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for x in slices(batch, text, SLICE):
                found, at, _, _ = enc.encode(x.column(kept.index(text)))
                yield pa.RecordBatch.from_arrays([*x.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found, pa.int32()))], [*kept, ids])

    rows = docs.select(*kept)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of token ids; bytes that are no UTF-8 become U+FFFD; null ids give null; a column of that name is
    replaced."""
    path = path or default_path()
    kept = [c for c in df.columns if c != text]

    def run(batches):
        merges = encoder(path).merges
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 10):
                x = batch.slice(k, 1 << 10)
                lists = x.column(kept.index(ids))
                lens = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                flat = lists.flatten()
                buf, size = merges.decode(flat.to_numpy(zero_copy_only=False), lens)
                ends = np.append(0, np.cumsum(size)).tolist()
                raw = buf.tobytes()
                found = [raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(found, pa.string())], [*kept, text])

    rows = df.select(*kept)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of each row."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        sha = lambda raw, at: pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        for batch in batches:
            for x in slices(batch, limit=SLICE):
                ids, at, text, in_text = enc.encode(x.column(1))
                found = [sha(memoryview(ids.astype("<u4").tobytes()), 4 * at), sha(memoryview(text.tobytes()), in_text)]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.diff(at), pa.int64()), *found], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_recursive_bpe(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return digests(table(spark, sf_dir, "documents"))
