"""Quality rules: measures of each text, and lines that too many documents of a host share.

Every line is normalised (A-Z lower-cased, white space between words made one space) and hashed. For each host (the
`source` column) the distinct documents that hold a line are counted, exact copies of a text each for itself. Lines held
by more than `limit` documents of the host are removed, and a document is rejected if less than `least` of its words are
left. Each task counts its lines before the shuffle, and adaptive execution splits the join of a hot line, so no line's
documents meet in one task.

Defined results: a null text has no words, so it fails the base rules; a null source is a host of its own; rows of equal
id, source and text are one document and get equal results; rows without id are kept, and each is a document of its own;
a text of any length is measured whole; empty tables give empty results. `judge` reads no other columns, `clean_texts`
returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import LOWER, SPACE, Words, column_bytes, mix, run_hashes, sequence_sums, slices, tidy, window_hashes

#: Distinct documents of one host that may hold a line. A small count, whatever the host's size: a line's verdict follows from
#: the documents that hold it alone, and is the same in a small table and in a large one.
LIMIT = 6
#: Keys of repeated rows that may be broadcast; beyond it they are joined.
MAX_BROADCAST = 2_000_000
#: Part of its words that a document keeps at least.
LEAST = 0.3
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Fixed value of the contract.
SYMBOLS = "#*$%&|<>"


def line_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (without the line feed) of all lines; empty documents have one empty line."""
    feeds = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate((offs[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((offs[1:], feeds)), kind="stable")
    return starts, ends


def line_hashes(w: Words, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: index among all lines, normalised hash, words, document."""
    starts, _ = line_bounds(w.buf, w.offs)
    # a line feed at a document's end makes an empty line with the next document's start; words lie in the last such line
    line = np.searchsorted(starts, w.starts, "right") - 1
    lines, first, n = np.unique(line, return_index=True, return_counts=True)
    total = sequence_sums(w.hashes(sums=sums), first)
    value = mix(total[first + n] - total[first] + n.astype(np.uint64))
    return lines, value, n, w.docs()[first] if len(first) else np.zeros(0, np.int64)


def measures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each document of a slice, and its distinct lines."""
    n = len(offs) - 1
    w = Words(buf, offs)
    exact = w.prefix_sums()
    h = w.hashes(sums=exact)
    over = lambda a: np.append(0, np.cumsum(a))[offs[1:]] - np.append(0, np.cumsum(a))[offs[:-1]]
    symbols = np.zeros(256, bool)
    symbols[[ord(c) for c in SYMBOLS]] = True
    out = {"n_words": np.diff(w.at), "word_chars": over(~SPACE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": over(symbols[buf])}

    windows = window_hashes(h, WINDOW)
    repeated = np.zeros(n, np.int64)
    for d, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
        if b - a > WINDOW:
            s = windows[a : b - WINDOW + 1]
            t = np.sort(s)
            if (t[1:] == t[:-1]).any():
                _, inverse, count = np.unique(s, return_inverse=True, return_counts=True)
                at = np.flatnonzero(count[inverse] > 1)
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                repeated[d] = int((np.cumsum(edge) > 0).sum())
    out["n_repeat_words"] = repeated

    lines, value, words, doc = line_hashes(w, w.prefix_sums(LOWER))
    starts, ends = line_bounds(buf, offs)
    raw = run_hashes(buf, starts[lines], ends[lines])
    dup, found_lines, found_words = np.zeros(n, np.int64), [], []
    at = np.searchsorted(doc, np.arange(n + 1))
    for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        dup[d] = b - a - len(np.unique(raw[a:b])) if b - a > 1 else 0
        u, inverse = np.unique(value[a:b], return_inverse=True)
        found_lines.append(u)
        found_words.append(np.bincount(inverse, words[a:b], len(u)).astype(np.int64))
    out["n_dup_lines"] = dup
    out["line_at"] = np.append(0, np.cumsum([len(x) for x in found_lines])).astype(np.int64)
    out["lines"] = np.concatenate(found_lines) if found_lines else np.zeros(0, np.uint64)
    out["line_words"] = np.concatenate(found_words) if found_words else np.zeros(0, np.int64)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, host, and a hash of the row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    host = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    return docs.select("doc_id", text.alias("text"), host.alias("host"), F.xxhash64("doc_id", host, text).alias("row_key"))


def measure(docs: DataFrame) -> DataFrame:
    """Of each row of `keyed`: its keys, measures and distinct lines with their words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "host", "row_key", *COUNTS, "lines", "line_words"]

    def run(batches):
        for batch in batches:
            for x in slices(batch):
                m = measures(*column_bytes(x.column(1)))
                at = pa.array(m["line_at"].astype(np.int32), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(a.view(np.int64), pa.int64())) for a in (m["lines"], m["line_words"])]
                yield pa.RecordBatch.from_arrays([x.column(0), *x.columns[2:4], *[pa.array(m[c], pa.int64()) for c in COUNTS], *lists], names)

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, host string, row_key long, {', '.join(c + ' long' for c in COUNTS)}, lines array<long>, line_words array<long>")


def frequent_lines(measured: DataFrame, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """host and line of the lines that more than `limit` distinct documents of the host hold. A row's lines are distinct, so
    rows are counted; only those that come more than once are made distinct first."""
    scratch = scratch or Scratch(measured.sparkSession)
    twice = measured.where(F.col("doc_id").isNotNull()).groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key")
    twice = scratch.keep(twice, "twice")
    rows, n = measured.select("row_key", "host", "lines"), twice.count()
    if n:
        twice = F.broadcast(twice) if n <= MAX_BROADCAST else twice
        again = rows.join(twice, "row_key", "left_semi").select("row_key", "host", F.explode("lines").alias("line")).distinct()
        rows = rows.join(twice, "row_key", "left_anti")
    rows = rows.select("host", F.explode("lines").alias("line"))
    rows = rows.unionByName(again.select("host", "line")) if n else rows
    return rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > limit).drop("documents")


def removed_words(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """row_key and the number of its words that lie in frequent lines."""
    rows = measured.select("row_key", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row_key", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hits = rows.join(frequent, ["host", "line"])
    return hits.groupBy("row_key", "line").agg(F.max("words").alias("words")).groupBy("row_key").agg(F.sum("words").alias("removed"))


def judge(docs: DataFrame, limit: int = LIMIT, least: float = LEAST, scratch: Scratch | None = None) -> DataFrame:
    scratch = scratch or Scratch(docs.sparkSession)
    measured = scratch.keep(measure(keyed(docs)), "measured")
    frequent = scratch.keep(frequent_lines(measured, limit, scratch), "frequent")
    removed = scratch.keep(removed_words(measured, frequent), "removed")
    rows = measured.drop("lines", "line_words").join(removed, "row_key", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("removed") >= F.lit(least) * F.col("n_words"))
    return rows.select("doc_id", *COUNTS, failed.alias("base_failed"), kept.alias("kept"), F.col("removed").alias("n_removed_words"))


def clean_texts(docs: DataFrame, limit: int = LIMIT, scratch: Scratch | None = None) -> DataFrame:
    """docs, all columns, with the frequent lines cut from their texts; a text whose lines all go is empty."""
    scratch = scratch or Scratch(docs.sparkSession)
    frequent = scratch.keep(frequent_lines(scratch.keep(measure(keyed(docs)), "measured"), limit, scratch), "frequent")
    text, host = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    key = "__row"
    while key in docs.columns:
        key += "_"
    rows = docs.withColumn(key, F.xxhash64("doc_id", host, text))
    measured = measure(keyed(docs)).select("row_key", "host", F.explode("lines").alias("line")).distinct()
    cut = measured.join(frequent, ["host", "line"]).groupBy("row_key").agg(F.collect_set("line").alias("lines cut"))
    rows = rows.join(cut, rows[key] == cut["row_key"], "left").select(*(rows[c] for c in docs.columns), "lines cut")
    names, place = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for x in slices(batch):
                buf, offs = column_bytes(x.column(place))
                before = np.searchsorted(np.flatnonzero(buf == 10), offs) + np.arange(len(offs))  # lines before each document
                w = Words(buf, offs)
                lines, value, _, doc = line_hashes(w, w.prefix_sums(LOWER))
                starts, ends = line_bounds(buf, offs)
                out = x.column(place).to_pylist()
                for d, cut in enumerate(x.column(x.num_columns - 1).to_pylist()):
                    if cut:
                        mine, cut = doc == d, set(cut)
                        drop = {int(i) for i, v in zip(lines[mine], value[mine].view(np.int64), strict=True) if int(v) in cut}
                        out[d] = b"\n".join(buf[starts[i] : ends[i]].tobytes() for i in range(before[d], before[d + 1]) if i not in drop).decode()
                cols = [*x.columns[:-1]]
                cols[place] = pa.array(out, x.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(tidy(run), docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return judge(table(spark, sf_dir, "documents"))


#: The rules by list and regular expressions; lines are compared as texts, not by hashes.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
lines AS (SELECT r, doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (SELECT r, host, coalesce(doc_id || ':' || md5(t), 'row ' || r) AS document, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
plain AS (SELECT r, host, document, line, len(words) AS n, translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM worded),
frequent AS (SELECT host, norm FROM plain GROUP BY ALL HAVING count(DISTINCT document) > 6),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM plain GROUP BY r),
removed AS (SELECT r, sum(n)::BIGINT AS n FROM plain JOIN frequent USING (host, norm) GROUP BY r),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS x FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT r, x FROM win GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, x)) GROUP BY r),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cover USING (r) LEFT JOIN removed USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept, n_removed_words FROM f
"""
