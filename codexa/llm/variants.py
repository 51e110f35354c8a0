"""Spelling variants: words that one edit turns into each other, found by bands of letter-parity masks.

A word's mask has one bit for each letter class, set if the letters of the class occur an odd number of times. One inserted,
deleted or replaced letter flips at most two bits, so of the three bands into which the bits are split one at least is
equal in two near words. Words are joined on equal bands within the same length class (the shorter word's length), and
besides on the half that the edit left alone: of two near words whose shorter one has s letters, the first s // 2 letters are
equal or the last s // 2. The join holds each pair against the masks' distance and the exact edit distance, so no other
pairs leave it, and a pair that meets under several keys is taken at the first of them only.

Words are counted in tasks: one crc32 for each distinct word of a document decides whether its occurrences lose a letter;
task counts are summed before and behind the shuffle. What follows grows with the number of distinct words. Forms are
followed by pointer doubling; as a form has at least twice its word's count, chains are as short as log2 of the largest count.

Defined results: null texts have no words; a null id is the empty string within the hash; repeated rows count each; texts
and words of any length are taken whole; the Latin letters of the contract's range that Unicode calls signs (U+00D7, U+00F7)
are letters here; equal counts of forms are settled by code-point order; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import LOWER, Words, column_bytes, mix, run_hashes, slices, tidy

#: Fixed values of the contract.
TYPO_EVERY, MIN_LETTERS, MIN_COUNT, FORM_TIMES = 97, 5, 3, 2
#: Bits of a mask: a letter's bit is its code point modulo BITS, and belongs to the band of that number modulo BANDS.
BITS, BANDS = 63, 3
#: Distinct words that a task holds before it sends their counts on.
MAX_HELD = 1 << 17
#: Longer words are hashed one by one.
WIDE = 48
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = crc_table()


def continued_crc(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of the byte runs, each continued from the crc32 of what stands before it."""
    out = before.astype(np.uint32)
    for k in np.flatnonzero(lens > WIDE).tolist():
        out[k] = zlib.crc32(buf[starts[k] : starts[k] + lens[k]], int(before[k]))
    short = np.flatnonzero(lens <= WIDE)
    short = short[np.argsort(-lens[short], kind="stable")]
    at, size, state = starts[short], lens[short], out[short] ^ np.uint32(0xFFFFFFFF)
    longer = np.searchsorted(-size, -np.arange(WIDE + 1), "left")  # runs with more than j bytes come first
    for j in range(int(size[0]) if len(size) else 0):
        k = longer[j]
        state[:k] = _CRC[(state[:k] ^ buf[at[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    out[short] = state ^ np.uint32(0xFFFFFFFF)
    return out


def letter_runs(buf: np.ndarray, offs: np.ndarray) -> Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, which are the bytes C3 80 to C3 BF."""
    low = buf | 32
    inside = (low >= 97) & (low <= 122) | (buf == 0xC3)
    inside[1:] |= buf[:-1] == 0xC3
    table = np.zeros(256, bool)
    table[0] = True
    return Words(inside.astype(np.uint8), offs, table)


def counted_words(buf: np.ndarray, offs: np.ndarray, prefix: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a slice with enough letters and their counts; prefix: the crc32 of each document's `<doc_id>:`."""
    w = letter_runs(buf, offs)
    if not len(w):
        return [], np.zeros(0, np.int64)
    low, lens = LOWER[buf], w.ends - w.starts
    h, doc = run_hashes(low, w.starts, w.ends), w.docs()
    _, first, n = np.unique(mix(h + mix(doc.astype(np.uint64) + _PLACE)), return_index=True, return_counts=True)  # runs of a document
    crc = continued_crc(low, w.starts[first], lens[first], prefix[doc[first]])
    hit = crc % np.uint32(TYPO_EVERY) == 0
    typos: dict[bytes, int] = {}
    for k, c in zip(np.flatnonzero(hit).tolist(), crc[hit].tolist(), strict=True):
        run = low[w.starts[first[k]] : w.ends[first[k]]].tobytes().decode()
        at = c % len(run)
        typo = (run[:at] + run[at + 1 :]).encode()
        typos[typo] = typos.get(typo, 0) + int(n[k])
    first, n = first[~hit], n[~hit]
    # letters of a run: its bytes but for the second of each pair
    seconds = np.append(0, np.cumsum(buf == 0xC3))
    enough = (lens - (seconds[w.ends] - seconds[w.starts]))[first] >= MIN_LETTERS
    first, n = first[enough], n[enough]
    _, place, inverse = np.unique(h[first], return_index=True, return_inverse=True)
    raw, at = low.tobytes(), first[place]
    words = [raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
    typos = {t: c for t, c in typos.items() if len(t.decode()) >= MIN_LETTERS}
    return words + list(typos), np.append(np.bincount(inverse, n, len(place)).astype(np.int64), np.fromiter(typos.values(), np.int64, len(typos)))


def vocabulary(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """word and n of the words that occur `least` times or more."""

    def run(batches):
        held: dict[bytes, int] = {}
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for x in slices(batch):
                prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in x.column(0).to_pylist()], np.uint32)
                words, n = counted_words(*column_bytes(x.column(1)), prefix)
                for word, k in zip(words, n.tolist(), strict=True):
                    held[word] = held.get(word, 0) + k
                if len(held) > MAX_HELD:
                    yield emit()
                    held = {}
        if held:
            yield emit()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """The bits of the letters that occur an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % BITS)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.when(c == "", F.lit(0).cast("long")).otherwise(bit(c))))


def band_bits(band: int) -> int:
    return sum(1 << b for b in range(band, BITS, BANDS))


def keys(words: DataFrame, longer: bool) -> DataFrame:
    """A row for each word, half and band: the keys under which it can meet words of its own or (longer: itself being the longer
    one) of one letter less."""
    s = F.length("word") - (1 if longer else 0)
    half = F.floor(s / 2).cast("int")
    halves = F.array(F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.length("word") - half + 1, half))
    bands = F.array(*[F.col("mask").bitwiseAND(F.lit(band_bits(k))) for k in range(BANDS)])
    rows = words.select("word", "n", "mask", s.alias("s"), halves.alias("halves"), bands.alias("bands"), F.explode(F.sequence(F.lit(0), F.lit(2 * BANDS - 1))).alias("k"))
    side, band = F.floor(F.col("k") / BANDS).cast("int"), F.col("k") % BANDS
    return rows.select("word", "n", "mask", "halves", "s", "k", F.get("halves", side).alias("half"), F.get("bands", band).alias("band"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n of all near words, each pair once: the shorter word first, of equal lengths the smaller one."""
    short = keys(words, False)
    long = short.select(*short.columns).unionByName(keys(words, True))
    a = short.select("s", "k", "half", "band", *[F.col(c).alias(c) for c in ("word", "n", "mask", "halves")])
    b = long.select("s", "k", "half", "band", *[F.col(c).alias(f"other_{c}") for c in ("word", "n", "mask", "halves")])
    differ = F.col("mask").bitwiseXOR(F.col("other_mask"))
    ordered = (F.length("word") < F.length("other_word")) | (F.col("word") < F.col("other_word"))
    # the first key under which the pair meets
    meets = [(F.get("halves", F.lit(k // BANDS)) == F.get("other_halves", F.lit(k // BANDS))) & (differ.bitwiseAND(F.lit(band_bits(k % BANDS))) == 0) for k in range(2 * BANDS)]
    first = F.coalesce(*[F.when(m, F.lit(k)) for k, m in enumerate(meets)])
    near = (F.bit_count(differ) <= 2) & ordered & (F.col("k") == first) & (F.levenshtein("word", "other_word", 1) == 1)
    return a.join(b, ["s", "k", "half", "band"]).where(near).select("word", "n", F.col("other_word").alias("other"), "other_n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root, from word and form: pointer doubling until no root has a form of its own."""
    at = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(at)
        at = new
        if not at.where("moved").limit(1).count():
            return at.drop("moved")


def group(docs: DataFrame, least: int = MIN_COUNT, times: int = FORM_TIMES, scratch: Scratch | None = None) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word that occurs `least` times or more."""
    scratch = scratch or Scratch(docs.sparkSession)
    counted = scratch.keep(vocabulary(docs, least), "words")
    words = counted.withColumn("mask", parity_mask(F.col("word")))
    pairs = near_pairs(words)
    ways = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("x")
    near = pairs.select(ways).select("x.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("own"))
    is_form = -F.col("best.less") >= times * F.col("own")
    near = scratch.keep(near.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "near")
    found = near.join(roots(near.where(F.col("form").isNotNull()), scratch), "word", "left")
    rows = counted.join(found, "word", "left")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return group(table(spark, sf_dir, "documents"))


#: Near words by their deletion neighbourhoods; crc32 by its table, byte by byte.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(0, 256) AS r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT key, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS key,
    unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')).translate('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, octet_length(encode(key || run)) * 2, 2), lambda j: ('0x' || substr(hex(encode(key || run)), j::INT + 1, 2))::UBIGINT)),
    lambda s, b: xor(t[(xor(s, b) & 255)::INT + 1], s >> 8)), 4294967295::UBIGINT) AS h FROM runs, crc),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 2)) AS i FROM w)),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (part) WHERE a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1),
near AS MATERIALIZED (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS m FROM pairs
  WHERE length(word) <> length(other) AND (SELECT count(*) FROM cut c WHERE c.word = CASE WHEN length(pairs.word) > length(other) THEN pairs.word ELSE other END AND c.part = CASE WHEN length(pairs.word) > length(other) THEN other ELSE pairs.word END) > 0
    OR length(word) = length(other) AND len(list_filter(range(1, length(word) + 1), lambda i: substr(pairs.word, i::INT, 1) <> substr(other, i::INT, 1))) = 1 GROUP BY word, n),
form AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN m >= 2 * n THEN best END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM near),
chain AS (SELECT word, form AS root FROM form WHERE form IS NOT NULL UNION ALL SELECT chain.word, f.form FROM chain JOIN form f ON f.word = chain.root WHERE f.form IS NOT NULL),
last AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form WHERE form IS NOT NULL))
SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, w.word) AS root FROM w LEFT JOIN form USING (word) LEFT JOIN last USING (word)
"""
