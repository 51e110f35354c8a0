"""Filter interaction audit: what each filter removes in every order of application, by inclusion-exclusion.

Each text gets one flag (0 or 1) for each filter it fails. For every subset S of the filters the joint-failure count N(S) is
the sum of the product of S's flags, for all documents, for those of good quality and for toxic ones; all of these come from
one aggregation by part with partial sums before the shuffle. What follows is arithmetic on 2**n numbers for each part:

* survivors of a set P are the alternating sum of N over P's subsets (Möbius inversion over subsets), so a filter i behind P
  removes survivors(P) - survivors(P + i), and the rest of N(i) is redundant there;
* the count of documents that fail exactly T is the alternating sum of N over T's supersets; unique failures are T = {i};
* the number of removed documents is a game of the filters whose Harsanyi dividends are (-1)**(|T| + 1) N(T); a filter's
  Shapley value shares each dividend equally, and n! times that is what it removes summed over all orders.

Copies are found by the SHA-256 of the texts: the smallest id of each digest is worked out with partial minima and joined
back by digest and id, so a text that a third of all rows hold is no hot key.

Defined results: a null text is an empty one; a null source is the part of the empty string; a row without id has no smaller
id's text and lends its text to none; repeated rows count each, and those of the smallest id of a text are all originals;
labels of one id are 1 if any row says 1; ids without label are neither good nor toxic; texts are read whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch
from .text import Words, column_bytes, slices, tidy

#: Fixed values of the contract.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
MARKS = "#$%&*|"
#: The documents counted: all, those of good quality, toxic ones.
WEIGHTS = ("all", "good", "toxic")


def text_flags(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Failures of A to D for each text of a slice."""
    w = Words(buf, offs)
    n_words = np.diff(w.at)
    distinct = np.zeros(len(n_words), np.int64)
    if len(w):
        h, doc = w.hashes(), w.docs()
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        distinct = np.bincount(doc[new], minlength=len(n_words))

    def count(hit: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(hit))[offs])

    marks = np.zeros(256, bool)
    marks[[ord(c) for c in MARKS]] = True
    points = count((buf & 0xC0) != 0x80)
    return [
        n_words < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * n_words,
        100 * count((buf >= 65) & (buf <= 90)) > MAX_CAPITAL_PERCENT * points,
        count(marks[buf]) > 0,
    ]


def failures(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, part and the flags a to e (0 or 1) of each row of documents."""
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "part", "digest", *"abcd"]

    def run(batches):
        for batch in batches:
            for x in slices(batch):
                buf, offs = column_bytes(x.column(2))
                raw = memoryview(buf.tobytes())
                digest = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                flags = [pa.array(f.astype(np.int32), pa.int32()) for f in text_flags(buf, offs)]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(digest, pa.binary()), *flags], names)

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = scratch.keep(rows.mapInArrow(tidy(run), f"doc_id {kind}, part string, digest binary, a int, b int, c int, d int"), "flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    found = rows.join(first, (rows["digest"] == first["digest"]) & (rows["doc_id"] == first["first"]), "left")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return found.select("doc_id", "part", *"abcd", later.cast("int").alias("e"))


def label_flags(labels: DataFrame) -> DataFrame:
    """doc_id, good and toxic (0 or 1), one row for each id."""
    is_one = lambda c: F.max(F.coalesce((F.col(c).cast("int") == 1).cast("int"), F.lit(0)))
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def joint_failures(rows: DataFrame, flags: list[str], weights: list[str]) -> DataFrame:
    """part and counts: for each weight (1, then the 0/1 columns given) the counts N(S) of all subsets S of the flags, S as the bits of
    its place. One aggregation; each S is the product of a smaller set and one more flag."""
    product = [F.lit(1)]
    for k, flag in enumerate(flags):
        product += [p * F.col(flag) if s else F.col(flag) for s, p in enumerate(product[: 1 << k])]
    sets = range(1 << len(flags))
    rows = rows.select("part", *weights, *[product[s].alias(f"s{s}") for s in sets])
    sums = [F.sum(F.col(f"s{s}") * w).cast("long") for w in (F.lit(1), *map(F.col, weights)) for s in sets]
    return rows.groupBy("part").agg(F.array(*sums).alias("counts"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """For each set P the documents that fail none of P: Möbius inversion over subsets along the last axis."""
    out = counts.copy()
    for i in range(out.shape[-1].bit_length() - 1):
        has = np.flatnonzero(np.arange(out.shape[-1]) >> i & 1)
        out[..., has] = out[..., has ^ (1 << i)] - out[..., has]
    return out


def exactly(counts: np.ndarray) -> np.ndarray:
    """For each set T the documents that fail T and nothing else: Möbius inversion over supersets along the last axis."""
    out = counts.copy()
    for i in range(out.shape[-1].bit_length() - 1):
        has = np.flatnonzero(np.arange(out.shape[-1]) >> i & 1)
        out[..., has ^ (1 << i)] -= out[..., has]
    return out


def shapley_sums(counts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each filter n! times its Shapley value: its equal shares of the dividends of all sets that hold it."""
    size = np.array([s.bit_count() for s in range(1 << n)])
    share = np.array([0, *[math.factorial(n) // int(k) for k in size[1:]]])
    dividends = np.where(size % 2 == 1, 1, -1) * counts * share
    return [dividends[..., np.arange(1 << n) >> i & 1 == 1].sum(-1) for i in range(n)]


def effects(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the joint-failure counts of WEIGHTS."""
    n = len(filters)
    orders = list(itertools.permutations(range(n)))
    names = ["".join(filters[i] for i in order) for order in orders for _ in order]
    before = np.array([sum(1 << j for j in order[:k]) for order in orders for k in range(n)])
    own = np.array([i for order in orders for i in order])
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                joint = np.array(found, np.int64).reshape(len(WEIGHTS), 1 << n)
                left = survivors(joint)
                removed = left[:, before] - left[:, before | 1 << own]
                values = [left[0, before | 1 << own], removed[0], joint[0, 1 << own] - removed[0], exactly(joint[0])[1 << own], removed[1], removed[2], np.array(shapley_sums(joint[0], n))[own]]
                steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array(names), pa.array(steps), *map(pa.array, values)], columns)

    return counts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(c + ' long' for c in columns[3:])}")


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """What each filter removes, in each order, for each source; `effects` has the columns."""
    rows = failures(docs, scratch).join(label_flags(labels), "doc_id", "left")
    rows = rows.select("part", *"abcde", *[F.coalesce(c, F.lit(0)).alias(c) for c in WEIGHTS[1:]])
    return effects(joint_failures(rows, list("abcde"), list(WEIGHTS[1:])))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The filters applied in every order to the documents of each set of failures.
OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
letter AS (SELECT substr('ABCDE', i + 1, 1) AS c, (1 << i)::INT AS bit FROM range(0, 5) AS r(i)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT o, s::INT AS step, bit AS own, coalesce((SELECT sum(bit) FROM letter WHERE instr(substr(o, 1, s - 1), c) > 0), 0)::INT AS before
  FROM orders, range(1, 6) AS r(s), letter WHERE c = substr(o, s, 1)),
e AS (SELECT part, o AS filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM m, steps GROUP BY part, o, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM e
"""
