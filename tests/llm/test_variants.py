"""Spelling variants against comparisons of all words."""

import collections
import random
import re
import string
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from codexa.llm import variants

SCHEMA = "doc_id long, text string, word string, n int"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def counted(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def result(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = variants.group(docs).collect()
    assert len({r.word for r in found}) == len(found)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}


def word_rows(words, times):
    return [(i, f"{w} ; {w.upper() if w.isascii() else w}|{w}") for i, w in enumerate(w for w in words for _ in range(times(w)))]


def test_variants_of_edited_words(spark):
    rnd = random.Random(3)
    letters = string.ascii_lowercase[:8] + "éßàÿ×"
    words = set()
    for _ in range(40):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 12)))
        words.add(w)
        for _ in range(rnd.randrange(8)):
            k, c = rnd.randrange(len(w)), rnd.choice(letters)
            w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words.add(w)
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "z" * 700, "z" * 701, "z" * 699 + "y"}
    rows = word_rows(sorted(words), lambda w: 1 + zlib.crc32(w.encode()) % 7)
    assert result(spark, rows) == by_hand(rows)


def test_variants_edge_rows(spark):
    rows = [(None, "letters " * 5), (None, None), (1, ""), (1, "Letters letters LETTERS"), (1, "Letters letters LETTERS"), (2, "Élite élite élite"), (3, "a1b2 co-op naïve_naïve naïve"), (4, "letterz " * 3), (5, "lettery " * 3)]
    rows += [(i, "chain " * 3 + "chains " * 7 + "chainsa " * 15 + "chainsab " * 31) for i in range(6, 10)]
    assert result(spark, rows) == by_hand(rows)
    assert result(spark, []) == {}


def test_ties_go_to_the_smaller_word(spark):
    rows = [(i, "trialb " * 8 + "triala " * 8 + "trial " * 3 + "trialé " * 8) for i in range(3)]
    got = result(spark, rows)
    assert got == by_hand(rows) and got["trial"][2] == "triala"


def test_typos_by_crc(spark):
    rows = [(i, "conversation " * 2 + "straße") for i in range(2000)]
    n = counted(rows)
    assert len(n) > 2 and {r.word: r.n for r in variants.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == n


def test_counts_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(variants, "MAX_HELD", 3)
    rows = [(i, f"alpha beta{'abcdefg'[i % 7]} gamma delta{'hijkl'[i % 5]} epsilon") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in variants.vocabulary(frame).collect()} == counted(rows)


def test_continued_crc_equals_zlib():
    rnd = np.random.default_rng(5)
    buf = rnd.integers(0, 256, 4000).astype(np.uint8)
    starts = np.sort(rnd.choice(3000, 200, replace=False))
    lens = rnd.integers(0, 90, 200)
    before = rnd.integers(0, 1 << 32, 200).astype(np.uint32)
    want = [zlib.crc32(buf[s : s + k].tobytes(), int(b)) for s, k, b in zip(starts, lens, before)]
    assert variants.continued_crc(buf, starts, lens, before).tolist() == want


def test_one_edit_keeps_a_band(spark):
    rnd = random.Random(9)
    letters = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
    rows = []
    for _ in range(300):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 15)))
        k, c = rnd.randrange(len(w)), rnd.choice(letters)
        rows += [(w, v) for v in (w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :])]
    found = spark.createDataFrame(rows, "a string, b string").select(variants.parity_mask(F.col("a")).alias("a"), variants.parity_mask(F.col("b")).alias("b")).collect()
    for a, b in found:
        assert (a ^ b).bit_count() <= 2 and any((a ^ b) & variants.band_bits(k) == 0 for k in range(3))
    assert sum(variants.band_bits(k) for k in range(3)) == (1 << 63) - 1


def test_variants_equal_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["monday mondays mondai", "Monday MONDAY mondays", "mondáy mondáy mondáy", None, "", "tuesday tuesday"] * 20)] + [(None, "monday tuesdays")] * 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT word, n, n_near, form, form_n, root FROM ({variants.OP12_SQL})").fetchall()}
    assert want == by_hand(rows) == result(spark, rows)
