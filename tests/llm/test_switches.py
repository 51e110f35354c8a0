"""The other side of every switch by size gives the same results; odd ids and labels."""

import base64
import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from codexa.llm import bpe, jaccard, lines, mixing, toxicity, training_order, warc
from codexa.llm.sampling import training_labels
from codexa.llm.store import Scratch

SCHEMA = "doc_id long, text string, source string"
BASE = " ".join(f"w{k}" for k in range(40))


def same(a, b):
    return collections.Counter(map(repr, a.collect())) == collections.Counter(map(repr, b.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [BASE, BASE, BASE + " tail", BASE.replace("w7 ", "x7 "), "shared line here\n" + BASE[::-1], None, "", "short text", "shared line here\nown words", "a b c d e f g " * 30]
    rows = [(k if k % 9 else None, texts[k % len(texts)], f"s{k % 3}" if k % 4 else None) for k in range(90)]
    return spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(3)


def test_mixing_joins_rates(docs, monkeypatch):
    want = mixing.mix(docs)
    want.collect()
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert same(mixing.mix(docs), want)


def test_lines_join_repeated_rows(docs, monkeypatch):
    want = lines.judge(docs).collect()
    monkeypatch.setattr(lines, "MAX_BROADCAST", 0)
    assert collections.Counter(map(repr, lines.judge(docs).collect())) == collections.Counter(map(repr, want)) and any(r.n_removed_words for r in want)


def test_jaccard_joins_keys_and_raises_the_bar(docs, monkeypatch):
    want = jaccard.join_documents(docs).collect()
    monkeypatch.setattr(jaccard, "MAX_BROADCAST", 0)
    monkeypatch.setattr(jaccard, "MAX_COMMON", 3)
    assert collections.Counter(map(repr, jaccard.join_documents(docs).collect())) == collections.Counter(map(repr, want))
    assert len({r.component_id for r in want}) < len(want)


def test_training_order_joins_numbers(docs, monkeypatch, spark):
    def shards():
        scratch = Scratch(spark)
        folder = scratch.path("shards")
        index = training_order.write(docs, folder, length=64, shard_bytes=640, scratch=scratch)
        raw = {s: t.tobytes() for s, t in training_order.read(folder)}
        return sorted(raw), collections.Counter(raw[r.slot] for r in index.collect())

    want = shards()
    monkeypatch.setattr(training_order, "MAX_BROADCAST", 0)
    assert shards() == want


def test_bpe_table_starts_again(docs, monkeypatch):
    want = bpe.digests(docs).collect()
    path = bpe.default_path()
    monkeypatch.setattr(bpe, "MAX_ARCS", 40)
    monkeypatch.setattr(bpe, "_automata", {})
    enc = bpe.Encoder(path, max_words=30)
    import pyarrow as pa

    texts = [r.text for r in docs.select("text").collect()]
    ids, at, *_ = enc.encode(pa.array(texts, pa.string()))
    found = collections.Counter(hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest() for a, b in zip(at[:-1], at[1:]))
    assert found == collections.Counter(r.ids_sha256 for r in want) and enc.auto.arcs.transitions.used <= 40


def test_labels_that_clash(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (2, 0, None), (None, 1, 1), (3, 7, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    known = {r.doc_id: r.y for r in training_labels(labels, "quality", 5, 9).collect()}
    assert known == {1: 1, 2: 0, 5: 0}  # a 1 wins; other values and null ids teach nothing


def test_toxicity_without_other_text(spark):
    texts = [f"you idiot clown number {k}" for k in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "x"), (0, None)], "doc_id long, text string")
    all_toxic = spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, toxic int")
    found = toxicity.score(rows, toxicity.fit(rows, all_toxic)).collect()
    assert len(found) == 14 and all(0 <= r.score <= 1 for r in found)
    none = toxicity.score(rows, toxicity.fit(rows, all_toxic.where("false"))).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_learns_from_unlabelled_text(spark):
    """Words of unlabelled documents count as text of the population, though no label names them."""
    rows = [(k, "vile slur " + f"word{k % 7} plain talk") if k % 10 == 0 else (k, f"word{k % 7} plain talk of day {k % 13}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(0, 400, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.prior == pytest.approx(0.2, abs=0.05)  # among labelled ones, of which every fifth is toxic
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(s for k, s in found.items() if k % 10 == 0) > 0.5 > max(s for k, s in found.items() if k % 10)


def test_warc_rows_without_id(spark):
    pages = spark.createDataFrame([(None, "u", "same"), (3, "u", "same"), (None, "v", "alone"), (4, None, None)], "page_id long, url string, html string")
    scratch = Scratch(spark)
    folder = scratch.path("warc")
    index = scratch.keep(warc.write(warc.first_of_equal(pages, scratch), folder, archive_bytes=300), "index")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(index, folder).collect())
    assert sum(got.values()) == 4 and got[3, 4, "response", None] == 1 and got[4, 0, "response", None] == 1
    digest = base64.b32encode(hashlib.sha1(b"alone").digest()).decode()
    assert index.where(F.col("page_id").isNull()).count() == 2 and any(r.payload_digest == digest for r in warc.read(index, folder).collect())
