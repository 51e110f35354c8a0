"""Recursive BPE against the library, on words of all lengths, and round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from codexa.llm import recursive_bpe


def encoding(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return encoding(recursive_bpe.default_path())


def texts():
    rnd = random.Random(2)
    out = [None, "", " ", "a", "it's DON'T we'LL 's", "<|endoftext|>", "日本語 " * 50, " x   y \r\n\n z  ", "½ ٣٤ 12 3.5", "👨‍👩‍👧 é é \u0000 �"]
    out += ["=" * 900 + " " * 333 + "x", "a" * 5000, "ab" * 700 + "aab" * 300, "abcabcab" * 100]
    out += ["".join(rnd.choice("aab") for _ in range(rnd.randrange(65, 700))) for _ in range(20)]
    out += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(60, 900))) for _ in range(10)]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x600), rnd.randrange(0x4E00, 0x5000), 32, 39, 10])) for _ in range(200)) for _ in range(30)]
    return out


def test_encoder_equals_library(library):
    enc = recursive_bpe.Encoder(recursive_bpe.default_path())
    given = texts()
    for _ in range(2):  # from the queries, then from what is kept
        ids, at, back, in_text = enc.encode(pa.array(given, pa.string()))
        for k, t in enumerate(given):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(t or "")
            assert back[in_text[k] : in_text[k + 1]].tobytes() == (t or "").encode()


def test_encoder_with_other_ranks_and_long_words():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc, library = recursive_bpe.Encoder(path), encoding(path)
    rnd = random.Random(8)
    given = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(20_000)), *texts()]
    ids, at, _, _ = enc.encode(pa.array(given, pa.string()))
    for k, t in enumerate(given):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(t or "")


def test_ranks_that_no_training_gives(tmp_path):
    """Pairs of a merged token may have lower ranks than it, words may be tokens that no merges lead to."""
    rnd = random.Random(6)
    for trial in range(6):
        tokens = [bytes([b]) for b in range(256)]
        made = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 6))).encode() for _ in range(30)}
        made = sorted(made, key=lambda _: rnd.random())
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens + made)))
        enc, library = recursive_bpe.Encoder(str(path)), encoding(path)
        given = ["".join(rnd.choice("aab") for _ in range(n)) for n in (*range(1, 60), 65, 70, 99, 150, 400, 3000)]
        ids, at, _, _ = enc.encode(pa.array(given, pa.string()))
        for k, t in enumerate(given):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(t), (trial, t)


def test_words_of_one_hash(library, monkeypatch):
    monkeypatch.setattr(recursive_bpe, "run_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    enc = recursive_bpe.Encoder(recursive_bpe.default_path())
    for given in (["cat dog cow"], ["hen cat ox", "a bc", "d"]):
        ids, at, back, _ = enc.encode(pa.array(given))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode_ordinary(t) for t in given]
        assert back.tobytes() == "".join(given).encode()


def test_full_store_starts_again(library):
    enc = recursive_bpe.Encoder(recursive_bpe.default_path(), max_words=20)
    for k in range(5):
        given = [" ".join(f"word{k}{j}" for j in range(12)), " ".join(f"more{j}" for j in range(40))]
        ids, at, _, _ = enc.encode(pa.array(given))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode_ordinary(t) for t in given]


def test_digests(spark, library, monkeypatch):
    monkeypatch.setattr(recursive_bpe, "SLICE", 500)  # some texts are longer than a slice
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts())] + [(3, "a", "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, w int").repartition(3)
    got = sorted(map(tuple, recursive_bpe.digests(docs).collect()), key=repr)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert got == sorted(want, key=repr)
    assert recursive_bpe.digests(docs.limit(0)).count() == 0


def test_columns(spark, library):
    rows = [(i, t, [9], "own") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, pos string")
    encoded = recursive_bpe.encode_column(docs)
    assert encoded.columns == ["doc_id", "text", "pos", "ids"]
    for r in recursive_bpe.decode_column(encoded).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and r.decoded == (r.text or "") and r.pos == "own"
    odd = spark.createDataFrame([(1, None), (2, []), (3, [library.encode_ordinary("é")[0]] if len(library.encode_ordinary("é")) == 1 else [200])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in recursive_bpe.decode_column(odd).collect()}
    assert got[1] is None and got[2] == "" and got[3]
