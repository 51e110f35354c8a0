"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, and clashing names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import bpe, jaccard, lines, mixing, quality, queries, telephony, toxicity, training_order, urlfilter, warc
from codexa.llm.store import Scratch

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h long"
BASE = " ".join(f"w{i}" for i in range(60))


def rows_of_texts():
    texts = [BASE, BASE, BASE.upper(), BASE.replace("w3 ", "x3 "), BASE.replace("w57", "y"), BASE + " tail", "one two", "One  two", "one two three four five", "", None, " \n\t", "é 日本語 😀 " * 3, "a\n b \na\n\nA\na", "x " * 3000, "# $ <|endoftext|> 's don't", "\u00a0nbsp\u00a0word", "idiot clown " + BASE]
    return [(i, t, "en", f"s{i % 2}" if i % 5 else None, None if t is None else len(t), "s", 1) for i, t in enumerate(texts)] + [(0, BASE, "en", None, 1, "s", 1), (None, BASE, "en", "s1", 1, "s", 1), (None, "", "en", "s1", 1, "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_texts(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    low = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(low[i : i + 5]) for i in range(len(low) - 4)} if len(low) >= 5 else {tuple(low)} if low else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and comp[i] != comp[j] and 100 * len(a & b) >= 80 * len(a | b):
                    x, y = comp[i], comp[j]
                    comp = [min(x, y) if c in (x, y) else c for c in comp]
                    moved = True
    first = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        if d is not None:
            first[c] = min(first.get(c, d), d)
    return sorted(((d, len(s), first.get(c)) for (d, _), s, c in zip(rows, sets, comp, strict=True)), key=str)


def near_copies(n, seed):
    r = random.Random(seed)
    base = [f"b{i}" for i in range(80)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            w[r.randrange(80)] = f"n{i}"
        out.append((i, " ".join(w) if i % 3 else " ".join(f"u{i}{k}" for k in range(40)) + " " + " ".join(base[:30])))
    return out


def test_jaccard_components(spark, docs):
    got = sorted(map(tuple, jaccard.join_documents(docs).collect()), key=str)
    assert got == brute_components([(r[0], r[1]) for r in rows_of_texts()])


def test_jaccard_large_groups_and_shared_passages(spark):
    rows = near_copies(90, 1)
    got = sorted(map(tuple, jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=str)
    assert got == brute_components(rows)


def test_components_by_propagation(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame(edges, "a long, b long")
    for limit in (0, 1000):
        got = dict(map(tuple, jaccard.components(df, Scratch(spark), limit).collect()))
        near = collections.defaultdict(set)
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        for node in near:
            seen, todo = {node}, [node]
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            assert got[node] == min(seen)


def incidence_components(rows):
    """`brute_components` by one product of the whole incidence matrix."""
    sets = [shingles(t) for _, t in rows]
    column = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[x] for x in s]] = 1
    both = m @ m.T
    n = m.sum(1)
    link = (100 * both >= 80 * (n[:, None] + n[None, :] - both)) & (both > 0)
    comp = np.arange(len(rows))
    while True:
        low = np.where(link, comp[None, :], len(rows)).min(1)
        low = np.minimum(low, comp)
        if (low == comp).all():
            break
        comp = low[low]
    first = {c: min(rows[i][0] for i in np.flatnonzero(comp == c)) for c in set(comp.tolist())}
    return sorted((d, len(s), first[c]) for (d, _), s, c in zip(rows, sets, comp.tolist(), strict=True))


def dissimilar_copies(n, seed, words=120):
    """Copies of one text in groups: edits in the text's words tell the groups apart, and few more the copies of a group.
    Edits come from a small pool, so that most shingles are shared by some."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in random.Random(i % 41).sample(range(words), 4):
            w[k] = f"g{k % 7}"
        for k in r.sample(range(words), r.choice((0, 1, 1, 2))):
            w[k] = f"n{r.randrange(9)}"
        out.append((i, " ".join(w)))
    return out


def test_jaccard_dissimilar_near_copies(spark, monkeypatch):
    rows = dissimilar_copies(2000, 4) + [(2000 + i, f"own{i} " * 9) for i in range(9)]
    want = incidence_components(rows)
    assert 2 < len({c for *_, c in want if c < 2000}) < 1500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made, keep = {}, Scratch.keep

    def counted(self, df, name="table", level=3):
        out = keep(self, df, name, level)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    assert sorted(map(tuple, jaccard.join_documents(df).collect())) == want
    assert made["pairs"] < 20_000 and made["more"] < 20_000 and 0 < made["joining"] < 2000


def test_jaccard_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_CLASSES", 40)
    monkeypatch.setattr(jaccard, "PAIRS", 0)
    monkeypatch.setattr(jaccard, "CELLS", 500)
    monkeypatch.setattr(jaccard, "DENSE", 5)
    rows = dissimilar_copies(300, 5)
    got = sorted(map(tuple, jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == incidence_components(rows)


def test_overlaps_and_forest():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64) for _ in range(70)]
    sizes = np.array([len(x) for x in sets])
    for dense, cells in ((1, 40), (1000, 40), (6, 10**6)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(jaccard, "DENSE", dense)
            m.setattr(jaccard, "CELLS", cells)
            got = {(int(i), int(j)) for a, b in jaccard.overlaps(sets, sets[:50], sizes, sizes[:50]) for i, j in zip(a, b, strict=True)}
        want = {(i, j) for i in range(70) for j in range(50) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (sizes[i] + sizes[j] - c)}
        assert got == want
    a, b = r.integers(0, 500, 400), r.integers(0, 500, 400)
    parent = np.arange(500)
    k = jaccard.forest(a, b, parent)
    again = np.arange(500)
    jaccard.forest(a[k], b[k], again)
    assert (again == parent).all() and len(k) == 500 - len(np.unique(parent)) and (parent[a] == parent[b]).all()


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 400, r.integers(1, 400))) for _ in range(2))
        a, b = (jaccard.mix(x.astype(np.uint64)) for x in (a, b))
        assert jaccard.odd_bits(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))
    a = jaccard.mix(np.arange(1000, dtype=np.uint64))
    assert jaccard.odd_bits(jaccard.sketch(a), jaccard.sketch(a[:700])) > 170 and jaccard.odd_bits(jaccard.sketch(a), jaccard.sketch(a)) == 0


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_words_of_one_polynomial_hash(spark):
    """Words, and lines of words, that every polynomial modulo a power of two maps to one value."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    for x, y in (thue_morse(10), thue_morse(12)):
        df = spark.createDataFrame([(1, x), (2, y), (3, f"{x} {y}")], "doc_id long, text string")
        for r in bpe.encode_column(df.coalesce(1)).collect():
            assert list(r.ids) == t.encode(r.text, add_special_tokens=False).ids
        rows = [(1, f"one two three four {x}"), (2, f"one two three four {y}"), (3, f"one two three four {y}")]
        got = {d: c for d, _, c in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
        assert got == {1: 1, 2: 2, 3: 2}
        rows = [(1, f"{x}\n{y}\n{x}", "s"), (2, f"{' '.join(x)}\n{' '.join(y)}", "s")]
        got = {r.doc_id: r.n_dup_lines for r in lines.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert got == {1: 1, 2: 0}
        w = lines.Words(*bpe.column_bytes(lines.pa.array([" ".join(x) + "\n" + " ".join(y)])))
        assert len(set(lines.line_hashes(w, w.prefix_sums())[1].tolist())) == 2


def test_bpe_table_equals_the_written_automaton():
    r = random.Random(7)
    for _ in range(30):
        n_bytes = 3
        labels = {bytes([b]): b for b in range(n_bytes)}
        merges = []
        while len(merges) < 9:
            a, b = r.choice(list(labels)), r.choice(list(labels))
            if a + b not in labels and (labels[a], labels[b]) not in [m[:2] for m in merges]:
                labels[a + b] = len(labels)
                merges.append((labels[a], labels[b], labels[a + b]))
        n = len(labels)
        whole = bpe.written_out(n_bytes, merges)
        x, y = (a.reshape(-1) for a in np.meshgrid(np.arange(n), np.arange(n)))
        gadgets = bpe.Gadgets(n, merges)
        assert gadgets.compile(x, y).tolist() == [whole[a].get(b, bpe.NO_ARC) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert gadgets.steps(x, y).tolist() == gadgets.steps(x, y).tolist() == gadgets.compile(x, y).tolist()


def test_jaccard_near_copies_without_id(spark):
    far = " ".join(f"v{i}" for i in range(60))
    texts = [(1, BASE), (None, BASE.replace("w57", "y")), (None, far + " left"), (None, far + " right"), (4, " ".join(far.split()[6:])), (5, " ".join(far.split()[:54])), (None, "one of its own without any id")]
    got = sorted(map(tuple, jaccard.join_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == brute_components(texts) and [c for *_, c in got].count(4) == 4


def test_jaccard_empty_and_keep_one(spark, docs, empty):
    assert jaccard.join_documents(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 9 in ids and 10 in ids


def test_keep_one_by_row(spark):
    far, own = (" ".join(f"{c}{i}" for i in range(60)) for c in "vo")
    rows = [(1, BASE), (2, BASE + " tail"), (2, far), (3, far + " tail"), (4, own), (4, own), (4, ""), (None, BASE), (None, "without id " + " ".join(own.split()[::2])), (None, "without id " + " ".join(own.split()[::2]))]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[6], rows[8]], key=str)


def test_bpe_equals_library(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    r = random.Random(3)
    pool = ["'s", "'ll", " ", "  ", "\n", "a", "the", "é", "x1", "½", "!", "'", "<|endoftext|>", "日本", "😀", "\u00a0", "aaaa", "\t", "Re"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(400)] + [x[1] or "" for x in rows_of_texts()] + ["a" * 5000, "=" * 777]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    found = bpe.decode_column(bpe.encode_column(df)).collect()
    for x in found:
        want = t.encode(x.text, add_special_tokens=False).ids
        assert list(x.ids) == want, repr(x.text)
        assert x.decoded == t.decode(want, skip_special_tokens=False)
    for x in bpe.digests(docs).collect():
        if x.doc_id in (10, 15):
            text = dict((a, b) for a, b, *_ in rows_of_texts()[:18])[x.doc_id] or ""
            ids = t.encode(text, add_special_tokens=False).ids
            assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert bpe.digests(empty).count() == 0


def test_lines_measures(docs, empty):
    want = []
    for d, t, *_ in rows_of_texts():
        w, t = words_of(t), t or ""
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(win)
        cover = {k for i, x in enumerate(win) if n[x] > 1 for k in range(i, i + 5)}
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    got = [tuple(r) for r in lines.judge(docs).select("doc_id", *lines.COUNTS, "base_failed").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lines.judge(empty).count() == 0


def test_lines_across_documents(spark):
    own = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    common = own("s", 20)
    rows = [(i, f"Shared  line {common}\n{own(i, 30 if i % 2 else 4)}", "a" if i < 8 else "b") for i in range(12)] + [(20, f"Shared line {common} \n{own(1, 4)}", "a")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.lit(1))
    out = {r.doc_id: (r.kept, r.n_removed_words) for r in lines.judge(df, limit=5).collect()}
    assert out[0] == (False, 22) and out[1] == (True, 22) and out[9] == (True, 0) and out[10] == (True, 0) and out[20] == (False, 22)
    cleaned = {r.doc_id: r.text for r in lines.clean_texts(df, limit=5).collect()}
    assert cleaned[0] == own(0, 4) and cleaned[9] == rows[9][1]
    assert lines.clean_texts(df, limit=5).columns == df.columns


def test_lines_equal_sql(spark, docs, tmp_path):
    more = [(100 + i, "Menu  of all the pages that are here on this site now\n" + " ".join(f"own{i}x{k}" for k in range(3 + 9 * (i % 2))), "en", "s1", 1, "s", 1) for i in range(8)]
    df = docs.where("doc_id is not null").unionByName(spark.createDataFrame(more, SCHEMA))
    removed = []
    for data in (df, spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        con = duckdb.connect()
        con.register("documents", data.toPandas())
        got = lines.judge(data).collect()
        names = list(got[0].asDict())
        want = con.sql(lines.OP9_SQL).select(*names).fetchall()
        assert sorted(map(tuple, got)) == sorted(want)
        removed.append((sum(r.n_removed_words > 0 for r in got), sum(not r.kept and not r.base_failed for r in got)))
    assert removed[0][1] > 0 and removed[2][0] > 0


def test_lines_default_limit_rejects_in_small_hosts(spark, tmp_path):
    line = " ".join(f"menu{k}" for k in range(30))
    rows = [(i, f"{line}\nown{i} text{i} end{i}", "seven" if i < 7 else "six") for i in range(13)] + [(20, line, "one")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.base_failed, r.kept, r.n_removed_words) for r in queries.QUERIES["op9_quality_rules"](spark, str(tmp_path)).collect()}
    assert out == {i: (False, False, 30) if i < 7 else (False, True, 0) for i in [*range(13), 20]}


def test_lines_count_every_exact_copy(spark):
    text = " ".join(f"copied{k}" for k in range(30))
    rows = [(i, text, "copies") for i in range(7)] + [(30, text, "repeats")] * 9 + [(None, text, "no ids")] * 7
    out = lines.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.kept, r.n_removed_words) for r in out), key=str) == sorted([(i, False, 30) for i in range(7)] + [(30, True, 0)] * 9 + [(None, False, 30)] * 7, key=str)


def test_mixing_equals_sql(spark):
    df = queries.op6_mix_sources(spark, DATA).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(mixing.OP6_SQL).df()
    cols = sorted(df.columns)
    a, b = (x[cols].sort_values(["training_order", "doc_id"]).reset_index(drop=True).astype(str) for x in (df, want))
    assert a.equals(b)
    assert (df.training_order.diff().dropna() >= 0).all()


def test_mixing_high_rates_equal_sql(spark):
    rows = [(i, f"t{i}", "en", "few" if i < 3 else f"s{i % 90}", 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    for data in (df.where("doc_id < 3 or doc_id >= 800"), df):
        con.unregister("documents")
        con.register("documents", data.toPandas())
        got = sorted(map(tuple, mixing.mix(data).collect()))
        assert got == sorted(con.sql(mixing.OP6_SQL).fetchall())
    one = spark.createDataFrame([(1, "x", "en", "a", 1)] + [(i, "x", "en", f"b{i % 5}", 1) for i in range(2, 700)], df.schema)
    con.unregister("documents")
    con.register("documents", one.toPandas())
    got = sorted(map(tuple, mixing.mix(one).collect()))
    assert got == sorted(con.sql(mixing.OP6_SQL).fetchall()) and sum(r[0] == 1 for r in got) > 64


def test_mixing_rates_and_edges(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(docs, {"s0": 0.0}, size=3.0)
    assert out.columns[:-3] == docs.columns and out.where("source = 's0'").count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot").otherwise("cold").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(many, {}).groupBy("source").count().collect()}
    assert abs(n["hot"] - 2000) < 150 and abs(n["cold"] - 2000) < 150
    assert mixing.mix(many.limit(3), {}, size=60.0).count() > 120
    clash = mixing.mix(docs.withColumns({"Copy": F.lit(1), "training_order": F.lit("x"), "_parts": F.lit(2)}))
    assert clash.columns == [*docs.columns, "Copy", "training_order", "_parts", "_copy", "copies", "_training_order"]
    rows = clash.collect()
    assert {(r.Copy, r.training_order, r._parts) for r in rows} == {(1, "x", 2)} and len(rows) == mixing.mix(docs).count()
    order = [r.training_order for r in mixing.mix(docs).collect()]
    assert order == sorted(order)


def test_mixing_high_rates_are_poisson(spark):
    rows = spark.createDataFrame([(i, "s") for i in range(2000)], "doc_id long, source string")
    out = mixing.mix(rows, {}, size=200.0).toArrow()
    n = out.column("copies").to_numpy()[out.column("copy").to_numpy() == 0]
    assert len(n) == 2000 and abs(n.mean() - 200) < 2 and 170 < n.var() < 230


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        p = training_order.permute(np.arange(n), n, "k")
        assert sorted(p.tolist()) == list(range(n))
        assert (training_order.restore(p, n, "k") == np.arange(n)).all()
    assert (training_order.permute(np.arange(1000), 1000, "a") != training_order.permute(np.arange(1000), 1000, "b")).any()


def test_shards_hold_every_sequence(spark, docs, empty):
    scratch = Scratch(spark)
    folder = scratch.path("shards")
    index = training_order.write(docs, folder, length=64, shard_bytes=640, scratch=scratch)
    rows = index.collect()
    raw = {s: t.tobytes() for s, t in training_order.read(folder)}
    assert sorted(raw) == list(range(len(rows))) == sorted(r.slot for r in rows)
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.slot):
        found[r.doc_id].append((r.seq_no, raw[r.slot]))
    want = collections.Counter((d, (t or "").encode()) for d, t, *_ in rows_of_texts())
    for (d, t), n in want.items():
        full = t + b"\xfe"
        full += b"\xff" * (-len(full) % 64)
        for k in range(len(full) // 64):
            assert found[d].count((k, full[64 * k : 64 * k + 64])) >= n
    assert [s for s, _ in training_order.read(folder, start=17)] == list(range(17, len(rows)))
    assert training_order.check(index, folder, 64).where("n_tokens > 64").count() == 0
    assert training_order.write(empty, Scratch(spark).path("none")).count() == 0


def test_shards_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(training_order, "EQUAL_ROWS", 7)
    rows = [(1, "equal rows")] * 50 + [(2, "x" * 100)] * 3 + [(i, f"own {i}") for i in range(3, 30)]
    scratch = Scratch(spark)
    folder = scratch.path("equal")
    index = training_order.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, length=64, shard_bytes=640, scratch=scratch)
    raw = dict(training_order.read(folder))
    found = collections.Counter((r.doc_id, r.seq_no, raw[r.slot].tobytes().split(b"\xfe")[0].rstrip(b"\xff")) for r in index.collect())
    want = collections.Counter((d, k, t.encode()[64 * k : 64 * k + 64]) for d, t in rows for k in range(len(t) // 64 + 1))
    assert found == want and sorted(raw) == list(range(sum(want.values())))
    assert training_order.check(index, folder, 64).count() == len(raw)


def test_url_rules(spark):
    urls = ["http://a.COM/en/1?x", "https://example.com/en/70#t", "x.example.com/en/7", None, "ftp://com/en/", "http://notexample.com/en/7", "http://b.net/de/8", "http://w.example.net/de/81", "http://org?/es/", "http://q.org/es/", "://org/es/", "a://b://org/es/", "http:///en/", ""]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[1])], "page_id long, url string").withColumn("host", F.lit("clash"))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    key = lambda r: str(tuple(None if v != v else v for v in r))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted((key(r) for r in urlfilter.judge(pages).select(cols).collect()))
    assert got == sorted(key(r) for r in con.sql(urlfilter.OP3_SQL).select(*cols).fetchall())
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    """The contract's list, written out: rules of both verdicts in each of the nested pairs."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://w.example.com/en/8": ("com/en/", "block"),
        "http://b.net/de/8": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://w.example.net/de/81": ("example.net/de/8", "block"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://q.org/es/": ("org/es/", "block"), "http://q.org/en/": (None, "allow"),
    }
    rows = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(rows).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit("\n/p")).alias("key"))
    listed = [f"h{i}\n/p" for i in range(0, 20000, 37)]
    cascade = urlfilter.build(keys, listed)
    import pyarrow as pa

    has = cascade.has(urlfilter.key_hashes(pa.array([r.key for r in keys.collect()])))
    assert has.sum() == len(listed) and len(cascade.levels) > 1
    assert {r.key for r, x in zip(keys.collect(), has, strict=True) if x} == set(listed)


def reference_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_telephony_decoders():
    assert [int(telephony.MULAW[i]) for i in (0, 127, 128, 255, 1)] == [-32124, 0, 32124, 0, -31100]
    assert [int(telephony.ALAW[i]) for i in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    blocks = np.random.default_rng(1).integers(0, 256, (7, 40), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [reference_adpcm(b.tobytes()) for b in blocks]
    assert telephony.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert telephony.resample(np.array([0, 2, 4, 8, -6, -8, 5], np.int16), 8000, 4000).tolist() == [1, 6, -7]
    x = np.random.default_rng(3).integers(-32768, 32768, 100)
    fine = np.repeat(x, 3)[:296].reshape(-1, 8).mean(1)
    assert telephony.resample(x.astype(np.int16), 8000, 3000).tolist() == np.floor(fine).astype(int).tolist()
    assert telephony.resample(np.array([0, 9], np.int16), 8000, 24000).tolist() == [0, 3, 6, 9, 9, 9]


def test_telephony_round_trip(spark, docs, empty):
    out = telephony.describe(telephony.store_texts(docs)).collect()
    texts = {d: t for d, t, *_ in rows_of_texts() if d is not None}
    for r in out:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        full = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
        media = telephony.wav(full, telephony.codec_of(full))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(full[-32:]), len(media), hashlib.sha256(media).hexdigest())
    assert len({r.feature for r in out if r.doc_id in (0, 1)}) == 1 and len(out) == docs.count()
    pcm = telephony.decode_column(telephony.store_texts(docs).withColumn("pcm", F.lit(1))).select("media", "pcm").first()
    codec, rate, data = telephony.parse(pcm.media)
    assert len(pcm.pcm) == 2 * (len(telephony.expand([(codec, rate, data)])[0]) // 4)
    assert telephony.describe(telephony.store_texts(empty)).count() == 0
    with pytest.raises(ValueError):
        telephony.parse(b"RIFFxxxxWAVEfmt ")


def test_telephony_query_stores_pcm(spark, docs, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="table", level=3, keep=Scratch.keep: kept.append(keep(self, df, name, level)) or kept[-1])
    docs.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    features = {r.doc_id: r.feature.split(":") for r in queries.QUERIES["op4_telephony"](spark, str(tmp_path)).collect()}
    stored = {r.doc_id: (r.media, r.pcm) for t in kept if "pcm" in t.columns for r in t.collect()}
    assert set(stored) == set(features) and len(stored) > 10
    for d, (media, pcm) in stored.items():
        codec, rate, data = telephony.parse(media)
        want = telephony.resample(telephony.expand([(codec, rate, data)])[0], rate, telephony.TARGET_RATE).astype("<i2").tobytes()
        assert pcm == want and features[d][0] == codec and int(features[d][2]) == len(pcm) // 2 and int(features[d][5], 16) == zlib.crc32(pcm)


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 70000, "<p>a</p>", "b\r\n\r\nc"]
    rows = [(i, None if i == 3 else f"http://h/{i}\r\n%", h) for i, h in enumerate(html)] + [(0, "u", "<p>a</p>"), (None, "n", "b\r\n\r\nc")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    scratch = Scratch(spark)
    folder = scratch.path("warc")
    index = scratch.keep(warc.write(warc.first_of_equal(pages, scratch), folder, archive_bytes=300), "index")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index, folder).collect() if r.page_id is not None}
    first = {}
    for i, h in enumerate(html):
        p = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        j = first.setdefault(p, i)
        assert got[i] == (len(p), digest, "response" if j == i else "revisit", None if j == i else j)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 1
    one = index.where("page_id = 5")
    assert [r.refers_to for r in warc.read(one, folder).collect()] == [0]
    assert warc.read(index.limit(0), folder).count() == 0
    assert warc.ranges([(0, 5), (5, 5), (1 << 20, 3)]) == [(0, 10, [0, 1]), (1 << 20, (1 << 20) + 3, [2])]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, docs, empty, module, label):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = module.fit(*table)
    rows = module.score(table[0], model).join(table[1], "doc_id").where("held_out").select(F.col(label).alias("y"), "predicted", "score").collect()
    right = sum(r.y == r.predicted for r in rows) / len(rows)
    assert right > (0.93 if label == "toxic" else 0.98) and all(0 <= r.score <= 1 for r in rows)
    out = module.score(docs, model).collect()
    assert len(out) == docs.count() and all(r.score is not None for r in out)
    same = {r.score for r in out if r.doc_id in (0, 1)}
    assert len(same) == 1 and not any(r.held_out for r in out if r.doc_id is None)
    assert module.score(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(docs, module.fit(docs, none)).collect()} == {0.0 if label == "toxic" else 1.0}
    kept = (toxicity.keep_clean if label == "toxic" else quality.keep_good)(docs, model)
    assert kept.schema == docs.schema


def test_risk_gradient_by_differences():
    r = np.random.default_rng(5)
    signs = set()
    for spread in (0.3, 4.0):
        for _ in range(10):
            f_p, f_u, prior = r.normal(2, spread, 7), r.normal(-3, spread, 11), 0.4
            value, negative, g_p, g_u = toxicity.risk(f_p, f_u, prior)
            part = lambda p, u: np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
            whole = lambda p, u: prior * np.logaddexp(0, -p).mean() + part(p, u)
            goal = whole if part(f_p, f_u) >= 0 else lambda p, u: -part(p, u)
            assert np.isclose(negative, part(f_p, f_u)) and np.isclose(value, prior * np.logaddexp(0, -f_p).mean() + max(0, negative))
            signs.add(negative >= 0)
            for g, f, at in ((g_p, f_p, 0), (g_u, f_u, 1)):
                for i in range(len(f)):
                    step = np.zeros(len(f))
                    step[i] = 1e-5
                    up, down = ([f_p, f_u], [f_p, f_u])
                    up[at], down[at] = f + step, f - step
                    assert np.isclose(g[i], (goal(*up) - goal(*down)) / 2e-5, atol=1e-7)
    assert signs == {True, False}


def test_dual_coordinate_descent_against_projected_gradient():
    r = np.random.default_rng(6)
    n, size = 40, 12
    dense = r.normal(size=(n, size)) * (r.random((n, size)) < 0.5)
    dense[:, -1] = 1
    y = np.where(dense[:, 0] + 0.5 * r.normal(size=n) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 1.0, 0.6)
    x = [(np.flatnonzero(d), d[np.flatnonzero(d)]) for d in dense]
    w = quality.dual_coordinate_descent(x, y, cost, size, epochs=4000, tolerance=1e-12)
    q = (y[:, None] * dense) @ (y[:, None] * dense).T
    alpha, rate = np.zeros(n), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - rate * (q @ alpha - 1), 0, cost)
    assert np.allclose(w, (alpha * y) @ dense, atol=1e-4)
    primal = 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (dense @ w))
    assert np.isclose(primal, alpha.sum() - 0.5 * alpha @ q @ alpha, atol=1e-4)


def test_quality_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    alone = quality.features(pa.RecordBatch.from_pydict({"text": ["c d e f"]}))[0]
    for before in ("a b c", "a b x", "", "c"):
        assert quality.features(pa.RecordBatch.from_pydict({"text": [before, "c d e f", "c"]}))[1].tolist() == alone.tolist()


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_under_other_partitions(spark, module, label):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one = {r.doc_id: r.score for r in module.score(table[0], module.fit(*table)).collect()}
    dealt = table[0].repartition(7, "lang").sortWithinPartitions("text"), table[1].repartition(3)
    again = {r.doc_id: r.score for r in module.score(dealt[0], module.fit(*dealt)).collect()}
    assert one.keys() == again.keys() and max(abs(one[k] - again[k]) for k in one) < 1e-9


def test_toxic_examples_outlast_many_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").limit(400)
    first = docs.orderBy("doc_id").first()
    copies = spark.createDataFrame([first], docs.schema).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(18_000)))).drop("again")
    found = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(d, labels, max_bytes=b)).collect()} for d, b in ((docs, 64 << 20), (docs.unionByName(copies), 64 << 20))]
    assert max(found[1].values()) > 0.5 and sum((found[0][k] >= 0.3) != (found[1][k] >= 0.3) for k in found[0]) <= 5
    small = toxicity.fit(docs, labels, max_positive=20, max_unlabelled=30, max_bytes=1000)
    assert len(small.weights) == 2
