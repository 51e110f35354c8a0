"""The pipeline's stages on nulls, empty and long texts, repeats, and columns with names that clash, against brute force."""

import collections
import hashlib

import corpus_pipeline
from codexa.llm import bpe, mixing, quality, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
CLASHES = {"__row": 7, "copy": "c", "copies": 3, "training_order": 1, "sig": "s", "score": 0.5, "y": 2, "key": "k", "ids": "i"}


def shingles(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def test_stages_on_odd_rows(spark, tmp_path):
    own = spark.read.parquet(f"{DATA}/documents.parquet")
    base = " ".join(f"clean{k}" for k in range(60)) + ". A sentence ends here, and another one. " * 2
    odd = [(5000, None), (5001, ""), (5002, base), (5002, base), (5003, base + "tail"), (None, base), (None, "alone without an id " + base[::-1]), (5004, base * 400), (5005, " \n ")]
    rows = spark.createDataFrame([(d, t, None, None if d == 5003 else "s", None) for d, t in odd], own.schema)
    docs = own.unionByName(rows).withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        got = [r.asDict() for r in after.collect()]
        if name == "quality_classifier" or name == "toxicity":
            module = quality if name == "quality_classifier" else toxicity
            model = module.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            good = {t: s for t, s in ((r.text, r.score) for r in docs.select("text").distinct().withColumn("doc_id", F.lit(1)).transform(lambda d: scored(module, model, d)).collect())}
            keep = (lambda t: good[t] >= 0.3) if module is quality else (lambda t: good[t] < 0.3)
            assert sorted(map(str, got)) == sorted(str(r) for r in before if keep(r["text"]))
        elif name == "ngram_jaccard":
            sets = [shingles(r["text"]) for r in before]
            root = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    a, b = sets[i], sets[j]
                    if a and b and root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                        x, y = root[i], root[j]
                        root = [min(x, y) if c in (x, y) else c for c in root]
            groups = collections.defaultdict(list)
            for r, c in zip(before, root, strict=True):
                groups[c].append(r["doc_id"])
            want = [min((d for d in ids if d is not None), default=None) for ids in groups.values()]
            assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in got)
        elif name == "mix_sources":
            n = collections.Counter(r["source"] for r in before)
            weight = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT) for s in n}
            rate = {s: len(before) * weight[s] / sum(weight.values()) / n[s] for s in n}
            want = collections.Counter()
            for r in before:
                assert rate[r["source"]] <= 32
                u = int(hashlib.md5(f"2024:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
                term = total = 2.718281828459045 ** -rate[r["source"]]
                k = 0
                while total <= u:
                    k += 1
                    term *= rate[r["source"]] / k
                    total += term
                want[str(r)] += k
            assert collections.Counter(map(str, got)) == +want
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(bpe.default_path())
            want = []
            for r in before:
                ids = t.encode(r["text"] or "", add_special_tokens=False).ids
                want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
            assert sorted(map(str, want)) == sorted(str(tuple(r.values())) for r in got)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        docs = after


def scored(module, model, texts):
    return texts.join(module.score(texts.withColumn("doc_id", F.xxhash64("text")), model).withColumnRenamed("doc_id", "h"), F.xxhash64("text") == F.col("h")).select("text", "score")
