"""The filter audit against the filters applied one after the other, and its inversions against sets of documents."""

import itertools
import random
import re

import numpy as np
import pytest

from codexa.llm import audit, queries

LONG = " ".join(f"w{i}" for i in range(200))
SCHEMA = "doc_id long, text string, source string, part string, e int"


def failed(text, smaller_texts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        any(c in "#$%&*|" for c in text),
        text in smaller_texts,
    )


def by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    flags = []
    for i, text, source in rows:
        smaller = {(t or "") for j, t, _ in rows if i is not None and j is not None and j < i}
        flags.append((source or "", i in good, i in toxic, failed(text or "", smaller)))
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        removed_in = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                k = "ABCDE".index(c)
                gone = [f for f in left if f[3][k]]
                left = [f for f in left if not f[3][k]]
                removed_in[c] += len(gone)
                fails = sum(f[3][k] for f in own)
                only = sum(f[3][k] and sum(f[3]) == 1 for f in own)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), only, sum(f[1] for f in gone), sum(f[2] for f in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(removed_in[key[1][key[2] - 1]])
    return out


def result(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(docs, table).collect()}


def test_audit_equals_filters_in_every_order(spark):
    texts = [LONG, LONG, LONG + " #", LONG.upper(), "a " * 300, "A b", "", None, " \n", LONG + " é" * 30, "$ A", "x" * 5000, LONG * 20]
    rows = [(i, t, ["s", "t", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [(0, LONG, "s"), (3, LONG.upper(), "t"), (None, LONG, "s"), (None, "new", "u"), (20, "new", "u"), (21, "new", "u"), (21, "new", None)]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (2, None, 1), (4, 0, None), (20, 1, 1), (21, 1, 0), (99, 1, 1), (None, 1, 1)]
    assert result(spark, rows, labels) == by_hand(rows, labels)


def test_audit_of_random_texts(spark):
    rnd = random.Random(4)
    pieces = [LONG, "A" * 40, "a a a " * 150, "#", "plain words here"]
    rows = [(rnd.randrange(60), " ".join(rnd.sample(pieces, rnd.randrange(3))), rnd.choice(["p", "q"])) for _ in range(80)]
    labels = [(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 60, 2)]
    assert result(spark, rows, labels) == by_hand(rows, labels)


def test_audit_of_nothing(spark):
    assert result(spark, [], []) == {}
    assert set(result(spark, [(1, None, None)], [])) == {("", "".join(o), s) for o in itertools.permutations("ABCDE") for s in range(1, 6)}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_inversions(n):
    rnd = np.random.default_rng(n)
    exact = rnd.integers(0, 50, 1 << n)  # documents by the set that they fail
    sets = np.arange(1 << n)
    joint = np.array([exact[sets & s == s].sum() for s in sets])
    assert (audit.exactly(joint) == exact).all()
    assert (audit.survivors(joint) == [exact[sets & s == 0].sum() for s in sets]).all()
    sums = [0] * n
    for order in itertools.permutations(range(n)):
        gone = 0
        for i in order:
            sums[i] += exact[(sets >> i & 1 == 1) & (sets & gone == 0)].sum()
            gone |= 1 << i
    assert [int(x) for x in audit.shapley_sums(joint, n)] == [int(x) for x in sums]


def test_query_is_registered():
    assert {"op11_filter_audit", "op12_spelling_variants"} <= queries.SQL.keys()
