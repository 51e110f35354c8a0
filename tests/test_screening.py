"""The decision cascade over its whole truth table, result rows and summaries."""

import itertools
import json

from pyspark.sql import functions as F

from codexa import queries as q
from codexa.functions import signals as sig
from codexa.functions import text as tx
from codexa.operators import checkpoint as cp
from codexa.operators.schema import CANONICAL
from codexa.plans import screening as scr

TEXTS = {
    "": (),
    "a wearable sensor": ("acquisition",),
    "a game": ("interaction",),
    "a game with a camera": ("acquisition", "interaction"),
    "cognitive training by an assistive robot": ("stimulation", "assistive", "interaction", "cue"),
    "monitoring; stimulates cognitive health; virtual community": ("acquisition", "assistive", "cue"),
}
EVIDENCE = {"The metadata does not mention AI.": True, "It does not use AI.": False}


def expected(g, m, h, a, i, s, on, omission):
    known = i in ("EXPLICIT_IOT", "FUNCTIONALLY_COMPATIBLE")
    if g == m == "YES":
        return "UNCERTAIN", ""
    if s == "YES" or m == "YES":
        return "EXCLUDE", ""
    if g == h == a == "YES" and i == "NO" and "acquisition" in on:
        return "UNCERTAIN", "RESGATE_IOT_3_DE_4"
    if h == a == "YES" and "NO" in (g, i) and {"interaction", "acquisition"} <= set(on):
        return "UNCERTAIN", "RESGATE_MULTIMODAL"
    if g == "NO" and h == "YES" and a != "NO" and known and {"stimulation", "assistive"} <= set(on):
        return "UNCERTAIN", "RESGATE_AAL_ESTIMULACAO"
    if s == m == g == a == "NO" and h == "YES" and omission and i != "NO" and {"acquisition", "assistive", "cue"} <= set(on):
        return "UNCERTAIN", "RESGATE_AAL_METADADOS_INCOMPLETOS"
    if "NO" in (g, h, a, i):
        return "EXCLUDE", ""
    return ("UNCERTAIN", "") if "UNCERTAIN" in (g, m, h, a, i, s) else ("RETAIN", "")


def test_cascade_truth_table(spark):
    y, rows = scr.YES_NO, []
    for labels in itertools.product(y, y, y, y, scr.IOT, y):
        for text, evidence in itertools.product(TEXTS, EVIDENCE):
            rows.append((*labels, text, evidence, *expected(*labels, TEXTS[text], EVIDENCE[evidence])))
    names = ["serious_game", "gamification_only", "health", "ai", "iot", "secondary_or_incomplete", "abstract", "evidence_ai", "want", "code"]
    df = spark.createDataFrame(rows, names).withColumns({"title": F.lit(""), "keywords": F.lit(""), "notes": F.lit("")}).withColumn("d", scr.decision())
    bad = df.where((F.col("d.decision") != F.col("want")) | (F.col("d.rescue_code") != F.col("code")))
    assert bad.count() == 0, bad.first()


def test_acronyms_are_words(spark):
    rows = [("an emg unit", True), ("semg unit", False), ("cable", False), ("çeeg", False), ("x_eeg", False), ("(EEG)", True)]
    df = spark.createDataFrame(rows, ["t", "want"]).withColumn("got", sig.contains_any(F.col("t"), ("emg", "eeg", "ble")))
    assert all(r.got == r.want for r in df.collect())


def test_results_and_summary(spark):
    articles = spark.createDataFrame([("MASTER-0001", "a"), ("MASTER-0002", ""), ("MASTER-0003", "a"), ("MASTER-0004", "a")], ["master_id", "abstract"])
    articles = articles.withColumns({c: F.lit("x") for c in [*scr.BASE[1:], "keywords"]})
    labels = dict.fromkeys(scr.LABELS, "YES") | {"gamification_only": "NO", "secondary_or_incomplete": "NO", "iot": "EXPLICIT_IOT"}
    answers = [{"master_id": f"MASTER-000{k}", **labels, **dict.fromkeys(scr.EVIDENCE, "e"), "notes": "", "api_error": "503" if k == 3 else None} for k in (1, 3)]
    answers.append(answers[0] | {"master_id": "MASTER-0004", "ai": "MAYBE"})
    schema = "master_id string, " + ", ".join(f"{c} string" for c in [*scr.LABELS, *scr.EVIDENCE, "notes", "api_error"])
    config = {"model": "m", "prompt_version": "1", "classifier_version": "1", "prompt_hash": "p"}
    rows = scr.results(articles, spark.createDataFrame([tuple(a[c.split()[0]] for c in schema.split(", ")) for a in answers], schema), config).cache()
    got = {r.master_id[-1]: (r.api_status, r.decision) for r in rows.collect()}
    assert got == {"1": ("SUCCESS", "RETAIN"), "2": ("NO_ABSTRACT", "UNCERTAIN"), "3": ("API_ERROR", "API_ERROR"), "4": ("API_ERROR", "API_ERROR")}
    assert {*scr.BASE, *scr.LABELS, *scr.EVIDENCE, "decision", "metadata_hash", "prompt_hash"} <= {*rows.columns}
    values = {r.indicator: r.value for r in scr.summary(rows, 4, "All", config).collect()}
    assert values["Pending"] == "2" and values["RETAIN"] == "1"
    assert scr.by_database(rows).count() == 2


def test_error_kinds(spark):
    df = spark.createDataFrame([("HTTP 429",), ("permission_denied",), ("High demand",), (None,)], "e string")
    got = df.select(*[scr.error_is(k, F.col("e")).alias(k) for k in scr.ERROR_CUES]).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def plan_text(df) -> str:
    """The optimized plan, with all columns."""
    spark, name = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)


def test_signal_text_is_worked_out_once(spark):
    """All terms are sought in one lower-cased text; written out for each term, it was made anew for each."""
    rows = spark.createDataFrame([[""] * len(CANONICAL)], list(CANONICAL))
    answers = spark.createDataFrame([], "master_id string, " + ", ".join(f"{c} string" for c in (*scr.LABELS, *scr.EVIDENCE, "notes", "api_error")))
    assert plan_text(scr.results(rows, answers, q.CONFIG)).count("lower(concat_ws(") == 1


def test_first_lines_are_found_without_splitting(spark):
    plan = plan_text(q.canonical(spark, "/root/testdata/sf0.001"))
    assert "substring_index" in plan and "split" not in plan
    text = spark.createDataFrame([("a\nb",), ("",), ("\nb",), ("a",), ("a\r\nb\nc",), (None,)], "t string")
    assert text.where("not (split_part(t, chr(10), 1) <=> substring_index(t, chr(10), 1))").isEmpty()


def test_texts_are_hashed_before_they_move(spark):
    """Saved results and records are joined by their keys; the join carried titles, abstracts and keywords of both."""
    saved, now = q.saved(spark, "/root/testdata/sf0.001"), q.articles(spark, "/root/testdata/sf0.001")
    for done in (q.QUERIES["checkpoint_valid"](spark, "/root/testdata/sf0.001"), cp.reconcile(saved, now, q.CONFIG).select("master_id", "refreshed")):
        plan = plan_text(done)
        assert not [c for c in ("s_abstract", "c_abstract", "s_keywords", "c_keywords", "Union") if c in plan]


def test_white_space_and_escapes_as_in_python(spark):
    """Every white space at either end goes, and JSON texts are Python's."""
    texts = [f"{a}{chr(c)}x{chr(c)}\\\"{chr(c)}" for c in (*range(1, 0x100), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0x1F600) for a in ("", "\\u001f")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tx.safe_text(F.col("t")), tx.json_text(F.col("t"))).collect()
    assert all(a == t.strip() and b == json.dumps(t, ensure_ascii=False) for t, a, b in got)
