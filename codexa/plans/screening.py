"""From evidence labels and lexical signals to decisions, result rows, summaries and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import Lexicons, calibrated, omission_cue, signal_text, stimulation_cue
from ..functions.text import metadata_fingerprint, safe_text

#: Allowed labels.
YES_NO = ("YES", "NO", "UNCERTAIN")
IOT = ("EXPLICIT_IOT", "FUNCTIONALLY_COMPATIBLE", "NO", "UNCERTAIN")
LABELS = {"serious_game": YES_NO, "gamification_only": YES_NO, "health": YES_NO, "ai": YES_NO, "iot": IOT, "secondary_or_incomplete": YES_NO}
EVIDENCE = ("evidence_serious_game", "evidence_gamification", "evidence_health", "evidence_ai", "evidence_iot", "evidence_study_type")
BASE = ("master_id", "source_id", "database", "title", "authors", "year", "publication", "volume", "document_type", "doi", "url")

#: The texts of decisions.
REASONS = {
    "contradiction": "Contradictory serious-game and gamification-only labels.",
    "secondary": "Secondary studies, abstracts or incomplete publications.",
    "gamification": "The study concerns gamification only.",
    "RESGATE_IOT_3_DE_4": "Serious game, health and AI are supported, with acquisition or monitoring signals; connectivity requires full-text review.",
    "RESGATE_MULTIMODAL": "Health and AI are supported, with digital interaction and acquisition signals; game or connectivity details need review.",
    "RESGATE_AAL_ESTIMULACAO": "An assistive health platform with IoT and cognitive or physical stimulation is indicated; the game component needs review.",
    "RESGATE_AAL_METADADOS_INCOMPLETOS": "An assistive health platform with stimulation and acquisition or monitoring is indicated. AI was marked negative only because its method is not mentioned. Verify the game, AI and connectivity in the full text; this rescue confirms none of them.",
    "serious_game": "No sufficient evidence of a serious game in health.",
    "health": "The study is outside the health context.",
    "ai": "No sufficient evidence of AI.",
    "iot": "No explicit or functionally compatible IoT is demonstrated.",
    "uncertain": "At least one criterion requires human review of the full text.",
    "retain": "The metadata supports serious game, health, AI and IoT criteria.",
    "no_abstract": "No abstract was available. The record must not be automatically excluded.",
    "error": "Technical API failure. This result must not be interpreted as an exclusion.",
}
NO_ABSTRACT_NOTES = "Preserved for human review because the abstract was unavailable."


def decision(lexicons: Lexicons = Lexicons(), text: Column | None = None) -> Column:
    """struct(decision, reason, rescue_code) from the label columns, title, abstract and keywords; the first rule that holds wins.
    text: the column that holds their `signal_text`, where it is worked out once for all terms that are sought in it."""
    g, h, a, i, m, s = (F.col(c) for c in ("serious_game", "health", "ai", "iot", "gamification_only", "secondary_or_incomplete"))
    text = signal_text(F.col("title"), F.col("abstract"), F.col("keywords")) if text is None else text
    sig = calibrated(text, lexicons)
    made = lambda d, key: F.struct(F.lit(d).alias("decision"), F.lit(REASONS[key]).alias("reason"), F.lit(key if key.startswith("RESGATE") else "").alias("rescue_code"))
    known = i.isin("EXPLICIT_IOT", "FUNCTIONALLY_COMPATIBLE")
    incomplete = (s == "NO") & (m == "NO") & (g == "NO") & (h == "YES") & (a == "NO") & (known | (i == "UNCERTAIN"))
    # the cue folds accents in Python, which runs for all rows; those that the labels rule out give it nothing
    omission = omission_cue(F.when(incomplete, F.col("evidence_ai")), F.when(incomplete, F.col("notes")))
    rules = [
        ((g == "YES") & (m == "YES"), "UNCERTAIN", "contradiction"),
        (s == "YES", "EXCLUDE", "secondary"),
        (m == "YES", "EXCLUDE", "gamification"),
        ((g == "YES") & (h == "YES") & (a == "YES") & (i == "NO") & sig["acquisition"], "UNCERTAIN", "RESGATE_IOT_3_DE_4"),
        ((h == "YES") & (a == "YES") & ((g == "NO") | (i == "NO")) & sig["interaction"] & sig["acquisition"], "UNCERTAIN", "RESGATE_MULTIMODAL"),
        ((g == "NO") & (h == "YES") & a.isin("YES", "UNCERTAIN") & known & sig["stimulation"] & sig["assistive"], "UNCERTAIN", "RESGATE_AAL_ESTIMULACAO"),
        (incomplete & sig["acquisition"] & sig["assistive"] & stimulation_cue(text) & omission, "UNCERTAIN", "RESGATE_AAL_METADADOS_INCOMPLETOS"),
        *[(c == "NO", "EXCLUDE", key) for c, key in ((g, "serious_game"), (h, "health"), (a, "ai"), (i, "iot"))],
        (F.array_contains(F.array(g, m, h, a, i, s), "UNCERTAIN"), "UNCERTAIN", "uncertain"),
    ]
    out = None
    for condition, d, key in rules:
        out = F.when(condition, made(d, key)) if out is None else out.when(condition, made(d, key))
    return out.otherwise(made("RETAIN", "retain"))


def valid_labels() -> Column:
    """Whether all labels are allowed ones and all evidence texts are there."""
    ok = F.lit(True)
    for c, allowed in LABELS.items():
        ok = ok & F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    for c in EVIDENCE:
        ok = ok & F.col(c).isNotNull()
    return ok


def results(articles: DataFrame, assessments: DataFrame, config: dict[str, str], lexicons: Lexicons = Lexicons()) -> DataFrame:
    """One result row for each article: SUCCESS, NO_ABSTRACT, or API_ERROR where labels are missing or not allowed.

    assessments: master_id, the labels, their evidence, notes, and api_error (null if the call went well).
    config: model, prompt_version, classifier_version, prompt_hash.
    """
    base = articles.select(*[safe_text(F.col(c)).alias(c) for c in BASE], safe_text(F.col("abstract")).alias("abstract"), safe_text(F.col("keywords")).alias("keywords"))
    rows = base.join(assessments, "master_id", "left")
    empty = F.col("abstract") == ""
    good = ~empty & F.coalesce(valid_labels(), F.lit(False)) & F.col("api_error").isNull()
    rows = rows.withColumn("_text", signal_text(F.col("title"), F.col("abstract"), F.col("keywords")))
    rows = rows.withColumns({"_status": F.when(empty, "NO_ABSTRACT").when(good, "SUCCESS").otherwise("API_ERROR"), "_made": decision(lexicons, F.col("_text"))})
    status = F.col("_status")
    pick = lambda success, none, error: F.when(status == "SUCCESS", success).when(status == "NO_ABSTRACT", F.lit(none)).otherwise(F.lit(error))
    out = [metadata_fingerprint(F.col("title"), F.col("abstract"), F.col("keywords")).alias("metadata_hash"), F.lit(config["prompt_hash"]).alias("prompt_hash")]
    out += [F.col(c) for c in BASE] + [F.lit(config[c]).alias(c) for c in ("model", "prompt_version", "classifier_version")]
    for label, evidence in zip(LABELS, ("evidence_serious_game", "evidence_gamification", "evidence_health", "evidence_ai", "evidence_iot", "evidence_study_type"), strict=True):
        out += [pick(F.col(label), "NOT_EVALUATED", "NOT_EVALUATED").alias(label), pick(F.col(evidence), "Abstract unavailable.", "").alias(evidence)]
    rescue = pick(F.col("_made.rescue_code"), "", "")
    out += [
        pick(F.coalesce("notes", F.lit("")), NO_ABSTRACT_NOTES, "").alias("notes"),
        pick(F.col("_made.decision"), "UNCERTAIN", "API_ERROR").alias("decision"),
        pick(F.col("_made.reason"), REASONS["no_abstract"], REASONS["error"]).alias("decision_reason"),
        F.when(rescue != "", "YES").otherwise("NO").alias("safety_rescue"),
        rescue.alias("rescue_code"),
        status.alias("api_status"),
        F.when(status == "API_ERROR", F.coalesce("api_error", F.lit("invalid assessment"))).otherwise("").alias("api_error"),
        "abstract",
        "keywords",
    ]
    return rows.select(*out)


COUNTERS = ("successful_api_analyses", "no_abstract", "api_errors", "retain", "uncertain", "exclude", "safety_rescues")


def counters() -> list[Column]:
    status, d = F.col("api_status"), F.col("decision")
    conditions = (status == "SUCCESS", status == "NO_ABSTRACT", status == "API_ERROR", d == "RETAIN", d == "UNCERTAIN", d == "EXCLUDE", F.col("safety_rescue") == "YES")
    return [F.count_if(c).alias(n) for n, c in zip(COUNTERS, conditions, strict=True)]


def summary(rows: DataFrame, total_records: int, database: str, config: dict[str, str]) -> DataFrame:
    """The 13 lines of a run's summary, as position, indicator, value."""
    values = rows.agg(*counters())
    pending = F.greatest(F.lit(total_records) - F.col("successful_api_analyses") - F.col("no_abstract"), F.lit(0))
    lines = [("Database", F.lit(database)), ("Model", F.lit(config["model"])), ("Prompt version", F.lit(config["prompt_version"])), ("Classifier version", F.lit(config["classifier_version"])), ("Total records", F.lit(total_records))]
    lines += list(zip(("Successful API analyses", "No abstract", "API errors", "RETAIN", "UNCERTAIN", "EXCLUDE", "Safety rescues"), (F.col(c) for c in COUNTERS), strict=True)) + [("Pending", pending)]
    items = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("indicator"), v.cast("string").alias("value")) for k, (n, v) in enumerate(lines, 1)])
    return values.select(F.explode(items).alias("x")).select("x.*")


def by_database(rows: DataFrame) -> DataFrame:
    """Outcomes of each database with a total row."""
    return rows.rollup("database").agg(F.count(F.lit(1)).alias("records"), *counters()).withColumn("database", F.coalesce("database", F.lit("Total")))


def sheets(rows: DataFrame) -> dict[str, DataFrame]:
    """The views of a run's result: filters over one table."""
    d = F.col("decision")
    return {"Results": rows, "RETAIN": rows.where(d == "RETAIN"), "UNCERTAIN": rows.where(d == "UNCERTAIN"), "EXCLUDE": rows.where(d == "EXCLUDE"), "Safety_rescue": rows.where(F.col("safety_rescue") == "YES"), "No_abstract": rows.where(F.col("api_status") == "NO_ABSTRACT"), "API_errors": rows.where(F.col("api_status") == "API_ERROR")}


#: What error messages of a provider are told apart by.
ERROR_CUES = {
    "quota": ("429", "resource_exhausted", "quota", "too many requests"),
    "authentication": ("401", "403", "api_key_invalid", "api key not valid", "invalid api key", "permission_denied", "unauthenticated"),
    "unavailable": ("503", "unavailable", "high demand", "service unavailable"),
}


def error_is(kind: str, message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for cue in ERROR_CUES[kind]:
        out = out | text.contains(cue)
    return out
