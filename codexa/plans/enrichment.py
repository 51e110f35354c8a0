"""Metadata enrichment by an outside provider: which records to ask for, what answers mean, and how they are applied.

Planning and applying are plain DataFrame operations. The call itself sits behind a provider, a function from DOIs to
answers that runs in mapInPandas; the default one looks answers up in a table, so all runs work offline.
"""

from __future__ import annotations

import itertools
import json
import math
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, keywords_of_payload, normalize_doi, safe_text
from ..operators.resolve import shared_path
from ..operators.schema import ranked

#: The cap on calls of one run, and statuses after which a record is not asked for again.
MAX_CALLS = 470
FINAL = ("FOUND", "NOT_FOUND", "ALREADY_HAS_ABSTRACT", "NO_DOI")
STOP = ("RATE_LIMIT", "AUTH_OR_QUOTA_ERROR")
SOURCE = "Springer Nature Meta API v2"
ANSWER = "seq long, status string, payload string, error string"


def actions(records: DataFrame) -> DataFrame:
    """records with `action`: HAS_ABSTRACT, FINAL, NO_DOI or CALL; the first that holds."""
    action = F.when(safe_text(F.col("abstract")) != "", "HAS_ABSTRACT").when(safe_text(F.col("springer_api_status")).isin(*FINAL), "FINAL").when(normalize_doi(F.col("doi")) == "", "NO_DOI")
    return records.withColumn("action", action.otherwise("CALL"))


def plan(records: DataFrame, max_calls: int = MAX_CALLS) -> DataFrame:
    """records with `action` and `call`, the number of the call in seq order (null where none is made).

    The run stops at the first record beyond the cap: records after it keep their status, and get the action AFTER_CAP.
    """
    marked = actions(records)
    called = ranked(marked.where("action = 'CALL'").select("seq")).withColumnRenamed("position", "call")
    rows = marked.join(called, "seq", "left")
    stop = called.where(F.col("call") == max_calls + 1).agg(F.min("seq").alias("_stop"))  # one row
    rows = rows.join(F.broadcast(stop))
    late = F.col("_stop").isNotNull() & (F.col("seq") >= F.col("_stop"))
    return rows.withColumn("action", F.when(late, "AFTER_CAP").otherwise(F.col("action"))).withColumn("call", F.when(late, F.lit(None)).otherwise(F.col("call"))).drop("_stop")


def http_status(code: Column, payload: Column) -> Column:
    """What an HTTP answer means."""
    records = F.get_json_object(payload, "$.records")
    found = F.when(payload.isNull() | (F.get_json_object(payload, "$").isNull()), "ERROR").when(F.coalesce(records, F.lit("[]")) == "[]", "NOT_FOUND").otherwise("FOUND")
    return F.when(code == 404, "NOT_FOUND").when(code == 429, "RATE_LIMIT").when(code.isin(401, 403), "AUTH_OR_QUOTA_ERROR").when(code == 200, found).otherwise("ERROR")


class StopFlag:
    """A file in the shared folder that tells all tasks of a run to stop."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self) -> bool:
        store, at = fs.FileSystem.from_uri(self.path)
        return store.get_file_info(at).type != fs.FileType.NotFound

    def up(self) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at):
            pass


def paced(calls: Iterable[tuple[int, str]], provider: Callable, pause: float, index: int, partitions: int, begin: float, stopped: Callable[[], bool], stop: Callable[[], None], clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Answers of the calls (seq, doi) that one of several tasks makes. Time from `begin` is cut into slots of `pause` seconds, of which
    each task owns every `partitions`-th; a call takes the task's next slot that has not begun, so all tasks together make one
    call in each slot at most, however long calls take and without asking each other. A stopping status stops all of them
    before their next calls."""
    turn = -1
    for seq, doi in calls:
        if stopped():
            return
        if pause:
            turn = max(turn + 1, math.ceil(((clock() - begin) / pause - index) / partitions))
            wait(max(0.0, begin + (index + turn * partitions) * pause - clock()))
            if stopped():
                return
        status, record, error = provider(doi)
        if status in STOP:
            stop()
        yield seq, status, json.dumps(record) if record is not None else None, error


def call(planned: DataFrame, provider: Callable[[str], tuple[str, dict | None, str]], pause: float = 0.0, partitions: int = 1, clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Answers (seq, status, payload, error) of the planned calls. Calls are dealt to the partitions in turn, by their numbers, and made as
    `paced` says, by the machines' clocks. The cap on calls is the plan's, so it holds over all partitions. The flag belongs to one
    plan of calls: what is returned is to be written once."""
    flag, begin = StopFlag(shared_path(planned.sparkSession, "stop")), clock()
    rows = planned.where("call is not null").select("seq", normalize_doi(F.col("doi")).alias("doi"), "call")
    rows = rows.repartitionById(partitions, ((F.col("call") - 1) % partitions).cast("int")).sortWithinPartitions("call")

    def run(frames):
        index = TaskContext.get().partitionId()
        calls = ((seq, doi) for pdf in frames for seq, doi in zip(pdf["seq"].tolist(), pdf["doi"], strict=True))
        out = paced(calls, provider, pause, index % partitions, partitions, begin, flag, flag.up, clock, wait)
        while part := list(itertools.islice(out, 100)):
            yield pd.DataFrame(part, columns=["seq", "status", "payload", "error"]).astype({"status": object, "payload": object, "error": object})

    return rows.mapInPandas(run, ANSWER)


def with_retries(request: Callable[[str], tuple[int, str]], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str, dict | None, str]]:
    """A provider from a function that returns (HTTP code, body) or raises OSError."""

    def ask(doi: str) -> tuple[str, dict | None, str]:
        if not doi:
            return "NO_DOI", None, ""
        for k in range(1, attempts + 1):
            try:
                code, body = request(doi)
                if code in (404, 429, 401, 403):
                    return {404: "NOT_FOUND", 429: "RATE_LIMIT"}.get(code, "AUTH_OR_QUOTA_ERROR"), None, "HTTP 429 - rate limit reached" if code == 429 else f"HTTP {code}"
                if code >= 400:
                    raise OSError(f"HTTP {code}")
            except OSError as error:
                if k == attempts:
                    return "ERROR", None, str(error)
                wait(2.0**k)
                continue
            try:
                found = json.loads(body).get("records", [])
            except ValueError as error:
                return "ERROR", None, f"Invalid JSON response: {error}"
            return ("FOUND", found[0], "") if found else ("NOT_FOUND", None, "")
        return "ERROR", None, "Unknown request error."

    return ask


def apply(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """The records after the answers: an abstract replaces, keywords and document type only fill blanks."""
    a = answers.select("seq", F.col("status").alias("_status"), F.col("payload").alias("_payload"), F.col("error").alias("_error"))
    rows = planned.join(a, "seq", "left")
    found = (F.col("_status") == "FOUND") & F.col("_payload").isNotNull()
    field = lambda name: safe_text(F.get_json_object("_payload", f"$.{name}"))
    rows = rows.withColumns({"_abstract": clean_html(F.get_json_object("_payload", "$.abstract")), "_keywords": keywords_of_payload(F.col("_payload")), "_type": field("contentType")})
    now = F.when(F.col("_status").isNotNull(), F.col("_status")).when((F.col("action") == "HAS_ABSTRACT") & (safe_text(F.col("springer_api_status")) == ""), "ALREADY_HAS_ABSTRACT").when(F.col("action") == "NO_DOI", "NO_DOI")
    fill = lambda c, new: F.when(found & (safe_text(F.col(c)) == "") & (F.col(new) != ""), F.col(new)).otherwise(F.col(c))
    updates = {
        "springer_api_status": F.coalesce(now, F.col("springer_api_status")),
        "springer_api_error": F.when(F.col("_status").isNotNull(), F.coalesce("_error", F.lit(""))).otherwise(F.col("springer_api_error")),
        "springer_api_title": F.when(found, field("title")).otherwise(F.col("springer_api_title")),
        "springer_api_doi": F.when(found, normalize_doi(F.get_json_object("_payload", "$.doi"))).otherwise(F.col("springer_api_doi")),
        "springer_api_document_type": F.when(found, F.col("_type")).otherwise(F.col("springer_api_document_type")),
        "abstract": F.when(found & (F.col("_abstract") != ""), F.col("_abstract")).otherwise(F.col("abstract")),
        "keywords": fill("keywords", "_keywords"),
        "document_type": fill("document_type", "_type"),
        "metadata_status": F.when(found, F.when(F.col("_abstract") != "", "ABSTRACT_FOUND").otherwise("METADATA_FOUND_NO_ABSTRACT")).otherwise(F.col("metadata_status")),
        "metadata_source": F.when(found, F.lit(SOURCE)).otherwise(F.col("metadata_source")),
    }
    return rows.withColumns(updates).drop("_status", "_payload", "_error", "_abstract", "_keywords", "_type")
