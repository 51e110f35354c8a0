"""Order-dependent entity resolution, first record wins, as a fold over connected components.

Records act on each other only through an equal DOI or an equal title key, so the components of the graph of records and
keys can be folded on their own, in `seq` order, with the result of one fold over all. Components come from label
propagation over written tables; records alone in their component never reach Python.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import format_master_id, master_number, normalize_database, normalize_doi, normalize_title, safe_text
from .schema import CANONICAL, quoted, ranked

#: Columns that a duplicate may fill.
FILLED = ("title", "authors", "year", "publication", "volume", "document_type", "doi", "abstract", "keywords", "url")


@dataclass(frozen=True)
class Policy:
    """How a fold matches and fills. incoming: a duplicate's own keys lead to its survivor too; origin: also match by source id;
    strip: fill stripped values; source: keep track of metadata sources and status; reset: clear a NO_DOI status when a DOI
    arrives; fill: columns, all but API columns if empty."""

    incoming: bool = False
    origin: bool = False
    strip: bool = False
    source: bool = False
    reset: bool = False
    fill: tuple = FILLED


INTERNAL = Policy(incoming=True)
MASTER = Policy(origin=True, strip=True, source=True)
#: What a fold says of each row.
VERDICT = ("kept", "matched", "match_type", "fields_filled")
ENRICHMENT = Policy(origin=True, reset=True, fill=())


def shared_path(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset; set it to a folder that all machines of the cluster share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "codexa-checkpoints")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def keep(df: DataFrame, name: str) -> DataFrame:
    path, spark, schema = shared_path(df.sparkSession, name), df.sparkSession, df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: How tables that grow with the records are joined: by shuffles alone, the hinted side, of unique keys, in hash tables of one partition
#: each. Without it Spark would send some of them through the driver, again in each round of `components`.
HASHED = "shuffle_hash"

#: Rows of keys whose components one task works out; above it labels are propagated over tables.
AT_ONCE = 200_000


def components_at_once(keys: DataFrame) -> DataFrame:
    """`components` of few keys, in one task of an executor. Keys go by their hash: a collision would only join two components,
    which the fold tells apart."""

    def run(frames):
        up: dict[int, int] = {}
        first: dict[int, int] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for pdf in frames:
            for seq, key in zip(pdf["seq"].tolist(), pdf["key"].tolist(), strict=True):
                a, b = root(seq), root(first.setdefault(key, seq))
                up[max(a, b)] = min(a, b)
        yield pd.DataFrame({"seq": list(up), "comp": [root(x) for x in up]}, dtype="int64")

    return keys.select("seq", F.xxhash64("key").alias("key")).coalesce(1).mapInPandas(run, "seq long, comp long")


def components(keys: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """seq, comp from rows (seq, key): the smallest seq that a record reaches through equal keys."""
    keys = keep(keys.distinct(), "keys")
    if keys.count() <= at_once:
        return keep(components_at_once(keys), "labels")
    labels = keep(keys.select("seq", F.col("seq").alias("comp")).distinct(), "labels")
    while True:
        low = keep(keys.join(labels.hint(HASHED), "seq").groupBy("key").agg(F.min("comp").alias("low")), "low")
        near = keep(keys.join(low.hint(HASHED), "key").groupBy("seq").agg(F.min("low").alias("near")), "near")
        jump = near.join(labels.select(F.col("seq").alias("near"), F.col("comp").alias("root")).hint(HASHED), "near", "left").select("seq", F.least("near", F.coalesce("root", "near")).alias("comp"))
        fresh = keep(jump.join(labels.withColumnRenamed("comp", "old").hint(HASHED), "seq").select("seq", "comp", (F.col("comp") != F.col("old")).alias("moved")), "labels")
        if fresh.where("moved").isEmpty():
            return fresh.select("seq", "comp")
        labels = fresh.select("seq", "comp")


def key_hash(kind: str, key: str) -> Column:
    """A key as a number, 0 where it is blank."""
    made = F.xxhash64(F.lit(kind), F.col(key))
    return F.when(F.col(key) == "", 0).when(made == 0, 1).otherwise(made)


def pair_components(rows: DataFrame) -> DataFrame:
    """_kt, _kd and comp, of the components that have several of the rows (seq, _kt, _kd), where the hash of a title and that of a DOI
    stand for them (a collision would only join two components, which the fold tells apart).

    Rows of an equal pair are one. Only a key that several pairs hold, in pairs of two keys, leads from one to another, so what
    `components` gets is small where most keys are of one pair; rows that come again add nothing to it."""
    one = F.col("_kt") + F.col("_kd")  # of which one is 0
    pairs = keep(rows.where("_kt <> 0 or _kd <> 0").groupBy("_kt", "_kd").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")), "pairs")
    both = pairs.where("_kt <> 0 and _kd <> 0")
    ends = both.select("seq", F.explode(F.array("_kt", "_kd")).alias("key"))
    shared = ends.groupBy("key").count().where("count > 1").select("key")
    labels = components(ends.join(shared.hint(HASHED), "key").select("seq", "key"))
    both = keep(both.join(labels.hint(HASHED), "seq", "left").select("_kt", "_kd", "n", F.coalesce("comp", "seq").alias("comp")), "both")
    by_key = both.select("comp", F.explode(F.array("_kt", "_kd")).alias("key")).groupBy("key").agg(F.min("comp").alias("comp"))
    alone = pairs.where("_kt = 0 or _kd = 0").withColumn("key", one).join(by_key.hint(HASHED), "key", "left").select("_kt", "_kd", "n", F.coalesce("comp", "seq").alias("comp"))
    found = keep(both.unionByName(alone), "found")
    many = found.groupBy("comp").agg(F.sum("n").alias("n")).where("n > 1").select("comp")
    return found.drop("n").join(many.hint(HASHED), "comp")


def _text(v) -> str:
    return "" if v is None or v != v else str(v).strip()


@functools.lru_cache(1 << 14)
def _plain(v) -> str:
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", _text(v)) if not unicodedata.combining(c)).lower()).strip()


@functools.lru_cache(1 << 14)
def _number(v) -> str:
    return re.sub(r"\s+", " ", re.sub(r"^(\d+)\.0$", r"\1", _text(v).casefold())).strip()


def _differ(a: str, b: str) -> bool:
    return bool(a) and bool(b) and a != b


class Fold:
    """The survivors of one component, in order, with their lookup tables."""

    def __init__(self, policy: Policy, columns: list[str]):
        self.policy = policy
        self.fill = policy.fill or tuple(c for c in columns if not c.startswith(("springer_api_", "_")) and c not in ("seq", "comp", "existing"))
        self.rows: list[dict] = []
        self.by_doi: dict[str, int] = {}
        #: Survivors by title with DOI and volume, with either, and alone: each kind of key leads to lists of survivors, in no order.
        self.by_title: tuple[dict, ...] = ({}, {}, {}, {})
        #: By title, source id and database, with the DOI and without, and there by what else must not differ.
        self.by_origin: tuple[dict, ...] = ({}, {})
        #: Of each survivor its place, and where it stands in the list of each kind.
        self.places: list[tuple] = []
        self.spots: tuple[array, ...] = tuple(array("q") for _ in range(6))

    @staticmethod
    def place(row: dict) -> tuple[str, str, str, tuple[str, str], tuple[str, ...]]:
        """Title, DOI and volume; source id and database; volume, year, publication and authors, as they are compared."""
        volume = _number(row.get("volume"))
        return row["_title"], row["_doi"], volume, (_text(row.get("source_id")), row["_db"]), (volume, _number(row.get("year")), _plain(row.get("publication")), _plain(row.get("authors")))

    def near(self, place: tuple) -> list[int]:
        """The compatible survivors of the title; two at most, as more than one is none."""
        title, doi, volume, *_ = place
        both, dois, volumes, titles = self.by_title
        if doi and volume:
            found = [both.get((title, d, v), ()) for d in (doi, "") for v in (volume, "")]
        elif doi:
            found = [dois.get((title, d), ()) for d in (doi, "")]
        elif volume:
            found = [volumes.get((title, v), ()) for v in (volume, "")]
        else:
            found = [titles.get(title, ())]
        return list(itertools.islice(itertools.chain.from_iterable(found), 2))

    def own(self, place: tuple) -> list[int]:
        """The compatible survivors of the same origin; two at most."""
        title, doi, _, origin, rest = place
        if not all(origin):
            return []
        by_doi, any_doi = self.by_origin
        found: list[int] = []
        for held in [by_doi.get((title, origin, d), {}) for d in (doi, "")] if doi else [any_doi.get((title, origin), {})]:
            if all(rest) and len(held) > 16:
                alike = [x for x in itertools.product(*((v, "") for v in rest)) if x in held]
            else:
                alike = (x for x in held if not any(map(_differ, x, rest)))
            for x in alike:
                found += held[x][: 2 - len(found)]
                if len(found) == 2:
                    return found
        return found

    def match(self, new: dict) -> tuple[int, str] | None:
        if new["_doi"] and new["_doi"] in self.by_doi:
            return self.by_doi[new["_doi"]], "DOI"
        if not new["_title"]:
            return None
        place = self.place(new)
        if self.policy.origin:
            own = self.own(place)
            if len(own) == 1:
                return own[0], "SOURCE_ID"
        near = self.near(place)
        return (near[0], "TITLE") if len(near) == 1 else None

    def keys(self, place: tuple) -> list[tuple[dict, object, object]]:
        """The tables that a survivor of the place stands in, with its key there, and the one within that."""
        title, doi, volume, origin, rest = place
        if not title:
            return []
        own = [(held, key, None) for held, key in zip(self.by_title, ((title, doi, volume), (title, doi), (title, volume), title), strict=True)]
        if self.policy.origin and all(origin):
            own += [(held, key, rest) for held, key in zip(self.by_origin, ((title, origin, doi), (title, origin)), strict=True)]
        return own

    def enter(self, i: int, place: tuple) -> None:
        self.places[i] = place
        for spots, (held, key, within) in zip(self.spots, self.keys(place)):
            if within is not None:
                held, key = held.setdefault(key, {}), within
            same = held.setdefault(key, [])
            spots[i] = len(same)
            same.append(i)

    def leave(self, i: int) -> None:
        for spots, (held, key, within) in zip(self.spots, self.keys(self.places[i])):
            table, inner = (held[key], within) if within is not None else (held, key)
            same = table[inner]
            last = same.pop()
            if last != i:  # the last one takes the place
                same[spots[i]], spots[last] = last, spots[i]
            if not same:
                del table[inner]
                if within is not None and not table:
                    del held[key]

    def register(self, i: int, doi: str) -> None:
        if doi:
            self.by_doi.setdefault(doi, i)

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.places.append(())
        for spots in self.spots:
            spots.append(0)
        self.enter(len(self.rows) - 1, self.place(row))
        self.register(len(self.rows) - 1, row["_doi"])

    def absorb(self, i: int, new: dict) -> list[str]:
        """Fills the survivor's blanks and registers its keys; the columns that were filled."""
        old, filled = self.rows[i], []
        for c in self.fill:
            if not _text(old.get(c)) and _text(new.get(c)):
                old[c] = _text(new[c]) if self.policy.strip else new[c]
                filled.append(c)
        if "doi" in filled:  # keys are those of the stored text
            old["_doi"] = new["_doi"]
            if self.policy.reset and old["_doi"] and _text(old.get("springer_api_status")) == "NO_DOI":
                old["springer_api_status"] = old["springer_api_error"] = ""
        if "title" in filled:
            old["_title"] = new["_title"]
        if "database" in filled:
            old["_db"] = new["_db"]
        if self.policy.source and filled:
            seen = [x.strip() for x in _text(old.get("metadata_source")).split(" | ") if x.strip()]
            own = _text(new.get("metadata_source"))
            old["metadata_source"] = " | ".join(seen + [own] * (own not in seen)) if own else old.get("metadata_source")
            if _text(new.get("metadata_status")) and ("abstract" in filled or not _text(old.get("metadata_status"))):
                old["metadata_status"] = _text(new["metadata_status"])
        if filled and (now := self.place(old)) != self.places[i]:
            self.leave(i)
            self.enter(i, now)
        if self.policy.incoming:
            self.register(i, new["_doi"])
        self.register(i, old["_doi"])
        return filled

    def survivors(self) -> Iterator[dict]:
        """The survivors, each of which is let go when it is handed on."""
        for i, r in enumerate(self.rows):
            self.rows[i] = {}
            yield r | {"kept": True, "matched": None, "match_type": "", "fields_filled": ""}


def repeated(df: DataFrame, column: str = "seq") -> list:
    """Up to five values that are not unique."""
    return [r[0] for r in df.groupBy(column).count().where("count > 1").select(column).limit(5).collect()]


#: Rows that a task hands on at once.
EMITTED = 4096
#: Columns whose values a fold looks at; of all others it knows which rows have one.
SEEN = ("source_id", "year", "volume", "publication", "authors", "springer_api_status", "springer_api_error", "metadata_source", "metadata_status")


def fold(rows: DataFrame, policy: Policy) -> DataFrame:
    """All rows with `kept`, and for the others `matched` (the survivor's seq), `match_type` and `fields_filled`; survivors carry
    what they took over.

    rows: seq (unique long, else ValueError), existing (rows of a master, never matched themselves), and text columns. Rows of
    components are sorted by component and seq within hash partitions and streamed: one call folds many components and
    holds the survivors of one of them, while duplicates are handed on at once. Only keys and the columns SEEN go there; a value of
    another column is stood for by its row's seq, and what survivors took over is joined to them afterwards.
    """
    text = [c for c in rows.columns if c not in ("seq", "existing")]
    seen, rest = [c for c in text if c in SEEN], [c for c in text if c not in SEEN]
    keyed = rows.withColumns({"_doi": normalize_doi(F.col("doi")), "_title": normalize_title(F.col("title")), "_db": normalize_database(F.col("database"))})
    keyed = keyed.withColumns({"_kt": key_hash("t", "_title"), "_kd": key_hash("d", "_doi")} | {f"_h_{c}": safe_text(quoted(c)) != "" for c in rest})
    keyed = keep(keyed, "keyed")
    if twice := repeated(keyed):
        raise ValueError(f"repeated seq values: {twice}")
    slim = keyed.select("seq", "existing", "_kt", "_kd", "_doi", "_title", "_db", *[quoted(c) if c in SEEN else quoted(f"_h_{c}").alias(c) for c in text])
    together = slim.join(pair_components(keyed).hint(HASHED), ["_kt", "_kd"]).drop("_kt", "_kd").repartition("comp").sortWithinPartitions("comp", "seq")
    verdicts = keep(together.mapInArrow(folding(policy, text, seen, rest), VERDICTS + "".join(f", `_s_{c}` string" for c in seen)), "verdicts")
    given = verdicts.select("seq", F.explode("_from").alias("x")).select("seq", "x.name", F.col("x.giver").alias("giver"))
    giver = keyed.where("not existing").select(F.col("seq").alias("giver"), *[(safe_text(quoted(c)) if policy.strip else quoted(c)).alias(f"_t_{c}") for c in rest])
    given = giver.join(given.hint(HASHED), "giver").groupBy("seq").agg(*[F.max(F.when(F.col("name") == c, quoted(f"_t_{c}"))).alias(f"_t_{c}") for c in rest])
    given = keep(given, "given")
    done = keyed.join(verdicts.drop("_from").hint(HASHED), "seq", "left").join(given.hint(HASHED), "seq", "left")
    values = {c: F.when(F.col("kept").isNull(), quoted(c)).otherwise(quoted(f"_s_{c}")) if c in SEEN else F.coalesce(quoted(f"_t_{c}"), quoted(c)) for c in text}
    verdict = [F.coalesce("kept", F.lit(True)).alias("kept"), "matched", *[F.coalesce(c, F.lit("")).alias(c) for c in ("match_type", "fields_filled")]]
    return done.select("seq", *[values[c].alias(c) for c in text], *verdict)


VERDICTS = "seq long, kept boolean, matched long, match_type string, fields_filled string, _from array<struct<name:string,giver:long>>"


def folding(policy: Policy, text: list[str], seen: list[str], rest: list[str]):
    """A function of batches of slim rows, sorted by comp and seq, that gives their verdicts."""
    fields = [("seq", pa.int64()), ("kept", pa.bool_()), ("matched", pa.int64()), ("match_type", pa.string()), ("fields_filled", pa.string())]
    names = pa.schema([*fields, ("_from", pa.list_(pa.struct([("name", pa.string()), ("giver", pa.int64())]))), *[(f"_s_{c}", pa.string()) for c in seen]])
    alike = (*seen, "_title", "_db")

    def told(row: dict) -> dict:
        own = str(row["seq"])
        taken = [{"name": c, "giver": int(row[c])} for c in rest if row[c] and row[c] != own]
        return {c: row[c] for c, _ in fields} | {"_from": taken} | {f"_s_{c}": row[c] for c in seen}

    def folded(batches) -> Iterator[dict]:
        state, comp, held = None, None, {}
        for batch in batches:
            for k in range(0, batch.num_rows, EMITTED):
                for row in batch.slice(k, EMITTED).to_pylist():
                    if row["comp"] != comp:
                        if state:
                            yield from map(told, state.survivors())
                        state, comp, held = Fold(policy, text), row["comp"], {}
                    own = str(row["seq"])
                    for c in rest:
                        row[c] = own if row[c] else ""
                    for c in alike:  # equal texts are held once
                        row[c] = held.setdefault(row[c], row[c])
                    hit = None if row["existing"] else state.match(row)
                    if hit:
                        filled = state.absorb(hit[0], row)
                        yield told(row | {"kept": False, "matched": state.rows[hit[0]]["seq"], "match_type": hit[1], "fields_filled": "; ".join(filled)})
                    else:
                        state.add(row)
        if state:
            yield from map(told, state.survivors())

    def run(batches):
        rows = folded(batches)
        while part := list(itertools.islice(rows, EMITTED)):
            yield pa.RecordBatch.from_pylist(part, schema=names)

    return run


def two_smallest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, first and second: the two smallest distinct values of each group (second is null where there is one). Spark keeps two rows of a
    group in each task before it shuffles, so a hot group costs no more than others."""
    w = W.partitionBy(*keys).orderBy(value)
    best = rows.select(*keys, value).withColumn("_n", F.dense_rank().over(w)).where("_n <= 2")
    return best.groupBy(*keys).agg(F.min(value).alias("first"), F.min(F.when(F.col("_n") == 2, F.col(value))).alias("second"))


def single_earlier(rows: DataFrame, same: tuple, agree: tuple) -> DataFrame:
    """seq and matched, for the rows that have exactly one earlier row (by seq, which is unique) equal in the columns `same` and not differing
    in the columns `agree`, where a blank differs from nothing.

    Rows equal in all of these columns form a class, of which only its two smallest seqs matter; classes of equal `same` are held
    against each other, not rows. A class' two smallest seqs over all classes that agree with it tell for each of its rows
    whether one earlier row is there (the first lies before it, the second does not)."""
    keys = [*same, *agree]
    rows = keep(rows.select("seq", *keys), "rows")
    classes = keep(two_smallest(rows, keys, "seq"), "classes")
    other = classes.select(*[F.col(c).alias(f"o_{c}") for c in keys], F.array("first", "second").alias("o_seqs"))
    meet = [F.col(c) == F.col(f"o_{c}") for c in same] + [(F.col(c) == F.col(f"o_{c}")) | (F.col(c) == "") | (F.col(f"o_{c}") == "") for c in agree]
    seqs = classes.select(*keys).join(other, meet).select(*keys, F.explode("o_seqs").alias("seq")).where("seq is not null")
    found = two_smallest(seqs, keys, "seq")
    one = (F.col("first") < F.col("seq")) & (F.col("second").isNull() | (F.col("second") >= F.col("seq")))
    return rows.join(found, keys).where(one).select("seq", F.col("first").alias("matched"))


def internal_dedup(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique records and the report of duplicates of one database."""
    done = keep(fold(rows.withColumn("existing", F.lit(False)), INTERNAL), "internal")
    unique = done.where("kept").drop(*VERDICT)
    first = unique.select(F.col("seq").alias("matched"), F.col("source_id").alias("matched_source_id"), F.col("title").alias("matched_title"))
    report = done.where("not kept").withColumnRenamed("match_type", "duplicate_reason").join(first.hint(HASHED), "matched").drop("kept", "matched", "fields_filled")
    return unique, report


def highest_id(rows: DataFrame) -> int:
    return rows.agg(F.max(master_number(F.col("master_id")))).first()[0] or 0


def assign_ids(rows: DataFrame, last: int = 0) -> DataFrame:
    """Blank master ids become the numbers after the highest one, in seq order; others stay, malformed ones too. last: the
    highest number ever given, where rows that had it may be gone."""
    top = max(last, highest_id(rows))
    blank = ranked(rows.where(safe_text(F.col("master_id")) == ""))
    given = blank.withColumn("master_id", format_master_id(F.lit(top) + F.col("position"))).drop("position")
    return rows.where(safe_text(F.col("master_id")) != "").unionByName(given)


def invalid_ids(rows: DataFrame) -> DataFrame:
    """Blank ids (as "") and repeated ids, with their counts."""
    ids = rows.groupBy(safe_text(F.col("master_id")).alias("master_id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.where((F.col("master_id") == "") | (F.col("n") > 1))


def upsert(master: DataFrame, incoming: DataFrame, last: int = 0) -> tuple[DataFrame, DataFrame]:
    """The new master and the report of incoming duplicates. seq orders both; the master's rows come first. last: as in
    `assign_ids`."""
    rows = master.select("seq", *CANONICAL).withColumn("existing", F.lit(True)).unionByName(incoming.select("seq", *CANONICAL).withColumn("master_id", F.lit("")).withColumn("existing", F.lit(False)))
    done = fold(rows, MASTER)  # of kept tables; texts are joined where a result is read, and not before
    ids = keep(assign_ids(keep(done.where("kept").select("seq", "master_id"), "kept"), last), "ids")
    fresh = done.where("kept").drop(*VERDICT, "master_id").join(ids.hint(HASHED), "seq").select("seq", *CANONICAL)
    place = fresh.select(F.col("seq").alias("matched"), *[safe_text(F.col(c)).alias(f"matched_{c}") for c in ("master_id", "database", "title", "doi")])
    updated = F.when(F.col("fields_filled") != "", safe_text(F.col("metadata_source"))).otherwise("")
    report = done.where("not kept").withColumn("metadata_update_source", updated).withColumnRenamed("match_type", "duplicate_reason")
    return fresh, report.join(place.hint(HASHED), "matched").drop("kept", "matched")


def update_counts(incoming: DataFrame, report: DataFrame) -> dict[str, int]:
    """Of an update: rows read, added, left out as duplicates, and master rows that duplicates filled."""
    filled = F.when(F.col("fields_filled") != "", F.col("matched_master_id"))
    duplicates, enriched = report.agg(F.count(F.lit(1)), F.count_distinct(filled)).first()
    read = incoming.count()
    return {"read": read, "added": read - duplicates, "duplicates": duplicates, "enriched": enriched}


def merge_enrichment(checkpoint: DataFrame, incoming: DataFrame) -> DataFrame:
    """An enrichment checkpoint with new import rows: blanks are filled, API columns belong to the checkpoint."""
    columns = list(dict.fromkeys([*checkpoint.columns, *incoming.columns, "source_id", "volume", "springer_api_status", "springer_api_error"]))

    def full(df: DataFrame, existing: bool) -> DataFrame:
        return df.select("seq", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns if c != "seq"]).withColumn("existing", F.lit(existing))

    done = fold(full(checkpoint, True).unionByName(full(incoming, False)), ENRICHMENT)
    return done.where("kept").drop(*VERDICT)
