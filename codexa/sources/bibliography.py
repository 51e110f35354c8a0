"""Readers of bibliographic exports: BibTeX, NBIB/MEDLINE, delimited text and workbooks.

BibTeX, NBIB and delimited files are read in byte ranges (`splits`), so one large file uses all cores. Workbooks, and files given
as rows, are parsed by one Python call each, to an array that is exploded with its position.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import DATABASES, clean_bibtex_value, extract_doi, extract_doi_from_values, header_name, safe_text
from ..operators.resolve import keep
from ..operators.schema import CANONICAL, EXPORTS, VOLUME_ALIASES
from . import bibtex, splits, workbooks

#: Rows that a task hands on at once.
EMITTED = 1000
PAIR = lambda name: pa.list_(pa.struct([(name, pa.string()), ("value", pa.string())]))
ENTRY = {"line": ("int", pa.int32()), "type": ("string", pa.string()), "key": ("string", pa.string()), "fields": ("array<struct<name:string,value:string>>", PAIR("name")), "error": ("string", pa.string())}


def parsed_files(contents: DataFrame, keys: list[str], made: dict[str, tuple], parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """The keys of each file (keys, content), `row`, and what `parse` gives of its content, a row each. made: Spark's and Arrow's type of
    each column. A task holds the results of one file at most and hands them on as they come."""

    def run(batches):
        out, names = [], None
        for batch in batches:
            names = pa.schema([*[batch.schema.field(k) for k in range(len(keys))], ("row", pa.int32()), *[(c, t) for c, (_, t) in made.items()]])
            for k in range(batch.num_rows):
                *own, content = (c[k].as_py() for c in batch.columns)
                same = dict(zip(keys, own, strict=True))
                for row, x in enumerate(parse(bytes(content)) if content is not None else ()):
                    out.append(same | {"row": row} | x)
                    if len(out) == EMITTED:
                        yield pa.RecordBatch.from_pylist(out, schema=names)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=names)

    schema = ", ".join([*[f"`{c}` {contents.schema[c].dataType.simpleString()}" for c in keys], "row int", *[f"`{c}` {t}" for c, (t, _) in made.items()]])
    return contents.select(*keys, "content").mapInArrow(run, schema)


def parse_bibtex(text: str, keep_first: frozenset[str] = frozenset()) -> Iterator[dict]:
    """Entries of a BibTeX file: `bibtex.parse`."""
    return bibtex.parse(text, keep_first)


def parse_nbib(text: str) -> Iterator[list[tuple[str, str]]]:
    """Records of (tag, value). A blank line ends a record; a line that starts with a space goes on with the last value."""
    record: list[list[str]] = []
    for line in [*re.split(r"\r\n|\r|\n", text), ""]:
        if not line.strip():
            if record:
                yield [(a, b) for a, b in record]
            record = []
        elif m := re.match(r"^([A-Z0-9]{2,4})\s*-\s?(.*)$", line):
            record.append([m[1], m[2].strip()])
        elif line[0] == " " and record:
            record[-1][1] = f"{record[-1][1]} {line.strip()}".strip()


def file_numbers(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """name and file (position by lower-cased name) of the files of a folder; contents are not read."""
    return files(spark, path, suffixes).select("name", "file")


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, name, content and file (position by lower-cased name) of the files of a folder, not of folders in it."""
    rows = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = rows.where(F.lower("name").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    names = sorted((r["name"] for r in rows.select("name").collect()), key=str.lower)  # a row for each file
    order = spark.createDataFrame(list(enumerate(names)), "file int, name string") if names else spark.createDataFrame([], "file int, name string")
    return rows.select("path", "name", "content").join(F.broadcast(order), "name")


def refuse(rows: DataFrame) -> None:
    """ValueError where entries (name, file, line, error) can't be used, as nothing of such a file may be: for each file the number of its
    bad blocks and the first five."""
    bad = rows.where("error <> ''").groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list(F.struct("line", "error"))), 1, 5).alias("first"))
    found = bad.orderBy("file").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['name']}: {r['n']} rejected block(s). " + "; ".join(f"line {x['line'] + 1}: {x['error']}" for x in r["first"]) for r in found))


PARTS = "array<struct<line:int,type:string,key:string,fields:array<struct<name:string,parts:array<struct<text:string,ref:boolean>>>>,error:string>>"


def read_bibtex(spark: SparkSession, path: str, recover_copyright: bool = False) -> DataFrame:
    """file, name, row, line, type, key and fields of all entries of a folder's files, which are read in byte ranges. ValueError
    as in `refuse`."""
    first = frozenset({"copyright"}) if recover_copyright else frozenset()

    @F.pandas_udf(PARTS)
    def parsed(text: pd.Series) -> pd.Series:
        made = lambda b: b | {"fields": [{"name": n, "parts": [{"text": t, "ref": r} for t, r in parts]} for n, parts in b["fields"]]}
        return text.map(lambda t: [made(b) for b in bibtex.blocks(t, first)])

    suffixes = (".bib", ".bibtex")
    found = splits.records(splits.text_lines(spark, path, suffixes), splits.Scan(lambda line, state, delimiter: bibtex.START.match(line) is not None))
    rows = found.select("path", "name", "begin", "n", F.col("line").alias("top"), F.posexplode(parsed("text")).alias("k", "x")).select("path", "name", "begin", "n", "k", "top", "x.*")
    rows = keep(rows.withColumn("line", (F.col("top") + F.col("line")).cast("int")).drop("top").join(F.broadcast(file_numbers(spark, path, suffixes)), "name"), "blocks")  # parsed once
    key = F.when(F.col("type") == "string", F.concat(F.lit("@"), F.lower(F.get("fields", 0)["name"]))).otherwise(F.col("key"))
    same = rows.where("error = ''").select("file", "name", "line", "k", key.alias("key")).where("key <> ''")
    twice = same.groupBy("file", "name", "key").agg(F.sort_array(F.collect_list(F.struct("line", "k"))).alias("at")).where(F.size("at") > 1)
    twice = twice.select("file", "name", F.explode(F.slice("at", 2, F.size("at") - 1)).alias("x")).select("file", "name", "x.line", F.lit(bibtex.SAME_KEY).alias("error"))
    refuse(rows.select("file", "name", "line", "error").unionByName(twice))
    entries = splits.numbered(rows.where("type <> 'string'"), "k")
    return named_values(entries, rows.where("type = 'string'")).select("name", "file", "row", "line", "type", "key", "fields")


def named_values(entries: DataFrame, strings: DataFrame) -> DataFrame:
    """Entries with their fields' parts joined; a word that an @string before it in the file names stands for that string's value. The
    strings of a file, a few as a rule, are worked out in one task, in order, as they may name each other."""
    plain = lambda parts: F.array_join(F.transform(parts, lambda p: p["text"]), "")
    fields = lambda text: F.transform("fields", lambda f: F.struct(f["name"].alias("name"), text(f["parts"]).alias("value")))
    if strings.isEmpty():
        return entries.withColumn("fields", fields(plain))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, str] = {}
        out = []
        for r in pdf.sort_values(["line", "k"]).itertuples():
            for f in r.fields:
                names[f["name"].lower()] = bibtex.joined([(p["text"], p["ref"]) for p in f["parts"]], names)
                out.append((r.file, r.line, r.k, f["name"].lower(), names[f["name"].lower()]))
        return pd.DataFrame(out, columns=["file", "at", "part", "word", "text"])

    values = strings.select("file", "line", "k", "fields").groupBy("file").applyInPandas(follow, "file int, at int, part int, word string, text string")
    words = F.array_distinct(F.transform(F.filter(F.flatten("fields.parts"), lambda p: p["ref"]), lambda p: F.lower(p["text"])))
    used = entries.select("file", "row", "line", "k", F.explode(words).alias("word")).join(values, ["file", "word"])
    used = used.where(F.struct("at", "part") < F.struct("line", "k"))
    known = used.groupBy("file", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "text"))).alias("known"))
    stands = lambda p: F.when(p["ref"], F.coalesce(F.element_at("known", F.lower(p["text"])), p["text"])).otherwise(p["text"])
    rows = entries.join(known, ["file", "row"], "left")
    return rows.withColumn("fields", fields(lambda parts: F.when(F.col("known").isNull(), plain(parts)).otherwise(F.array_join(F.transform(parts, stands), "")))).drop("known")


def bibtex_entries(contents: DataFrame, recover_copyright: bool = False) -> DataFrame:
    """file, line, type, key and fields of all entries of files given as rows (name, file, content). ValueError as in `refuse`."""
    first = frozenset({"copyright"}) if recover_copyright else frozenset()
    parse = lambda b: parse_bibtex(b.decode("utf-8-sig", "replace"), first)
    rows = keep(parsed_files(contents, ["name", "file"], ENTRY, parse), "entries")  # parsed once
    refuse(rows)
    return rows.drop("error")


#: Fields that a canonical column is taken from, in order of preference.
BIBTEX_FIELDS = {
    "authors": ("author", "authors"),
    "year": ("year", "date"),
    "publication": ("journal", "booktitle", "publication", "series", "publisher"),
    "volume": ("volume",),
    "doi": ("doi",),
    "abstract": ("abstract", "summary"),
    "url": ("url", "link"),
    "title": ("title",),
}
BIBTEX_TYPES = ("document_type", "documenttype", "content_type", "type")
BIBTEX_KEYWORDS = ("keywords", "keyword", "author_keywords", "author keywords", "index_keywords", "index keywords", "controlled_terms", "controlled terms", "uncontrolled_terms", "uncontrolled terms")
COMPENDEX_KEYWORDS = ("keywords", "keyword", "key", "note")


def bibtex_records(entries: DataFrame, database: str) -> DataFrame:
    """seq (file, row) and the canonical columns of BibTeX entries; a blank key gives DB-0001, ... by position over all files."""
    lower = F.transform("fields", lambda x: F.struct(F.lower(x["name"]).alias("k"), clean_bibtex_value(x["value"]).alias("v")))
    rows = entries.withColumn("f", F.map_from_entries(F.filter(lower, lambda x: x["k"] != "")))
    field = lambda *names: F.coalesce(*[F.nullif(F.element_at("f", n), F.lit("")) for n in names], F.lit(""))
    words = F.filter(F.array(*[F.coalesce(F.element_at("f", k), F.lit("")) for k in (COMPENDEX_KEYWORDS if database == "compendex" else BIBTEX_KEYWORDS)]), lambda x: x != "")
    out = {k: field(*v) for k, v in BIBTEX_FIELDS.items()}
    out["keywords"] = F.array_join(F.array_distinct(words), "; ")
    out["document_type"] = F.coalesce(F.nullif(field(*BIBTEX_TYPES), F.lit("")), F.col("type"))
    out["doi"] = F.coalesce(F.nullif(extract_doi(out["doi"]), F.lit("")), extract_doi_from_values(F.concat_ws(" ", F.col("key"), F.array_join(F.map_values("f"), " "))))
    display = DATABASES[database][0]
    constants = {"master_id": F.lit(""), "source_id": safe_text(F.col("key")), "database": F.lit(display), "metadata_status": F.lit("IMPORTED"), "metadata_source": F.lit(f"{display} export")}
    sizes = entries.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))  # a row for each file
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(sizes), "file")
    made = F.format_string(database.upper() + "-%04d", F.col("_before") + F.col("row") + 1)
    constants["source_id"] = F.coalesce(F.nullif(constants["source_id"], F.lit("")), made)
    return rows.select(F.struct("file", "row").alias("seq"), *[(out | constants)[c].alias(c) for c in CANONICAL])


def read_nbib(spark: SparkSession, path: str) -> DataFrame:
    """file, row and tags of all records of a folder's files, which are read in byte ranges."""

    @F.pandas_udf("array<array<struct<tag:string,value:string>>>")
    def parsed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [[{"tag": x, "value": v} for x, v in r] for r in parse_nbib(t)])

    rows = splits.records(splits.text_lines(spark, path, (".nbib",)), splits.NBIB)
    rows = keep(rows.select("path", "name", "begin", "n", F.explode(parsed("text")).alias("tags")), "tags")
    return splits.numbered(rows).join(F.broadcast(file_numbers(spark, path, (".nbib",))), "name").select("file", "row", "tags")


def nbib_tags(contents: DataFrame) -> DataFrame:
    """file, row and tags (tag -> values) of all records of files (file, content)."""
    parse = lambda b: ({"tags": [{"tag": t, "value": v} for t, v in r]} for r in parse_nbib(b.decode("utf-8", "replace")))
    return parsed_files(contents, ["file"], {"tags": ("array<struct<tag:string,value:string>>", PAIR("tag"))}, parse)


def nbib_records(records: DataFrame) -> DataFrame:
    """seq and the canonical columns of MEDLINE records; without a PMID the id counts within the file."""
    values = lambda *tags: F.filter(F.transform(F.filter("tags", lambda x: x["tag"].isin(*tags)), lambda x: safe_text(x["value"])), lambda v: v != "")
    first = lambda tag: F.coalesce(F.get(values(tag), 0), F.lit(""))
    joined = lambda a: F.array_join(F.array_distinct(a), "; ")
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    pmid = first("PMID")
    out = {
        "master_id": F.lit(""),
        "source_id": either(pmid, F.format_string("PUBMED-%04d", F.col("row") + 1)),
        "database": F.lit("PubMed"),
        "title": first("TI"),
        "authors": either(joined(values("FAU")), joined(values("AU"))),
        "year": first("DP"),
        "publication": either(first("JT"), first("TA")),
        "volume": first("VI"),
        "document_type": joined(values("PT")),
        "doi": extract_doi_from_values(F.array_join(F.concat(values("LID"), values("AID")), " ")),
        "abstract": F.array_join(values("AB"), " "),
        "keywords": joined(F.concat(values("OT"), values("MH"))),
        "url": F.when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).otherwise(""),
        "metadata_status": F.lit("IMPORTED"),
        "metadata_source": F.lit("PubMed NBIB export"),
    }
    return records.select(F.struct("file", "row").alias("seq"), *[out[c].alias(c) for c in CANONICAL])


def decode(data: bytes) -> str:
    """The first encoding that fits: UTF-16 where a mark says so, UTF-8 with or without a mark, then Latin-1, which fits all."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


DELIMITERS = ",;\t|"


def sniff(sample: str) -> str:
    """The delimiter that cuts the first record, the headers, in two or more, and then most of the sample's other whole records in as many;
    of equals the one with more headers. Where none does, a file of one column, what csv.Sniffer takes it for, else a comma."""
    found = []
    for d in DELIMITERS:
        try:
            rows = [r for r in csv.reader(io.StringIO(sample, newline=""), delimiter=d) if r]
        except csv.Error:
            continue
        n, rest = len(rows[0]) if rows else 0, rows[1:-1] or rows[1:]  # the last one may be cut off
        if n > 1:
            found.append((sum(len(r) == n for r in rest) / len(rest) if rest else 0.0, n, d))
    if found:
        return max(found, key=lambda x: x[:2])[2]
    try:
        return csv.Sniffer().sniff(sample, DELIMITERS).delimiter
    except csv.Error:
        return ","


def parse_delimited(data: bytes) -> list[list[str]]:
    text = decode(data)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text[:8192])))


#: Files whose headers are broadcast to their rows.
MAX_FILES = 20_000
DELIMITED = (".csv", ".txt", ".tsv")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """file, row and cells (header -> text) of the tables of a folder. Delimited text is read in byte ranges, workbooks file by file."""
    suffixes = (*DELIMITED, *WORKBOOKS)
    numbers = F.broadcast(file_numbers(spark, path, suffixes))
    books = workbook_cells(files(spark, path, WORKBOOKS).drop("file").join(numbers, "name"))
    return read_delimited(spark, path).join(numbers, "name").select("file", "row", "cells").unionByName(books)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """name, row and cells of delimited files. The delimiter of each is found in its first lines."""
    lines = splits.text_lines(spark, path, DELIMITED)
    signs = {r["path"]: sniff(decode(bytes(r["head"]))) for r in splits.heads(lines).collect()}  # a row for each file
    found = keep(splits.records(lines, splits.DELIMITED, signs), "lines")

    @F.pandas_udf("array<string>")
    def parsed(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([next(csv.reader(io.StringIO(t, newline=""), delimiter=signs.get(p, ",")), []) for p, t in zip(path, text, strict=True)])

    rows = keep(found.where("n > 0").select("path", "name", "begin", "n", "line", parsed("path", "text").alias("values")), "values")
    top = rows.where("line = 0").select("path", F.col("values").alias("headers"))
    rows = rows.where((F.col("line") > 0) & F.exists("values", lambda v: v != "")).join(F.broadcast(top), "path")
    size = F.least(F.size("headers"), F.size("values"))
    cells = F.transform(F.arrays_zip(F.slice("headers", 1, size), F.slice("values", 1, size)), lambda x: F.struct(x["0"].alias("header"), x["1"].alias("value")))
    return splits.numbered(rows.withColumn("cells", cells)).select("name", "row", "cells")


WORKBOOKS = (".xlsx", ".xls")


def table_cells(contents: DataFrame) -> DataFrame:
    """file, row and cells (header -> text) of .csv, .txt, .tsv, .xlsx and .xls files (name, file, content); all values are text."""

    def parse(b: bytes) -> Iterator[dict]:
        rows = [r for r in parse_delimited(b) if r]
        return ({"cells": [{"header": h, "value": v} for h, v in zip(rows[0], r, strict=False)]} for r in rows[1:] if any(r))

    book = F.lower("name").rlike(r"\.xlsx?$")
    plain = parsed_files(contents.where(~book), ["file"], {"cells": ("array<struct<header:string,value:string>>", PAIR("header"))}, parse)
    return plain.unionByName(workbook_cells(contents.where(book)))


def workbook_cells(contents: DataFrame) -> DataFrame:
    """file, row and cells of the first sheets of workbooks; rows are numbered as they come, behind the first one, which has the headers."""
    rows = keep(workbooks.sheet_rows(contents), "sheets")
    top = rows.groupBy("file").agg(F.min_by("values", "row").alias("headers"), F.min("row").alias("top"))  # a row for each file
    rows = rows.join(F.broadcast(top), "file").where(F.col("row") > F.col("top"))
    size = F.least(F.size("headers"), F.size("values"))
    cells = F.transform(F.arrays_zip(F.slice("headers", 1, size), F.slice("values", 1, size)), lambda x: F.struct(x["0"].alias("header"), x["1"].alias("value")))
    place = F.row_number().over(W.partitionBy("file").orderBy("row")) - 1  # a sheet has a million rows at most
    return rows.select("file", place.alias("row"), cells.alias("cells"))


def table_records(rows: DataFrame, database: str) -> DataFrame:
    """seq and the canonical columns of a database's tables: for each column the first cell with a value under one of its headers, keywords
    combined, a DOI sought in the whole row. Headers are normalised once for each file and joined to its rows, so the plan does not
    grow with files or layouts; of equal headers in a file the first counts."""

    @F.pandas_udf("array<string>")
    def named(headers: pd.Series) -> pd.Series:
        return headers.map(lambda h: [header_name(x) if x not in list(h)[:k] else "" for k, x in enumerate(h)])

    longest = F.max_by(F.transform("cells", lambda c: c["header"]), F.size("cells"))
    names = keep(rows.groupBy("file").agg(longest.alias("headers")).select("file", named("headers").alias("names")), "headers")  # a row for each file
    rows = rows.join(F.broadcast(names) if names.count() <= MAX_FILES else names, "file")
    cells = F.transform("cells", lambda c, k: F.struct(F.get("names", k).alias("name"), safe_text(c["value"]).alias("value")))
    rows = rows.withColumn("found", F.filter(cells, lambda c: c["value"] != ""))
    values = lambda aliases: F.transform(F.filter("found", lambda c: c["name"].isin(sorted({header_name(a) for a in aliases}))), lambda c: c["value"])
    first = lambda aliases: F.coalesce(F.get(values(aliases), 0), F.lit(""))
    out = {name: first(aliases) for name, aliases in EXPORTS[database].items() if name != "keywords"} | {"volume": first(VOLUME_ALIASES)}
    out["keywords"] = F.array_join(F.array_distinct(values(EXPORTS[database]["keywords"])), "; ")
    dois = F.filter(F.transform("found", lambda c: extract_doi(c["value"])), lambda x: x != "")
    out["doi"] = F.coalesce(F.nullif(out["doi"], F.lit("")), F.get(dois, 0), F.lit(""))
    display = DATABASES[database][0]
    constants = {"master_id": F.lit(""), "database": F.lit(display), "metadata_status": F.lit("IMPORTED"), "metadata_source": F.lit(f"{display} export")}
    return rows.select(F.struct("file", "row").alias("seq"), *[(out | constants)[c].alias(c) for c in CANONICAL])


def import_database(spark: SparkSession, database: str, path: str) -> DataFrame | None:
    """All records of a database's folder in order: NBIB before BibTeX before tables, files by name. None without files. They are kept, as
    whoever numbers them reads them more than once."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    found = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    if not found:
        return None
    parts = []
    if database == "pubmed":
        parts.append(nbib_records(read_nbib(spark, path)))
    parts.append(bibtex_records(read_bibtex(spark, path, recover_copyright=database == "compendex"), database))
    if database in EXPORTS:
        parts.append(table_records(read_table(spark, path), database))
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("seq", F.struct(F.lit(k).alias("format"), F.col("seq.file").alias("file"), F.col("seq.row").alias("row")))
        out = part if out is None else out.unionByName(part)
    return keep(out, "imported")
