"""Mapping of source columns to the canonical schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import DATABASES, clean_year, combine_unique, extract_doi_from_values, first_non_empty, header_name, normalize_doi, recover_doi, safe_text

#: The canonical columns in order.
CANONICAL = ("master_id", "source_id", "database", "title", "authors", "year", "publication", "volume", "document_type", "doi", "abstract", "keywords", "url", "metadata_status", "metadata_source")
#: Headers that general tables use for a canonical column.
ALIASES = {
    "master_id": ("master_id", "master id", "master-id"),
    "source_id": ("source_id", "source id", "id", "id_origem", "id origem", "record_id", "record id"),
    "database": ("database", "base", "source_database", "source database"),
    "title": ("title", "titulo", "título"),
    "authors": ("authors", "author", "autores", "autor"),
    "year": ("year", "ano", "publication_year", "publication year"),
    "publication": ("publication", "journal", "source", "venue", "publicacao", "publicação"),
    "document_type": ("document_type", "document type", "content_type", "content type", "tipo_documento", "tipo documento", "tipo"),
    "doi": ("doi",),
    "abstract": ("abstract", "abstract_api", "resumo"),
    "keywords": ("keywords", "keywords_api", "keyword", "palavras_chave", "palavras-chave", "palavras chave"),
    "url": ("url", "link", "article_url", "article url"),
    "metadata_status": ("metadata_status", "metadata status", "status_metadata", "status metadata", "status_api"),
    "metadata_source": ("metadata_source", "metadata source", "fonte_metadados", "fonte metadados", "fonte_api"),
}
#: Headers of the databases' own exports.
EXPORTS = {
    "acm": {
        "source_id": ("id", "citation key", "article number", "acm id"),
        "title": ("title", "article title"),
        "authors": ("authors", "author", "author names"),
        "year": ("year", "publication year", "date"),
        "publication": ("publication title", "booktitle", "journal", "proceedings", "conference"),
        "document_type": ("document type", "content type", "publication type", "type"),
        "doi": ("doi", "digital object identifier"),
        "abstract": ("abstract", "abstract text"),
        "keywords": ("keywords", "author keywords", "index terms", "ccs concepts"),
        "url": ("url", "link", "doi url", "article url"),
    },
    "scopus": {
        "source_id": ("eid", "id", "scopus id"),
        "title": ("title", "document title"),
        "authors": ("authors", "author full names", "author names"),
        "year": ("year", "publication year", "cover date"),
        "publication": ("source title", "publication name", "journal", "source"),
        "document_type": ("document type", "publication type", "type"),
        "doi": ("doi", "digital object identifier"),
        "abstract": ("abstract", "abstract text"),
        "keywords": ("author keywords", "index keywords", "keywords", "controlled terms"),
        "url": ("link", "url", "document url", "doi url"),
    },
    "compendex": {
        "source_id": ("accession number", "accession no", "accession number (an)", "record id", "id"),
        "title": ("title", "document title", "article title"),
        "authors": ("authors", "author", "author names"),
        "year": ("year", "publication year", "date", "publication date"),
        "publication": ("source", "source title", "publication", "journal", "conference title"),
        "document_type": ("document type", "publication type", "content type", "type"),
        "doi": ("doi", "digital object identifier"),
        "abstract": ("abstract", "abstract text"),
        "keywords": ("author keywords", "controlled terms", "uncontrolled terms", "index terms", "keywords"),
        "url": ("url", "link", "document url", "doi url"),
    },
    "springer": {
        "source_id": ("item id", "record id", "identifier", "id"),
        "title": ("item title", "title", "article title", "chapter title"),
        "authors": ("authors", "author", "creator"),
        "year": ("publication year", "year", "date published", "publication date", "online date"),
        "publication": ("publication title", "journal title", "book title", "book series title", "publication", "journal"),
        "document_type": ("content type", "document type", "publication type", "type"),
        "doi": ("item doi", "doi", "digital object identifier"),
        "abstract": ("abstract", "abstract text", "description"),
        "keywords": ("keywords", "keyword", "subject terms", "subjects"),
        "url": ("url", "item url", "link", "doi url"),
    },
}
#: Headers of a volume that all exports share.
VOLUME_ALIASES = ("volume", "vol", "vol.", "volume number", "volume no", "volume no.", "journal volume", "book series volume")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def discover(columns: list[str], aliases: tuple) -> list[Column]:
    """The columns whose header is among the aliases, in table order."""
    wanted = {header_name(a) for a in aliases}
    return [quoted(c) for c in columns if header_name(c) in wanted]


def map_export(df: DataFrame, database: str, seq: Column, skip: tuple = ()) -> DataFrame:
    """A tabular export in canonical columns: first non-empty header, keywords combined, a DOI sought in the whole row."""
    headers, columns = EXPORTS[database], [c for c in df.columns if c not in skip]
    out = {}
    for name, aliases in headers.items():
        found = discover(columns, aliases)
        out[name] = (combine_unique if name == "keywords" else first_non_empty)(*found) if found else F.lit("")
    out["volume"] = first_non_empty(*found) if (found := discover(columns, VOLUME_ALIASES)) else F.lit("")
    out["doi"] = F.coalesce(F.nullif(safe_text(out["doi"]), F.lit("")), extract_doi_from_values(*[quoted(c) for c in columns]))
    display = DATABASES[database][0]
    constants = {"master_id": F.lit(""), "database": F.lit(display), "metadata_status": F.lit("IMPORTED"), "metadata_source": F.lit(f"{display} export")}
    return df.select(seq.alias("seq"), *[(out | constants)[c].alias(c) for c in CANONICAL])


def standardize(df: DataFrame, database: str = "", seq: str = "seq") -> DataFrame:
    """seq and the canonical columns of any table; a blank database gets the default, DOIs are normalised, blank titles go."""
    out = []
    for name in CANONICAL:
        found = discover([c for c in df.columns if c != seq], ALIASES.get(name, (name,)))
        c = first_non_empty(*found) if found else F.lit("")
        if name == "database" and database:
            c = F.when(c == "", F.lit(DATABASES.get(database, (database,))[0])).otherwise(c)
        out.append((normalize_doi(c) if name == "doi" else c).alias(name))
    return df.select(F.col(seq).alias("seq"), *out).where(F.col("title") != "")


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows, kept, in ranges of the order, with `__position` 1, 2, ... and `__before`, the row before in the same range as a struct of
    the order: ranges are sorted by themselves, and their row counts (one for each partition) give where each starts."""
    from .resolve import keep

    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = keep(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    starts, at = [], 0
    for r in part.groupBy("__part").count().orderBy("__part").collect():
        starts.append((r["__part"], at))
        at += r["count"]
    inside = W.partitionBy("__part").orderBy(*order)
    rows = part.withColumns({"__row": F.row_number().over(inside), "__before": F.lag(F.struct(*order)).over(inside)})
    rows = rows.join(F.broadcast(spark.createDataFrame(starts, "__part int, __start long")), "__part")
    return rows.withColumn("__position", F.col("__start") + F.col("__row")).drop("__part", "__start", "__row")


def ranked(df: DataFrame, order: str = "seq") -> DataFrame:
    """Adds `position`, 1, 2, ... in the given order, without one window over all rows: positions are worked out for the order's
    values alone and joined back. A repeated value is an error when the rows are read."""
    same = F.col("__before") == F.struct(order)
    twice = F.raise_error(F.concat(F.lit(f"repeated {order}: "), F.to_json(F.struct(order)))).cast("long")
    placed = _ranges(df.select(order), [order]).select(order, F.when(same, twice).otherwise(F.col("__position")).alias("position"))
    return df.join(placed.hint("shuffle_hash"), order)  # by a shuffle, as it grows with the rows


def numbered(df: DataFrame) -> DataFrame:
    """Adds `position`, 1, 2, ... in the order of all columns; equal rows get numbers of their own, and it does not matter which."""
    return _ranges(df, df.columns).withColumnRenamed("__position", "position").drop("__before")


def fallback_ids(df: DataFrame, database: str) -> DataFrame:
    """Blank source ids become DB-0001, ... by the position among all rows."""
    rows = ranked(df)
    made = F.concat(F.lit(database.upper() + "-"), F.format_string("%04d", F.col("position")))
    return rows.withColumn("source_id", F.when(F.col("source_id") == "", made).otherwise(F.col("source_id"))).drop("position")


def finalize(df: DataFrame, database: str) -> DataFrame:
    """Canonical, DOIs recovered, ids filled, years cut: ready for deduplication."""
    rows = standardize(df, database).withColumn("doi", recover_doi(F.col("doi"), F.col("url"), F.col("source_id")))
    return fallback_ids(rows, database).withColumn("year", clean_year(F.col("year")))
