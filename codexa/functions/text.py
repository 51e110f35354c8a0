"""Text normalisation as Column -> Column functions. The missing marker is the empty string throughout."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trailing punctuation of a DOI, and the DOI pattern.
DOI_TAIL = ".,;:]}>'\""
DOI_PATTERN = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
#: Names of the six databases in their order of precedence, and the aliases that records use.
DATABASES = {
    "ieee": ("IEEE Xplore", ("IEEE", "IEEE Xplore")),
    "pubmed": ("PubMed", ("PubMed",)),
    "acm": ("ACM Digital Library", ("ACM", "ACM Digital Library")),
    "scopus": ("Scopus", ("Scopus",)),
    "compendex": ("Engineering Village / Compendex", ("Compendex", "El Compendex", "Engineering Village", "Engineering Village / Compendex")),
    "springer": ("Springer Link", ("Springer", "Springer Link", "Springer Nature")),
}


#: White space in the Unicode sense, and the four separators that Python strips too.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def safe_text(c: Column) -> Column:
    """Null becomes empty; white space in the Unicode sense goes from both ends, by a trim that looks at the ends only."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(WHITE))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(safe_text(c), F.lit("")) for c in cols], F.lit(""))


def combine_unique(*cols: Column) -> Column:
    """Distinct values in first-seen order, joined by "; "."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[safe_text(c) for c in cols]), lambda x: x != "")), "; ")


def _strip_accents(s: pd.Series) -> pd.Series:
    """NFKD without combining characters; plain ASCII values pass untouched."""

    def one(x):
        if x is None or x.isascii():
            return x
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(one)


def strip_accents(c: Column) -> Column:
    """NFKD without combining characters. Python sees only values that are not plain ASCII; the others pass natively."""
    return F.coalesce(F.pandas_udf(_strip_accents, "string")(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


#: An entity that a semicolon closes.
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _unescape_closed(s: pd.Series) -> pd.Series:
    """Entities that a semicolon closes; `&amp` without one stays, as do names that no entity has."""
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]
    return s.map(lambda x: ENTITY.sub(one, x) if x and "&" in x else x)


def clean_html(c: Column, closed: bool = False) -> Column:
    """Entities first, then tags to spaces, then white space to single spaces. closed: only entities that a semicolon closes, so that
    a text cut off within one keeps what is left of it; else as browsers do, `&amp` too."""
    unescape = F.pandas_udf(_unescape_closed if closed else _unescape, "string")
    text = F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), r"<[^>]+>", " ")
    return safe_text(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_title(c: Column) -> Column:
    """Accents off, lower case, all but a-z and 0-9 to single spaces; a title in another script becomes empty."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(safe_text(c))), r"[^a-z0-9]+", " "))


def normalize_database_text(c: Column) -> Column:
    return normalize_title(c)


def normalize_doi(c: Column) -> Column:
    text = F.lower(safe_text(c))
    text = F.regexp_replace(text, r"^https?://(dx\.)?doi\.org/", "")
    return F.rtrim(F.regexp_replace(text, r"(?U)^doi\s*:\s*", ""), F.lit(".,; "))


def extract_doi(c: Column) -> Column:
    """The first DOI in a text, without trailing punctuation and without a closing bracket that none opens."""
    found = F.rtrim(F.regexp_extract(safe_text(c), DOI_PATTERN, 0), F.lit(DOI_TAIL))
    opened, closed = (F.length(found) - F.length(F.replace(found, F.lit(b), F.lit(""))) for b in "()")
    cut = F.when(found.endswith(")") & (opened < closed), F.regexp_replace(found, r"\)$", "")).otherwise(found)
    return normalize_doi(cut)


def extract_doi_from_values(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(extract_doi(c), F.lit("")) for c in cols], F.lit(""))


def recover_doi(doi: Column, url: Column, source_id: Column) -> Column:
    """A DOI found in doi, url or source_id, in that order; a text without one stays as it is."""
    found = extract_doi_from_values(doi, url, source_id)
    return F.when(found != "", found).otherwise(safe_text(doi))


def normalize_volume(c: Column) -> Column:
    text = F.lower(safe_text(c))
    return safe_text(F.regexp_replace(F.regexp_replace(text, r"^(\d+)\.0$", "$1"), r"(?U)\s+", " "))


def clean_year(c: Column) -> Column:
    text = safe_text(c)
    year = F.regexp_extract(text, r"(?U)\b((19|20)\d{2})\b", 1)
    return F.when(year != "", year).otherwise(text)


def clean_bibtex_value(c: Column) -> Column:
    """One layer of braces, then one of quotes; white space to single spaces."""
    text = safe_text(c)
    text = F.when(text.rlike(r"(?s)^\{.*\}$"), safe_text(F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1))).otherwise(text)
    text = F.when(text.rlike(r'(?s)^".*"$'), safe_text(F.regexp_extract(text, r'(?s)^"(.*)"$', 1))).otherwise(text)
    return safe_text(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_database(c: Column) -> Column:
    """The slug of a database's slug or display name; another name in header form."""
    name = F.regexp_replace(normalize_title(c), " ", "_")
    out = name
    for slug, (display, _) in DATABASES.items():
        out = F.when(name.isin(header_name(slug), header_name(display)), F.lit(slug)).otherwise(out)
    return out


def belongs_to(c: Column, slug: str) -> Column:
    """Whether a record's database value is one of the aliases of a database."""
    return normalize_database_text(c).isin(sorted({header_name(a).replace("_", " ") for a in DATABASES[slug][1]}))


def header_name(value: str) -> str:
    """Of a column header: accents off, lower case, runs of other characters to one underscore. Driver-side: headers are few."""
    text = "".join(x for x in unicodedata.normalize("NFKD", str(value or "").strip()) if not unicodedata.combining(x)).lower()
    return re.sub(r"[^a-z0-9]+", "_", text).strip("_")


def master_number(c: Column) -> Column:
    """The number of MASTER-n as a long, null if the id has another form."""
    return F.nullif(F.regexp_extract(F.upper(safe_text(c)), r"^MASTER-(\d+)$", 1), F.lit("")).cast("long")


def format_master_id(c: Column) -> Column:
    return F.format_string("MASTER-%04d", c.cast("long"))


def json_text(c: Column) -> Column:
    """A JSON string literal that leaves non-ASCII characters as they are. Spark's own writer escapes in one pass; only its codes of control
    characters are written in other letters, so texts that show one are escaped character by character."""
    text = c
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    for code in range(0x20):
        if code not in (8, 9, 10, 12, 13):
            text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    every = F.concat(F.lit('"'), text, F.lit('"'))
    # of {"a":"..."} the value; in a lambda, so that it is written once
    written = F.transform(F.array(F.to_json(F.struct(c.alias("a")))), lambda j: F.when(j.contains("\\u00"), every).otherwise(F.substring(j, F.lit(6), F.length(j) - 6)))
    return F.when(c.isNotNull(), F.element_at(written, 1))


def record_keys(doi: Column, title: Column) -> tuple[Column, Column]:
    """The keys by which records are told apart: of the DOI and of the title; blank without one."""
    return normalize_doi(doi), normalize_title(title)


def plain_text(c: Column) -> Column:
    """Accents off, lower case, white space to single spaces; punctuation stays."""
    return safe_text(F.regexp_replace(F.lower(strip_accents(safe_text(c))), r"(?U)[\s\x1c-\x1f]+", " "))


def combined_metadata(title: Column, abstract: Column, keywords: Column) -> Column:
    return plain_text(F.concat_ws(" ", *[safe_text(c) for c in (title, abstract, keywords)]))


def metadata_fingerprint(title: Column, abstract: Column, keywords: Column) -> Column:
    """SHA-256 of the JSON object of abstract, keywords and title, in that order."""
    parts = []
    for name, c in (("abstract", abstract), ("keywords", keywords), ("title", title)):
        parts += [F.lit(("{" if not parts else ", ") + f'"{name}": '), json_text(safe_text(c))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def keywords_of_payload(c: Column) -> Column:
    """Keywords of an API's JSON payload: `keyword` before `keywords`; a list is joined by "; ", a scalar is text."""
    out = []
    for name in ("keyword", "keywords"):
        raw = F.get_json_object(c, f"$.{name}")
        items = F.from_json(raw, "array<string>")
        joined = F.array_join(F.filter(F.transform(items, safe_text), lambda x: x != ""), "; ")
        out.append(F.nullif(F.when(raw.startswith("["), joined).otherwise(safe_text(raw)), F.lit("")))
    return F.coalesce(*out, F.lit(""))
