"""Readers of exports, enrichment, and every query against its SQL on the smallest tables."""

import glob
import os
import zipfile

import duckdb
import pytest

from codexa import queries as own
from codexa.plans import enrichment as en
from codexa.sources import bibliography as src

DATA = "/root/testdata/sf0.001"


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_bibtex(spark, tmp_path):
    write(tmp_path, "b.bib", "@string{j = {Journal}}\n@article{k1, title={A {B} c}, journal = j # \" X\", year=2020, note={n}, DOI={https://doi.org/10.1234/Z}}\n@comment{x}\n@inproceedings{, title = \"Q\"}")
    write(tmp_path, "a.BIB", "@book{z, title={First}, keyword={p}, keywords={q}}")
    rows = src.bibtex_records(src.read_bibtex(spark, str(tmp_path)), "acm").orderBy("seq").collect()
    assert [r.title for r in rows] == ["First", "A {B} c", "Q"]
    assert rows[0].keywords == "q; p" and rows[1].publication == "Journal X" and rows[1].keywords == "" and rows[1].doi == "10.1234/z"
    assert rows[2].document_type == "inproceedings"


def test_bibtex_repeated_fields(spark, tmp_path):
    write(tmp_path, "a.bib", "@article{k, title={T}, copyright={1}, copyright={2}, key={w}}")
    with pytest.raises(ValueError, match="DuplicateFieldKeyBlock"):
        src.read_bibtex(spark, str(tmp_path))
    row = src.bibtex_records(src.read_bibtex(spark, str(tmp_path), recover_copyright=True), "compendex").first()
    assert row.title == "T" and row.keywords == "w"


def test_bibtex_junk_fails_and_many_entries_are_quick():
    import time

    (entry,) = src.parse_bibtex("@article{k, title={T}, year=2020 %junk note={y}}")
    assert entry["error"] == "ParsingFailedBlock"
    began = time.time()
    found = list(src.parse_bibtex("".join(f"@article{{k{i},\n title={{T}},\n}}\n\n" for i in range(20_000))))
    assert len(found) == 20_000 and found[-1]["line"] == 4 * 19_999 and not found[-1]["error"] and time.time() - began < 5


def test_nbib(spark, tmp_path):
    write(tmp_path, "x.nbib", "PMID- 1\nTI  - A title\n      goes on\nFAU - One\nFAU - Two\nLID - 10.1234/q [doi]\nOT  - k\nMH  - k\nMH  - m\n\nTI  - Second\nVI  - 7\n")
    a, b = src.nbib_records(src.read_nbib(spark, str(tmp_path))).orderBy("seq").collect()
    assert (a.source_id, a.title, a.authors, a.doi, a.keywords) == ("1", "A title goes on", "One; Two", "10.1234/q", "k; m")
    assert (b.source_id, b.volume, b.url) == ("PUBMED-0002", "7", "")


def test_html_with_entities_that_are_cut_off(spark, tmp_path):
    pages = ["<title>a &amp</title>b &amp; c&amp;amp;&copy;&middot;&quot;", "x &copy 2 &ampy; &nosuch; &amp", None, "<p>&quot</p>", ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {k: v or "" for k, v in con.sql(own.SQL["clean_html_pages"]).fetchall()}
    got = {r.page_id: r.text for r in own.QUERIES["clean_html_pages"](spark, str(tmp_path)).collect()}
    assert got == want and "a &amp b" in got[0]


def test_delimiter_of_texts_full_of_other_signs():
    head = "EID;Document Title;Authors;Year\n"
    shout = "".join(f'S{k};"{"LY!! RETIOR,!! TO!! | THEA!! " * 40}";src{k};20{k:02d}\n' for k in range(20))
    assert src.sniff((head + shout)[:8192]) == ";" and src.sniff(head) == ";"
    assert src.sniff(head + f'S1;"{"a, b,\n" * 2000}') == ";"  # the first record does not end in the sample
    assert src.sniff("a|b|c\n1,2|3|4,5\n") == "|" and src.sniff("a\tb\n1\t2;3;4\n") == "\t"
    assert src.sniff("Title\nOne, two\n") == "," and src.sniff("") == ","


def test_files_given_as_rows_are_handed_on_in_parts(spark, monkeypatch):
    """A task holds no batch of files with all that is parsed of them: no UDF over the files, and parts across their bounds."""
    text = "".join(f"PMID- {k}\nTI  - Title {k}\n\n" for k in range(700))
    contents = spark.createDataFrame([(f, f"{f}.nbib", bytearray(text.encode())) for f in range(4)] + [(4, "none.nbib", bytearray()), (5, "null.nbib", None)], "file int, name string, content binary").coalesce(1)
    found = src.nbib_tags(contents)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    got = sorted((r.file, r.row, r.tags[1].value) for r in found.collect())
    assert got == [(f, k, f"Title {k}") for f in range(4) for k in range(700)]


def test_tables(spark, tmp_path):
    write(tmp_path, "a.csv", 'EID;Title;Volume\n1;"x; y";2\n')
    (tmp_path / "b.csv").write_bytes("Title,EID\nCaf\xe9,9\n".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Title</t></si><si><t>Z</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    rows = src.import_database(spark, "scopus", str(tmp_path)).orderBy("seq").collect()
    assert [(r.title, r.source_id, r.volume) for r in rows] == [("x; y", "1", "2"), ("Café", "9", ""), ("Z", "", "")]


def test_provider_statuses():
    answers = iter([(500, ""), (200, '{"records": []}'), (200, "no"), (429, ""), (403, "")])
    ask = en.with_retries(lambda doi: next(answers), wait=lambda s: None)
    assert [ask("d")[0] for _ in range(4)] == ["NOT_FOUND", "ERROR", "RATE_LIMIT", "AUTH_OR_QUOTA_ERROR"]
    assert ask("")[0] == "NO_DOI"


def test_call_stops(spark):
    rows = own.api_rows(spark, DATA)
    planned = en.plan(rows, 20)
    got = en.call(planned, lambda doi: ("RATE_LIMIT" if doi.endswith("0") else "NOT_FOUND", None, "")).collect()
    stops = [r for r in got if r.status == "RATE_LIMIT"]
    assert len(got) <= 20 and len(stops) <= 1


def same(a, b):
    def norm(d):
        d = d[sorted(d.columns)].copy()
        for c in d.columns:
            d[c] = d[c].map(lambda v: "None" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
        return d.sort_values(list(d.columns)).reset_index(drop=True)

    a, b = norm(a), norm(b)
    return list(a.columns) == list(b.columns) and a.equals(b)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert same(own.QUERIES[name](spark, DATA).toPandas(), con.sql(own.SQL[name]).df())




def test_imported_records_are_kept(spark, tmp_path):
    """Numbering and finalizing read the records several times, which parsed the files' values again each time."""
    (tmp_path / "x.bib").write_text("@article{a, title={A}, doi={10.1234/a}}\n@article{b, title={B}}\n")
    rows = src.import_database(spark, "acm", f"file://{tmp_path}")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "fields" not in plan and [r.title for r in rows.orderBy("seq").collect()] == ["A", "B"]
