"""The fold over components against one fold over all rows, and the matching rules."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from codexa.functions.text import DATABASES, normalize_database, normalize_doi, normalize_title
from codexa.operators import checkpoint as cp
from codexa.operators import resolve as rs
from codexa.operators.schema import CANONICAL, fallback_ids, map_export, standardize


def records(spark, rows):
    full = [tuple([k] + [r.get(c, "") for c in CANONICAL]) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, " + ", ".join(f"{c} string" for c in CANONICAL))


def random_rows(n, seed):
    r = random.Random(seed)
    pick = lambda *v: r.choice(v)
    return [
        {"source_id": pick("", "A", "B"), "database": pick("Scopus", "PubMed"), "title": pick("One", "Two", "óne", f"T{r.randrange(n)}"), "year": pick("", "2020", "2020.0"), "volume": pick("", "1", "1.0", "2"), "doi": pick("", "10.1/a", "https://doi.org/10.1/B", "10.1/c", f"10.1/{r.randrange(n)}"), "abstract": pick("", "text"), "metadata_source": pick("x", "y"), "metadata_status": pick("", "IMPORTED")}
        for _ in range(n)
    ]


@pytest.mark.parametrize("policy", [rs.INTERNAL, rs.MASTER])
def test_components_fold_like_one_fold(spark, policy):
    rows = random_rows(150, 5)
    df = records(spark, rows).withColumn("existing", F.lit(False))
    got = {r.seq: r for r in rs.fold(df, policy).collect()}
    keyed = df.withColumns({"_doi": normalize_doi(F.col("doi")), "_title": normalize_title(F.col("title")), "_db": normalize_database(F.col("database"))}).orderBy("seq").collect()
    state = rs.Fold(policy, df.columns)
    for row in (k.asDict() for k in keyed):
        hit = state.match(row)
        r = got[row["seq"]]
        if hit:
            assert (r.kept, r.matched, r.match_type) == (False, state.rows[hit[0]]["seq"], hit[1])
            state.absorb(hit[0], row)
        else:
            assert r.kept
            state.add(row)
    for row in state.rows:
        assert all(getattr(got[row["seq"]], c) == row[c] for c in CANONICAL)


def test_components_both_ways(spark):
    r = random.Random(4)
    keys = spark.createDataFrame([(i, f"k{r.randrange(60)}") for i in range(80) for _ in range(1 + i % 2)], "seq long, key string")
    assert sorted(map(tuple, rs.components(keys, 0).collect())) == sorted(map(tuple, rs.components(keys).collect()))


def test_joins_that_grow_are_not_broadcast(spark, monkeypatch):
    plans, kept = [], rs.keep

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(rs, "keep", noted)
    rs.components(spark.createDataFrame([(i, f"k{i // 2}") for i in range(40)], "seq long, key string"), 0)
    for df in (*rs.internal_dedup(records(spark, random_rows(60, 3))), rs.upsert(records(spark, random_rows(9, 1)), records(spark, random_rows(60, 2)).withColumn("seq", F.col("seq") + 100))[1]):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and sum("ShuffledHashJoin" in p for p in plans) > 5
    big = [p for p in plans if "Broadcast" in p.replace("__start", "") and "__part" not in p]
    assert not big  # but for the starts of ranges, a row for each partition


def test_fold_gets_no_texts_and_lets_survivors_go(spark):
    rows = records(spark, [{"title": "One", "doi": f"10.1/{i}", "abstract": f"text {i} " * 50 if i else "", "url": " u "} for i in range(6)] + [{"title": "One", "doi": "10.1/0", "abstract": "  taken ", "url": "w"}])
    done = rs.fold(rows.withColumn("existing", F.lit(False)), rs.MASTER)
    got = {r.seq: r for r in done.collect()}
    assert got[0].abstract == "taken" and got[0].url == " u " and not got[6].kept and got[6].abstract == "  taken " and got[6].fields_filled == "abstract"
    assert all(got[i].abstract == f"text {i} " * 50 for i in range(1, 6))
    state = rs.Fold(rs.MASTER, [])
    for i in range(3):
        state.add({"seq": i, "_title": "one", "_doi": "", "_db": ""})
    for i, row in enumerate(state.survivors()):
        assert row["kept"] and state.rows[i] == {}


def test_ambiguous_title_stays(spark):
    rows = [{"title": "Same", "volume": v} for v in ("1", "2", "")]
    unique, report = rs.internal_dedup(records(spark, rows))
    assert unique.count() == 3 and report.count() == 0


def test_doi_ignores_conflicts_and_fills(spark):
    rows = [{"title": "A", "doi": "10.1/x", "volume": "1"}, {"title": "B", "doi": "doi: 10.1/X.", "volume": "2", "abstract": "t"}]
    unique, report = rs.internal_dedup(records(spark, rows))
    assert [r.abstract for r in unique.collect()] == ["t"]
    assert [(r.duplicate_reason, r.matched_title) for r in report.collect()] == [("DOI", "A")]


def test_upsert_keeps_ids_and_reports(spark):
    first, _ = rs.upsert(records(spark, []), records(spark, [{"title": "A", "source_id": "S", "database": "Scopus"}, {"title": "B"}]))
    assert sorted(r.master_id for r in first.collect()) == ["MASTER-0001", "MASTER-0002"]
    more = records(spark, [{"title": "A", "source_id": "S", "database": "Scopus", "doi": "10.1/n"}, {"title": "C"}]).withColumn("seq", F.col("seq") + 10)
    second, report = rs.upsert(first, more)
    assert sorted((r.master_id, r.title, r.doi) for r in second.collect()) == [("MASTER-0001", "A", "10.1/n"), ("MASTER-0002", "B", ""), ("MASTER-0003", "C", "")]
    assert [(r.duplicate_reason, r.matched_master_id) for r in report.collect()] == [("SOURCE_ID", "MASTER-0001")]


def test_ids_grow_past_four_digits_and_odd_ones_stay(spark):
    df = spark.createDataFrame([(1, "MASTER-9999"), (2, ""), (3, "odd"), (4, None)], "seq long, master_id string")
    assert {r.seq: r.master_id for r in rs.assign_ids(df).collect()} == {1: "MASTER-9999", 2: "MASTER-10000", 3: "odd", 4: "MASTER-10001"}
    assert rs.invalid_ids(df).collect()[0].n == 2


def test_enrichment_merge_keeps_api_columns(spark):
    old = spark.createDataFrame([(0, "T", "", "NO_DOI", "")], "seq long, title string, doi string, springer_api_status string, database string")
    new = spark.createDataFrame([(5, "T", "https://doi.org/10.1/Q", "FOUND", "")], old.schema)
    (row,) = rs.merge_enrichment(old, new).collect()
    assert (row.doi, row.springer_api_status) == ("https://doi.org/10.1/Q", "")


def test_standardize_and_exports(spark):
    df = spark.createDataFrame([(1, " Ã ", "see 10.1234/AB.", "k", "k; j", "3")], ["seq", "Document Title", "Note", "Author Keywords", "Index Keywords", "Vol."])
    row = map_export(df, "scopus", F.col("seq"), skip=("seq",)).first()
    assert (row.title, row.doi, row.keywords, row.volume, row.database) == ("Ã", "10.1234/ab", "k; k; j", "3", "Scopus")
    blank = spark.createDataFrame([(1, ""), (2, "t"), (3, "u")], ["seq", "Título"])
    rows = fallback_ids(standardize(blank, "acm"), "acm").collect()
    assert sorted(r.source_id for r in rows) == ["ACM-0001", "ACM-0002"]


def test_preconditions(spark):
    with pytest.raises(ValueError, match="MASTER-1"):
        cp.preconditions(spark.createDataFrame([("MASTER-1",), ("MASTER-1",)], ["master_id"]))
    with pytest.raises(ValueError, match="title"):
        cp.require_columns(spark.range(1), ("id", "title"))


def test_swap_keeps_backup(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    cp.swap(spark.range(1), path)
    cp.swap(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    assert len([p for p in tmp_path.iterdir() if "backup" in p.name]) == 1
    cp.write_or_remove(spark.range(0), path)
    assert not (tmp_path / "t").exists()


def one_by_one(rows, internal):
    """The rules once more, record after record: (kept, matched, reason, filled) of each, and the survivors' texts."""

    def text(v):
        return (v or "").strip()

    def plain(v):
        return " ".join(re.findall("[a-z0-9]+", "".join(c for c in unicodedata.normalize("NFKD", text(v)) if not unicodedata.combining(c)).lower()))

    def doi(v):
        return re.sub(r"^doi\s*:\s*", "", re.sub(r"^https?://(dx\.)?doi\.org/", "", text(v).lower())).rstrip(".,; ")

    def number(v):
        return re.sub(r"^(\d+)\.0$", r"\1", text(v).lower())

    slugs = {plain(x): slug for slug, (name, _) in DATABASES.items() for x in (slug, name)}
    base = lambda v: slugs.get(plain(v), plain(v))
    unlike = lambda a, b: bool(a and b and a != b)
    survivors, found, by_doi, titles, out = [], [], {}, {}, []
    for k, r in enumerate(rows):
        def fits(s):
            return plain(s["title"]) == plain(r["title"]) and not unlike(doi(s["doi"]), doi(r["doi"])) and not unlike(number(s["volume"]), number(r["volume"]))

        def origin(s):
            return text(r["source_id"]) and text(s["source_id"]) == text(r["source_id"]) and base(s["database"]) == base(r["database"]) and not unlike(number(s["year"]), number(r["year"])) and not any(unlike(plain(s[c]), plain(r[c])) for c in ("publication", "authors"))

        hit, reason = by_doi.get(doi(r["doi"])) if doi(r["doi"]) else None, "DOI"
        if hit is None and plain(r["title"]):
            near = [i for i in titles.get(plain(r["title"]), []) if fits(survivors[i])]
            own = [] if internal else [i for i in near if origin(survivors[i])]
            hit, reason = (own[0], "SOURCE_ID") if len(own) == 1 else (near[0], "TITLE") if len(near) == 1 else (None, "")
        if hit is None:
            survivors.append(dict(r))
            found.append(k)
            hit, filled, kept = len(survivors) - 1, [], True
        else:
            s, kept = survivors[hit], False
            filled = [c for c in rs.FILLED if not text(s[c]) and text(r[c])]
            s.update({c: r[c] if internal else text(r[c]) for c in filled})
            if filled and not internal:
                sources = [x for x in s["metadata_source"].split(" | ") if x]
                s["metadata_source"] = " | ".join(sources + [r["metadata_source"]] * (r["metadata_source"] not in sources))
                if r["metadata_status"] and ("abstract" in filled or not s["metadata_status"]):
                    s["metadata_status"] = r["metadata_status"]
        for x in (r, survivors[hit]) if internal or kept else (survivors[hit],):
            if doi(x["doi"]):
                by_doi.setdefault(doi(x["doi"]), hit)
            if plain(x["title"]) and hit not in titles.setdefault(plain(x["title"]), []):
                titles[plain(x["title"])].append(hit)
        out.append((kept, None if kept else found[hit], "" if kept else reason, "; ".join(filled)))
    return out, dict(zip(found, survivors, strict=True))


@pytest.mark.parametrize("policy", [rs.INTERNAL, rs.MASTER])
@pytest.mark.parametrize("seed", [5, 6])
def test_fold_against_the_rules_one_by_one(spark, policy, seed):
    r = random.Random(seed)
    rows = random_rows(160, seed)
    for row in rows:
        row["database"] = r.choice(("Scopus", "scopus", "IEEE Xplore", "ieee", "PubMed"))
        row["doi"] = r.choice((row["doi"], row["doi"], "doi:", " "))
        row |= {"authors": r.choice(("", "A. B.", "Ä b")), "keywords": r.choice(("", " k ")), "publication": r.choice(("", "P"))}
    full = [{c: x.get(c, "") for c in CANONICAL} for x in rows]
    want, survivors = one_by_one(full, policy is rs.INTERNAL)
    got = rs.fold(records(spark, rows).withColumn("existing", F.lit(False)), policy).orderBy("seq").collect()
    assert [(x.kept, x.matched, x.match_type, x.fields_filled) for x in got] == want
    assert {x.seq: {c: x[c] for c in CANONICAL} for x in got if x.kept} == survivors
    assert {x.match_type for x in got} >= {"DOI", "TITLE"} and any(x.fields_filled for x in got)


def test_slug_and_name_are_one_origin(spark):
    rows = [{"title": "T", "volume": "1", "source_id": "9", "database": "IEEE Xplore"}, {"title": "T", "volume": "2", "source_id": "8", "database": "IEEE Xplore"}, {"title": "T", "source_id": "9", "database": "ieee", "abstract": "late"}]
    incoming = records(spark, rows)
    master, report = rs.upsert(records(spark, []), incoming)
    (row,) = report.collect()
    assert (row.duplicate_reason, row.matched_master_id, row.matched_database, row.fields_filled, row.metadata_update_source) == ("SOURCE_ID", "MASTER-0001", "IEEE Xplore", "abstract", "")
    assert rs.update_counts(incoming, report) == {"read": 3, "added": 2, "duplicates": 1, "enriched": 1} and master.count() == 2


def test_unreadable_doi_text_stays_and_leads_nowhere(spark):
    rows = [{"title": "A", "doi": d} for d in ("doi:", "10.1/x", "10.1/y")]
    unique, report = rs.internal_dedup(records(spark, rows))
    assert [r.doi for r in unique.collect()] == ["doi:"] and report.count() == 2


def test_merge_resets_no_doi_for_a_doi_only(spark):
    old = spark.createDataFrame([(0, "T", "", "NO_DOI", "")], "seq long, title string, doi string, springer_api_status string, database string")
    for text, status in (("doi:", "NO_DOI"), ("10.1/Q", "")):
        (row,) = rs.merge_enrichment(old, spark.createDataFrame([(5, "T", text, "FOUND", "")], old.schema)).collect()
        assert (row.doi, row.springer_api_status) == (text, status)


def test_a_title_of_many_records_is_not_searched_through(monkeypatch):
    """What a record is held against doesn't grow with the survivors of its title, and survivors are found where fills have put them."""
    from codexa.operators.schema import CANONICAL

    def compared(n: int) -> float:
        state, calls, differ = rs.Fold(rs.MASTER, list(CANONICAL)), 0, rs._differ

        def counted(a, b):
            nonlocal calls
            calls += 1
            return differ(a, b)

        monkeypatch.setattr(rs, "_differ", counted)
        for k in range(n):  # no two agree in DOI or, without one, in volume
            doi, volume = (f"10.1/{k}", "") if k % 2 else ("", "") if not k else (f"10.2/{k}", str(k))
            row = dict.fromkeys(CANONICAL, "") | {"seq": k, "source_id": "S", "title": "One", "volume": volume, "doi": doi, "_doi": doi, "_title": "one", "_db": "acm"}
            state.add(row)
            state.match(row | {"_doi": f"10.3/{k}", "doi": f"10.3/{k}"})
        monkeypatch.setattr(rs, "_differ", differ)
        return calls / n

    assert compared(800) < 2 * compared(100) + 5


def test_pairs_of_keys_are_joined_once(spark, monkeypatch):
    """Components by pairs of keys are those of records, and what rounds go over is no more when records come again."""
    given, kept = [], rs.components
    monkeypatch.setattr(rs, "components", lambda keys: given.append(keys.count()) or kept(keys))
    rows = [(0, 1, 10), (1, 2, 10), (2, 2, 0), (3, 3, 0), (4, 0, 11), (5, 4, 11), (6, 4, 12), (7, 5, 13), (8, 0, 0), (9, 3, 0), (10, 0, 14)]
    for more in (rows, rows + [(s + 100, t, d) for s, t, d in rows if s in (0, 1, 2, 3, 4, 5, 6, 9)]):
        found = {(r["_kt"], r["_kd"]): r["comp"] for r in rs.pair_components(spark.createDataFrame(more, "seq long, _kt long, _kd long")).collect()}
        groups = {}
        for pair, comp in found.items():
            groups.setdefault(comp, set()).add(pair)
        assert sorted(map(sorted, groups.values())) == [[(0, 11), (4, 11), (4, 12)], [(1, 10), (2, 0), (2, 10)], [(3, 0)]]
    assert given[0] == given[1] < 8
