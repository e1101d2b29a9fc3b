import csv
from datetime import date
from types import SimpleNamespace

import pytest
from tables import values

from rxcohort.operators import cohorts
from rxcohort.operators.codelists import named
from rxcohort.sources import csv as csv_source
from rxcohort.sources import store as parquet_store
from rxcohort.sources.proxy import TARGET, ProxyCdm
from rxcohort.schema import COLUMN_TYPES, CORE_TABLES


@pytest.fixture
def place(tmp_path):
    return SimpleNamespace(csv=tmp_path / "in", store=str(tmp_path / "store"))


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


DRUGS = (
    "drug_exposure_id,person_id,drug_concept_id,drug_exposure_start_date,drug_exposure_end_date,days_supply,note\n"
    '900,1,7,2001-02-03,,30,"a, ""b"""\n'
    "901,2,7,2001-02-04 00:00:00,2001-03-01,,\n"
    "902,,7,2001-02-05,,,\n"
)


def load(spark, place):
    status = csv_source.load_cdm(spark, str(place.csv), place.store).collect()
    return {(r["table"], r["path"].rsplit("/in/")[1]): (r["loaded"], r["error"]) for r in status}


def test_directory_of_csv_tables(spark, place):
    put(place.csv / "nested" / "deep" / "DRUG_EXPOSURE.csv", DRUGS)
    put(place.csv / "nested" / "._PERSON.csv", "\0\0junk")
    put(place.csv / "Person.csv", "person_id,gender_concept_id,year_of_birth\n1,8507,1960\n2,8532,1970\n")
    put(place.csv / "death.csv", "person_id,death_date\n")
    put(place.csv / "concept.csv", "concept_id\tconcept_name\tvocabulary_id\n7\tIbuprofen, oral\tRxNorm\n8\t\tRxNorm\n")
    put(place.csv / "condition_occurrence.csv", "person_id,condition_concept_id\n1,2\n")
    put(place.csv / "measurement.csv", "a,b\n1,2\n3,4,5\n")
    put(place.csv / "observation.csv", "person_id,value\n1,2\n")
    put(place.csv / "notes.txt", "not a table")
    status = load(spark, place)
    loaded = {key[0] for key, (ok, _) in status.items() if ok}
    assert loaded == {"DRUG_EXPOSURE", "PERSON", "DEATH", "CONCEPT", "OBSERVATION"}
    assert status[("CONDITION_OCCURRENCE", "condition_occurrence.csv")][1].endswith("missing columns condition_start_date")
    assert status[("MEASUREMENT", "measurement.csv")][1]
    assert len(status) == 7

    drugs = parquet_store.read_table(spark, place.store, "drug_exposure")
    types = dict(drugs.dtypes)
    assert {c: types[c] for c in COLUMN_TYPES["drug_exposure"]} == COLUMN_TYPES["drug_exposure"]
    assert values(drugs.select("person_id", "drug_exposure_start_date", "days_supply", "note")) == [
        (1, date(2001, 2, 3), 30, 'a, "b"'),
        (2, date(2001, 2, 4), None, None),
        (None, date(2001, 2, 5), None, None),
    ]
    assert values(parquet_store.read_table(spark, place.store, "Concept")) == [
        (7, "Ibuprofen, oral", "RxNorm"), (8, None, "RxNorm"),
    ]
    assert parquet_store.read_table(spark, place.store, "DEATH").count() == 0

    tables = {t: parquet_store.read_table(spark, place.store, t) for t in loaded}
    counts = values(parquet_store.core_row_counts(spark, tables))
    expected = {"PERSON": 2, "DRUG_EXPOSURE": 3, "OBSERVATION": 1, "DEATH": 0}
    assert counts == sorted((t, expected.get(t)) for t in CORE_TABLES)


@pytest.mark.parametrize(
    "table, row",
    [
        ("person", "1.9,8507,1960"),
        ("person", "1,8507,1980.7"),
        ("person", "1,8507,true"),
        ("drug_exposure", "1,2,2000-01-01,2000-01-02,true"),
        ("drug_exposure", "1,2,01.02.2000,2000-01-02,3"),
    ],
)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_no_value_is_changed_to_fit(spark, place, table, row, ansi):
    header = {"person": "person_id,gender_concept_id,year_of_birth", "drug_exposure": ",".join(COLUMN_TYPES["drug_exposure"])}
    put(place.csv / f"{table}.csv", f"{header[table]}\n{row}\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert [ok for ok, _ in load(spark, place).values()] == [False]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_table_in_many_files(spark, place):
    header = "person_id,gender_concept_id,year_of_birth,note\n"
    for i in range(3):
        put(place.csv / "PERSON" / f"part-{i}.csv", f"{header}{i},1,190{i},{'x' if i else i}\n")
    put(place.csv / "death.csv", "person_id\n1\n")
    status = csv_source.load_cdm(spark, str(place.csv), place.store, in_parts=["person"]).collect()
    assert sorted((r["table"], r["loaded"]) for r in status) == [("DEATH", True)] + [("PERSON", True)] * 3
    stored = parquet_store.read_table(spark, place.store, "person")
    assert values(stored.select("person_id", "note")) == [(0, "0"), (1, "x"), (2, "x")]
    put(place.csv / "PERSON" / "part-3.csv", "person_id,year_of_birth,gender_concept_id,note\n9,1909,1,x\n")
    again = csv_source.load_cdm(spark, str(place.csv), place.store, in_parts=["person"]).collect()
    assert [r["loaded"] for r in again if r["table"] == "PERSON"] == [False] * 4  # a part with another header
    assert parquet_store.read_table(spark, place.store, "person").count() == 3


def test_paths_that_look_like_patterns(spark, place):
    for i, folder in enumerate(["set[1]", "p{q,r}", "s pace"]):
        put(place.csv / folder / f"t{i}.csv", f"a\n{i}\n")
    assert all(ok for ok, _ in load(spark, place).values())
    assert [values(parquet_store.read_table(spark, place.store, f"t{i}")) for i in range(3)] == [[(0,)], [(1,)], [(2,)]]


def test_failed_write_keeps_the_old_table(spark, place):
    old = spark.range(3)
    parquet_store.write_table(old, place.store, "note")
    broken = spark.range(3).selectExpr("IF(id = 2, raise_error('broken'), id) AS id")
    with pytest.raises(Exception, match="broken"):
        parquet_store.write_table(broken, place.store, "note")
    assert parquet_store.read_table(spark, place.store, "note").count() == 3
    parquet_store.write_table(spark.range(5), place.store, "note")
    assert parquet_store.read_table(spark, place.store, "note").count() == 5


def test_values_that_do_not_fit_are_reported(spark, place):
    put(place.csv / "person.csv", "person_id,gender_concept_id,year_of_birth\n1,8507,unknown\n")
    ok, error = load(spark, place)[("PERSON", "person.csv")]
    assert not ok and error
    assert not parquet_store.has_table(spark, place.store, "nothing")


def test_last_readable_file_of_a_table_wins_and_reload_replaces(spark, place):
    header = "person_id,gender_concept_id,year_of_birth\n"
    put(place.csv / "a" / "person.csv", header + "1,1,1901\n")
    put(place.csv / "b" / "PERSON.csv", header + "2,1,1902\n")
    put(place.csv / "c" / "person.csv", header + "3,1,bad\n")
    status = load(spark, place)
    assert [status[("PERSON", p)][0] for p in ("a/person.csv", "b/PERSON.csv", "c/person.csv")] == [False, True, False]
    assert "replaced by" in status[("PERSON", "a/person.csv")][1]
    read = lambda: [r[0] for r in parquet_store.read_table(spark, place.store, "person").select("person_id").collect()]
    assert read() == [2]
    put(place.csv / "b" / "PERSON.csv", header + "2,1,1902\n4,1,1904\n")
    load(spark, place)
    assert sorted(read()) == [2, 4]


def test_failed_reload_keeps_the_old_table(spark, place):
    header = "person_id,gender_concept_id,year_of_birth\n"
    put(place.csv / "person.csv", header + "1,1,1901\n")
    load(spark, place)
    put(place.csv / "person.csv", header + "1,1,x\n")
    assert not load(spark, place)[("PERSON", "person.csv")][0]
    assert parquet_store.read_table(spark, place.store, "person").count() == 1


def test_line_breaks_inside_fields(spark, place):
    put(place.csv / "note.csv", 'note_id,text\n1,"two\nlines"\n2,one\n')
    csv_source.load_cdm(spark, str(place.csv), place.store, multi_line=["note"])
    assert values(parquet_store.read_table(spark, place.store, "note")) == [(1, "two\nlines"), (2, "one")]


def test_each_line_is_parsed_once(spark, place):
    """Once the text is written, a table is typed, clustered and stored without its CSV file."""
    put(place.csv / "drug_exposure.csv", DRUGS)
    put(place.csv / "person.csv", "person_id,gender_concept_id,year_of_birth\n1,8507,1960\n")
    raw = csv_source.raw_csv(spark, str(place.csv / "drug_exposure.csv"))
    scan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert scan(raw).count("FileScan csv") == 1
    with csv_source.parsed_once(raw, place.store, "drug_exposure") as text:
        (place.csv / "drug_exposure.csv").unlink()
        assert "FileScan csv" not in scan(text)
        parquet_store.write_table(csv_source.typed(text, "drug_exposure"), place.store, "drug_exposure")
    assert parquet_store.read_table(spark, place.store, "drug_exposure").count() == 3
    # A table with declared columns only, and no ranges to find, goes from CSV to the store directly.
    small = csv_source.raw_csv(spark, str(place.csv / "person.csv"))
    with csv_source.parsed_once(small, place.store, "person") as text:
        assert text is small
    left = [p.name for p in (place.csv.parent / "store").iterdir()]
    assert left == ["drug_exposure"]


def test_types_of_undeclared_columns(spark):
    columns = {
        "i": (["1", "-20", None], "int"), "l": (["1", "9999999999", None], "bigint"), "d": (["1", "2.5", "1e3"], "double"),
        "day": (["2000-01-31", "1999-02-28", None], "date"), "at": (["2000-01-31", "2000-01-31 10:00:00", None], "timestamp"),
        "b": (["true", "FALSE", None], "boolean"), "s": (["1", "x", None], "string"), "nothing": ([None] * 3, "string"),
        "no day": (["2000-02-31", "2000-01-01", None], "string"), "pad": ([" 1", "2", None], "string"),
        "dot.ted": (["1", "2", "3"], "int"), "many": (["1", "99999999999999999999", None], "double"),
    }
    rows = list(zip(*[v for v, _ in columns.values()]))
    frame = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    assert csv_source.inferred(frame, list(columns)) == {c: kind for c, (_, kind) in columns.items()}
    assert dict(csv_source.typed(frame, "note").dtypes) == {c: kind for c, (_, kind) in columns.items()}
    assert csv_source.inferred(frame.limit(0), ["i"]) == {"i": "string"}


def test_empty_directory(spark, place):
    place.csv.mkdir(parents=True)
    assert load(spark, place) == {}


def test_csv_round_trip_gives_the_same_cohort(spark, place):
    """The stand-in tables, written out as CSV and loaded again."""
    t = ProxyCdm(spark, "/root/testdata/sf0.001")
    for name in COLUMN_TYPES:
        rows = getattr(t, name).collect()
        path = place.csv / f"{name.upper()}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(getattr(t, name).columns)
            writer.writerows(rows)
    assert all(ok for ok, _ in load(spark, place).values())
    stored = parquet_store.read_cdm(spark, place.store, views=True)
    assert spark.sql("SELECT count(*) FROM DRUG_EXPOSURE").first()[0] == t.drug_exposure.count()
    one, other = (
        values(cohorts.new_user_cohort(c.drug_exposure, named(c.concept, TARGET))) for c in (t, stored)
    )
    assert one == other and one
