"""Every way of meeting a code list gives the same rows, and plans have the intended shape."""

import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F
from tables import values

from rxcohort.catalog.queries import ON_TABLES
from rxcohort.operators import codelists, cohorts, describe, model, safety
from rxcohort.operators import utilization as use
from rxcohort.plans import lookup
from rxcohort.sources import proxy
from rxcohort.sources import store as parquet_store

SMALL = "/root/testdata/sf0.001"


def sizes(monkeypatch, literal, broadcast):
    monkeypatch.setattr(lookup, "LITERAL_CODES", literal)
    monkeypatch.setattr(lookup, "BROADCAST_CODES", broadcast)


@contextmanager
def settings(spark, **conf):
    conf = {"spark.sql." + key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.fixture
def no_small_tables(spark):
    """Estimated sizes never lead to a broadcast, as with large tables."""
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        yield


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LOOKUP_USERS = [
    "keyword_conditions", "codelist_by_name", "new_user_cohort", "sex_breakdown", "codelist_products",
    "concomitant_by_id", "concomitant_by_name", "comedication_coverage", "ingredient_exposures",
    "comparator_cohort", "comparative_cells", "drug_presets",
]


@pytest.mark.parametrize("name", LOOKUP_USERS)
def test_large_code_lists_give_the_same_rows(spark, monkeypatch, no_small_tables, name):
    query = ON_TABLES[name]
    few = values(query(proxy.ProxyCdm(spark, SMALL)))
    sizes(monkeypatch, 0, 500_000)
    assert values(query(proxy.ProxyCdm(spark, SMALL))) == few
    sizes(monkeypatch, 0, 0)
    joined = query(proxy.ProxyCdm(spark, SMALL))
    assert "Broadcast" not in plan(joined)
    assert values(joined) == few and few


def test_way_follows_the_counted_size(spark, monkeypatch, no_small_tables):
    facts = spark.range(100).withColumnRenamed("id", "code")
    codes = spark.range(10).withColumnRenamed("id", "concept_id")
    for literal, broadcast, expected in ((10, 0, " IN "), (9, 10, "BroadcastHashJoin"), (9, 9, "SortMergeJoin")):
        sizes(monkeypatch, literal, broadcast)
        for meet, n in ((lookup.keep_codes, 10), (lookup.drop_codes, 90), (lookup.tag_codes, 10)):
            met = meet(facts, "code", codes)
            assert met.count() == n
            shape = plan(met)
            if expected == " IN ":
                assert " IN " in shape or "INSET" in shape
                assert "SortMergeJoin" not in shape
            else:
                assert expected in shape


def test_resolved_list_is_not_searched_again(spark, monkeypatch):
    codes = codelists.named(proxy.ProxyCdm(spark, SMALL).concept, proxy.TARGET)
    held = lookup.resolved(codes)
    assert "FileScan" not in plan(held) and held.schema == codes.schema and values(held) == values(codes)
    sizes(monkeypatch, 1, 1)
    assert lookup.resolved(codes) is codes


def test_null_codes_and_keys(spark, monkeypatch):
    facts = spark.createDataFrame([(1,), (2,), (None,)], "code bigint")
    codes = spark.createDataFrame([(1,), (None,)], "concept_id bigint")
    nothing = codes.where("concept_id > 9")
    for literal, broadcast in ((1000, 1000), (0, 1000), (0, 0)):
        sizes(monkeypatch, literal, broadcast)
        assert values(lookup.keep_codes(facts, "code", codes)) == [(1,)]
        assert values(lookup.drop_codes(facts, "code", codes)) == [(2,)]
        assert values(lookup.keep_codes(facts, "code", nothing)) == []
        assert values(lookup.drop_codes(facts, "code", nothing)) == [(1,), (2,)]
        assert values(lookup.tag_codes(facts, "code", nothing)) == []


@pytest.mark.parametrize("name", ["comparative_cells", "crude_safety", "group_risks", "concomitant_by_id", "switching"])
def test_people_are_never_broadcast(spark, no_small_tables, name):
    shape = plan(ON_TABLES[name](proxy.ProxyCdm(spark, SMALL)))
    assert "BroadcastNestedLoopJoin" not in shape and "CartesianProduct" not in shape
    for line in shape.split("\n"):
        if "BroadcastHashJoin" in line:
            assert "concept_id" in line


def test_switching_reads_exposures_once(spark):
    tagged = use.ingredient_exposures(proxy.ProxyCdm(spark, SMALL).drug_exposure, proxy.ProxyCdm(spark, SMALL).concept, proxy.TARGET)
    assert plan(use.switching(tagged)).count("lineitem.parquet") == 1


def test_store_scan_takes_the_code_list(spark, tmp_path):
    """On stored tables the ids of a code list and of an outcome reach the Parquet reader."""
    t = proxy.ProxyCdm(spark, SMALL)
    for name in ("person", "concept", "condition_occurrence", "drug_exposure"):
        parquet_store.write_table(getattr(t, name), str(tmp_path), name)
    cdm = parquet_store.read_cdm(spark, str(tmp_path))
    exposed = cohorts.new_user_cohort(cdm.drug_exposure, codelists.named(cdm.concept, proxy.TARGET))
    scan = next(line for line in plan(exposed).split("\n") if "FileScan" in line)
    assert "PushedFilters: [In(drug_concept_id" in scan
    assert "days_supply" not in scan and "end_date" not in scan
    outcomes = plan(cohorts.outcome_cohort(cdm.condition_occurrence, proxy.OUTCOME))
    assert "PushedFilters: [In(condition_concept_id" in outcomes
    assert values(exposed) == values(cohorts.new_user_cohort(t.drug_exposure, codelists.named(t.concept, proxy.TARGET)))


def test_exchanges_of_a_study(spark, no_small_tables, tmp_path):
    """One exchange by person for each of exposures, persons and events, then only cells move."""
    t = proxy.ProxyCdm(spark, SMALL)
    for name in ("person", "concept", "condition_occurrence", "drug_exposure"):
        parquet_store.write_table(getattr(t, name), str(tmp_path), name)
    cdm = parquet_store.read_cdm(spark, str(tmp_path))
    cells = safety.study_cells(cdm, proxy.TARGET, proxy.COMPARATOR, proxy.OUTCOME)
    shape = plan(cells)
    assert shape.count("Exchange hashpartitioning(person_id") == 3
    assert shape.count("Exchange ") == 5 + shape.count("BroadcastExchange")


def skewed(spark, copies):
    """Drug and condition rows where one person, one drug and one condition fill most of the table."""
    t = proxy.ProxyCdm(spark, SMALL)
    hot_rx = t.drug_exposure.limit(1).crossJoin(spark.range(copies)).drop("id")
    hot_dx = t.condition_occurrence.limit(1).crossJoin(spark.range(copies)).drop("id")
    t.drug_exposure = t.drug_exposure.unionByName(hot_rx)
    t.condition_occurrence = t.condition_occurrence.unionByName(hot_dx)
    return t


@pytest.mark.parametrize("name", ["new_user_cohort", "switching", "concomitant_by_id", "crude_safety", "comparative_cells"])
def test_copies_of_one_row_change_nothing(spark, name):
    query = ON_TABLES[name]
    assert values(query(skewed(spark, 50_000))) == values(query(proxy.ProxyCdm(spark, SMALL)))


def test_partitioning_does_not_matter(spark):
    t = proxy.ProxyCdm(spark, SMALL)
    before = values(describe.age_summary(cohorts.outcome_cohort(t.condition_occurrence, proxy.OUTCOME), t.person))
    moved = t.condition_occurrence.repartition(13)
    assert values(describe.age_summary(cohorts.outcome_cohort(moved, proxy.OUTCOME), t.person)) == before


@pytest.mark.parametrize("meet, n", [(lookup.keep_codes, 300_000), (lookup.tag_codes, 300_000), (lookup.drop_codes, 1_000)])
def test_hot_code_is_split_in_a_shuffled_join(spark, monkeypatch, no_small_tables, meet, n):
    """Beyond broadcast size, the partition of a code with nearly all rows is read by several tasks."""
    sizes(monkeypatch, 0, 0)
    facts = spark.range(0, 301_000, 1, 8).selectExpr("id AS person_id", "IF(id < 300000, 7, id) AS code")
    codes = spark.range(50).withColumnRenamed("id", "concept_id")
    with settings(
        spark,
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        adaptive__advisoryPartitionSizeInBytes="64KB",
        adaptive__coalescePartitions__enabled="false",
    ):
        met = meet(facts, "code", codes)
        assert len(met.collect()) == n
        assert "skew=true" in plan(met)


def rows_read(df):
    """Rows that leave the scans of a finished query."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        nodes.extend(node.children().apply(i) for i in range(node.children().size()))
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
    return found


@pytest.mark.parametrize("ids", [2, 20, 200, 2_000])
def test_clustered_store_skips_what_a_scattered_list_does_not_need(spark, tmp_path, ids):
    """Far fewer rows are read than lie between the smallest and the largest id, with the session as it comes."""
    n = 2_000_000
    facts = spark.range(0, n, 1, 4).selectExpr(
        "id AS person_id", "id * 7919 % 500000 AS drug_concept_id", "DATE '2000-01-01' AS drug_exposure_start_date"
    )
    with settings(spark, adaptive__coalescePartitions__enabled="false"):  # as many files as a large table has
        parquet_store.write_table(facts, str(tmp_path), "drug_exposure")
    stored = parquet_store.read_table(spark, str(tmp_path), "drug_exposure")
    # Clusters of ids, as product lists are, at both ends of the vocabulary and between.
    chosen = [(1_000 + (i % 10) * 49_000 + i // 10 * 3,) for i in range(ids)]
    codes = spark.createDataFrame(chosen, "concept_id bigint")
    kept = lookup.keep_codes(stored, "drug_concept_id", codes)
    read = rows_read(kept)
    assert kept.count() == 4 * ids
    assert read < 0.35 * n


def test_stored_query_lets_the_code_list_reach_the_reader(spark, tmp_path):
    """The registered query on stored tables: the list is in the scan, and of two ids in two clusters few rows are read."""
    cdm = parquet_store.stored(spark, proxy.ProxyCdm(spark, "/root/testdata/sf0.1"), str(tmp_path))
    exposed = cohorts.new_user_cohort(cdm.drug_exposure, codelists.named(cdm.concept, proxy.TARGET))
    with settings(spark, maxMetadataStringLength="100000"):
        scan = next(line for line in plan(exposed).split("\n") if "FileScan" in line)
    assert "In(drug_concept_id" in scan and "GreaterThanOrEqual(drug_concept_id" in scan
    total = cdm.drug_exposure.count()
    # 635 product ids scattered over the whole dictionary: every page holds some, so all are read.
    assert rows_read(exposed) <= total
    # One narrow class of products, as vocabularies have them: a few pages.
    narrow = spark.createDataFrame([(10_000_000 + i,) for i in (*range(50, 80), *range(19_000, 19_030))], "concept_id bigint")
    few = lookup.keep_codes(cdm.drug_exposure, "drug_concept_id", narrow)
    assert few.count() > 0 and rows_read(few) < 0.35 * total


def has_window(df):
    return "Window" in plan(df)


def test_switching_needs_no_window(spark, no_small_tables):
    assert not has_window(ON_TABLES["switching"](proxy.ProxyCdm(spark, SMALL)))


def test_dictionary_is_not_sorted_by_name(spark, no_small_tables):
    concept = proxy.ProxyCdm(spark, SMALL).concept
    marked = use._marked(concept, proxy.TARGET)
    assert not has_window(marked)
    leads = {r["concept_name"]: r["low"] for r in concept.groupBy("concept_name").agg({"concept_id": "min"}).toDF("concept_name", "low").collect()}
    names = dict(concept.select("concept_id", "concept_name").collect())
    for r in marked.collect():
        hit = any(k in names[r.drug_concept_id] for k in proxy.TARGET)
        assert r.taken == (hit, None if hit else leads[names[r.drug_concept_id]])


def jobs(spark, name, build):
    spark.sparkContext.setJobGroup(name, name)
    try:
        made = build()
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("other", "other")


def test_sexes_of_a_cohort_are_not_listed_beforehand(spark):
    t = proxy.ProxyCdm(spark, SMALL)
    cohort = cohorts.outcome_cohort(t.condition_occurrence, proxy.OUTCOME)
    df, ran = jobs(spark, "sexes", lambda: describe.sex_breakdown(cohort, t.person, t.concept))
    assert ran == 0 and df.count() == 2


def test_study_does_not_read_persons_beforehand(spark, tmp_path):
    """A study is planned without its persons: they may be gone by then."""
    t = proxy.ProxyCdm(spark, SMALL)
    broken = t.person.withColumn("gender_concept_id", F.raise_error(F.lit("read")).cast("bigint"))
    cohort = cohorts.outcome_cohort(t.condition_occurrence, proxy.OUTCOME)
    for build in (safety.comparative_rows, safety.comparative_cells):
        df = build(cohort.withColumn("grp", F.lit("NSAID")), broken, t.condition_occurrence, t.concept, proxy.OUTCOME)
        with pytest.raises(Exception, match="read"):
            df.collect()


def test_study_runs_few_jobs(spark):
    t = proxy.ProxyCdm(spark, SMALL)
    _, ran = jobs(spark, "study", lambda: model.comparative_safety(t, proxy.TARGET, proxy.COMPARATOR, proxy.OUTCOME).collect())
    assert ran <= 20  # 32 with a fitted estimator


def test_hot_person_is_reduced_before_it_is_gathered(spark):
    """A person with very many days on a few drugs: rows by person are bounded by drugs and calendar."""
    rows = spark.range(0, 60_000, 1, 8).selectExpr(
        "1 AS person_id", "IF(id % 2 = 0, named_struct('target', true, 'lead', CAST(NULL AS BIGINT)), "
        "named_struct('target', false, 'lead', id % 3)) AS taken", "date_add(DATE '2000-01-01', CAST(id % 3000 AS INT)) AS day",
    )
    near = use._within(rows, 90)
    assert near.count() == 4
    assert "collect" not in plan(near)


def test_cost_of_a_row_does_not_grow_with_the_list(spark, tmp_path):
    """A scan of rows with 600 or 4,000 scattered ids takes about as long as with 12."""
    spark.range(0, 6_000_000, 1, 8).selectExpr("id * 7919 % 500000 AS code").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))

    def seconds(ids):
        codes = spark.createDataFrame([(i * 101 % 500_000,) for i in range(ids)], "concept_id bigint")
        kept = lookup.keep_codes(facts, "code", codes)
        taken = []
        for _ in range(3):
            start = time.perf_counter()
            assert kept.count() == 12 * ids
            taken.append(time.perf_counter() - start)
        return min(taken)

    few = seconds(12)
    assert seconds(600) < 3 * few + 0.3 and seconds(4_000) < 3 * few + 0.3


@pytest.mark.parametrize("literal, broadcast", [(5_000, 500_000), (0, 0)])
@pytest.mark.parametrize("name", ["concomitant_by_id", "concomitant_by_name", "concomitant_in_window"])
def test_co_medication_reads_exposures_once(spark, monkeypatch, no_small_tables, name, literal, broadcast):
    sizes(monkeypatch, literal, broadcast)
    shape = plan(ON_TABLES[name](proxy.ProxyCdm(spark, SMALL)))
    assert shape.count("lineitem.parquet") == 1
    assert shape.count("Exchange hashpartitioning(person_id") == 1
