"""DuckDB SQL for every registered query, over the same Parquet tables.

Written independently of the operators: the SQL takes row-level ways (windows,
joins and QUALIFY) where the operators aggregate, and fits the logistic model
by Newton steps in a recursive query.
"""

from __future__ import annotations

TABLES = """
person AS (
  SELECT c_custkey AS person_id,
         CAST(1940 + (c_custkey * 7) % 50 AS BIGINT) AS year_of_birth,
         CAST(CASE c_nationkey % 2 WHEN 0 THEN 3000001 ELSE 3000002 END AS BIGINT) AS gender_concept_id
  FROM customer
),
coded_orders AS (
  SELECT *, CAST(2000000 + 10 * CAST(left(o_orderpriority, 1) AS BIGINT)
                 + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS code
  FROM orders
),
condition_occurrence AS (
  SELECT o_custkey AS person_id, code AS condition_concept_id, CAST(o_orderdate AS DATE) AS condition_start_date
  FROM coded_orders
),
drug_exposure AS (
  SELECT o_custkey AS person_id,
         10000000 + l_partkey AS drug_concept_id,
         CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
         CASE WHEN l_linenumber <> 1
              THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS drug_exposure_end_date,
         CAST(CASE l_linenumber WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE l_quantity END AS BIGINT) AS days_supply
  FROM lineitem, orders WHERE l_orderkey = o_orderkey
),
concept AS (
  SELECT 10000000 + p_partkey AS concept_id, p_name AS concept_name FROM part
  UNION ALL
  SELECT DISTINCT code, o_orderpriority || ' ' || o_orderstatus FROM coded_orders
  UNION ALL
  SELECT CAST(id AS BIGINT), label FROM (VALUES (3000001, 'Female'), (3000002, 'Male')) AS sexes(id, label)
)
"""

# Exposures with their name, and the study drugs among them.
DRUGS = """
named_rx AS (
  SELECT rx.*, concept_name AS drug FROM drug_exposure AS rx JOIN concept ON concept_id = drug_concept_id
),
target_rx AS (
  SELECT *, CASE WHEN contains(lower(drug), 'hot gear') THEN 'hot gear' ELSE 'red bolt' END AS ingredient
  FROM named_rx WHERE contains(lower(drug), 'hot gear') OR contains(lower(drug), 'red bolt')
),
new_users AS (
  SELECT person_id, drug_exposure_start_date AS index_date FROM target_rx
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY drug_exposure_start_date) = 1
),
ages AS (
  SELECT year(index_date) - year_of_birth AS age FROM new_users JOIN person USING (person_id)
),
starts AS (
  SELECT person_id, ingredient AS index_ingredient, drug_exposure_start_date AS index_date FROM target_rx
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY drug_exposure_start_date, ingredient) = 1
)
"""

OUTCOMES = """
outcome_events AS (
  SELECT * FROM condition_occurrence WHERE condition_concept_id = 2000011 OR condition_concept_id = 2000021
),
first_events AS (
  SELECT person_id, condition_start_date AS event_date FROM outcome_events
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY condition_start_date) = 1
)
"""

STUDY = """
comparator_rx AS (SELECT * FROM named_rx WHERE contains(lower(drug), 'blue')),
arms AS (
  SELECT person_id, 'NSAID' AS grp, index_date FROM new_users
  UNION ALL
  SELECT person_id, 'Acetaminophen', min(drug_exposure_start_date) FROM comparator_rx
  WHERE NOT EXISTS (SELECT 1 FROM new_users WHERE new_users.person_id = comparator_rx.person_id)
  GROUP BY ALL
),
study_rows AS (
  SELECT grp, year(index_date) - year_of_birth AS age, upper(concept_name) AS sex,
         CAST(coalesce(event_date > index_date, false) AS BIGINT) AS outcome,
         CAST(coalesce(event_date <= index_date, false) AS BIGINT) AS prior_bleed
  FROM arms JOIN person USING (person_id) JOIN concept ON concept_id = gender_concept_id
       LEFT JOIN first_events USING (person_id)
),
incident AS (SELECT * FROM study_rows WHERE prior_bleed <> 1),
risks AS (
  SELECT grp, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS events, 100.0 * avg(outcome) AS risk
  FROM incident GROUP BY grp
),
counts AS (
  SELECT t.events AS a, t.n AS n1, k.events AS c, k.n AS n0
  FROM risks AS t, risks AS k WHERE t.grp = 'NSAID' AND k.grp = 'Acetaminophen'
),
ratio AS (
  SELECT (a / n1) / (c / n0) AS rr, sqrt((n1 - a) / (a * n1) + (n0 - c) / (c * n0)) AS se FROM counts
),
crude AS (SELECT rr, rr * exp(-1.96 * se) AS lo, rr * exp(1.96 * se) AS hi FROM ratio)
"""

# Newton steps for outcome ~ 1 + age + female + exposed. Each step solves the
# normal equations by a Cholesky factor; exposed is last, so the reciprocal of
# the last pivot is its standard error.
MODEL = """
design AS (
  SELECT CAST(age AS DOUBLE) AS x1, CAST(sex = 'FEMALE' AS DOUBLE) AS x2, CAST(grp = 'NSAID' AS DOUBLE) AS x3,
         CAST(outcome AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w
  FROM incident GROUP BY ALL
),
newton AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2,
         CAST(0 AS DOUBLE) AS b3, CAST(0 AS DOUBLE) AS se
  UNION ALL
  SELECT step + 1, b0 + d0, b1 + d1, b2 + d2, b3 + d3, 1 / l33
  FROM (
    SELECT step, b0, b1, b2, b3,
           sqrt(h00) AS l00, h01 / l00 AS l10, h02 / l00 AS l20, h03 / l00 AS l30,
           sqrt(h11 - l10 * l10) AS l11, (h12 - l20 * l10) / l11 AS l21, (h13 - l30 * l10) / l11 AS l31,
           sqrt(h22 - l20 * l20 - l21 * l21) AS l22, (h23 - l30 * l20 - l31 * l21) / l22 AS l32,
           sqrt(h33 - l30 * l30 - l31 * l31 - l32 * l32) AS l33,
           g0 / l00 AS z0, (g1 - l10 * z0) / l11 AS z1, (g2 - l20 * z0 - l21 * z1) / l22 AS z2,
           (g3 - l30 * z0 - l31 * z1 - l32 * z2) / l33 AS z3,
           z3 / l33 AS d3, (z2 - l32 * d3) / l22 AS d2, (z1 - l21 * d2 - l31 * d3) / l11 AS d1,
           (z0 - l10 * d1 - l20 * d2 - l30 * d3) / l00 AS d0
    FROM (
      SELECT step, b0, b1, b2, b3,
             sum(r) AS g0, sum(r * x1) AS g1, sum(r * x2) AS g2, sum(r * x3) AS g3,
             sum(v) AS h00, sum(v * x1) AS h01, sum(v * x2) AS h02, sum(v * x3) AS h03,
             sum(v * x1 * x1) AS h11, sum(v * x1 * x2) AS h12, sum(v * x1 * x3) AS h13,
             sum(v * x2 * x2) AS h22, sum(v * x2 * x3) AS h23, sum(v * x3 * x3) AS h33
      FROM (
        SELECT newton.*, x1, x2, x3, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS p,
               w * (y - p) AS r, w * p * (1 - p) AS v
        FROM newton, design WHERE step < 15
      ) AS scored
      GROUP BY step, b0, b1, b2, b3
    ) AS normal
  ) AS solved
),
adjusted AS (
  SELECT exp(b3) AS or_adj, exp(b3 - 1.959963984540054 * se) AS lo, exp(b3 + 1.959963984540054 * se) AS hi
  FROM newton WHERE step = 15
)
"""


def _sql(select: str, *parts: str) -> str:
    recursive = "RECURSIVE " if MODEL in parts else ""
    return f"WITH {recursive}" + ",".join((TABLES, *parts)) + select


def _six(source: str, value: str, suffix: str) -> str:
    return f"""
SELECT CAST(min({value}) AS BIGINT) AS min_{suffix},
       round(quantile_cont({value}, 0.25), 6) AS p25_{suffix},
       round(quantile_cont({value}, 0.5), 6) AS median_{suffix},
       round(quantile_cont({value}, 0.75), 6) AS p75_{suffix},
       CAST(max({value}) AS BIGINT) AS max_{suffix},
       round(avg({value}), 6) AS mean_{suffix}
FROM {source}
"""


def _pct(part: str, whole: str) -> str:
    return f"round(100.0 * ({part}) / ({whole}), 6)"


def _co_drugs(excluded: str, pct: str = "") -> str:
    return f"""
SELECT drug, count(DISTINCT person_id) AS patients {pct}
FROM named_rx
WHERE EXISTS (SELECT 1 FROM new_users WHERE new_users.person_id = named_rx.person_id) AND {excluded}
GROUP BY drug ORDER BY patients DESC, drug LIMIT 10
"""


NOT_BY_ID = "drug_concept_id NOT IN (SELECT drug_concept_id FROM target_rx)"
NOT_BY_NAME = "NOT (contains(lower(drug), 'hot gear') OR contains(lower(drug), 'red bolt'))"
USERS = "(SELECT count(*) FROM new_users)"
PERSONS = "(SELECT count(*) FROM person)"

HISTOGRAM = """
SELECT CAST(age // step * step AS BIGINT) AS bin_start, count(*) AS patients
FROM ages, ({step}) AS bins WHERE age BETWEEN 0 AND 110 GROUP BY bin_start
"""
FITTED_STEP = """
SELECT min(years) AS step FROM (VALUES (1), (2), (5), (10), (20), (50), (100)) AS widths(years)
WHERE years * 30 >= (SELECT max(age) - min(age) FROM ages WHERE age BETWEEN 0 AND 110)
"""

METRICS = f"""
SELECT {USERS} AS size, {PERSONS} AS total, {_pct(USERS, PERSONS)} AS pct,
       round(avg(age), 6) AS mean_age, round(median(age), 6) AS median_age
FROM ages
"""

PRESETS = f"""
, presets(preset, word) AS (
  VALUES ('Both targets', 'hot gear'), ('Both targets', 'red bolt'), ('First target', 'hot gear'),
         ('Second target', 'red bolt'), ('Not in use', 'celecoxib'), ('Comparator', 'blue')
),
preset_users AS (
  SELECT preset, person_id, min(drug_exposure_start_date) AS index_date
  FROM named_rx JOIN presets ON contains(lower(drug), word) GROUP BY preset, person_id
)
SELECT preset, count(DISTINCT u.person_id) AS size, {PERSONS} AS total,
       {_pct("count(DISTINCT u.person_id)", PERSONS)} AS pct,
       round(avg(year(index_date) - year_of_birth), 6) AS mean_age,
       round(median(year(index_date) - year_of_birth), 6) AS median_age
FROM (SELECT DISTINCT preset FROM presets) AS labels
     LEFT JOIN preset_users AS u USING (preset) LEFT JOIN person USING (person_id)
GROUP BY preset
"""

CRUDE = f"""
, exposed_events AS (
  SELECT count(DISTINCT person_id) AS n FROM new_users JOIN outcome_events USING (person_id)
  WHERE condition_start_date > index_date
),
other_events AS (
  SELECT count(DISTINCT person_id) AS n FROM outcome_events ANTI JOIN new_users USING (person_id)
),
table_2x2 AS (
  SELECT {USERS} AS exp_n, e.n AS exp_ev, {PERSONS} - {USERS} AS unexp_n, o.n AS unexp_ev
  FROM exposed_events AS e, other_events AS o
)
SELECT exp_n, exp_ev, round(100.0 * exp_ev / exp_n, 6) AS r_exp,
       unexp_n, unexp_ev, round(100.0 * unexp_ev / unexp_n, 6) AS r_unexp,
       round((exp_ev / exp_n) / (unexp_ev / unexp_n), 6) AS rr
FROM table_2x2
"""


def all_oracles() -> dict[str, str]:
    found = _on_tables()
    stored = ("new_user_cohort", "nsaid_exposures", "comparative_safety")
    return found | {f"stored_{name}": found[name] for name in stored}


def _on_tables() -> dict[str, str]:
    return {
        "core_row_counts": _sql("""
SELECT * FROM (
  SELECT 'PERSON' AS "table", count(*) AS n FROM person
  UNION ALL SELECT 'CONDITION_OCCURRENCE', count(*) FROM condition_occurrence
  UNION ALL SELECT 'DRUG_EXPOSURE', count(*) FROM drug_exposure
  UNION ALL SELECT name, CAST(NULL AS BIGINT)
  FROM (VALUES ('VISIT_OCCURRENCE'), ('MEASUREMENT'), ('OBSERVATION'), ('DEATH')) AS absent(name)
)
"""),
        "top_conditions": _sql("""
SELECT concept_name AS condition_name, concept_id, count(DISTINCT person_id) AS patients, count(*) AS records
FROM condition_occurrence JOIN concept ON concept_id = condition_concept_id
GROUP BY ALL ORDER BY patients DESC, concept_id LIMIT 15
"""),
        "top_drugs": _sql("""
SELECT drug AS drug_name, drug_concept_id AS concept_id, count(DISTINCT person_id) AS patients
FROM named_rx GROUP BY ALL ORDER BY patients DESC, concept_id LIMIT 15
""", DRUGS),
        "keyword_conditions": _sql("""
SELECT concept_name AS condition_name, concept_id, count(DISTINCT person_id) AS patients
FROM condition_occurrence JOIN concept ON concept_id = condition_concept_id
WHERE regexp_matches(concept_name, 'urgent|high', 'i') GROUP BY ALL
"""),
        "codelist_by_name": _sql("SELECT DISTINCT drug_concept_id FROM target_rx", DRUGS),
        "codelist_by_ids": _sql("SELECT * FROM outcome_events", OUTCOMES),
        "outcome_cohort": _sql("SELECT person_id, event_date AS index_date FROM first_events", OUTCOMES),
        "new_user_cohort": _sql("SELECT * FROM new_users", DRUGS),
        "cohort_members": _sql("SELECT DISTINCT person_id FROM target_rx", DRUGS),
        "cohort_share": _sql(
            f"SELECT {USERS} AS size, {PERSONS} AS total, {_pct(USERS, PERSONS)} AS pct", DRUGS
        ),
        "age_summary": _sql(
            "SELECT round(avg(age), 6) AS mean_age, round(median(age), 6) AS median_age FROM ages", DRUGS
        ),
        "sex_breakdown": _sql(f"""
SELECT concept_name AS sex, count(*) AS patients, {_pct("count(*)", USERS)} AS pct
FROM new_users JOIN person USING (person_id) JOIN concept ON concept_id = gender_concept_id GROUP BY concept_name
""", DRUGS),
        "age_distribution": _sql("SELECT age FROM ages WHERE age BETWEEN 0 AND 110", DRUGS),
        "age_histogram": _sql(HISTOGRAM.format(step="SELECT 5 AS step"), DRUGS),
        "age_histogram_fitted": _sql(HISTOGRAM.format(step=FITTED_STEP), DRUGS),
        "codelist_products": _sql("""
SELECT drug AS concept_name, drug_concept_id, count(DISTINCT person_id) AS patients FROM target_rx GROUP BY ALL
""", DRUGS),
        "nsaid_exposures": _sql("""
SELECT person_id, drug_exposure_start_date AS start_date,
       ifnull(drug_exposure_end_date, drug_exposure_start_date) AS end_date FROM target_rx
""", DRUGS),
        "rx_per_patient": _sql("""
SELECT round(avg(n_rx), 6) AS mean_rx, round(median(n_rx), 6) AS median_rx, max(n_rx) AS max_rx
FROM (SELECT count(*) AS n_rx FROM target_rx GROUP BY person_id)
""", DRUGS),
        "treatment_span": _sql(_six("""(
  SELECT max(ifnull(drug_exposure_end_date, drug_exposure_start_date)) - min(drug_exposure_start_date) AS days
  FROM target_rx GROUP BY person_id)""", "days", "span"), DRUGS),
        "days_supply_quality": _sql("""
SELECT count(*) AS n_total, count(*) FILTER (ifnull(days_supply, 0) = 0) AS n_missing FROM target_rx
""", DRUGS),
        "rx_days_supply_stats": _sql(
            _six("(SELECT days_supply FROM target_rx WHERE days_supply > 0)", "days_supply", "days"), DRUGS
        ),
        "rx_span_stats": _sql(_six("""(
  SELECT drug_exposure_end_date - drug_exposure_start_date AS days FROM target_rx
  WHERE drug_exposure_end_date IS NOT NULL)""", "days", "days"), DRUGS),
        "concomitant_by_id": _sql(
            _co_drugs(NOT_BY_ID, f", {_pct('count(DISTINCT person_id)', USERS)} AS pct"), DRUGS
        ),
        "concomitant_by_name": _sql(_co_drugs(NOT_BY_NAME), DRUGS),
        "concomitant_in_window": _sql(f"""
SELECT drug, count(DISTINCT person_id) AS patients, {_pct('count(DISTINCT person_id)', USERS)} AS pct
FROM named_rx JOIN new_users USING (person_id)
WHERE {NOT_BY_ID} AND drug_exposure_start_date - index_date BETWEEN 0 AND 90
GROUP BY drug ORDER BY patients DESC, drug LIMIT 10
""", DRUGS),
        "comedication_coverage": _sql(f"""
, covered AS (
  SELECT count(DISTINCT person_id) AS n FROM named_rx SEMI JOIN new_users USING (person_id)
  WHERE contains(lower(drug), 'anvil')
)
SELECT n, {USERS} AS size, {_pct("n", USERS)} AS pct FROM covered
""", DRUGS),
        "ingredient_exposures": _sql(
            "SELECT person_id, drug_exposure_start_date AS start_date, ingredient FROM target_rx", DRUGS
        ),
        "first_ingredient": _sql("SELECT * FROM starts", DRUGS),
        "switching": _sql(f"""
, moved AS (
  SELECT count(DISTINCT person_id) AS switched FROM target_rx JOIN starts USING (person_id)
  WHERE ingredient <> index_ingredient AND drug_exposure_start_date - index_date BETWEEN 1 AND 365
)
SELECT {USERS} AS n, switched, {_pct("switched", USERS)} AS pct FROM moved
""", DRUGS),
        "starting_ingredient": _sql(f"""
SELECT index_ingredient AS ingredient, count(*) AS patients, {_pct("count(*)", USERS)} AS pct FROM starts GROUP BY ALL
""", DRUGS),
        "crude_safety": _sql(CRUDE, DRUGS, OUTCOMES),
        "comparator_cohort": _sql("SELECT * FROM arms", DRUGS, OUTCOMES, STUDY),
        "comparative_rows": _sql("SELECT * FROM study_rows", DRUGS, OUTCOMES, STUDY),
        "comparative_cells": _sql(
            "SELECT *, count(*) AS persons FROM study_rows GROUP BY ALL", DRUGS, OUTCOMES, STUDY
        ),
        "incident_filter": _sql("SELECT * FROM incident", DRUGS, OUTCOMES, STUDY),
        "dummy_encode": _sql("""
SELECT *, CAST(grp = 'NSAID' AS DOUBLE) AS exposed, CAST(sex = 'FEMALE' AS DOUBLE) AS female FROM incident
""", DRUGS, OUTCOMES, STUDY),
        "group_risks": _sql("SELECT grp, n, events, round(risk, 6) AS risk FROM risks", DRUGS, OUTCOMES, STUDY),
        "risk_ratio_ci": _sql("""
SELECT round(rr, 6) AS rr, round(lo, 6) AS lo, round(hi, 6) AS hi, a > 0 AND c > 0 AS stable FROM crude, counts
""", DRUGS, OUTCOMES, STUDY),
        "adjusted_odds_ratio": _sql("""
SELECT round(or_adj, 6) AS or_adj, round(lo, 6) AS lo, round(hi, 6) AS hi, true AS converged FROM adjusted
""", DRUGS, OUTCOMES, STUDY, MODEL),
        "cohort_metrics": _sql(METRICS, DRUGS),
        "utilization": _sql("""
SELECT (SELECT round(median(days_supply), 6) FROM target_rx WHERE days_supply > 0) AS median_days_supply,
       (SELECT round(avg(days_supply), 6) FROM target_rx WHERE days_supply > 0) AS mean_days_supply,
       round(avg(n_rx), 6) AS mean_rx, round(median(n_rx), 6) AS median_rx
FROM (SELECT count(*) AS n_rx FROM target_rx GROUP BY person_id)
""", DRUGS),
        "drug_presets": _sql(PRESETS, DRUGS),
        "risk_table": _sql(
            'SELECT grp AS "group", round(risk, 6) AS risk, events, n FROM risks', DRUGS, OUTCOMES, STUDY
        ),
        "forest_rows": _sql("""
SELECT 'Crude RR' AS measure, round(rr, 6) AS est, round(lo, 6) AS lo, round(hi, 6) AS hi FROM crude
UNION ALL
SELECT 'Adjusted OR (age+sex)', round(or_adj, 6), round(lo, 6), round(hi, 6) FROM adjusted
""", DRUGS, OUTCOMES, STUDY, MODEL),
        "comparative_safety": _sql("""
SELECT n1 AS target_n, a AS target_events, round(100.0 * a / n1, 6) AS target_risk,
       n0 AS comparator_n, c AS comparator_events, round(100.0 * c / n0, 6) AS comparator_risk,
       round(crude.rr, 6) AS rr, round(crude.lo, 6) AS rr_lo, round(crude.hi, 6) AS rr_hi,
       round(or_adj, 6) AS or_adj, round(adjusted.lo, 6) AS or_lo, round(adjusted.hi, 6) AS or_hi, true AS converged
FROM counts, crude, adjusted
""", DRUGS, OUTCOMES, STUDY, MODEL),
    }
