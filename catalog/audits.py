"""Eligibility, certification, contracts, leakage and descriptive profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.knowledge import LABELLED, labelled_panel
from catalog.registry import query
from catalog.roles import (
    CQ,
    LB,
    SQ,
    customer_panel,
    rounded,
    scored_documents,
    supplier_panel,
    table,
)
from knownat.functions import quarter_position, round_half_away
from knownat.operators.asof import asof_join
from knownat.operators.audit import (
    artifact_checks,
    certify_panel,
    contract_evidence,
    eligibility_audit,
    grain_check,
    group_medians,
    leakage_audit,
    longest_runs,
    readiness,
)
from knownat.operators.profile import (
    cross_tab,
    describe_groups,
    display_rows,
    missing_shares,
    spearman_pairs,
    time_series_diagnostics,
    value_mix,
)
from knownat.operators.ratios import modelling_eligibility, risk_band
from knownat.scale import dealt
from knownat.sources.tables import reconcile_accessions, restrict_to_entities


def run_sql(source: str, keys: str, position: str, name: str) -> str:
    return f"""SELECT {keys}, CAST(max(k) AS BIGINT) AS {name} FROM (
      SELECT {keys}, isl, count(*) AS k FROM (
        SELECT {keys}, {position} - row_number() OVER (PARTITION BY {keys} ORDER BY {position}) AS isl FROM {source})
      GROUP BY ALL) GROUP BY {keys}"""


@query(
    "longest_consecutive_run",
    f"""WITH {CQ}, v AS (SELECT DISTINCT entity, qpos FROM cq WHERE settled IS NOT NULL)
{run_sql("v", "entity", "qpos", "longest_run")}""",
)
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_panel(spark, sf_dir)
    return longest_runs(
        rows, ["entity"], F.col("qpos"), F.col("settled").isNotNull(), "longest_run"
    )


HISTORY = f"""{CQ},
hq AS (SELECT lpad(CAST(entity AS VARCHAR), 10, '0') AS cik, fiscal_year, fiscal_quarter_number,
    amount AS revenue, settled AS operating_income, urgent AS interest_expense, amount AS total_assets,
    settled AS total_debt FROM cq WHERE fiscal_year BETWEEN 1995 AND 2001),
md AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS company_name, c_mktsegment AS sector FROM customer)"""


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = customer_panel(spark, sf_dir).select(
        F.col("entity").cast("string").alias("cik"),
        "fiscal_year",
        "fiscal_quarter_number",
        F.col("amount").alias("revenue"),
        F.col("settled").alias("operating_income"),
        F.col("urgent").alias("interest_expense"),
        F.col("amount").alias("total_assets"),
        F.col("settled").alias("total_debt"),
    )
    metadata = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("cik"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("sector"),
    )
    return metadata, rows


CORE = ("revenue", "operating_income", "interest_expense", "total_assets", "total_debt")


@query(
    "entity_eligibility_audit",
    f"""WITH {HISTORY},
r AS (SELECT *, (revenue IS NOT NULL)::INT + (operating_income IS NOT NULL)::INT + (interest_expense IS NOT NULL)::INT
    + (total_assets IS NOT NULL)::INT + (total_debt IS NOT NULL)::INT AS filled FROM hq),
u AS (SELECT *, filled / 5.0 >= 0.8 AND operating_income IS NOT NULL AND total_assets IS NOT NULL
    AND total_debt IS NOT NULL AS usable, coalesce(abs(interest_expense) >= 150000, false) AS meaningful FROM r),
c AS (SELECT cik, CAST(count(*) FILTER (usable) AS BIGINT) AS usable_quarters, sum(filled) / (count(*) * 5.0) AS cov,
    CAST(count(*) FILTER (meaningful) AS BIGINT) AS interest_quarters,
    median(total_assets) FILTER (fiscal_year <= 1999) AS median_total_assets,
    median(revenue) FILTER (fiscal_year <= 1999) AS median_revenue FROM u GROUP BY cik),
p AS (SELECT DISTINCT cik, fiscal_year * 4 + fiscal_quarter_number AS pos FROM u WHERE usable),
n AS ({run_sql("p", "cik", "pos", "run")}),
j AS (SELECT md.*, coalesce(usable_quarters, 0) AS usable_quarters, coalesce(run, 0) AS run, coalesce(cov, 0) AS cov,
    coalesce(interest_quarters, 0) AS interest_quarters, median_total_assets, median_revenue
  FROM md LEFT JOIN c USING (cik) LEFT JOIN n USING (cik)),
k AS (SELECT *, list_filter([CASE WHEN usable_quarters < 3 THEN 'INSUFFICIENT_USABLE_QUARTERS' END,
    CASE WHEN run < 2 THEN 'INSUFFICIENT_CONSECUTIVE_QUARTERS' END,
    CASE WHEN cov < 0.75 THEN 'INSUFFICIENT_CORE_FIELD_COVERAGE' END,
    CASE WHEN interest_quarters < 1 THEN 'INSUFFICIENT_INTEREST_EXPENSE_HISTORY' END], lambda x: x IS NOT NULL) AS rs FROM j)
SELECT cik, company_name, sector, CAST(usable_quarters AS BIGINT) AS usable_quarters,
  CAST(run AS BIGINT) AS maximum_consecutive_usable_quarters, round(cov, 6) AS core_field_coverage,
  CAST(interest_quarters AS BIGINT) AS meaningful_interest_expense_quarters,
  round(median_total_assets, 4) AS median_total_assets, round(median_revenue, 4) AS median_revenue,
  len(rs) = 0 AS eligible, CASE WHEN len(rs) = 0 THEN 'ELIGIBLE' ELSE array_to_string(rs, ',') END AS reason_codes
FROM k""",
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata, rows = _history(spark, sf_dir)
    made = eligibility_audit(
        metadata,
        rows,
        minimum_usable_quarters=3,
        minimum_consecutive_quarters=2,
        minimum_coverage=0.8,
        minimum_interest_expense=150_000,
        minimum_interest_quarters=1,
        years=(1995, 2001),
        development_year=1999,
        core=CORE,
        essential=("operating_income", "total_assets", "total_debt"),
        minimum_entity_coverage=0.75,
    )
    return rounded(
        made.select(
            "cik", "company_name", "sector", "usable_quarters",
            "maximum_consecutive_usable_quarters", round_half_away("core_field_coverage", 6).alias(
                "core_field_coverage"),
            "meaningful_interest_expense_quarters", "median_total_assets", "median_revenue",
            "eligible", F.concat_ws(",", "reason_codes").alias("reason_codes"),
        ),
        "median_total_assets",
        "median_revenue",
        digits=4,
    )


CERTIFY = f"""{SQ},
lp AS (UNPIVOT (SELECT entity, fiscal_year * 4 + fiscal_quarter_number AS pos,
    CASE WHEN qpos % 9 = 0 THEN NULL ELSE coverage END AS "COVERAGE", leverage AS "LEVERAGE" FROM sq)
  ON "COVERAGE", "LEVERAGE" INTO NAME kpi VALUE v),
al AS (SELECT entity, kpi, max(pos) AS last FROM (SELECT entity, fiscal_year * 4 + fiscal_quarter_number AS pos,
    unnest(['COVERAGE', 'LEVERAGE']) AS kpi FROM sq) GROUP BY ALL),
ob AS (SELECT al.entity, al.kpi, last, count(v) AS observed, min(pos) AS first FROM al LEFT JOIN lp USING (entity, kpi)
  GROUP BY ALL),
rn AS ({run_sql("lp", "entity, kpi", "pos", "run")}),
ev AS (SELECT entity, kpi, CAST(observed AS DOUBLE) AS observed, CAST(coalesce(run, 0) AS DOUBLE) AS run,
    coalesce(observed / greatest(last - first + 1, 0), 0.0) AS coverage FROM ob LEFT JOIN rn USING (entity, kpi)),
lin AS (SELECT entity, count(*) = count(DISTINCT decision_key) AS d, NOT bool_or(coalesce(period_end > decision_at, false)) AS p,
    NOT bool_or(coalesce(CASE WHEN lines > 32 THEN decision_at + 1 END > decision_at, false)) AS m, true AS l
  FROM sq GROUP BY entity),
ru AS (
  SELECT entity, 'KPI_' || kpi || '_OBSERVATIONS' AS rule_code, observed >= 24 AS passed, observed AS observed_value, 24.0::DOUBLE AS required_value FROM ev
  UNION ALL SELECT entity, 'KPI_' || kpi || '_CONTINUITY', run >= 16, run, 16.0::DOUBLE FROM ev
  UNION ALL SELECT entity, 'KPI_' || kpi || '_COVERAGE', coverage >= 0.88, coverage, 0.88::DOUBLE FROM ev
  UNION ALL SELECT entity, 'DUPLICATE_DECISION_KEY', d, CAST(d AS INTEGER)::DOUBLE, 1.0::DOUBLE FROM lin
  UNION ALL SELECT entity, 'POINT_IN_TIME_LEAKAGE', p, CAST(p AS INTEGER)::DOUBLE, 1.0::DOUBLE FROM lin
  UNION ALL SELECT entity, 'MACRO_VINTAGE_LEAKAGE', m, CAST(m AS INTEGER)::DOUBLE, 1.0::DOUBLE FROM lin
  UNION ALL SELECT entity, 'MATERIAL_LINEAGE_BREAK', l, CAST(l AS INTEGER)::DOUBLE, 1.0::DOUBLE FROM lin)"""


def _certified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = supplier_panel(spark, sf_dir).select(
        "entity",
        "sector",
        "fiscal_year",
        "fiscal_quarter_number",
        "decision_key",
        "decision_at",
        F.when(F.col("qpos") % 9 != 0, F.col("coverage")).alias("coverage"),
        "leverage",
        F.col("period_end").alias("maximum_source_available_at"),
        F.when(F.col("lines") > 32, F.date_add("decision_at", 1)).alias("macro_available_at_max"),
        F.col("decision_key").alias("accession_numbers_json"),
        F.col("industry").alias("company_name"),
        F.col("industry").alias("ticker"),
    )
    return certify_panel(
        panel,
        universe_version="v1",
        minimum_coverage=0.88,
        kpis=["coverage", "leverage"],
        entity="entity",
    )


@query(
    "panel_certification_rules",
    f"""WITH {CERTIFY} SELECT entity, rule_code, passed, round(observed_value, 6) AS observed_value, required_value FROM ru""",
)
def certification_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, _ = _certified(spark, sf_dir)
    return rounded(
        rules.select("entity", "rule_code", "passed", "observed_value", "required_value"),
        "observed_value",
    )


@query(
    "panel_certification_summary",
    f"""WITH {CERTIFY}
SELECT entity, bool_and(passed) AS certified,
  coalesce(array_to_string(list_sort(list(rule_code) FILTER (NOT passed)), ','), '') AS failed_rules FROM ru GROUP BY entity""",
)
def certification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = _certified(spark, sf_dir)
    return summary.select(
        "entity", "certified", F.concat_ws(",", "failed_rules").alias("failed_rules")
    )


def _contract_sql(name: str, key: str) -> str:
    empty = " OR ".join(f"{k.strip()} IS NULL" for k in key.split(","))
    return f"""SELECT '{name}' AS table_name, '{"x_missing" if name == "events" else ""}' AS missing_columns,
  CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_keys,
  CAST(coalesce(sum(n) FILTER ({empty}), 0) AS BIGINT) AS null_keys
FROM (SELECT {key}, count(*) AS n FROM {name} GROUP BY ALL)"""


CONTRACTS = {"orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber",
             "conversations": "conv_id, turn", "events": "event_id"}


@query(
    "contract_key_check",
    "SELECT *, missing_columns = '' AND duplicate_keys = 0 AND null_keys = 0 AS passed FROM ("
    + " UNION ALL ".join(_contract_sql(n, k) for n, k in CONTRACTS.items())
    + ")",
)
def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in CONTRACTS}
    rules = {
        name: {
            "required": [*key.split(", "), *(["x_missing"] if name == "events" else [])],
            "key": key.split(", "),
        }
        for name, key in CONTRACTS.items()
    }
    return contract_evidence(tables, rules)


@query(
    "grain_and_chronology_check",
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n,
    count(*) FILTER (CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)) AS early
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicate_keys,
  CAST(sum(early) AS BIGINT) AS available_before_period_end FROM g""",
)
def grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # Dealt out by order: the join and the grouping both take place in these partitions.
    joined = dealt(lines, ["l_orderkey"], lines.count()).join(
        table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")
    )
    return grain_check(
        joined, ["l_orderkey", "l_linenumber"], period_end="o_orderdate", available="l_shipdate"
    )


@query(
    "leakage_audit",
    """WITH d AS (SELECT user_id, event_id, ts AS decision_at FROM events WHERE event_type = 'view'),
o AS (SELECT user_id, ts AS available_at, event_id AS observed_id, value AS observed_value FROM events WHERE event_type = 'error'),
j AS (SELECT * FROM d ASOF LEFT JOIN o ON d.user_id = o.user_id AND d.decision_at >= o.available_at)
SELECT 'asof_source' AS check_name, CAST(count(available_at) AS BIGINT) AS checked_rows,
  CAST(count(*) FILTER (available_at > decision_at) AS BIGINT) AS violations,
  count(*) FILTER (available_at > decision_at) = 0 AS passed FROM j
UNION ALL
SELECT 'shifted_source', CAST(count(available_at) AS BIGINT),
  CAST(count(*) FILTER (available_at + INTERVAL 6 HOUR > decision_at) AS BIGINT),
  count(*) FILTER (available_at + INTERVAL 6 HOUR > decision_at) = 0 FROM j""",
)
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    decisions = events.where("event_type = 'view'").select(
        "user_id", "event_id", F.col("ts").alias("decision_at")
    )
    observations = events.where("event_type = 'error'").select(
        "user_id",
        F.col("ts").alias("available_at"),
        F.col("event_id").alias("observed_id"),
        F.col("value").alias("observed_value"),
    )
    joined = asof_join(
        decisions, observations, by=["user_id"], decision_id=["event_id"],
        tie_break=["observed_id"],
    ).withColumn("later", F.expr("available_at + INTERVAL 6 HOUR"))
    return leakage_audit(
        joined,
        {
            "asof_source": ("available_at", "decision_at"),
            "shifted_source": ("later", "decision_at"),
        },
    )


@query(
    "artifact_checks",
    f"""WITH {LB}, g AS (SELECT decision_key, count(*) AS n, count(*) FILTER (probability IS NULL) AS f,
    count(*) FILTER (probability IS NULL OR probability < 0 OR probability > 1) AS b FROM lb GROUP BY decision_key),
t AS (SELECT CAST(sum(n) AS BIGINT) AS r, CAST(sum(n - 1) AS BIGINT) AS u, CAST(sum(f) AS BIGINT) AS f, CAST(sum(b) AS BIGINT) AS b FROM g)
SELECT 'predictions' AS asset, 'nonempty' AS check_name, r > 0 AS passed, r AS evidence FROM t
UNION ALL SELECT 'predictions', 'unique_key', u = 0, u FROM t
UNION ALL SELECT 'predictions', 'finite_probability', f = 0, f FROM t
UNION ALL SELECT 'predictions', 'bounded_probability', b = 0, b FROM t""",
)
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifact_checks(
        "predictions",
        scored_documents(spark, sf_dir),
        key=["decision_key"],
        finite=["probability"],
        bounded=["probability"],
    )


READY = f"""{LABELLED},
s AS (SELECT *, coalesce(deterioration_label = 1, false) AND NOT (coalesce(lag(deterioration_label) OVER w = 1, false)
    AND coalesce((year(decision_at) * 4 + quarter(decision_at))
      - lag(year(decision_at) * 4 + quarter(decision_at)) OVER w = 1, false)) AS starts
  FROM lq WINDOW w AS (PARTITION BY entity ORDER BY decision_at)),
se AS (SELECT sector, CAST(count(DISTINCT entity) AS BIGINT) AS issuers,
    CAST(count(*) FILTER (starts) AS BIGINT) AS episodes, min(decision_at) AS first_decision_at,
    max(decision_at) AS last_decision_at FROM s GROUP BY sector)"""


def _ready(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled_panel(spark, sf_dir).drop("deterioration_episode_start")
    return readiness(
        rows,
        minimum_issuers=18,
        minimum_episodes=40,
        consumed_start="1999-01-01",
        untouched_start="2001-01-01",
        entity="entity",
    )


@query(
    "readiness_sectors",
    f"""WITH {READY} SELECT *, issuers >= 18 AS issuer_gate_passed, episodes >= 40 AS episode_gate_passed FROM se""",
)
def readiness_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir)[0]


@query(
    "readiness_gates",
    f"""WITH {READY} SELECT count(*) > 0 AS real_panel_present, bool_and(issuers >= 18 AND episodes >= 40)
  AS sector_sample_sizes_pass, false AS active_population_lineage_present,
  true AS new_untouched_test_boundary_registered, 'not_ready' AS status, false AS final_test_may_be_opened FROM se""",
)
def readiness_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark, sf_dir)[1]


# --- profiles ----------------------------------------------------------------------------------


@query(
    "describe_by_group",
    f"""WITH {SQ}, u AS (SELECT sector, 'coverage' AS variable, coverage AS v FROM sq
    UNION ALL SELECT sector, 'leverage', leverage FROM sq)
SELECT sector, variable, CAST(count(v) AS BIGINT) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS min, round(quantile_cont(v, 0.25), 8) AS p25, round(quantile_cont(v, 0.5), 8) AS p50,
  round(quantile_cont(v, 0.75), 8) AS p75, max(v) AS max FROM u GROUP BY 1, 2""",
)
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = describe_groups(supplier_panel(spark, sf_dir), ["sector"], ["coverage", "leverage"])
    return rounded(rounded(made, "mean", "std"), "p25", "p50", "p75", digits=8)


@query(
    "missing_share_by_group",
    f"""WITH {CQ}, u AS (SELECT fiscal_year, 'settled' AS variable, settled AS v FROM cq
    UNION ALL SELECT fiscal_year, 'urgent', urgent FROM cq)
SELECT fiscal_year, variable, round(1 - count(v) / count(*), 6) AS missing_share,
  round(count(v) / count(*), 6) AS coverage_share FROM u GROUP BY 1, 2""",
)
def missing_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = missing_shares(customer_panel(spark, sf_dir), ["fiscal_year"], ["settled", "urgent"])
    return rounded(made, "missing_share", "coverage_share")


@query(
    "value_mix",
    """SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM customer GROUP BY 1""",
)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(value_mix(table(spark, sf_dir, "customer"), "c_mktsegment"), "share")


@query(
    "quantile_display_filter",
    """WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, b WHERE o_totalprice BETWEEN lo AND hi""",
)
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return display_rows(orders, "o_totalprice")


@query(
    "sector_by_risk_band",
    f"""WITH {LB}, b AS (SELECT sector, CASE WHEN probability >= 0.67 THEN 'High' WHEN probability >= 0.33 THEN 'Medium'
    ELSE 'Low' END AS band FROM lb)
SELECT sector, CAST(count(*) FILTER (band = 'High') AS BIGINT) AS "High", CAST(count(*) FILTER (band = 'Medium') AS BIGINT)
  AS "Medium", CAST(count(*) FILTER (band = 'Low') AS BIGINT) AS "Low" FROM b GROUP BY sector""",
)
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir).withColumn("band", risk_band("probability"))
    return cross_tab(rows, "sector", "band", ["High", "Medium", "Low"])


@query(
    "time_series_diagnostics",
    f"""WITH {SQ}, x AS (SELECT entity, sector, decision_at, coverage AS v FROM sq WHERE coverage IS NOT NULL),
y AS (SELECT *, lag(v) OVER w AS pv, CASE WHEN count(v) OVER r >= 2 THEN avg(v) OVER r END AS trend,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY entity, sector) AS n
  FROM x WINDOW w AS (PARTITION BY entity, sector ORDER BY decision_at),
    r AS (PARTITION BY entity, sector ORDER BY decision_at ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT entity, sector, 'coverage' AS kpi, CAST(count(*) AS BIGINT) AS observations,
  round(corr(v, pv), 6) AS lag1_autocorrelation, round(var_samp(trend) / var_samp(v - trend), 6) AS signal_to_noise_ratio,
  round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS excess_kurtosis,
  round((avg(v) FILTER (i > n // 2) - avg(v) FILTER (i <= n // 2)) / stddev_samp(v), 6) AS mean_shift_standardized
FROM y WHERE n >= 8 GROUP BY entity, sector""",
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = time_series_diagnostics(supplier_panel(spark, sf_dir), ["coverage"], entity="entity")
    return rounded(
        made, "lag1_autocorrelation", "signal_to_noise_ratio", "skewness", "excess_kurtosis",
        "mean_shift_standardized",
    )


AVG_RANK = """(rank() OVER (PARTITION BY feature_a, feature_b ORDER BY {v})
    + (count(*) OVER (PARTITION BY feature_a, feature_b, {v}) - 1) / 2.0)"""


@query(
    "spearman_pairwise",
    f"""WITH {SQ}, pr AS (
  SELECT 'coverage' AS feature_a, 'cash_margin' AS feature_b, coverage AS x, cash_margin AS y FROM sq
  UNION ALL SELECT 'coverage', 'lev', coverage, CASE WHEN lines % 5 <> 0 THEN round(leverage, 2) END FROM sq
  UNION ALL SELECT 'cash_margin', 'lev', cash_margin, CASE WHEN lines % 5 <> 0 THEN round(leverage, 2) END FROM sq),
r AS (SELECT feature_a, feature_b, {AVG_RANK.format(v="x")} AS rx, {AVG_RANK.format(v="y")} AS ry
  FROM pr WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT feature_a, feature_b, round(corr(rx, ry), 6) AS spearman, CAST(count(*) AS BIGINT) AS complete_rows
FROM r GROUP BY 1, 2""",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).withColumn(
        "lev", F.when(F.col("lines") % 5 != 0, round_half_away("leverage", 2))
    )
    return rounded(spearman_pairs(rows, ["coverage", "cash_margin", "lev"]), "spearman")


@query(
    "accession_reconciliation",
    """WITH b AS (SELECT DISTINCT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS period, o_orderkey AS a FROM orders),
k AS (SELECT DISTINCT l_orderkey AS a FROM lineitem WHERE l_returnflag = 'R')
SELECT period, CAST(count(*) AS BIGINT) AS filings, CAST(count(k.a) AS BIGINT) AS matched
FROM b LEFT JOIN k USING (a) GROUP BY period""",
)
def accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bulk = table(spark, sf_dir, "orders").select(
        quarter_position("o_orderdate").alias("period"), F.col("o_orderkey").alias("a")
    )
    facts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("a")
    )
    return reconcile_accessions(bulk, facts, accession="a")


@query(
    "restrict_to_entities",
    """WITH w AS (SELECT DISTINCT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')
SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) FILTER (o_custkey IN (SELECT o_custkey FROM w)) AS BIGINT)
  AS rows_after, CAST(count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT o_custkey FROM w)) AS BIGINT) AS entities FROM orders""",
)
def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"))
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    ids = orders.join(
        building.select(F.col("c_custkey").alias("cik")), "cik", "left_semi"
    )
    _, report = restrict_to_entities(orders, ids)
    return report


@query(
    "median_by_year_sector",
    f"""WITH {SQ} SELECT fiscal_year, sector, round(median(coverage), 8) AS median_coverage FROM sq GROUP BY 1, 2""",
)
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = group_medians(
        supplier_panel(spark, sf_dir), ["fiscal_year", "sector"], "coverage", "median_coverage"
    )
    return rounded(made, "median_coverage", digits=8)


@query(
    "modelling_eligibility",
    f"""WITH {SQ}, e AS (SELECT decision_key, coverage IS NOT NULL AND income IS NOT NULL AND coalesce(interest > 30000, false) AS a,
    period_end <= decision_at AND debt IS NOT NULL AS b FROM sq)
SELECT decision_key, a AS company_quarter_interest_coverage_eligible, b AS company_quarter_lineage_eligible,
  a AND b AS company_quarter_modeling_eligible FROM e""",
)
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).withColumn("paid", F.col("interest") - 30000)
    made = modelling_eligibility(
        rows, coverage="coverage", operating_income="income", interest="paid",
        source_time="period_end", decision_time="decision_at", lineage="debt",
    )
    return made.select(
        "decision_key", "company_quarter_interest_coverage_eligible",
        "company_quarter_lineage_eligible", "company_quarter_modeling_eligible",
    )
