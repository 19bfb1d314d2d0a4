"""Stratified selection, size tiers, reserves, replacements and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.roles import HASH, LB, geography, rounded, scored_documents, table
from knownat.functions import composite_key, hash_score, pad_id, split_key
from knownat.operators.ratios import case_type
from knownat.operators.scoring import model_disagreement
from knownat.operators.selection import (
    balanced_sample,
    candidate_pool,
    current_listing,
    excluded_name,
    priority_review_cases,
    range_rule_lookup,
    replace_failures,
    screening_reason,
    select_universe,
    selection_digest,
    size_tiers,
    top_cases,
)

SEED = 42
PER_SECTOR = {
    "BUILDING": 12, "MACHINERY": 9, "HOUSEHOLD": 6, "AUTOMOBILE": 10, "FURNITURE": 5
}


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as issuers: market segment = sector, region = industry, balance = size."""
    customers = table(spark, sf_dir, "customer")
    return customers.join(
        geography(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey").cast("string").alias("cik"),
        F.col("c_mktsegment").alias("sector"),
        F.col("sector").alias("industry"),
        F.col("c_acctbal").alias("size"),
    )


H = HASH.format(seed=SEED, id="cik")
ISSUERS = """iss AS (SELECT CAST(c_custkey AS VARCHAR) AS cik, c_mktsegment AS sector, r_name AS industry, c_acctbal AS size
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@query(
    "hash_score",
    f"""WITH {ISSUERS} SELECT lpad(cik, 10, '0') AS cik, {H} AS random_score,
  sector || '|' || industry AS stratum, industry AS industry_part FROM iss""",
)
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = issuers(spark, sf_dir)
    return rows.select(
        pad_id("cik").alias("cik"),
        hash_score("cik", SEED).alias("random_score"),
        composite_key("sector", "industry").alias("stratum"),
        split_key(composite_key("sector", "industry"))[1].alias("industry_part"),
    )


@query(
    "hash_score_sample_round_robin",
    f"""WITH {ISSUERS}, r AS (SELECT *, {H} AS random_score FROM iss),
p AS (SELECT *, row_number() OVER (PARTITION BY sector, industry ORDER BY random_score, cik) AS place FROM r),
q AS (SELECT *, CAST(row_number() OVER (ORDER BY place, sector, industry) AS BIGINT) AS random_rank FROM p)
SELECT cik, sector, industry, random_score, random_rank FROM q WHERE random_rank <= 120""",
)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = balanced_sample(
        issuers(spark, sf_dir), 120, strata=["sector", "industry"], seed=SEED
    )
    return drawn.select("cik", "sector", "industry", "random_score", "random_rank")


@query(
    "candidate_pool",
    f"""WITH {ISSUERS}, r AS (SELECT *, {H} AS random_score FROM iss),
p AS (SELECT *, row_number() OVER (PARTITION BY sector, industry ORDER BY random_score, cik) AS place FROM r),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY sector ORDER BY place, industry) AS BIGINT) AS random_rank FROM p)
SELECT cik, sector, random_rank, 'INCLUDED' AS candidate_pool_status FROM q WHERE random_rank <= 400""",
)
def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = candidate_pool(issuers(spark, sf_dir), 400, seed=SEED)
    return drawn.select("cik", "sector", "random_rank", "candidate_pool_status")


TIERED = f"""{ISSUERS},
k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY size, cik) AS r, count(*) OVER (PARTITION BY sector) AS n FROM iss),
tr AS (SELECT cik, sector, industry, size, ['small', 'medium', 'large'][CAST(least(floor(3 * (r - 1) / (n - 1)) + 1, 3) AS INTEGER)]
  AS size_tier FROM k)"""


@query("size_terciles", f"WITH {TIERED} SELECT cik, sector, size, size_tier FROM tr")
def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = size_tiers(issuers(spark, sf_dir), size="size", identity="cik", within=["sector"])
    return made.select("cik", "sector", "size", "size_tier")


GOAL = "CASE sector WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN 9 WHEN 'HOUSEHOLD' THEN 6 WHEN 'AUTOMOBILE' THEN 10 WHEN 'FURNITURE' THEN 5 END"
SELECTED = f"""{TIERED},
se0 AS (SELECT *, {H} AS random_score, {GOAL} AS goal FROM tr WHERE {GOAL} IS NOT NULL),
se1 AS (SELECT *, row_number() OVER (PARTITION BY sector, industry, size_tier ORDER BY random_score, cik) AS place FROM se0),
se2 AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY place, industry, size_tier) AS rr FROM se1),
se AS (SELECT cik, sector, industry, size_tier, random_score, CAST(rr AS BIGINT) AS random_rank, 'SELECTED' AS selection_status
  FROM se2 WHERE rr <= goal
  UNION ALL SELECT cik, sector, industry, size_tier, random_score,
    CAST(goal + row_number() OVER (PARTITION BY sector ORDER BY random_score, cik) AS BIGINT), 'RESERVE'
  FROM se2 WHERE rr > goal)"""


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = size_tiers(issuers(spark, sf_dir), size="size", identity="cik", within=["sector"])
    return select_universe(sized, PER_SECTOR, seed=SEED)


@query(
    "universe_selection",
    f"WITH {SELECTED} SELECT cik, sector, industry, size_tier, random_rank, selection_status FROM se",
)
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(spark, sf_dir).select(
        "cik", "sector", "industry", "size_tier", "random_rank", "selection_status"
    )


REPLACED = f"""{SELECTED},
ce AS (SELECT cik, CAST(cik AS BIGINT) % 7 <> 3 AS certified FROM iss),
lo AS (SELECT se.*, row_number() OVER (PARTITION BY sector ORDER BY random_rank, se.cik) AS i
  FROM se JOIN ce USING (cik) WHERE selection_status = 'SELECTED' AND NOT certified),
op AS (SELECT se.*, row_number() OVER (PARTITION BY sector ORDER BY random_rank, random_score, se.cik) AS i
  FROM se JOIN ce USING (cik) WHERE selection_status = 'RESERVE' AND certified),
au AS (SELECT lo.cik AS removed_id, op.cik AS replacement_id, lo.sector, lo.random_rank AS replacement_rank,
    CASE WHEN op.cik IS NULL THEN 'retained_with_quality_flag' ELSE 'frozen_reserve' END AS replacement_source
  FROM lo LEFT JOIN op USING (sector, i))"""


def _replaced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    certification = issuers(spark, sf_dir).select(
        "cik", (F.col("cik").cast("long") % 7 != 3).alias("certified")
    )
    return replace_failures(
        _universe(spark, sf_dir), certification, retain_flagged_shortfall=True
    )


@query("reserve_replacement", f"WITH {REPLACED} SELECT * FROM au")
def replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir)[1]


@query(
    "final_universe",
    f"""WITH {REPLACED}
SELECT cik, sector, random_rank, 'CERTIFIED' AS quality_tier FROM se JOIN ce USING (cik) WHERE selection_status = 'SELECTED' AND certified
UNION ALL SELECT replacement_id, sector, replacement_rank, 'CERTIFIED' FROM au WHERE replacement_id IS NOT NULL
UNION ALL SELECT removed_id, sector, replacement_rank, 'FLAGGED_INSUFFICIENT_CERTIFIED_RESERVE' FROM au WHERE replacement_id IS NULL""",
)
def final_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir)[0].select("cik", "sector", "random_rank", "quality_tier")


@query(
    "selection_digest",
    f"""WITH {SELECTED}
SELECT sha256(array_to_string(list_sort(list(sha256('{{"cik":"' || cik || '","random_rank":' || random_rank || '}}'))), ','))
  AS selection_sha256, CAST(count(*) AS BIGINT) AS rows FROM se WHERE selection_status = 'SELECTED'""",
)
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the chosen list, whose size is the sampling target whatever the table's size."""
    chosen = _universe(spark, sf_dir).where("selection_status = 'SELECTED'")
    return selection_digest(chosen, ["cik", "random_rank"])


RULES = [
    {"codes": [7, 14], "ranges": [], "band": "special", "shelf": "A"},
    {"codes": [], "ranges": [[1, 10], [40, 42]], "band": "small", "shelf": "B"},
    {"codes": [45], "ranges": [[5, 30]], "band": "medium", "shelf": "C"},
]


@query(
    "range_rule_lookup",
    """SELECT p_partkey, p_size,
  CASE WHEN p_size IN (7, 14) THEN 'special' WHEN p_size BETWEEN 1 AND 10 OR p_size BETWEEN 40 AND 42 THEN 'small'
    ELSE 'medium' END AS band,
  CASE WHEN p_size IN (7, 14) THEN 'A' WHEN p_size BETWEEN 1 AND 10 OR p_size BETWEEN 40 AND 42 THEN 'B' ELSE 'C' END AS shelf
FROM part WHERE p_size BETWEEN 1 AND 30 OR p_size BETWEEN 40 AND 42 OR p_size = 45""",
)
def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return range_rule_lookup(parts, "p_size", RULES, outputs=["band", "shelf"])


@query(
    "semi_anti_intersect",
    """WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM f INTERSECT SELECT o_custkey FROM u) AS in_both,
  c_custkey IN (SELECT o_custkey FROM f EXCEPT SELECT o_custkey FROM u) AS only_finished
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM f) OR c_custkey NOT IN (SELECT o_custkey FROM u)""",
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders")

    def keys(condition: str) -> DataFrame:
        return orders.where(condition).select(F.col("o_custkey").alias("c_custkey")).distinct()

    finished, urgent = keys("o_orderstatus = 'F'"), keys("o_orderpriority = '1-URGENT'")
    both = finished.intersect(urgent).withColumn("in_both", F.lit(True))
    only = finished.exceptAll(urgent).withColumn("only_finished", F.lit(True))
    kept = customers.join(finished, "c_custkey", "left_semi").union(
        customers.join(urgent, "c_custkey", "left_anti")
    ).distinct()
    return (
        kept.join(both, "c_custkey", "left")
        .join(only, "c_custkey", "left")
        .na.fill(False, ["in_both", "only_finished"])
    )


@query(
    "screening_reason_precedence",
    """WITH s AS (SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS n,
    count(DISTINCT date_trunc('month', o_orderdate)) AS months
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'NOT_PUBLIC_COMMON_EQUITY'
  WHEN c_mktsegment = 'FURNITURE' OR contains(' ' || upper(c_name) || ' ', '99 ') THEN 'EXCLUDED_ENTITY_TYPE'
  WHEN n < 8 OR months < 7 THEN 'INSUFFICIENT_PRELIMINARY_FILING_HISTORY' ELSE 'CANDIDATE' END AS reason_code FROM s""",
)
def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.trunc("o_orderdate", "month")).alias("months"),
    )
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").na.fill(
        0, ["n", "months"]
    )
    override = F.when(F.col("c_custkey") % 97 == 0, F.lit("NOT_PUBLIC_COMMON_EQUITY"))
    excluded = (F.col("c_mktsegment") == "FURNITURE") | excluded_name("c_name", ["99 "])
    short = (F.col("n") < 8) | (F.col("months") < 7)
    return rows.select("c_custkey", screening_reason(override, excluded, short).alias("reason_code"))


@query(
    "current_listing",
    """WITH a AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents),
b AS (SELECT *, list_transform(t, lambda w: upper(w[1:1])) AS e FROM a),
c AS (SELECT *, list_position(list_transform(e, lambda x: x IN ('V', 'K')), true) AS p FROM b)
SELECT doc_id, CASE WHEN p > 0 THEN t[p] END AS ticker, CASE WHEN p > 0 THEN e[p] END AS exchange FROM c""",
)
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eligible pair of two parallel arrays: a document's words and their initials."""
    words = table(spark, sf_dir, "documents").select(
        "doc_id", F.split("text", " ").alias("t")
    ).withColumn("e", F.transform("t", lambda w: F.upper(F.substring(w, 1, 1))))
    found = words.select("doc_id", current_listing("t", "e", ("V", "K")).alias("l"))
    return found.select("doc_id", "l.ticker", "l.exchange")


CASES = f"""{LB},
d AS (SELECT decision_key, stddev_samp(probability) AS sd FROM lb GROUP BY decision_key),
c AS (SELECT lb.decision_key, sector, probability, round(sd, 8) AS model_probability_std,
    CASE WHEN probability >= 0.5 AND deterioration_label = 1 THEN 'true_positive'
      WHEN probability >= 0.5 THEN 'false_positive' WHEN deterioration_label = 1 THEN 'false_negative'
      ELSE 'true_negative' END AS case_type FROM lb JOIN d USING (decision_key) WHERE model = 'strong')"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_documents(spark, sf_dir)
    spread = model_disagreement(scored)
    rows = scored.where("model = 'strong'").join(spread, "decision_key")
    return rounded(
        rows.select(
            "decision_key",
            "sector",
            "probability",
            "model_probability_std",
            case_type("deterioration_label", F.col("probability") >= 0.5).alias("case_type"),
        ),
        "model_probability_std",
        digits=8,
    )


@query("confusion_case_types", f"WITH {CASES} SELECT * FROM c")
def confusion_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


@query(
    "top_cases_per_group",
    f"""WITH {CASES} SELECT decision_key, sector, probability, CAST(rn AS INTEGER) AS case_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sector ORDER BY probability DESC, decision_key) AS rn FROM c) WHERE rn <= 10""",
)
def top_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = top_cases(_cases(spark, sf_dir), ["sector"], "probability", 10, key="decision_key")
    return made.select("decision_key", "sector", "probability", "case_rank")


@query(
    "priority_review_cases",
    f"""WITH {CASES},
t AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY CASE WHEN case_type = 'false_negative'
    THEN model_probability_std ELSE probability END DESC, decision_key) AS rn FROM c WHERE case_type <> 'true_negative'),
u AS (SELECT *, row_number() OVER (ORDER BY model_probability_std DESC, decision_key) AS rn FROM c),
a AS (SELECT decision_key, sector, probability, case_type,
    list_position(['false_negative', 'false_positive', 'true_positive'], case_type) AS p FROM t WHERE rn <= 5
  UNION ALL SELECT decision_key, sector, probability, 'unstable', 9 FROM u WHERE rn <= 5)
SELECT decision_key, sector, probability, case_type FROM a
QUALIFY row_number() OVER (PARTITION BY decision_key ORDER BY p) = 1""",
)
def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = priority_review_cases(_cases(spark, sf_dir))
    return made.select("decision_key", "sector", "probability", "case_type")
