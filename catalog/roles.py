"""The benchmark tables cast into the roles the operators expect, in Spark and in SQL.

* supplier panel: supplier x quarter flows from ``lineitem`` (dense), sector = region;
* customer panel: customer x quarter from ``orders`` (sparse, with gaps and nulls);
* filings: ``lineitem`` rows as restated facts of a supplier's fiscal quarter;
* vintages: ``orders`` as a vintage series per priority;
* scores: labelled ``documents`` with a reproducible score.

Raw rows always collapse to (entity, quarter) map-side before anything else happens, so a
supplier or customer holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownat.functions import hash_score, quarter_end, quarter_position, round_half_away


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("industry"), F.col("r_name").alias("sector")
    )


def _calendar(position: Column | str) -> list[Column]:
    p = F.col(position) if isinstance(position, str) else position
    year = F.floor(p / 4).cast("int")
    end = F.last_day(F.make_date(year, (p % 4 * 3 + 3).cast("int"), F.lit(1)))
    return [
        year.alias("fiscal_year"),
        (p % 4 + 1).cast("int").alias("fiscal_quarter_number"),
        end.alias("period_end"),
    ]


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    flows = line.groupBy(
        F.col("l_suppkey").alias("entity"), quarter_position("l_shipdate").alias("qpos")
    ).agg(
        F.round(F.sum(net), 4).alias("revenue"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 4).alias("interest"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "N", net).otherwise(0.0)), 4).alias("__n"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", net).otherwise(0.0)), 4).alias("__r"),
        F.round(F.sum(F.when(F.col("l_linestatus") == "F", net).otherwise(0.0)), 4).alias("__f"),
        F.round(
            F.sum(
                F.when(
                    (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25),
                    F.col("l_extendedprice"),
                )
            ),
            2,
        ).alias("debt"),
        F.round(F.sum("l_extendedprice"), 2).alias("assets"),
        F.count(F.lit(1)).alias("lines"),
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = flows.join(suppliers, F.col("entity") == F.col("s_suppkey")).join(
        geography(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")
    )
    dated = placed.select(
        "entity",
        "sector",
        "industry",
        "qpos",
        *_calendar("qpos"),
        "revenue",
        "interest",
        round_half_away(0.25 * F.col("revenue") + F.col("__n") - F.col("__r"), 4).alias("income"),
        round_half_away(F.col("__f") - 0.4 * F.col("revenue"), 4).alias("cash"),
        "debt",
        "assets",
        "lines",
    )
    return dated.select(
        "*",
        F.date_add("period_end", (F.lit(20) + F.col("entity") % 25).cast("int")).alias(
            "decision_at"
        ),
        F.concat_ws(
            "|", F.col("entity").cast("string"), F.col("fiscal_year").cast("string"),
            F.concat(F.lit("FQ"), F.col("fiscal_quarter_number").cast("string")),
        ).alias("decision_key"),
        F.when(
            F.col("interest") > 0, round_half_away(F.col("income") / F.col("interest"), 6)
        ).alias("coverage"),
        F.when(
            F.col("revenue") > 0, round_half_away(F.col("cash") / F.col("revenue"), 6)
        ).alias("cash_margin"),
        F.when(
            F.col("assets") > 0, round_half_away(F.col("debt") / F.col("assets"), 6)
        ).alias("leverage"),
    )


SQ = """
sq AS (
  SELECT b.*,
    CAST(b.period_end + CAST(20 + b.entity % 25 AS INTEGER) AS DATE) AS decision_at,
    b.entity || '|' || b.fiscal_year || '|FQ' || b.fiscal_quarter_number AS decision_key,
    CASE WHEN b.interest > 0 THEN round(b.income / b.interest, 6) END AS coverage,
    CASE WHEN b.revenue > 0 THEN round(b.cash / b.revenue, 6) END AS cash_margin,
    CASE WHEN b.assets > 0 THEN round(b.debt / b.assets, 6) END AS leverage
  FROM (
    SELECT a.entity, r_name AS sector, n_name AS industry, a.qpos,
      CAST(a.qpos // 4 AS INTEGER) AS fiscal_year,
      CAST(a.qpos % 4 + 1 AS INTEGER) AS fiscal_quarter_number,
      CAST(last_day(make_date(CAST(a.qpos // 4 AS INTEGER), CAST(a.qpos % 4 * 3 + 3 AS INTEGER), 1)) AS DATE)
        AS period_end,
      a.revenue, a.interest,
      round(0.25::DOUBLE * a.revenue + a.n_net - a.r_net, 4) AS income,
      round(a.f_net - 0.4::DOUBLE * a.revenue, 4) AS cash,
      a.debt, a.assets, a.lines
    FROM (
      SELECT l_suppkey AS entity,
        CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS qpos,
        round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
        round(sum(l_extendedprice * l_tax), 4) AS interest,
        round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * (1 - l_discount) ELSE 0.0::DOUBLE END), 4) AS n_net,
        round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0.0::DOUBLE END), 4) AS r_net,
        round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) ELSE 0.0::DOUBLE END), 4) AS f_net,
        round(sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN l_extendedprice END), 2) AS debt,
        round(sum(l_extendedprice), 2) AS assets,
        CAST(count(*) AS BIGINT) AS lines
      FROM lineitem GROUP BY 1, 2
    ) a
    JOIN supplier ON s_suppkey = a.entity
    JOIN nation ON n_nationkey = s_nationkey
    JOIN region ON r_regionkey = n_regionkey
  ) b
)"""


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sums = orders.groupBy(
        F.col("o_custkey").alias("entity"), quarter_position("o_orderdate").alias("qpos")
    ).agg(
        F.round(F.sum("o_totalprice"), 2).alias("amount"),
        F.round(
            F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), 2
        ).alias("settled"),
        F.round(
            F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), 2
        ).alias("urgent"),
        F.count(F.lit(1)).alias("orders"),
    )
    return sums.select("entity", "qpos", *_calendar("qpos"), "amount", "settled", "urgent", "orders")


CQ = """
cq AS (
  SELECT entity, qpos,
    CAST(qpos // 4 AS INTEGER) AS fiscal_year,
    CAST(qpos % 4 + 1 AS INTEGER) AS fiscal_quarter_number,
    CAST(last_day(make_date(CAST(qpos // 4 AS INTEGER), CAST(qpos % 4 * 3 + 3 AS INTEGER), 1)) AS DATE) AS period_end,
    amount, settled, urgent, orders
  FROM (
    SELECT o_custkey AS entity,
      CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS qpos,
      round(sum(o_totalprice), 2) AS amount,
      round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) AS settled,
      round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2) AS urgent,
      CAST(count(*) AS BIGINT) AS orders
    FROM orders GROUP BY 1, 2
  )
)"""

CONCEPTS = {"A": "revenue", "N": "interest_expense", "R": "total_assets"}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line is one reported fact; order and part numbers decide when it was filed."""
    line = table(spark, sf_dir, "lineitem")
    concept = F.lit(None).cast("string")
    for letter, name in CONCEPTS.items():
        concept = F.when(F.col("l_returnflag") == letter, name).otherwise(concept)
    quarter = F.quarter("l_shipdate")
    end = quarter_end("l_shipdate")
    lag = (F.lit(20) + (F.col("l_orderkey") + 3 * F.col("l_partkey")) % 500).cast("int")
    # Literal names, so that conditions on the period become conditions on the quarter.
    period = F.when(quarter == 4, "FY")
    for number in (1, 2, 3):
        period = period.when(quarter == number, f"Q{number}")
    return line.select(
        F.col("l_suppkey").cast("string").alias("cik"),
        concept.alias("concept"),
        F.when(F.col("l_returnflag") == "R", "instant").otherwise("duration").alias("period_type"),
        (F.col("l_linenumber") % 3).cast("int").alias("tag_priority"),
        F.year("l_shipdate").alias("fiscal_year"),
        period.alias("fiscal_period"),
        F.lit(None).cast("date").alias("start_date"),
        end.alias("end_date"),
        F.col("l_extendedprice").alias("value"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"),
                    F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("accession_number"),
        F.when(F.col("l_partkey") % 13 == 0, "8-K")  # some of another kind, some amended
        .otherwise(
            F.concat(
                F.when(quarter == 4, "10-K").otherwise("10-Q"),
                F.when(F.col("l_orderkey") % 11 == 0, "/A").otherwise(""),
            )
        )
        .alias("form"),
        F.date_add(end, lag).alias("filed_at"),
        F.when(F.col("l_linestatus") == "O", 90).otherwise(90 * quarter).alias("duration_days"),
    )


FX = """
fx AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS cik,
    CASE l_returnflag WHEN 'A' THEN 'revenue' WHEN 'N' THEN 'interest_expense' ELSE 'total_assets' END AS concept,
    CASE WHEN l_returnflag = 'R' THEN 'instant' ELSE 'duration' END AS period_type,
    CAST(l_linenumber % 3 AS INTEGER) AS tag_priority,
    CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
    CAST(quarter(l_shipdate) AS INTEGER) AS q,
    CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS DATE) AS end_date,
    l_extendedprice AS value,
    lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS accession_number,
    CAST(last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS DATE)
      + CAST(20 + (l_orderkey + 3 * l_partkey) % 500 AS INTEGER) AS filed_at,
    CAST(CASE WHEN l_linestatus = 'O' THEN 90 ELSE 90 * quarter(l_shipdate) END AS INTEGER) AS duration_days,
    CASE WHEN l_partkey % 13 = 0 THEN '8-K' ELSE CASE quarter(l_shipdate) WHEN 4 THEN '10-K' ELSE '10-Q' END
      || CASE WHEN l_orderkey % 11 = 0 THEN '/A' ELSE '' END END AS form
  FROM lineitem
)"""


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value (whole units) per priority and day, learned over up to forty later days."""
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return orders.groupBy(
        F.col("o_orderpriority").alias("series_id"),
        day.alias("observation_date"),
        F.date_add(day, (F.col("o_orderkey") % 40).cast("int")).alias("available_at"),
    ).agg(F.floor(F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).cast("double").alias("value"))


VX = """
vx AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS observation_date,
    CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS DATE) AS available_at,
    CAST(floor(round(sum(o_totalprice), 2) / count(*)) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2, 3
)"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores of every labelled document."""
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = labels.join(documents, "doc_id")

    def score(seed: int, pull: float) -> Column:
        return round_half_away(0.65 * hash_score("doc_id", seed) + pull * F.col("quality"), 3)

    return rows.select(
        F.col("doc_id").alias("decision_key"),
        F.col("lang").alias("sector"),
        F.col("source").alias("cik"),
        F.col("quality").cast("int").alias("deterioration_label"),
        "n_chars",
        F.explode(
            F.array(
                F.struct(F.lit("weak").alias("model"), score(7, 0.1).alias("probability")),
                F.struct(F.lit("strong").alias("model"), score(11, 0.3).alias("probability")),
            )
        ).alias("m"),
    ).select("decision_key", "sector", "cik", "deterioration_label", "n_chars", "m.*")


HASH = "CAST(CAST(('0x' || substr(sha256('{seed}:' || {id}), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551615.0::DOUBLE"

LB = f"""
lb AS (
  SELECT doc_id AS decision_key, lang AS sector, source AS cik,
    CAST(quality AS INTEGER) AS deterioration_label, n_chars, model,
    CASE WHEN model = 'weak'
      THEN round(0.65::DOUBLE * ({HASH.format(seed=7, id="doc_id")}) + 0.1::DOUBLE * quality, 3)
      ELSE round(0.65::DOUBLE * ({HASH.format(seed=11, id="doc_id")}) + 0.3::DOUBLE * quality, 3)
    END AS probability
  FROM labels JOIN documents USING (doc_id), (VALUES ('weak'), ('strong')) m(model)
)"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Columns rounded as SQL's ``round`` does it; only floating-point ones differ from Spark's."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            n: round_half_away(n, digits) if types[n] == "double" else F.round(F.col(n), digits)
            for n in names
        }
    )
