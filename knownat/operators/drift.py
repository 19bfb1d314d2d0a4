"""Distribution drift and operating monitors between a reference and a current population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownat.operators.checks import require_columns
from knownat.operators.scoring import LABEL, SCORE, ranking_metrics
from knownat.scale import exact_quantiles

SHARE_FLOOR = 1e-6
PSI_WARNING, PSI_ESCALATION, MISSING_WARNING = 0.10, 0.25, 0.05


def _unpivot(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                    for f in features
                ]
            )
        ).alias("c")
    ).select("c.feature", "c.value")


def stability_index(
    reference: DataFrame, current: DataFrame, features: Sequence[str], *, bins: int = 10
) -> DataFrame:
    """Population stability index and missing rates per feature.

    Reference quantiles are the bin edges.  Rows become (feature, bin) counts map-side, so only
    ``features x bins`` rows are ever joined; both populations are read once for the counts.
    """
    require_columns(reference, features, "reference population")
    require_columns(current, features, "current population")
    base = _unpivot(reference, features)
    both = base.withColumn("__now", F.lit(0)).unionByName(
        _unpivot(current, features).withColumn("__now", F.lit(1))
    )
    edges = exact_quantiles(base, ["feature"], "value", [i / bins for i in range(bins + 1)])
    cuts = F.array_distinct("quantiles")
    edges = edges.select(
        "feature",
        F.slice(cuts, 2, F.greatest(F.size(cuts) - 2, F.lit(0))).alias("__inner"),
        F.size(cuts).alias("__edges"),
    )
    placed = F.when(
        F.col("value").isNotNull(), F.size(F.filter("__inner", lambda e: e <= F.col("value")))
    )
    # One row per listed feature: packed into one row, the edges need no shuffle of the rows.
    table = edges.agg(
        F.map_from_entries(
            F.collect_list(F.struct("feature", F.struct("__inner", "__edges")))
        ).alias("__table")
    )
    one = F.lit(1).alias("__one")
    counted = (
        both.select("*", one)
        .join(F.broadcast(table.select("*", one)), "__one")
        .select("feature", "value", "__now", F.col("__table")[F.col("feature")].alias("__cut"))
        .select("feature", "value", "__now", "__cut.__inner", "__cut.__edges")
        .groupBy("feature", "__edges", placed.alias("__bin"))
        .agg(
            F.sum((F.col("__now") == 0).cast("long")).alias("was"),
            F.sum((F.col("__now") == 1).cast("long")).alias("is"),
        )
    )
    packed = counted.groupBy("feature").agg(
        F.max("__edges").alias("__edges"),
        F.sum("was").alias("__was"),
        F.sum("is").alias("__is"),
        F.coalesce(F.sum(F.when(F.col("__bin").isNotNull(), F.col("was"))), F.lit(0)).alias("__bw"),
        F.coalesce(F.sum(F.when(F.col("__bin").isNotNull(), F.col("is"))), F.lit(0)).alias("__bi"),
        F.array_sort(
            F.collect_list(F.when(F.col("__bin").isNotNull(), F.struct("__bin", "was", "is")))
        ).alias("__bins"),
    )

    def share(count: Column, whole: Column) -> Column:
        return F.greatest(count / whole, F.lit(SHARE_FLOOR))

    # A bin empty on both sides has equal floored shares and adds nothing, so it may be absent.
    total = F.aggregate(
        "__bins",
        F.lit(0.0),
        lambda acc, b: acc
        + (share(b["is"], F.col("__bi")) - share(b["was"], F.col("__bw")))
        * F.log(share(b["is"], F.col("__bi")) / share(b["was"], F.col("__bw"))),
    )
    index = F.when((F.col("__bw") >= bins) & (F.col("__bi") > 0),
                   F.when(F.col("__edges") < 3, F.lit(0.0)).otherwise(total))
    return packed.select(
        "feature",
        index.alias("population_stability_index"),
        (1 - F.col("__bw") / F.col("__was")).alias("reference_missing_rate"),
        (1 - F.col("__bi") / F.col("__is")).alias("current_missing_rate"),
    )


def feature_monitoring(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    *,
    warning: float = PSI_WARNING,
    escalation: float = PSI_ESCALATION,
    missing_warning: float = MISSING_WARNING,
    action: str = "investigate_before_use",
) -> DataFrame:
    """Stability, missingness change, severity and action per feature."""
    table = stability_index(reference, current, features)
    change = F.col("current_missing_rate") - F.col("reference_missing_rate")
    psi = F.col("population_stability_index")
    severity = (
        F.when(psi >= escalation, "escalation")
        .when((psi >= warning) | (change >= missing_warning), "warning")
        .otherwise("normal")
    )
    return table.withColumn("missingness_change", change).select(
        "*",
        severity.alias("severity"),
        F.when(severity != "normal", action).otherwise("continue_monitoring").alias("action"),
    )


def mix_change(reference: DataFrame, current: DataFrame, category: str) -> DataFrame:
    """Shares of each category in both populations and their absolute change."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(category).isNotNull()).groupBy(category).agg(
            F.count(F.lit(1)).alias(name)
        )

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sum(name).alias(f"{name}_all")).withColumn("__one", F.lit(1))

    was, now = counts(reference, "was"), counts(current, "now")
    joined = was.join(now, category, "full").withColumn("__one", F.lit(1))
    shares = joined.join(F.broadcast(total(was, "was")), "__one").join(
        F.broadcast(total(now, "now")), "__one"
    )  # single-row totals
    before = F.coalesce(F.col("was"), F.lit(0)) / F.col("was_all")
    after = F.coalesce(F.col("now"), F.lit(0)) / F.col("now_all")
    return shares.select(
        category,
        before.alias("reference_share"),
        after.alias("current_share"),
        F.abs(after - before).alias("absolute_change"),
    )


def operational_monitors(
    features: DataFrame,
    predictions: DataFrame,
    *,
    boundary: str,
    source_cutoff: str,
    alert: Column,
    decision_time: str = "decision_at",
    category: str = "sector",
    label: str = LABEL,
    score: str = SCORE,
    mix_warning: float = 0.05,
    calibration_warning: float = 0.05,
    alert_rate_upper: float = 0.50,
) -> DataFrame:
    """Freshness, mix, event rate, ranking, calibration-in-the-large and alert-rate lines."""
    edge = F.lit(boundary).cast("timestamp")
    reference = features.where(F.col(decision_time) < edge)
    current = features.where(F.col(decision_time) >= edge)
    one = F.lit(1).alias("__one")
    freshness = features.agg(
        F.datediff(F.lit(source_cutoff).cast("date"), F.max(decision_time))
        .cast("double")
        .alias("days")
    ).select("*", one)
    mix = mix_change(reference, current, category).agg(
        F.max("absolute_change").alias("mix")
    ).select("*", one)
    rank = ranking_metrics(predictions, [], label, score).select("PR_AUC", one)
    rates = predictions.agg(
        F.avg(F.col(label).cast("double")).alias("events"),
        F.abs(F.avg(score) - F.avg(F.col(label).cast("double"))).alias("gap"),
        F.avg(alert.cast("double")).alias("alerts"),
    ).select("*", one)
    single = freshness.join(mix, "__one").join(rank, "__one").join(rates, "__one")

    def line(name: str, value: Column, unit: str, bad: Column | None, status: str, action: str,
             usual: str = "continue_monitoring", otherwise: str = "normal") -> Column:
        hit = F.lit(False) if bad is None else F.coalesce(bad, F.lit(False))
        return F.struct(
            F.lit(name).alias("monitor"),
            value.cast("double").alias("value"),
            F.lit(unit).alias("unit"),
            F.when(hit, status).otherwise(otherwise).alias("status"),
            F.when(hit, action).otherwise(usual).alias("action"),
        )

    lines = [
        line("source_freshness", F.col("days"), "days_before_financial_cutoff",
             F.col("days") < 0, "failure", "stop_and_refresh_sources"),
        line("largest_sector_mix_change", F.col("mix"), "absolute_share_change",
             F.col("mix") >= mix_warning, "warning", "investigate_population_composition"),
        line("matured_event_rate", F.col("events"), "share", None, "", "",
             "compare_with_training_event_rate", "diagnostic"),
        line("ranking_PR_AUC", F.col("PR_AUC"), "score", None, "", "",
             "reconsider_features_and_model_on_confirmed_failure", "development_only"),
        line("calibration_error", F.col("gap"), "absolute_mean_probability_error",
             F.col("gap") >= calibration_warning, "warning", "recalibrate_on_matured_labels"),
        line("alert_rate", F.col("alerts"), "share",
             F.col("alerts") > alert_rate_upper, "warning",
             "review_threshold_and_analyst_capacity"),
    ]
    return single.select(F.inline(F.array(*lines)))


__all__ = [
    "feature_monitoring",
    "mix_change",
    "operational_monitors",
    "stability_index",
]
