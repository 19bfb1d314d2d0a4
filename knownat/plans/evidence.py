"""Model-comparison evidence from out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.operators.checks import fail_if_duplicated, require_columns
from knownat.operators.labels import episode_runs
from knownat.operators.resample import clustered_bootstrap
from knownat.operators.scoring import (
    LABEL,
    SCORE,
    brier_decomposition,
    confusion_metrics,
    decision_value,
    episode_capture,
    equal_width_calibration_error,
    ranking_from_cells,
    regroup,
    review_queue,
    score_cells,
    top_share_lift,
    with_overall,
)
from knownat.scale import exact_quantiles, weighted_quantiles


def variant_names(df: DataFrame) -> DataFrame:
    """Fold feature increment and calibration into the model name."""
    name = F.col("model")
    if "feature_increment" in df.columns:
        name = F.concat_ws(" | ", name, F.col("feature_increment"))
    if "calibration_method" in df.columns:
        scope = F.col("calibration_scope") if "calibration_scope" in df.columns else F.lit("overall")
        name = F.concat(
            name, F.lit(" | calibration="), F.col("calibration_method"), F.lit(" | scope="), scope
        )
    return df.withColumn("model", name)


def sliced_metrics(df: DataFrame, *, reference_alert_rate: float = 0.20) -> DataFrame:
    """Ranking, calibration and threshold metrics per model: overall, by sector and by tier.

    Cells are cut once at the finest grain and repeated per slice afterwards; the model's
    threshold is its median recorded threshold, or the upper score quantile.
    """
    tiers = {"quality_tier": "Quality: "} if "quality_tier" in df.columns else {}
    fine = score_cells(df, ["model", "sector", *tiers], LABEL, SCORE)
    sliced = with_overall(fine, {"sector": "", **tiers})
    cells = regroup(sliced, ["model", "slice"], SCORE)
    if "threshold" in df.columns:
        cut = exact_quantiles(df, ["model"], "threshold", [0.5])
    else:
        cut = weighted_quantiles(
            regroup(fine, ["model"], SCORE), ["model"], SCORE, "n", [1 - reference_alert_rate]
        )
    cut = cut.select("model", F.col("quantiles")[0].alias("__cut"))
    keys = ["model", "slice"]
    # Cells carry counts of both classes: split them so the confusion counts can be weighted.
    weighted = (
        cells.join(cut, "model")
        .select(
            *keys,
            SCORE,
            "__cut",
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("y"), F.col("pos").alias("w")),
                    F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("w")),
                )
            ).alias("c"),
        )
        .select(*keys, SCORE, "__cut", F.col("c.y").alias(LABEL), F.col("c.w").alias("__w"))
    )
    operated = confusion_metrics(
        weighted, keys, F.col(SCORE) >= F.col("__cut"), LABEL, F.col("__w")
    ).select(*keys, "recall", "precision", "alert_rate", "false_alert_rate")
    lift = top_share_lift(
        with_overall(df, {"sector": "", **tiers}), keys, label=LABEL, score=SCORE
    )
    return (
        ranking_from_cells(cells, keys, SCORE)
        .join(operated, keys)
        .join(equal_width_calibration_error(cells, keys, SCORE), keys)
        .join(lift, keys)
    )


def development_evidence(
    predictions: DataFrame,
    *,
    review_fractions: Sequence[float] = (0.05, 0.10, 0.20),
    missed_event_cost: float = 5.0,
    unnecessary_review_cost: float = 1.0,
    correct_alert_benefit: float = 0.0,
    repetitions: int = 500,
    level: float = 0.95,
    seed: int = 20260805,
    cluster: str = "cik",
) -> dict[str, Callable[[], DataFrame]]:
    """Metrics, queues, episode capture, clustered uncertainty, value and calibration tables.

    Each entry makes its table when called, so asking for one runs nothing for the others.
    """
    require_columns(
        predictions,
        ["decision_key", "cik", "decision_at", "sector", LABEL, "model", SCORE],
        "predictions",
    )
    data = variant_names(predictions)
    fail_if_duplicated(
        data, ["decision_key", "model"], "a model scored the same decision more than once"
    )
    cells = score_cells(data, ["model", "sector"], LABEL, SCORE)

    def value() -> DataFrame:
        """Cells of (model, score) meet the model's few thresholds, each fraction one column."""
        by_model = regroup(cells, ["model"], SCORE)
        cuts = weighted_quantiles(
            by_model, ["model"], SCORE, "n", [1 - f for f in review_fractions]
        )
        asked = F.transform(
            F.arrays_zip(
                F.array(*[F.lit(float(f)) for f in review_fractions]).alias("f"),
                F.col("quantiles").alias("q"),
            ),
            lambda c: F.struct(c["f"].alias("review_fraction"), c["q"].alias("threshold")),
        )
        counted = F.explode(
            F.array(
                F.struct(F.lit(1).alias(LABEL), F.col("pos").alias("__w")),
                F.struct(F.lit(0).alias(LABEL), (F.col("n") - F.col("pos")).alias("__w")),
            )
        ).alias("w")
        offered = (
            by_model.join(cuts.select("model", asked.alias("c")), "model")
            .select("model", SCORE, "n", "pos", F.explode("c").alias("c"))
            .select("model", SCORE, "c.*", counted)
            .select("model", SCORE, "review_fraction", "threshold", "w.*")
        )
        return decision_value(
            offered,
            ["model", "review_fraction", "threshold"],
            F.col(SCORE) >= F.col("threshold"),
            missed_event_cost=missed_event_cost,
            unnecessary_review_cost=unnecessary_review_cost,
            correct_alert_benefit=correct_alert_benefit,
            weight=F.col("__w"),
        )

    def capture() -> DataFrame:
        marked = episode_runs(
            data.withColumn("__series", F.concat_ws("|", "model", "cik")), entity="__series"
        )
        return episode_capture(marked, ["model"], review_fractions)

    def uncertainty() -> DataFrame:
        return clustered_bootstrap(
            data,
            within=["model"],
            cluster=cluster,
            repetitions=repetitions,
            level=level,
            seed=seed,
        )

    def decomposition() -> DataFrame:
        sliced = regroup(with_overall(cells, {"sector": ""}), ["model", "slice"], SCORE)
        return brier_decomposition(sliced, ["model", "slice"], SCORE)

    return {
        "metrics": lambda: sliced_metrics(data),
        "review_queues": lambda: review_queue(data, ["model"], review_fractions),
        "episode_capture": capture,
        "clustered_uncertainty": uncertainty,
        "decision_value": value,
        "calibration_decomposition": decomposition,
    }
