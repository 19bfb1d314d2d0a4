"""Bitemporal joins: what was known at a decision, never what became known later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions import fiscal_position
from knownat.operators.checks import fail_if_any, require_columns
from knownat.scale import last_known, same_keys


def asof_join(
    decisions: DataFrame,
    observations: DataFrame,
    *,
    by: Sequence[str],
    decision_time: str = "decision_at",
    available_time: str = "available_at",
    decision_id: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Each decision with the latest observation available at or before it (NULLs if none).

    Both sides are interleaved on the time line of their key and the last observation is carried
    forward, so the work is one ordered pass: no pair of rows is ever formed.  A key of any size
    is spread over blocks by ``last_known``.  ``tie_break`` orders observations of equal time
    (the greatest wins); ``decision_id`` makes the order of a key's rows total.
    """
    by = list(by)
    require_columns(decisions, [*by, decision_time, *decision_id], "decisions")
    require_columns(observations, [*by, available_time, *tie_break], "observations")
    carried = [c for c in observations.columns if c not in by]
    clash = sorted(set(carried) & set(decisions.columns))
    if clash:
        raise ValueError(f"rename columns present on both sides: {clash}")
    left = decisions.select(
        *by,
        F.col(decision_time).cast("timestamp").alias("__at"),
        F.lit(1).alias("__side"),
        F.struct(*[F.lit(0)] if not decision_id else decision_id).cast("string").alias("__id"),
        F.struct(*decisions.columns).alias("__decision"),
    )
    right = observations.where(F.col(available_time).isNotNull()).select(
        *by,
        F.col(available_time).cast("timestamp").alias("__at"),
        F.lit(0).alias("__side"),
        F.struct(*[F.col(c) for c in tie_break], *[F.col(c) for c in carried]).alias("__rank"),
        F.struct(*carried).alias("__seen"),
    )
    line = left.unionByName(right, allowMissingColumns=True)
    order = [
        F.col("__at"),
        F.col("__side"),
        F.col("__rank").asc_nulls_first(),
        F.col("__id").asc_nulls_first(),
    ]
    known = last_known(line, by, order, "__seen", "__last").where("__side = 1")
    return known.select("__decision.*", *[F.col("__last")[c].alias(c) for c in carried])


def assert_known(df: DataFrame, available_time: str, decision_time: str) -> None:
    fail_if_any(
        df,
        F.col(available_time) > F.col(decision_time),
        f"{available_time} is later than {decision_time}",
    )


def vintage_window_aggregate(
    decisions: DataFrame,
    vintages: DataFrame,
    series: Mapping[str, str],
    *,
    period_end: str = "period_end",
    decision_time: str = "decision_at",
    series_id: str = "series_id",
    observed: str = "observation_date",
    available: str = "available_at",
    value: str = "value",
    days: int = 92,
    available_max: str = "macro_available_at_max",
) -> DataFrame:
    """Aggregate each series over the ``days`` ending at period end, as known at the decision.

    ``series`` maps a series id to ``"mean"`` or ``"sum"``.  Rows sharing the same two dates
    share one answer, so the range join runs on distinct date pairs (bounded by the calendar,
    not by the panel) and on one row per observation vintage; both sides are cut by
    series and month, which makes it an equi-join with a small residual filter.
    """
    require_columns(decisions, [period_end, decision_time], "decisions")
    wanted = vintages.where(F.col(series_id).isin(*series)).select(
        F.col(series_id).alias("__series"),
        F.to_date(observed).alias("__obs"),
        F.to_date(available).alias("__avail"),
        F.col(value).cast("double").alias("__value"),
    )
    # One row per vintage date; a later listing of the same date must not fan out the join.
    wanted = wanted.groupBy("__series", "__obs", "__avail").agg(F.max("__value").alias("__value"))
    pairs = decisions.select(
        F.to_date(period_end).alias("__end"), F.to_date(decision_time).alias("__dec")
    ).distinct()

    def month(day):
        return F.year(day) * 12 + F.month(day)

    begin = F.date_sub("__end", days)
    cut = pairs.withColumn(
        "__month", F.explode(F.sequence(month(begin), month(F.col("__end"))))
    ).withColumn("__series", F.explode(F.array(*[F.lit(s) for s in series])))
    keys = ["__series", "__month"]
    met = cut.join(wanted.withColumn("__month", month(F.col("__obs"))), keys).where(
        (F.col("__obs") >= begin)
        & (F.col("__obs") <= F.col("__end"))
        & (F.col("__avail") <= F.col("__dec"))
    )
    latest = met.groupBy("__end", "__dec", "__series", "__obs").agg(
        F.max(F.struct("__avail", "__value")).alias("__v")
    )
    per_pair = latest.groupBy("__end", "__dec").agg(
        *[
            _series_value(name, how).alias(name)
            for name, how in series.items()
        ],
        F.max("__v.__avail").alias(available_max),
    )
    keyed = decisions.withColumns(
        {"__end": F.to_date(period_end), "__dec": F.to_date(decision_time)}
    )
    return keyed.join(per_pair, ["__end", "__dec"], "left").drop("__end", "__dec")


def _series_value(name: str, how: str):
    mine = F.col("__series") == name
    chosen = F.when(mine, F.col("__v.__value"))
    if how == "mean":
        return F.avg(chosen)
    if how != "sum":
        raise ValueError(f"unknown aggregation: {how}")
    # A window that holds only missing values sums to zero; an empty window stays missing.
    return F.when(F.max(mine), F.coalesce(F.sum(chosen), F.lit(0.0)))


def prior_event_rate(
    rows: DataFrame,
    *,
    entity: str = "cik",
    decision_time: str = "decision_at",
    label: str = "deterioration_label",
    label_time: str = "label_available_at",
    prior_events: float = 1.0,
    prior_quiet: float = 4.0,
) -> DataFrame:
    """Smoothed rate of past positives whose labels were known strictly before each decision."""
    require_columns(rows, [entity, decision_time, label, label_time], "prior rate input")
    ends = rows.where(F.col(label).isNotNull() & F.col(label_time).isNotNull()).select(
        entity,
        F.col(label_time).cast("timestamp").alias("__at"),
        F.lit(1).alias("__side"),
        F.col(label).cast("double").alias("__y"),
    )
    asks = rows.select(
        entity,
        F.col(decision_time).cast("timestamp").alias("__at"),
        F.lit(0).alias("__side"),
        F.struct(*rows.columns).alias("__row"),
    )
    # A question precedes labels of the same moment, which keeps the comparison strict.
    upto = (
        Window.partitionBy(entity)
        .orderBy("__at", "__side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = asks.unionByName(ends, allowMissingColumns=True).withColumns(
        {
            "__n": F.count("__y").over(upto),
            "__pos": F.coalesce(F.sum("__y").over(upto), F.lit(0.0)),
        }
    )
    return _posterior(
        counted.where("__side = 0").select("__row.*", "__n", "__pos"), prior_events, prior_quiet
    )


def prior_event_rate_at_origin(
    training: DataFrame,
    scoring: DataFrame,
    origin: str,
    *,
    entity: str = "cik",
    label: str = "deterioration_label",
    label_time: str = "label_available_at",
    prior_events: float = 1.0,
    prior_quiet: float = 4.0,
) -> DataFrame:
    """The same rate for scoring rows, all of which use labels known before one origin."""
    known = (
        training.where(F.col(label).isNotNull() & (F.col(label_time) < F.lit(origin)))
        .groupBy(entity)
        .agg(F.count(label).alias("__n"), F.sum(F.col(label).cast("double")).alias("__pos"))
    )
    joined = same_keys(scoring, known, [entity], "left").na.fill(0, ["__n", "__pos"])
    return _posterior(joined, prior_events, prior_quiet)


def _posterior(df: DataFrame, events: float, quiet: float) -> DataFrame:
    return df.withColumns(
        {
            "prior_deterioration_rate": (F.col("__pos") + events)
            / (F.col("__n") + events + quiet),
            "prior_deterioration_evidence": F.log1p(F.col("__n")),
        }
    ).drop("__n", "__pos")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], origin: str, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Keep the row of the newest origin per key (a map-side combinable maximum)."""
    rest = [c for c in df.columns if c not in keys and c != origin and c not in tie_break]
    newest = F.max(F.struct(origin, *tie_break, *rest)).alias("__newest")
    picked = df.groupBy(*keys).agg(newest)
    return picked.select(*keys, "__newest.*").select(*df.columns)


__all__ = [
    "asof_join",
    "assert_known",
    "fiscal_position",
    "latest_per_key",
    "prior_event_rate",
    "prior_event_rate_at_origin",
    "vintage_window_aggregate",
]
