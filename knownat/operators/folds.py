"""Temporal folds: train on labels already known, embargo the rest, never look ahead.

Fold origins are a short list of dates derived from the first and last decision; rows meet their
folds through an exploded literal array, so only the (row, fold) pairs that belong to a split are
ever produced.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.functions import quarter_position
from knownat.operators.checks import fail_if_any, require_columns

LABEL = "deterioration_label"


def _position(day: date) -> int:
    return day.year * 4 + (day.month - 1) // 3


def _start(position: int) -> date:
    return date(position // 4, position % 4 * 3 + 1, 1)


def _as_date(value: str | date | datetime) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(value[:10])


def first_decision(df: DataFrame, time: str) -> date:
    """One aggregated value; everything else about the folds follows from it."""
    found = df.agg(F.min(F.to_date(time))).first()[0]
    if found is None:
        raise ValueError("no decision precedes the holdout")
    return found


def expanding_origins(
    earliest: date, holdout: date, *, minimum_training: int, window: int, step: int
) -> list[tuple[int, date, date]]:
    """(number, validation start, validation end) of every candidate fold."""
    begin, found = _position(earliest) + minimum_training, []
    while _start(begin) < holdout and _start(begin + window) <= holdout:
        found.append((len(found) + 1, _start(begin), _start(begin + window)))
        begin += step
    return found


def expanding_window_splits(
    df: DataFrame,
    *,
    holdout_start: str = "2023-01-01",
    minimum_training_quarters: int = 24,
    validation_window_quarters: int = 4,
    step_quarters: int = 4,
    key: str = "decision_key",
    entity: str = "cik",
    time: str = "decision_at",
    label: str = LABEL,
    label_time: str = "label_available_at",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, locked holdout rows, fold summary) with the label embargo applied."""
    require_columns(df, [key, entity, time, label, label_time], "fold input")
    holdout = _as_date(holdout_start)
    edge = F.lit(holdout).cast("timestamp")
    development = df.where(F.col(time) < edge)
    origins = expanding_origins(
        first_decision(development, time),
        holdout,
        minimum_training=minimum_training_quarters,
        window=validation_window_quarters,
        step=step_quarters,
    )
    if not origins:
        raise ValueError("no temporal fold satisfies the configured minimum history")
    folds = F.array(
        *[
            F.struct(
                F.lit(number).alias("number"),
                F.lit(start).cast("timestamp").alias("start"),
                F.lit(end).cast("timestamp").alias("end"),
            )
            for number, start, end in origins
        ]
    )
    at, known_at = F.col(time), F.col(label_time)

    def split_of(fold: Column) -> Column:
        before = at < fold["start"]
        return (
            F.when(before & (known_at < fold["start"]), "TRAIN")
            .when(before, "EMBARGO")
            .when((at >= fold["start"]) & (at < fold["end"]), "VALIDATION")
        )

    placed = F.filter(
        F.transform(
            folds,
            lambda fold: F.struct(
                fold["number"].alias("number"),
                fold["start"].alias("start"),
                fold["end"].alias("end"),
                split_of(fold).alias("split"),
            ),
        ),
        lambda p: p["split"].isNotNull(),
    )
    assigned = (
        development.where(F.col(label).isNotNull())
        .select(key, entity, time, label_time, F.explode(placed).alias("f"))
        .select(key, entity, time, label_time, "f.*")
    )
    train = F.col("split") == "TRAIN"
    candidates = assigned.groupBy("number", "start", "end").agg(
        F.countDistinct(F.when(train, quarter_position(time))).alias("training_quarters"),
        F.min(F.when(train, F.to_date(time))).alias("training_start"),
        F.max(F.when(train, F.to_date(time))).alias("training_end"),
        F.sum(train.cast("long")).alias("training_rows"),
        F.sum((F.col("split") == "VALIDATION").cast("long")).alias("validation_rows"),
        F.sum((F.col("split") == "EMBARGO").cast("long")).alias("embargoed_rows"),
    )
    accepted = candidates.where(
        (F.col("training_quarters") >= minimum_training_quarters)
        & (F.col("validation_rows") > 0)
    )
    # One row per fold origin: this window holds a few dozen rows at most.
    renumbered = accepted.withColumn(
        "fold_id",
        F.format_string("fold_%02d", F.row_number().over(Window.orderBy("number"))),
    )
    summary = renumbered.select(
        "fold_id",
        "training_start",
        "training_end",
        F.to_date("start").alias("validation_start"),
        F.date_sub(F.to_date("end"), 1).alias("validation_end"),
        "training_rows",
        "validation_rows",
        "embargoed_rows",
    )
    assignments = assigned.join(
        F.broadcast(renumbered.select("number", "fold_id")), "number"  # one row per fold
    ).select(key, entity, time, "fold_id", "split")
    locked = df.where(F.col(time) >= edge).withColumn("split", F.lit("FINAL_HOLDOUT_LOCKED"))
    return assignments, locked, summary


def assert_no_label_leakage(assignments: DataFrame, df: DataFrame, summary: DataFrame, *,
                            key: str = "decision_key",
                            label_time: str = "label_available_at") -> None:
    """Training labels must have been known before the fold's validation starts."""
    rows = (
        assignments.where("split = 'TRAIN'")
        .join(df.select(key, label_time), key)
        .join(F.broadcast(summary.select("fold_id", "validation_start")), "fold_id")
    )
    fail_if_any(
        rows, F.col(label_time) >= F.col("validation_start").cast("timestamp"),
        "label leakage: a training label was unknown at the fold origin",
    )


def anchored_quarter_begin(origin: str | date, quarters: int) -> date:
    """``quarters`` steps back over quarter beginnings anchored on Mar, Jun, Sep and Dec."""
    day = _as_date(origin)
    year, month = day.year, day.month
    # step back to the latest anchor strictly before, or on, the day
    anchors_back = month % 3
    first = (year * 12 + month - 1) - anchors_back
    on_anchor = anchors_back == 0 and day.day == 1
    steps = quarters if on_anchor else quarters - 1
    target = first - 3 * steps
    return date(target // 12, target % 12 + 1, 1)


def rolling_training_rows(
    df: DataFrame,
    origin: str | date,
    *,
    embargo_quarters: int,
    time: str = "decision_at",
    label: str = LABEL,
    label_time: str = "label_available_at",
) -> DataFrame:
    """Rows decided before the embargo cut whose labels were known before the origin."""
    cut = anchored_quarter_begin(origin, embargo_quarters)
    return df.where(
        F.col(label).isNotNull()
        & (F.col(time) < F.lit(cut).cast("timestamp"))
        & (F.col(label_time) < F.lit(_as_date(origin)).cast("timestamp"))
    )


def rolling_folds(
    df: DataFrame,
    *,
    first_origin: str,
    development_end: str,
    validation_quarters: int = 1,
    step_quarters: int = 1,
    minimum_folds: int = 4,
    prefix: str = "phase3_fold",
    time: str = "decision_at",
    label: str = LABEL,
) -> DataFrame:
    """Origins every ``step_quarters`` whose validation window holds both classes.

    A fold keeps the number of its origin, so rejected origins leave gaps in the numbering.
    """
    last = _as_date(development_end)
    position, origins, number = _position(_as_date(first_origin)), [], 0
    while _start(position) <= last:
        number += 1
        stop = _start(position + validation_quarters)
        if (stop - last).days <= 1:
            origins.append((number, _start(position), stop))
        position += step_quarters
    if not origins:
        raise ValueError("no rolling origin fits the development period")
    folds = F.array(
        *[
            F.struct(
                F.lit(n).alias("number"),
                F.lit(start).cast("timestamp").alias("origin"),
                F.lit(stop).cast("timestamp").alias("stop"),
            )
            for n, start, stop in origins
        ]
    )
    at, y = F.col(time), F.col(label)
    mine = F.filter(folds, lambda f: (at >= f["origin"]) & (at < f["stop"]))
    rows = df.where(y.isNotNull()).select(y, F.explode(mine).alias("f"))
    table = rows.groupBy("f.number", "f.origin", "f.stop").agg(
        F.count(F.lit(1)).alias("validation_rows"),
        F.sum((y == 1).cast("long")).alias("validation_events"),
    )
    kept = table.where(
        (F.col("validation_events") > 0)
        & (F.col("validation_events") < F.col("validation_rows"))
    ).select(
        F.format_string(f"{prefix}_%02d", "number").alias("fold_id"),
        F.to_date("origin").alias("origin"),
        F.date_sub(F.to_date("stop"), 1).alias("validation_end"),
        "validation_rows",
        "validation_events",
    )
    if kept.limit(minimum_folds).count() < minimum_folds:
        raise ValueError(f"at least {minimum_folds} rolling development folds are needed")
    return kept


def _known_before(df: DataFrame, origin: date, time: str, label_time: str) -> DataFrame:
    edge = F.lit(origin).cast("timestamp")
    return df.where((F.col(time) < edge) & (F.col(label_time) < edge))


def _both_classes(df: DataFrame, label: str) -> bool:
    low, high = df.agg(F.min(label), F.max(label)).first()
    return low is not None and low != high


def _observed_quarters(df: DataFrame, time: str) -> list[int]:
    """Sorted distinct quarters of the rows: as long as the calendar, whatever the table size."""
    return sorted(r[0] for r in df.select(quarter_position(time)).distinct().collect())


def inner_windows(
    training: DataFrame,
    *,
    minimum_training_quarters: int,
    validation_quarters: int,
    maximum_windows: int,
    time: str = "decision_at",
    label: str = LABEL,
    label_time: str = "label_available_at",
) -> list[tuple[DataFrame, DataFrame]]:
    """The last few (fit, validation) windows of observed quarters with two classes each."""
    quarters = _observed_quarters(training, time)
    latest = max(len(quarters) - validation_quarters + 1, minimum_training_quarters)
    starts = list(range(minimum_training_quarters, latest, validation_quarters))
    windows = []
    for start in starts[-maximum_windows:]:
        span = quarters[start : start + validation_quarters]
        if len(span) < validation_quarters:
            continue
        fit = _known_before(training, _start(span[0]), time, label_time)
        held = training.where(quarter_position(time).isin(*span))
        if _both_classes(fit, label) and _both_classes(held, label):
            windows.append((fit, held))
    return windows


def inner_split(
    training: DataFrame,
    *,
    time: str = "decision_at",
    label: str = LABEL,
    label_time: str = "label_available_at",
    minimum_quarters: int = 12,
    validation_quarters: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Last observed year for validation, labels known before it for fitting."""
    quarters = _observed_quarters(training, time)
    if len(quarters) < minimum_quarters:
        raise ValueError("insufficient history for inner validation")
    span = quarters[-validation_quarters:]
    fit = _known_before(training, _start(span[0]), time, label_time)
    held = training.where(quarter_position(time).isin(*span))
    if not (_both_classes(fit, label) and _both_classes(held, label)):
        raise ValueError("inner validation split does not contain both classes")
    return fit, held


def calibration_split(
    training: DataFrame,
    calibration_quarters: int,
    *,
    time: str = "decision_at",
    label: str = LABEL,
) -> tuple[DataFrame, DataFrame]:
    """Last quarters held back for calibration, else the last fifth of observed quarters."""
    q = quarter_position(time)
    counts = (
        training.groupBy(q.alias("q"))
        .agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
        .orderBy("q")
        .collect()
    )
    quarters = [r["q"] for r in counts]

    def both(test) -> bool:
        chosen = [r for r in counts if test(r["q"])]
        n, pos = sum(r["n"] for r in chosen), sum(r["pos"] or 0 for r in chosen)
        return 0 < pos < n

    cut = quarters[-1] - calibration_quarters + 1
    if not (both(lambda p: p < cut) and both(lambda p: p >= cut)):
        split = max(int(len(quarters) * 0.8), 1)
        cut = quarters[min(split, len(quarters) - 1)]
    if not both(lambda p: p < cut):
        raise ValueError("training history cannot support an internal calibration split")
    return training.where(q < cut), training.where(q >= cut)
