import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from knownat.operators import folds, profile
from knownat.plans import development
from knownat.sources import tables


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(1)
    rows = []
    for c in range(4):
        for i, end in enumerate(pd.date_range("2012-03-31", periods=36, freq="QE")):
            y = int((i + c) % 5 == 0 or (i + 2 * c) % 7 == 0)
            rows.append((f"k{c}-{i}", str(c), end.date(), (end + timedelta(days=200)).date(),
                         ["Utilities", "B"][c % 2], y, 1.5 * y + rng.gauss(0, 0.7),
                         rng.gauss(0, 1)))
    return spark.createDataFrame(
        rows, "decision_key string, cik string, decision_at date, label_available_at date, "
              "sector string, deterioration_label int, signal double, noise double").persist()


@pytest.fixture(scope="module")
def split(frame):
    assigned, _, summary = folds.expanding_window_splits(
        frame, holdout_start="2021-01-01", minimum_training_quarters=20, step_quarters=8)
    names = [r[0] for r in summary.select("fold_id").orderBy("fold_id").collect()]
    return assigned.persist(), names[:1]


def test_nested_architectures(frame, split):
    assigned, names = split
    made, chosen = development.nested_architectures(
        frame, assigned, names, ["signal", "noise"], ["sector"],
        logistic_grid=[{"C": 0.1, "positive_weight": 1.0}],
        boosting_grid=[{"n_estimators": 3, "max_depth": 1}],
        interaction_features=["signal"], minimum_training_quarters=12, maximum_windows=1)
    counts = {r["model"]: r["count"] for r in made.groupBy("model").count().collect()}
    assert counts == {m: 16 for m in (
        "pooled_logistic", "partially_pooled_logistic", "pooled_gradient_boosting")}
    assert {c["architecture"] for c in chosen} == set(counts)
    assert made.groupBy("decision_key", "model").count().where("count > 1").isEmpty()


def test_temporal_classification(frame, split):
    assigned, names = split
    made = development.temporal_classification(
        frame, assigned, names, {"base": (["signal"], ["sector"])}, {"logistic": {"C": 1.0}})
    rows = made.collect()
    assert len(rows) == 16 and len({r["threshold"] for r in rows}) == 1
    assert all((r["probability"] >= r["threshold"]) == r["alert"] for r in rows)


def test_rolling_development(frame):
    origins = folds.rolling_folds(
        frame, first_origin="2019-07-01", development_end="2020-06-30", step_quarters=2,
        minimum_folds=1).limit(2).persist()
    made, inner = development.rolling_development(
        frame, origins, ["signal", "noise"], protected=["signal"],
        grids={"logistic": [{"C": 0.5}], "random_forest": [{"n_estimators": 5, "max_depth": 3}]},
        screen={"minimum_features": 2})
    models = {r[0] for r in made.select("model").distinct().collect()}
    assert {"logistic", "random_forest", "ensemble_simple_average", "ensemble_rank_average",
            "ensemble_static_weighted", "ensemble_adaptive_weighted"} <= models
    assert made.groupBy("decision_key", "fold_id", "model").count().where("count > 1").isEmpty()
    assert made.where(F.col("probability").isNull()).isEmpty()
    assert inner.count() == 2 * origins.count()


def test_named_tables(spark):
    tables.create_schemas(spark)
    tables.publish(spark.range(3), "marts.sample_rows")
    assert spark.table("marts.sample_rows").count() == 3
    assert "run_id" in spark.table("metadata.pipeline_runs").columns
    spark.sql("DROP TABLE marts.sample_rows")


def test_metadata_rows_have_filled_columns_and_new_keys(spark, make):
    tables.create_schemas(spark)
    schema = ("run_id string, started_at_utc timestamp, completed_at_utc timestamp, "
              "status string, git_commit string, config_version string")
    begun = datetime(2032, 5, 1, 12)

    def run(name, status="done"):
        return (name, begun, None, status, None, "v1")

    tables.record(make([run("a"), run("b")], schema), "pipeline_runs")
    assert spark.table("metadata.pipeline_runs").where("config_version = 'v1'").count() == 2
    for rows, message in (
        ([run("b")], "present already"),
        ([run("c"), run("c")], "present already"),
        ([run("d", None)], "required column"),
    ):
        with pytest.raises(ValueError, match=message):
            tables.record(make(rows, schema), "pipeline_runs")
    assert spark.table("metadata.pipeline_runs").where("config_version = 'v1'").count() == 2


def test_pairs_share_rankings_where_no_gap_divides_them(make, monkeypatch):
    draw = random.Random(8)
    rows = []
    for _ in range(120):
        a, b = draw.randint(0, 9), draw.random()
        gap, own = draw.random() < 0.3, draw.random() < 0.2
        rows.append((float(a), b, None if gap else a + b, None if gap else -b,
                     None if own else a * b, float("nan") if a == 3 else b))
    names = list("abcdef")
    frame = make(rows, ", ".join(f"{n} double" for n in names))
    asked = []
    real = profile.with_average_rank
    monkeypatch.setattr(
        profile, "with_average_rank",
        lambda df, keys, *args, **kw: asked.append(df.select(*keys).distinct().count())
        or real(df, keys, *args, **kw),
    )
    made = {(r.feature_a, r.feature_b): r for r in profile.spearman_pairs(frame, names).collect()}
    # six alone, four among the rows of c (and d), five among those of e; 30 if made by pair
    assert asked == [15]
    table = pd.DataFrame(rows, columns=names)
    held = {n: [r[i] is not None for r in rows] for i, n in enumerate(names)}
    top = table["f"].max() + 1  # NaN ranks above every number in Spark
    table["f"] = table["f"].fillna(top)
    assert len(made) == 15
    for (x, y), r in made.items():
        both = [p and q for p, q in zip(held[x], held[y], strict=True)]
        part = table[both]
        assert r.complete_rows == len(part)
        assert r.spearman == pytest.approx(part[x].rank().corr(part[y].rank()), abs=1e-9)
