"""Groups cut into blocks give what whole groups give, with a hot group and ties."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import catalog
from knownat import scale
from knownat.operators import scoring
from knownat.operators.asof import asof_join


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = None if i % 17 == 0 else rng.choice([1.0, 2.0, 2.0, rng.random()])
        rows.append((i, key, value, rng.randrange(2)))
    return rows  # "hot" holds two thirds of the rows


SCHEMA = "id long, k string, v double, y int"


def test_row_rank_and_running_sums(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    split = scale.running_sums(
        df, ["k"], order, {"s": F.col("y")}, totals={"t": "s"}
    ).collect()
    upto = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    direct = df.select(
        "*", F.sum("y").over(upto).alias("s"), F.sum("y").over(Window.partitionBy("k")).alias("t")
    ).collect()
    assert len({r["id"] for r in split}) == len(data)
    assert sorted(map(tuple, split), key=repr) == sorted(map(tuple, direct), key=repr)
    ranks = scale.row_rank(df, ["k"], order, "r").groupBy("k").agg(
        F.max("r").alias("m"), F.count("r").alias("n"), F.countDistinct("r").alias("d")
    )
    assert all(r["m"] == r["n"] == r["d"] for r in ranks.collect())


def test_quantiles_match_numpy(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    levels = [0.0, 0.1, 0.5, 0.77, 1.0]
    found = {r["k"]: r["quantiles"] for r in scale.exact_quantiles(df, ["k"], "v", levels).collect()}
    frame = pd.DataFrame(data, columns=["id", "k", "v", "y"])
    for key, group in frame.groupby("k"):
        assert found[key] == pytest.approx(np.quantile(group["v"].dropna(), levels))
    whole = scale.exact_quantiles(df, [], "v", levels).first()["quantiles"]
    assert whole == pytest.approx(np.quantile(frame["v"].dropna(), levels))


def test_percent_rank_and_median_match_pandas(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    made = scale.with_group_median(
        scale.percent_rank_average(df, ["k"], "v", "p"), ["k"], "v", "m"
    ).toPandas().set_index("id").sort_index()
    frame = pd.DataFrame(data, columns=["id", "k", "v", "y"]).set_index("id")
    grouped = frame.groupby("k")["v"]
    expected = pd.DataFrame({"p": grouped.rank(pct=True), "m": grouped.transform("median")})
    pd.testing.assert_series_equal(made["p"], expected["p"], check_names=False)
    pd.testing.assert_series_equal(made["m"], expected["m"], check_names=False)


def test_asof_split_equals_merge_asof(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    left = [(i, rng.choice([1, 1, 2]), start + timedelta(minutes=rng.randrange(500)))
            for i in range(200)]
    right = [(rng.choice([1, 1, 3]), start + timedelta(minutes=rng.randrange(500)), i)
             for i in range(200)]
    decisions = spark.createDataFrame(left, "d long, k long, decision_at timestamp")
    observations = spark.createDataFrame(right, "k long, available_at timestamp, obs long")
    made = asof_join(
        decisions, observations, by=["k"], decision_id=["d"], tie_break=["obs"]
    ).toPandas().sort_values("d")
    a = pd.DataFrame(left, columns=["d", "k", "decision_at"]).sort_values("decision_at")
    b = pd.DataFrame(right, columns=["k", "available_at", "obs"]).sort_values(
        ["available_at", "obs"]
    )
    expected = pd.merge_asof(
        a, b, left_on="decision_at", right_on="available_at", by="k"
    ).sort_values("d")
    assert len(made) == len(left)
    assert made["obs"].fillna(-1).tolist() == expected["obs"].fillna(-1).tolist()


def test_ranking_metrics_split(spark, data):
    rows = [(k or "none", round(v or 0.0, 2), y) for _, k, v, y in data]
    df = spark.createDataFrame(rows, "s string, probability double, deterioration_label int")
    split = scoring.ranking_metrics(df, ["s"]).toPandas().set_index("s").sort_index()
    for name, group in pd.DataFrame(rows, columns=["s", "p", "y"]).groupby("s"):
        y, p = group["y"].to_numpy(), group["p"].to_numpy()
        steps = [((y[p >= t]).mean(), (y * (p == t)).sum()) for t in sorted(set(p))]
        ap = sum(precision * hits for precision, hits in steps) / y.sum()
        ranks = pd.Series(p).rank().to_numpy()
        pos, neg = y.sum(), len(y) - y.sum()
        auc = (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
        assert split.loc[name, "PR_AUC"] == pytest.approx(ap)
        assert split.loc[name, "ROC_AUC"] == pytest.approx(auc)
        assert split.loc[name, "Brier_score"] == pytest.approx(((p - y) ** 2).mean())


def test_partitions_follow_from_the_rows(spark, make, monkeypatch):
    monkeypatch.setattr(scale, "BLOCK_ROWS", 100)
    frame = make([(i,) for i in range(1000)], "k long").coalesce(1)
    sizes = scale.dealt(frame, ["k"], 1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 200
    made = catalog.queries()["grain_and_chronology_check"](spark, "/root/testdata/sf0.001")
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # and nothing else deals the lines out again
    assert "hashpartitioning(l_orderkey#" in plan and "l_linenumber#" not in "".join(
        line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line)
