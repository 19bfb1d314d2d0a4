"""Primitives for groups that may hold any share of the rows.

A window or an exact quantile over one group normally runs in one task, which is fatal when one
sector, series or key holds a third of a large table.  Each primitive here has one plan, taken
whatever the size: equal rows are first counted into cells where that is possible, rows or cells
are range partitioned by (keys, order) so that a large group spans many contiguous blocks, every
block is scanned on its own, and the totals of earlier blocks are carried forward.  Totals meet
rows on (keys, block), never on the keys of a whole group.

Block numbers come from sampled range bounds, so the input is written once before it is counted
and the blocked rows once before they are read twice; a lost executor can never mix two sets of
bounds.  Both go to the checkpoint folder; with ``spark.cleaner.referenceTracking.cleanCheckpoints``
Spark deletes them when the frames that read them are gone.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat.session import ensure_checkpoint_dir

BLOCK = "__block"
#: Rows of a block, about; the number of blocks follows from the rows alone.
BLOCK_ROWS = 1_000_000
_FEATURE, _VALUE = "__feature", "__value"


def stable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Hash partitions of some ``BLOCK_ROWS`` rows each, so a task's memory stays what it is."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parallel, math.ceil(rows / BLOCK_ROWS)), *keys)


def order_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``__block``: contiguous, similarly sized ranges of (keys, order)."""
    kept = stable(df)
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parallel, math.ceil(kept.count() / BLOCK_ROWS))
    ranged = kept.repartitionByRange(blocks, *[F.col(k) for k in keys], *order)
    return stable(ranged.withColumn(BLOCK, F.spark_partition_id()))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where null equals null, keeping one copy of the keys."""
    renamed = right
    condition = F.lit(True)
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"__r_{key}"])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    *,
    totals: Mapping[str, str] | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sums`` inside each group.

    ``order`` must be total inside a group: aggregate ties first or end it with a unique id.
    ``totals`` names columns that take the group's whole sum of one of the ``sums``.
    """
    keys, totals = list(keys), dict(totals or {})
    addends = {name: f"__add_{name}" for name in sums}
    rows = df.select("*", *[c.alias(addends[n]) for n, c in sums.items()])
    blocked = order_blocks(rows, keys, order)
    of_block = blocked.groupBy(*keys, BLOCK).agg(
        *[F.sum(a).alias(f"__tot_{n}") for n, a in addends.items()]
    )
    along = Window.partitionBy(*keys).orderBy(BLOCK)  # one row per block that a group touches
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = of_block.select(
        *keys,
        BLOCK,
        F.row_number().over(along).alias("__nth"),
        *[F.sum(f"__tot_{n}").over(before).alias(f"__base_{n}") for n in sums],
        *[
            F.sum(f"__tot_{n}").over(Window.partitionBy(*keys)).alias(f"__all_{t}")
            for t, n in totals.items()
        ],
    )
    if not totals:
        carried = carried.where("__nth > 1")
    within = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    scanned = blocked.select(
        "*", *[F.sum(a).over(within).alias(f"__in_{n}") for n, a in addends.items()]
    )
    joined = same_keys(scanned, carried.drop("__nth"), [*keys, BLOCK], "left")
    return joined.select(
        *df.columns,
        *[
            F.when(
                F.col(f"__in_{n}").isNull() & F.col(f"__base_{n}").isNull(), F.lit(None)
            )
            .otherwise(
                F.coalesce(F.col(f"__in_{n}"), F.lit(0))
                + F.coalesce(F.col(f"__base_{n}"), F.lit(0))
            )
            .alias(n)
            for n in sums
        ],
        *[F.col(f"__all_{t}").alias(t) for t in totals],
        *([BLOCK] if keep_block else []),
    )


def row_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` over a total order, for groups of any size."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")})


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of the group."""
    keys = list(keys)
    blocked = order_blocks(df, keys, order)
    within = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    scanned = blocked.withColumn(name, F.last(value, ignorenulls=True).over(within))
    # A block's closing value is the running value on its last row.
    following = F.lead(F.lit(1)).over(Window.partitionBy(*keys, BLOCK).orderBy(*order))
    ends = (
        scanned.withColumn("__next", following)
        .where("__next IS NULL")
        .select(*keys, BLOCK, F.col(name).alias("__end"))
    )
    before = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        *keys, BLOCK, F.last("__end", ignorenulls=True).over(before).alias("__base")
    ).where("__base IS NOT NULL")
    joined = same_keys(scanned, carried, [*keys, BLOCK], "left")
    return joined.select(*df.columns, F.coalesce(F.col(name), F.col("__base")).alias(name))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    name: str = "quantiles",
) -> DataFrame:
    """Linear-interpolation quantiles per group as an array; nulls are ignored."""
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double"))
    cells = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return weighted_quantiles(cells, keys, value, "__n", probabilities, name)


def weighted_quantiles(
    cells: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probabilities: Sequence[float],
    name: str = "quantiles",
) -> DataFrame:
    """Quantiles of the rows counted by ``weight`` in cells of distinct (keys, value)."""
    known = cells.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias(_VALUE), F.col(weight).alias("__n")
    )
    ranked = running_sums(
        known, keys, [F.col(_VALUE)], {"__upto": F.col("__n")}, totals={"__size": "__upto"}
    )
    return _levels(ranked, list(keys), probabilities, name)


def _levels(
    ranked: DataFrame, keys: list[str], probabilities: Sequence[float], name: str
) -> DataFrame:
    """Quantiles of cells that know their running count and their group's size."""
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
            for i, p in enumerate(probabilities)
        ]
    )
    places = F.transform(
        wanted,
        lambda t: F.struct(t["i"].alias("i"), (t["p"] * (F.col("__size") - 1)).alias("at")),
    )
    # A cell answers a level when it holds the row at floor(at) or at ceil(at), counted from 0.
    first, final = F.col("__upto") - F.col("__n"), F.col("__upto") - 1

    def holds(place: Column) -> Column:
        return (first <= place) & (place <= final)

    hits = ranked.where(F.col("__n") > 0).select(
        *keys,
        _VALUE,
        "__upto",
        "__n",
        F.explode(
            F.filter(places, lambda t: holds(F.floor(t["at"])) | holds(F.ceil(t["at"])))
        ).alias("__t"),
    )
    at = F.col("__t.at")
    answers = hits.groupBy(*keys, F.col("__t.i").alias("__i")).agg(
        F.max(F.when(holds(F.floor(at)), F.col(_VALUE))).alias("__low"),
        F.max(F.when(holds(F.ceil(at)), F.col(_VALUE))).alias("__high"),
        F.max(at - F.floor(at)).alias("__w"),
    )
    level = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(
        (1 - F.col("__w")) * F.col("__low") + F.col("__w") * F.col("__high")
    )
    return answers.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("__i"), level.alias("v")))),
            lambda item: item["v"],
        ).alias(name)
    )


def with_standings(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    median: str | None = None,
    rank: str | None = None,
    size: str | None = None,
    share: str | None = None,
) -> DataFrame:
    """Each row's standing among its group's non-null values, for several value columns at once.

    The names are patterns in which ``{}`` is the value column: the group's median, the average
    tie rank, the number of non-null values and rank over number.  Rank and share of a null value
    are null; rows with a null key belong to no group.  All columns are counted into cells of
    (keys, column, value) and ranked in one pass; rows look their cells up by value.
    """
    keys = list(keys)
    pairs = F.array(
        *[
            F.struct(F.lit(v).alias(_FEATURE), F.col(v).cast("double").alias(_VALUE))
            for v in values
        ]
    )
    cells = (
        df.select(*keys, F.explode(pairs).alias("__p"))
        .groupBy(*keys, F.col(f"__p.{_FEATURE}"), F.col(f"__p.{_VALUE}"))
        .agg(F.count_if(F.col(f"__p.{_VALUE}").isNotNull()).alias("__n"))
    )
    groups = [*keys, _FEATURE]
    ranked = running_sums(
        cells,
        groups,
        [F.col(_VALUE).asc_nulls_last()],
        {"__upto": F.col("__n")},
        totals={"__size": "__upto"},
        keep_block=True,
    )
    if median:
        ranked = stable(ranked)
        middles = _levels(ranked, groups, [0.5], "__middle").select(
            *groups, F.col("__middle")[0].alias("__median")
        )
        of_blocks = same_keys(ranked.select(*groups, BLOCK).distinct(), middles, groups, "left")
        ranked = same_keys(ranked, of_blocks, [*groups, BLOCK], "left")
    order = F.when(
        F.col(_VALUE).isNotNull(), F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)
    )
    found = {median: "__median", rank: order, size: "__size", share: order / F.col("__size")}
    grouped = F.lit(True)
    for key in keys:
        grouped = grouped & F.col(key).isNotNull()
    rows = df
    for value in values:
        mine = ranked.where(F.col(_FEATURE) == value).select(
            *keys,
            _VALUE,
            *[
                (F.col(c) if isinstance(c, str) else c).alias(name.format(value))
                for name, c in found.items()
                if name
            ],
        )
        asked = rows.withColumn(_VALUE, F.col(value).cast("double"))
        rows = same_keys(asked, mine, [*keys, _VALUE], "left").drop(_VALUE)
        for name in (median, share):
            if name:
                column = name.format(value)
                rows = rows.withColumn(column, F.when(grouped, F.col(column)))
    return rows


def with_group_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Give each row its group's median (null keys form no group)."""
    return with_standings(df, keys, [value], median=name)


def with_average_rank(
    df: DataFrame, keys: Sequence[str], value: str, *, rank: str, size: str
) -> DataFrame:
    """Average-tie rank and group size over the non-null values; null rows get a null rank."""
    return with_standings(df, keys, [value], rank=rank, size=size)


def percent_rank_average(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Share-of-group rank with average ties, nulls excluded, null groups left null."""
    return with_standings(df, keys, [value], share=name)
