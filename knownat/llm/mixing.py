"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target of words, shared by weight and stopped at a multiple of its size.  Its
documents stand in a fixed pseudo-random order, and cumulative sizes place each on the source's
line of words; whole passes over the source repeat it, a remainder ends inside the line.  A
source's weight varies over training time; its integral is the words demanded so far, and the
time at which that demand reaches a document's first word is the document's position.  Sorting
all documents by position interleaves the sources as scheduled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownat import scale
from knownat.llm.common import WORD, prepare, settled

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: For each weight slot, (time, relative weight) knots, linear between them.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """(source, source_size, slot, target) from rows of (source, size).

    Sources take the weights in code-point order, null last.  Targets share all words by weight;
    one that would pass ``most`` times its source's size stops there and the rest is shared by
    weight among the others.  Ordering sources by limit over weight turns that repetition into
    one prefix sum.  The work after the first aggregate is one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn(
        "slot",
        F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) % len(weights),
    ).withColumn("slot", F.pmod(F.col("slot") - 1, F.lit(len(weights))))
    shares = F.array(*[F.lit(float(w)) for w in weights])
    limited = ranked.select(
        "source", "source_size", "slot",
        F.element_at(shares, F.col("slot") + 1).alias("weight"),
        (F.col("source_size") * most).alias("limit"),
    )
    order = Window.orderBy(
        F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = limited.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(upto), F.lit(0)))
        .alias("left"),
        F.sum("weight").over(onward).alias("rest"),
    )
    stopped = level.withColumn(
        "stops", F.col("weight") * F.col("left") / F.col("rest") >= F.col("limit")
    )
    free = stopped.select(
        "*",
        F.first(F.when(~F.col("stops"), F.col("left")), True).over(everything).alias("shared"),
        F.first(F.when(~F.col("stops"), F.col("rest")), True).over(everything).alias("by"),
    )
    return free.select(
        "source", "source_size", "slot",
        F.when(F.col("stops"), F.col("limit").cast("double"))
        .otherwise(F.col("weight") * F.col("shared") / F.col("by"))
        .alias("target"),
    )


def plan_mixture(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: str = "mix",
    row_key: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, size, source, source_size, slot, target,
    before (the source's words ahead of this row in its order) and taken.

    A null or empty text has size 0 and is taken 0 times; a source without words has target 0.
    Repeated rows each hold a place of their own; which of two equal rows comes first does not
    show.  Other columns are not read.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = settled(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            (F.lit(None).cast("long") if row_key is None else row_key).alias("row_key"),
        )
    )
    named = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    ordered = rows.withColumn("draw", F.md5(named.cast("binary")))
    order = [F.col("draw"), F.col("doc_id"), F.col("size"), F.col("row_key")]
    placed = scale.running_sums(ordered, ["source"], order, {"upto": F.col("size")})
    aimed = scale.same_keys(placed, source_targets(rows, weights, most), ["source"], "inner")
    whole = F.floor("target")
    before = F.col("upto") - F.col("size")
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.try_divide(whole, size))).otherwise(F.lit(0))
    rest = whole - passes * size
    inside = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return aimed.select(
        "doc_id", "row_key", "size", "source", "source_size", "slot", "target",
        before.alias("before"),
        (passes * F.col("size") + inside).cast("long").alias("taken"),
    )


def position_of(word: Column, slot: Column, demand: Column, schedules=SCHEDULES) -> Column:
    """Training time in [0, 1] at which a source's cumulative demand reaches ``word``."""
    bends = []
    for knots in schedules:
        area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:], strict=False))
        upto, parts = 0.0, []
        for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
            level, rise = u / area, (v - u) / area / (b - a)
            parts.append((a, upto, level, rise))
            upto += (b - a) * (u + v) / 2 / area
        bends.append(parts)
    share = F.try_divide(word, demand)
    found = None
    for index, parts in enumerate(bends):
        at = None
        for start, upto, level, rise in parts:  # the last part begun by this share holds it
            over = share - F.lit(upto)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(level * level) + F.lit(2 * rise) * over))
            time = F.lit(start) + F.lit(2.0) * over / (F.lit(level) + root)
            at = time if at is None else F.when(share >= upto, time).otherwise(at)
        found = F.when(slot == index, at) if found is None else found.when(slot == index, at)
    return found


def with_positions(plan: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """One row for every time a row is taken, with its ``position``; rows not taken give none."""
    demand = F.floor("target").cast("double")
    copies = F.when(
        F.col("taken") > 0, F.ceil(F.try_divide("taken", "size")).cast("int")
    ).otherwise(0)
    repeated = plan.withColumn(
        "repeat", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)))
    )
    word = (F.col("repeat") * F.col("source_size") + F.col("before")).cast("double")
    return repeated.withColumn("position", position_of(word, F.col("slot"), demand, schedules))


def mix(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", **choices,
) -> DataFrame:
    """The documents in training order, each as often as the mixture takes it, columns as given.

    A document taken in part still comes whole.  Rows equal in every column are one text held
    as many times as the plan takes all of them together.
    """
    row_key = F.xxhash64(*[F.col(c) for c in docs.columns])
    plan = plan_mixture(
        docs, id_column=id_column, text_column=text_column, source_column=source_column,
        row_key=row_key, **choices,
    )
    sequence = settled(
        with_positions(plan).select(
            F.col("row_key").alias("__taken_key"), F.col("position").alias("__position")
        )
    )
    texts = docs.withColumn("__row_key", row_key).dropDuplicates(["__row_key"])
    taken = texts.join(sequence, texts["__row_key"] == sequence["__taken_key"])
    return taken.orderBy("__position", "__taken_key").select(*[texts[c] for c in docs.columns])
