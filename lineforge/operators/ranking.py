"""Exact positions in a total order without sorting a whole group in one task.

A plain ``row_number`` puts every row of a group into one task. Here the order is cut at quantiles, which a mergeable
sketch gives in one pass with map-side combine, and each range once more at its own quantiles. A range holds a
65,536th of all rows or so however the order values cluster, whatever the groups. The rows of a group in a range are counted,
a running sum over these (at most 65,536 a group) counts gives the offset of each range, and rows are numbered inside their
range only. Equal order values stay in one range.

Ranking works on the columns of the order alone; ``evenly_spaced`` fetches the few rows that it wants afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineforge.session import materialize

BITS = 8  # 256 ranges per level
SKETCH = 20  # accuracy of the sketch, in errors of one part of this many of a range


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches null keys too and keeps the left copy of each."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for key in keys:
        part = left[key].eqNullSafe(renamed[f"__{key}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def quantiles(order: str, bits: int) -> Column:
    """The cuts of ``2 ** bits`` ranges of about equal numbers of rows, by a mergeable sketch."""
    parts = 1 << bits
    return F.percentile_approx(order, [i / parts for i in range(1, parts)], SKETCH * parts)


def range_of(order: str, cuts: Column, bits: int) -> Column:
    """How many of the sorted cuts are below the value, by halving; null values come first."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    return F.aggregate(halves, F.lit(0), lambda low, half: low + F.when(
        F.get(cuts, low + half - 1) < F.col(order), half).otherwise(0))


def _ranged(df: DataFrame, group: list[str], order: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``__range``, and per (group, range) the offset, size and group total."""
    cuts = df.agg(quantiles(order, bits).alias("c")).scalar()
    coarse = df.withColumn("__cuts", cuts).withColumn("__coarse", range_of(order, F.col("__cuts"), bits)).drop("__cuts")
    inner = coarse.groupBy("__coarse").agg(quantiles(order, bits).alias("__cuts"))
    fine = join_on(coarse, inner, ["__coarse"])
    number = F.shiftleft("__coarse", bits) + range_of(order, F.col("__cuts"), bits)
    rows = fine.withColumn("__range", number).drop("__coarse", "__cuts")
    sizes = rows.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    running = Window.partitionBy(*group).orderBy("__range")
    sizes = sizes.withColumn("__before", F.sum("__n").over(running) - F.col("__n"))
    return rows, sizes.withColumn("total", F.sum("__n").over(Window.partitionBy(*group)))


def _number(rows: DataFrame, kept: DataFrame, group: list[str], order: str, ties: Sequence[str]) -> DataFrame:
    keys = [*group, "__range"]
    inside = Window.partitionBy(*keys).orderBy(order, *ties)
    return join_on(rows, kept, keys).withColumn("position", F.col("__before") + F.row_number().over(inside))


def positions(
    df: DataFrame, order: str, group: Sequence[str] = (), ties: Sequence[str] = (), bits: int = BITS,
) -> DataFrame:
    """Adds ``position`` (from 1, per group by a numeric ``order``) and the group's ``total``.

    All columns travel with the rows: hand over the narrow ones and join the others back.
    """
    group = list(group)
    rows, sizes = _ranged(df, group, order, bits)
    return _number(rows, sizes, group, order, ties).drop("__range", "__before", "__n")


def evenly_spaced(
    df: DataFrame, order: str, group: Sequence[str] = (), size: int = 15, ties: Sequence[str] = (), bits: int = BITS,
) -> DataFrame:
    """The rows at positions 1, 1 + step, 1 + 2*step, ... (at most ``size``) of each group.

    ``step`` is ``max(1, total // size)``. Ranges that hold no wanted position are dropped before any row is
    sorted: of a group at most ``size`` are left. The rows are then fetched by group, order and ties; of rows
    equal in these, as many as are wanted. The places are written first, so that their size is known when Spark
    picks the join: as few as they mostly are, they are broadcast and the rows stay where they are.
    """
    group, ties = list(group), list(ties)
    keys = list(dict.fromkeys([*group, order, *ties]))
    rows, sizes = _ranged(df.select(*keys), group, order, bits)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / size)).cast("long")
    first_index = F.ceil(F.col("__before") / F.col("step"))
    holds_one = (first_index < size) & (first_index * F.col("step") < F.col("__before") + F.col("__n"))
    kept = sizes.withColumn("step", step).filter(holds_one)
    offset = F.col("position") - 1
    wanted = _number(rows, kept, group, order, ties).filter(
        (offset % F.col("step") == 0) & (offset / F.col("step") < size))
    # at most ``size`` places for rows of equal keys
    places = materialize(wanted.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("position", "total"))).alias("__places")), "places").filter("size(__places) > 0")
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    fetched = join_on(df, places, keys).withColumn("__place", F.get("__places", copy - 1))
    return fetched.filter("__place IS NOT NULL").select(*df.columns, "__place.position", "__place.total")
