"""Order statistics of groups of any size: no task holds a group's values.

``order_statistics`` narrows a range around each wanted rank by rounds of histograms, which are combined before the
shuffle; ``running_total`` adds up a group that is dealt over tasks by ranges of its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CELLS = 1024
MOST_ROUNDS = 250  # a range of doubles shrinks to 1/CELLS in each, so this is never reached
FEW = 10_000


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """(keys, rank, value): the value at each 0-based rank among the non-null values of its group, exactly.

    ``ranks``: keys and rank (long); a rank outside the group gives no row.  In each round the values inside a rank's
    range are counted in CELLS cells, and the range becomes the least and the largest value of the cell that holds the
    rank, until it is one value or has at most ``few`` of them, which are then sorted.  Every round reads ``df``
    once, so hand it a written table.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("held"))
    asked = ranks.select(*keys, "rank").distinct()
    targets = asked.alias("t").join(whole.alias("w"), _same(keys, "t", "w")).select("t.*", "w.lo", "w.hi", F.lit(0).cast("long").alias("below"), "w.held")
    open_ = materialise(targets.filter("rank >= 0 and rank < held"), "ranks")
    done: list[DataFrame] = []
    by_cell = Window.partitionBy(*keys, "rank").orderBy("cell")
    for _ in range(MOST_ROUNDS):
        done.append(open_.filter("lo = hi or held <= " + str(few)))
        open_ = open_.filter(f"lo < hi and held > {few}")
        if open_.isEmpty():
            break
        v, lo, hi = F.col("v._v"), F.col("t.lo"), F.col("t.hi")
        wide = (hi - lo) == float("inf")  # then in halves; a narrow range must not be halved to nothing
        share = F.when(wide, (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((v - lo) / (hi - lo))
        cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")
        inside = rows.alias("v").join(open_.alias("t"), _same(keys, "v", "t") & F.col("v._v").between(F.col("t.lo"), F.col("t.hi")))
        cells = inside.select("t.*", "v._v", cell.alias("cell")).groupBy(*keys, "rank", "below", "cell")
        counted = cells.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("held"))
        before = F.coalesce(F.sum("held").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.withColumn("below", F.col("below") + before)
        held = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("held"))
        open_ = materialise(placed.filter(held).drop("cell"), "ranks")
    else:
        raise RuntimeError("ranks did not settle")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    one = found.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
    rest = found.filter("lo < hi")
    last = rows.alias("v").join(rest.alias("t"), _same(keys, "v", "t") & F.col("v._v").between(F.col("t.lo"), F.col("t.hi")))
    sorted_ = last.groupBy(*(F.col(f"t.{k}").alias(k) for k in keys), "t.rank", "t.below").agg(F.array_sort(F.collect_list("v._v")).alias("_all"))
    few_ = sorted_.select(*keys, "rank", F.get("_all", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
    return one.unionByName(few_)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float], few: int = FEW) -> DataFrame:
    """keys, n and interpolated quantiles of ``value``, equal to ``percentile``, for groups of any size."""
    rows = df.filter(F.col(value).isNotNull())
    sizes = materialise(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    place = {name: (F.col("n") - 1) * q for name, q in named.items()}
    ends = F.array(*(f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)))
    found = order_statistics(rows, keys, value, sizes.select(*keys, F.explode(F.array_distinct(ends)).alias("rank")), few)
    held = sizes.alias("s").join(found.alias("f"), _same(keys, "s", "f"), "left").select("s.*", "f.rank", "f.value")
    at = lambda rank: F.max(F.when(F.col("rank") == rank.cast("long"), F.col("value")))
    told = held.groupBy(*keys, "n").agg(*(at(f(p)).alias(f"_{name}_{f.__name__}") for name, p in place.items() for f in (F.floor, F.ceil)))
    between = lambda name, p: F.col(f"_{name}_floor") + (F.col(f"_{name}_ceil") - F.col(f"_{name}_floor")) * (p - F.floor(p))
    return told.select(*keys, "n", *(between(name, p).alias(name) for name, p in place.items()))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the rows of its group up to each one in ``order``.

    Rows are dealt by ranges of (keys, order); a task adds up its own rows, and the sums of the tasks before it, of
    which a group has as many as tasks, are added to them.
    """
    ranges = [*(F.col(k) for k in keys), *(F.col(o) for o in order)]
    placed = materialise(df.repartitionByRange(*ranges).withColumn("_task", F.spark_partition_id()), "placed")
    sums = placed.groupBy(*keys, "_task").agg(F.sum(amount).alias("_sum_of_task"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum_of_task").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum(amount).over(inside))
    joined = local.alias("l").join(offsets.alias("o"), _same([*keys, "_task"], "l", "o"))
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("l._local") + F.col("o._offset")).alias(name))
