"""Robust statistics over groups, as DataFrame transforms.

Every function takes the grouping keys and the value column and returns one row per group.  All of
them are two or three hash aggregations over the same keys, so Spark keeps one partitioning for the
whole chain.  Null values are left out; a group without values gives null statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import selection, slopes

# Scale of the MAD and of the mean deviation, outlier threshold and least sample
MAD_TO_SIGMA = 1.4826
MEAN_DEV_TO_SIGMA = 1.2533
OUTLIER_THRESHOLD = 3.5
OUTLIER_MIN_SAMPLE = 8
MIN_SLOPE_POINTS = 3

QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    """``value`` limited to [low, high]; null stays null."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def saturating(value: Column, half_point: float) -> Column:
    """value / (value + half_point), 0 for values up to 0."""
    return F.when(value <= 0, F.lit(0.0)).otherwise(value / (value + F.lit(half_point)))


def money_mean(value: Column) -> Column:
    """Aggregate: mean of amounts with two decimals, from whole cents: the same however rows are dealt to tasks."""
    return F.sum(F.round(value * 100).cast("long")) / (F.count(value) * 100)


def _medians(df: DataFrame, keys: Sequence[str], value: str, name: str, large: bool) -> DataFrame:
    if large:
        return selection.quantiles(df, keys, value, {name: 0.5}).drop("n")
    return df.groupBy(*keys).agg(F.median(value).alias(name))


def spread(df: DataFrame, keys: Sequence[str], value: str, money: bool = False, large: bool = False) -> DataFrame:
    """n, mean, median, mad, sigma and cv of ``value`` in each group.

    sigma is 1.4826 MAD, or 1.2533 times the mean absolute deviation from the median where the MAD
    is 0, and 0 below two values.  cv is sigma / |median|, 0 below two values or at median 0.
    ``money``: values have two decimals, and their mean is taken of whole cents.  ``large``: groups may have
    more different values than a task can hold; medians are then selected by histograms.
    """
    centred = df.filter(F.col(value).isNotNull())
    if large:
        centred = materialise(centred, "centred")
    middle = _medians(centred, keys, value, "_median", large)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    deviations = (
        centred.alias("l")
        .join(middle.alias("m"), on)
        .select(*(F.col(f"l.{k}") for k in keys), F.col(f"l.{value}").alias("_v"), "_median")
        .withColumn("_dev", F.abs(F.col("_v") - F.col("_median")))
    )
    if large:
        deviations = materialise(deviations, "deviations")
    found = deviations.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (money_mean(F.col("_v")) if money else F.avg("_v")).alias("mean"),
        F.first("_median").alias("median"),
        *(() if large else (F.median("_dev").alias("mad"),)),
        F.avg("_dev").alias("_mean_dev"),
    )
    if large:
        mads = _medians(deviations, keys, "_dev", "mad", large)
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
        found = found.alias("l").join(mads.alias("m"), on).select("l.*", "m.mad")
    sigma = (
        F.when(F.col("n") < 2, 0.0)
        .when(F.col("mad") > 0, F.col("mad") * MAD_TO_SIGMA)
        .otherwise(F.col("_mean_dev") * MEAN_DEV_TO_SIGMA)
    )
    return (
        found.withColumn("sigma", sigma)
        .withColumn("cv", F.when((F.col("n") < 2) | (F.col("median") == 0), 0.0).otherwise(F.col("sigma") / F.abs("median")))
        .drop("_mean_dev")
    )


def flag_outliers(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    threshold: float = OUTLIER_THRESHOLD,
    min_sample: int = OUTLIER_MIN_SAMPLE,
    large: bool = False,
) -> DataFrame:
    """``df`` with boolean ``is_outlier``: outside median +- threshold sigma of its group.

    Groups below ``min_sample`` values or without spread keep everything; a null value is no
    outlier.
    """
    bounds = spread(df, keys, value, large=large).select(
        *(F.col(k).alias(f"_b_{k}") for k in keys),
        F.when((F.col("n") >= min_sample) & (F.col("sigma") > 0), F.col("sigma") * threshold).alias("_reach"),
        F.col("median").alias("_mid"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    outside = (F.col(value) < F.col("_mid") - F.col("_reach")) | (F.col(value) > F.col("_mid") + F.col("_reach"))
    return df.join(bounds, on, "left").select(*df.columns, F.coalesce(outside, F.lit(False)).alias("is_outlier"))


def weighted_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    quantiles: dict[str, float] = QUANTILES,
    tie: Sequence[str] = (),
    combine: bool = True,
    large: bool = False,
) -> DataFrame:
    """Weighted quantiles by the mid-point convention, one column per entry of ``quantiles``, and n.

    The i-th smallest value sits at (weight before it + half its own) / total weight; between two
    positions the quantile is interpolated, beyond the ends it is the end value.  Negative weights
    count as 0; a group whose weights are all 0 gets the plain interpolated quantile.  ``tie``
    orders equal values.  With ``combine`` equal values become one row before the shuffle, so a group
    costs its task as many rows as it has different values, whatever its size; without it rows are
    taken as they are, which is shorter for groups that are small anyway.  ``large``: groups may have more
    different values than a task can hold; weights are then added up over ranges of values.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_w", w.cast("double"))
    if combine:
        # equal values: their weights in order of the tie, of which only the first and the last set a position
        order = F.struct(*(tie or [F.lit(0)]))
        rows = rows.groupBy(*keys, value).agg(
            F.sum("_w").alias("_sum"), F.min_by("_w", order).alias("_head"), F.max_by("_w", order).alias("_tail"), F.count("*").alias("_rows")
        )
    else:
        rows = rows.withColumns({"_sum": F.col("_w"), "_head": F.col("_w"), "_tail": F.col("_w"), "_rows": F.lit(1)})
    if large:
        return _large_quantiles(rows, keys, value, quantiles, [] if combine else tie)
    ordered = Window.partitionBy(*keys).orderBy(F.col(value), *(F.col(t) for t in ([] if combine else tie)))
    whole = Window.partitionBy(*keys)
    total = F.col("_total")
    placed = (
        rows.withColumn("_upto", F.sum("_sum").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_sum").over(whole))
        .withColumn("_from", F.when(total > 0, (F.col("_upto") - F.col("_sum") + F.col("_head") / 2) / total))
        .withColumn("_at", F.when(total > 0, (F.col("_upto") - F.col("_tail") / 2) / total))
        .withColumn("_next_at", F.lead("_from").over(ordered))
        .withColumn("_next", F.lead(value).over(ordered))
        .withColumn("_first", F.row_number().over(ordered) == 1)
    )

    def at(q: float) -> Column:
        start, here, then, a, b = F.col("_from"), F.col("_at"), F.col("_next_at"), F.col(value), F.col("_next")
        inside = F.when(then == here, a).otherwise(a + (b - a) * ((F.lit(q) - here) / (then - here)))
        # the first interval that reaches q: at a shared position both neighbours give the same value
        reached = F.when(F.col("_first") & (start >= q), a).when(then.isNull() & (here <= q), a).when((start <= q) & (here >= q), a)
        between = F.when((here <= q) & (then >= q), inside)
        return F.coalesce(F.min(reached), F.min(between))

    plain = [F.expr(f"percentile({value}, {q}, _rows)") for q in quantiles.values()]
    return placed.groupBy(*keys).agg(
        F.sum("_rows").alias("n"),
        *(
            F.when(F.max("_total") > 0, at(q)).otherwise(p).alias(name)
            for (name, q), p in zip(quantiles.items(), plain, strict=True)
        ),
    )


def _large_quantiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], tie: Sequence[str]) -> DataFrame:
    """``weighted_quantiles`` of combined rows without a window over a group: each quantile lies between the last
    position up to it and the first one from it on, which two aggregates find."""
    written = selection.running_total(rows, keys, [value, *tie], "_sum", "_upto")
    totals = written.groupBy(*keys).agg(F.sum("_sum").alias("_total"), F.sum("_rows").alias("n"), F.min(value).alias("_low"), F.max(value).alias("_top"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = written.alias("l").join(totals.alias("t"), on).select("l.*", "t._total", "t.n", "t._low", "t._top")
    total, v = F.col("_total"), F.col(value).cast("double")
    start = (F.col("_upto") - F.col("_sum") + F.col("_head") / 2) / total
    end = (F.col("_upto") - F.col("_tail") / 2) / total
    placed = joined.filter(total > 0).withColumns({"_from": start, "_at": end})
    ends = []
    for name, q in quantiles.items():
        ends.append(F.max(F.when(F.col("_from") <= q, F.struct(F.least("_at", F.lit(q)).alias("at"), v.alias("v")))).alias(f"_{name}_a"))
        ends.append(F.min(F.when(F.col("_at") >= q, F.struct(F.greatest("_from", F.lit(q)).alias("at"), v.alias("v")))).alias(f"_{name}_b"))
    found = placed.groupBy(*keys, "n", "_low", "_top").agg(*ends)

    def told(name: str, q: float) -> Column:
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        inside = F.when(a["at"] == b["at"], F.least(a["v"], b["v"])).otherwise(a["v"] + (b["v"] - a["v"]) * (q - a["at"]) / (b["at"] - a["at"]))
        return F.when(a.isNull(), F.col("_low").cast("double")).when(b.isNull(), F.col("_top").cast("double")).otherwise(inside)

    weighted = found.select(*keys, "n", *(told(name, q).alias(name) for name, q in quantiles.items()))
    weightless = totals.filter("_total <= 0").select(*keys)
    some = rows.alias("r").join(weightless.alias("w"), [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], "left_semi")
    plain = selection.quantiles(some.withColumn("_one", F.explode(F.expr("sequence(1, int(_rows))"))), keys, value, quantiles)
    return weighted.unionByName(plain)


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: sum of value times weight over the weights, the plain mean where those are all 0."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.avg(value))


def effective_size(weight: str) -> Column:
    """Aggregate: the number of equally weighted rows that the group is worth, (sum w)^2 / sum w^2."""
    w = F.col(weight).cast("double")  # whole weights too: their squares outgrow a long
    squares, total = F.sum(w * w), F.sum(weight).cast("double")
    return F.when(squares > 0, total * total / squares).otherwise(F.lit(0.0))


def percentile_rank(value: Column, target: Column) -> Column:
    """Aggregate: the percentage of values below ``target``, equal ones counting half."""
    score = F.when(value < target, 1.0).when(value == target, 0.5).otherwise(0.0)
    return F.avg(F.when(value.isNotNull(), score)) * 100


def percentile_ranks(rows: DataFrame, keys: Sequence[str], value: str, targets: DataFrame, target: str) -> DataFrame:
    """``targets`` with ``n``, the rows of their group, and ``percentile``, the ``percentile_rank`` of ``target`` in it.

    No target meets the rows of its group: equal values become one row, and a running total of these, which no single task
    has to hold a group for, gives what lies below each target.  Targets whose group has no rows are left out.
    """
    held = materialise(rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "values")
    sizes = held.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_valued"))
    asked = targets.select(*keys, F.col(target).alias("_v"), F.lit(0).cast("long").alias("_n"))
    values = held.unionByName(asked).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    placed = selection.running_total(values, keys, ["_v"], "_n", "_upto").select(*keys, F.col("_v").alias(target), "_n", "_upto")
    below = F.coalesce(F.col("_upto") - F.col("_n") + F.col("_n") * 0.5, F.lit(0.0))
    found = targets.join(sizes, [*keys]).join(placed, [*keys, target], "left")
    return found.withColumn("percentile", F.when(F.col("_valued") > 0, below / F.col("_valued") * 100)).drop("_n", "_upto", "_valued")


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, row_id: str, large: bool = False) -> DataFrame:
    """Robust line through each group: slope, intercept, n_points, x_span.

    The slope is the median over all pairs with different x, the intercept the median of
    y - slope x; groups below three points or with one x give no row.  All pairs of a group are built
    in one array, so this is for groups of bounded size.  With ``large``
    pairs are counted instead, in n log^2 n steps for n points, which alone a task then holds.
    """
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if large:
        return _large_theil_sen(points, keys, x, y)
    packed = points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(row_id).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_p"),
        F.count("*").alias("n_points"),
        (F.max(x) - F.min(x)).cast("double").alias("x_span"),
    )
    pairs = F.expr(
        "flatten(transform(_p, (a, i) -> transform(filter(slice(_p, i + 2, size(_p)), b -> b.x <> a.x),"
        " b -> (b.y - a.y) / (b.x - a.x))))"
    )
    usable = packed.filter((F.col("n_points") >= MIN_SLOPE_POINTS) & (F.col("x_span") > 0)).withColumn(
        "slope", median_of(F.sort_array(pairs))
    )
    rest = F.transform(F.col("_p"), lambda p: p["y"] - F.col("slope") * p["x"])
    return usable.select(*keys, "slope", median_of(F.sort_array(rest)).alias("intercept"), "n_points", "x_span")


def _large_theil_sen(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    def fit(table: pa.Table) -> pa.Table:
        a, b = table["_x"].to_numpy(), table["_y"].to_numpy()
        slope = slopes.median_slope(a, b) if len(a) >= MIN_SLOPE_POINTS else None
        found = [] if slope is None else [(slope, float(np.median(b - slope * a)), len(a), float(a.max() - a.min()))]
        kinds = (("slope", pa.float64()), ("intercept", pa.float64()), ("n_points", pa.int64()), ("x_span", pa.float64()))
        values = {name: pa.array([row[k] for row in found], kind) for k, (name, kind) in enumerate(kinds)}
        return pa.table({k: table[k].slice(0, len(found)) for k in keys} | values)

    rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    schema = [*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "slope double, intercept double, n_points long, x_span double"]
    return rows.groupBy(*keys).applyInArrow(fit, ", ".join(schema))


def median_of(ordered: Column) -> Column:
    """Median of a sorted array without nulls; null for an empty one."""
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def modified_z(value: Column, median: Column, sigma: Column) -> Column:
    """Distance from the median in sigmas, 0 where there is no spread."""
    return F.when(sigma > 0, (value - median) / sigma).otherwise(F.lit(0.0))
