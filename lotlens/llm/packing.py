"""Packing: optimal length buckets by dynamic programming over the global histogram, then token-budget batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, number_rows, unpacked, whole_row

BUCKETS = 16
BUDGET = 16_384
MOST_CELLS = 1 << 20  # different lengths up to which the histogram is exact
EXACT_TO = 4096
STEPS = 512
PACKED = ["doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot", "padding"]


def word_count(text: Column) -> Column:
    """Words between white space; null and empty texts have none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def cell_of(length: Column) -> Column:
    """Coarse histogram cell: each length up to EXACT_TO, then STEPS cells per doubling (a bounded number)."""
    wide = F.lit(EXACT_TO) + F.floor(F.log2(length / EXACT_TO) * STEPS) + 1
    return F.when(length <= EXACT_TO, length).otherwise(wide).cast("long")


def histogram(lengths: DataFrame, most: int = MOST_CELLS) -> list[tuple[int, int, int]]:
    """(longest, count, sum) of each used cell, by length; at most about ``most`` cells reach the driver.

    Up to ``most`` different lengths a cell is one length, and boundaries made from the cells are
    optimal.  Beyond it lengths over EXACT_TO share cells whose ends are a factor of 2 ** (1 / STEPS) apart:
    the nearest boundaries at cell ends lie above the optimal ones by no more than that, so the
    padded corpus is at most 2 ** (1 / STEPS) - 1 (0.14 %) larger than with optimal boundaries.
    """
    exact = lengths.groupBy("_n").agg(F.count("*").alias("n"))
    cell = F.col("_n") if exact.count() <= most else cell_of(F.col("_n"))
    cells = exact.groupBy(cell.alias("_cell")).agg(
        F.max("_n").alias("top"), F.sum("n").alias("n"), F.sum(F.col("_n") * F.col("n")).alias("sum")
    )
    return sorted((r["top"], r["n"], r["sum"]) for r in cells.collect())


def best_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    best[j] over the first j cells is top_j * C_j - S_j plus the least of best_before[i] + S_i -
    top_j * C_i, for running counts C and sums S: lines in top_j, of which a convex hull keeps the
    useful ones, so a bucket more costs one pass.
    """
    n = len(cells)
    counts, sums = [0], [0]
    for _, count, total in cells:
        counts.append(counts[-1] + count)
        sums.append(sums[-1] + total)
    best = [0] + [None] * n
    choices: list[list[int]] = []
    for _ in range(min(buckets, n)):
        after, chosen = [0] + [None] * n, [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, offset, i), slopes falling
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, offset = -counts[j - 1], best[j - 1] + sums[j - 1]
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (offset - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, offset, j - 1))
            if not hull:
                continue
            top = cells[j - 1][0]
            while head + 1 < len(hull) and hull[head + 1][0] * top + hull[head + 1][1] <= hull[head][0] * top + hull[head][1]:
                head += 1
            slope, offset, i = hull[head]
            after[j] = top * counts[j] - sums[j] + slope * top + offset
            chosen[j] = i
        choices.append(chosen)
        best = after
    bounds, j = [], n
    for chosen in reversed(choices):
        if j == 0:
            break
        bounds.append(cells[j - 1][0])
        j = chosen[j]
    return bounds[::-1]


def pack(
    docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, carry: bool = False
) -> DataFrame:
    """Put each document into a length bucket and a batch of at most ``budget`` padded tokens.

    ``length`` (default: words of ``text``) is a document's tokens; null counts as 0.  A batch holds
    budget // bucket length documents, one at least: a document longer than the budget is a batch
    of its own.  Batches fill in order of doc_id (nulls first) inside each bucket; repeated rows get
    slots of their own; documents without tokens share the shortest bucket; an empty table gives no
    rows.  For how near to optimal the boundaries are see ``histogram``.
    Returns doc_id, n_tokens, bucket, bucket_tokens, batch (number within the bucket), slot, padding;
    with ``carry`` all other columns of ``docs`` too, those of the same names with ``_in`` appended.
    """
    tokens = F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(0)).cast("long").alias("_n")
    rows = docs.select("doc_id", tokens, *([whole_row(docs)] if carry else []))
    if not carry:
        rows = materialise(rows, "lengths")
    bounds = best_boundaries(histogram(rows.select("_n")), buckets) or [0]
    bounds_sql = F.array(*(F.lit(b).cast("long") for b in bounds))
    rows = rows.withColumn("bucket", F.size(F.filter(bounds_sql, lambda b: b < F.col("_n"))))
    placed = number_rows(rows, [F.col("doc_id"), F.col("_n")], {"_at": F.lit(1)}, ["bucket"], "packed")
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L div bucket_tokens"))
    width = F.greatest(F.element_at(bounds_sql, F.col("bucket") + 1), F.lit(1).cast("long"))
    found = placed.withColumn("bucket_tokens", width).withColumn("_room", room)
    rest = [c for c, name in zip(unpacked(docs, PACKED[1:]), docs.columns) if name != "doc_id"] if carry else []
    return found.select(
        "doc_id",
        F.col("_n").alias("n_tokens"),
        "bucket",
        "bucket_tokens",
        F.expr("_at div _room").alias("batch"),
        (F.col("_at") % F.col("_room")).alias("slot"),
        (F.col("bucket_tokens") - F.col("_n")).alias("padding"),
        *rest,
    )


def padded_batches(
    docs: DataFrame, ids: str = "ids", pad: int = 0, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """Batches ready for training from token arrays (column ``ids`` of ``docs``, null: none).

    One row per batch: bucket, batch, bucket_tokens, doc_ids and ``tokens``, an array per document in order of
    its slot, filled up with ``pad`` to bucket_tokens.  A row holds at most ``budget`` tokens, or one document.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(ids), F.array().cast(docs.schema[ids].dataType)).alias("_ids"))
    placed = pack(rows, buckets, budget, F.size("_ids"), carry=True)
    filled = F.concat("_ids", F.array_repeat(F.lit(pad).cast(docs.schema[ids].dataType.elementType), F.col("padding").cast("int")))
    held = placed.groupBy("bucket", "batch", "bucket_tokens").agg(
        F.sort_array(F.collect_list(F.struct("slot", "doc_id", filled.alias("tokens")))).alias("rows")
    )
    return held.select(
        "bucket", "batch", "bucket_tokens",
        F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"), F.transform("rows", lambda r: r["tokens"]).alias("tokens"),
    )
