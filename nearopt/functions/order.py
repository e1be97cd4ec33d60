"""Ranks and order statistics without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that a group's rows are dealt into by an even number; at 10 billion rows a cell holds some 2.4 million.
CELLS = 4096
#: Bins of a narrowing step, for one position and for each of several.
BINS, FEW_BINS = 4096, 512


def ranked(df: DataFrame, by: Sequence[str], even: Column, ties: Sequence[Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with the rank, from 1, of each row within `by` in the order of (even, *ties), and optionally the group's size.

    even is spread over [0, 1), so its CELLS parts split a group, however large, into cells of a bounded share.  Cells
    are counted, counts are summed up in that small table, and only a cell's own rows are sorted together.
    """
    dealt = df.withColumn("_even", even).withColumn("_cell", F.least(F.floor(F.col("_even") * CELLS), F.lit(CELLS - 1)).cast("int"))
    cells = dealt.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_all", F.sum("_n").over(group)).drop("_n")
    own = Window.partitionBy(*by, "_cell").orderBy("_even", *ties)
    # Null-safe, as groups of null are groups; the renamed side keeps the names of df.
    right = cells.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_cell").alias("_own_cell"), "_before", "_all")
    same = F.col("_cell") == F.col("_own_cell")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = dealt.withColumn("_place", F.row_number().over(own)).join(right, same)
    out = out.withColumn(rank, F.col("_before") + F.col("_place"))
    return (out.withColumn(size, F.col("_all")) if size else out).drop("_even", "_cell", "_own_cell", "_place", "_before", "_all", *[f"_by{i}" for i in range(len(by))])


def order_statistics(rows: DataFrame, column: str, positions: Sequence[int]) -> list[float]:
    """The values at positions, from 0, of the ascending order of a column without nulls; None for no rows.

    Histograms are narrowed around the positions until a bin has one value, so a pass sends a bounded number of counts
    and no task holds the values.  Equal values, however many, end in one bin.
    """
    bins = BINS if len(set(positions)) == 1 else FEW_BINS
    x = F.col("_x")
    now = rows.select(F.col(column).cast("double").alias("_x"))
    low, high, n = now.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n:
        return [None for _ in positions]
    now = now.where(x.isNotNull()).withColumns({"_id": F.lit(0), "_low": F.lit(low), "_width": F.lit((high - low) / bins)})
    # For each position: its interval, the rows below it, and the interval's ends.
    at = {p: (0, 0, low, high) for p in {min(max(p, 0), n - 1) for p in positions}}
    while any(a < b for _, _, a, b in at.values()):
        # Where a step is lost to rounding, few values are left between the ends: they are bins themselves.
        bin_ = F.when((F.col("_width") > 0) & (F.col("_low") + F.col("_width") > F.col("_low")), F.least(F.floor((x - F.col("_low")) / F.col("_width")), F.lit(bins - 1)).cast("double")).otherwise(x)
        binned = now.withColumn("_bin", bin_)
        counts: dict[int, list] = {}
        for r in binned.groupBy("_id", "_bin").agg(F.count(x).alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).collect():  # bins for each interval
            counts.setdefault(r._id, []).append((r.a, r.b, r.n, r._bin))
        found: dict[tuple, int] = {}
        new, table = {}, []
        for p, (interval, below, _, _) in at.items():
            for a, b, k, which in sorted(counts[interval]):
                if below + k > p:
                    if (interval, which) not in found:
                        found[interval, which] = len(found)
                        table.append((interval, which, len(found) - 1, a, (b - a) / bins))
                    new[p] = (found[interval, which], below, a, b)
                    break
                below += k
        at = new
        narrow = rows.sparkSession.createDataFrame(table, "_id int, _bin double, _next int, _a double, _w double")
        now = binned.join(F.broadcast(narrow), ["_id", "_bin"]).select("_x", F.col("_next").alias("_id"), F.col("_a").alias("_low"), F.col("_w").alias("_width"))  # a row for each position
    return [at[min(max(p, 0), n - 1)][2] for p in positions]


def quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles by linear interpolation between neighbours; None for no rows."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return [None for _ in shares]
    places = [s * (n - 1) for s in shares]
    below = [int(p) for p in places]
    found = order_statistics(rows, column, [*below, *[min(b + 1, n - 1) for b in below]])
    return [a + (b - a) * (p - k) if p > k else a for p, k, a, b in zip(places, below, found, found[len(below) :])]
