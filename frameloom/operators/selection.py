"""Exact order statistics and stratified samples of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.sequences import capped_shares
from frameloom.operators.vectors import _cut

#: Bins of a histogram, and values of a rank that are few enough to be sorted.
BINS, FEW = 64, 10_000


def order_statistics(rows: DataFrame, group: str, value: str, wanted: DataFrame) -> DataFrame:
    """(group, rank, value): the value at each wanted (group, rank), ranks from 1 within the group's values in order.

    Exact for groups of any size: each round counts the values of a rank's range in BINS bins and narrows the range to the bin that
    holds the rank, whose least and largest values are the next range; FEW values that are left are sorted. No
    group's values are held in one task, and a round shuffles counts only. Nulls and NaN are left out; ranks beyond a group have no row.
    """
    clean = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    asked = wanted.select(F.col(group).alias("g"), F.col("rank").cast("long").alias("rank")).distinct()
    same = lambda a, b: a["g"].eqNullSafe(b["g"])
    ends = clean.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    # A rank's range, how many values lie before it, and how many in it.
    state = asked.join(ends, same(asked, ends)).select(asked["g"], "rank", "low", "high", F.lit(0).cast("long").alias("before"), "n").where(F.col("rank").between(1, F.col("n")))
    state, done = _cut(state), []
    while True:
        done.append(state.where("low = high").select("g", "rank", F.col("low").alias("value")))
        left = state.where("low < high")
        few = left.where(F.col("n") <= FEW)
        inside = few.join(clean, same(few, clean)).where(F.col("v").between(F.col("low"), F.col("high"))).select(few["g"], "rank", "before", "v")
        turn = F.row_number().over(Window.partitionBy("g", "rank").orderBy("v"))
        done.append(inside.withColumn("turn", turn).where("before + turn = rank").select("g", "rank", F.col("v").alias("value")))
        todo = left.where(F.col("n") > FEW)
        if todo.isEmpty():
            break
        ranges = todo.select("g", "low", "high").distinct()
        inner = ranges.join(clean, same(ranges, clean)).where(F.col("v").between(F.col("low"), F.col("high"))).select(ranges["g"], "low", "high", "v")
        # Bins of about equal numbers, whatever the values' spread; their ends are a mergeable sketch, their counts exact.
        shares = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
        ends = _cut(inner.groupBy("g", "low", "high").agg(F.percentile_approx("v", shares).alias("ends")))
        ends = ends.select(F.col("g").alias("eg"), F.col("low").alias("elow"), F.col("high").alias("ehigh"), "ends")
        binned = inner.join(ends, inner["g"].eqNullSafe(ends["eg"]) & (inner["low"] == ends["elow"]) & (inner["high"] == ends["ehigh"]))
        binned = binned.withColumn("bin", F.size(F.filter("ends", lambda x: x < F.col("v"))))
        bins = binned.groupBy("g", "low", "high", "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        ahead = F.sum("n").over(Window.partitionBy("g", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("ahead", F.coalesce(ahead, F.lit(0))).select(F.col("g").alias("bg"), F.col("low").alias("blow"), F.col("high").alias("bhigh"), F.col("n").alias("bn"), "least", "most", "ahead")
        narrowed = todo.join(bins, todo["g"].eqNullSafe(bins["bg"]) & (todo["low"] == bins["blow"]) & (todo["high"] == bins["bhigh"]))
        narrowed = narrowed.where((F.col("rank") > F.col("before") + F.col("ahead")) & (F.col("rank") <= F.col("before") + F.col("ahead") + F.col("bn")))
        state = _cut(narrowed.select("g", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("ahead")).alias("before"), F.col("bn").alias("n")))
    return reduce(DataFrame.unionByName, done).select(F.col("g").alias(group), "rank", "value")


def quantiles(rows: DataFrame, group: str, value: str, points: dict[str, tuple[int, int]]) -> DataFrame:
    """(group, n, one column for each point): the i-th of the cut points that part a group into m equal shares, i and m being a point's pair.

    By the exclusive rule: the point lies i (n + 1) / m values in, between two neighbours in proportion, the first or last two at the ends.
    A group of one value has that value for every point.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    sizes = _cut(rows.groupBy(group).agg(F.count(v).alias("n")).where("n > 0"))
    place = {name: (F.lit(i) * (F.col("n") + 1), m) for name, (i, m) in points.items()}
    low = {name: F.greatest(F.lit(1), F.least(F.floor(at / m), F.col("n") - 1)).cast("long") for name, (at, m) in place.items()}
    wanted = [sizes.select(group, c.alias("rank")) for name in points for c in (low[name], F.least(low[name] + 1, F.col("n")))]
    found = order_statistics(rows, group, value, reduce(DataFrame.unionByName, wanted))
    by_rank = found.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two entries a point
    joined = sizes.join(by_rank.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")))
    columns = []
    for name, (at, m) in place.items():
        a, b = F.col("at")[low[name]], F.col("at")[F.least(low[name] + 1, F.col("n"))]
        rest = at - low[name] * m
        columns.append(F.when(F.col("n") == 1, a).otherwise((a * (m - rest) + b * rest) / m).alias(name))
    return joined.select(group, "n", *columns)


def bottom_k(rows: DataFrame, by: list[str], order: list[Column], k: Column, parts: int = 64) -> DataFrame:
    """The first k rows of each group by an order that ends in a unique id; first within parts of a group, so none is sorted as a whole."""
    part = F.pmod(F.xxhash64(*order[-1:]), F.lit(parts))
    first = rows.withColumn("__part", part).withColumn("__turn", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))).where(F.col("__turn") <= k)
    return first.withColumn("__turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__turn") <= k).withColumnRenamed("__turn", "turn").drop("__part")


def drawn(id_: str, *seeds: Column) -> Column:
    """The place of an id in a draw: a hash that any engine can compute."""
    return F.md5(F.concat_ws(":", *seeds, F.col(id_).cast("string")).cast("binary"))


def stratified_sample(rows: DataFrame, stratum: str, id_: str, total: int, whole_up_to: int, seed: int) -> DataFrame:
    """A sample of about total rows: each stratum's share by size, one at least, drawn by hash; pools of whole_up_to rows or fewer are taken whole."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    shares = capped_shares(sizes, "n", total, "all", stratum).withColumn("pool", F.sum("n").over(Window.partitionBy("all")))
    taken = shares.select(stratum, F.when(F.col("pool") <= whole_up_to, F.col("n")).otherwise(F.col("share")).alias("share"))
    marked = rows.join(taken, stratum).withColumn("draw", drawn(id_, F.lit(str(seed)), F.col(stratum)))
    return bottom_k(marked, [stratum], [F.col("draw"), F.col(id_)], F.col("share")).drop("draw", "share")
