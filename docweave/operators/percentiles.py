"""Exact percentiles of large groups: the cell that holds a rank is refined until it is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.sources.scratch import cut

CELLS = 1024
#: A cell of this many rows is sorted.
SMALL = 10_000


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: tuple[float, ...], cells: int = CELLS, small: int = SMALL) -> DataFrame:
    """``keys``, share, n and value of each percentile, interpolated between the two values that it lies between.

    A group's values never meet: tasks count them by range, a running sum over at most ``cells``
    ranges tells which one holds the rank, and that range (by the least and greatest value in it) is
    cut again, until its values are equal or ``small`` in number. Null and NaN values do
    not count; a group without others has no row. Null keys are a group.
    """
    names = [f"__g{i}" for i in range(len(keys))]
    v = value.cast("double")
    data = rows.select(*[F.col(k).alias(g) for k, g in zip(keys, names, strict=True)], v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    one = data.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.col("share") * (F.col("n") - 1)
    asked = one.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    asked = asked.withColumn("rank", F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at)).cast("long"))
    open_ = cut(asked.select(*names, "share", "side", "n", "rank", "lo", "hi", F.col("n").alias("held")))
    target = [*names, "share", "side"]
    done = None
    while True:
        equal = open_.filter("lo = hi").select(*target, "n", F.col("lo").alias("v"))
        done = equal if done is None else done.unionByName(equal)
        few = open_.filter((F.col("lo") < F.col("hi")) & (F.col("held") <= small))
        place = F.row_number().over(Window.partitionBy(*target).orderBy("v")) - 1
        done = done.unionByName(_within(data, few, names).withColumn("place", place).filter("place = rank").select(*target, "n", "v"))
        open_ = open_.filter((F.col("lo") < F.col("hi")) & (F.col("held") > small))
        if open_.isEmpty():
            break
        # In halves, so that the width of the whole range of doubles is no infinity; a width of 0 has two values.
        width = F.col("hi") / 2 - F.col("lo") / 2
        cell = F.when(width > 0, F.least(F.lit(cells - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * cells))).otherwise((F.col("v") == F.col("hi")).cast("long")).cast("int")
        counts = _within(data, open_, names).groupBy(*target, cell.alias("cell")).agg(F.first("n").alias("n"), F.first("rank").alias("rank"), F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        so_far = F.sum("held").over(Window.partitionBy(*target).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hit = counts.withColumn("before", so_far - F.col("held")).filter("rank >= before AND rank < before + held")
        open_ = cut(hit.select(*target, "n", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi", "held"))
    low, high = F.max(F.when(F.col("side") == 0, F.col("v"))), F.max(F.when(F.col("side") == 1, F.col("v")))
    part = at - F.floor(at)
    out = done.groupBy(*names, "share", "n").agg(low.alias("a"), high.alias("b")).withColumn("value", F.col("a") * (1 - part) + F.col("b") * part)
    return out.select(*[F.col(g).alias(k) for k, g in zip(keys, names, strict=True)], "share", "n", "value")


def _within(data: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """The values in each target's range, with the target."""
    t = targets.select(*[F.col(g).alias(f"{g}t") for g in names], "share", "side", "n", "rank", "lo", "hi")
    on = F.lit(True)
    for g in names:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}t"))
    return data.join(t, on & F.col("v").between(F.col("lo"), F.col("hi"))).drop(*[f"{g}t" for g in names])
