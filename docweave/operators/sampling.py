"""Rankings, samples and limits that keep a total order, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group. Spark prunes each partition to k rows before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of least md5 of key and seed: a sample that any engine can repeat."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key).limit(n)


def diversified(df: DataFrame, key: str, group: str, order: list[Column], n: int, each: int = 2) -> DataFrame:
    """Up to n rows in order, at most ``each`` a group, then others in order of key up to n. Adds pick, 1 to n."""
    of_group = Window.partitionBy(group).orderBy(*order, F.col(key))
    first = df.withColumn("__rank", F.row_number().over(of_group)).filter(F.col("__rank") <= each).drop("__rank").orderBy(*order, key).limit(n)
    # At most n rows meet in either window below.
    first = first.withColumn("__at", F.row_number().over(Window.orderBy(*order, F.col(key))))
    rest = df.join(first.select(key), key, "left_anti").orderBy(key).limit(n).withColumn("__at", n + F.row_number().over(Window.orderBy(key)))
    both = first.unionByName(rest).withColumn("pick", F.row_number().over(Window.orderBy("__at")))
    return both.filter(F.col("pick") <= n).drop("__at")


def prefer_having(df: DataFrame, key: str, having: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order of those whose key ``having`` holds, of all rows where it holds none of them."""
    held = df.join(having.select(F.col(key).alias("__k")).distinct().withColumn("__has", F.lit(True)), F.col(key) == F.col("__k"), "left").drop("__k")
    some = held.agg(F.coalesce(F.bool_or(F.col("__has").isNotNull()), F.lit(False)).alias("__some"))
    # One row, joined to all.
    return held.join(F.broadcast(some), how="cross").filter(F.col("__has").isNotNull() | ~F.col("__some")).drop("__has", "__some").orderBy(*order).limit(n)


def history_summary(turns: DataFrame, keep: int, clip: int) -> DataFrame:
    """Per conversation: how many turns are earlier than the last ``keep``, and those as one line."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    ranked = turns.withColumn("back", back)
    line = F.struct("turn", F.concat_ws(": ", "role", F.substring("text", 1, clip)).alias("line"))
    latest = F.array_sort(F.collect_list(F.when(F.col("back") <= keep, line)))
    return ranked.groupBy("conv_id").agg(F.count_if(F.col("back") > keep).alias("earlier"), F.array_join(F.transform(latest, lambda x: x["line"]), " | ").alias("latest"))
