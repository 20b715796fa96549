"""Panels and summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issuer_year(rows: DataFrame, keys: list[str], maxima: dict[str, Column], firsts: dict[str, Column], date: Column, flag: Column) -> DataFrame:
    """One row a key: greatest measures, first known attributes, and the first date of flagged rows (empty without one).

    Rows with a null key drop out. One aggregate, combined before the shuffle: no join back for
    the flagged subset. First attributes are the least by the rows' date, so reruns agree.
    """
    known = rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return known.groupBy(*keys).agg(
        *[F.max(c).alias(n) for n, c in maxima.items()],
        *[F.min_by(c, F.when(c.isNotNull(), date)).alias(n) for n, c in firsts.items()],
        F.coalesce(F.min(F.when(flag, date.cast("string"))), F.lit("")).alias("first_flagged"),
    )


def fill_rates(df: DataFrame, key: str, cols: dict[str, Column]) -> DataFrame:
    """Share of filled cells by column: field, n_rows, n_filled, rate (three digits). One pass over the rows."""
    n = F.count("*").alias("n")
    one = df.agg(n, *[F.count_if(c).alias(k) for k, c in cols.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n_filled")) for k in cols]))
    out = one.select("n", cells.alias("c")).select("c.field", F.col("n").alias("n_rows"), "c.n_filled")
    return out.withColumn("rate", F.bround(F.col("n_filled") / F.greatest(F.col("n_rows"), F.lit(1)), 3))


def shares(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their whole per cent of all rows; ties by value."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    top = n.orderBy(F.col("n").desc(), col).limit(k)
    return top.join(F.broadcast(total)).select(col, "n", F.bround(100 * F.col("n") / F.col("total"), 0).cast("long").alias("percent"))


def fingerprint(df: DataFrame, signature: Column) -> DataFrame:
    """SHA-256 over the sorted different signatures, a line each; empty for none.

    Spark sorts the signatures, and one task hashes them as they pass: a digest of one ordered
    list is one pass over it, but no list is ever held.
    """
    one = fingerprints_by(df.select(F.lit("").alias("__all"), signature.alias("__s")), "__all", F.col("__s"))
    return df.sparkSession.range(1).join(one, how="left").select(F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def range_fingerprint(df: DataFrame, signature: Column, digits: int = 2) -> DataFrame:
    """SHA-256 over the digests of ranges of the sorted different signatures (hex digests); empty for none.

    A range holds the signatures of the same first ``digits`` and has a fingerprint of its own, so the
    ranges are hashed by as many tasks, and only their digests meet in one.
    """
    ranges = df.select(F.substring(signature, 1, digits).alias("r"), signature.alias("s"))
    parts = fingerprints_by(ranges, "r", F.col("s")).groupBy().agg(F.array_sort(F.collect_list(F.concat_ws(":", "r", "fingerprint"))).alias("p"))  # 16 ** digits at most
    return parts.select(F.when(F.size("p") > 0, F.sha2(F.concat(F.array_join("p", "\n"), F.lit("\n")), 256)).otherwise("").alias("fingerprint"))


def fingerprints_by(df: DataFrame, key: str, signature: Column) -> DataFrame:
    """fingerprint() of each value of ``key`` (null is one): key, fingerprint.

    Different signatures are sorted by Spark, a key's in one partition, and hashed as they pass,
    so no list of them is ever held.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for b in batches:
            for k, s in zip(b.k.tolist(), b.s.tolist(), strict=True):
                if h is None or k != at:
                    if h is not None:
                        yield pd.DataFrame({key: [at], "fingerprint": [h.hexdigest()]})
                    at, h = k, hashlib.sha256()
                h.update(f"{s}\n".encode())
        if h is not None:
            yield pd.DataFrame({key: [at], "fingerprint": [h.hexdigest()]})

    rows = df.select(F.col(key).cast("string").alias("k"), signature.alias("s")).filter("s IS NOT NULL").distinct()
    return rows.repartition("k").sortWithinPartitions("k", "s").mapInPandas(hashed, f"{key} string, fingerprint string")


def vote_agreement(votes: DataFrame, key: str, label: str, valid: list[str]) -> DataFrame:
    """Share of the most frequent valid label; 0.5 without a valid one."""
    counts = votes.groupBy(key, label).agg(F.count_if(F.col(label).isin(valid)).alias("n"))
    total = F.sum("n")
    return counts.groupBy(key).agg(F.when(total > 0, F.bround(F.max("n") / total, 6)).otherwise(F.lit(0.5)).alias("agreement"))
