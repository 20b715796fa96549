"""Vector search for many queries: an inverted-file index, probes joined by cell, exact similarities in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.sampling import hash_sample
from docweave.sources.scratch import cut

#: Rows that centroids are fitted on, at most; every row is indexed.
SAMPLE = 20_000
#: A table has the square root of its rows in cells, this many at most.
MOST_CELLS = 4096
#: Rows of one side that meet in a task at a time.
BLOCK = 8192
#: Share of cells that a query reads. Vectors without clusters, as those of the tests, need this much for a recall of 0.9; with clusters far fewer will do.
PROBES = 0.65


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit_cells(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centroids (cells, width) by spherical k-means on the ``sample`` rows of least hash of their id; none without rows.

    ``sample`` bounds what reaches the driver. The start is the first rows of the sample, so reruns agree.
    """
    cells = cells or max(1, min(MOST_CELLS, int(vectors.count() ** 0.5)))
    x = _unit(_matrix(hash_sample(vectors.select(id_col, vector), id_col, sample).toPandas()[vector]))
    c = x[:cells].copy()
    for _ in range(rounds if len(x) else 0):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        used = np.bincount(at, minlength=len(c)) > 0
        c[used] = _unit(total[used])
    return c


def add_cells(vectors: DataFrame, centroids: np.ndarray, probes: int = 1, vector: str = "embedding") -> DataFrame:
    """``vectors`` with cell, a row for each of the ``probes`` cells whose centroids are nearest."""
    probes = min(probes, len(centroids))
    flat = F.pandas_udf(lambda col: pd.Series(list(np.argsort(-(_unit(_matrix(col)) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32))), "array<int>")
    return vectors.withColumn("cell", F.explode(flat(F.col(f"`{vector}`"))))


def search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, the id, similarity (cosine, six places) and rank of the k best rows of ``vectors`` for each of ``queries``.

    Both have id, vector and cell, and meet by cell: exact among the rows of a query's cells. Equal
    similarities go by id. A cell is cut into blocks of about ``block`` rows on either side, so a hot
    cell is as many tasks as it needs; every pair of blocks gives k rows a query at most. Null
    vectors are left out; a zero vector has similarity 0 with all. Ids are unique on either side.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector).alias("q"), "cell")
    v = vectors.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), "cell")
    size = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    blocks = cut(size(q, "nq").join(size(v, "nv"), "cell"))  # a row per cell
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(blocks, "cell").withColumn("bq", own("query_id", "nq")).withColumn("bv", every("nv"))
    v = v.join(blocks, "cell").withColumn("bv", own("id", "nv")).withColumn("bq", every("nq"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        ids, near = b.id.to_numpy(), []
        order = np.argsort(ids, kind="stable")
        unit, ids = _unit(_matrix(b.v))[order], ids[order]
        for lo in range(0, len(a), 512):
            sim = np.round(_unit(_matrix(a.q.iloc[lo : lo + 512])) @ unit.T, 6) + 0.0
            for who, row in zip(a.query_id.iloc[lo : lo + 512], sim, strict=True):
                least = np.partition(row, -k)[-k] if k < len(row) else -np.inf
                some = np.flatnonzero(row >= least)
                some = some[np.argsort(-row[some], kind="stable")][:k]  # ids are in order
                near.append(pd.DataFrame({"query_id": who, "id": ids[some], "similarity": row[some]}))
        return pd.concat(near)

    key = ["cell", "bq", "bv"]
    near = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInPandas(best, f"query_id {kind}, id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("id", id_col)


def exact_search(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """search() over all rows: one cell, in blocks."""
    return search(queries.withColumn("cell", F.lit(0)), vectors.withColumn("cell", F.lit(0)), k, id_col, vector, block)


def indexed_search(queries: DataFrame, vectors: DataFrame, k: int, probes: float = PROBES, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> DataFrame:
    """search() in the ``probes`` (a share) of all cells whose centroids are nearest to a query."""
    centroids = fit_cells(vectors, id_col, vector, cells)
    if not len(centroids):
        return exact_search(queries, vectors, k, id_col, vector)
    many = max(1, round(probes * len(centroids)))
    known = lambda df: df.filter(F.col(vector).isNotNull())
    return search(add_cells(known(queries), centroids, many, vector), add_cells(known(vectors), centroids, 1, vector), k, id_col, vector)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> float:
    """Share of the exact rows that are found."""
    n = exact.count()
    return found.join(exact, ["query_id", id_col], "left_semi").count() / n if n else 1.0
