"""Vector search by index against all rows, percentiles of hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import vectors as J
from docweave.operators.percentiles import percentiles


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall(spark, scale):
    v = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    q = v.filter("vec_id % 20 = 0")
    exact = J.exact_search(q, v, 10).cache()
    assert J.recall(J.indexed_search(q, v, 10), exact) >= 0.9
    assert J.recall(J.indexed_search(q, v, 10, probes=1.0), exact) == 1
    assert exact.count() == 10 * q.count()


def test_search_in_blocks(spark):
    """A hot cell of copies, more blocks than one on either side, ties by id, zero and null vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[100]
    x[7] = 0
    rows = [(k, [float(a) for a in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows + [(999, None)], "vec_id long, embedding array<double>").repartition(4)
    q = df.filter("vec_id % 3 = 0 OR vec_id = 7")
    got = {}
    for r in J.exact_search(q, df, 5, block=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.similarity))
    norm = np.sqrt((x * x).sum(1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    want = {}
    for k in range(300):
        if k % 3 == 0 or k == 7:
            s = np.round(unit @ unit[k], 6) + 0.0
            want[k] = [(n + 1, int(i), s[i]) for n, i in enumerate(sorted(range(300), key=lambda i: (-s[i], i))[:5])]
    assert {k: [(n, i) for n, i, _ in sorted(v)] for k, v in got.items()} == {k: [(n, i) for n, i, _ in v] for k, v in want.items()}
    assert J.exact_search(q, df.limit(0), 5).count() == 0
    assert J.indexed_search(q, df.limit(0), 5).count() == 0


def test_percentiles(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.0, 2.5, rng.gauss(0, 1e6), rng.gauss(0, 1e-9)])) for _ in range(5000)]
    rows += [("same", 7.0)] * 300 + [("one", -1.5), (None, 3.0), (None, 4.0), ("none", None), ("nan", float("nan")), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {(r.k, r.share): (r.n, r.value) for r in percentiles(df, ["k"], F.col("v"), shares, cells=8, small=20).collect()}
    by = {}
    for k, v in rows:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    assert got.keys() == {(k, p) for k in by for p in shares}
    for (k, p), (n, v) in got.items():
        assert n == len(by[k])
        assert v == pytest.approx(np.quantile(by[k], p) if k != "wide" else {0.0: -1.7e308, 0.25: -0.85e308, 0.5: 0.0, 0.95: 1.53e308, 1.0: 1.7e308}[p], rel=1e-9)
    assert percentiles(df.limit(0), ["k"], F.col("v"), shares).count() == 0
