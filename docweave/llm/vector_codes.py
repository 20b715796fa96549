"""Vector code compression: product codes of integer vectors, nearest entries by a screened matrix product."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this become this, so that squared distances and their sums stay exact in 64 bits.
LIMIT = 1 << 27
_UNIT = 2.0**-24  # half the distance from 1 to the next float32
_BLOCK = 4096


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, held within LIMIT."""
    return np.clip(np.floor(SCALE * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Place of the nearest row of c for each row of x, its squared distance, and how many distances were taken exactly.

    All are integers within LIMIT. Screening: |c|^2 - 2 x.c orders the rows of c as the
    distance does, and is taken as a float32 matrix product. Its error is below
    e = 2 (k + 6) u |x||c| + 4 u |c|^2 for k components and u = 2^-24: turning x and c into
    float32 costs a factor 1 + u each, a sum of k products in any order k more, the last
    difference one of its parts; the rest is slack for the float64 numbers that e itself is made of. An
    entry whose interval lies above another's upper end can't be nearest. Of the others, where
    there are two or more, all are taken anew in int64; equal ones go to the lower place.
    """
    k = c.shape[1]
    cf, c2 = c.astype(np.float32), (c * c).sum(1)
    norm = np.sqrt(c2.astype(np.float64))
    at, far, taken = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    for lo in range(0, len(x), _BLOCK):
        b = x[lo : lo + _BLOCK]
        rough = (c2.astype(np.float32) - np.float32(2) * (b.astype(np.float32) @ cf.T)).astype(np.float64)
        own = np.sqrt((b * b).sum(1).astype(np.float64))
        error = 2 * (k + 6) * _UNIT * own[:, None] * norm + 4 * _UNIT * c2
        open_ = rough - error <= (rough + error).min(1)[:, None]
        best = open_.argmax(1)
        many = np.flatnonzero(open_.sum(1) > 1)
        if len(many):
            i, j = np.nonzero(open_[many])
            d = ((b[many[i]] - c[j]) ** 2).sum(1)
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(i))))
            hit = np.flatnonzero(d == least)
            best[many[i[hit][::-1]]] = j[hit][::-1]  # of equal ones the lowest is written last
            taken += len(i)
        at[lo : lo + _BLOCK] = best
        far[lo : lo + _BLOCK] = ((b - c[best]) ** 2).sum(1)
    return at, far, taken


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes (n, parts) and squared distances (n, parts) of the integer vectors x under books (parts, entries, width)."""
    parts, _, width = books.shape
    found = [nearest(x[:, p * width : (p + 1) * width], books[p])[:2] for p in range(parts)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _vectors(col: pa.Array, width: int) -> np.ndarray:
    return integers(np.asarray(col.flatten()).reshape(len(col), width))


def usable(vec: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks (parts, entries, width) from the vectors of the smallest ids of ``rows`` (id, vec); None without rows.

    An id that is repeated gives its least vector, null counts as the largest id. With fewer
    ids than ``entries`` a codebook is shorter. At most ``entries`` rows reach the driver.
    """
    ids = [r.id for r in rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    if not ids:
        return None
    wanted = F.col("id").isin([i for i in ids if i is not None])
    wanted = (F.coalesce(wanted, F.lit(False)) | F.col("id").isNull()) if None in ids else wanted
    got = rows.filter(wanted).groupBy("id").agg(F.min("vec").alias("vec")).orderBy(F.col("id").asc_nulls_last()).collect()
    x = integers(np.array([r.vec for r in got], np.float64))
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry becomes the floor of the mean of its parts; unused ones stay.

    Each task adds up what it assigns and gives one number a component of the codebooks, whatever
    its rows, so copies and hot vectors move nothing; Spark adds up the tasks' numbers.
    """
    parts, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _vectors(b.column("vec"), parts * width)
            codes, _ = assign(x, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        at = ((p * entries + e)[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_pydict({"at": at, "total": total[p, e].ravel(), "n": np.repeat(count[p, e], width)})

    sums = rows.select("vec").mapInArrow(summed, "at long, total long, n long")
    out = books.copy().reshape(-1)
    for r in sums.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r["at"]] = int(r["total"]) // r["n"]
    return out.reshape(books.shape)


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, codes (binary, a byte a part) and error (squared distance over all parts) of ``rows`` (id, label, vec)."""
    parts, _, width = books.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, far = assign(_vectors(b.column("vec"), parts * width), books)
            own = [row.tobytes() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(own, pa.binary()), pa.array(far.sum(1))], ["id", "label", "codes", "error"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "label", "vec").mapInArrow(coded, f"id {kind['id']}, label {kind['label']}, codes binary, error long")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with approx: the entries that its codes name, as an array of doubles in the scale of the vectors."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in e]) for e in p]) for p in books])
    byte = lambda p: F.conv(F.substring(F.hex("codes"), 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("approx", F.flatten(F.array(*[flat[p][byte(p)] for p in range(len(books))])))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray | None]:
    """Coded rows (id, label, codes, error), a row per usable row, and the codebooks (parts, entries, width).

    Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so
    are those whose length is no multiple of ``parts`` or differs from that of the smallest id
    that is left. Components become floor(SCALE * x), held within LIMIT. Null ids and labels
    stay as they are, repeated rows are coded each; with no usable row both results are None.
    ``entries`` is 256 at most, so codebooks are of fixed size; nothing else reaches the driver.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries is from 1 to 256")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    rows = rows.filter(usable(F.col("vec")) & (F.size("vec") % parts == 0))
    least = rows.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.size("vec").alias("width"))).alias("m")).first().m
    if least is None:
        return None, None
    rows = rows.filter(F.size("vec") == least.width)
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = refine(rows, books)
    return encode(rows, books), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of embeddings; none gives an empty result."""
    df = table(spark, sf_dir, "embeddings")
    coded, books = compress(df)
    if coded is None:
        return df.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = store(coded)  # read twice below
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long")
    by = store(coded.groupBy(F.col("label").alias("l")).agg(total.alias("label_error")))
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = coded.join(by, F.col("label").eqNullSafe(F.col("l")))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment under codebook c{k}, and codebook c{k+1}."""
    return f"""
a{k} AS (SELECT parts.vec_id, parts.p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS best
         FROM parts JOIN c{k} ON c{k}.p = parts.p GROUP BY ALL),
s{k} AS (SELECT p, e, i, floor(sum(v) / count(*))::BIGINT AS v
         FROM (SELECT a{k}.p, best % 64 AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM a{k} JOIN parts USING (vec_id, p)) GROUP BY ALL),
c{k + 1} AS (SELECT c{k}.p, c{k}.e, coalesce(m.c, c{k}.c) AS c
         FROM c{k} LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM s{k} GROUP BY ALL) m ON m.p = c{k}.p AND m.e = c{k}.e),"""


OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
              FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 64),{_round_sql(0)}{_round_sql(1)}
done AS (SELECT vec_id, parts.p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS best
         FROM parts JOIN c2 ON c2.p = parts.p GROUP BY ALL),
codes AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM done GROUP BY vec_id),
flat AS (SELECT p, e, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS v FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) FROM flat) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""
