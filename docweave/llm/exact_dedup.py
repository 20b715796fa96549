"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, one_space, row_key, store

PREFIX_CHARS = 256
#: Up to this many (length, prefix hash) keys, 16 bytes each, are broadcast.
BROADCAST_KEYS = 1_000_000


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Groups of texts that are equal once each run of white space is one blank.

    Returns one row per row of ``docs``: ``doc_id``, ``keep_id`` (smallest id of the
    group), ``group_size``, ``kept`` and ``text_sha256``. Rows are grouped by byte length,
    then by a hash of the prefix; only texts in a group of two or more are hashed in full,
    so ``text_sha256`` is null for the others unless ``digest_all`` asks for every digest.
    Text itself is never shuffled: with few surviving keys they are broadcast to the scan;
    with more, the digest is taken in the scan, and rows of 100 bytes meet the keys.

    Null text counts as empty. Rows that repeat an id and its text are counted in
    ``group_size`` and only one of them is kept. A null id sorts after all others.
    An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("i"), one_space(F.col(text_col)).alias("t"))
    keyed = base.withColumns({"n": F.octet_length("t"), "p": F.xxhash64(F.substring("t", 1, prefix_chars))})
    light = materialise(keyed.select("n", "p").groupBy("n", "p").agg(F.count("*").alias("c")))
    by_length = light.groupBy("n").agg(F.sum("c").alias("m")).filter("m > 1").select("n")
    keys = light.filter("c > 1").join(by_length, "n", "left_semi").select(F.col("n").alias("kn"), F.col("p").alias("kp"))
    few = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    on = (F.col("n") == F.col("kn")) & (F.col("p") == F.col("kp"))
    if few:
        scanned = keyed.join(F.broadcast(keys), on, "left")
        again = F.col("kn").isNotNull()
        full = scanned.select("i", again.alias("again"), F.when(F.lit(True) if digest_all else again, F.sha2("t", 256)).alias("h"))
    else:
        hashed = keyed.select("i", "n", "p", F.sha2("t", 256).alias("h"))
        again = F.col("kn").isNotNull()
        full = hashed.join(keys, on, "left").select("i", again.alias("again"), F.when(F.lit(True) if digest_all else again, F.col("h")).alias("h"))
    rows = full.groupBy("i", "again", "h").agg(F.count("*").alias("copies"))
    rows = materialise(rows)
    # As a table of its own, so that both sides of the join are plain shuffles and a hot digest can be split.
    groups = store(rows.filter("again").groupBy(F.col("h").alias("gh")).agg(F.min("i").alias("k"), F.sum("copies").alias("size")))
    out = rows.join(groups, F.col("again") & (F.col("h") == F.col("gh")), "left")
    # Without digests, single texts with the same (null) id have met in one row; each is a group of its own.
    alone = ~F.col("again")
    out = out.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.col("i").alias("doc_id"),
        F.when(alone, F.col("i")).otherwise(F.col("k")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("size")).cast("long").alias("group_size"),
        (alone | (F.col("i").eqNullSafe(F.col("k")) & (F.col("c") == 1))).alias("kept"),
        F.col("h").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Of rows that repeat id and text one stays; null and empty texts are one group; an empty table
    gives an empty result.
    """
    kept = exact_dedup(docs, id_col, text_col, digest_all=True).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("k"))
    own = row_key(F.col(id_col), F.sha2(one_space(F.col(text_col)), 256))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("k"))
    return tagged.join(kept, "k", "left_semi").dropDuplicates(["k"]).select("row.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, dropped ones too."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


OP5_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
