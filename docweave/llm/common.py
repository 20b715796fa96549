"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, return.
WS = r"[\x20\x09-\x0D]+"
#: Only the runs of white space that differ from one blank.
ODD_WS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only a local session may lack the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docweave-"))
    return folder or sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint(), in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: With this setting, Spark removes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled leaves the executors' disks when the query ends; its rows must have been written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def store(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again: smaller than a checkpoint, for many narrow rows.

    The shuffles that made the rows are not needed after that, and leave the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docweave-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: Column) -> Column:
    """A digest that rows share if they agree in all these columns, nulls included."""
    return F.md5(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in cols]))


def one_space(text: Column) -> Column:
    """Each run of white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_WS, " ")


def words(text: Column) -> Column:
    """array<string> of the words; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def word_count(text: Column) -> Column:
    """Number of words as long, without building them."""
    t = F.trim(one_space(text))
    blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
