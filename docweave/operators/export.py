"""Sinks: ordered exports, cells, partitioned JSON, manifests, notes."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.rollup import range_fingerprint


def ordered_columns(columns: list[str], identity: list[str], fields: list[str]) -> list[str]:
    """Identity, schema fields, then sorted evidence, flags and meta columns, then the rest as they are."""
    seen: list[str] = []

    def take(names):
        seen.extend(c for c in names if c in columns and c not in seen)

    take(identity)
    take(fields)
    take(sorted(c for c in columns if "_evidence_" in c or c.endswith(("_chunk_id", "_verified", "_entailment_score"))))
    take(sorted(c for c in columns if c.startswith("_flag_")))
    take(sorted(c for c in columns if c.startswith("_")))
    take(columns)
    return seen


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def write_dataset(df: DataFrame, path: str, identity: list[str], fields: list[str]) -> None:
    flat(df.select(*ordered_columns(df.columns, identity, fields))).write.mode("overwrite").csv(path, header=True)


def write_cells(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").json(path)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def flush_rows(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at ``path`` does not hold yet: what was flushed before is never written again."""
    spark = new.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new.dropDuplicates(keys).write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as JSON, in one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def library_manifest(docs: DataFrame, corpus_id: str, signature: Column, chars: Column) -> DataFrame:
    """One row: corpus_id, n_docs, n_signatures (different ones), n_chars and the fingerprint of the signatures, taken range by range."""
    counts = docs.agg(F.count("*").alias("n_docs"), F.count_distinct(signature).alias("n_signatures"), F.coalesce(F.sum(chars), F.lit(0)).alias("n_chars"))
    return counts.join(range_fingerprint(docs, signature), how="cross").select(F.lit(corpus_id).alias("corpus_id"), "*")  # one row each


def safe_name(c):
    """At most 120 characters of letters, digits, dot, underscore and hyphen."""
    s = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9._-]+", "_"), 1, 120)
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """JSON in a folder for each key."""
    df.withColumn("__p", safe_name(F.col(key))).repartition("__p").write.mode("overwrite").partitionBy("__p").json(path)


def write_vectors(df: DataFrame, path: str, mode: str = "append", dim: int = 384) -> None:
    """Vectors by corpus, those without one as zeros; overwrite replaces the corpora at hand only."""
    made = df.withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), dim)))
    writer = made.write.mode(mode).partitionBy("corpus_id")
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(path)


def note_text(title, front: dict[str, object], body):
    """A markdown note with a YAML head as a column."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in front.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.concat(F.lit("# "), title), body)


def write_notes(df: DataFrame, name: str, text: str, path: str) -> None:
    """One text file for each note name, below ``path``; notes of one name are joined.

    A note is a few bytes and a file's cost, so tasks share the names evenly, where adaptive execution would
    merge them by bytes. Hadoop's local file system starts a process for each file and folder that it makes:
    there the tasks write the files themselves. In other stores Spark writes a folder a note.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    notes = df.select(safe_name(F.col(name)).alias("__p"), F.coalesce(F.col(text), F.lit("")).alias("value")).repartition(tasks, "__p")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() != "file":
        notes.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("__p").text(path)
        return
    store.delete(folder, True)
    root = store.makeQualified(folder).toUri().getPath()
    os.makedirs(root)
    made = notes.sortWithinPartitions("__p").mapInArrow(lambda batches: _note_files(batches, root), "n long")
    made.agg(F.sum("n")).collect()  # one row


def _note_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Rows (__p, value) in order of name as files, each whole once it has its name; the number of files."""
    rows = ((n, t) for b in batches for n, t in zip(b.column("__p").to_pylist(), b.column("value").to_pylist(), strict=True))
    count = 0
    for name, some in groupby(rows, lambda r: r[0]):
        folder = f"{root}/{zlib.crc32(name.encode()) % 256:02x}"
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{uuid.uuid4().hex}"  # readers pass over such names
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.writelines(t + "\n" for _, t in some)
        os.replace(part, f"{folder}/note-{name}.md")
        count += 1
    yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})


def neutral_report(docs: DataFrame, key: str) -> DataFrame:
    """A fixed quality row a document: no rule is set."""
    return docs.select(key, F.lit("ok").alias("qc_status"), F.lit(0).alias("n_flags"), F.lit("").alias("qc_notes"))


def sections(docs: DataFrame, prompt_parts: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds prompt: the parts that are not blank, each up to its cap, under their titles."""
    parts = [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"## {t}\n"), F.substring(c, 1, cap))) for t, (c, cap) in prompt_parts.items()]
    return docs.withColumn("prompt", F.concat_ws("\n\n", *parts))


def evidence_prompt(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, prompt: the blocks of a document in order of rank, each under a header with its place."""
    line = F.format_string("[%d] chunk %s\n%s", "rank", "chunk_id", "text")
    return blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("b")).select(doc, F.array_join(F.transform("b", lambda x: x["line"]), "\n\n").alias("prompt"))


def markdown_table(df: DataFrame, rows: int = 3, columns: int = 9, cell: int = 72) -> DataFrame:
    """The first rows as lines of a markdown table."""
    cols = df.columns[:columns]
    cells = [F.substring(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit(r"\|")), 1, cell) for c in cols]
    return df.limit(rows).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def extraction_files(rows: DataFrame, write_one) -> int:
    """Rows handed to ``write_one`` where they are, a partition at a time; the number written."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                write_one(r)
            yield pd.DataFrame({"n": [len(b)]})

    return rows.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
