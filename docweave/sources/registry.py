"""Registry tables: Parquet with fixed columns, defaults and keys, which older files may lack in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of each table.
COLUMNS = {
    "documents": "file_hash string, filing_id string, corpus_id string, entity_name string, doc_type string, doc_date string, chunk_count int, parse_status string, json_path string, chunks_indexed boolean, entity_id string, fiscal_year int, period_end date",
    "corpora": "corpus_id string, name string, topic string, doc_count int, chunk_count int, index_csv_path string, docs_dir string, chunks_parquet_path string, source_kind string",
    "schemas": "schema_id string, corpus_id string, schema_version int, columns_json string, approved_at timestamp, fill_rates_json string",
    "jobs": "job_id string, corpus_id string, schema_id string, completed_at timestamp, n_docs int, n_rows_extracted int, status string",
    "entities": "entity_id string, cik string, lei string, profile_number string, company_name string, naics string, issuer_type string, website string",
    "identifiers": "entity_id string, id_type string, id_value string, valid_from date, valid_to date, source string",
}
#: What tells the rows of a table apart.
KEYS = {"documents": ["file_hash", "corpus_id"], "corpora": ["corpus_id"], "schemas": ["schema_id"], "jobs": ["job_id"], "entities": ["entity_id"], "identifiers": ["entity_id", "id_type", "id_value", "valid_from"]}
#: What stands where nothing was given, by column.
DEFAULTS = {
    "documents": {"entity_name": "", "doc_type": "", "doc_date": "", "chunk_count": 0, "parse_status": "OK", "json_path": "", "chunks_indexed": False, "entity_id": ""},
    "corpora": {"topic": "", "doc_count": 0, "chunk_count": 0, "index_csv_path": "", "docs_dir": "", "chunks_parquet_path": "", "source_kind": ""},
    "schemas": {"schema_version": 1, "columns_json": "[]", "fill_rates_json": "{}"},
    "jobs": {"schema_id": "", "n_docs": 0, "n_rows_extracted": 0, "status": "running"},
    "entities": {"company_name": "", "naics": ""},
    "identifiers": {"source": ""},
}


def fitted(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the table's columns and types; what is missing or null takes its default, other columns drop out."""
    own = {c.lower() for c in rows.columns}

    def value(field: T.StructField):
        default = F.lit(DEFAULTS[name].get(field.name)).cast(field.dataType)
        return (F.coalesce(F.col(f"`{field.name}`").cast(field.dataType), default) if field.name in own else default).alias(field.name)

    return rows.select(*[value(f) for f in T.StructType.fromDDL(COLUMNS[name]).fields])


def read_registry(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table, with all its columns whichever of them its files have; without rows where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return fitted(spark.read.parquet(f"{folder}/{name}", mergeSchema=True), name)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(COLUMNS[name]))


def registry_stats(spark: SparkSession, folder: str) -> DataFrame:
    """corpus_id, n_documents, n_hashes, n_chunks, n_ok, n_indexed and n_entities by corpus of the documents table."""
    docs = read_registry(spark, folder, "documents")
    entity = F.when(F.col("entity_id") != "", F.col("entity_id"))
    return docs.groupBy("corpus_id").agg(
        F.count("*").alias("n_documents"), F.count_distinct("file_hash").alias("n_hashes"), F.sum("chunk_count").alias("n_chunks"), F.count_if(F.col("parse_status").startswith("OK")).alias("n_ok"),
        F.count_if("chunks_indexed").alias("n_indexed"), F.count_distinct(entity).alias("n_entities"),
    )


def cached(files: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """``files`` (with file_hash) with cached and json_path: the least path of an OK parse of the same content, in whatever corpus; empty without one."""
    ok = read_registry(spark, folder, "documents").filter(F.col("parse_status").startswith("OK") & (F.col("json_path") != ""))
    one = ok.groupBy(F.col("file_hash").alias("__h")).agg(F.min("json_path").alias("__p"))
    met = files.join(one, F.col("file_hash") == F.col("__h"), "left")
    return met.select(*files.columns, F.col("__p").isNotNull().alias("cached"), F.coalesce("__p", F.lit("")).alias("json_path"))


def register(rows: DataFrame, folder: str, name: str) -> None:
    """Append the rows whose keys the table does not hold yet, one of each key; nulls in a key are equal.

    Of rows that share a key the least in all columns stays. The table is read, not rewritten.
    """
    keys = KEYS[name]
    new = fitted(rows, name)
    one = new.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.struct(*new.columns)).alias("r")).select("r.*")
    held = read_registry(rows.sparkSession, folder, name).select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    one.join(held, same, "left_anti").write.mode("append").parquet(f"{folder}/{name}")
