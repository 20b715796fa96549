"""Files: paths as metadata, manifests, logs, notes. Bytes are read only where content is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_fields(paths: DataFrame, path: str) -> DataFrame:
    """company, doc_type and year from a relative path's first folders, where it is that deep, and filename."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    at = lambda k: F.when(F.size(p) > k + 1, F.get(p, F.lit(k))).otherwise(F.lit(""))
    return paths.withColumns({"company": at(0), "doc_type": at(1), "year": at(2), "filename": F.element_at(p, -1)})


def scan_files(spark: SparkSession, folder: str, suffix: str = "pdf", least_bytes: int = 0) -> DataFrame:
    """Files below a folder, case of the suffix aside: local_path, length, path fields and doc_id, md5 of the path.

    Content is not read: the reader prunes it. Paths that differ in case only count once.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    found = found.filter(F.lower("path").endswith(f".{suffix}") & (F.col("length") >= least_bytes))
    one = found.groupBy(F.lower("path").alias("__low")).agg(F.min("path").alias("local_path"), F.max("length").alias("length")).drop("__low")
    inside = F.split(F.col("local_path"), F.concat(F.lit(r"\Q"), F.lit(folder.rstrip("/").split("://")[-1] + "/"), F.lit(r"\E")), 2)
    named = one.withColumn("__rel", F.element_at(inside, -1))
    return path_fields(named, "__rel").withColumn("doc_id", F.md5("local_path")).drop("__rel")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with all columns as strings, nulls as empty."""
    return spark.read.csv(path, header=True, inferSchema=False).na.fill("")


def read_master(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """CSV of strings in which rows of the wrong width are skipped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=header, schema=schema, mode="DROPMALFORMED", enforceSchema=True)


def date_column(columns: list[str]) -> str | None:
    """The column that holds the effective date, by its head: the first with both words, else with one of them; None without."""
    has = [(sum(w in c.lower() for w in ("effective", "date")), c) for c in columns]
    most = max(n for n, _ in has) if has else 0
    return next(c for n, c in has if n == most) if most else None


def read_parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or one without rows where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes as path, front (map of the simple keys of the YAML head) and body; folders' names are not read as columns."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.split(x, ":", 2)[0].alias("k"), F.regexp_replace(F.trim(F.split(x, ":", 2)[1]), "^[\"']|[\"']$", "").alias("v")))
    # Of repeated keys the last counts.
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return raw.select("path", F.map_from_entries(last).alias("front"), F.regexp_replace("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?", "").alias("body"))


#: Labels of layout items that head a section.
HEADERS = ("title", "section_header")


def profile_parses(parses: DataFrame, key: str, js: str) -> DataFrame:
    """key, kind, n_texts, n_tables, n_pages, chars, labels (map to counts) and headers of each parse as JSON.

    kind is layout, fallback (sections of text without a layout) or broken. Everything is read from the
    row; nothing meets across rows.
    """
    schema = "fallback boolean, sections array<struct<text:string>>, texts array<struct<label:string,text:string,prov:array<struct<page_no:int>>>>, tables array<string>"
    p = parses.select(key, F.from_json(js, schema).alias("p"), F.coalesce(F.get_json_object(js, "$").startswith("{"), F.lit(False)).alias("whole")).select(key, "p.*", "whole")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    texts = none(F.col("texts"), "array<struct<label:string,text:string,prov:array<struct<page_no:int>>>>")
    sections = none(F.col("sections"), "array<struct<text:string>>")
    lay = ~F.coalesce("fallback", F.lit(False))
    p = p.select(key, "whole", lay.alias("lay"), texts.alias("t"), sections.alias("s"), none(F.col("tables"), "array<string>").alias("tables"))
    said = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + F.length(F.coalesce(x["text"], F.lit(""))))
    names = F.transform("t", lambda x: F.coalesce(x["label"], F.lit("")))
    pages = F.array_max(F.flatten(F.transform("t", lambda x: F.coalesce(F.transform(x["prov"], lambda y: y["page_no"]), F.array().cast("array<int>")))))
    count = F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda x: x == n)).cast("long")))
    return p.select(
        key, F.when(~F.col("whole"), "broken").when(F.col("lay"), "layout").otherwise("fallback").alias("kind"),
        F.when(F.col("lay"), F.size("t")).otherwise(F.size("s")).cast("long").alias("n_texts"), F.size("tables").cast("long").alias("n_tables"), F.coalesce(pages, F.lit(0)).cast("long").alias("n_pages"),
        F.when(F.col("lay"), said(F.col("t"))).otherwise(said(F.col("s"))).alias("chars"), count.alias("labels"),
        F.transform(F.filter("t", lambda x: x["label"].isin(*HEADERS)), lambda x: x["text"]).alias("headers"),
    )


def parse_route(size: Column, lean: int = 4 << 20, large: int = 10 << 20) -> Column:
    """How a file of this size is parsed."""
    return F.when(size >= large, "text_layer_then_ocr").when(size >= lean, "lean").otherwise("full")


def filename_locale(name: Column) -> Column:
    """en or fr by a suffix of the file name; null without one."""
    low = F.lower(name)
    return F.when(low.rlike(r"[_\-. ](en|eng|english)\.pdf$"), "en").when(low.rlike(r"[_\-. ](fr|fra|french)\.pdf$"), "fr")


def filename_slug(name: Column) -> Column:
    """The file name without its suffix and locale."""
    return F.regexp_replace(name, r"(?i)([_\-. ](en|eng|english|fr|fra|french))?\.pdf$", "")


def file_signature(name: Column, content: Column, edge: int = 32 << 10) -> Column:
    """First 16 hex digits of SHA-256 over the name, the size (8 bytes, little endian), the first and, beyond two edges, the last bytes."""
    size = F.octet_length(content)
    big = F.lpad(F.hex(size.cast("long")), 16, "0")
    little = F.concat(*[F.substring(big, k, 2) for k in range(15, 0, -2)])
    tail = F.when(size > 2 * edge, F.substr(content, size - edge + 1, F.lit(edge))).otherwise(F.lit(b""))
    return F.substring(F.sha2(F.concat(F.encode(name, "utf-8"), F.unhex(little), F.substr(content, F.lit(1), F.lit(edge)), tail), 256), 1, 16)
