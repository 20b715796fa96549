"""A corpus from documents: language ID, exact dedup, near dedup, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) over all rows that the one before has kept;
its result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.bpe import bpe_digests
from docweave.llm.common import crc32_mod, shared_folder
from docweave.llm.exact_dedup import keep_first
from docweave.llm.langid import fit_languages, keep_identified
from docweave.llm.mixing import mixed_documents
from docweave.llm.simhash import keep_representatives


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts, texts without letters and undecided ones go.

    Repeated rows fare alike. Without rows, or labels to learn from, none is identified and none stays.
    """
    model = fit_languages(docs.filter(crc32_mod(F.col("doc_id"), 4) != 2))
    return keep_identified(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the document of the smallest id; null text counts as empty, of repeated rows one stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id; texts without words are one group, of repeated rows one stays."""
    return keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that the mix takes, once for each time that it takes it: whole or not, at most three.

    Texts without words have nothing to take and go; null is a source of its own.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents: doc_id, n_tokens, ids_sha256, decoded_sha256; a row per row."""
    return bpe_digests(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte BPE", tokens),
]

#: Language ID, SimHash and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
