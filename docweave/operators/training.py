"""Rows for review and training out of extractions, checks and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.sampling import hash_sample

#: Scores and remarks of a result, with what a correction sets them to.
ZEROED = {"has_discussion": False, "direction": "NONE", "score": 0, "disclosure": "BOILERPLATE"}


def review_rows(rows: DataFrame, families: dict[str, tuple[str, str]], texts: dict[str, str]) -> DataFrame:
    """A row per piece of evidence: the columns of ``rows`` but the arrays, category, signal_type, quote.

    ``families`` names, by category, an array of structs and the field that holds its type;
    ``texts`` an array of strings. Blank quotes drop out. One explode for all families.
    """
    kind = "array<struct<category:string,signal_type:string,quote:string>>"
    made = lambda k, kind_, quote: F.struct(F.lit(k).alias("category"), F.trim(F.coalesce(kind_, F.lit(""))).alias("signal_type"), quote.alias("quote"))
    each = lambda column, f: F.coalesce(F.transform(column, f), F.array().cast(kind))
    family = lambda k, c, t: each(c, lambda x: made(k, x[t], F.trim(F.coalesce(x["quote"], F.lit("")))))
    plain = lambda k, c: each(c, lambda x: made(k, F.lit(""), F.coalesce(x, F.lit(""))))
    parts = [family(k, c, t) for k, (c, t) in families.items()] + [plain(k, c) for k, c in texts.items()]
    left = [c for c in rows.columns if c not in {c for c, _ in families.values()} | set(texts.values())]
    return rows.select(*left, F.explode(F.concat(*parts)).alias("e")).select(*left, "e.*").filter("trim(quote) <> ''")


def training_rows(results: DataFrame, checks: DataFrame, chunks: DataFrame, doc: str, most: int, seed: int = 7) -> DataFrame:
    """Results to train on: up to ``most`` gold rows (split gold), and corrections (split correction) with ZEROED values.

    Gold: a discussion was found, the worst finding of the check is none or warn, there are
    quotes, and the document is not of forward-looking statements only. Corrections are the
    documents that are. Documents without a positive chunk drop out.
    ``results``: doc, key_quotes and the columns of ZEROED; ``checks``: doc, severity, forward_only;
    ``chunks``: doc, positive.
    """
    met = results.join(checks.select(doc, "severity", "forward_only"), doc, "left")
    only = F.coalesce(F.col("forward_only"), F.lit(False))
    gold = met.filter(F.col("has_discussion") & F.lower("severity").isin("none", "warn") & (F.length("key_quotes") > 4) & ~only)
    fixed = met.filter(only).withColumns({c: F.lit(v) for c, v in ZEROED.items()})
    both = hash_sample(gold, doc, most, seed).withColumn("split", F.lit("gold")).unionByName(fixed.withColumn("split", F.lit("correction")))
    return both.join(chunks.filter("positive").select(doc).distinct(), doc, "left_semi").select(doc, "split", *ZEROED)


def few_shot(rows: DataFrame, fields: list[str], order: list[Column], rework: bool = False) -> DataFrame:
    """Of each field the first rows that have it, three in a rework and one else: field, value and the columns of ``rows`` but the fields.

    Each field is a top-k of its own: a partition passes on k rows, however many it has.
    """
    left = [c for c in rows.columns if c not in fields]
    k = 3 if rework else 1
    picks = [rows.filter(F.col(f).isNotNull()).orderBy(*order).limit(k).select(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), *left) for f in fields]
    return reduce(DataFrame.unionByName, picks)
