"""Whether a run is complete: artefacts compared by digests of their ids, counts, and evidence closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators import quality as Q

BUCKETS = 1024
#: What the report says, in this order, where something is missing.
ARTEFACTS = ("parses", "chunks", "chunk_answers", "answers", "panel")


def set_digests(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket and digest (count, sum and XOR of 64-bit hashes) of the keys in it, in whatever order they come.

    Combined within tasks, so at most ``buckets`` rows a task are shuffled, however many keys there are. Null is a key.
    """
    k = F.col(key).cast("string")
    one, two = F.xxhash64(k, k.isNull()), F.xxhash64(F.lit(7), k, k.isNull())
    digest = F.struct(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("s"), F.bit_xor(two).alias("x"))
    return df.groupBy(F.pmod(one, F.lit(buckets)).cast("int").alias("bucket")).agg(digest.alias("digest"))


def unmatched(a: DataFrame, b: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """key and side (a or b) of the keys that only one side has.

    Buckets of equal digests hold the same keys and are not looked at again; only ids of the others are
    joined, each once. Tables that agree cost two small sums.
    """
    left, right = set_digests(a, key, buckets).alias("l"), set_digests(b, key, buckets).alias("r")
    differ = left.join(right, F.col("l.bucket") == F.col("r.bucket"), "full").filter(~F.col("l.digest").eqNullSafe(F.col("r.digest"))).select(F.coalesce("l.bucket", "r.bucket").alias("bucket"))
    k = F.col(key).cast("string")
    at = F.pmod(F.xxhash64(k, k.isNull()), F.lit(buckets)).cast("int")
    some = lambda df: df.select(k.alias(key), at.alias("bucket")).join(F.broadcast(differ), "bucket", "left_semi").select(key).distinct()  # noqa: E731  ``buckets`` rows at most
    x, y = some(a), some(b)
    only = lambda p, q, side: p.join(q.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k")), "left_anti").withColumn("side", F.lit(side))
    return only(x, y, "a").unionByName(only(y, x, "b"))


def assess(index: DataFrame | None, parses: DataFrame | None = None, chunks: DataFrame | None = None, chunk_answers: DataFrame | None = None, answers: DataFrame | None = None,
           panel: DataFrame | None = None, review: DataFrame | None = None, review_required: bool = False, key: str = "doc_id", status: str = "status") -> DataFrame:
    """One row: ok, what is there and how much of it, and messages on what is not.

    The end is reached when every document of the index is parsed once, without an error, chunks and
    their answers are there, there is one answer a document, and a panel (and a review, if required). An empty
    index is complete; none at all is not. None stands for an artefact that does not exist.
    """
    some = next(x for x in (index, parses, chunks, chunk_answers, answers, panel, review) if x is not None)
    if index is None:
        return _report(some.sparkSession.range(1), {"index": None}, F.lit(False), F.array(F.lit("no index")))
    parts = {"index": index, "parses": parses, "chunks": chunks, "chunk_answers": chunk_answers, "answers": answers, "panel": panel, "review": review}
    row = None
    for name, df in parts.items():
        if df is not None and name != "review":
            wanted = [F.count("*").alias(f"n_{name}")]
            if name == "parses":
                said = F.trim(F.coalesce(F.col(status).cast("string"), F.lit("")))
                wanted.append(F.count_if((said != "") & ~Q.is_terminal(said)).alias("n_errors"))
            one = df.agg(*wanted)
            row = one if row is None else row.join(one, how="cross")  # one row each
    if parses is not None:
        lost = unmatched(index, parses, key).filter("side = 'a'").agg(F.count("*").alias("n_missing"))
        row = row.join(lost, how="cross")
    else:
        row = row.withColumns({"n_missing": F.col("n_index"), "n_errors": F.lit(0).cast("long")})
    n = lambda name: F.col(f"n_{name}") if parts[name] is not None else F.lit(0).cast("long")
    parsed = (F.col("n_errors") == 0) & (F.col("n_missing") == 0) & (n("parses") == F.col("n_index"))
    aligned = (n("answers") == F.col("n_index")) if answers is not None else F.lit(False)
    there = reduce(lambda a, b: a & b, [F.lit(parts[x] is not None) for x in ARTEFACTS])
    done = parsed & there & aligned & F.lit(review is not None or not review_required)
    count = lambda c, text: F.when(c > 0, F.concat(c.cast("string"), F.lit(text)))
    differs = lambda name: F.when(n(name) != F.col("n_index"), F.concat(F.lit(f"{name}: "), n(name).cast("string"), F.lit(" rows for "), F.col("n_index").cast("string"), F.lit(" documents"))) if parts[name] is not None else F.lit(None).cast("string")
    says = [*[F.lit(f"no {x}") for x in ARTEFACTS if parts[x] is None], count(F.col("n_missing"), " documents are not parsed") if parses is not None else F.lit(None).cast("string"), count(F.col("n_errors"), " parses failed"), differs("parses"), differs("answers")]
    says += [F.lit("no review")] if review_required and review is None else []
    empty = F.col("n_index") == 0
    messages = F.when(empty, F.array(F.lit("nothing to process"))).when(done, F.array(F.lit("complete"))).otherwise(F.filter(F.array(*says), lambda x: x.isNotNull()))
    return _report(row, parts, empty | done, messages, parsed | empty, aligned | empty)


def _report(row: DataFrame, parts: dict, ok: Column, messages: Column, parsed: Column | None = None, aligned: Column | None = None) -> DataFrame:
    have = set(row.columns)
    n = lambda name: (F.col(name) if name in have else F.lit(0)).cast("long").alias(name)
    no = F.lit(False)
    return row.select(
        ok.alias("ok"), *[n(f"n_{x}") for x in ("index", *ARTEFACTS, "errors", "missing")], *[F.lit(parts.get(x) is not None).alias(f"has_{x}") for x in (*ARTEFACTS, "review")],
        (no if parsed is None else parsed).alias("parsed"), (no if aligned is None else aligned).alias("aligned"), messages.alias("messages"),
    )


def consistency_summary(rows: DataFrame, defaults: dict[str, str | None], parse_error: str = "_flag_parse_error", error: str = "_extraction_error") -> DataFrame:
    """One row of counts over all extracted ``rows``: flags, errors, evidence closure, verified and checked cells.

    A row of ``defaults``' fields (each with its ``_evidence_quote`` and, where kept, ``_chunk_text``) is closed
    if every value other than null and the default has a quote; rows that failed are skipped. A quote is held against
    its chunk's text, and by its length where that was not kept.
    """
    flags = Q.row_flags(defaults)
    have = set(rows.columns)
    failed = F.trim(F.coalesce(F.col(error).cast("string"), F.lit(""))) != ""
    closed = ~flags["evidenceless"]

    def stands(f: str) -> Column:
        quote, text = F.coalesce(F.col(f"{f}_evidence_quote"), F.lit("")), F.coalesce(F.col(f"{f}_chunk_text"), F.lit("")) if f"{f}_chunk_text" in have else F.lit("")
        return (quote != "") & F.when(text != "", Q.verified(quote, text)).otherwise(Q.heuristic_check(quote)[0])

    held = reduce(lambda a, b: a + b, [stands(f).cast("long") for f in defaults])
    return rows.agg(
        F.count("*").alias("total_rows"), F.count_if(flags["all_default"]).alias("all_default"), F.count_if(flags["evidenceless"]).alias("evidenceless"),
        F.count_if(F.coalesce(F.col(parse_error), F.lit(False))).alias("parse_errors"), F.count_if(failed).alias("extraction_errors"), F.count_if(~failed & closed).alias("closure_ok"),
        F.count_if(~failed & ~closed).alias("closure_violated"), F.count_if(failed).alias("closure_skipped"), F.coalesce(F.sum(held), F.lit(0)).alias("verified"), (F.count("*") * len(defaults)).alias("checked"),
    )


def parsed_count(chunks: DataFrame, parses: DataFrame, key: str = "doc_id", status: str = "status") -> DataFrame:
    """n_parsed: the greater of the documents that have chunks and those whose parse is OK."""
    with_chunks = chunks.agg(F.count_distinct(key).alias("a"))
    return with_chunks.join(parses.filter(Q.is_ok(F.col(status))).agg(F.count_distinct(key).alias("b")), how="cross").select(F.greatest("a", "b").alias("n_parsed"))
