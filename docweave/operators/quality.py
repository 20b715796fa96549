"""Evidence and quality: validation, cells, grounding, flags, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import records as R
from docweave.functions import text as X


def is_ok(status: Column) -> Column:
    return F.coalesce(status.startswith("OK"), F.lit(False))


def is_terminal(status: Column) -> Column:
    return is_ok(status) | F.coalesce(status == "PDF_MISSING", F.lit(False))


def validate_rows(raw: DataFrame, schema: dict[str, tuple[str, object]], flag: str = "_flag_parse_error") -> DataFrame:
    """Fields cast to their types; one that fails gets its default and sets the flag. No row is dropped."""
    made = {c: R.COERCE[kind.removesuffix("|null")](F.col(c), default) for c, (kind, default) in schema.items()}
    failed = F.lit(False)
    for c, (kind, _) in schema.items():
        if kind.removesuffix("|null") not in ("string", "str", "text"):
            failed = failed | (made[c].isNull() & F.col(c).isNotNull() & (F.trim(c) != ""))
    return raw.select(*[made.get(c, F.col(c)).alias(c) for c in raw.columns], failed.alias(flag))


def cells(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per cell: value, quote, pages and whether a value lacks a quote. One pass, one explode."""
    page = lambda f, k: F.try_element_at(F.split(F.col(f"{f}_evidence_pages"), "-"), F.lit(k)).try_cast("int")
    made = [
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_evidence_quote").alias("quote"), page(f, 1).alias("page_start"), F.coalesce(page(f, 2), page(f, 1)).alias("page_end"))
        for f in fields
    ]
    out = rows.select(key, F.explode(F.array(*made)).alias("c")).select(key, "c.*")
    return out.withColumn("evidenceless", R.filled(F.col("value")) & (F.trim(F.coalesce("quote", F.lit(""))) == ""))


def cardinality(name: Column, kind: Column) -> Column:
    """combine for counts, totals and numbers, else single."""
    return F.when(F.lower(name).rlike("count|total|number_of|num_") | kind.isin("integer", "number", "float"), "combine").otherwise("single")


def call_config(level: Column, temperatures: dict[str, float]) -> Column:
    out = F.lit(max(temperatures.values()))
    for k, v in temperatures.items():
        out = F.when(level == k, F.lit(v)).otherwise(out)
    return out


def page_boxes(rows: DataFrame, key: str, boxes: str, page_height: float) -> DataFrame:
    """Bounding boxes from JSON, a row each, with the top counted from the page's upper edge; malformed JSON gives none."""
    kind = "array<struct<page:bigint,l:double,t:double,r:double,b:double>>"
    return rows.select(key, F.explode(F.from_json(boxes, kind)).alias("x")).select(key, "x.page", "x.l", "x.r", (F.lit(page_height) - F.col("x.t")).alias("top"), (F.lit(page_height) - F.col("x.b")).alias("bottom"))


def verified(quote: Column, source: Column, least: int = 8) -> Column:
    """Whether the quote, white space and case aside, is of ``least`` characters or more and stands in the source."""
    q, s = X.collapse(quote), X.collapse(source)
    return (F.length(q) >= least) & (s != "") & F.contains(s, q)


def ground(cells_: DataFrame, chunks: DataFrame, doc: str = "doc_id", chunk: str = "chunk_id", least: int = 8) -> DataFrame:
    """Cells (doc, chunk, field, value, quote) held against the text of the chunk that they cite.

    A quote that fails is cleared with its chunk id, and failed is set; the value stays. Cells
    without a quote are left alone; one of less than ``least`` characters fails. Chunks meet cells in one equi-join.
    """
    c = chunks.select(F.col(doc).alias("__d"), F.col(chunk).alias("__c"), F.col("text").alias("__t"))
    met = cells_.join(c, (F.col(doc) == F.col("__d")) & (F.col(chunk) == F.col("__c")), "left")
    asked = F.trim(F.coalesce("quote", F.lit(""))) != ""
    failed = asked & ~F.coalesce(verified(F.col("quote"), F.col("__t"), least), F.lit(False))
    kept = {c: F.when(~F.col("failed"), F.col(c)) for c in ("quote", chunk)}
    return met.withColumn("failed", failed).select(*[kept.get(x, F.col(x)).alias(x) for x in cells_.columns], "failed")


def pressure(grounded: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Failures by document and field, where there are any."""
    return grounded.groupBy(doc, "field").agg(F.count_if("failed").cast("double").alias("pressure")).filter("pressure > 0")


def row_flags(fields: dict[str, str | None]) -> dict[str, Column]:
    """all_default: every field is its default; evidenceless: a value other than the default has no quote."""
    default, bare = F.lit(True), F.lit(False)
    for f, d in fields.items():
        default = default & F.col(f).eqNullSafe(F.lit(d))
        bare = bare | (F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.lit(d)) & (F.trim(F.coalesce(f"{f}_evidence_quote", F.lit(""))) == ""))
    return {"all_default": default, "evidenceless": bare}


def heuristic_check(quote: Column) -> tuple[Column, Column]:
    """(verified, score) where no model checks entailment: quotes of ten characters or more pass at 0.75."""
    good = F.coalesce(F.length(quote) >= 10, F.lit(False))
    return good, F.when(good, F.lit(0.75)).otherwise(F.lit(0.0))


def wonders(rows: DataFrame, key: str, fields: list[str], pressure_: str, most_pressure: float, order: list[Column], cap: int = 200, defaults: dict[str, str | None] | None = None, evidence_fields: tuple[str, ...] = ()) -> DataFrame:
    """Open questions: cells without a quote in rows under the pressure limit, the first ``cap`` in row and field order.

    A value other than null and its field's default (null, if ``defaults`` has none) is evidenceless; a cell
    of ``evidence_fields``, which are there to be quoted, is unresolved_evidence_mode while it is the default.
    """
    open_ = cells(rows.filter(F.coalesce(F.col(pressure_), F.lit(0.0)) <= most_pressure), key, fields)
    bare = F.trim(F.coalesce("quote", F.lit(""))) == ""
    usual = F.lit(False)
    for f in fields:
        usual = usual | ((F.col("field") == f) & F.col("value").eqNullSafe(F.lit((defaults or {}).get(f))))
    asked = F.when(F.col("value").isNotNull() & ~usual, "evidenceless").when(usual & F.col("field").isin(*evidence_fields), "unresolved_evidence_mode")
    reason = F.when(bare, asked)
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    return open_.withColumns({"place": place, "reason": reason}).filter("reason IS NOT NULL").orderBy(*order, "place").limit(cap).select(key, "field", "reason")


def field_pressure(flat: DataFrame, pressure_: str) -> DataFrame:
    """Pressure from a flat map of "doc::field" to number: doc_id, field, pressure; keys without "::" drop out."""
    e = flat.select(F.explode(pressure_).alias("k", "v")).filter(F.contains("k", F.lit("::")))
    return e.select(F.split("k", "::", 2)[0].alias("doc_id"), F.split("k", "::", 2)[1].alias("field"), F.col("v").cast("double").alias("pressure"))


def prompt_variant(fill: Column, kind: Column) -> Column:
    return F.when(fill < 0.40, "exhaustive").when(kind.isin("integer", "number", "float"), "numeric").otherwise("standard")


def found_in(cells_: DataFrame, chunks: DataFrame, doc: str, quote: str, ordinal: str, prefix: int = 120) -> DataFrame:
    """Of each cell the first chunk of its document that holds the first characters of its quote: adds found."""
    c = chunks.select(F.col(doc).alias("__d"), F.col(ordinal).alias("__o"), X.collapse(F.col("text")).alias("__t"))
    cid = cells_.withColumn("__id", F.md5(F.to_json(F.struct(*cells_.columns)))).withColumn("__q", F.substring(X.collapse(F.col(quote)), 1, prefix))
    hit = cid.join(c, F.col(doc) == F.col("__d")).filter((F.col("__q") != "") & F.contains("__t", F.col("__q")))
    first = hit.groupBy("__id").agg(F.min("__o").alias("found"))
    return cid.join(first, "__id", "left").drop("__id", "__q")


def richness(evidence: Column, mentions: Column, programs: Column, flags: list[Column]) -> Column:
    out = 3 * F.size(evidence) + F.size(mentions) + F.size(programs)
    for f in flags:
        out = out + F.coalesce(f.cast("int"), F.lit(0))
    return out


#: Of so many entities or more, as many must be done; a source must be linked to one of the first so many.
LEAST_DONE, FIRST_ENTITIES = 6, 10


def topology(columns: DataFrame, entities: DataFrame, order: list[Column]) -> DataFrame:
    """corpus, broken, column, n_entities, n_done: what keeps a corpus from running, null for nothing.

    ``columns``: corpus, place, name, keywords (array); ``entities``: corpus, done, sources (array).
    The first of: keywords (the first column without any is ``column``), acquired (six entities or
    more, fewer than six done), sources (none linked to the first ten by ``order``). Corpora that
    only one of the tables names count too. No group is gathered: counts and least places are
    combined before the shuffle, and only ten entities a corpus go on.
    """
    bare = F.coalesce(F.size(F.filter("keywords", lambda k: F.trim(k) != "")), F.lit(0)) <= 0
    asked = columns.groupBy("corpus").agg(F.min_by(F.when(bare, F.col("name")), F.when(bare, F.col("place"))).alias("column"))
    counts = entities.groupBy("corpus").agg(F.count("*").alias("n_entities"), F.count_if("done").alias("n_done"))
    ten = entities.withColumn("__rank", F.row_number().over(Window.partitionBy("corpus").orderBy(*order))).filter(F.col("__rank") <= FIRST_ENTITIES)
    linked = ten.groupBy("corpus").agg(F.bool_or(F.coalesce(F.size("sources") > 0, F.lit(False))).alias("linked"))
    both = asked.join(counts.join(linked, "corpus"), "corpus", "full").fillna(0, ["n_entities", "n_done"])
    broken = (
        F.when(F.col("column").isNotNull(), "keywords")
        .when((F.col("n_entities") >= LEAST_DONE) & (F.col("n_done") < LEAST_DONE), "acquired")
        .when((F.col("n_entities") > 0) & ~F.col("linked"), "sources")
    )
    return both.select("corpus", broken.alias("broken"), "column", "n_entities", "n_done")
