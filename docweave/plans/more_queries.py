"""Sources, incremental refresh, selection and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import records as R
from docweave.functions import text as X
from docweave.operators import completion as Y
from docweave.operators import entities as E
from docweave.operators import quality as Q
from docweave.operators import retrieval as L
from docweave.operators import rollup as U
from docweave.operators import sampling as S
from docweave.plans.retrieval_queries import _LINES, bounded_chunks, tagged_chunks
from docweave.sources.config import source_mode
from docweave.sources.files import profile_parses
from docweave.sources.scratch import scratch
from docweave.sources.tables import table
from docweave.streaming import live_state as Z
from docweave.streaming import watch as W

QUERIES = {}


def _q(name, sql, *sources):
    def add(f):
        QUERIES[name] = (lambda spark, d: f(*[table(spark, d, s) for s in sources]), sql)
        return f

    return add


@_q("A08_log_head", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500", "events")
def _(e):
    return e.orderBy("event_id").limit(500).select("event_id", "event_type")


@_q("A14_layout_profile", "SELECT role AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role", "conversations")
def _(c):
    return c.groupBy(F.col("role").alias("label")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@_q("A14_parse_profiles", """
WITH t AS (SELECT conv_id, turn + 1 AS page, CASE WHEN turn % 3 = 0 THEN 'title' ELSE role END AS label, text, turn FROM conversations), h AS (SELECT conv_id, label || '=' || count(*) AS x FROM t GROUP BY conv_id, label)
SELECT conv_id, 'layout' AS kind, count(*) AS n_texts, count(*) FILTER (WHERE turn % 4 = 1) AS n_tables, max(page) AS n_pages, sum(length(text))::BIGINT AS chars,
 (SELECT string_agg(x, ',' ORDER BY x) FROM h WHERE h.conv_id = t.conv_id) AS labels, string_agg(left(text, 20), '|' ORDER BY turn) FILTER (WHERE label = 'title') AS headers FROM t WHERE conv_id % 5 > 0 GROUP BY conv_id
UNION ALL SELECT conv_id, 'fallback', count(*), 0, 0, sum(length(text))::BIGINT, '', '' FROM t WHERE conv_id % 5 = 0 GROUP BY conv_id""", "conversations")  # fmt: skip
def _(c):
    """Conversations as parses, a turn a text; every fifth as a fallback parse without a layout."""
    t = F.col("turn")
    item = F.struct(F.when(t % 3 == 0, "title").otherwise(F.col("role")).alias("label"), "text", F.array(F.struct((t + 1).alias("page_no"))).alias("prov"), t.alias("at"))
    table_ = F.when(t % 4 == 1, F.struct(F.lit("cell").alias("data")))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))).alias("t"), F.collect_list(table_).alias("tables"))
    layout = F.to_json(F.struct(F.transform("t", lambda x: x["i"]).alias("texts"), "tables"))
    fallback = F.to_json(F.struct(F.lit(True).alias("fallback"), F.transform("t", lambda x: F.struct(x["i"]["text"].alias("text"))).alias("sections")))
    parses = whole.select("conv_id", F.when(F.col("conv_id") % 5 == 0, fallback).otherwise(layout).alias("js"))
    p = profile_parses(parses, "conv_id", "js")
    labels = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return p.select("conv_id", "kind", "n_texts", "n_tables", "n_pages", "chars", labels.alias("labels"), F.array_join(F.transform("headers", lambda h: F.substring(h, 1, 20)), "|").alias("headers"))


@_q("C18_default_rows", "SELECT doc_id, 'unknown' AS topic, CAST(NULL AS VARCHAR) AS topic_evidence_quote, 0 AS score FROM documents", "documents")
def _(d):
    return d.select("doc_id", F.lit("unknown").alias("topic"), F.lit(None).cast("string").alias("topic_evidence_quote"), F.lit(0).alias("score"))


@_q("C28_strip_rows", "SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'no evidence' ELSE '' END AS _row_note FROM customer", "customer")
def _(c):
    rows = c.select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 1, "q").alias("name_evidence_quote"))
    noted = rows.withColumn("_row_note", F.when(F.col("name_evidence_quote").isNull(), "no evidence").otherwise(""))
    return noted.drop("c_custkey", *[x for x in noted.columns if "_evidence_" in x])


@_q("C31_dashboard", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events", "events")
def _(e):
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@_q("D25_source_mode", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'local_folder' WHEN 2 THEN 'csv_manifest' ELSE 'query' END AS mode FROM pages", "pages")
def _(p):
    k = F.col("page_id") % 4
    s = F.when(k == 0, F.lit("https://Example.org/x")).when(k == 1, F.lit("/data/docs")).when(k == 2, F.lit("m.CSV")).otherwise(F.lit("annual reports of miners"))
    return p.select("page_id", source_mode(s).alias("mode"))


@_q("D37_criteria_block", "SELECT item_id, '## Criteria' || chr(10) || left(trim(text), 4000) AS block FROM benchmark", "benchmark")
def _(b):
    return b.select("item_id", F.concat(F.lit("## Criteria\n"), F.substring(F.trim("text"), 1, 4000)).alias("block"))


@_q("E06_chunk_parsed", f"{_LINES} SELECT doc_id, count(*) AS n FROM h WHERE doc_id % 5 IN (0, 1) GROUP BY doc_id", "documents")
def _(d):
    status = F.get(F.array(F.lit("OK"), F.lit("OK_OCR"), F.lit("PDF_MISSING"), F.lit("ERROR: x"), F.lit(None)), (F.col("doc_id") % 5).cast("int"))
    parses = d.select("doc_id", status.alias("status")).filter(Q.is_ok(F.col("status")))
    return tagged_chunks(d.join(parses, "doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))


@_q("E07_M07_replace_chunks", """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'old' END AS chunk, doc_id % 10 > 0 AS answered FROM documents""", "documents")  # fmt: skip
def _(d):
    old = d.select("doc_id", F.lit("old").alias("chunk"))
    answers = d.select("doc_id", F.lit(True).alias("answered"))
    new = d.filter("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("chunk"))
    # Chunks are replaced, and what was answered on the old ones no longer counts.
    chunks = E.replace_by_key(old, new, ["doc_id"])
    valid = answers.join(new, "doc_id", "left_anti")
    return chunks.join(valid, "doc_id", "left").select("doc_id", "chunk", F.coalesce("answered", F.lit(False)).alias("answered"))


@_q("F02_G06_canonical_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END AS doc_id FROM orders", "orders")
def _(o):
    doc = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise(F.lit(" "))
    return o.select("o_orderkey", E.backfill(doc, F.col("o_custkey").cast("string")).cast("long").alias("doc_id"))


@_q("F03_sample_restriction", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer")
def _(c):
    wanted = c.sparkSession.createDataFrame([("building",), ("MACHINERY",)], "s string").select(F.upper("s").alias("c_mktsegment"))
    return c.join(wanted, "c_mktsegment", "left_semi").select("c_custkey")


@_q("G30_notes_load", "SELECT lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g')) AS slug, s_name AS name, s_acctbal AS balance FROM supplier", "supplier")
def _(s):
    return s.select(R.issuer_slug(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "_")).alias("slug"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@_q("H05_catalogue_upsert", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier", "supplier")
def _(s):
    rows = s.select("s_suppkey", "s_name", "s_acctbal")
    counts = rows.filter("s_suppkey % 2 = 0").select("s_suppkey", F.lit("").alias("s_name"), F.lit(1.5).alias("s_acctbal"))
    return E.upsert(rows, counts, "s_suppkey")


@_q("J14_topology_checks", "SELECT count(*) >= 6 AS enough, count(*) FILTER (WHERE c_acctbal > 0) >= 6 AS done, bool_or(c_mktsegment <> '') AS sourced FROM customer", "customer")
def _(c):
    return c.agg((F.count("*") >= 6).alias("enough"), (F.count_if(F.col("c_acctbal") > 0) >= 6).alias("done"), F.bool_or(F.col("c_mktsegment") != "").alias("sourced"))


@_q("K06_seeded_sample", "SELECT doc_id FROM labels WHERE quality = 1 ORDER BY md5(CAST(doc_id AS VARCHAR) || '/7'), doc_id LIMIT 40", "labels")
def _(lb):
    return S.hash_sample(lb.filter("quality = 1"), "doc_id", 40).select("doc_id")


@_q("L03_L13_refinement", f"""{_LINES},
t AS (SELECT doc_id, ordinal, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'from')) AS tf FROM h)
SELECT doc_id, max(tf) AS most FROM t GROUP BY doc_id HAVING max(tf) > 0""", "documents")  # fmt: skip
def _(d):
    # A hop's query counts a term as often as it stands there; one term alone ranks by its own frequency and length.
    chunks = tagged_chunks(d).withColumn("keyword_hit", F.lit(False))
    hits = L.score_chunks(chunks, {"from": 2}).filter("score > 0")
    tf = F.size(F.filter(X.tokens(F.col("text")), lambda x: x == "from"))
    return hits.groupBy("doc_id").agg(F.max(tf).cast("long").alias("most"))


@_q("L03_L13_refinement_all", None, "documents")
def _(d):
    hits = L.score_chunks(bounded_chunks(d).withColumn("keyword_hit", F.lit(False)), {"from": 2}).filter("score > 0")
    tf = F.size(F.filter(X.tokens(F.col("text")), lambda x: x == "from"))
    return hits.groupBy("doc_id").agg(F.max(tf).cast("long").alias("most"))


@_q("M09_lease_jobs", """
WITH j AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), w AS (SELECT c_custkey, ['view', 'click', 'error'][c_custkey % 3 + 1] AS can, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS k FROM customer)
SELECT event_id, c_custkey FROM j JOIN w ON event_type = can AND j.k = w.k""", "events", "customer")  # fmt: skip
def _(e, c):
    jobs = e.select("event_id", "event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("k"))
    can = F.get(F.array(F.lit("view"), F.lit("click"), F.lit("error")), (F.col("c_custkey") % 3).cast("int"))
    workers = c.select("c_custkey", can.alias("event_type")).withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("c_custkey")))
    return jobs.join(workers, ["event_type", "k"]).select("event_id", "c_custkey")


@_q("N08_N09_feedback_rows", "SELECT event_id, md5('run/' || event_id)[:16] AS event_key, 'field_override' AS kind FROM events WHERE event_type = 'error'", "events")
def _(e):
    key = F.substring(F.md5(F.concat_ws("/", F.lit("run"), F.col("event_id").cast("string"))), 1, 16)
    return e.filter("event_type = 'error'").select("event_id", key.alias("event_key"), F.lit("field_override").alias("kind"))


@_q("Q05_lakehouse_stats", "SELECT lang AS corpus, count(DISTINCT md5(text)) AS texts, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang", "documents")
def _(d):
    return d.groupBy(F.col("lang").alias("corpus")).agg(F.countDistinct(F.md5("text")).alias("texts"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@_q("I16_max_pressure", "SELECT CAST(event_id % 3 AS VARCHAR) AS field, max(value) AS pressure FROM events GROUP BY 1", "events")
def _(e):
    m = e.groupBy("user_id", (F.col("event_id") % 3).cast("string").alias("f")).agg(F.max("value").alias("v"))
    maps = m.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("p"))
    return maps.select(F.explode("p").alias("field", "v")).groupBy("field").agg(F.max("v").alias("pressure"))


_BY_SOURCE = "SELECT source, sha256(string_agg(s, chr(10) ORDER BY s) || chr(10)) AS fingerprint FROM (SELECT DISTINCT source, md5(text) AS s FROM documents) GROUP BY source"


@_q("H15_fingerprint_by_source", _BY_SOURCE, "documents")
@_q("H15_fingerprint_by_source_all", _BY_SOURCE, "documents")
def _(d):
    return U.fingerprints_by(d, "source", F.md5("text"))


@_q("A07_E01_layout_chunks", "SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, role AS section_path, CAST(turn AS INTEGER) AS page_start, trim(text) AS text FROM conversations WHERE trim(text) <> ''", "conversations")
def _(c):
    from docweave.operators.chunking import chunk_layouts

    item = F.struct("turn", F.array(F.struct(F.lit("header").alias("kind"), F.lit(1).alias("level"), F.col("role").alias("text"), F.lit(0).cast("long").alias("page")), F.struct(F.lit("text").alias("kind"), F.lit(1).alias("level"), F.col("text").alias("text"), F.col("turn").cast("long").alias("page"))).alias("x"))
    js = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t")).select("conv_id", F.to_json(F.flatten(F.transform("t", lambda t: t["x"]))).alias("js"))
    return chunk_layouts(js, "conv_id", "js").select("doc_id", "ordinal", "section_path", "page_start", "text")


_TOPIC = "Licensed work released under version terms of the public license"


def _topic_rules():
    from docweave.plans.schema import keyword_rules

    return [r for r in keyword_rules(_TOPIC) if r[0].isascii()]


@_q("D14_D15_topic_rules", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{x}' END" for x, p in _topic_rules()) + "], lambda x: x IS NOT NULL)), ',') AS labels FROM documents", "documents")
def _(d):
    return d.select("doc_id", F.array_join(X.labels(F.col("text"), _topic_rules()), ",").alias("labels"))


@_q("D31_critique_salvage", "SELECT event_id, ['good', 'ok', 'needs_work'][event_id % 3 + 1] AS quality, event_type AS field FROM events", "events")
def _(e):
    import pandas as pd

    from docweave.operators.external import salvage_critique

    def salvaged(batches):
        for b in batches:
            found = [salvage_critique(t) for t in b.t]
            yield pd.DataFrame({"event_id": b.event_id, "quality": [f["overall_quality"] for f in found], "field": [f["field_issues"][0]["field"] for f in found]})

    quality = F.get(F.array(F.lit("good"), F.lit("ok"), F.lit("Needs_Work")), (F.col("event_id") % 3).cast("int"))
    broken = F.concat(F.lit('note {"overall_quality": "'), quality, F.lit('", "field_issues": [{"field": "'), "event_type", F.lit('", "issue": "x"}, {"field": "y", "iss'))
    return e.select("event_id", broken.alias("t")).mapInPandas(salvaged, "event_id long, quality string, field string")


# The running chain: files of documents through index, chunks and panel

READY_AT = 100


def run_chain(documents, files=4):
    """Panel by source and the signals of a stream that reads ``documents`` in ``files`` files, a file a batch."""
    spark, at = documents.sparkSession, scratch(documents.sparkSession)
    documents.select("doc_id", "text", "source").repartition(files, "doc_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")

    def panel(chunks):
        """Of the sources that the batch touches, all chunks that stand."""
        touched = chunks.select(F.col("source").alias("s")).distinct()
        standing = W.current(spark, f"{at}/chunks")
        return standing.join(touched, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.sum("chars").alias("chars"))

    stages = [
        (f"{at}/index", ["doc_id"], lambda d: d.withColumn("n_chars", F.length("text"))),
        (f"{at}/chunks", ["doc_id"], lambda d: tagged_chunks(d).select("doc_id", "ordinal", F.length("text").alias("chars")).join(d.select("doc_id", "source"), "doc_id")),
        (f"{at}/panel", ["source"], panel),
    ]
    signals = W.Signals(READY_AT)
    spark.streams.addListener(signals)
    try:
        query = W.refresh_chain(stream, f"{at}/state", stages, signals=signals, counted=f"{at}/chunks", buckets=8).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.streams.removeListener(signals)
    return W.current(spark, f"{at}/panel"), signals


_CHUNK_ROWS = f"{_LINES} SELECT h.doc_id, source, length(h.text) AS chars FROM h JOIN documents USING (doc_id)"


@_q("M01_M07_stream", f"SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, sum(chars)::BIGINT AS chars FROM ({_CHUNK_ROWS}) GROUP BY source", "documents")
def _(d):
    return run_chain(d)[0].select("source", "n_docs", "n_chunks", "chars")


@_q("M06_signals", f"""
WITH c AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks FROM ({_CHUNK_ROWS}))
SELECT 'PARSE_PROGRESS' AS signal, n_docs, n_chunks FROM c UNION ALL SELECT 'EXTRACTION_READY', {READY_AT}, 1 FROM c WHERE n_docs >= {READY_AT}""", "documents")
def _(d):
    """The last progress of a running chain, and how often it said that enough documents are there (the mark, 1)."""
    signals = run_chain(d)[1]
    last = max(x for x in signals.told if x[0] == "PARSE_PROGRESS")
    ready = [(x[0], READY_AT, signals.told.count(x)) for x in signals.told if x[0] == "EXTRACTION_READY"]
    return d.sparkSession.createDataFrame([last, *ready], "signal string, n_docs long, n_chunks long")


_RUN_EVENTS = """
r AS (SELECT user_id::VARCHAR AS run, event_id AS seq, event_type = 'search' AND value > 50 AS rework,
 CASE WHEN event_type = 'view' THEN event_id % 7 END AS n_columns, CASE WHEN event_type = 'click' THEN event_id % 3 > 0 END AS approved, CASE WHEN event_type IN ('view', 'click') THEN event_id % 9 END AS n_rows,
 CASE WHEN event_id % 4 = 0 THEN event_id % 5 END AS n_errors, CASE WHEN event_id % 4 = 1 THEN event_id % 6 END AS n_flagged, CASE event_id % 8 WHEN 2 THEN 'needs_work' WHEN 6 THEN '' WHEN 7 THEN 'good' END AS quality, CASE WHEN event_id % 10 = 3 THEN 'text' END AS critique FROM events)"""
_LAST = ", ".join(f"arg_max({f}, seq) FILTER (WHERE {f} IS NOT NULL{' AND ' + f + chr(60) + chr(62) + chr(39) * 2 if f in ('quality', 'critique') else ''}) AS {f}" for f in Z.FIELDS)
_LIVE_SQL = f"""
WITH {_RUN_EVENTS},
s AS (SELECT run, {_LAST}, count(*) FILTER (WHERE rework) AS rework_count, count(*) AS n_events FROM r GROUP BY run),
c AS (SELECT *, coalesce(n_columns, 0) AS cols, coalesce(n_rows, 0) AS n, coalesce(n_errors, 0) AS e, coalesce(n_flagged, 0) AS g FROM s)
SELECT run, n_columns, approved, n_rows, n_errors, n_flagged, quality, critique, rework_count, n_events, CASE WHEN cols = 0 THEN 'design_schema' WHEN NOT coalesce(approved, false) THEN 'approve_schema' WHEN n = 0 THEN 'start_extraction'
 WHEN e / n >= 0.5 THEN 'fix_extraction' WHEN g / n > 0.4 AND e / n >= 0.25 THEN 'stabilise_model' WHEN g / n > 0.4 THEN 'refine_schema' WHEN quality = 'needs_work' THEN 'review_issues'
 WHEN coalesce(critique, '') = '' THEN 'wait_for_critique' ELSE 'iterate_or_export' END AS action FROM c"""


def run_events(e):
    """What events say of a run, a user's: mostly nothing, in every field now and then."""
    k, kind = F.col("event_id"), F.col("event_type")
    given = {
        "rework": (kind == "search") & (F.col("value") > 50), "n_columns": F.when(kind == "view", k % 7), "approved": F.when(kind == "click", k % 3 > 0), "n_rows": F.when(kind.isin("view", "click"), k % 9),
        "n_errors": F.when(k % 4 == 0, k % 5), "n_flagged": F.when(k % 4 == 1, k % 6), "quality": F.when(k % 8 == 2, "needs_work").when(k % 8 == 6, "").when(k % 8 == 7, "good"), "critique": F.when(k % 10 == 3, "text"),
    }
    return e.select(F.col("user_id").cast("string").alias("run"), k.alias("seq"), *[c.alias(f) for f, c in given.items()])


@_q("J11_N07_live_state", _LIVE_SQL, "events")
def _(e):
    return Z.with_action(Z.live_state(run_events(e)))


@_q("J11_live_state_stream", _LIVE_SQL, "events")
def _(e):
    """The same by keyed state over a stream of the events in files; of each run the last state counts."""
    spark, at = e.sparkSession, scratch(e.sparkSession)
    run_events(e).repartition(3).write.parquet(f"{at}/in")
    rows = spark.readStream.schema(run_events(e).schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    merge = lambda batch, k: W.merge_batch(batch, f"{at}/states", ["run"], 8)
    Z.live_state_stream(rows).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return Z.with_action(W.current(spark, f"{at}/states"))


# Completion of a run

_PARSE_STATUS = "CASE doc_id % 20 WHEN 0 THEN 'ERROR: x' WHEN 1 THEN 'PDF_MISSING' WHEN 2 THEN '' ELSE 'OK_FULL' END"


def _artefacts(d, lb):
    """Parses without some documents and with some errors, chunks, answers to half of them, answers to labelled documents, a panel by source."""
    parses = d.filter("doc_id % 50 <> 7").select("doc_id", F.expr(_PARSE_STATUS).alias("status"))
    chunks = tagged_chunks(d).select("doc_id", "ordinal")
    return {"index": d.select("doc_id"), "parses": parses, "chunks": chunks, "chunk_answers": chunks.filter("ordinal % 2 = 0"), "answers": lb, "panel": d.select("source").distinct()}


@_q("I14_I15_completion_report", f"""
WITH n AS ({_LINES} SELECT count(*) AS chunks, count(*) FILTER (WHERE ordinal % 2 = 0) AS chunk_answers FROM h),
p AS (SELECT count(*) AS parses, count(*) FILTER (WHERE doc_id % 20 = 0) AS errors FROM documents WHERE doc_id % 50 <> 7),
c AS (SELECT count(*) AS docs, count(*) FILTER (WHERE doc_id % 50 = 7) AS missing, count(DISTINCT source) AS panel FROM documents), a AS (SELECT count(*) AS answers FROM labels)
SELECT 'partial' AS run, false AS ok, docs AS n_index, parses AS n_parses, chunks AS n_chunks, chunk_answers AS n_chunk_answers, answers AS n_answers, panel AS n_panel, errors AS n_errors, missing AS n_missing, false AS parsed, answers = docs AS aligned,
 missing || ' documents are not parsed; ' || errors || ' parses failed; parses: ' || parses || ' rows for ' || docs || ' documents; answers: ' || answers || ' rows for ' || docs || ' documents' AS messages FROM n, p, c, a
UNION ALL SELECT 'whole', true, docs, docs, chunks, chunk_answers, docs, panel, 0, 0, true, true, 'complete' FROM n, c
UNION ALL SELECT 'begun', false, docs, 0, chunks, 0, 0, 0, 0, docs, false, false, 'no parses; no chunk_answers; no answers; no panel' FROM n, c""", "documents", "labels")  # fmt: skip
def _(d, lb):
    some = _artefacts(d, lb)
    ok = d.select("doc_id", F.lit("OK").alias("status"))
    runs = {"partial": some, "whole": some | {"parses": ok, "answers": ok}, "begun": {k: some[k] for k in ("index", "chunks")}}
    reports = [Y.assess(**parts).withColumn("run", F.lit(k)) for k, parts in runs.items()]
    both = reports[0].unionByName(reports[1]).unionByName(reports[2])
    return both.select("run", "ok", *[f"n_{x}" for x in ("index", "parses", "chunks", "chunk_answers", "answers", "panel", "errors", "missing")], "parsed", "aligned", F.array_join("messages", "; ").alias("messages"))


@_q("I14_unmatched", "SELECT doc_id::VARCHAR AS doc_id, 'a' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id::VARCHAR, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", "documents", "labels")
def _(d, lb):
    return Y.unmatched(d, lb, "doc_id", 64)


@_q("I18_parsed_count", "SELECT greatest((SELECT count(DISTINCT doc_id) FROM labels), (SELECT count(*) FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 20 > 2)) AS n_parsed", "documents", "labels")
def _(d, lb):
    return Y.parsed_count(lb, _artefacts(d, lb)["parses"])


@_q("I07_closure_summary", """
WITH r AS (SELECT *, doc_id % 9 = 0 AS failed, quality = 1 AND doc_id % 2 = 0 AS bare FROM labels)
SELECT count(*) AS total_rows, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS all_default, count(*) FILTER (WHERE bare) AS evidenceless, count(*) FILTER (WHERE doc_id % 7 = 0) AS parse_errors, count(*) FILTER (WHERE failed) AS extraction_errors,
 count(*) FILTER (WHERE NOT failed AND NOT bare) AS closure_ok, count(*) FILTER (WHERE NOT failed AND bare) AS closure_violated, count(*) FILTER (WHERE failed) AS closure_skipped,
 count(*) FILTER (WHERE doc_id % 2 = 1 AND doc_id % 3 > 0) + count(*) FILTER (WHERE doc_id % 4 > 0) AS verified, 2 * count(*) AS checked FROM r""", "labels")  # fmt: skip
def _(lb):
    """A quote that stands in its chunk's text on two of three odd rows, and one whose text is not kept, long enough on three of four."""
    k = F.col("doc_id")
    rows = lb.select(
        "doc_id", F.col("quality").cast("string").alias("q"), F.when(k % 2 == 1, "A  longer quote").alias("q_evidence_quote"), F.when(k % 3 > 0, "it has a longer\nquote").otherwise("it has none").alias("q_chunk_text"),
        F.col("toxic").cast("string").alias("t"), F.when(k % 4 > 0, "another quote").otherwise("short").alias("t_evidence_quote"), (k % 7 == 0).alias("_flag_parse_error"), F.when(k % 9 == 0, "down").otherwise(" ").alias("_extraction_error"),
    )
    return Y.consistency_summary(rows, {"q": "0", "t": "0"})
