"""Exports, notes and model boundaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.operators import entities as E
from docweave.operators import export as O
from docweave.operators import external as M
from docweave.sources.files import read_notes
from docweave.sources.scratch import scratch
from docweave.sources.tables import table
from docweave.streaming.watch import progress

QUERIES = {}


def _q(name, sql, source):
    def add(f):
        QUERIES[name] = (lambda spark, d: f(table(spark, d, source)), sql)
        return f

    return add


@_q("B03_ordered_export", "SELECT c_custkey, c_name AS name, c_mktsegment AS name_evidence_quote, c_nationkey AS _flag_x, c_acctbal AS rest FROM customer", "customer")
def _(c):
    wide = c.select(F.col("c_acctbal").alias("rest"), F.col("c_nationkey").alias("_flag_x"), F.col("c_mktsegment").alias("name_evidence_quote"), F.col("c_name").alias("name"), "c_custkey")
    return wide.select(*O.ordered_columns(wide.columns, ["c_custkey"], ["name"]))


@_q("B06_flat_sink", "SELECT conv_id, '[' || string_agg('\"' || role || '\"', ',' ORDER BY turn) || ']' AS roles FROM conversations GROUP BY conv_id", "conversations")
def _(c):
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return O.flat(turns.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles")))


@_q("B07_safe_names", "SELECT c_custkey, left(regexp_replace(c_name || ' / A*B', '[^A-Za-z0-9._-]+', '_', 'g'), 120) AS folder FROM customer", "customer")
def _(c):
    return c.select("c_custkey", O.safe_name(F.concat("c_name", F.lit(" / A*B"))).alias("folder"))


@_q("B10_manifest", "SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(DISTINCT md5(text)) FROM documents) AS n_signatures", "documents")
def _(d):
    return d.agg(F.count("*").alias("n_docs"), F.countDistinct(F.md5("text")).alias("n_signatures"))


@_q("B10_library_manifest", """
WITH s AS (SELECT DISTINCT md5(text) AS s FROM documents), r AS (SELECT left(s, 2) AS r, sha256(string_agg(s, chr(10) ORDER BY s) || chr(10)) AS d FROM s GROUP BY 1)
SELECT 'lib' AS corpus_id, (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM s) AS n_signatures, (SELECT sum(n_chars)::BIGINT FROM documents) AS n_chars, (SELECT sha256(string_agg(r || ':' || d, chr(10) ORDER BY r) || chr(10)) FROM r) AS fingerprint""", "documents")
def _(d):
    """The manifest of a library, written as JSON and read again."""
    at = scratch(d.sparkSession)
    O.write_report(O.library_manifest(d, "lib", F.md5("text"), F.col("n_chars")), at)
    return d.sparkSession.read.json(at).select("corpus_id", "n_docs", "n_signatures", "n_chars", "fingerprint")


@_q("A10_B11_notes_round_trip", "SELECT s_suppkey::VARCHAR AS id, s_name AS title, round(s_acctbal, 2)::DOUBLE AS balance FROM supplier", "supplier")
def _(s):
    """Notes of all suppliers, written as files with a head and read again."""
    at = scratch(s.sparkSession)
    note = O.note_text(F.col("s_name"), {"id": F.col("s_suppkey"), "balance": F.col("s_acctbal")}, F.lit("body: of the note"))
    O.write_notes(s.select(F.col("s_name").alias("name"), note.alias("text")), "name", "text", at)
    n = read_notes(s.sparkSession, at)
    return n.select(F.col("front")["id"].alias("id"), F.regexp_extract("body", "^# (.*)", 1).alias("title"), F.round(F.col("front")["balance"].cast("double"), 2).alias("balance"))


@_q("B13_vector_table", "SELECT label AS corpus_id, count(*) AS n, count(*) FILTER (WHERE vec_id % 10 = 3) AS n_zero FROM embeddings GROUP BY label", "embeddings")
def _(v):
    """Vectors written by corpus, one corpus replaced by itself; failed ones are zeros."""
    at = scratch(v.sparkSession)
    rows = v.select(F.col("label").alias("corpus_id"), "vec_id", F.when(F.col("vec_id") % 10 != 3, F.col("embedding")).alias("vector"))
    O.write_vectors(rows, at, dim=64)
    O.write_vectors(rows.filter("corpus_id = 1"), at, mode="overwrite", dim=64)
    zero = F.forall("vector", lambda x: x == 0)
    return v.sparkSession.read.parquet(at).groupBy("corpus_id").agg(F.count("*").alias("n"), F.count_if(zero).alias("n_zero"))


@_q("B11_notes", "SELECT s_suppkey, '---' || chr(10) || 'id: ' || s_suppkey || chr(10) || '---' || chr(10) || '# ' || s_name || chr(10) || 'body' AS note FROM supplier", "supplier")
def _(s):
    return s.select("s_suppkey", O.note_text(F.col("s_name"), {"id": F.col("s_suppkey")}, F.lit("body")).alias("note"))


@_q("B15_neutral_report", "SELECT doc_id, 'ok' AS qc_status, 0 AS n_flags, '' AS qc_notes FROM documents", "documents")
def _(d):
    return O.neutral_report(d, "doc_id")


@_q("B13_vectors", "SELECT vec_id, len(embedding) AS dim FROM embeddings", "embeddings")
def _(v):
    return v.select("vec_id", F.size(F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64))).cast("long").alias("dim"))


@_q("D33_N02_prompts", "SELECT conv_id, '## System' || chr(10) || 'be exact' || chr(10) || chr(10) || '## User' || chr(10) || left(string_agg(text, ' ' ORDER BY turn), 200) AS prompt FROM conversations GROUP BY conv_id", "conversations")
def _(c):
    # Turns that begin beyond the cap and the blank before them are in no prompt, so they are not gathered.
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = c.select("conv_id", "turn", F.substring("text", 1, 200).alias("text"), before.alias("before")).filter("before <= 200")
    t = near.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    return O.sections(t, {"System": (F.lit("be exact"), 48_000), "User": (F.col("text"), 200), "Schema": (F.lit(" "), 24_000)}).select("conv_id", "prompt")


@_q("D38_markdown_table", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region WHERE r_regionkey < 3", "region")
def _(r):
    return O.markdown_table(r.select("r_regionkey", "r_name").orderBy("r_regionkey"), columns=2)


@_q("D30_C29_json_rescue", """SELECT event_id, '{"k": ' || regexp_extract(props, '([0-9]+)', 1) || '}' AS json FROM events""", "events")
def _(e):
    answer = F.concat(F.lit("<think>{no}</think> Sure:\n```json\n"), "props", F.lit("\n```\nbye {"))
    return M.parse_answers(e.select("event_id", answer.alias("a")), "event_id", "a")


@_q("N01_preference_pairs", """SELECT 'p' || event_id AS prompt, props AS rejected, '{"k": "fixed"}' AS chosen FROM events""", "events")
def _(e):
    return M.preference_pairs(e.select(F.concat(F.lit("p"), "event_id").alias("prompt"), F.col("props").alias("raw"), F.lit("k").alias("field"), F.lit("fixed").alias("value")))


@_q("L08_J10_model_boundary", "SELECT conv_id, CAST(turn AS VARCHAR) || '/' || length(text) AS response FROM conversations", "conversations")
def _(c):
    asked = c.select("conv_id", F.concat_ws("/", F.col("turn").cast("string"), F.length("text").cast("string")).alias("p"))
    return M.call_model(asked, "conv_id", "p", lambda xs: xs).select("conv_id", "response")


@_q("D20_fuzzy_names", "SELECT 'The ' || s_name || ' Inc.' AS n, s_name AS match, 1.0::DOUBLE AS score FROM supplier", "supplier")
def _(s):
    names = s.select(F.concat(F.lit("The "), "s_name", F.lit(" Inc.")).alias("n"))
    return E.fuzzy_match(names, "n", s, "s_name")


@_q("D20_misspelt_names", "SELECT replace(s_name, 'pp', 'ppp') || ' Corp.' AS n, s_name AS match, round(2.0 * length(s_name) / (2 * length(s_name) + 1), 6) AS score FROM supplier", "supplier")
def _(s):
    """Names that hold no other and need a ratio; all share their word and most digits."""
    return E.fuzzy_match(s.select(F.concat(F.replace("s_name", F.lit("pp"), F.lit("ppp")), F.lit(" Corp.")).alias("n")), "n", s, "s_name")


@_q("M06_progress", "SELECT event_id AS seq, count(DISTINCT user_id) OVER (ORDER BY event_id) AS n_docs FROM events", "events")
def _(e):
    return progress(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq")), 10).select("seq", "n_docs")
