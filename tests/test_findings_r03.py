"""What the third round found, on small tables."""

import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docweave.functions import text as X
from docweave.operators import chunking as C
from docweave.operators import entities as E
from docweave.operators import export as O
from docweave.operators import payloads as Y
from docweave.operators import postings as I
from docweave.operators import retrieval as L
from docweave.sources.files import read_notes
from docweave.streaming import live_state as Z


def rows_of(spark, name, folder, *tables):
    """The rows of a query, and those of its SQL."""
    df = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'").fetchall()
    res = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    return sorted(tuple(r[c] for c in names) for r in df.collect()), sorted(res.fetchall())


def test_topics_as_the_sql_matches_them(spark, tmp_path):
    """Patterns meet RE2, as in DuckDB: a dot is a carriage return too."""
    texts = ["trade\rwar", "cash\u2028flow", "cap.rate", "Net\nzero", None, ""]
    pq.write_table(pa.table({"doc_id": range(6), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got, want = rows_of(spark, "D11_topics", tmp_path, "documents")
    assert [x for x in got if x[0] < 4] == [x for x in want if x[0] < 4]
    assert got[0][1].startswith("trade_tariff") and got[4:] == [(4, ""), (5, "")]


def test_labels_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Straße\nTRADE\twar"), (4, "trade war, ore")], "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", X.labels(F.col("t"), [("b", "war"), ("a", "stra"), ("b", "ore")]).alias("a"), X.topics(F.col("t")).alias("b")).collect()}
    assert got == {1: ([], []), 2: ([], []), 3: (["a", "b"], ["trade_tariff"]), 4: (["b"], ["trade_tariff", "mining_resources"])}


def test_embedding_of_a_long_text(spark):
    """Tokens are counted once, not once for each pair of dimensions."""
    docs = spark.range(8).repartition(8).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda x: F.concat(F.lit("w"), x % 97)), " ").alias("t"))
    start = time.perf_counter()
    e = docs.select(L.hashing_embedding(F.col("t")).alias("e")).select(F.size("e").alias("n"), F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v).alias("s")).collect()
    assert time.perf_counter() - start < 20
    assert all(r.n == 16 and abs(r.s - 1) < 1e-9 for r in e)
    assert spark.range(1).select(L.hashing_embedding(F.lit(" ")).alias("e")).first().e == [0.0] * 16


def test_codes_of_late_customers(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": [1, 7, 787_779, 787_780, 787_781, 900_000]}), tmp_path / "customer.parquet")
    got, want = rows_of(spark, "D28_D29_codes", tmp_path, "customer")
    assert got == want and any(len(r[1]) == 7 for r in got)


def test_block_merge_of_equal_lines(spark, tmp_path):
    """Of equal lines the first in the file counts."""
    n = 5_000
    supp = [(i * 7919) % 100_003 for i in range(4 * n)]
    t = pa.table({"l_partkey": [i % n for i in range(4 * n)], "l_orderkey": [2 * (i % n) for i in range(4 * n)], "l_linenumber": pa.array([1] * 4 * n, pa.int32()), "l_suppkey": supp})
    pq.write_table(t, tmp_path / "lineitem.parquet", row_group_size=1_000_000)
    got, want = rows_of(spark, "H10_block_merge", tmp_path, "lineitem")
    assert got == want == [(i, supp[i]) for i in range(n)]


def test_lookup_in_long_texts(spark):
    """Parts of a text are taken in one pass, not each from its start: before, 600,000 characters took minutes."""
    rows = spark.range(8).repartition(8).select("id", F.concat(F.repeat(F.lit("some words é of a text 😀 "), 25_000), F.when(F.col("id") % 2 == 0, F.lit("the Acme Holdings of Here")).otherwise("acme"), F.lit(" end")).alias("t"))
    dim = spark.createDataFrame([("acme holdings of here", 7), ("Acme Holdings of There", 1), ("nowhere", 2), ("of a", 5), ("é", 9)], "n string, e int")
    start = time.perf_counter()
    got = {r.id: r.entity_id for r in E.contains_lookup(rows, "t", dim, "n", "e", gram=20).select("id", "entity_id").collect()}
    assert time.perf_counter() - start < 30
    assert got == {k: 5 for k in range(8)}
    got = {r.id: r.entity_id for r in E.contains_lookup(rows, "t", dim.filter("e <> 5"), "n", "e", gram=20).select("id", "entity_id").collect()}
    assert got == {k: 7 if k % 2 == 0 else None for k in range(8)}


def test_index_of_what_is_asked(spark):
    """Postings of asked terms only, the same as those of the whole index; documents without a query keep their sizes."""
    chunks = spark.createDataFrame([(1, 0, "a b a", True), (1, 1, "c", False), (1, 2, None, None), (2, 0, "a d d", True), (3, 0, "a", True)], "doc_id long, ordinal int, text string, keyword_hit boolean")
    queries = spark.createDataFrame([(1, "a", 2), (1, "c", 1), (1, "x", 1), (2, "d", 1)], "doc_id long, term string, times long")
    postings, sizes = I.index_for(chunks, queries)
    whole, every = I.index_chunks(chunks)
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(sizes) == key(every)
    assert key(postings) == key(whole.join(queries.drop("times"), ["doc_id", "term"]))
    assert key(I.score_by_query(postings, sizes, queries)) == key(I.score_by_query(whole, every, queries))


def test_slices_of_batches():
    """Python holds the pieces of a few texts at a time, not those of a whole batch."""
    import pandas as pd

    b = pd.DataFrame({"doc_id": range(150), "text": ["x"] * 150})
    got = list(C.slices(iter([b, b.iloc[:0]])))
    assert [len(x) for x in got] == [64, 64, 22] and list(pd.concat(got).doc_id) == list(range(150))


def test_chunks_in_one_pass(spark, tmp_path):
    """Texts are read once and lines part in Arrow; before, short and long ones were two scans, and Java met each line and rule."""
    texts = [" a b\x85\n\n\u3000\n\tThe Licence\u2028x \r\n" + "w " * 900, None, "", "with\nx" * 70, "\x1c" + "one. two! " * 400 + "\nthing", "thingy \U0001f600 é\n otros"]
    pq.write_table(pa.table({"doc_id": range(6), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    docs, rules = spark.read.parquet(str(tmp_path / "documents.parquet")), [("a", "licen[cs]e"), ("b", X.whole_word("thing|otros"))]
    for target, hard in ((1200, 6000), (50, 300)):
        got = C.chunk_documents(docs, target=target, hard=hard, rules=rules)
        assert got._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
        want = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(c for x in (t or "").split("\n") if x.strip() for c in C.text_chunks(x.strip(), target, hard))]
        rows = got.collect()
        assert sorted((r.doc_id, r.ordinal, r.text) for r in rows) == want
        assert all(r.num_tokens == C.estimate(r.text) for r in rows)
        assert all(r.keyword_hit == any(x in f" {r.text.lower()} " for x in ("licence", " thing ", " otros ")) for r in rows)
        packed = C.chunk_documents(docs, target=target, hard=hard, packed=True, rules=rules)
        assert packed.columns == got.columns and packed.count() <= len(rows)


def test_many_notes(spark, tmp_path):
    """Tasks share notes by number and write the files themselves; before, one task made each file and folder by processes of its own."""
    df = spark.range(3_000).select(F.format_string("Note %d/", "id").alias("n"), F.concat(F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\n---\n# é")).alias("t"))
    odd = spark.createDataFrame([("_x", "one"), ("_x", None), (None, "two"), (".y", "three")], "n string, t string")
    at = str(tmp_path / "notes")
    O.write_notes(df, "n", "t", at)
    start = time.perf_counter()
    O.write_notes(df.union(odd), "n", "t", at)
    assert time.perf_counter() - start < 10
    got = read_notes(spark, at).select("path", F.col("front")["id"].alias("id"), "body").collect()
    assert len(got) == 3_003 == len({r.path for r in got})
    assert {int(r.id) for r in got if r.id} == set(range(3_000)) and all(r.body.strip() == "# é" for r in got if r.id)
    assert sorted(tuple(sorted(r.body.split("\n"))) for r in got if not r.id) == [("", "", "one"), ("", "three"), ("", "two")]


def test_names_by_what_is_left(spark):
    """Misspelt names meet the few that they can be; before, the pairs of 4,000 names that share most letters were more than 100 a name."""
    b = spark.range(4_000).select(F.format_string("supplier %09d", F.col("id") * 7).alias("b_n"))
    a = spark.range(4_000).select(F.format_string("suppplier %09d", F.col("id") * 7).alias("a_n"))
    assert E.close_pairs(a, b, 0.95).count() < 40_000
    names = ["abcdefghij" * 3, "abcdefghij" * 2 + "abcdefghi", "", "a", "ab", "xabcdefghijklmnopqrs", "abcdefghijklmnopqrs", "abcdefghijklmnopqrsy", "abcdefgijklmnopqrsty", "😀bcdefghijklmnopqrs"]
    a, b = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c in ("a_n", "b_n"))
    import difflib

    for least in (0.95, 0.9, 0.8, 0.72):
        want = {(x, y) for x in names for y in names if x and y and difflib.SequenceMatcher(None, y, x).ratio() >= least}
        assert {(r.a_n, r.b_n) for r in E.ratios(E.close_pairs(a, b, least), least).collect()} - {("", "")} == want


def test_parts_that_begin_alike(spark):
    """Queries meet names on their rarest part; before, those that begin alike met every name."""
    names = spark.range(3_000).select(F.format_string("SUPPLIER#%09d", "id").alias("v"), F.col("id").cast("string").alias("entity_id"))
    q = spark.range(3_000).select(F.format_string("plier#%09d", "id").alias("q"), F.format_string("PLIER#%09d", "id").alias("u"))
    assert {(r.q, int(r.entity_id)) for r in E._holding(q, names, 4, 20).collect()} == {(f"plier#{k:09}", k) for k in range(3_000)}
    assert E.within(q.select("u"), "u", names.select("v"), "v", 8).count() == 3_000


def test_stream_state_stays_in_spark(spark, tmp_path):
    """Events are combined before they are shuffled; before, each run's events went to Python in a group of their own."""
    schema = "run string, seq long, rework boolean, " + ", ".join(f"{f} {t}" for f, t in Z.FIELDS.items())
    plan = Z.live_state_stream(spark.readStream.schema(schema).parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "PandasWithState" not in plan and "Aggregate" in plan


def test_walks_in_one_pass(spark):
    """Blocks are made once and lists of lengths walk; before, they were made for the walk and for the join with it."""
    rows = [(i, r + 1, "x" * (37 * i * (r + 3) % 900)) for i in range(20) for r in range(9)] + [(None, 1, "x"), (None, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, rank int, text string")
    out = L.annealed(df, 40, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    got = {(r.doc_id, r.rank): r.text for r in out.collect()}
    assert len(got) == len(rows)
    for i in range(20):
        texts = [t for k, _, t in rows if k == i]
        assert [got[i, k + 1] for k in range(9)] == [texts[j] for j in L.annealed_order([len(t) for t in texts], 40, f"3/{i}")]


def test_payload_is_read_once(spark):
    """A payload is parsed once for all its columns and a value's kind is told once; before, each use in each column did both anew."""
    rows = spark.range(5).select("id", F.format_string('{"macro_evidence": ["q%d", {"quote": 1}], "uncertainty_language": ["may"], "mentions_tariffs": "yes"}', "id").alias("payload"))
    out = Y.repair_payloads(rows, "id", "payload")
    plan = out.select("id", "macro_evidence", "other_tariff_mentions", "mentions_tariffs")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1
    assert plan.count("schemaofvariant") + plan.count("schema_of_variant") < 20
    got = {r.id: ([tuple(x) for x in r.macro_evidence], r.other_tariff_mentions, r.mentions_tariffs) for r in out.collect()}
    assert got == {k: ([(f"q{k}", "OTHER", None), ("1", "OTHER", None)], ["may"], True) for k in range(5)}
