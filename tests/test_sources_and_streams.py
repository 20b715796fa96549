"""Files as sources, and streams that end with what a batch gives."""

import hashlib
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.events import sessions
from docweave.sources import files as A
from docweave.streaming import watch as W


def test_scan(spark, tmp_path):
    for p in ("acme/mda/2020/a.PDF", "acme/b.pdf", "c.pdf", "acme/x.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"%PDF" * (1 if p == "c.pdf" else 100))
    got = {r.filename: (r.company, r.doc_type, r.year) for r in A.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": ("acme", "mda", "2020"), "b.pdf": ("acme", "", ""), "c.pdf": ("", "", "")}
    assert A.scan_files(spark, str(tmp_path), least_bytes=100).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,\n2,x\n")
    assert [tuple(r) for r in A.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("1", ""), ("2", "x")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert A.read_log(spark, str(tmp_path / "l.jsonl"), schema).count() == 2
    assert A.read_parquet_or_empty(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "n.md").write_text('---\ntitle: "T"\nyear: 2020\n---\nBody\n')
    note = A.read_notes(spark, str(tmp_path / "n.md")).first()
    assert (note.front, note.body) == ({"title": "T", "year": "2020"}, "Body\n")


def test_signature(spark):
    for data in (b"", b"abc", bytes(range(256)) * 300):
        tail = data[-32768:] if len(data) > 65536 else b""
        expected = hashlib.sha256(b"n.pdf" + struct.pack("<q", len(data)) + data[:32768] + tail).hexdigest()[:16]
        df = spark.createDataFrame([("n.pdf", bytearray(data))], "n string, b binary")
        assert df.select(A.file_signature(F.col("n"), F.col("b")).alias("s")).first().s == expected


def test_stream_sessions_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    batch = sessions(events, "key", "ts", "6 hours")
    stream = W.debounced(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "6 hours", "0 seconds")
    q = stream.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    fired = {(r.key, r.started, r.n_events) for r in spark.table("fired").collect()}
    whole = {(r.key, r.started, r.n_events) for r in batch.collect()}
    assert fired
    assert fired <= whole  # sessions that the watermark has not passed are still open


def test_refresh_replaces_keys(spark, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    schema = "k string, v int"
    run = lambda: W.refresh(spark.readStream.schema(schema).json(src), table, str(tmp_path / "cp"), ["k"]).trigger(availableNow=True).start().awaitTermination(120)
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema).write.json(src)
    run()
    spark.createDataFrame([("a", 9)], schema).write.mode("append").json(src)
    run()
    assert sorted(map(tuple, W.current(spark, table).collect())) == [("a", 9), ("b", 3)]


def test_chain_runs_all_stages(spark, tmp_path):
    """Index, chunks and answers of a batch's documents only, then the panel of all."""
    from docweave.operators import chunking as C

    src, at = str(tmp_path / "src"), lambda x: str(tmp_path / x)
    schema = "doc_id long, text string"
    stages = [
        (at("index"), ["doc_id"], lambda d: d.select("doc_id", "text", F.length("text").alias("n"))),
        (at("chunks"), ["doc_id"], lambda d: C.chunk_documents(d)),
        (at("answers"), ["doc_id"], lambda c: c.groupBy("doc_id").agg(F.max("text").alias("last"), F.count("*").alias("n_chunks"))),
    ]
    panel = (at("panel"), lambda a: a.agg(F.count("*").alias("docs"), F.sum("n_chunks").alias("chunks")))
    run = lambda: W.refresh_chain(spark.readStream.schema(schema).json(src), at("cp"), stages, panel).trigger(availableNow=True).start().awaitTermination(120)
    spark.createDataFrame([(1, "a\nb"), (2, "c")], schema).write.json(src)
    run()
    assert tuple(spark.read.parquet(at("panel")).first()) == (2, 3)
    spark.createDataFrame([(1, "x\ny\nz"), (3, "d")], schema).write.mode("append").json(src)
    run()
    assert tuple(spark.read.parquet(at("panel")).first()) == (3, 5)
    assert sorted((r.doc_id, r.text) for r in W.current(spark, at("chunks")).collect()) == [(1, "x"), (1, "y"), (1, "z"), (2, "c"), (3, "d")]


def test_reader_never_sees_half_a_batch(spark, tmp_path):
    """A batch that fails after its data are written leaves the table as it was; a commit that is not whole does not count."""
    import os

    table = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k string, v int")
    W.merge_batch(df([("a", 1), ("a", 2), (None, 3), ("b", 4)]), table, ["k"], 4)
    before = sorted(map(str, W.current(spark, table).collect()))
    os.makedirs(f"{table}/commit-000000000002")
    df([("z", 9)]).write.parquet(f"{table}/data-half")
    assert sorted(map(str, W.current(spark, table).collect())) == before
    os.rmdir(f"{table}/commit-000000000002")
    old = W.current(spark, table)
    W.merge_batch(df([(None, 7), ("c", 8)]), table, ["k"], 4)
    W.merge_batch(df([(None, 7), ("c", 8)]), table, ["k"], 4)
    assert sorted(map(str, old.collect())) == before  # a reader of the earlier state
    assert sorted((r.k or "", r.v) for r in W.current(spark, table).collect()) == [("", 7), ("a", 1), ("a", 2), ("b", 4), ("c", 8)]
    assert W.totals(spark, table) == (4, 5)
    assert W.current(spark, str(tmp_path / "none")) is None
    assert W.totals(spark, str(tmp_path / "none")) == (0, 0)


def test_chain_signals(spark, sf):
    """Progress grows to all documents, the mark is told once, and the listener has seen every row."""
    from docweave.plans import more_queries as M

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    panel, signals = M.run_chain(docs, 5)
    progress = [x[1:] for x in signals.told if x[0] == "PARSE_PROGRESS"]
    assert progress == sorted(progress)
    assert progress[-1][0] == M.tagged_chunks(docs).select("doc_id").distinct().count()
    names = [x[0] for x in signals.told]
    assert names.count("EXTRACTION_READY") == 1
    assert names.count("QUEUE_GREW") == sum(n > M.READY_AT for n, _ in progress) - (signals.told[names.index("EXTRACTION_READY")][1] > M.READY_AT)
    assert sum(signals.intake) == docs.count()
    assert panel.count() == docs.select("source").distinct().count()


def test_file_events(spark, tmp_path):
    (tmp_path / "acme").mkdir()
    for n in ("a_en.pdf", "b-fr.pdf", "c.pdf"):
        (tmp_path / "acme" / n).write_bytes(b"x")
    q = W.file_events(spark, str(tmp_path)).select("key", "path").writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("files").collect()
    assert {r.key for r in got} == {"acme"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a_en.pdf", "c.pdf"]


def test_config(spark, tmp_path):
    from docweave.sources import config as K

    cfg = K.load_config('{"corpus_id": "c", "docs_dir": "/d", "run_id": "r", "other": 1}')
    assert cfg.chunks == "/d/.docweave/c/r/chunks"
    assert K.resolve("x/y", "/r", lambda p: True) == "/r/x/y"
    assert K.resolve("x/y", "/r", lambda p: False) == "x/y"
    (tmp_path / "a").mkdir()
    for n in "ab":
        (tmp_path / "a" / f"{n}.pdf").write_bytes(b"x")
    assert K.acquire(spark, "local_folder", str(tmp_path), 1).first().filename == "a.pdf"
    (tmp_path / "m.csv").write_text("doc_id\n1\n")
    assert K.scan(spark, K.CorpusConfig("c", "/d", pattern="csv_manifest", manifest=str(tmp_path / "m.csv"))).count() == 1


def test_live_state_folds_in_any_order(spark, tmp_path):
    """Null and empty values never win, a null run is a run, late events do not undo later ones, and the stream ends where the batch does."""
    from docweave.streaming import live_state as Z

    schema = "run string, seq long, rework boolean, " + ", ".join(f"{f} {t}" for f, t in Z.FIELDS.items())
    none = dict.fromkeys(Z.FIELDS)
    row = lambda run, seq, rework=None, **given: (run, seq, rework, *(none | given).values())
    rows = [row("a", 5, n_columns=3, quality=""), row("a", 1, n_columns=9, quality="ok", approved=False), row("a", 9, approved=True, rework=True), row("a", 7, approved=False, critique="t"), row(None, 1, n_rows=2), row(None, 2), row("c", 1)]
    df = spark.createDataFrame(rows, schema)
    batch = {r.run: tuple(r) for r in Z.live_state(df).collect()}
    assert batch["a"] == ("a", 3, True, None, None, None, "ok", "t", 1, 4)
    assert batch[None] == (None, None, None, 2, None, None, None, None, 0, 2)
    for k, part in enumerate((rows[:1] + rows[4:], rows[2:3], rows[1:2] + rows[3:4])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    merge = lambda b, k: W.merge_batch(b, str(tmp_path / "states"), ["run"], 4)
    Z.live_state_stream(stream).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    assert {r.run: tuple(r[c] for c in df.sparkSession.createDataFrame([], Z.SCHEMA).columns) for r in W.current(spark, str(tmp_path / "states")).collect()} == batch
    assert Z.with_action(Z.live_state(df.limit(0))).count() == 0
