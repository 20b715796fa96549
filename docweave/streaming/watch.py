"""Watching a folder: file events, a debounce per key, and an incremental refresh per batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from docweave.sources.files import filename_locale

QUIET = "15 seconds"
#: A session fires once the watermark has passed its end; events later than this are dropped.
LATE = "1 minute"


def file_events(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """A stream of new files: key (first folder below), path, ts; those whose names mark another language than English drop out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(folder)
    base = folder.rstrip("/").split("://")[-1]
    rel = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(base + "/"), F.lit(r"\E")), 2), -1)
    kept = raw.filter(F.coalesce(filename_locale(F.col("path")), F.lit("en")) == "en")
    return kept.select(F.split(rel, "/")[0].alias("key"), "path", F.col("modificationTime").alias("ts"))


def debounced(events: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """One row a key and burst of events, once nothing has come for ``quiet``: key, started, fires, n_events."""
    w = F.session_window("ts", quiet)
    out = events.withWatermark("ts", late).groupBy("key", w.alias("w")).agg(F.count("*").alias("n_events"))
    return out.select("key", F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n_events")


#: Parts of a refreshed table; a batch rewrites those that its keys fall into.
BUCKETS = 64
_COMMIT = "bucket int, path string, n_rows long, n_keys long"


def _commit(spark: SparkSession, table: str) -> tuple[int, list]:
    """Number and rows (a part each) of the table's last commit; 0 and none if there is none."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/commit-*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    last = max((f.getPath().getParent().getName() for f in found or []), default=None)
    return (int(last.removeprefix("commit-")), spark.read.schema(_COMMIT).parquet(f"{table}/{last}").collect()) if last else (0, [])


def merge_batch(batch: DataFrame, table: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Replace the rows of the batch's keys in a table that is parted by a hash of the keys.

    Only the parts that hold such keys are read and written anew, into a folder of their own. A
    commit then names the folder of every part; it counts once it is whole, so a reader sees the
    table before or after the batch, never between, and a failure leaves it as it was. A batch that is
    run again gives the same table. One writer at a time; folders that no commit names any more can
    be removed. Null keys are keys.
    """
    spark = batch.sparkSession
    new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        hit = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        if not hit:
            return
        number, parts = _commit(spark, table)
        old = _read(spark, [r for r in parts if r.bucket in hit])
        folder = f"{table}/data-{uuid.uuid4().hex}"
        out = new
        if old is not None:
            gone = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
            on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            out = old.join(gone, on, "left_anti").unionByName(new, allowMissingColumns=True)
        out.write.partitionBy("bucket").parquet(folder)
        key = F.struct(*keys)
        fresh = spark.read.schema(out.schema).parquet(folder).groupBy("bucket").agg(F.count("*").alias("n_rows"), F.count_distinct(F.to_json(key)).alias("n_keys")).collect()
        rows = [r for r in parts if r.bucket not in hit] + [(r.bucket, folder, r.n_rows, r.n_keys) for r in fresh]
        spark.createDataFrame([tuple(r) for r in rows], _COMMIT).coalesce(1).write.parquet(f"{table}/commit-{number + 1:012}")
    finally:
        new.unpersist()


def _read(spark: SparkSession, parts: list) -> DataFrame | None:
    by: dict[str, list[int]] = {}
    for r in parts:
        by.setdefault(r.path, []).append(r.bucket)
    frames = [spark.read.parquet(path).filter(F.col("bucket").isin(some)) for path, some in by.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of the table's last commit; None if there is none."""
    found = _read(spark, _commit(spark, table)[1])
    return None if found is None else found.drop("bucket")


def totals(spark: SparkSession, table: str) -> tuple[int, int]:
    """Keys and rows of the table as its last commit counts them; nothing else is read."""
    parts = _commit(spark, table)[1]
    return sum(r.n_keys for r in parts), sum(r.n_rows for r in parts)


def refresh(stream: DataFrame, table: str, checkpoint: str, keys: list[str], derive: Callable[[DataFrame], DataFrame] = lambda d: d):
    """Start a query that replaces, batch by batch, the rows of each key in a refreshed table."""
    return stream.writeStream.foreachBatch(lambda batch, k: merge_batch(derive(batch), table, keys)).option("checkpointLocation", checkpoint)


class Signals(StreamingQueryListener):
    """What a running chain tells: (signal, documents, chunks) in ``told``, and the rows of each batch in ``intake``.

    PARSE_PROGRESS after every batch that brought chunks, EXTRACTION_READY once when ``ready_at``
    documents have chunks, QUEUE_GREW at each further batch. The intake is what the query itself
    observes (``observed``); add the object to spark.streams to receive it.
    """

    NAME = "intake"

    def __init__(self, ready_at: int) -> None:
        self.ready_at, self.told, self.intake, self.before = ready_at, [], [], 0

    def observed(self, stream: DataFrame) -> DataFrame:
        return stream.observe(self.NAME, F.count(F.lit(1)).alias("n"))

    def after(self, n_docs: int, n_chunks: int) -> None:
        self.told.append(("PARSE_PROGRESS", n_docs, n_chunks))
        if self.before < self.ready_at <= n_docs:
            self.told.append(("EXTRACTION_READY", n_docs, n_chunks))
        elif n_docs > self.ready_at:
            self.told.append(("QUEUE_GREW", n_docs, n_chunks))
        self.before = n_docs

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if found := event.progress.observedMetrics.get(self.NAME):
            self.intake.append(found.n)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def refresh_chain(
    stream: DataFrame,
    checkpoint: str,
    stages: list[tuple[str, list[str], Callable[[DataFrame], DataFrame]]],
    panel: tuple[str, Callable[[DataFrame], DataFrame]] | None = None,
    signals: Signals | None = None,
    counted: str | None = None,
    buckets: int = BUCKETS,
):
    """Start a query that runs each batch through all stages: (table, keys, derive), index, chunks, answers and so on.

    A stage derives its rows from those of the stage before, for the batch's keys only, and merges
    them into its table; rows of those keys that it no longer derives stay until they are derived
    anew. A stage may read the current() rows of an earlier table, to derive what stands for keys
    beyond the batch. After the last, ``panel`` (path, build) is rebuilt from the whole of the last table, if
    given. ``signals`` hears the keys and rows of the table ``counted`` after each batch.
    """

    def run(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        held = [rows]
        try:
            for table, keys, derive in stages:
                rows = derive(rows).persist()
                held.append(rows)
                merge_batch(rows, table, keys, buckets)
            whole = current(spark, stages[-1][0])
            if panel is not None and whole is not None:
                panel[1](whole).write.mode("overwrite").parquet(panel[0])
            if signals is not None:
                signals.after(*totals(spark, counted or stages[-1][0]))
        finally:
            for x in held:
                x.unpersist()

    return (stream if signals is None else signals.observed(stream)).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


#: Events of a run within which marks are summed by one task.
RUN_EVENTS = 10_000


def progress(events: DataFrame, ready_at: int, run_events: int = RUN_EVENTS) -> DataFrame:
    """Documents seen so far at each event, and whether the ready mark is reached there: seq, n_docs, ready.

    A document counts at its first event only, so the running count is a sum of marks: within
    runs of ``run_events`` numbers, and over the list of runs.
    """
    from pyspark.sql import Window

    first = events.groupBy("doc_id").agg(F.min("seq").alias("seq")).withColumn("new", F.lit(1))
    marked = events.join(first, ["doc_id", "seq"], "left").select("seq", F.coalesce("new", F.lit(0)).alias("new"), F.floor(F.col("seq") / run_events).alias("run"))
    runs = marked.groupBy("run").agg(F.sum("new").alias("n"))
    before = runs.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = F.sum("new").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = marked.withColumn("n", n).join(before, "run")
    return counted.select("seq", (F.col("n") + F.col("before")).alias("n_docs")).withColumn("ready", F.col("n_docs") >= ready_at)
