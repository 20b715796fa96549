"""Event logs: as-of pairing, pending work, compaction, training records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.export import append_log
from docweave.sources.files import read_log


def latest_before(events: DataFrame, keys: list[str], order: list[Column], is_source: Column, payload: list[str], is_target: Column) -> DataFrame:
    """As-of join backward: each target event with the last source event before it of the same keys.

    One sort by key instead of a range join: the last source is carried along the window, so an
    event costs the same however many came before it. Adds prev_<column>, null where none came.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(is_source, F.struct(*payload)), ignorenulls=True).over(before)
    out = events.withColumn("__prev", carried).filter(is_target)
    return out.select(*events.columns, *[F.col(f"__prev.{c}").alias(f"prev_{c}") for c in payload])


def pair_overrides(events: DataFrame) -> DataFrame:
    """Each override with the latest earlier extract of its run and document whose schema hash agrees.

    ``events``: seq, event_type, run_id, doc_id, schema_hash, chunk_id, chunks (array). Hashes are
    compared only where both are known, and an override's chunk, if named, must be among the
    extract's. An extract stands under its own hash and under any, and under each of its chunks
    and any; an override looks under its hash and under extracts of none. So each lookup is the
    last extract before it of equal keys, carried along one window: no pairs are made.
    """
    known = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c))
    h, c = known("schema_hash"), known("chunk_id")
    key = lambda tag, value: F.concat(F.lit(tag), value)
    none, any_ = F.lit("-"), F.lit("*")
    extract = F.col("event_type") == "llm_extract"
    hashes = F.when(extract, F.array(F.coalesce(key("=", h), none), any_)).otherwise(F.when(h.isNull(), F.array(any_)).otherwise(F.array(key("=", h), none)))
    chunks = F.when(extract, F.concat(F.array(any_), F.transform(F.array_distinct(F.coalesce("chunks", F.array().cast("array<string>"))), lambda x: key("=", x)))).otherwise(F.array(F.coalesce(key("=", c), any_)))
    rows = events.filter("event_type IN ('override', 'llm_extract')").select("run_id", "doc_id", "seq", extract.alias("extract"), F.explode(hashes).alias("h"), chunks.alias("cs"))
    rows = rows.select("run_id", "doc_id", "seq", "extract", "h", F.explode("cs").alias("c")).filter("run_id IS NOT NULL AND doc_id IS NOT NULL")
    before = Window.partitionBy("run_id", "doc_id", "h", "c").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("extract"), F.col("seq")), ignorenulls=True).over(before)
    found = rows.withColumn("extract_seq", last).filter("NOT extract AND extract_seq IS NOT NULL")
    return found.groupBy(F.col("seq").alias("override_seq")).agg(F.max("extract_seq").alias("extract_seq"))


def pending(items: DataFrame, resolved: DataFrame, key: str, ref: str, status: str, done: list[str], order: list[Column], n: int | None = None) -> DataFrame:
    """Items that nothing resolved and whose status is open; with n, the last n of them in order."""
    left = items.filter(~F.coalesce(F.col(status), F.lit("")).isin(done)).join(resolved.select(F.col(ref).alias(key)).distinct(), key, "left_anti")
    return left if n is None else left.orderBy(*[c.desc() for c in order]).limit(n)


def merge_state(events: DataFrame, keys: list[str], state: str, order: list[Column]) -> DataFrame:
    """Later keys of a map win, blank values never do: one map a key."""
    blank = events.select(*keys, F.explode(state).alias("k", "v"), F.struct(*order).alias("o")).filter(F.trim("v") != "")
    last = blank.groupBy(*keys, "k").agg(F.max_by("v", "o").alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(state))


def apply_edits(base: DataFrame, edits: DataFrame, keys: list[str], value: str, new: str, order: list[Column]) -> DataFrame:
    """The last edit of each cell over its value; adds edited."""
    last = edits.groupBy(*keys).agg(F.max_by(new, F.struct(*order)).alias("__new"), F.lit(True).alias("__e"))
    return base.join(last, keys, "left").select(*[F.coalesce(F.col("__new"), F.col(c)).alias(c) if c == value else F.col(c) for c in base.columns], F.coalesce("__e", F.lit(False)).alias("edited"))


def sessions(events: DataFrame, key: str, ts: str, quiet: str) -> DataFrame:
    """Per-key debounce: runs of events with no gap of ``quiet`` or more; works on streams with a watermark too."""
    return events.groupBy(F.col(key), F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n_events")


def coverage(entities: DataFrame, types: DataFrame, years: tuple[int, int], found: DataFrame) -> DataFrame:
    """Every entity, type and year with whether ``found`` (entity, type, year) has it.

    The grid is asked for as such; entities are exploded over the few types and years in place,
    and meet what was found in one equi-join.
    """
    kinds = types.agg(F.array_sort(F.collect_set("type")).alias("t"))
    grid = entities.join(F.broadcast(kinds)).select("entity", F.explode("t").alias("type")).select("entity", "type", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))).alias("year"))
    have = found.select("entity", "type", "year").distinct().withColumn("have", F.lit(True))
    return grid.join(have, ["entity", "type", "year"], "left").withColumn("have", F.coalesce("have", F.lit(False)))


#: What each event of a run says of its state and its action, and the most characters or items of each.
SHAPES = {
    "llm_extract": (
        {"doc_id": None, "retrieved_chunks": 64, "retrieved_chunk_hashes": 64, "schema_hash": None, "schema_iteration": None},
        {"llm_raw_output": 32000, "reasoning_trace": 16000, "system_prompt": 96000, "user_prompt": 96000, "schema_json": 96000},
    ),
    "extraction_failed": ({"doc_id": None, "retrieved_chunks": 64, "schema_hash": None}, {"error": 2000}),
    "human_override": ({"doc_id": None, "field_name": None, "schema_hash": None, "chunk_id": None}, {"proposed_value": None, "override_value": None, "override_reason": 4000, "evidence_quote": 4000, "evidence_pages": None}),
    "schema_update": ({"schema_hash": None, "column_count": None}, {"schema_hash": None, "approved": None, "user_feedback": 8000}),
    "chat_correction": ({"schema_hash": None}, {"user_text": 8000, "assistant_text": 8000}),
    "schema_iteration": ({"schema_iteration": None, "dataset_name": None}, {"approved": None, "user_feedback": 8000, "user_query": 4000, "column_count": None}),
    "merge_decision": ({"doc_id": None, "field_name": None}, {"chosen_value": None, "choice_reason": 4000, "conflicting_values": 50}),
}
_LISTS = ("retrieved_chunks", "retrieved_chunk_hashes", "conflicting_values")
#: Events whose approval is a reward, and the event of each level of feedback.
_REWARDED = ("schema_update", "schema_iteration")
LEVELS = {"schema": "schema_iteration", "extraction": "human_override", "merge": "merge_decision"}


def event_rows(rows: DataFrame, kind: str, run: Column, key: Column, given: dict[str, Column]) -> DataFrame:
    """event_id, run_id, event_type, state, action (JSON), reward_signal, a row per row of ``rows``; blank run ids drop out.

    ``given`` has the values by name, lists as arrays; a null or missing one is left out. Ids
    follow from run, kind and key, so a job that runs again writes the same. An approved schema
    is rewarded with 1.
    """

    def json_of(fields: dict[str, int | None]) -> Column:
        cut = lambda name, most: F.slice(given[name], 1, most) if name in _LISTS else F.substring(given[name], 1, most)
        return F.to_json(F.struct(F.lit(None).cast("string").alias("__none"), *[(cut(n, most) if most else given[n]).alias(n) for n, most in fields.items() if n in given]))

    state, action = SHAPES[kind]
    name = F.concat(F.lit("evt_"), F.substring(F.md5(F.concat_ws("/", run, F.lit(kind), key.cast("string"))), 1, 12))
    reward = F.when(given["approved"], F.lit(1.0)) if kind in _REWARDED and "approved" in given else F.lit(None).cast("double")
    out = rows.select(name.alias("event_id"), F.trim(run).alias("run_id"), F.lit(kind).alias("event_type"), json_of(state).alias("state"), json_of(action).alias("action"), reward.alias("reward_signal"))
    return out.filter("run_id <> ''")


def log_feedback(rows: DataFrame, level: str, run: Column, key: Column, given: dict[str, Column], folder: str) -> None:
    """Append the feedback of a level, one of LEVELS, to the level's own log in ``folder``."""
    append_log(event_rows(rows, LEVELS[level], run, key, given).withColumn("level", F.lit(level)), f"{folder}/{level}")


def read_feedback(spark: SparkSession, level: str, folder: str) -> DataFrame:
    """A level's feedback, malformed lines skipped; without rows where none was logged."""
    schema = T.StructType.fromDDL("event_id string, run_id string, event_type string, state string, action string, reward_signal double, level string")
    try:
        return read_log(spark, f"{folder}/{level}", schema).filter("event_id IS NOT NULL")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
