"""Live state of a run, folded from its events: by grouped maxima, in a batch and in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.policy import next_action

#: What a run's state holds, by kind: the last value that an event gave and that says something.
FIELDS = {"n_columns": "long", "approved": "boolean", "n_rows": "long", "n_errors": "long", "n_flagged": "long", "quality": "string", "critique": "string"}
SCHEMA = "run string, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items()) + ", rework_count long, n_events long"


def live_state(events: DataFrame) -> DataFrame:
    """The state of every run after all its events (run, seq, rework, and the FIELDS, null where an event says nothing).

    Later values win (by seq, unique in a run); null and empty ones never do. Everything is combined before the shuffle.
    A null run is a run of its own.
    """
    says = lambda f: F.col(f).isNotNull() & (F.col(f) != "" if FIELDS[f] == "string" else F.lit(True))
    last = [F.max_by(f, F.when(says(f), F.col("seq"))).alias(f) for f in FIELDS]
    return events.groupBy("run").agg(*last, F.count_if(F.coalesce("rework", F.lit(False))).alias("rework_count"), F.count("*").alias("n_events"))


def live_state_stream(events: DataFrame) -> DataFrame:
    """A stream of ``events``: the state of every run that a batch touches, as live_state() has it so far.

    The last values, each with its seq, and the counts are what Spark keeps of a run: of fixed size, however
    many events it has, and events may come out of order. A batch is combined before the shuffle.
    """
    return live_state(events)


def with_action(states: DataFrame) -> DataFrame:
    """``states`` with action: what the run should do next."""
    of = lambda f: F.coalesce(f, F.lit(0))
    return states.withColumn("action", next_action(of("n_columns"), F.coalesce("approved", F.lit(False)), of("n_rows"), of("n_errors"), of("n_flagged"), F.coalesce("quality", F.lit("")), F.coalesce("critique", F.lit("")) != ""))
