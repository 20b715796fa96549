"""Decisions about a run as Column expressions: gates, questions, consensus, what to do next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Autonomy levels at which each gate stops for the user.
GATES = {"schema": ("supervised", "semi", "researcher"), "flags": ("supervised",), "export": ("supervised", "semi")}
#: Thresholds of fill rates and of rows with flags or errors.
LOW_FILL, LOW_FIELDS, MANY_FLAGS, MOST_ERRORS, SOME_ERRORS = 0.55, 2, 0.4, 0.5, 0.25
#: Questions, the most urgent first; their place is their priority.
QUESTIONS = ("topology_failure", "zero_docs_parsed", "no_schema_columns", "fill_rate_below_threshold", "critique_flags_present")


def gates(level: Column) -> dict[str, Column]:
    """Whether each gate stops at this level of autonomy; an unknown or null level never does."""
    return {gate: F.coalesce(level.isin(*levels), F.lit(False)) for gate, levels in GATES.items()}


def question(level: Column, error: Column, n_rows: Column, extracted: Column, n_columns: Column, n_low: Column, n_deltas: Column) -> Column:
    """The most urgent open question, null for none: the first of QUESTIONS whose condition holds."""
    stop = gates(level)
    holds = (
        F.contains(F.lower(F.coalesce(error, F.lit(""))), F.lit("topology")),
        (n_rows == 0) & extracted,
        n_columns == 0,
        stop["flags"] & (n_low >= LOW_FIELDS),
        stop["export"] & (n_deltas > 0),
    )
    return F.coalesce(*[F.when(c, F.lit(q)) for q, c in zip(QUESTIONS, holds, strict=True)])


def next_action(n_columns: Column, approved: Column, n_rows: Column, n_errors: Column, n_flagged: Column, quality: Column, critiqued: Column) -> Column:
    """What a run should do next, the first that applies: a name for each case."""
    per = lambda n: n / F.greatest(n_rows, F.lit(1))
    flagged = per(n_flagged) > MANY_FLAGS
    return (
        F.when(n_columns == 0, "design_schema").when(~approved, "approve_schema").when(n_rows == 0, "start_extraction").when(per(n_errors) >= MOST_ERRORS, "fix_extraction")
        .when(flagged & (per(n_errors) >= SOME_ERRORS), "stabilise_model").when(flagged, "refine_schema").when(quality == "needs_work", "review_issues")
        .when(~critiqued, "wait_for_critique").otherwise("iterate_or_export")
    )


def consensus(model: Column, vote: Column, quality: Column) -> dict[str, Column]:
    """Agreement never above the vote's, and no "good" where fewer than half agree."""
    return {"agreement": F.least(model, vote), "quality": F.when((vote < 0.5) & (quality == "good"), "ok").otherwise(quality)}
