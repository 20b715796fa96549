"""Literal cases of registry tables, the council and event rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import events, external, quality
from docweave.sources import registry


def test_registry_holds_each_key_once(spark, tmp_path):
    at = str(tmp_path)
    assert registry.read_registry(spark, at, "jobs").count() == 0
    rows = spark.createDataFrame([("b", 2), ("a", 9), ("a", 3), (None, 1)], "job_id string, n_docs int")
    registry.register(rows.withColumn("other", F.lit("x")), at, "jobs")
    registry.register(rows, at, "jobs")
    found = {(r.job_id, r.n_docs, r.status, r.completed_at) for r in registry.read_registry(spark, at, "jobs").collect()}
    assert found == {("a", 3, "running", None), ("b", 2, "running", None), (None, 1, "running", None)}


@pytest.mark.parametrize("name", registry.COLUMNS)
def test_registry_defaults(spark, tmp_path, name):
    keys = registry.KEYS[name]
    registry.register(spark.createDataFrame([tuple("1" if k != "valid_from" else None for k in keys)], ", ".join(f"{k} string" for k in keys)), str(tmp_path), name)
    row = registry.read_registry(spark, str(tmp_path), name).first()
    assert all(row[c] == v for c, v in registry.DEFAULTS[name].items())


def test_council(spark):
    """Two lenses against one; an answer that is none; a chairman that fails, and one that claims too much."""
    asked = spark.createDataFrame([(1, "p"), (2, None)], "k int, p string")

    def review(prompts):
        return ['{"overall_quality": "OK", "field_issues": [{"field": "f", "issue": "i"}, {"field": ""}]}' if "skeptic" in p else '{"overall_quality": "good"}' if "literal" in p else "no" for p in prompts]

    def fails(prompts):
        raise RuntimeError("down")

    rows = external.council(asked, "k", "p", review, fails).orderBy("k").collect()
    assert [[(r.lens, r.quality, len(r.issues)) for r in x.reviews] for x in rows] == [[("literal_evidence", "good", 0), ("schema_coherence", "needs_work", 0), ("cross_sample_skeptic", "ok", 1)]] * 2
    assert [(x.quality, round(x.agreement, 3), x.suggestion) for x in rows] == [("needs_work", 0.333, "")] * 2
    seen = external.council(asked, "k", "p", lambda ps: ['{"overall_quality": "good"}'] * len(ps), lambda ps: ['{"overall_quality": "Good", "reviewer_agreement_score": 3, "overall_suggestion": "s"}'] * len(ps)).collect()
    assert [(x.quality, x.agreement, x.suggestion) for x in seen] == [("good", 1.0, "s")] * 2
    assert external.council(asked.limit(0), "k", "p", review, fails).count() == 0


def test_council_asks_once(spark, tmp_path):
    """Answers that differ from call to call: each reviewer is asked once a row, and the chairman judges what is returned."""
    log = tmp_path / "asked"

    def review(prompts):
        with open(log, "a") as f:
            f.writelines("review\n" for _ in prompts)
        return [json.dumps({"overall_quality": random.choice(["good", "ok", "needs_work"])}) for _ in prompts]

    def chairman(prompts):
        return [json.dumps({"overall_suggestion": p}) for p in prompts]

    asked = spark.createDataFrame([(k, "p") for k in range(40)], "k int, p string").repartition(4)
    rows = external.council(asked, "k", "p", review, chairman).collect()
    assert len(rows) == 40
    for r in rows:
        assert [x["quality"] for x in json.loads(r.suggestion)["reviews"]] == [x.quality for x in r.reviews]
    assert len(log.read_text().splitlines()) == 40 * len(external.LENSES)


def test_event_rows(spark):
    rows = spark.createDataFrame([(1, "r", list("ab") * 40, "x" * 9000), (2, " ", None, None), (3, "r", None, None)], "k int, run string, c array<string>, t string")
    given = {"doc_id": F.lit("d"), "retrieved_chunks": F.col("c"), "error": F.col("t")}
    got = events.event_rows(rows, "extraction_failed", F.col("run"), F.col("k"), given).collect()
    assert [(len(json.loads(r.state).get("retrieved_chunks", [])), len(json.loads(r.action).get("error", "")), r.reward_signal) for r in got] == [(64, 2000, None), (0, 0, None)]
    approved = events.event_rows(rows, "schema_update", F.lit("r"), F.col("k"), {"schema_hash": F.lit("h"), "approved": F.col("k") == 1})
    assert sorted(r.reward_signal or 0 for r in approved.collect()) == [0, 0, 1]
    assert len({r.event_id for r in approved.collect()}) == 3


def test_topology_and_feedback(spark, tmp_path):
    columns = spark.createDataFrame([("a", 1, "y", []), ("a", 0, "x", None), ("b", 0, "x", ["k"]), ("d", 0, "x", ["k"])], "corpus string, place int, name string, keywords array<string>")
    rows = [("b", k, k < 5, ["s"] if k == 11 else None) for k in range(12)] + [("c", k, None, ["s"] if k == 10 else []) for k in range(5)]
    entities = spark.createDataFrame(rows, "corpus string, k int, done boolean, sources array<string>")
    got = {r.corpus: (r.broken, r.column, r.n_entities, r.n_done) for r in quality.topology(columns, entities, [F.col("k")]).collect()}
    assert got == {"a": ("keywords", "x", 0, 0), "b": ("acquired", None, 12, 5), "c": ("sources", None, 5, 0), "d": (None, None, 0, 0)}
    assert events.read_feedback(spark, "merge", str(tmp_path)).count() == 0
