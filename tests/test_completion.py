"""Artefacts compared by set digests, and reports on runs in every state."""

import random

from docweave.operators import completion as Y


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "doc_id string").repartition(3)


def test_unmatched(spark):
    rng = random.Random(1)
    a = [f"d{k}" for k in range(500)] + [None, ""]
    b = [x for x in a if x != "d7"] + ["e1", "e1"]
    rng.shuffle(b)
    got = sorted(map(tuple, Y.unmatched(ids(spark, a), ids(spark, b), "doc_id", 16).collect()))
    assert got == [("d7", "a"), ("e1", "b")]
    assert Y.unmatched(ids(spark, a), ids(spark, a[::-1]), "doc_id").count() == 0
    assert Y.unmatched(ids(spark, a), ids(spark, a + ["d7"]), "doc_id").count() == 0  # repeats are no difference
    assert sorted(Y.unmatched(ids(spark, [None]), ids(spark, [""]), "doc_id").collect(), key=str) == [("", "b"), (None, "a")]
    assert Y.unmatched(ids(spark, a), ids(spark, []), "doc_id").count() == len(a)


def test_digests_tell_nothing_of_the_order(spark):
    one, two = ([tuple(r) for r in Y.set_digests(ids(spark, x), "doc_id", 8).orderBy("bucket").collect()] for x in ([f"d{k}" for k in range(100)], [f"d{99 - k}" for k in range(100)]))
    assert one == two
    assert len(one) <= 8


def test_states_of_a_run(spark):
    docs = ids(spark, ["a", "b", "c"])
    parsed = lambda *s: spark.createDataFrame(list(zip("abc", s, strict=False)), "doc_id string, status string")
    rest = {"chunks": docs, "chunk_answers": docs, "answers": docs, "panel": docs}
    state = lambda **parts: Y.assess(**parts).first()
    r = state(index=docs, parses=parsed("OK", "OK_LEAN", " PDF_MISSING "), **rest)
    assert (r.ok, r.parsed, r.messages) == (True, True, ["complete"])
    r = state(index=docs, parses=parsed("OK", "ERROR", None), **rest)
    assert (r.ok, r.n_errors, r.messages) == (False, 1, ["1 parses failed"])  # an empty status is no error
    r = state(index=docs, parses=parsed("OK", "OK"), **rest)
    assert (r.ok, r.n_missing, r.messages) == (False, 1, ["1 documents are not parsed", "parses: 2 rows for 3 documents"])
    r = state(index=docs, parses=parsed("OK", "OK", "OK"), **rest, review_required=True)
    assert (r.ok, r.has_review, r.messages) == (False, False, ["no review"])
    r = state(index=docs, parses=parsed("OK", "OK", "OK"), **rest | {"answers": docs.limit(1)})
    assert (r.ok, r.aligned, r.messages) == (False, False, ["answers: 1 rows for 3 documents"])
    r = state(index=docs)
    assert (r.ok, r.n_missing, r.messages) == (False, 3, [f"no {x}" for x in Y.ARTEFACTS])
    r = state(index=docs.limit(0))
    assert (r.ok, r.parsed, r.messages) == (True, True, ["nothing to process"])
    r = state(index=None, parses=parsed("OK", "OK", "OK"))
    assert (r.ok, r.messages) == (False, ["no index"])


def test_summary_of_no_rows(spark):
    rows = spark.createDataFrame([], "q string, q_evidence_quote string, _flag_parse_error boolean, _extraction_error string")
    assert set(Y.consistency_summary(rows, {"q": None}).first()) == {0}
    one = rows.union(spark.createDataFrame([("x", None, None, None), (None, "a long quote", True, "e")], rows.schema))
    r = Y.consistency_summary(one, {"q": None}).first()
    assert (r.closure_violated, r.closure_skipped, r.parse_errors, r.verified, r.all_default) == (1, 1, 1, 1, 1)
