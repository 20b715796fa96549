"""Small literal cases, held against worked-out results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docweave.functions import records as R
from docweave.functions import text as X
from docweave.operators import chunking as C
from docweave.operators import entities as E
from docweave.operators import events as V
from docweave.operators import export as O
from docweave.operators import external as M
from docweave.operators import quality as Q
from docweave.operators import retrieval as L
from docweave.operators import rollup as U
from docweave.operators import sampling as S
from docweave.plans import schema as P


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


# Text


def test_collapse(spark):
    assert one(spark, X.collapse(F.lit("  Hello   World\n"))) == "hello world"


@pytest.mark.parametrize(("quote", "source", "ok"), [("the quick brown", "See The  Quick brown fox", True), ("absent phrase", "See the fox", False), ("short", "short", False), ("a longer quote", "", False)])
def test_verified(spark, quote, source, ok):
    assert one(spark, Q.verified(F.lit(quote), F.lit(source))) is ok


def test_half_even_and_caps(spark):
    got = spark.createDataFrame([(1, 2), (None, None), (2, 0), (3, 3)], "s int, c int").select(R.adjusted(F.col("s"), F.col("c")).alias("a"), R.fuzzy(F.col("s"), F.col("c")).alias("f"), R.calibrated(F.col("s"), F.col("c")).alias("r")).collect()
    assert [r.a for r in got] == [1, 0, 0, 3]
    assert [r.f for r in got][::2] == [0.5, 0.0]
    assert [r.r for r in got][2:] == [0.05, 0.95]
    assert got[0].r == 0.75  # 1.5 rounds to the even 2


def test_profile_and_naics(spark):
    df = spark.createDataFrame([("",), ("12",), ("#123456789",), ("12345678901",)], "p string")
    assert [r.x for r in df.select(X.profile_number(F.col("p")).alias("x")).collect()] == ["", "000000012", "123456789", "12345678901"]
    assert [one(spark, X.naics_code(F.lit(x))) for x in ("212220 - Gold", "21", "000000", "")] == ["212220", "", "", ""]


def test_coercions(spark):
    assert [one(spark, R.to_int(F.lit(x))) for x in ("1,234", "3.9", "-3.9", "", "x")] == [1234, 3, -3, None, None]
    assert [one(spark, R.to_bool(F.lit(x))) for x in ("yes", "F", "")] == [True, False, False]


def test_sanitize(spark):
    assert one(spark, X.sanitize(F.lit("a\x00b \t c\n\n  \n d"))) == "ab c\nd"
    assert one(spark, X.sanitize(F.lit("abcdefgh"), 5)) == "abcd…"


def test_scope(spark):
    row = spark.createDataFrame([("TSX:ABC and CEO of XYZ 123456, esg 2019 to 2021",)], "t string").select(*[c.alias(k) for k, c in X.scope_of(F.col("t")).items()]).first()
    assert row.tickers == ["ABC", "XYZ"]
    assert row.profile_numbers == ["123456"]
    assert (row.date_from, row.date_to) == (2019, 2021)
    assert row.doc_types == ["ESG/Sustainability Report"]


# Chunks and retrieval


def test_split_prefix_is_maximal():
    text = " ".join(f"w{k}" for k in range(1000))
    head, tail = C.split_prefix(text, 100)
    assert C.estimate(head) <= 100
    assert C.estimate(f"{head} {tail.split()[0]}") > 100
    assert f"{head} {tail}" == text
    assert C.split_prefix("", 5) == ("", "")
    assert C.split_prefix("a b", 0) == ("", "a b")


def test_hard_split_is_lossless():
    text = "\n\n".join(["x " * 100, "y" * 500, "First one. Second one! " * 30])
    parts = C.hard_split(text, 120)
    assert all(len(p) <= 240 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_chunks_keep_all_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chunks = C.chunk_documents(docs, target=50)
    assert chunks.filter(F.col("num_tokens") > 50).count() == 0
    words = lambda df: df.agg(F.sum(F.size(X.words(F.col("text"))))).first()[0]
    assert words(chunks) == words(docs)
    assert chunks.select("chunk_id").distinct().count() == chunks.count()


def test_layout():
    items = [{"kind": "header", "level": 1, "text": "A"}, {"kind": "text", "text": "x", "page": 1}, {"kind": "header", "level": 2, "text": "B"}, {"kind": "table", "text": "| t |", "page": 2}, {"kind": "header", "level": 1, "text": "C"}, {"kind": "text", "text": "y"}]
    assert [(c["section_path"], c["text"], c["page_start"]) for c in C.walk_layout(items)] == [("A", "x", 1), ("A/B", "| t |", 2), ("C", "y", 0)]


def test_layout_json(spark):
    js = ['{"fallback": true, "sections": [{"path": "S", "texts": [{"text": "hello", "page_no": 3}]}]}', "broken", None]
    df = spark.createDataFrame(list(enumerate(js)), "id int, js string")
    assert [(r.doc_id, r.section_path, r.page_start, r.text) for r in C.chunk_layouts(df, "id", "js").collect()] == [(0, "S", 3, "hello")]


def test_weak_pool_gives_way(spark):
    rows = [("d", k, f"plain {k}", True) for k in range(3)] + [("d", 3, "needle here", False)]
    got = L.retrieve(spark.createDataFrame(rows, "doc_id string, ordinal int, text string, keyword_hit boolean"), {"needle": 1}, top_n=1).first()
    assert (got.ordinal, got.total, got.keyword_hits) == (3, 4, 3)


def test_retrieve_nothing(spark):
    empty = spark.createDataFrame([], "doc_id string, ordinal int, text string, keyword_hit boolean")
    assert L.retrieve(empty, {"a": 1}).count() == 0


def test_merge_blocks(spark):
    a = spark.createDataFrame([("d", "1", "first", 1), ("d", "2", "x", 2)], "doc_id string, chunk_id string, text string, rank int")
    b = spark.createDataFrame([("d", "1", "later", 1), ("d", "3", "y", 2), ("d", "", "z", 3)], a.schema)
    assert [(r.chunk_id, r.text) for r in L.merge_blocks([a, b], "doc_id", "chunk_id").orderBy("place").collect()] == [("1", "first"), ("2", "x"), ("3", "y")]
    assert L.merge_blocks([a, b], "doc_id", "chunk_id", 2).count() == 2


# Entities


def test_fuzzy(spark):
    names = spark.createDataFrame([("Acme Corp.",), ("Betta Mining Ltd",), ("Nothing like",)], "n string")
    dims = spark.createDataFrame([("ACME",), ("Beta Mining",), ("Zeta",)], "c string")
    got = {r.n: (r.match, r.score) for r in E.fuzzy_match(names, "n", dims, "c").collect()}
    assert got["Acme Corp."] == ("ACME", 1.0)
    assert got["Betta Mining Ltd"][0] == "Beta Mining"
    assert "Nothing like" not in got


def test_upsert_keeps_old(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    new = spark.createDataFrame([(1, " ", 2.0), (3, "c", None)], old.schema)
    assert sorted(map(tuple, E.upsert(old, new, "k").collect())) == [(1, "a", 2.0), (2, "b", None), (3, "c", None)]


def test_insert_absent_nulls(spark):
    old = spark.createDataFrame([("e", None)], "a string, b string")
    assert E.insert_absent(old, spark.createDataFrame([("e", None), ("e", None), ("f", None)], old.schema), ["a", "b"]).count() == 2


def test_contains_lookup(spark):
    rows = spark.createDataFrame([("the ACME holdings rose",), ("none",), (None,)], "t string")
    dim = spark.createDataFrame([("Acme Holdings", 7), ("Other Holdings", 8)], "n string, e int")
    assert sorted((r.t or "", r.entity_id) for r in E.contains_lookup(rows, "t", dim, "n", "e").collect()) == [("", None), ("none", None), ("the ACME holdings rose", 7)]


def test_resolve_within(spark):
    """Short queries, parts longer than a gram, the cut at 20 characters, nulls, and the first step wins."""
    q = spark.createDataFrame([("cnq",), ("International Mining of the North",), ("Inter",), ("no such firm",), ("",), (None,)], "q string")
    dim = spark.createDataFrame([("x CNQ y", 5), ("The International Mining Co", 7), ("International", 9), (None, 1)], "n string, e int")
    exact = spark.createDataFrame([("INTER", 3)], "n string, e int")
    got = {r.q: (r.entity_id, r.step) for r in E.resolve_chain(q, "q", [("exact", exact, "n", "e"), ("within", dim, "n", "e", (1, 20))]).collect()}
    none = (None, "unresolved")
    assert got == {"cnq": ("5", "within"), "International Mining of the North": ("7", "within"), "Inter": ("3", "exact"), "no such firm": none, "": none, None: none}
    short = {r.q: r.step for r in E.resolve_chain(q, "q", [("within", dim, "n", "e", (4, 20))]).collect()}
    assert short["cnq"] == "unresolved"
    assert short["Inter"] == "within"


# Events


def test_pending(spark):
    items = spark.createDataFrame([("a", "open"), ("b", "open"), ("c", "done")], "event_id string, status string")
    resolved = spark.createDataFrame([("a",)], "ref string")
    assert [r.event_id for r in V.pending(items, resolved, "event_id", "ref", "status", ["done"], [F.col("event_id")]).collect()] == ["b"]


def test_override_pairs_to_preferences(spark):
    log = spark.createDataFrame(
        [(1, "llm_extract", "r", "d", "h", "", ["c1"]), (2, "llm_extract", "r", "d", "other", "", ["c1"]), (3, "override", "r", "d", "h", "c1", []), (4, "override", "r", "x", "h", "", [])],
        "seq int, event_type string, run_id string, doc_id string, schema_hash string, chunk_id string, chunks array<string>",
    )
    assert [tuple(r) for r in V.pair_overrides(log).collect()] == [(3, 1)]
    assert M.splice('{"f": "wrong", "g": 1}', "f", "ok") == '{"f": "ok", "g": 1}'
    assert "parse_failed" in M.splice("broken", "f", "ok")


@pytest.mark.parametrize(("votes", "expected"), [(["ok"] * 3, 1.0), (["good", "ok", "ok"], 0.666667), (["good", "ok"], 0.5), (["bad"], 0.5)])
def test_votes(spark, votes, expected):
    df = spark.createDataFrame([("k", v) for v in votes], "k string, v string")
    assert U.vote_agreement(df, "k", "v", ["good", "ok", "needs_work"]).first().agreement == expected


def test_grounding(spark):
    cells = spark.createDataFrame([("d1", "c", "foo", "v", "not in there"), ("d1", "c", "bar", "w", "really is there")], "doc_id string, chunk_id string, field string, value string, quote string")
    chunks = spark.createDataFrame([("d1", "c", "It really  IS there.")], "doc_id string, chunk_id string, text string")
    got = {r.field: r for r in Q.ground(cells, chunks).collect()}
    assert (got["foo"].value, got["foo"].quote, got["foo"].failed) == ("v", None, True)
    assert (got["bar"].quote, got["bar"].failed) == ("really is there", False)
    assert [tuple(r) for r in Q.pressure(Q.ground(cells, chunks)).collect()] == [("d1", "foo", 1.0)]


def test_flat_pressure(spark):
    df = spark.createDataFrame([({"d1::foo": 2.5, "d2::bar": 1.0, "x": 1.0},)], "m map<string,double>")
    assert sorted(map(tuple, Q.field_pressure(df, "m").collect())) == [("d1", "foo", 2.5), ("d2", "bar", 1.0)]


def test_diversified_backfills(spark):
    df = spark.createDataFrame([(k, "a" if k < 5 else "b", k % 2) for k in range(6)], "k int, g string, s int")
    picks = S.diversified(df, "k", "g", [F.col("s").desc()], 5).orderBy("pick").collect()
    assert [r.k for r in picks] == [1, 3, 5, 0, 2]


def test_null_keys_drop_from_panel(spark):
    df = spark.createDataFrame([("a", 1, "2020-01-01", True), (None, 2, "2020-01-01", True)], "t string, v int, d string, f boolean")
    got = U.issuer_year(df, ["t"], {"v": F.col("v")}, {}, F.col("d"), F.col("f")).collect()
    assert [tuple(r) for r in got] == [("a", 1, "2020-01-01")]


def test_fingerprint_of_nothing(spark):
    assert U.fingerprint(spark.createDataFrame([], "s string"), F.col("s")).first().fingerprint == ""


# Models


def test_salvage():
    broken = '{"overall_quality": "needs_work", "field_issues": [{"field": "a", "issue": "x"}, {"field": "b", "iss'
    got = M.salvage_critique(broken)
    assert got == {"overall_quality": "needs_work", "field_issues": [{"field": "a", "issue": "x"}]}
    assert M.merge_critique({"overall_quality": "ok"}, got)["overall_quality"] == "ok"


def test_rescue():
    assert M.rescue_json('<think>{"a": 2}</think>```json\n{"a": 1}\n``` tail') == {"a": 1}
    assert M.rescue_json("nothing") is None


def test_model_failure_keeps_rows(spark):
    def bad(xs):
        raise ValueError("down")

    got = M.call_model(spark.createDataFrame([(1, "p")], "k int, p string"), "k", "p", bad).collect()
    assert [(r.k, r.response, r.error) for r in got] == [(1, None, "ValueError: down")]


def test_anneal():
    blocks = ["a" * k for k in range(5)]
    assert M.anneal(blocks, len, 0) == blocks
    assert sorted(M.anneal(blocks, lambda xs: len(xs[0]), 50)) == sorted(blocks)


# Schemas


def test_schema_helpers():
    col = {"name": "net_zero", "type": "string", "extraction_instruction": "Find the net zero target year"}
    assert P.query_string([col], override="  net zero 2050  ") == "net zero 2050"
    assert P.query_string([col]) == "Find the net zero target year"
    assert P.query_tokens([]) == ["document"]
    assert P.query_counts([col], "a b a") == {"a": 2, "b": 1}
    assert len(P.schema_hash([col])) == 12
    assert P.enrich([{"name": "total_x"}, "no"])[0]["value_cardinality"] == "combine_all_occurrences"
    assert ("supply_chain" in dict(P.keyword_rules("tariff on lumber"))) is True
    assert P.row_type([{"name": "a", "type": "integer|null"}]).simpleString() == "struct<a:bigint>"
    assert P.import_columns({"properties": {"a": {"type": "str", "enum": [1, 2]}}})[0]["extraction_instruction"] == "Allowed values: 1, 2."
    assert [c["name"] for c in P.draft_schema("tariff on lumber")][0] == "tariff_mention"
    assert [c["name"] for c in P.draft_schema("zzzz")] == ["relevant_passage", "context", "quantitative_value"]
    assert P.refinement_query([col], ["net_zero"], [], "t").startswith("Find the net zero")


def test_prompt_fit():
    render = lambda s, b: s["q"] + "".join(b)
    assert len(M.fit_prompt({"q": "?"}, ["x" * 900] * 20, 3000, render, len)) <= 3000
    assert M.fit_prompt({"q": "?"}, ["x" * 900], 50, render, len) == "?"
    assert C.truncate("a " * 100, 40).endswith("limit ...]")


def test_json_schema():
    js = P.json_schema([{"name": "a", "type": "integer|null"}])
    assert js["properties"]["a"]["type"] == ["integer", "null"]
    assert js["required"] == ["a", "a_evidence_quote", "a_evidence_pages"]


# Sinks


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "w", "q", ["a"])], "doc_id int, widget string, widget_evidence_quote string, extra array<string>")
    O.write_dataset(df, str(tmp_path / "csv"), ["doc_id"], ["widget"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["doc_id", "widget", "widget_evidence_quote", "extra"]
    assert back.first().extra == '["a"]'
    O.write_by_key(df, "widget", str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    vectors = spark.createDataFrame([("c", None), ("d", [1.0])], "corpus_id string, vector array<float>")
    O.write_vectors(vectors, str(tmp_path / "v"), "overwrite")
    O.write_vectors(vectors.filter("corpus_id = 'd'"), str(tmp_path / "v"), "overwrite")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_whole_tables(spark, sf):
    """Chunk queries over all documents, within the bounds of production, by brute force."""
    import re

    from docweave.operators.chunking import HARD_CHARS, text_chunks
    from docweave.plans import more_queries, retrieval_queries

    most, n = {}, {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        chunks = [c for block in (r.text or "").split("\n") for c in text_chunks(block)]
        assert all(len(c) <= HARD_CHARS for c in chunks)
        n[r.doc_id] = len(chunks)
        most[r.doc_id] = max((re.findall("[a-z0-9]+", c.lower()).count("from") for c in chunks), default=0)
    got = more_queries.QUERIES["L03_L13_refinement_all"][0](spark, sf).collect()
    assert {r.doc_id: r.most for r in got} == {k: v for k, v in most.items() if v}
    blocks = retrieval_queries.QUERIES["L01_L05_L06_L10_L17_K01_retrieval_bounded"][0](spark, sf).collect()
    assert {r.doc_id: r.total for r in blocks} == {k: v for k, v in n.items() if v}


def test_short_names_are_found(spark):
    from docweave.operators import entities

    rows = spark.createDataFrame([(1, "shares of acme rose"), (2, "Acme Holdings plc"), (3, "abc")], "k long, note string")
    names = spark.createDataFrame([("Acme", 7), ("Holdings plc", 5), ("abc", 1)], "name string, e long")
    got = {r.k: r.entity_id for r in entities.contains_lookup(rows, "note", names, "name", "e").collect()}
    assert got == {1: 7, 2: 5, 3: None}


def test_packed_chunks_by_brute_force(spark, sf):
    """Lines of each document packed at the limits of production, then cut at the hard limit."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = set()
    for r in docs.collect():
        held, out = [], []
        for line in filter(None, map(str.strip, (r.text or "").split("\n"))):
            if held and C.estimate("\n".join([*held, line])) > C.TARGET_TOKENS:
                out.append("\n".join(held))
                held = []
            held.append(line)
            while len(held) == 1 and C.estimate(held[0]) > C.TARGET_TOKENS:
                head, tail = C.split_prefix(held[0], C.TARGET_TOKENS)
                out.append(head)
                held = [tail] if tail else []
        out += ["\n".join(held)] if held else []
        expected |= {(r.doc_id, k, x) for k, x in enumerate(p for c in out for p in C.hard_split(c))}
    got = C.chunk_documents(docs, packed=True).collect()
    assert {(r.doc_id, r.ordinal, r.text) for r in got} == expected
    assert len(got) == len(expected)
    assert all(r.num_tokens <= C.TARGET_TOKENS and len(r.text) <= C.HARD_CHARS + 200 for r in got)


def test_native_and_python_chunks_agree(spark):
    texts = ["a b\n\n c  \n d e 　f\n", "", None, " \n \t", "one " * 50 + "\nshort", "x\x1cy\n\x85z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for target in (30, 1200):
        expected = {(i, k, c, C.estimate(c)) for i, t in enumerate(texts) for k, c in enumerate(c for x in (t or "").split("\n") for c in C.text_chunks(x, target))}
        got = {(r.doc_id, r.ordinal, r.text, r.num_tokens) for r in C.chunk_documents(df, target=target).collect()}
        assert got == expected


def test_hard_split_cases():
    assert C.hard_split("ab", 5) == ["ab"]
    assert C.hard_split("abc\n\ndef\n\ngh", 6) == ["abc\n\ndef", "gh"]
    assert C.hard_split("One. Two! " + "x" * 12, 6) == ["One.", "Two!", "xxxxxx", "xxxxxx"]
    assert C.hard_split(" " * 9, 4) == ["    "]
    assert [[k for k, _ in p] for p in C.pack(["a b", "c d", "e f g h i j", "k"], 4)] == [[0], [1], [2], [2], [3]]


def test_layout_packs_pages_and_boxes():
    items = [{"kind": "header", "level": 1, "text": "A"}, {"kind": "text", "text": "x", "page": 2, "box": [1]}, {"kind": "table", "rows": [["h", None], ["a|b", 1]], "page": 3, "box": [2]}, {"kind": "header", "level": 1, "text": "B"}, {"kind": "text", "text": "y"}]
    got = [(c["section_path"], c["text"], c["page_start"], c["page_end"], c["boxes"]) for c in C.walk_layout(items, packed=True)]
    assert got == [("A", "x\n| h |  |\n| --- | --- |\n| a\\|b | 1 |", 2, 3, [[1], [2]]), ("B", "y", 0, 0, [])]


def test_salvage_more():
    text = 'x {"field": "a", "n": {"field": "b"}} {"other": 1, "field": "c"} "overall_quality": "bad" "overall_quality": "GOOD", "overall_suggestion": "say \\"it\\"\\nnow"'
    got = M.salvage_critique(text)
    assert got == {"overall_quality": "good", "overall_suggestion": 'say "it"\nnow', "field_issues": [{"field": "a", "n": {"field": "b"}}, {"field": "b"}]}
    assert M.salvage_critique('"overall_suggestion": null') == {"overall_suggestion": ""}
    assert M.merge_critique({"field_issues": [], "overall_suggestion": " "}, got) == got
    assert M.rescue_json('[1, {"a": 2}]') == {}
    assert M.rescue_json('{broken {"a": 1}') == {"a": 1}


def test_fuzzy_with_a_word_that_all_share(spark):
    names = spark.createDataFrame([(f"supplier {k:03} x",) for k in range(60)] + [("supplier 007",)], "n string")
    dims = spark.createDataFrame([(f"Supplier {k:03} y",) for k in range(60)] + [("Supplier 007",)], "c string")
    got = {r.n: (r.match, r.score) for r in E.fuzzy_match(names, "n", dims, "c").collect()}
    assert got["supplier 007"] == ("Supplier 007", 1.0)
    assert all(got[f"supplier {k:03} x"][0] == f"Supplier {k:03} y" for k in range(60) if k != 7)


def _closest(spark, names, dims, least=0.72):
    """Every name against every candidate in order."""
    import difflib

    texts = spark.createDataFrame([(t,) for t in {*names, *dims}], "t string")
    plain = dict(texts.select("t", X.company_name(F.col("t"))).collect()).__getitem__
    known = [(c, plain(c)) for c in sorted(dims)]
    out = {}
    for n in set(names):
        q, best = plain(n), (None, 0.0)
        for c, p in known if q else []:
            r = 1.0 if p and (q in p or p in q) else difflib.SequenceMatcher(None, q, p).ratio() if p else 0.0
            best = max(best, (c, r), key=lambda x: x[1])
            if best[1] >= 0.99:
                break
        if best[1] >= least:
            out[n] = (best[0], round(best[1], 6))
    return out


def test_fuzzy_by_all_pairs(spark):
    """2,000 mixed names: misspelt, cut, swapped, of few letters, with a word that all share; equal to every name against every candidate."""
    import random

    rng = random.Random(4)
    letters = "eeaaiioonnrrttllssddcmuphgbfyvwkxjqz"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    dims = [" ".join([word().title() for _ in range(rng.randint(1, 3))] + rng.choice([[], ["Mining"], ["Mining", "Ltd."], ["Inc"]])) for _ in range(400)]
    dims += [f"Supplier#{k:05}" for k in range(100)] + ["X", "Q1", "Zed 9", "Acme Zlobel", "Ag", ""]
    names = ["Acme Globel Corp", "zed-9", "co", "", "x"]
    for _ in range(2000 - len(names)):
        t = list(rng.choice(dims) or word())
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            k, how = rng.randrange(len(t) + 1), rng.random()
            t[k : k + (how < 0.6)] = [] if how < 0.3 else [rng.choice(letters)]
        t = "".join(t)
        names.append(rng.choice([t, t, t.upper(), " ".join(reversed(t.split())), t[: rng.randint(1, 12)], " ".join(word() for _ in range(2))]))
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    got = {r.n: (r.match, r.score) for r in E.fuzzy_match(df, "n", spark.createDataFrame([(c,) for c in dims] + [(None,)], "c string"), "c").collect()}
    want = _closest(spark, names, dims)
    assert got == want
    assert sum(0.72 <= s < 1 for _, s in want.values()) > 200


def test_fuzzy_loses_nothing_as_candidates_grow(spark):
    """A match whose first word 1,200 other candidates share is found; few of all pairs are compared."""
    dims = spark.range(1200).select(F.format_string("acme %s", F.substring(F.md5(F.col("id").cast("string")), 1, 9)).alias("c")).union(spark.createDataFrame([("acme zlobel",)], "c string"))
    names = spark.createDataFrame([("acme globel corp",)], "n string")
    assert [tuple(r) for r in E.fuzzy_match(names, "n", dims, "c").collect()] == [("acme globel corp", "acme zlobel", round(20 / 22, 6))]
    s = spark.range(1000).select(F.format_string("supplier %09d", "id").alias("b_n"))
    asked = spark.range(1000).select(F.format_string("supplier %09dx", F.col("id") * 7).alias("a_n"))
    assert E.near_pairs(asked, s, 0.95).count() < 150_000  # of 1,000,000
    assert E.containing(asked, s).count() == 143


def test_override_pairs_by_brute_force(spark):
    import random

    rng, log = random.Random(5), []
    for k in range(300):
        kind = rng.choice(["override", "llm_extract", "other"])
        log.append((k, kind, rng.choice(["r", "s"]), rng.choice(["d", "e", None]), rng.choice(["", None, "h", "g"]), rng.choice(["", None, "a", "b"]), rng.choices(["a", "b", "c"], k=rng.randint(0, 3))))
    said = lambda x: bool((x or "").strip())
    expected = set()
    for o in log:
        found = [e[0] for e in log if o[1] == "override" and e[1] == "llm_extract" and e[0] < o[0] and e[2] == o[2] and e[3] is not None and e[3] == o[3]
                 and (not said(o[4]) or not said(e[4]) or o[4] == e[4]) and (not said(o[5]) or o[5] in e[6])]
        if found:
            expected.add((o[0], max(found)))
    df = spark.createDataFrame(log, "seq int, event_type string, run_id string, doc_id string, schema_hash string, chunk_id string, chunks array<string>")
    assert {tuple(r) for r in V.pair_overrides(df).collect()} == expected


def test_found_in(spark):
    cells = spark.createDataFrame([("d", "The  Quote"), ("d", "absent"), ("e", "")], "doc_id string, quote string")
    chunks = spark.createDataFrame([("d", 0, "nothing"), ("d", 1, "has the quote."), ("d", 2, "the quote")], "doc_id string, ordinal int, text string")
    assert {(r.doc_id, r.quote): r.found for r in Q.found_in(cells, chunks, "doc_id", "quote", "ordinal").collect()} == {("d", "The  Quote"): 1, ("d", "absent"): None, ("e", ""): None}


def test_progress_over_runs(spark):
    from docweave.streaming.watch import progress

    rows = [(f"d{k % 7}", k * 3) for k in range(50)]
    got = {r.seq: r.n_docs for r in progress(spark.createDataFrame(rows, "doc_id string, seq long"), 5, run_events=10).collect()}
    assert got == {s: min(k + 1, 7) for k, (_, s) in enumerate(rows)}


def test_schema_literals():
    """Schemas in three shapes, drafts, keywords, and queries of both hops."""
    shapes = [
        [{"name": "a", "type": "str", "enum": ["x", "y"]}, {"field": "b", "type": "int", "unit": "t"}, "no column"],
        {"columns": [{"name": "a", "type": "string", "description": "the first"}]},
        {"properties": {"a": {"type": "float"}, "b": {}}},
    ]
    got = [(k, c["name"], c["type"], c["extraction_instruction"]) for k, x in enumerate(shapes) for c in P.import_columns(x)]
    assert got == [(0, "a", "string", "Allowed values: x, y."), (0, "b", "integer", "Unit: t."), (1, "a", "string", "the first"), (2, "a", "number", ""), (2, "b", "string", "")]
    assert P.schema_hash([{"type": "string", "name": "a"}]) == hashlib.md5(b'[{"name": "a", "type": "string"}]').hexdigest()[:12]
    assert [c["name"] for c in P.draft_schema("tariff")] == ["tariff_mention", "affected_segment", "financial_impact", "management_response"]
    assert [",".join(P.ensure_keywords(c)) for c in ({"keywords": ["own"]}, {"description": "a remark"}, {"name": "net_zero_of"})] == ["own", "remark", "net,zero"]
    columns = [{"name": "net_zero", "type": "string", "keywords": ["net zero", "2050 target"], "extraction_instruction": "Find the target year"}, {"name": "plain", "description": "Any other remark"}]
    assert sorted(P.json_schema(columns)["required"]) == sorted(["net_zero", "net_zero_evidence_quote", "net_zero_evidence_pages", "plain", "plain_evidence_quote", "plain_evidence_pages"])
    assert sorted(P.query_tokens(columns)) == sorted(["net", "zero", "2050", "target", "any", "other", "remark"])
    assert P.query_string(columns, "mining") == "net zero 2050 target | plain | mining"
    assert P.refinement_query(columns, ["net_zero", "unknown"], [{"needs": "a source ", "summary": " "}, "no"]) == "net zero | 2050 target | Find the target year | a source"
    assert P.refinement_query(columns, [], []) == "net zero 2050 target | plain"
    assert P.unique(["b", "a", "b", "c", "a"]) == ["b", "a", "c"]


def test_config_and_folders(spark, sf):
    from docweave.sources import config as K
    from docweave.sources import files as A

    found = {r.filename for r in A.scan_files(spark, sf, suffix="parquet", least_bytes=1).select("filename").collect()}
    assert {"region.parquet", "nation.parquet"} <= found
    assert [r.filename for r in K.acquire(spark, "local_folder", sf, 3, suffix="parquet").collect()] == ["benchmark.parquet", "conversations.parquet", "customer.parquet"]
    c = K.load_config(json.dumps({"corpus_id": "c", "docs_dir": "/d/", "run_id": "r", "unknown": 1}))
    assert (c.index, K.resolve("x", "/r", lambda p: True)) == ("/d/.docweave/c/r/index", "/r/x")
