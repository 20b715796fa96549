"""Payload repair on VARIANT columns against a plain version."""

import json
import random

from docweave.functions import records as R
from docweave.operators import payloads as Y

MEMBERS = {"earnings_evidence": Y.SIGNALS, "macro_evidence": R.ENUMS["macro"][0], "supply_chain_evidence": R.ENUMS["supply_chain"][0]}


def truth(v):
    return v.strip().lower() in Y.TRUE if isinstance(v, str) else bool(v)


def plain(text):
    try:
        p = json.loads(text)
    except (TypeError, ValueError):
        p = {}
    p = p if isinstance(p, dict) else {}
    say = lambda x: json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False) if isinstance(x, (list, dict)) else str(x)
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    out = {}
    for name, (what, default) in Y.EVIDENCE.items():
        rows = []
        for x in many(p.get(name)):
            if isinstance(x, str) and x.strip(" "):
                rows.append((x, default, None))
            elif isinstance(x, dict):
                k = say(x.get(what, default)).strip(" ").upper().replace(" ", "_")
                rows.append((say(x.get("quote", "")), k if k in MEMBERS[name] else default, x.get("magnitude_text")))
        out[name] = rows
    strings = lambda v: [t for t in (say(x).strip(" ") for x in many(v)) if t]
    mentions, doubt = strings(p.get("other_tariff_mentions")), p.get("uncertainty_language")
    if isinstance(doubt, list):
        words = [x.strip(" ") for x in doubt if isinstance(x, str) and x.strip(" ")]
        out["uncertainty_language"] = bool(words) or True in [x for x in doubt if isinstance(x, bool)]
        for w in words:
            mentions += [] if w in mentions else [w]
    else:
        out["uncertainty_language"] = truth(doubt)
    out["other_tariff_mentions"], out["specific_tariff_programs"] = mentions, strings(p.get("specific_tariff_programs"))
    return out | {f: truth(p[f]) if f in p else None for f in Y.FLAGS}


def value(rng, depth=0):
    some = [None, True, False, 0, 7, -3, "", " ", "yes", "No", "1", "may ", "é…"]
    if depth < 2 and rng.random() < 0.5:
        if rng.random() < 0.5:
            return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
        keys = ["quote", "signal_type", "macro_type", "chain_type", "magnitude_text"]
        return {k: rng.choice(["q", "cost increase", "OTHER", "logistics ", "x"]) for k in rng.sample(keys, rng.randint(0, 5))}
    return rng.choice(some)


def test_payloads(spark):
    rng, rows = random.Random(12), []
    names = [*Y.EVIDENCE, "other_tariff_mentions", "uncertainty_language", "specific_tariff_programs", *Y.FLAGS]
    for k in range(400):
        rows.append((k, json.dumps({n: value(rng) for n in rng.sample(names, rng.randint(0, len(names)))}, ensure_ascii=False)))
    rows += [(400, None), (401, ""), (402, "no json"), (403, "[1, 2]"), (404, '"text"'), (405, "null"), (406, '{"macro_evidence": {"quote": null, "macro_type": null}}')]
    df = spark.createDataFrame(rows, "k long, payload string").repartition(3)
    out = Y.repair_payloads(df, "k", "payload")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: {n: [tuple(x) for x in r[n]] if n in Y.EVIDENCE else r[n] for n in names} for r in out.collect()}
    want = {k: plain(t) for k, t in rows}
    for k, t in rows:
        assert got[k] == want[k], t


def test_critiques(spark):
    """Whole, cut, empty and odd answers; the same whether Spark reads them or Python has to."""
    from docweave.operators import external as M

    issue = {"field": "a", "issue": "i", "severity": "low", "suggestion": "s", "suggested_call_config_delta": {"top_k": 3}, "config_rationale": "why"}
    whole = json.dumps({"overall_quality": "good", "overall_suggestion": "do", "field_issues": [issue, {"field": ""}, "x", {"field": "b"}]})
    rows = [(1, whole), (2, f"<think>{{}}</think>```json\n{whole}\n```"), (3, whole[:-30]), (4, None), (5, " \n"), (6, "prose"), (7, '{"other": 1}'), (8, '{"overall_quality": "ODD"}'), (9, '{"field_issues": []}'), (10, "p" * 90_000)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r for r in M.apply_critiques(df, "k", "t").collect()}
    for k in (1, 2):
        r = got[k]
        assert (r.quality, r.parse_ok, r.critique) == ("good", True, "do\n  [LOW] a: s\n  [MEDIUM] b: ")
        assert [tuple(x) for x in r.issues] == [("a", "i", "low", "s"), ("b", "", "medium", "")]
        assert [tuple(x) for x in r.deltas] == [("a", '{"top_k":3}', "why")]
    assert (got[3].quality, got[3].parse_ok, [x.field for x in got[3].issues]) == ("good", True, ["a"])
    assert [(got[k].quality, got[k].parse_ok, got[k].critique) for k in (4, 5)] == [("needs_work", False, M.NO_CONTENT)] * 2
    assert [(got[k].quality, got[k].parse_ok, got[k].critique) for k in (6, 7, 9)] == [("needs_work", False, t) for t in ("prose", '{"other": 1}', '{"field_issues": []}')]
    assert (got[8].quality, got[8].parse_ok, got[8].critique) == ("ok", True, M.NO_ISSUES)
    assert len(got[10].critique) == 80_000 - 20 + len(M.RAW_NOTE)
    assert M.apply_critiques(df.limit(0), "k", "t").count() == 0
