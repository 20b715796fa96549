"""The boundary to models: deterministic stand-ins, and repair of what models return."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.policy import consensus
from docweave.operators.payloads import given as _given
from docweave.operators.payloads import said as _said
from docweave.sources.scratch import cut

_THINK = re.compile(r"<(think|thinking|redacted_thinking)>.*?</\1>", re.I | re.S)
_FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$", re.I | re.M)
_DECODE = json.JSONDecoder()


def call_model(rows: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """key, response, error: the model asked batch by batch; a failure fills error and loses no row.

    Filter rows before the call: Spark cannot move a filter across it.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                try:
                    said, wrong = model(list(part.prompt)), None
                except Exception as e:  # the model is outside; the row says what went wrong
                    said, wrong = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"key": part.key, "response": said, "error": wrong})

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")).mapInPandas(asked, f"key {kind}, response string, error string")
    return out.withColumnRenamed("key", key)


def objects(text: str) -> Iterator[object]:
    """JSON values that open with a brace or bracket and decode, from left to right, those inside others too."""
    at = -1
    while (at := min((k for k in (text.find("{", at + 1), text.find("[", at + 1)) if k >= 0), default=-1)) >= 0:
        with contextlib.suppress(ValueError):
            yield _DECODE.raw_decode(text, at)[0]


def rescue_json(text: str) -> dict | None:
    """The first JSON value of a model's answer, think blocks and fences aside; {} if it is no object, None without one."""
    bare = _FENCE.sub("", _THINK.sub("", text or "").strip()).strip()
    first = next(objects(bare), None)
    return first if isinstance(first, dict) else {} if first is not None or _is_json(bare) else None


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


#: What a critique may say of the whole.
VERDICTS = ("good", "ok", "needs_work")
_SAID = re.compile(r'"overall_(quality|suggestion)"\s*:\s*(null|"(?:[^"\\]|\\.)*")', re.I | re.S)
_ESCAPED = {r"\n": "\n", r"\"": '"', r"\\": "\\"}


def salvage_critique(text: str) -> dict:
    """Quality, whole issues and suggestion out of a critique whose JSON is broken.

    An issue is an object whose first key is field, wherever it stands; what is cut off drops
    out. Of the two remarks, the first that can be one counts; null is an empty suggestion.
    """
    out: dict = {}
    for name, said in _SAID.findall(text):
        value = "" if said == "null" else re.sub(r'\\[n"\\]', lambda m: _ESCAPED[m[0]], said[1:-1])
        if name == "suggestion":
            out.setdefault("overall_suggestion", value)
        elif value.lower() in VERDICTS:
            out.setdefault("overall_quality", value.lower())
    issues = [x for x in objects(text) if isinstance(x, dict) and next(iter(x), "") == "field" and x["field"]]
    return out | ({"field_issues": issues} if issues else {})


#: What stands in a critique, by key: a salvaged value takes its place where it does not stand.
_STANDS = {
    "overall_quality": lambda c: "overall_quality" in c,
    "overall_suggestion": lambda c: bool(str(c.get("overall_suggestion") or "").strip()),
    "field_issues": lambda c: isinstance(c.get("field_issues"), list) and bool(c["field_issues"]),
}


def merge_critique(first: dict, salvage: dict) -> dict:
    """What the first lacks, from the salvage."""
    return first | {k: salvage[k] for k, stands in _STANDS.items() if salvage.get(k) is not None and not stands(first)}


#: What a critique says where it holds no issue, where nothing came, and the most characters of raw text that are kept.
NO_ISSUES, NO_CONTENT, RAW_CHARS, RAW_NOTE = "No issues detected.", "Critique returned no content from the model.", 80_000, "\n… [truncated]"
_ISSUE = "array<struct<field:string,issue:string,severity:string,suggestion:string,config_delta:string,config_rationale:string>>"


def apply_critiques(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, quality, critique, parse_ok, issues (field, issue, severity, suggestion) and deltas (field, config_delta as JSON, config_rationale) of each answer.

    Answers that are one whole JSON object with quality, suggestion and issues are read by Spark;
    the others go through rescue and salvage in Python first. An answer that names neither quality nor
    issues is no critique: it needs work, and its text stands as it is. A quality that is none of
    VERDICTS is ok, an issue without a field drops out, severity is medium if not given.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""))
    raw = F.when(F.length(bare) > RAW_CHARS, F.concat(F.substring(bare, 1, RAW_CHARS - 20), F.lit(RAW_NOTE))).otherwise(bare)
    said = rows.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), raw.alias("raw"))
    v = F.try_parse_json("t")
    issues = F.try_variant_get(v, "$.field_issues", "array<variant>")
    whole = F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, "$.overall_quality", "string").isNotNull() & (F.trim(F.try_variant_get(v, "$.overall_suggestion", "string")) != "") & (F.size(issues) > 0)
    said = said.withColumn("whole", F.coalesce(whole, F.lit(False)))

    def mended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(t=[_mended(t) for t in b.t])

    kind = rows.schema[key].dataType.simpleString()
    rest = said.filter("NOT whole").drop("whole").mapInPandas(mended, f"k {kind}, t string, raw string")
    metas = said.filter("whole").drop("whole").unionByName(rest).withColumn("v", F.try_parse_json("t"))
    part = lambda x, path: F.try_variant_get(x, path, "variant")
    of = lambda x, path, other: F.when(part(x, path).isNull(), F.lit(other)).otherwise(_said(part(x, path)))
    listed = F.filter(F.coalesce(F.try_variant_get("v", "$.field_issues", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT") & _given(part(x, "$.field")))
    delta = lambda x: F.when(F.schema_of_variant(part(x, "$.suggested_call_config_delta")).startswith("OBJECT<") & (F.to_json(part(x, "$.suggested_call_config_delta")) != "{}"), F.to_json(part(x, "$.suggested_call_config_delta")))
    made = F.transform(
        listed,
        lambda x: F.struct(of(x, "$.field", "").alias("field"), of(x, "$.issue", "").alias("issue"), of(x, "$.severity", "medium").alias("severity"), of(x, "$.suggestion", "").alias("suggestion"), delta(x).alias("config_delta"), of(x, "$.config_rationale", "").alias("config_rationale")),
    )
    ok = part(F.col("v"), "$.overall_quality").isNotNull() | (F.size(F.try_variant_get("v", "$.field_issues", "array<variant>")) > 0)
    quality = F.lower(of(F.col("v"), "$.overall_quality", "ok"))
    hint = F.trim(F.when(_given(part(F.col("v"), "$.overall_suggestion")), _said(part(F.col("v"), "$.overall_suggestion"))).otherwise(""))
    out = metas.select("k", "raw", (F.coalesce(ok, F.lit(False)) & (F.col("raw") != "")).alias("parse_ok"), quality.alias("q"), hint.alias("hint"), made.cast(_ISSUE).alias("i"))
    lines = F.transform("i", lambda x: F.concat(F.lit("  ["), F.upper(x["severity"]), F.lit("] "), x["field"], F.lit(": "), x["suggestion"]))
    told = F.when(F.size("i") > 0, F.concat_ws("\n", F.col("hint"), F.array_join(lines, "\n"))).otherwise(F.when(F.col("hint") != "", F.col("hint")).otherwise(NO_ISSUES))
    none = F.array().cast(_ISSUE)
    kept = F.when(F.col("parse_ok"), F.col("i")).otherwise(none)
    return out.select(
        F.col("k").alias(key), F.when(~F.col("parse_ok"), "needs_work").when(F.col("q").isin(*VERDICTS), F.col("q")).otherwise("ok").alias("quality"),
        F.when(F.col("parse_ok"), told).when(F.col("raw") == "", NO_CONTENT).otherwise(F.col("raw")).alias("critique"), "parse_ok",
        F.transform(kept, lambda x: F.struct(x["field"].alias("field"), x["issue"].alias("issue"), x["severity"].alias("severity"), x["suggestion"].alias("suggestion"))).alias("issues"),
        F.transform(F.filter(kept, lambda x: x["config_delta"].isNotNull()), lambda x: F.struct(x["field"].alias("field"), x["config_delta"].alias("config_delta"), x["config_rationale"].alias("config_rationale"))).alias("deltas"),
    )


def _mended(text: str) -> str | None:
    """The critique in an answer as JSON: what decodes, with what salvage finds in its place; null if neither is one."""
    first, more = rescue_json(text) or {}, salvage_critique(text)
    is_one = lambda c: "overall_quality" in c or (isinstance(c.get("field_issues"), list) and bool(c["field_issues"]))
    meta = merge_critique(first, more) if first and more else first if is_one(first) or not is_one(more) else more
    return json.dumps(meta, ensure_ascii=False) if is_one(meta) else None


#: The reviewers of a council, in order, and what each looks at.
LENSES = {
    "literal_evidence": "Judge whether each value stands in the quoted text.",
    "schema_coherence": "Judge whether names, types and instructions of the columns fit the sample.",
    "cross_sample_skeptic": "Judge whether the rows contradict each other.",
}
_REVIEW = "overall_quality string, overall_suggestion string, field_issues array<struct<field:string,issue:string>>"


def council(rows: DataFrame, key: str, prompt: str, reviewer: Callable[[list[str]], list[str]], chairman: Callable[[list[str]], list[str]]) -> DataFrame:
    """key, quality, agreement, suggestion, reviews (lens, quality, issues; in the order of LENSES) of each row's critique.

    ``key`` is unique. Every lens reviews every prompt, then the chairman sees a key's reviews as
    JSON. Reviews are kept before they are read twice, so every reviewer is asked once. A review that is no JSON says needs_work and has no issues; one without a quality says
    ok. The chairman's agreement is 0.7 if not given and never above the vote's; without a usable
    answer the reviews' most frequent quality counts, the worse of equal ones.
    """
    reviews = []
    for place, (lens, role) in enumerate(LENSES.items()):
        asked = rows.select(key, F.concat(F.coalesce(F.col(prompt), F.lit("")), F.lit(f"\n\n## Reviewer: {lens}\n{role}")).alias("p"))
        reviews.append(call_model(asked, key, "p", reviewer).select(key, F.lit(place).alias("place"), F.lit(lens).alias("lens"), "response"))
    # Text that is no JSON object leaves all fields null, so a review is told from none by its braces being whole.
    said = F.from_json("response", _REVIEW)
    whole = F.get_json_object("response", "$").startswith("{")
    quality = F.when(~F.coalesce(whole, F.lit(False)), "needs_work").otherwise(F.coalesce(F.lower(said["overall_quality"]), F.lit("ok")))
    issues = F.filter(F.coalesce(said["field_issues"], F.array().cast("array<struct<field:string,issue:string>>")), lambda x: x["field"] != "")
    each = reduce(DataFrame.unionByName, reviews).select(key, F.struct("place", "lens", quality.alias("quality"), issues.alias("issues")).alias("r"))
    traces = each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r.dropFields("place")).alias("reviews"))
    times = lambda v: F.size(F.filter("reviews", lambda r: r["quality"] == v))
    # The worse of equal verdicts is the greater, as VERDICTS goes from good to bad.
    top = F.array_max(F.array(*[F.struct(times(v).alias("n"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(VERDICTS)]))
    valid = reduce(lambda a, b: a + b, map(times, VERDICTS))
    voted = cut(traces).withColumns({"vote": F.when(valid > 0, top["n"] / valid).otherwise(0.5), "modal": F.when(valid > 0, top["v"]).otherwise("ok")})
    final = call_model(voted.select(key, F.to_json(F.struct("reviews", "vote")).alias("p")), key, "p", chairman)
    final = final.select(key, F.from_json("response", "overall_quality string, overall_suggestion string, reviewer_agreement_score double").alias("f"))
    own = F.lower("f.overall_quality")
    end = consensus(F.coalesce("f.reviewer_agreement_score", F.lit(0.7)), F.col("vote"), F.when(own.isin(*VERDICTS), own).otherwise(F.col("modal")))
    return voted.join(final, key).select(key, end["quality"].alias("quality"), end["agreement"].alias("agreement"), F.coalesce("f.overall_suggestion", F.lit("")).alias("suggestion"), "reviews")


def splice(rejected: str | None, field: str, value: object) -> str:
    """The rejected answer with one field replaced; a note where that cannot be."""
    try:
        data = json.loads(rejected or "")
    except ValueError:
        data = None
    if isinstance(data, dict) and field in data:
        return json.dumps(data | {field: value}, ensure_ascii=False)
    return json.dumps({"_note": "parse_failed", "field": field, "override": value, "raw_tail": (rejected or "")[:2000]}, ensure_ascii=False)


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """prompt, rejected, chosen from rows of prompt, raw, field, value."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"prompt": b.prompt, "rejected": b.raw, "chosen": [splice(*x) for x in zip(b.raw, b.field, b.value, strict=True)]})

    return pairs.select("prompt", "raw", "field", "value").mapInPandas(made, "prompt string, rejected string, chosen string")


def parse_answers(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """key, json: the rescued object as canonical JSON, null where there is none."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [rescue_json(t) for t in b.answer]
            yield pd.DataFrame({"key": b.key, "json": [None if f is None else json.dumps(f, sort_keys=True, ensure_ascii=False) for f in found]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(answer).alias("answer")).mapInPandas(parsed, f"key {kind}, json string").withColumnRenamed("key", key)


def fit_prompt(sections: dict[str, str], blocks: list[str], budget: int, render: Callable[[dict[str, str], list[str]], str], estimate: Callable[[str], int]) -> str:
    """The fullest prompt within the budget: fewer blocks first, from 12 to 1, each cut from 700 characters down to 120."""
    for n in range(min(12, len(blocks)), 0, -1):
        for chars in (700, 500, 350, 240, 120):
            text = render(sections, [b[:chars] for b in blocks[:n]])
            if estimate(text) <= budget:
                return text
    return render(sections, [])


def anneal(items: list, cost: Callable[[list], float], steps: int, seed: int = 0) -> list:
    """A seeded reordering that swaps toward lower cost; no steps, no change."""
    import math
    import random

    rng, now, best = random.Random(seed), list(items), list(items)
    for k in range(steps if len(items) > 1 else 0):
        i, j = rng.sample(range(len(now)), 2)
        new = list(now)
        new[i], new[j] = new[j], new[i]
        heat = 1 - k / steps
        if (d := cost(new) - cost(now)) <= 0 or rng.random() < math.exp(-d / max(heat, 1e-9)):
            now = new
        if cost(now) < cost(best):
            best = now
    return best
