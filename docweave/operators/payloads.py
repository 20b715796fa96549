"""Repair of model payloads whose values come in unknown shapes, on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import records as R

#: Lists of evidence with the name and default of each one's kind, and the flags of a payload.
EVIDENCE = {"earnings_evidence": ("signal_type", "UNCLEAR"), "macro_evidence": ("macro_type", "OTHER"), "supply_chain_evidence": ("chain_type", "OTHER")}
FLAGS = ("mentions_tariffs", "earnings_impact_present", "macro_risk_present", "supply_chain_risk_present", "pass_through_mentioned", "mitigation_mentioned", "llm_skipped")
TRUE = ("true", "1", "yes", "y")
#: What an earnings signal may be.
SIGNALS = ("COST_INCREASE", "MARGIN_COMPRESSION", "REVENUE_DECREASE", "PASS_THROUGH_CLAIM", "VOLUME_IMPACT", "BENEFIT_OR_TAILWIND", "UNCLEAR", "NONE")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind(v: Column) -> Column:
    """list, object, string, boolean, number, none (JSON null) or null (absent)."""

    def of(s: Column) -> Column:
        return (
            F.when(s.isNull(), F.lit(None)).when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object")
            .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "none").otherwise("number")
        )

    return let(F.schema_of_variant(v), of)


def said(v: Column) -> Column:
    """A value as text: strings as they are, True and False, None; lists and objects as JSON."""
    text = F.try_variant_get(v, "$", "string")
    return let(kind(v), lambda k: F.when(k == "boolean", F.initcap(text)).when(k == "none", "None").when(k.isin("list", "object"), F.to_json(v)).otherwise(text))


def _list(v: Column) -> Column:
    """array<variant> of a list, null for all else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _elements(v: Column) -> Column:
    return F.coalesce(_list(v), F.array().cast("array<variant>"))


def listed(v: Column) -> Column:
    """array<variant>: a list as it is, nothing as empty, anything else as a list of itself."""
    return F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<variant>")).otherwise(F.coalesce(_list(v), F.array(v)))


def truth(v: Column) -> Column:
    """A flag: numbers but 0, the words of TRUE, lists and objects that hold something."""

    def of(k: Column) -> Column:
        return (
            F.when(k == "boolean", F.try_variant_get(v, "$", "boolean")).when(k == "number", F.try_variant_get(v, "$", "double") != 0)
            .when(k == "string", F.lower(F.trim(F.try_variant_get(v, "$", "string"))).isin(*TRUE)).when(k == "list", F.size(_elements(v)) > 0)
            .when(k == "object", F.to_json(v) != "{}").otherwise(False)
        )

    return let(kind(v), of)


def given(v: Column) -> Column:
    """Whether a value says anything: no empty text, list or object, no zero, not false."""
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string") != "").otherwise(truth(v))


def texts(v: Column) -> Column:
    """array<string>: the elements as trimmed text, blank ones dropped; a single value that is not empty as a list of itself."""
    return F.filter(F.transform(listed(v), lambda x: F.trim(said(x))), lambda s: s != "")


def evidence(v: Column, name: str, default: str) -> Column:
    """array of quote, kind and magnitude: strings become quotes of the default kind, objects are read, all else is dropped."""
    members = {"signal_type": SIGNALS, "macro_type": R.ENUMS["macro"][0], "chain_type": R.ENUMS["supply_chain"][0]}[name]
    fields = f"struct<quote: variant, {name}: variant, magnitude_text: string>"
    read = F.transform(listed(v), lambda x: F.struct(F.when(kind(x) == "string", F.try_variant_get(x, "$", "string")).alias("text"), F.try_variant_get(x, "$", fields).alias("object")))
    kept = F.filter(read, lambda x: x["object"].isNotNull() | (F.trim(x["text"]) != ""))
    of = lambda x, other: F.when(x.isNull(), F.lit(other)).otherwise(said(x))

    def item(x: Column) -> Column:
        plain, o = x["text"].isNotNull(), x["object"]
        quote = F.when(plain, x["text"]).otherwise(of(o["quote"], ""))
        what = F.when(plain, F.lit(default)).otherwise(let(of(o[name], default), lambda s: R.member(s, list(members), default)))
        return F.struct(quote.alias("quote"), what.alias("kind"), o["magnitude_text"].alias("magnitude"))

    return F.transform(kept, item)


#: The fields of a payload that are read.
FIELDS = (*EVIDENCE, "uncertainty_language", "other_tariff_mentions", "specific_tariff_programs", *FLAGS)


def fields(payload: Column) -> Column:
    """A struct of FIELDS as variants, in one pass over one payload, JSON text of an object; null for text that is none."""
    return F.try_variant_get(F.try_parse_json(payload), "$", f"struct<{', '.join(f'{f}: variant' for f in FIELDS)}>")


def repaired(read: Column) -> dict[str, Column]:
    """The columns of one payload, from its fields(); those of text that is no object are empty lists, false and null flags.

    Evidence lists and text lists have one shape whatever came. Strings in a list of uncertain
    language join the mentions, and the list is true if it holds a string or true. Flags that are absent stay
    null. All of it is JVM-side.
    """
    doubt = read["uncertainty_language"]
    as_list = _list(doubt)
    said_so = F.transform(_elements(doubt), lambda x: let(kind(x), lambda k: F.struct(F.when(k == "string", F.trim(F.try_variant_get(x, "$", "string"))).alias("word"), F.when(k == "boolean", F.try_variant_get(x, "$", "boolean")).alias("yes"))))
    words = lambda xs: F.filter(F.transform(xs, lambda x: x["word"]), lambda s: s != "")
    out = {name: evidence(read[name], *how) for name, how in EVIDENCE.items()}
    mentions = lambda ms: F.concat(ms, F.array_distinct(F.filter(words(said_so), lambda s: ~F.array_contains(ms, s))))
    out["other_tariff_mentions"] = let(texts(read["other_tariff_mentions"]), mentions)
    holds = let(said_so, lambda xs: F.exists(xs, lambda x: F.coalesce(x["word"] != "", F.lit(False)) | F.coalesce(x["yes"], F.lit(False))))
    out["uncertainty_language"] = F.when(as_list.isNotNull(), holds).otherwise(truth(doubt))
    out["specific_tariff_programs"] = texts(read["specific_tariff_programs"])
    return out | {f: F.when(read[f].isNotNull(), truth(read[f])) for f in FLAGS}


def repair_payloads(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """``key`` and the columns of repaired(), a row per row; a payload is parsed once, however many of them are asked."""
    read = rows.select(key, fields(F.col(payload)).alias("payload_fields"))
    return read.select(key, *[c.alias(name) for name, c in repaired(F.col("payload_fields")).items()])
