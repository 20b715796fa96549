"""Derivations on record fields: enumerations, dates, slugs, coercions, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of each enumeration and what stands for all else.
ENUMS = {
    "filing_type": (["MDA_ANNUAL", "MDA_INTERIM", "AIF", "MATERIAL_CHANGE_REPORT", "NEWS_RELEASE", "OTHER"], "OTHER"),
    "supply_chain": (["INPUT_SOURCING", "LOGISTICS", "EQUIPMENT_OR_CAPEX", "SUPPLIER_OR_ALT_SOURCE", "CUSTOMS_OR_BORDER", "OTHER", "NONE"], "OTHER"),
    "macro": (["TRADE_POLICY_ESCALATION", "REGULATORY_OR_LEGAL", "FX_OR_MACRO", "DEMAND_DESTRUCTION", "OTHER", "NONE"], "OTHER"),
    "direction": (["COST_INCREASE", "REVENUE_DECREASE", "MIXED", "PASS_THROUGH", "MINIMAL", "NONE"], "NONE"),
    "disclosure_quality": (["BOILERPLATE", "SPECIFIC_QUALITATIVE", "SPECIFIC_QUANTITATIVE"], "BOILERPLATE"),
}
#: What counts as no value, and calibration anchors by level.
BLANKS = ["", "nan", "none", "<na>", "null", "nat"]
ANCHORS = [0.05, 0.25, 0.75, 0.95]


def meta_string(c: Column) -> Column:
    """Trimmed; null and the names of nothing as empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(BLANKS), F.lit("")).otherwise(t)


def member(c: Column, values: list[str], default: str, fold: bool = True) -> Column:
    """The value if it is a member, after upper-casing and blanks as underscores unless fold is false; else default."""
    s = F.trim(F.coalesce(c, F.lit("")))
    s = F.replace(F.upper(s), F.lit(" "), F.lit("_")) if fold else s
    return F.when(s.isin(values), s).otherwise(F.lit(default))


def fiscal_year(c: Column) -> Column:
    return F.year(F.try_to_timestamp(c.cast("string")))


def clamp03(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(c.try_cast("int"), F.lit(0))))


def file_date(stem: Column) -> Column:
    """First date or year in a file name, underscores as hyphens; empty without one."""
    return F.replace(F.regexp_extract(stem, r"([0-9]{4}[-_][0-9]{2}[-_][0-9]{2}|[0-9]{8}|[0-9]{4})", 1), F.lit("_"), F.lit("-"))


def year_hint(path: Column) -> Column:
    y = F.regexp_extract(path, "(20[12][0-9])", 1)
    return F.when(y == "", F.lit("")).otherwise(F.concat(y, F.lit("-01-01")))


def ticker_slug(name: Column) -> Column:
    s = F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", F.lit("UNKNOWN_ESG")).otherwise(F.concat(F.substring(s, 1, 24), F.lit("_ESG")))


def issuer_slug(name: Column) -> Column:
    s = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit("and"))
    s = F.regexp_replace(s, "[.,']", "")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def filing_type(desc: Column, by: str = "watcher") -> Column:
    """Filing type of a description; the two callers try the rules in different orders."""
    d = F.lower(F.coalesce(desc, F.lit("")))
    has = lambda *x: [d.contains(y) for y in x]
    either = lambda *x: has(*x)[0] | has(*x)[1]
    if by == "watcher":
        rules = [
            (either("annual information", "information form"), "AIF"), (d.contains("material change"), "MATERIAL_CHANGE_REPORT"), (either("news", "press release"), "NEWS_RELEASE"),
            (either("interim", "quarterly"), "MDA_INTERIM"), (d.contains("management") & d.contains("analysis"), "MDA_ANNUAL"), (d.contains("annual report"), "OTHER"), (d.contains("financial statement"), "MDA_ANNUAL"),
        ]
    else:
        rules = [
            (either("interim", "quarterly"), "MDA_INTERIM"), (either("management", "md&a"), "MDA_ANNUAL"), (either("annual information", "information form"), "AIF"),
            (d.contains("annual report"), "OTHER"), (d.contains("financial statement"), "MDA_ANNUAL"),
        ]
    out = F.lit("OTHER")
    for cond, kind in reversed(rules):
        out = F.when(cond, F.lit(kind)).otherwise(out)
    return out


def issuer_folder(path: Column) -> Column:
    """Folder after "filings", else the grandparent of a PDF in a folder of a known kind; null without one."""
    parts = F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    low = F.transform(parts, F.lower)
    after = F.get(parts, F.array_position(low, "filings").cast("int"))
    n = F.size(parts)
    known = F.get(low, n - 2).isin("general", "annual", "interim", "english", "french", "documents") & F.get(low, n - 1).endswith(".pdf")
    seg = F.when(F.array_contains(low, "filings") & after.isNotNull() & ~F.lower(after).endswith(".pdf"), after).when((n >= 3) & known, F.get(parts, n - 3))
    return F.when(n >= 2, F.trim(F.regexp_replace(seg, "[_-]", " ")))


def repair_company(company: Column, filename: Column, path: Column) -> Column:
    """The issuer folder where the name is blank or looks like a filing's title; else the name."""
    #: Fixed value: words of filing titles.
    title = r"(?i)(annual\s+md|final\s+short|management\s+information|consent\s+letter|notice\s+of|form\s+of|qualification|undertaking|auditors?'?|non[- ]issuer)"
    cur, folder = F.trim(F.coalesce(company, F.lit(""))), issuer_folder(path)
    stem = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]*$", ""), r"^[0-9]{4}[-_][0-9]{2}[-_][0-9]{2}[_\s–-]+", ""))
    wrong = (cur == "") | cur.rlike(title) | (F.startswith(stem, F.lower(cur)) & (F.length(cur) >= 6))
    return F.when(folder.isNotNull() & (F.lower(cur) != F.lower(folder)) & wrong, folder).otherwise(company)


def host_path(path: Column) -> Column:
    r"""C:\x as /mnt/c/x."""
    drive = F.lower(F.regexp_extract(path, r"^([A-Za-z]):[\\/]", 1))
    return F.when(drive == "", path).otherwise(F.concat(F.lit("/mnt/"), drive, F.lit("/"), F.replace(F.substr(path, F.lit(4)), F.lit("\\"), F.lit("/"))))


def substantive(text: Column) -> Column:
    """-1 boilerplate, 1 substantive, 0 neither, by file name and type."""
    #: Patterns of either.
    dull = r"undertaking|consent.letter|qualification.cert|power.of.attorney|notice.of.articles|certificate.of|statutory.declaration|material.change"
    rich = r"md.?a|annual.report|management.discussion|aif|annual.information|financial.statement|quarterly|interim|10.k|20.f|prospectus|circular"
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(dull), -1).when(low.rlike(rich), 1).otherwise(0)


def to_bool(c: Column, default: bool | None = False) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "yes", "y", "1", "t"), True).when(s.isin("false", "no", "n", "0", "f"), False).otherwise(F.lit(default))


def to_int(c: Column, default: int | None = None) -> Column:
    """Commas, underscores and blanks dropped, then truncated toward zero; default where that is no number."""
    return F.coalesce(F.regexp_replace(F.trim(c), "[,_ ]", "").try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def to_float(c: Column, default: float | None = None) -> Column:
    return F.coalesce(F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double"), F.lit(default).cast("double"))


def to_string(c: Column, default: str | None = None) -> Column:
    t = F.trim(c)
    return F.when(t.isNull() | (t == ""), F.lit(default)).otherwise(t)


COERCE = {"bool": to_bool, "boolean": to_bool, "integer": to_int, "int": to_int, "number": to_float, "float": to_float, "string": to_string, "str": to_string, "text": to_string}


def filled(c: Column, default: str | None = None) -> Column:
    """Not null, not the default, and no name of nothing."""
    s = F.trim(c.cast("string"))
    out = c.isNotNull() & ~s.isin("", "None", "nan", "NaN", "null", "<NA>", "—")
    return F.coalesce(out & (c.cast("string") != F.lit(default)) if default is not None else out, F.lit(False))


def adjusted(score: Column, cap: Column) -> Column:
    """The score up to its row's cap; null score 0, null cap 3."""
    return F.least(F.coalesce(score, F.lit(0)), F.coalesce(cap, F.lit(3)))


def fuzzy(score: Column, cap: Column) -> Column:
    """Score as a share of the profile's cap, 0 to 1, four digits, halves to even; 0 without a cap."""
    return F.when(cap <= 0, F.lit(0.0)).otherwise(F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / cap)), 4))


def calibrated(score: Column, cap: Column) -> Column:
    """Anchor of the score's level 0 to 3 within the profile's cap."""
    level = F.bround(F.least(F.lit(3.0), F.greatest(F.lit(0.0), score / cap * 3))).cast("int")
    return F.when(cap <= 0, F.lit(ANCHORS[0])).otherwise(F.get(F.array(*map(F.lit, ANCHORS)), level))
