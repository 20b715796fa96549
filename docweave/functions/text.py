"""Text functions. White space and words are ASCII, the same in every engine."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B]+"

#: Blanks that are trimmed, as DuckDB does.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: Lower-case letters that share their upper case with another, and that other.
FOLDED = ("ıſµ\u0345\u1fbeϐϵϑϰϖϱςϕ\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86\u1c87\u1c88ẛ", "isμιιβεθκπρσφвдосттъѣꙋṡ")

#: Intent taxonomy, tag and pattern, in order.
TAXONOMY = [
    ("trade_tariff", r"tariff|import.dut|trade.war|sanction|embargo|customs.dut|supply.chain|retaliatory|countervail|anti.dump|section.232|section.301|usmca|cusma|ceta|cptpp|liberation.day|softwood|lumber.dut"),
    ("financial_metrics", r"revenue|earnings|ebitda|net.income|margin|cash.flow|eps|return.on|profit|loss|gross|operating|capex|free.cash|dividend|yield"),
    ("esg_climate", r"emission|carbon|ghg|climate|sustainab|scope.[123]|net.zero|biodiversity|water|waste|renewable|decarbonization"),
    ("governance", r"board|director|executive|compensation|governance|audit.committee|say.on.pay|independence|diversity|ceo|cfo|whistleblower"),
    ("risk_factors", r"(^|[^a-z0-9_])risk([^a-z0-9_]|$)|uncertaint|exposure|sensitiv|contingent|legal.proceed|litigation|lawsuit|regulatory|compliance|penalty"),
    ("operational", r"production|capacity|output|volume|throughput|headcount|employee|plant|facility|fleet|unit.cost|efficiency"),
    ("real_estate", r"occupancy|lease|rent|cap.rate|noi|ffo|properties|square.feet|tenant|vacancy|development|zoning"),
    ("mining_resources", r"mineral|reserve|resource|grade|ore|pit|mine|gold|silver|copper|lithium|nickel|zinc|cobalt|uranium|royalty"),
    ("energy_oil_gas", r"barrel|boe|mboe|proved|probable|reservoir|upstream|downstream|refinery|petrochemical|lng|pipeline|wellbore|netback"),
    ("healthcare_pharma", r"clinical.trial|drug|therapeutic|patent|approval|fda|health.canada|patient|prescription|molecule|pipeline.stage"),
]

#: Words that are no key terms.
STOP_WORDS = (
    "the and for are with from that this have been were they their them will would could should about into over under also both "
    "each more most only very just such than then some any may can has had its how per yet what when where which been being itself "
    "those these does did was were all one two three four five six seven many other every either neither after before during while whether"
).split()

#: Signals of a field's type, in order of priority.
TYPE_SIGNALS = [
    ("bool", "whether|presence|existence|disclosed|reported|mentioned|flagged|indicates|signal|binary|yes.no|true.false|flag"),
    ("date", "date|when|period|quarter|year|month|fiscal|anniversary|expiry|maturity|effective|announced|closed|signed"),
    ("float", "amount|dollar|million|billion|percent|rate|ratio|value|price|cost|revenue|income|ebitda|margin|yield|return|gain|loss|fee|salary|wage|metric|score|average|mean|median|proportion|share|fraction|weight"),
    ("int", "count|number|year|month|quarter|employees|headcount|shares|units|properties|buildings|facilities|mines|wells|days|hours|periods"),
]

#: Common words by language, in the order that wins ties.
COMMON_WORDS = {
    "en": "the and of to in is for this that with are have has its".split(),
    "fr": "de du les et en que qui une des dans par est avec pour sur".split(),
    "es": "de la el en que es un una con por se los del las".split(),
}

#: Suffixes of company names.
LEGAL_SUFFIXES = r"inc|corp|ltd|limited|llc|lp|plc|company|co|group|holding|holdings|international|global|sa|nv|ag|gmbh"
CLEAN_SUFFIXES = ["inc", "corp", "ltd", "limited", "lp", "llp", "co", "trust", "fund", "plc"]

#: Words that look like tickers, and document types by keyword.
TICKER_STOP = (
    "CEO CFO COO CTO ESG IPO TSX NYSE GDP USD CAD PDF API LLM AI MD AIF BC ON QC AB NB NS PE NL YT NT NU SK MB ETF REIT "
    "THE FOR AND NOT BUT ALL FROM WITH THIS INTO"
).split()
DOC_TYPES = [
    ("mda", "Annual MD&A"), ("md&a", "Annual MD&A"), ("annual report", "Annual Report"), ("aif", "Annual Information Form"),
    ("esg", "ESG/Sustainability Report"), ("sustainability", "ESG/Sustainability Report"), ("circular", "Management Information Circular"),
    ("proxy", "Management Information Circular"), ("interim", "Interim MD&A"), ("quarterly", "Quarterly Report"),
]

#: Identity fields hinted at by a first message.
IDENTITY_HINTS = [
    ("compan(y|ies)", "company_name"), ("ticker|symbol", "ticker"), ("year|annual", "year"), ("quarter|q[1-4]", "quarter"),
    ("country|nation", "country"), ("sector|industry", "sector"), ("fil(ing|ings)", "filing_type"),
]


def whole_word(pattern: str) -> str:
    """The pattern between ASCII word borders, written out so that every regex engine agrees."""
    return f"(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}|{WS}$", "")


def words(c: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WS), "")


def estimate_tokens(c: Column) -> Column:
    """max(1, whole part of words / 0.75); blank text estimates to 1."""
    return F.greatest(F.lit(1), F.floor(F.size(words(c)) / F.lit(0.75))).cast("long")


def prompt_tokens(c: Column) -> Column:
    """The larger of estimate_tokens and a third of the characters."""
    return F.greatest(estimate_tokens(c), F.floor((F.length(F.coalesce(c, F.lit(""))) + 2) / 3)).cast("long")


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; accented letters part words."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def sanitize(c: Column, cap: int | None = None) -> Column:
    """No control characters, blanks collapsed, no blank lines; longer than cap: cut, with an ellipsis."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.transform(F.split(s, r"\r\n|[\n\r\u0085\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    s = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return s if cap is None else F.when(F.length(s) > cap, F.concat(F.regexp_replace(F.substring(s, 1, cap - 1), rf"{WS}$", ""), F.lit("…"))).otherwise(s)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank; no blank of any kind at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "), F.lit(BLANKS))


def lower(c: Column) -> Column:
    """Lower case, a character for each, wherever it stands: Σ is σ at the end of a word too, İ is i."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def fold_case(c: Column) -> Column:
    """Equal where the upper cases of the lower cases are, a character for each: ß is not ss, a long s is s."""
    return F.translate(lower(c), *FOLDED)


def collapse(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends; null as empty."""
    return lower(squeeze(F.coalesce(c, F.lit(""))))


def _matching(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Different labels of the rules that match, in their order.

    Batches of texts meet RE2, as in Arrow and DuckDB: its time is in proportion to the text,
    whatever the pattern. Patterns have no look-around and no back references.
    """
    names = list(dict.fromkeys(x for x, _ in rules))

    def found(low: pa.Array) -> pa.Array:
        hits = {x: reduce(pc.or_, [pc.match_substring_regex(low, p) for y, p in rules if x == y]).to_pylist() for x in names}
        return pa.array([[x for x, hit in zip(names, row, strict=True) if hit] for row in zip(*hits.values(), strict=True)], pa.list_(pa.string()))

    return F.arrow_udf(found, "array<string>")(F.lower(F.coalesce(c, F.lit("")))) if rules else F.array().cast("array<string>")


def labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Sorted different labels of the rules (label, pattern on lower-case text) that match."""
    return _matching(c, sorted(rules, key=lambda r: r[0]))


def labelled(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether any of the rules (label, pattern on lower-case text) matches; for short texts, which stay with Spark."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, [low.rlike(p) for _, p in rules], F.lit(False))


def topics(c: Column) -> Column:
    """Taxonomy tags in taxonomy order."""
    return _matching(c, TAXONOMY)


def infer_type(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("str")
    for kind, p in reversed(TYPE_SIGNALS):
        out = F.when(low.rlike(whole_word(p)), F.lit(kind)).otherwise(out)
    return out


def key_terms(c: Column, most: int = 25) -> Column:
    """First different words of four or more ASCII letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.isin(STOP_WORDS))), 1, most)


def company_name(c: Column) -> Column:
    """Lower case, without legal suffixes and punctuation."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?:^|(?<=[^a-z0-9_]))(?:{LEGAL_SUFFIXES})(?=[^a-z0-9_]|$)\.?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9_\s]", " "), WS, " "))


def clean_name(c: Column) -> Column:
    """The other name cleaner: up to a slash or "operating name", letters and digits only, without suffixes."""
    s = F.split(F.coalesce(c, F.lit("")), "/")[0]
    s = F.split(F.lower(s), "operating name")[0]
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), F.lit(" "))
    for x in CLEAN_SUFFIXES:
        # Twice: neighbours share the blank between them.
        s = F.replace(F.replace(s, F.lit(f" {x} "), F.lit(" ")), F.lit(f" {x} "), F.lit(" "))
    return F.trim(F.regexp_replace(s, " +", " "))


def detect_language(c: Column) -> Column:
    """en, fr or es by common words of three or more letters; fewer than two: unknown."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[a-zA-Zàâéèêëîïôùûüç]{3,}"), F.lit(0)), F.lower))
    n = {k: F.size(F.array_intersect(found, F.array(*map(F.lit, v)))) for k, v in COMMON_WORDS.items()}
    best = F.greatest(*n.values())
    return F.when(best <= 1, "unknown").when(n["en"] == best, "en").when(n["fr"] == best, "fr").otherwise("es")


def listed_identifiers(c: Column) -> Column:
    """map of lei, tsx_ticker, cusip and isin found in exchange text, upper case."""
    patterns = [("lei", r"(?i)\bLEI\s+([A-Z0-9]{18,20})\b"), ("tsx_ticker", r"TSX\)\s*-\s*([A-Z0-9.]+)"), ("cusip", r"(?i)CUSIP\s+([A-Z0-9]{6,9})"), ("isin", r"(?i)ISIN\s+([A-Z]{2}[A-Z0-9]{10})")]
    pairs = [x for k, p in patterns for x in (F.lit(k), F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1)))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


def former_names(name: Column, history: Column) -> Column:
    """Former names in "(formerly X)" and in history text; over two characters, first spelling of each."""
    a = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(?i)\(formerly\s+([^)]+)\)"), F.lit(1))
    b = F.regexp_extract_all(F.coalesce(history, F.lit("")), F.lit(r"(?i)Previous\s+name\s+in\s+English\s+([^\n]+?)\s+(?:Previous|Effective)"), F.lit(1))
    found = F.filter(F.transform(F.concat(a, b), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    low = F.transform(found, F.lower)
    return F.filter(found, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def naics_code(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when(s.startswith("000000"), F.lit("")).otherwise(F.regexp_extract(s, r"^([0-9]{4,6})", 1))


def profile_number(c: Column) -> Column:
    """Digits only, padded to nine with zeros; more than nine stay, none stays empty."""
    d = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")
    return F.when((d == "") | (F.length(d) >= 9), d).otherwise(F.lpad(d, 9, "0"))


def provisional_id(seed: Column) -> Column:
    return F.concat(F.lit("prov_"), F.substring(F.sha2(seed, 256), 1, 16))


def scope_of(c: Column) -> dict[str, Column]:
    """Structured scope of a free-text request: tickers, profile numbers, years, document types."""
    text = F.coalesce(c, F.lit(""))
    word = F.split(text, "[^A-Za-z0-9_]+")
    tickers = F.array_distinct(F.filter(word, lambda x: x.rlike("^[A-Z]{2,5}$") & ~x.isin(TICKER_STOP)))
    numbers = F.array_distinct(F.filter(word, lambda x: x.rlike("^[0-9]{6,9}$")))
    years = F.transform(F.filter(word, lambda x: x.rlike("^20[0-9]{2}$")), lambda x: x.cast("int"))
    span = r"(?:^|[^A-Za-z0-9_])(20[0-9]{2})\s*[-–—toTO]+\s*(20[0-9]{2})(?:[^A-Za-z0-9_]|$)"
    has = text.rlike(span)
    low = F.lower(text)
    types = F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in DOC_TYPES])))
    return {
        "tickers": tickers,
        "profile_numbers": numbers,
        "date_from": F.when(has, F.regexp_extract(text, span, 1).try_cast("int")).otherwise(F.array_min(years)),
        "date_to": F.when(has, F.regexp_extract(text, span, 2).try_cast("int")).otherwise(F.array_max(years)),
        "doc_types": F.when(F.size(types) == 0, F.array(F.lit("Annual MD&A"))).otherwise(types),
    }


def identity_hints(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike(whole_word(p)), F.lit(x)) for p, x in IDENTITY_HINTS]))
    return F.when(F.size(found) == 0, F.array(F.lit("doc_id"), F.lit("entity_name"))).otherwise(found)


def clip_quote(c: Column, most: int = 300) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def condense_quote(c: Column, most: int = 1200) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 3), " +$", ""), F.lit("...")))


def thinking(c: Column, most: int = 16_000) -> Column:
    """The text of the first think block, at most ``most`` characters; null without one."""
    t = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<think>(.*?)</think>", 1)
    return F.when(F.trim(t) != "", F.substring(F.trim(t), 1, most))
