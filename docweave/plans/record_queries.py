"""Record derivations and filters over the star-schema tables and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import records as R
from docweave.operators import payloads as Y
from docweave.sources.tables import table

QUERIES = {}


def _q(name, sql, source):
    def add(f):
        QUERIES[name] = (lambda spark, d: f(table(spark, d, source)), sql)
        return f

    return add


@_q("A01_path_metadata", """
SELECT page_id, CASE WHEN len(p) >= 2 THEN p[1] ELSE '' END AS company, CASE WHEN len(p) >= 3 THEN p[2] ELSE '' END AS doc_type, CASE WHEN len(p) >= 4 THEN p[3] ELSE '' END AS year, p[-1] AS filename
FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS p FROM pages)""", "pages")  # fmt: skip
def _(d):
    from docweave.sources.files import path_fields

    return path_fields(d.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path")), "path").select("page_id", "company", "doc_type", "year", "filename")


@_q("A12_parse_route", "SELECT page_id, CASE WHEN length(html) >= 10000 THEN 'text_layer_then_ocr' WHEN length(html) >= 4000 THEN 'lean' ELSE 'full' END AS route, length(html) < 500 AS retry FROM pages", "pages")
def _(d):
    from docweave.sources.files import parse_route

    return d.select("page_id", parse_route(F.length("html"), 4000, 10000).alias("route"), (F.length("html") < 500).alias("retry"))


@_q("A13_parse_chars", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id", "conversations")
def _(d):
    return d.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))


@_q("A15_A16_locale_names", "SELECT page_id, page_id % 3 = 0 AS english, page_id % 3 = 1 AS french, 'T' || page_id AS slug FROM pages", "pages")
def _(d):
    from docweave.sources.files import filename_locale, filename_slug

    lang = F.when(F.col("page_id") % 3 == 0, "_en.PDF").when(F.col("page_id") % 3 == 1, "-fr.pdf").otherwise(".pdf")
    name = F.concat(F.lit("T"), F.col("page_id"), lang)
    return d.select("page_id", filename_locale(name).eqNullSafe("en").alias("english"), filename_locale(name).eqNullSafe("fr").alias("french"), filename_slug(name).alias("slug"))


@_q("A18_host_path", r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/mnt/c/docs/' || page_id || '/a.pdf' ELSE '/data/' || page_id END AS path FROM pages", "pages")
def _(d):
    k = F.col("page_id").cast("string")
    return d.select("page_id", R.host_path(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C:\\docs\\"), k, F.lit("\\a.pdf"))).otherwise(F.concat(F.lit("/data/"), k))).alias("path"))


@_q("C01_C04_file_dates", """
SELECT page_id, replace(regexp_extract(url, '([0-9]{4}[-_][0-9]{2}[-_][0-9]{2}|[0-9]{8}|[0-9]{4})', 1), '_', '-') AS url_date, CAST(2010 + page_id % 15 AS VARCHAR) || '-03-0' || (1 + page_id % 9) AS name_date,
       CASE WHEN regexp_extract(url, '(20[12][0-9])', 1) = '' THEN '' ELSE regexp_extract(url, '(20[12][0-9])', 1) || '-01-01' END AS hint FROM pages""", "pages")  # fmt: skip
def _(d):
    k = F.col("page_id")
    name = F.concat(F.lit("mda_"), (2010 + k % 15).cast("string"), F.lit("_03_0"), (1 + k % 9).cast("string"), F.lit("_final"))
    return d.select("page_id", R.file_date(F.col("url")).alias("url_date"), R.file_date(name).alias("name_date"), R.year_hint(F.col("url")).alias("hint"))


@_q("C02_C03_issuer_folder", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'acme corp ' || page_id WHEN 1 THEN 'beta ' || page_id ELSE NULL END AS folder,
       CASE page_id % 4 WHEN 0 THEN 'acme corp ' || page_id WHEN 1 THEN 'Fine Name' ELSE 'Notice of Meeting' END AS repaired FROM pages""", "pages")  # fmt: skip
def _(d):
    k, s = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/x/Filings/acme_corp-"), s, F.lit("/2020/a.pdf"))).when(k == 1, F.concat(F.lit("/x/beta_"), s, F.lit("/Annual/b.PDF"))).when(k == 2, F.lit("/x/y/z/b.pdf")).otherwise(F.lit("b.pdf"))
    company = F.when(k == 1, F.lit("Fine Name")).otherwise(F.lit("Notice of Meeting"))
    return d.select("page_id", R.issuer_folder(path).alias("folder"), R.repair_company(company, F.lit("2020-01-01 x.pdf"), path).alias("repaired"))


@_q("C05_C06_slugs", """
SELECT c_custkey, left(upper(trim(regexp_replace(c_name, '[^a-zA-Z0-9]+', '_', 'g'), '_')), 24) || '_ESG' AS ticker, trim(regexp_replace(regexp_replace(replace(lower(c_name || ' & Sons, Inc.'), '&', 'and'), '[.,'']', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_') AS issuer,
       'UNKNOWN_ESG' AS none FROM customer""", "customer")  # fmt: skip
def _(d):
    return d.select("c_custkey", R.ticker_slug(F.col("c_name")).alias("ticker"), R.issuer_slug(F.concat("c_name", F.lit(" & Sons, Inc."))).alias("issuer"), R.ticker_slug(F.lit(" -- ")).alias("none"))


_DESC = ["Annual Information Form", "Material change", "News interim", "Quarterly report", "Management discussion and analysis", "Annual report", "Audited financial statements", "Interim MD&A", "Other"]


@_q("C07_filing_types", """
SELECT p_partkey, ['AIF','MATERIAL_CHANGE_REPORT','NEWS_RELEASE','MDA_INTERIM','MDA_ANNUAL','OTHER','MDA_ANNUAL','MDA_INTERIM','OTHER'][p_partkey % 9 + 1] AS by_watcher,
       ['AIF','OTHER','MDA_INTERIM','MDA_INTERIM','MDA_ANNUAL','OTHER','MDA_ANNUAL','MDA_INTERIM','OTHER'][p_partkey % 9 + 1] AS by_index FROM part""", "part")  # fmt: skip
def _(d):
    desc = F.get(F.array(*map(F.lit, _DESC)), (F.col("p_partkey") % 9).cast("int"))
    return d.select("p_partkey", R.filing_type(desc).alias("by_watcher"), R.filing_type(desc, "index").alias("by_index"))


@_q("C08_C09_clean_and_enums", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS meta, CASE o_orderkey % 3 WHEN 0 THEN 'COST_INCREASE' WHEN 1 THEN 'NONE' ELSE 'PASS_THROUGH' END AS direction,
       CASE o_orderkey % 2 WHEN 0 THEN 'AIF' ELSE 'OTHER' END AS filing, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'REST' END AS priority FROM orders""", "orders")  # fmt: skip
def _(d):
    k = F.col("o_orderkey")
    direction = F.when(k % 3 == 0, " cost increase ").when(k % 3 == 1, "upward").otherwise("Pass_Through")
    return d.select(
        "o_orderkey",
        R.meta_string(F.when(k % 8 == 0, " NaN").when(k % 4 == 0, "<NA>").otherwise(F.col("o_orderpriority"))).alias("meta"),
        R.member(direction, *R.ENUMS["direction"]).alias("direction"),
        R.member(F.when(k % 2 == 0, "AIF").otherwise("aif"), *R.ENUMS["filing_type"], fold=False).alias("filing"),
        R.member(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "REST").alias("priority"),
    )


@_q("C11_C12_year_and_clamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS fiscal_year, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE greatest(0, least(3, CAST(o_orderkey % 7 AS INTEGER) - 2)) END AS score FROM orders", "orders")
def _(d):
    bad = F.col("o_orderkey") % 5 == 0
    date = F.when(bad, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return d.select("o_orderkey", R.fiscal_year(date).alias("fiscal_year"), R.clamp03(F.when(bad, "x").otherwise((F.col("o_orderkey") % 7 - 2).cast("string"))).alias("score"))


@_q("C13_coercions", """
SELECT event_id, [1234, 3, -3, NULL, NULL][event_id % 5 + 1]::BIGINT AS as_int, [1234.0, 3.9, -3.9, NULL, NULL][event_id % 5 + 1]::DOUBLE AS as_float,
       [true, false, true, false, false][event_id % 5 + 1] AS as_bool, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""", "events")  # fmt: skip
def _(d):
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), (F.col("event_id") % 5).cast("int"))
    number, flag = pick("1,234", "3.9", " -3.9", "", "n/a"), pick("yes", "F", "1", "", "maybe")
    return d.select("event_id", R.to_int(number).alias("as_int"), R.to_float(number).alias("as_float"), R.to_bool(flag).alias("as_bool"), R.to_int(F.get_json_object("props", "$.k")).alias("k"))


@_q("C15_C16_row_validation", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS amount, value AS score, event_type AS kind, event_id % 3 = 0 AS parse_error FROM events""", "events")  # fmt: skip
def _(d):
    from docweave.operators.quality import validate_rows

    raw = d.select("event_id", F.when(F.col("event_id") % 3 == 0, "many").otherwise(F.col("event_id").cast("string")).alias("amount"), F.col("value").cast("string").alias("score"), F.concat(F.lit(" "), "event_type").alias("kind"))
    return validate_rows(raw, {"amount": ("integer", None), "score": ("number", None), "kind": ("string", None)}, flag="parse_error")


@_q("C17_C19_evidence_cells", """
SELECT c_custkey, f AS field, CASE f WHEN 'name' THEN c_name ELSE c_mktsegment END AS value, CASE f WHEN 'name' THEN CAST(c_custkey % 9 + 1 AS INTEGER) END AS page_start, CASE f WHEN 'name' THEN CAST(c_custkey % 9 + 2 AS INTEGER) END AS page_end,
       f = 'segment' AS evidenceless FROM customer, (VALUES ('name'), ('segment')) AS t(f)""", "customer")  # fmt: skip
def _(d):
    from docweave.operators.quality import cells

    k = F.col("c_custkey")
    wide = d.select("c_custkey", F.col("c_name").alias("name"), F.col("c_name").alias("name_evidence_quote"), F.concat((k % 9 + 1).cast("string"), F.lit("-"), (k % 9 + 2).cast("string")).alias("name_evidence_pages"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("segment_evidence_quote"), F.lit("").alias("segment_evidence_pages"))
    return cells(wide, "c_custkey", ["name", "segment"]).select("c_custkey", "field", "value", "page_start", "page_end", "evidenceless")


@_q("C20_C22_stamps", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR))[:12] AS doc_hash, md5(text[:8192])[:16] AS chunk_digest FROM documents", "documents")
def _(d):
    return d.select("doc_id", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12).alias("doc_hash"), F.substring(F.md5(F.substring("text", 1, 8192)), 1, 16).alias("chunk_digest"))


@_q("C24_C25_call_config", """
SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '(count|total|number_of|num_)') THEN 'combine' ELSE 'single' END AS cardinality, [0.0, 0.1, 0.3][p_size % 3 + 1]::DOUBLE AS temperature FROM part""", "part")  # fmt: skip
def _(d):
    from docweave.operators.quality import call_config, cardinality

    level = F.get(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.col("p_size") % 3)
    return d.select("p_partkey", cardinality(F.col("p_name"), F.lit("string")).alias("cardinality"), call_config(level, {"easy": 0.0, "medium": 0.1, "hard": 0.3}).alias("temperature"))


@_q("C26_C27_filled_display", "SELECT event_id, event_id % 4 > 1 AS filled, CASE WHEN event_id % 4 > 1 THEN event_type ELSE '—' END AS shown FROM events", "events")
def _(d):
    v = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, " nan ").otherwise(F.col("event_type"))
    return d.select("event_id", R.filled(v).alias("filled"), F.when(R.filled(v), F.when(F.length(v) > 80, F.concat(F.substring(v, 1, 79), F.lit("…"))).otherwise(v)).otherwise(F.lit("—")).alias("shown"))


@_q("C30_presence", "SELECT conv_id, turn, role = 'user' OR length(text) > 80 AS present FROM conversations", "conversations")
def _(d):
    evidence = F.when(F.length("text") > 80, F.array("text")).otherwise(F.array().cast("array<string>"))
    return d.select("conv_id", "turn", ((F.col("role") == "user") | (F.size(evidence) > 0)).alias("present"))


@_q("C32_boxes", "SELECT event_id, CAST(event_id % 3 + 1 AS BIGINT) AS page, CAST(792 - (event_id % 100 + 50) AS DOUBLE) AS top FROM events", "events")
def _(d):
    from docweave.operators.quality import page_boxes

    k = F.col("event_id")
    js = F.format_string('[{"page": %d, "l": 1.0, "t": %d.0, "r": 9.0, "b": %d.0}]', k % 3 + 1, k % 100 + 50, k % 100)
    return page_boxes(d.select("event_id", js.alias("boxes")), "event_id", "boxes", page_height=792.0).select("event_id", "page", "top")


@_q("F01_F09_parse_status", "SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS ok, o_orderkey % 5 IN (0, 1, 2) AS terminal FROM orders", "orders")
def _(d):
    from docweave.operators.quality import is_ok, is_terminal

    s = F.get(F.array(F.lit("OK"), F.lit("OK_OCR"), F.lit("PDF_MISSING"), F.lit("ERROR: x"), F.lit(None)), (F.col("o_orderkey") % 5).cast("int"))
    return d.select("o_orderkey", is_ok(s).alias("ok"), is_terminal(s).alias("terminal"))


@_q("F05_F06_F07_review_filters", "SELECT event_id, event_type FROM events WHERE event_type = 'error' AND event_id % 2 = 0", "events")
def _(d):
    return d.filter((F.upper("event_type").isin("ERROR")) & F.when(F.col("event_id") % 2 == 0, True).eqNullSafe(F.lit(True))).select("event_id", "event_type")


@_q("F08_F11_contains", "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'promo') AND p_partkey % 3 IN (0, 1)", "part")
def _(d):
    member = F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("here"))).otherwise(F.array(F.lit("there")))
    return d.filter(F.col("p_type").ilike("%promo%") & (F.array_contains(member, "here") | (F.size(member) == 0))).select("p_partkey", "p_type")


@_q("F10_substantive", "SELECT page_id, [-1, 1, 0][page_id % 3 + 1]::INTEGER AS score FROM pages", "pages")
def _(d):
    return d.select("page_id", R.substantive(F.get(F.array(F.lit("Consent letter MD&A"), F.lit("Annual_Report"), F.lit("note")), (F.col("page_id") % 3).cast("int"))).alias("score"))


@_q("I02_I03_I04_scores", """
SELECT p_partkey, CAST(least(coalesce(raw, 0), coalesce(row_cap, 3)) AS BIGINT) AS adj, CASE WHEN cap <= 0 THEN 0.0 ELSE round_even(least(1.0, greatest(0.0, least(coalesce(raw, 0), coalesce(row_cap, 3)) / cap)), 4) END AS fuzzy,
       CASE WHEN cap <= 0 THEN 0.05 ELSE [0.05, 0.25, 0.75, 0.95][CAST(round_even(least(3.0, greatest(0.0, least(coalesce(raw, 0), coalesce(row_cap, 3)) / cap * 3)), 0) AS INTEGER) + 1]::DOUBLE END AS anchor
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 4 END AS raw, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 3 + 1 END AS row_cap, p_size % 4 AS cap FROM part)""", "part")  # fmt: skip
def _(d):
    k = F.col("p_partkey")
    adj = R.adjusted(F.when(k % 7 != 0, k % 4), F.when(k % 5 != 0, k % 3 + 1))
    return d.select("p_partkey", adj.cast("long").alias("adj"), R.fuzzy(adj, F.col("p_size") % 4).alias("fuzzy"), R.calibrated(adj, F.col("p_size") % 4).alias("anchor"))


#: The same evidence in six shapes, by event: text, object, list of text, list of objects, mixed, none.
_SHAPES = """
CASE event_id % 6 WHEN 0 THEN '{"macro_evidence": "q' || k || '", "uncertainty_language": "Yes", "mentions_tariffs": 1}'
 WHEN 1 THEN '{"macro_evidence": {"quote": "q' || k || '", "macro_type": "fx or macro", "magnitude_text": "5%"}, "uncertainty_language": ["may", true, " "], "other_tariff_mentions": "may", "mentions_tariffs": "no"}'
 WHEN 2 THEN '{"macro_evidence": ["q' || k || '", " "], "uncertainty_language": [false], "other_tariff_mentions": ["a ", "", 7], "specific_tariff_programs": 301}'
 WHEN 3 THEN '{"macro_evidence": [{"quote": ' || k || ', "macro_type": "NONE"}, {"quote": "z"}], "uncertainty_language": ["might", "may", "might"], "other_tariff_mentions": ["may"], "mentions_tariffs": true}'
 WHEN 4 THEN '{"macro_evidence": ["q' || k || '", 5, null, {"macro_type": "odd"}], "uncertainty_language": 0, "specific_tariff_programs": [" 232", "301"]}'
 ELSE '[1]' END"""


@_q("C29_repaired_payloads", f"""
WITH e AS (SELECT event_id, event_id % 6 AS s, regexp_extract(props, '[0-9]+', 0) AS k FROM events)
SELECT event_id, CASE s WHEN 0 THEN 'q' || k || '/OTHER/-' WHEN 1 THEN 'q' || k || '/FX_OR_MACRO/5%' WHEN 2 THEN 'q' || k || '/OTHER/-' WHEN 3 THEN k || '/NONE/-;z/OTHER/-' WHEN 4 THEN 'q' || k || '/OTHER/-;/OTHER/-' ELSE '' END AS macro,
 CASE s WHEN 1 THEN 'may' WHEN 2 THEN 'a,7' WHEN 3 THEN 'may,might' ELSE '' END AS mentions, CASE s WHEN 2 THEN '301' WHEN 4 THEN '232,301' ELSE '' END AS programs,
 s IN (0, 1, 3) AS uncertain, CASE s WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS tariffs FROM e""", "events")  # fmt: skip
def _(e):
    shaped = e.select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k")).select("event_id", F.expr(_SHAPES).alias("payload"))
    r = Y.repair_payloads(shaped, "event_id", "payload")
    macro = F.array_join(F.transform("macro_evidence", lambda x: F.concat_ws("/", x["quote"], x["kind"], F.coalesce(x["magnitude"], F.lit("-")))), ";")
    return r.select("event_id", macro.alias("macro"), F.array_join("other_tariff_mentions", ",").alias("mentions"), F.array_join("specific_tariff_programs", ",").alias("programs"), F.col("uncertainty_language").alias("uncertain"), F.col("mentions_tariffs").alias("tariffs"))
