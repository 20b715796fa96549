"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: The base patterns by kind, in listed order, and the least length that counts. A run of
#: access or hex characters is matched whole, so the least length can stand in the pattern itself.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A cheap test of the whole text before its matches are placed.
HINT = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: What the Markov models judge: runs of this alphabet, of at least this length.
CANDIDATE, CANDIDATE_LEAST = r"[A-Za-z0-9+/_-]{20,}", 20
CANDIDATE_HINT = r"[A-Za-z0-9+/_-]{20}"
#: Fixed value: universally unique identifiers name things; though random, they are no secrets.
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Characters the models know, by the index used below; one more stands for all others.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Mean log-likelihood ratio a transition at which a run counts as random.
THRESHOLD = 0.35

#: Words that ordinary identifiers, paths and keys are made of.
IDENTIFIER_WORDS = (
    "account action active address admin agent alert alias amount answer apply archive array asset attempt author balance "
    "batch before begin binary block body border branch bridge browser buffer build button byte cache call cancel capture card "
    "category center chain change channel char check child choice class clean clear client clock close cloud code collect color "
    "column command comment commit common compare config connect console contact content context control convert cookie copy "
    "count country create current cursor custom data date debug default delete depth detail device digest direct disable display "
    "document domain double down draw driver drop edit element email enable encode entity entry error event example exception "
    "execute export expression extra factory fail feature field file filter final find first flag float flush folder format "
    "forward frame from function general get global graph group handle hash header height help hidden history home host html http "
    "icon image import index info init inner input insert install instance integer internal interval item iterator join json "
    "kernel key label language last latest layer layout left length level library license limit line link list load local lock "
    "login long loop main make manager map mask master match math max member memory menu merge message metadata method middle min "
    "mode model module monitor month mouse move name native network next node normal note null number object offset open option "
    "order origin other outer output owner package page panel parent parse partition password patch path pattern payment pixel "
    "plan player plugin point pool port position post power prefix preview price primary print private process product profile "
    "program project property proxy public query queue random range rate read record reference region register release remote "
    "remove render report request require reset resource response result return right role root route rule run sample save scale "
    "schema scope score screen script search section security select self send sequence server service session setting shape "
    "share show signal simple single size slot sort source space split stack start state static status step stop storage store "
    "stream string struct style submit summary support switch symbol sync system table target task team template temp test text "
    "thread time title token tool total trace track transfer transform tree trigger type unit update upload user utils valid value "
    "variable vector version video view visible wait watch widget width window word work worker wrapper write zone"
).split()

#: Long words of the other languages, which are no secrets either.
LONG_WORDS = (
    "geschwindigkeitsbegrenzung verantwortungsbewusstsein rechtsschutzversicherung aufmerksamkeitsdefizit wissenschaftlich gesellschaft "
    "unterschiedlich selbstverstaendlich entwicklungsumgebung datenschutzgrundverordnung arbeitsunfaehigkeit krankenversicherung "
    "zusammenarbeit veroeffentlichung berechtigungsnachweis anwendungsprogramm bundesausbildungsfoerderung durchschnittlich "
    "anticonstitutionnellement internationalisation responsabilisation developpement environnement gouvernement communication "
    "enseignement professionnellement administrativement caracteristiques appartement malheureusement quotidiennement vraisemblablement "
    "electroencefalografista responsabilidad internacionalmente desafortunadamente caracteristicas desarrollo funcionamiento "
    "administraciones independientemente constitucionalidad conocimiento establecimiento inmediatamente reconocimiento telecomunicaciones "
    "internationalization responsibilities characteristically counterrevolutionary incomprehensibility uncharacteristically "
    "electroencephalography institutionalization telecommunications misunderstanding representative notwithstanding straightforward"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n random strings (label 1) and n ordinary identifiers (label 0): columns s, label.

    Random ones are digests written as hex, base64 or in base 36, or letters alone; ordinary ones
    join two to five words in the usual styles, some with a short number, or are long words of
    other languages, or rules of one mark or digit. All derive from row numbers, so that the
    sample is the same in every run.
    """
    seed = F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 256)
    raw64 = F.regexp_replace(F.base64(F.unhex(seed)), "=+$", "")
    base36 = F.concat(*[F.conv(F.substring(seed, 1 + 12 * k, 12), 16, 36) for k in range(5)])
    twice = F.concat(raw64, F.base64(F.unhex(F.sha2(seed, 256))))
    letters = F.regexp_replace(twice, "[^A-Za-z]", "")
    case = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(3))
    alone = F.when(case == 0, letters).when(case == 1, F.lower(letters)).otherwise(F.upper(letters))
    random = F.when(F.col("id") % 5 == 4, alone).when(F.col("id") % 4 == 0, seed).when(F.col("id") % 4 == 1, F.upper(base36)).when(F.col("id") % 4 == 2, F.lower(base36)).otherwise(raw64)
    ones = spark.range(n).select(F.substring(random, 1, 40).alias("s"), F.lit(1).alias("label"))
    w = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    pick = lambda k: F.get(w, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))).cast("int"))
    parts = F.slice(F.array(*[pick(k) for k in range(5)]), 1, (2 + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4))).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(6))
    caps = F.array_join(F.transform(parts, F.initcap), "")
    name = (
        F.when(style == 0, F.array_join(parts, "_"))
        .when(style == 1, caps)
        .when(style == 2, F.upper(F.array_join(parts, "_")))
        .when(style == 3, F.array_join(parts, "-"))
        .when(style == 4, F.array_join(parts, "/"))
        .otherwise(F.array_join(parts, ""))
    )
    tail = F.when(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(3)) == 0, F.concat(F.lit("_"), F.pmod(F.xxhash64("id", F.lit(15)), F.lit(2100)).cast("string"))).otherwise("")
    other = F.split(F.lit(" ".join(LONG_WORDS)), " ")
    long = lambda k: F.get(other, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(LONG_WORDS))).cast("int"))
    foreign = F.concat(F.initcap(long(19)), F.when(F.col("id") % 2 == 0, long(21)).otherwise(F.concat(F.lit("-"), long(21))))
    rule = F.repeat(F.substring(F.lit("-_+/0x=*"), (F.pmod(F.xxhash64("id", F.lit(23)), F.lit(6)) + 1).cast("int"), F.lit(1)), 40)
    ordinary = F.when(F.col("id") % 10 == 7, foreign).when(F.col("id") % 200 == 8, rule).otherwise(F.concat(name, tail))
    zeros = spark.range(n).select(ordinary.alias("s"), F.lit(0).alias("label"))
    return ones.unionByName(zeros)


def fit_markov(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) of every pair of characters.

    ``samples`` has s and label (1 random, 0 identifier). Counts are summed per pair, at most
    (len(ALPHABET) + 1) squared rows, and smoothed by one. The list is read by
    index(a) * (len(ALPHABET) + 1) + index(b), with indices from 1, 0 for other characters. Without
    samples every ratio is 0.
    """
    m = len(ALPHABET) + 1
    pairs = samples.filter("length(s) >= 2").select("label", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
    pairs = pairs.select("label", F.expr(f"instr('{ALPHABET}', substring(s, i, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substring(s, i + 1, 1))").alias("b"))
    counts = {(r.label, r.a, r.b): r.n for r in pairs.groupBy("label", "a", "b").agg(F.count("*").alias("n")).collect()}
    out = []
    sums = {(label, a): sum(counts.get((label, a, b), 0) for b in range(m)) + m for label in (0, 1) for a in range(m)}
    for a in range(m):
        for b in range(m):
            p = [(counts.get((label, a, b), 0) + 1) / sums[label, a] for label in (0, 1)]
            out.append(round(math.log(p[1] / p[0]), 6))
    return out


def llr(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a transition of a string of two or more characters."""
    m = len(ALPHABET) + 1
    ratios = F.from_json(F.lit(str(table)), "array<double>")
    index = F.transform(F.split(run, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))

    def mean(x):
        pairs = F.transform(x, lambda a, i: F.get(ratios, a * m + F.get(x, i + 1)))
        return F.aggregate(F.array_compact(pairs), F.lit(0.0), lambda s, v: s + v) / (F.size(x) - 1)

    return let(index, mean)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, s>> of the leftmost matches that do not overlap, start in code points.

    The pieces between matches and the matches take turns, so lengths add up to positions. They
    are summed in blocks of about the square root of their number, so that n matches cost n ** 1.5.
    """
    both = F.struct(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def placed(x):
        n = F.size(x["hit"])
        lens = F.transform(x["hit"], lambda h, k: F.length(F.get(x["gap"], k)) + F.length(h))
        wide = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))

        def within(lens):
            sums = F.transform(upto(F.ceil(n / wide).cast("int")), lambda b: total(F.slice(lens, b * wide + 1, wide)))
            before = let(sums, lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))

            def made(before):
                first = lambda k: F.floor(k / wide).cast("int")
                start = lambda k: F.get(before, first(k)) + total(F.slice(lens, first(k) * wide + 1, k % wide)) + F.length(F.get(x["gap"], k))
                return F.transform(x["hit"], lambda h, k: F.struct(start(k).alias("start"), h.alias("s")))

            return let(before, made)

        return let(lens, within)

    return let(both, placed)


def _spans(text: Column, kind: str, order: int) -> Column:
    """array<struct<start, order, end, kind, s>> of a base kind's matches that are long enough."""
    value = lambda s: F.regexp_replace(s, ASSIGN_HEAD, "") if kind == "assign" else s
    found = F.filter(_matches(text, PATTERNS[kind]), lambda x: F.length(value(x["s"])) >= LEAST[kind])
    return F.when(text.rlike(HINT[kind]), F.transform(found, lambda x: _span(x, kind, order))).otherwise(_NONE())


def _span(x, kind: str, order: int) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + F.length(x["s"])).alias("end"), F.lit(kind).alias("kind"), x["s"].alias("s"))


def _NONE() -> Column:
    return F.array().cast("array<struct<start:int,order:int,end:int,kind:string,s:string>>")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Secrets of every whole text: array columns ``base`` and ``added`` of spans.

    A span has start, end (code points, end exclusive), kind and s, the matched text. Base
    kinds are the PATTERNS. ``markov`` spans are added: runs of CANDIDATE characters of at
    least CANDIDATE_LEAST, of whatever classes, whose mean log-likelihood ratio a
    transition is at least ``threshold``, unless they overlap a base span or are a UUID. The models are
    trained on ``samples`` (s, label 1 random or 0 identifier); the default is
    labelled_samples(). The scan has no shuffle: each text is judged where it is read.

    Null text counts as empty. One row per row of ``docs``, repeated ones too; an empty table
    gives an empty result.
    """
    table = fit_markov(samples if samples is not None else labelled_samples(docs.sparkSession))
    text = F.coalesce(F.col("t"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    base = base.withColumns({kind: _spans(text, kind, k) for k, kind in enumerate(PATTERNS)})
    base = base.withColumn("base", F.sort_array(F.concat(*PATTERNS)))

    def judged(found):
        whole = F.filter(found, lambda x: (F.length(x["s"]) >= CANDIDATE_LEAST) & ~x["s"].rlike(UUID))
        spans = F.transform(F.filter(whole, lambda x: llr(x["s"], table) >= threshold), lambda x: _span(x, "markov", len(PATTERNS)))
        return F.when(F.size("base") == 0, spans).otherwise(let(spans, clear))

    def clear(spans):
        # Most runs that are part of a base span end where it ends; those go by a set of ends, the others by looking at each base span.
        ends = F.array_except(F.transform(spans, lambda x: x["end"]), F.transform(F.col("base"), lambda y: y["end"]))
        return let(ends, lambda e: F.filter(spans, lambda x: F.array_contains(e, x["end"]) & ~F.exists(F.col("base"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))

    added = F.when(text.rlike(CANDIDATE_HINT), let(_matches(text, CANDIDATE), judged)).otherwise(_NONE())
    return base.withColumn("added", added).select("doc_id", "base", "added", *PATTERNS)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans of every document; null text counts as empty."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )
