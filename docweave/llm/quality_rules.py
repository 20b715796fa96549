"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, materialise, words

EM_ROUNDS = 25
#: Documents of a posterior below this are dropped.
KEEP_AT = 0.5
#: Start of EM: share of good documents, and how often a rule abstains, votes bad and votes good on either
#: kind. Defects are rarer in good documents than merits in bad ones, so a bad vote begins with more weight.
PRIOR = 0.5
START = {"good": {-1: 0.30, 0: 0.02, 1: 0.68}, "bad": {-1: 0.30, 0: 0.40, 1: 0.30}}


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def windows(w):
        return F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(h):
        # Windows sorted by hash stand beside their equals; the positions of those with an equal, sorted
        # again, are intervals of three words whose union is counted.
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s):
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            hit = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j + 1)) | ((j > 0) & same(x, F.get(s, F.greatest(j - 1, F.lit(0))))), x["i"]))
            return F.sort_array(F.array_compact(hit))

        def union(p):
            return F.aggregate(
                p,
                F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
                lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
                lambda acc: acc["n"],
            )

        return let(by_hash, lambda s: let(again(s), union))

    return let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over every whole text, one row per row of ``docs``; null counts as empty, an empty table gives an empty result.

    Windows of three words are told by 64-bit hashes.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    left = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).withColumn("w", words(F.col("t")))
    base = base.withColumns({
        "word_chars": F.length(F.regexp_replace(text, WS, "")).cast("long"),
        "n_symbols": left("#*$%&|<>"),
        "n_upper": left("A-Z"),
        "n_marks": left("!?"),
        "lines": let(lines(text), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
        "words_": let(F.col("w"), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), _repeat_words(w).alias("r"))),
    })
    return base.select(
        "doc_id",
        F.col("words_.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.col("words_.r").alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.col("words_.d").cast("long").alias("n_distinct"),
        "n_upper",
        "n_marks",
    )


def votes() -> dict[str, Column]:
    """Each rule's vote on the measures: 1 good, 0 bad, null abstains. Two see merits, the others a defect each."""
    n, c = F.col("n_words"), F.col
    good = lambda x: F.when(x, F.lit(1)).cast("int")
    bad = lambda x: F.when(x, F.lit(0)).cast("int")
    return {
        "plain": good((20 * c("n_symbols") <= n) & (20 * c("n_marks") <= n) & (5 * c("n_upper") <= c("word_chars"))),
        "varied": good((20 * c("n_repeat_words") <= 3 * n) & (5 * c("n_dup_lines") <= c("n_lines"))),
        "word_length": bad((c("word_chars") < 2 * n) | (c("word_chars") > 20 * n)),
        "symbols": bad(10 * c("n_symbols") > n),
        "marks": bad(4 * c("n_marks") > n),
        "capitals": bad(10 * c("n_upper") > 3 * c("word_chars")),
        "same_lines": bad(10 * c("n_dup_lines") > 3 * c("n_lines")),
        "same_words": bad(20 * c("n_distinct") < F.least(n, F.lit(1000))),
        "repeats": bad(10 * c("n_repeat_words") > 3 * n),
    }


def fit_rules(voted: DataFrame, names: list[str], rounds: int = EM_ROUNDS) -> dict:
    """Shares and accuracies by expectation-maximisation over all rows of ``voted``.

    The documents meet in EM as counts of vote patterns: at most 3 to the number of rules,
    summed before the shuffle, whatever the number of documents. Each round is one fold of
    the pattern list; the whole fit is one expression, so equal counts give equal results. Without
    rows the prior is 0.5 and no vote has any weight.
    """
    cells = [(r, v) for r in range(len(names)) for v in (-1, 0, 1)]  # per rule: abstains, bad, good
    index = {cell: k for k, cell in enumerate(cells)}
    pattern = F.array(*[F.lit(3 * r) + F.coalesce(F.col(x), F.lit(-1)) + 1 for r, x in enumerate(names)])
    counted = voted.groupBy(pattern.alias("cells")).agg(F.count("*").cast("double").alias("n"))
    rows = counted.agg(F.sort_array(F.collect_list(F.struct("cells", "n"))).alias("patterns"))

    def start(kind: str):
        return F.array(*[F.lit(math.log(START[kind][v])) for _, v in cells])

    def posterior(state, x):
        side = lambda side: F.aggregate(x["cells"], F.lit(0.0), lambda a, i: a + F.get(state[side], i))
        odds = F.log(state["prior"]) - F.log(1 - state["prior"]) + side("good") - side("bad")
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))

    def step(state, patterns):
        # weight[k]: soft documents of either class that show cell k; slot 0 of the pair is good, 1 bad.
        def update(soft):
            total = lambda f: F.aggregate(soft, F.lit(0.0), lambda a, s: a + f(s))
            good, every = total(lambda s: s["g"]), total(lambda s: s["n"])

            def logs(part):
                size = total(part) + 3.0
                return F.transform(F.sequence(F.lit(0), F.lit(len(cells) - 1)), lambda k: F.log((F.aggregate(soft, F.lit(0.0), lambda a, s: a + F.when(F.array_contains(s["cells"], k), part(s)).otherwise(0.0)) + 1.0) / size))

            return F.struct(
                ((good + 1.0) / (every + 2.0)).alias("prior"),
                logs(lambda s: s["g"]).alias("good"),
                logs(lambda s: s["n"] - s["g"]).alias("bad"),
            )

        soft = F.transform(patterns, lambda x: F.struct(x["cells"].alias("cells"), x["n"].alias("n"), (x["n"] * posterior(state, x)).alias("g")))
        return let(soft, update)

    init = F.struct(F.lit(PRIOR).alias("prior"), start("good").alias("good"), start("bad").alias("bad"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), init, lambda s, _: step(s, F.col("patterns")))
    fit = rows.select(fitted.alias("fit")).first()["fit"]
    return {"prior": fit["prior"], "weights": {names[r]: {v: fit["good"][index[r, v]] - fit["bad"][index[r, v]] for v in (-1, 0, 1)} for r in range(len(names))}}


def label_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, votes and the posterior probability that a document is good.

    One row per row of ``docs``: the measures, ``base_failed`` (under 50 words, or more than
    half of them in repeated 3-word windows; EM learns from the others), a column ``vote_<rule>`` per rule, ``posterior``
    and ``kept``: false where the base fails, else whether the posterior reaches KEEP_AT.
    Null and blank texts have no words, so they fail the base. Repeated rows count each time
    they occur. An empty table gives an empty result.
    """
    measured = text_measures(docs, id_col, text_col)
    rules = votes()
    names = [f"vote_{x}" for x in rules]
    voted = materialise(measured.withColumns(dict(zip(names, rules.values(), strict=True))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fit = fit_rules(voted.filter(~failed), names)
    odds = F.lit(math.log(fit["prior"] / (1 - fit["prior"])))
    for x in names:
        w = fit["weights"][x]
        odds = odds + F.when(F.col(x) == 1, w[1]).when(F.col(x) == 0, w[0]).otherwise(w[-1])
    out = voted.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts of its words and lines, base_failed and kept of every document."""
    out = label_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
