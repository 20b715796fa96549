"""Entity resolution: ordered lookups, prefix lookups, fuzzy names, upserts that lose nothing."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.sources.scratch import cut


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of each key the row that comes first, nulls of ``order`` first; blank and null keys drop out. Combined before the shuffle."""
    known = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return known.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins: of each key the row that comes last. Combined before the shuffle, so a hot key costs a row a task."""
    found = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return found.select("__r.*")


def priority_lookup(rows: DataFrame, dim: DataFrame, keys: list[tuple[str, str]], values: list[str], order: list[Column], defaults: dict[str, object]) -> DataFrame:
    """Values of ``dim`` by the first key (row column, dim column) that is found, else defaults; adds source (its place).

    The dimension is made unique by each key before it is joined, so rows never multiply. Spark
    broadcasts it where it is small.
    """
    out = rows
    for k, (mine, theirs) in enumerate(keys):
        one = first_per_key(dim, theirs, order).select(F.col(theirs).alias(f"__k{k}"), *[F.col(v).alias(f"__{v}{k}") for v in values], F.lit(k + 1).alias(f"__s{k}"))
        out = out.join(one, F.col(mine) == F.col(f"__k{k}"), "left")
    found = F.coalesce(*[F.col(f"__s{k}") for k in range(len(keys))])
    pick = {v: F.coalesce(*[F.when(found == k + 1, F.col(f"__{v}{k}")) for k in range(len(keys))], F.lit(defaults[v])) for v in values}
    return out.select(*rows.columns, *[c.alias(v) for v, c in pick.items()], F.coalesce(found, F.lit(0)).alias("source"))


def prefix_lookup(rows: DataFrame, code: Column, dim: DataFrame, key: str, values: list[str], unknown: dict[str, object], lengths: tuple[int, ...] = (3, 2)) -> DataFrame:
    """Values of the longest prefix of ``code`` that ``dim`` holds (key unique), else unknown."""
    out = rows.withColumn("__code", code)
    for n in lengths:
        one = dim.select(F.col(key).alias(f"__p{n}"), F.struct(*values).alias(f"__v{n}"))
        out = out.join(one, F.substring("__code", 1, n) == F.col(f"__p{n}"), "left")
    best = F.coalesce(*[F.col(f"__v{n}") for n in lengths])
    return out.select(*rows.columns, *[F.when(best.isNotNull(), best[v]).otherwise(F.lit(unknown[v])).alias(v) for v in values])


def backfill(target: Column, source: Column) -> Column:
    """The source where the target is blank."""
    return F.when(target.isNull() | (F.trim(target.cast("string")) == ""), source).otherwise(target)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a value of ``new`` that is neither null nor blank wins, else the old one stays."""
    a, b = old.alias("a"), new.alias("b")
    cols = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    kinds = dict(old.dtypes)
    for c in old.columns:
        if c != key:
            fresh = F.when(F.trim(F.col(f"b.{c}")) != "", F.col(f"b.{c}")) if kinds[c] == "string" else F.col(f"b.{c}")
            cols.append(F.coalesce(fresh, F.col(f"a.{c}")).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: rows of ``old`` whose key ``new`` does not have, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``old``, and rows of ``new`` whose key (null equals null) is not there yet, once each."""
    fresh = new.dropDuplicates(keys).alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    return old.unionByName(fresh.join(old.alias("o"), on, "left_anti"))


def identifier_rows(entities: DataFrame, entity: str, kinds: dict[str, Column]) -> DataFrame:
    """One row per entity and identifier that is not blank: entity_id, id_type, id_value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("id_type"), c.cast("string").alias("id_value")) for k, c in kinds.items()])
    return entities.select(F.col(entity).alias("entity_id"), F.explode(pairs).alias("x")).select("entity_id", "x.id_type", "x.id_value").filter("trim(id_value) <> ''")


#: Similarities at which names are tried before the least one: a name that has found one leaves.
STEPS = (0.95, 0.9, 0.8)
#: Above this similarity names have pairs of letters in common, and few candidates share a name's rarest ones.
PAIRS_FROM = 0.83


def _grams(c: Column, k: int) -> Column:
    """All parts of ``k`` characters, in order; none of a shorter string."""
    return F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def within(short: DataFrame, s: str, long: DataFrame, t: str, gram: int) -> DataFrame:
    """Pairs (s, t) of ``short`` (s) and ``long`` (t), both distinct, of which t holds s.

    s is looked up by that of its parts of ``gram`` characters which fewest t have, or whole if it
    is shorter; a part that none has ends the search.
    """
    small = [r.n for r in short.filter(F.length(s) < gram).select(F.length(s).alias("n")).distinct().collect()]  # at most gram - 1
    parts = long.select(t, F.explode(F.array_distinct(F.concat(*[_grams(F.col(t), k) for k in (gram, *small)]))).alias("g"))
    often = parts.groupBy("g").agg(F.count("*").alias("n"))
    own = short.select(s, F.explode(F.array_distinct(F.when(F.length(s) < gram, F.array(s)).otherwise(_grams(F.col(s), gram)))).alias("g"))
    rarest = own.join(often, "g", "left").groupBy(s).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).filter("m.n > 0").select(s, F.col("m.g").alias("g"))
    return rarest.join(parts, "g").filter(F.contains(t, s)).select(s, t)


def containing(asked: DataFrame, known: DataFrame, gram: int = 4) -> DataFrame:
    """Pairs (a_n, b_n) of ``asked`` (a_n) and ``known`` (b_n), both distinct, of which one holds the other."""
    return within(asked, "a_n", known, "b_n", gram).unionByName(within(known, "b_n", asked, "a_n", gram).select("a_n", "b_n")).distinct()


def near_pairs(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (a_n, b_n) that hold all whose Ratcliff-Obershelp ratio is ``least`` or more, and few others.

    With s letters in both, a ratio of t needs t s / 2 matched ones, so as many letters (with
    repeats) in common. Matched runs are parted by letters that are not, (1 - t) s at most, so
    (1.5 t - 1) s - 1 pairs of neighbours are in common as well. Two sets with k members in common
    share one of the first n - k + 1 of each in any one order of all members; in order of frequency,
    these are the rarest. s is at its least where the other's length is, t / (2 - t) times the own.
    Names of which no common pair is asked are left out: for them least is below PAIRS_FROM at last.
    """
    k = 2 if least > PAIRS_FROM else 1
    slope, gap = (1.5 * least - 1, 1) if k == 2 else (least / 2, 0)

    def tokens(df: DataFrame, c: str) -> DataFrame:
        size = F.length(c)
        common = F.ceil(slope * (size + F.ceil(size * least / (2 - least) - 1e-9)) - gap - 1e-9)
        parts = _grams(F.col(c), k)
        nth = F.transform(parts, lambda x, i: F.concat(x, F.size(F.filter(F.slice(parts, 1, i + 1), lambda y: y == x)).cast("string")))
        return df.select(c, common.alias("common"), F.size(parts).alias("n"), F.explode(nth).alias("g"))

    mine, theirs = tokens(asked, "a_n").filter("common > 0"), tokens(known, "b_n")
    often = theirs.groupBy("g").agg(F.count("*").alias("f"))

    def rarest(df: DataFrame, c: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(c).orderBy(F.coalesce("f", F.lit(0)), "g"))
        ranked = df.join(often, "g", "left").withColumn("place", place)
        return ranked.filter(F.col("f").isNotNull() & (F.col("place") <= F.col("n") - F.greatest("common", F.lit(1)) + 1)).select(c, "g")

    pairs = rarest(mine, "a_n").join(rarest(theirs, "b_n"), "g")
    return pairs.filter(2 * F.least(F.length("a_n"), F.length("b_n")) >= (least - 1e-9) * (F.length("a_n") + F.length("b_n"))).select("a_n", "b_n").distinct()


#: Names that may lose more characters than this to one as near are not looked up by what is left of them.
MOST_LOST = 2


def lost(n: Column, least: float) -> Column:
    """How many of its ``n`` characters a name can have unmatched in a pair whose ratio is ``least`` or more.

    i of a name's and j of the other's are unmatched where i + j is at most 1 - least of both lengths, n and
    n - i + j; i is at its most without j.
    """
    return F.floor(2 * n * (1 - least) / (2 - least) + 1e-9)


def left_pairs(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs of near_pairs() between names that lose MOST_LOST characters or fewer, by equality of what is left of both.

    Matched runs are in the same order in both names, so without their unmatched characters they
    are equal. A name has a fixed number of ways to lose so few, so rows grow with the names, however
    much these have in common.
    """
    drop = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))

    def variants(df: DataFrame, c: str) -> DataFrame:
        n, ways = lost(F.length(c), least), [F.array(F.col(c))]
        for _ in range(MOST_LOST):
            ways.append(F.array_distinct(F.flatten(F.transform(ways[-1], drop))))
        left = F.when(n < 1, ways[0])
        for k in range(1, MOST_LOST + 1):
            left = left.when(n == k, F.concat(*ways[: k + 1]))
        return df.select(c, F.explode(left).alias("left"))

    both = F.length("a_n") + F.length("b_n")
    met = variants(asked, "a_n").join(variants(known, "b_n"), "left")
    return met.filter(both - 2 * F.length("left") <= (1 - least) * both + 1e-9).select("a_n", "b_n").distinct()


def close_pairs(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (a_n, b_n), both distinct, that hold all whose ratio is ``least`` or more: by what is left of short names, by near_pairs() where either is long."""
    few = lambda df, c: (df.filter(lost(F.length(c), least) <= MOST_LOST), df.filter(lost(F.length(c), least) > MOST_LOST))
    (short, long), (mine, theirs) = few(asked, "a_n"), few(known, "b_n")
    return left_pairs(short, mine, least).unionByName(near_pairs(long, known, least)).unionByName(near_pairs(short, theirs, least))


def ratios(pairs: DataFrame, least: float) -> DataFrame:
    """a_n, b_n and score of the pairs whose Ratcliff-Obershelp ratio is ``least`` or more; cheap upper bounds come first."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found, m = [], difflib.SequenceMatcher()
            for b, part in p.groupby("b_n", sort=False).a_n:
                m.set_seq2(b)
                for a in part:
                    m.set_seq1(a)
                    if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := m.ratio()) >= least:
                        found.append((a, b, r))
            yield pd.DataFrame(found, columns=["a_n", "b_n", "score"]).astype({"score": float})

    return pairs.mapInPandas(scored, "a_n string, b_n string, score double")


def fuzzy_match(names: DataFrame, name: str, candidates: DataFrame, candidate: str, least: float = 0.72, order: list[Column] | None = None, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """The candidate closest to each different name: name, match, score; none below ``least``.

    Normalised names that are equal or contain each other score 1, others by Ratcliff-Obershelp; of
    equal scores (0.99 and more counts as one) the candidate that comes first in ``order``
    wins, by default its name. Both sides are made distinct. Candidates meet a name by the exact
    filters of containing() and close_pairs(), in ``steps`` from the highest similarity
    down: a name that has found one at a step has seen all that are as near, and leaves. No
    match is lost at any size. Null names, and those of which nothing is left, match nothing.
    """
    tidy = lambda df, c, tag, *more: df.select(F.col(c).alias(tag), *more).filter(F.col(tag).isNotNull()).withColumn(f"{tag}_n", X.company_name(F.col(tag))).filter(F.col(f"{tag}_n") != "")
    left = tidy(names.select(name).distinct(), name, "a")
    right = tidy(candidates, candidate, "b", F.struct(*(order or [F.col(candidate)])).alias("o"))
    right = cut(right.groupBy("b_n").agg(F.min(F.struct("o", "b")).alias("r")).select("b_n", "r.o", "r.b"))
    rest = cut(left.select("a_n").distinct())
    best = None
    for at in (None, *[x for x in steps if x > least], least):
        known = right.select("b_n")
        pairs = containing(rest, known).withColumn("score", F.lit(1.0)) if at is None else ratios(close_pairs(rest, known, at), at)
        rank = F.struct(F.when(F.col("score") >= 0.99, -1.0).otherwise(-F.col("score")).alias("s"), "o")
        here = cut(pairs.join(right, "b_n").groupBy("a_n").agg(F.min_by(F.struct("b", "score"), rank).alias("m")).select("a_n", "m.b", "m.score"))
        best = here if best is None else best.unionByName(here)
        rest = cut(rest.join(here, "a_n", "left_anti"))
        if rest.isEmpty():
            break
    return left.join(best, "a_n").select(F.col("a").alias(name), F.col("b").alias("match"), F.bround("score", 6).alias("score"))


def fuzzy_enrich(rows: DataFrame, name: str, dim: DataFrame, dim_name: str, exact: tuple[str, str], values: list[str], least: float = 0.72) -> DataFrame:
    """``rows`` with ``values`` of ``dim`` (each dim name once): by the exact key (row column, dim column), else by the closest name.

    Only rows that the exact key leaves open are matched by name, and each different name once;
    the match's values are then looked up by its name. Adds how: exact, fuzzy or null.
    """
    mine, theirs = exact
    by_key = first_per_key(dim, theirs, [F.col(dim_name)]).select(F.col(theirs).alias("__k"), F.struct(*values).alias("__e"))
    tried = rows.join(by_key, F.col(mine) == F.col("__k"), "left").drop("__k")
    open_ = tried.filter(F.col("__e").isNull()).select(name).distinct()
    near = fuzzy_match(open_, name, dim, dim_name, least).select(F.col(name).alias("__n"), F.col("match").alias("__m"))
    found = near.join(first_per_key(dim, dim_name, [F.col(theirs)]).select(F.col(dim_name).alias("__m"), F.struct(*values).alias("__f")), "__m").drop("__m")
    out = tried.join(found, F.col("__e").isNull() & (F.col(name) == F.col("__n")), "left")
    how = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__f").isNotNull(), "fuzzy")
    return out.select(*rows.columns, *[F.coalesce(F.col("__e")[v], F.col("__f")[v]).alias(v) for v in values], how.alias("how"))


def resolve_chain(queries: DataFrame, query: str, steps: list[tuple]) -> DataFrame:
    """Each query's entity by the first step that finds it: query, entity_id, step.

    A step is (name, table, value column, id column); these meet on equal upper-case values. With
    a fifth item (least, cut), the value has to hold the first ``cut`` characters of the query,
    which has ``least`` or more; cut None is all of it. Such a step tries only queries that those
    before leave open. Ties go to the least id.
    """
    rest = queries.select(F.col(query).alias("q"), F.upper(F.trim(F.col(query))).alias("u")).distinct()
    found = None
    for step, dim, value, entity, *part in steps:
        one = dim.select(F.upper(F.trim(F.col(value))).alias("v"), F.col(entity).cast("string").alias("entity_id")).groupBy("v").agg(F.min("entity_id").alias("entity_id"))
        here = _holding(rest, one, *part[0]) if part else rest.join(one, F.col("u") == F.col("v")).select("q", "entity_id")
        here = here.withColumn("step", F.lit(step))
        found = here if found is None else found.unionByName(here)
        rest = rest.join(here.select("q"), "q", "left_anti")
    return found.unionByName(rest.select("q", F.lit(None).cast("string").alias("entity_id"), F.lit("unresolved").alias("step"))).withColumnRenamed("q", query)


def _holding(q: DataFrame, names: DataFrame, least: int, cut: int | None, gram: int = 8) -> DataFrame:
    """q, entity_id: the least entity whose name holds the query. They meet on the part of ``gram`` characters of the query that fewest names have, or all if it is shorter."""
    part = q.filter(F.length("u") >= max(least, 1)).select("q", (F.substring("u", 1, cut) if cut else F.col("u")).alias("u"))
    known = names.filter("v IS NOT NULL")
    hits = within(part.select("u").distinct(), "u", known.select("v"), "v", gram).join(known, "v").groupBy("u").agg(F.min("entity_id").alias("entity_id"))
    return part.join(hits, "u").select("q", "entity_id")


def resolve_scope(direct: DataFrame, resolved: DataFrame, corpus: DataFrame, registry: DataFrame) -> DataFrame:
    """q, profile, entity_id, source of a scope: profiles given directly, and those that chains resolved (q, profile, step).

    A profile's entity is the corpus's own (profile, entity_id), else the registry's, else
    ``unregistered:`` and the profile. Unresolved queries are left out; of a profile's entities the
    least counts.
    """
    every = direct.select(F.col("profile").alias("q"), "profile", F.lit("direct").alias("source"))
    every = every.unionByName(resolved.filter("profile IS NOT NULL").select("q", "profile", F.col("step").alias("source")))
    for name, known in (("__c", corpus), ("__r", registry)):
        one = known.filter("trim(entity_id) <> ''").groupBy("profile").agg(F.min("entity_id").alias(name))
        every = every.join(one, "profile", "left")
    return every.select("q", "profile", F.coalesce("__c", "__r", F.concat(F.lit("unregistered:"), "profile")).alias("entity_id"), "source")


#: Names of fewer characters are not looked up in texts.
LEAST_NAME = 4


def contains_lookup(rows: DataFrame, text: str, dim: DataFrame, name: str, entity: str, gram: int = 8, fold: Callable[[Column], Column] = F.upper) -> DataFrame:
    """Rows with the least entity whose upper-case name (LEAST_NAME characters or more) the text contains.

    ``fold`` makes names and texts comparable where upper case is not wanted.

    A name is looked up by its first ``gram`` characters, a shorter one by its first LEAST_NAME,
    among those of the text's positions: an equi-join, then an exact test; names are never tried
    on all rows. Names that share their first characters meet the same rows, so ``gram`` should
    tell most names apart.
    """
    n = dim.select(fold(F.trim(F.col(name))).alias("__n"), F.col(entity).alias("__e")).filter(F.length("__n") >= min(gram, LEAST_NAME)).groupBy("__n").agg(F.min("__e").alias("__e"))
    n = n.withColumn("__g", F.when(F.length("__n") >= gram, F.substring("__n", 1, gram)).otherwise(F.substring("__n", 1, LEAST_NAME)))
    # Digests of grams travel with two hashes of the text, not with the text; texts that may hold a name are fetched by their hashes.
    folded = fold(F.coalesce(F.col(text), F.lit("")))
    tagged = rows.withColumns({"__u": folded, "__h": F.xxhash64(folded), "__i": F.xxhash64(F.lit(1), folded)})
    names = n.select("__n", "__e", "__g").mapInPandas(_first_gram, "__n string, __e " + n.schema["__e"].dataType.simpleString() + ", __d long")
    sizes = sorted({gram, min(gram, LEAST_NAME)})
    probe = tagged.select("__h", "__i", "__u").mapInPandas(lambda batches: _all_grams(batches, sizes), "__h long, __i long, __d array<long>").select("__h", "__i", F.explode("__d").alias("__d"))
    may = probe.join(names, "__d").select("__h", "__i", "__n", "__e").distinct()
    hits = tagged.select("__h", "__i", "__u").join(may, ["__h", "__i"]).filter(F.contains(F.col("__u"), F.col("__n")))
    hits = hits.groupBy("__h", "__i").agg(F.min("__e").alias("entity_id"))
    return tagged.join(hits, ["__h", "__i"], "left").drop("__h", "__i", "__u")


#: A fixed odd factor, and texts whose digests leave a task at once.
_FACTOR, _TEXTS = 0x9E3779B97F4A7C15, 64


def gram_digests(text: str, k: int) -> np.ndarray:
    """64-bit digests of the parts of ``k`` characters, in order, by halves: time in proportion to the text, for any k."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(chars) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    power = lambda m: np.uint64(pow(_FACTOR, m, 1 << 64))
    run, size, out, done = (chars + np.uint64(1)) * power(3), 1, np.zeros(n, np.uint64), 0
    while done < k:
        if (k - done) & size:
            out = out * power(size) + run[done : done + n]
            done += size
        if done < k:
            run = run[:-size] * power(size) + run[size:]
            size *= 2
    return out.view(np.int64)


def _first_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[["__n", "__e"]].assign(__d=[int(gram_digests(g, len(g))[0]) for g in b["__g"]])


def _all_grams(batches: Iterator[pd.DataFrame], sizes: list[int]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), _TEXTS):
            some = b.iloc[lo : lo + _TEXTS]
            yield some[["__h", "__i"]].assign(__d=[np.unique(np.concatenate([gram_digests(t, k) for k in sizes])) for t in some["__u"]])
