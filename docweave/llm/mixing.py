"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_key, word_count

#: The schedule has about this many slots while blocks are below BLOCK_WORDS, and more beyond.
SLOTS = 1 << 18
BLOCK_WORDS = 4096
#: A source has this many blocks at least, and its target this many, as far as it has words.
LEAST_BLOCKS = 256
#: Rows of a run within which ranks and running sums are taken by one task.
RUN_ROWS = 2_000
MAX_REPEAT = 3
#: A longer list of sources is joined, not broadcast.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with weight and target.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share all sizes
    by weight; none is above MAX_REPEAT times its source's size, and what is over is shared by
    weight among the others, until none is above. In order of size per weight the sources at
    their limit come first, so one pass of running sums finds where they end.
    One row per source: the windows below hold the list of sources, not their documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEAT)
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    over = tight.rowsBetween(Window.unboundedPreceding, -1)
    rest = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(over), F.lit(0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level["level"], F.lit(0.0)) * F.col("weight")))
    return s.drop("cap", "level")


def source_blocks(targets: DataFrame, block: int) -> DataFrame:
    """``targets`` with n_blocks, the source's ranks (lo to hi, hi excluded) among those of all.

    A source is cut into equal blocks of its own: of ``block`` words at most, and so short that
    neither its words nor its target make fewer than LEAST_BLOCKS (or one a word). It has as many
    ranks as its target has of these blocks, so it is off its target by half a block at most.
    """
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.least("source_size", "target") / LEAST_BLOCKS)))
    t = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / own).cast("long"))
    t = t.withColumn("n", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    hi = F.sum("n").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return t.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("n")).drop("n")


def golden_step(n: int) -> int:
    """The number nearest the golden ratio's share of n that has no factor in common with it."""
    at = round(n * (math.sqrt(5) - 1) / 2)
    return next(x for d in range(n + 1) for x in (at + d, at - d) if 0 < x <= n and math.gcd(x, n) == 1)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17):
    """A mix of all documents in which each source has its target share of words.

    Returns (mix, sized). ``mix`` is the schedule joined to the blocks: slot, source, epoch,
    block, doc_key, doc_id, first_word, n_words: the words that each slot takes.
    ``sized`` has a row per row of ``docs``: doc_key, doc_id, key (of id, text and source),
    source, size, source_size, target. doc_key is unique within a source.

    A source's documents, shuffled by a hash, lie on a line of words that is cut into equal
    blocks of its own (source_blocks). Slot k of n is the point k * golden_step(n) mod n, so each
    point is met once; the points are mapped to sources through the cumulative numbers of ranks,
    and the rank of a slot among its source's slots names the block it takes. A rank beyond the
    last block begins the line anew, MAX_REPEAT times at most.
    Ranks and positions are sums over runs of at most about RUN_ROWS rows, so no source,
    however large, is ever sorted or held by one task.

    Null text has size 0. Null is a source of its own. Rows that repeat an id are separate.
    Documents without words are in ``sized`` only; an empty table gives two empty results.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _key(id_col, text_col, source_col).alias("key")
    )
    base = materialise(base.withColumn("h", F.xxhash64(F.lit(seed), F.col("key"))))
    total = base.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    block = max(1, min(BLOCK_WORDS, total.words // SLOTS))
    runs = max(1, -(-total.n // RUN_ROWS))
    targets = materialise(source_blocks(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), block))
    slots = targets.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("n")).first().n

    # Positions: running sums of runs (source, part of the hash), then within each run.
    placed = base.withColumn("run", F.shiftrightunsigned("h", 33) * F.lit(runs) / F.lit(1 << 31)).withColumn("run", F.floor("run"))
    in_run = Window.partitionBy("source", "run").orderBy("h", "key")
    placed = placed.withColumns({
        "pos": F.row_number().over(in_run),
        "at": F.sum("size").over(in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
    })
    starts = base.groupBy("source", F.floor(F.shiftrightunsigned("h", 33) * F.lit(runs) / F.lit(1 << 31)).alias("run")).agg(F.sum("size").alias("w"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source", "run", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    placed = _join_null_safe(placed, starts, ["source", "run"])
    placed = placed.withColumns({"start": F.col("at") + F.col("base"), "doc_key": F.struct("run", "pos")})
    # A hot source has a large share of the rows; the list of sources is broadcast while it is short.
    of_source = targets.select("source", "source_size", "target", "n_blocks", (F.col("hi") - F.col("lo")).alias("ranks"))
    placed = _join_null_safe(placed, F.broadcast(of_source) if targets.count() <= BROADCAST_SOURCES else of_source, ["source"])
    placed = materialise(placed.select("doc_key", "doc_id", "key", "source", "size", "source_size", "target", "start", "n_blocks", "ranks"))

    # Pieces of documents in blocks; block j begins at word j * source_size div n_blocks. Blocks that no rank takes are left out.
    block_of = lambda word: f"(({word} + 1) * n_blocks - 1) div source_size"
    pieces = placed.filter("size > 0").withColumn("first", F.expr(block_of("start"))).withColumn("last", F.least(F.expr(block_of("(start + size - 1)")), F.col("ranks") - 1))
    pieces = pieces.filter("first <= last").withColumn("block", F.explode(F.sequence("first", "last")))
    lo = F.greatest(F.col("start"), F.expr("block * source_size div n_blocks"))
    hi = F.least(F.col("start") + F.col("size"), F.expr("(block + 1) * source_size div n_blocks"))
    pieces = pieces.select("source", "block", "doc_key", "doc_id", (lo - F.col("start")).alias("first_word"), (hi - lo).alias("n_words"))

    # Slots to sources: an interval lookup as an equi-join on cells of the unit interval.
    cell = max(1, -(-slots // 1024))
    cells = targets.filter("hi > lo").select(
        "source", "lo", "hi", "n_blocks", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell")
    )
    k = F.col("slot")
    point = k * F.lit(golden_step(max(1, slots))) % F.lit(max(1, slots))
    sched = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", point.cast("long")).withColumn("cell", F.floor(F.col("u") / cell))
    sched = sched.join(cells, "cell").filter("u >= lo AND u < hi").withColumn("run", F.floor(k / RUN_ROWS))
    sched = sched.select("slot", "source", "n_blocks", "run")
    sums = sched.groupBy("source", "run").agg(F.count("*").alias("w"))
    sums = sums.select("source", "run", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    ranked = sched.withColumn("r", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    ranked = _join_null_safe(ranked, sums, ["source", "run"]).withColumn("r", F.col("r") + F.col("base"))
    ranked = ranked.filter(F.col("r") < F.col("n_blocks") * MAX_REPEAT)
    ranked = ranked.select("slot", "source", F.floor(F.col("r") / F.col("n_blocks")).alias("epoch"), (F.col("r") % F.col("n_blocks")).alias("block"))
    mix = _join_null_safe(ranked, pieces, ["source", "block"])
    return mix, placed.drop("start", "n_blocks", "ranks")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which null equals null."""
    r = right.select(*[F.col(c).alias(f"{c}__r") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    return left.join(r, on).drop(*[f"{c}__r" for c in keys])


def _key(id_col: str, text_col: str, source_col: str):
    return row_key(F.col(id_col), F.col(source_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def taken_words(docs: DataFrame, **columns) -> DataFrame:
    """One row per document: doc_id, key, size, source_size, target (its source's), taken (words the mix takes of it, repeats counted).

    Null and blank texts have size 0 and nothing taken; null is a source of its own. Rows that repeat
    id, source and text share one hash, so they follow each other in the schedule, each with
    words of its own; an empty table gives an empty result.
    """
    mix, sized = mix_sources(docs, **columns)
    per = mix.groupBy("source", "doc_key").agg(F.sum("n_words").alias("taken")).select(F.col("source").alias("s"), F.col("doc_key").alias("k"), "taken")
    out = sized.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("doc_key") == F.col("k")), "left")
    return out.select("doc_id", "key", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, to the nearest whole number.

    Only documents that a border of the schedule cuts are rounded: about two a source. Documents
    without words, null texts among them, are never taken. Rows that repeat id, text and source
    share the times that the mix takes them; an empty table gives an empty result.
    """
    taken = taken_words(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    times = taken.filter("taken > 0").groupBy("key").agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times")).filter("times > 0")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id_col, text_col, source_col).alias("key"))
    met = tagged.dropDuplicates(["key"]).join(times, "key")
    return met.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, as taken_words() has them."""
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")
