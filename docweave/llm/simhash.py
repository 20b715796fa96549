"""SimHash near-dedup over a Gray-order hierarchical index of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key, store

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
#: A bucket of more fingerprints than this is split by further bits instead of being indexed by one task.
BUCKET = 4096
FANOUT = 8
_BLOCK = 1 << 14
_PAIRS = 1 << 18


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text as an unsigned number; zero if it has no words."""
    w = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    joined = memoryview(b" ".join(w))
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    k = min(SHINGLE, len(w))
    h64 = xxhash.xxh64_intdigest
    pairs = zip(start[: len(w) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    h = np.fromiter((h64(joined[a:b], SEED) for a, b in pairs), np.uint64, len(w) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[i : i + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, fp (the 64 bits as a signed long), a row per row of ``docs``; key stands for id and text."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "key": b.key, "fp": np.array([fingerprint(t) for t in b.text], np.uint64).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    own = _key(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), own.alias("key"), F.col(text_col).alias("text")).mapInPandas(marked, f"doc_id {kind}, key string, fp long")


def _key(doc_id: Column, text: Column) -> Column:
    return row_key(doc_id, F.xxhash64(F.coalesce(text, F.lit(""))))


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in Gray order, in which neighbours differ in one bit."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def near_links(bucket: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), j the least linked place, that connect fingerprints of one bucket at DISTANCE or less.

    ``bucket`` numbers the buckets, in runs; within one, ``fps`` (unsigned) are in Gray order.
    Each FANOUT neighbours form a node with the bits that all share (mask) and their values
    (pattern), level by level up to one root a bucket. Pairs of nodes are followed from the
    roots down; a pair whose shared bits already differ in more than DISTANCE places is pruned
    with all that is below it.
    """
    n = len(fps)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(fps, np.full(n, ones), None)]
    group = bucket
    while len(group) and (group[1:] == group[:-1]).any():
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        at = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        start = np.flatnonzero(at % FANOUT == 0)
        pat, mask, _ = levels[-1]
        head = np.repeat(pat[start], np.diff(np.append(start, len(group))))
        levels.append((pat[start], np.bitwise_and.reduceat(mask & ~(pat ^ head), start), np.append(start, len(group))))
        group = group[start]
    label = np.arange(n)
    roots = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > _PAIRS:
            stack += [(depth, a[k : k + _PAIRS], b[k : k + _PAIRS]) for k in range(0, len(a), _PAIRS)]
            continue
        if depth == 0:
            _unite(label, a, b)
            continue
        starts = levels[depth][2]
        wide_a, wide_b = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
        many = wide_a * wide_b
        pair = np.repeat(np.arange(len(a)), many)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        i, j = starts[a[pair]] + k // wide_b[pair], starts[b[pair]] + k % wide_b[pair]
        pat, mask, _ = levels[depth - 1]
        differ = np.bitwise_count((pat[i] ^ pat[j]) & mask[i] & mask[j])
        keep = (differ <= DISTANCE) & ((i < j) if depth == 1 else (i <= j))
        if keep.any():
            stack.append((depth - 1, i[keep], j[keep]))
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let label name the least place of each component, with the links a-b added."""
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _split(bits: int) -> list[int]:
    """Masks of DISTANCE + 1 runs of the free bits outside ``bits``, each joined with ``bits``."""
    free = [k for k in range(BITS) if not bits >> k & 1]
    parts = np.array_split(np.array(free), DISTANCE + 1)
    return [bits | sum(1 << int(k) for k in p) for p in parts if len(p)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def link_fingerprints(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a > b as signed numbers, that connect all pairs at DISTANCE or less.

    ``fps`` has the column fp, without repeats. Of DISTANCE + 1 runs of bits, a near pair has
    one in common; fingerprints are dealt to a bucket for each run and its value, an upper
    node of the index. A bucket above ``bucket`` rows is never given to one task: its rows go
    to the next level, where a run of the bits that are still free is added to what a bucket
    shares, by the same argument without loss. After a few levels too few bits are left for a
    bucket to be larger. Within a bucket, near_links() follows the index; links found are at
    most one a fingerprint and bucket. ``bucket`` is 16 or more.
    """
    spark = fps.sparkSession

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            same = (rest["mask"] == rest["mask"].iloc[-1]) & (rest.val == rest.val.iloc[-1])
            whole, rest = rest[~same], rest[same]
            yield from links(whole)
        if rest is not None:
            yield from links(rest)

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows) > 1:
            m, v, f = (rows[c].to_numpy() for c in ("mask", "val", "fp"))
            group = np.concatenate(([0], np.cumsum((m[1:] != m[:-1]) | (v[1:] != v[:-1]))))
            i, j = near_links(group, f.view(np.uint64))
            yield pd.DataFrame({"a": np.maximum(f[i], f[j]), "b": np.minimum(f[i], f[j])})

    found = None
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    masks = [0]
    while True:
        finer = {m: _split(m) for m in masks}
        to = F.coalesce(*[F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(x)).cast("long") for x in xs])) for m, xs in finer.items()])
        rows = rows.select("fp", F.explode(to).alias("mask")).withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
        if len(masks) > 1:
            rows = rows.distinct()
        masks = sorted({x for xs in finer.values() for x in xs})
        hot = materialise(rows.groupBy("mask", "val").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("mask", "val"))
        more = not hot.isEmpty()
        small = rows.join(hot, ["mask", "val"], "left_anti") if more else rows
        dealt = small.repartition("mask", "val").sortWithinPartitions("mask", "val", gray_rank(F.col("fp")))
        here = dealt.select("mask", "val", "fp").mapInPandas(linked, "a long, b long")
        found = here if found is None else found.unionByName(here)
        if not more:
            return materialise(found.distinct())
        rows = materialise(rows.join(hot, ["mask", "val"], "left_semi").select("fp", "mask"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), root the least node that it reaches.

    Large-star and small-star steps in turn, until nothing changes: about log(n) rounds, each
    of grouped minima, which Spark combines before the shuffle, and joins that it can split at
    a node with many links. The links never grow in number. Lineage is cut each round.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialise(small.filter("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, key, fp and component_id (least id reachable over links), a row per row of ``docs``.

    Fingerprints at DISTANCE or fewer differing bits are linked; equal ones are one node from
    the start, so copies cost nothing in the index. Null, empty and blank texts have fingerprint
    zero and link like any other. A null id reaches and is reached, but names a component only
    if it has no other id. Repeated rows stay; an empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, id_col, text_col))
    least = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_fingerprints(least.select("fp"), bucket))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    # As a table of its own, so that both sides of the last join are plain shuffles and a hot fingerprint can be split.
    per = store(named.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"))
    return marked.join(per, F.col("fp") == F.col("f")).select("doc_id", "key", "fp", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the row of the smallest id, with all its columns.

    Of rows that repeat id and text one stays; null, empty and blank texts are one group; an empty
    table gives an empty result.
    """
    near = near_duplicates(docs, id_col, text_col)
    group = F.when(F.col("component_id").isNull(), F.col("fp").cast("string")).otherwise(F.col("component_id").cast("string"))
    kept = near.groupBy(group.alias("g")).agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k")).select("k")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col(id_col), F.col(text_col)).alias("k"))
    return tagged.join(kept, "k", "left_semi").dropDuplicates(["k"]).select("row.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; texts without words have fingerprint zero."""
    near = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
