"""MinHash near-dedup: banded candidates, odd sketches of the samples, exact sets for what they leave open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, shuffles_removed, store, table
from .simhash import components

WORDS, PERCENT = 5, 85
#: A sample of BANDS * ROWS minima; two sets meet if all minima of a band agree.
BANDS, ROWS = 32, 5
SAMPLE = BANDS * ROWS
#: Bits of the odd sketch, in numbers of 64.
LANES = 8
BITS = 64 * LANES
#: A sketch refutes a pair only if one at the threshold would differ as much with less than this probability.
RISK = 1e-9
#: More representatives than this are joined with the texts by a shuffle, not broadcast.
BROADCAST_IDS = 200_000
_BLOCK = 1 << 12
_WORDS_KEPT = 1 << 18

_rng = np.random.default_rng(12)
_FACTORS = _rng.integers(0, 1 << 63, SAMPLE, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio, odd


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A hash of h and x, number by number."""
    h = (h ^ x) * _MIX
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    """XXH64 by word, remembered up to _WORDS_KEPT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Different shingles of a whole text as sorted 64-bit digests; with fewer words the whole sequence; none without words."""
    w = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mixed(h, each[j : len(w) - k + 1 + j])
    return np.unique(_mixed(h, np.uint64(words)))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of SAMPLE permutations of the shingles."""
    out = np.full(SAMPLE, ~np.uint64(0))
    for lo in range(0, len(shingles), _BLOCK):
        np.minimum(out, (shingles[lo : lo + _BLOCK, None] * _FACTORS).min(0), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """A digest of each band of each row of minima."""
    rows = samples.reshape(len(samples), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        h = _mixed(h, rows[:, :, k])
    return h


def whole_sketch(shingles: np.ndarray) -> np.ndarray:
    """LANES numbers of a whole set: each shingle chooses one of BITS bits. Two sets differ in as many shingles as sketches in bits, or more."""
    odd = np.bincount(((shingles >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """LANES numbers a row of minima: a minimum and its place choose one of BITS bits, and a bit is set if chosen an odd number of times."""
    at = (_mixed(np.broadcast_to(np.arange(SAMPLE, dtype=np.uint64), samples.shape), samples) >> np.uint64(40)) % np.uint64(BITS)
    n = len(samples)
    odd = np.bincount((np.arange(n)[:, None] * BITS + at.astype(np.int64)).ravel(), minlength=n * BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, BITS), axis=1).view(np.uint64)


@cache
def most_bits(percent: int) -> int:
    """Bits in which two sketches differ, but for RISK, if the sets have this similarity or more.

    Each of SAMPLE minima differs with probability 1 - J, on its own, and if it does, changes two
    bits at random. The number of odd bits after each change is a chain whose distribution is
    followed step by step.
    """
    p, now, tail = 1 - percent / 100, np.eye(1, BITS + 1)[0], np.zeros(BITS + 1)
    weight = (1 - p) ** SAMPLE
    for d in range(SAMPLE + 1):
        tail += weight * now
        weight *= (SAMPLE - d) / (d + 1) * p / (1 - p)
        for _ in range(2):
            z = np.arange(BITS + 1)
            now = np.concatenate(([0], (now * (BITS - z) / BITS)[:-1])) + np.concatenate(((now * z / BITS)[1:], [0]))
    return int(np.flatnonzero(np.cumsum(tail[::-1])[::-1] > RISK)[-1])


def _key(doc_id: Column, text: Column) -> Column:
    return row_key(doc_id, F.xxhash64(F.coalesce(text, F.lit(""))))


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, digest (128 bits of the set), bands and sketch (of the sample, then of the whole set), a row per row of ``docs``; the last three are null without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            for lo in range(0, len(b), _BLOCK):
                yield of(b.iloc[lo : lo + _BLOCK], hashes)

    def of(b: pd.DataFrame, hashes: dict) -> pd.DataFrame:
        n, digest, samples, whole = [], [], np.empty((len(b), SAMPLE), np.uint64), np.empty((len(b), LANES), np.uint64)
        for i, t in enumerate(b.text):
            s = shingle_set(t, hashes)
            n.append(len(s))
            digest.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            samples[i], whole[i] = minima(s), whole_sketch(s)
        some = np.array(n) > 0
        keep = lambda rows: [r if x else None for r, x in zip(rows.view(np.int64), some, strict=True)]
        return pd.DataFrame({"doc_id": b.doc_id, "key": b.key, "n_shingles": n, "digest": digest, "bands": keep(bands(samples)), "sketch": keep(np.hstack([odd_sketches(samples), whole]))})

    own = _key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), own.alias("key"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(marked, f"doc_id {kind}, key string, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """c and shingles (array<long>) of the classes ``wanted`` (c, key), from the text of one row each."""
    own = _key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(own.alias("key"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(wanted) if few else wanted, "key").select("c", "text")

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for b in batches:
            for lo in range(0, len(b), 256):
                some = b.iloc[lo : lo + 256]
                yield pd.DataFrame({"c": some.c, "shingles": [shingle_set(t, hashes).view(np.int64) for t in some.text]})

    return store(rows.mapInPandas(built, "c long, shingles array<long>").dropDuplicates(["c"]))


def _differing(a: str, b: str, at: int) -> Column:
    lanes = [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(at, at + LANES)]
    return sum(lanes[1:], lanes[0])


def _may_be(percent: int) -> Column:
    """Whether sizes and sketches of a member (n, sketch) and a leader (ln, lsketch) leave this similarity open.

    Sketches of whole sets refute without error, and almost all pairs below the threshold while sets
    have some hundreds of shingles; those of samples serve sets of any size.
    """
    sizes = 100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")
    whole = (100 + percent) * _differing("sketch", "lsketch", LANES) <= (100 - percent) * (F.col("n") + F.col("ln"))
    return sizes & whole & (_differing("sketch", "lsketch", 0) <= most_bits(percent))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets (c, shingles) reach the threshold."""
    one = sets.select(F.col("c").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("c").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.filter(100 * F.col("common") >= percent * (F.size("s") + F.size("t") - F.col("common"))).select("a", "b")


def _folded(dealt: DataFrame) -> DataFrame:
    """bucket and m, the number of its members, of ``dealt`` (bucket, c): no bucket of one class, and of buckets of the same classes one."""
    each = dealt.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y"))
    return each.filter("m > 1").groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "m")


def _divided(live: DataFrame) -> DataFrame:
    """Of ``live`` the buckets whose members are of two components or more."""
    divided = live.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("d")).filter("d").select("bucket")
    return live.join(store(divided), "bucket")


def rare_buckets(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``live`` dealt anew: a bucket for each shingle that is among the rarest of two or more classes.

    A pair of sizes n and m at the threshold has percent / (100 + percent) * (n + m) shingles or more in
    common. With m at its least in the buckets of a class, n less that many and one more are its
    prefix: in one order of all shingles, two classes at the threshold share one of their prefixes.
    In order of frequency among the live classes, a class whose prefix is its own is near none.
    """
    least = live.join(live.groupBy("bucket").agg(F.min("n").alias("least")), "bucket").groupBy("c").agg(F.min("n").alias("n"), F.min("least").alias("least"))
    common = F.ceil(percent * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100))) / (100 + percent))
    size = store(least.select("c", (F.col("n") - common + 1).alias("prefix")))
    each = store(sets.join(size, "c").select("c", "prefix", F.explode("shingles").alias("h")))
    known = each.join(each.groupBy("h").agg(F.count("*").alias("k")), "h")
    place = F.row_number().over(Window.partitionBy("c").orderBy("k", "h"))
    dealt = store(known.withColumn("place", place).filter("place <= prefix AND k > 1").select("c", F.col("h").alias("bucket")))
    members = live.groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("weight").alias("weight"), F.first("root").alias("root"))
    return dealt.join(store(_folded(dealt).select("bucket")), "bucket").join(members, "c").select(*live.columns)


def link_classes(classes: DataFrame, docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) of all linked classes of ``classes`` (c, key, n, bands, sketch), root the least c that a class reaches.

    Classes that agree in a band share a bucket. A round compares every member of a bucket with
    the bucket's leaders. Sketches refute what they can, full sets decide the rest, and
    components follow the links. Then leaders leave their buckets, for all their pairs are done,
    and so do buckets whose members are all of one component. In the first round the leader is the member that
    shares most buckets with most classes, so that a group of near copies costs one comparison
    a member, not one a pair. What is still apart is then dealt to buckets of rare shingles, an
    exact filter, in which members that are near none have no bucket. Later rounds have
    16, 256, ... leaders a bucket, each from its range of a hash, those outside the largest component first.
    A pair at the threshold is missed with a probability of (1 - J^ROWS)^BANDS, below 1e-8 at 0.85
    and 4e-6 at 0.80, and of RISK.
    """
    dealt = classes.select("c", F.explode("bands").alias("bucket"))
    many = store(dealt.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"))
    dealt = store(dealt.join(many, "bucket"))
    own = store(classes.join(dealt.groupBy("c").agg(F.sum("m").alias("weight")), "c").select("c", "key", "n", "sketch", "weight"))
    live = store(dealt.join(store(_folded(dealt).select("bucket")), "bucket").select("bucket", "c").join(own.drop("key"), "c").withColumn("root", F.col("c")))
    sets = full_sets(docs, own.select("c", "key"), id_col, text_col)
    links, roots, ranges = None, None, 1
    while not live.isEmpty():
        main = live.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "c", "root")).alias("s")).select("bucket", F.col("s.root").alias("main"))
        order = F.struct((F.col("root") == F.col("main")).alias("inside"), (-F.col("weight")).alias("w"), F.col("c").alias("l"), F.col("n").alias("ln"), F.col("sketch").alias("lsketch"), F.col("root").alias("lroot"))
        leaders = live.join(main, "bucket").groupBy("bucket", F.pmod(F.xxhash64("c", F.lit(ranges)), F.lit(ranges)).alias("r")).agg(F.min(order).alias("s"))
        leaders = store(leaders.select("bucket", "s.*"))
        pairs = live.join(leaders, "bucket").filter("c <> l AND root <> lroot").filter(_may_be(percent))
        pairs = store(pairs.select(F.least("c", "l").alias("a"), F.greatest("c", "l").alias("b")).distinct())
        new = store(confirmed(pairs, sets, percent))
        links = new if links is None else links.unionByName(new)
        with shuffles_removed(docs.sparkSession):
            roots = components(links)
        rest = live.drop("root").join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).drop("node")
        rest = store(_divided(store(rest.join(leaders.select("bucket", F.col("l").alias("c")), ["bucket", "c"], "left_anti"))))
        live = store(_divided(store(rare_buckets(rest, sets, percent)))) if ranges == 1 else rest
        ranges *= 16
    return roots if roots is not None else classes.select(F.col("c").alias("node"), F.col("c").alias("root")).limit(0)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, group and component_id (least id reachable over links), a row per row of ``docs``.

    Documents whose sets of five-word shingles have a Jaccard similarity of ``percent`` or more are
    linked; sets are told by 64-bit digests of shingles, and documents of equal sets are one class from
    the start. Without words a set is empty and linked with nothing: the document is its own
    component. group stands for the component where ids are null or repeat. A null id reaches and
    is reached, but names a component only if it has no other id. Repeated rows stay; an empty table gives an empty result.
    """
    marked = store(marks(docs, id_col, text_col))
    some = marked.filter("n_shingles > 0")
    one = some.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = store(one.withColumn("c", F.monotonically_increasing_id()))  # numbers hold once the table is written
    roots = link_classes(classes, docs, percent, id_col, text_col)
    named = classes.join(roots, F.col("c") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "c").alias("group"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    per = store(named.select("digest", "group").join(ids, "group"))
    out = marked.select("doc_id", "key", "n_shingles", "digest").join(per, "digest", "left")
    return out.select("doc_id", "key", "n_shingles", "group", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id, both null included) of every document."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
