"""Conversation prefix trie by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store, table

#: Turns of the first round; each further round takes twice as many.
STRIDE = 1
#: A conversation takes fewer of its group's first turns than this.
SHARED_TURNS = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), dig (a digest of role and text), n_bytes, role and text, a row per turn.

    Turns are in order of ``turn_col``, null first; those that agree in it are in order of their
    digest, and repeated rows are turns of their own. Null role or text becomes empty. Rows without an id
    belong to no conversation and are left out.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = conversations.filter(c(id_col).isNotNull()).select(c(id_col).alias("conv_id"), c(turn_col).alias("turn"), *[F.coalesce(c(x), F.lit("")).alias(y) for x, y in ((role_col, "role"), (text_col, "text"))])
    rows = rows.withColumn("dig", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "dig")) - 1
    return rows.select("conv_id", at.cast("long").alias("pos"), "dig", F.octet_length("text").cast("long").alias("n_bytes"), "role", "text")


def rebuilt(turns: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: (conv_id) of each, and their turns.

    Conversation c takes the first h turns of conversation c - c mod ``group`` (all if fewer,
    none if there is no such conversation), then its own after its first h; h is the crc32 of c
    in decimal, mod SHARED_TURNS.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).alias("h"))
    rest = [x for x in turns.columns if x not in ("conv_id", "pos")]
    first = turns.filter(F.col("pos") < SHARED_TURNS).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").filter("pos < h").select("conv_id", "pos", *rest)
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    moved = convs.join(sizes, "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("n_base", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.join(moved, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), *rest)
    return convs.select("conv_id"), taken.unionByName(own)


def _marks() -> list:
    """Two 64-bit digests of a turn and its place; those of some turns are told by the XOR of each."""
    return [F.xxhash64("pos", "dig"), F.xxhash64("dig", "pos")]


def prefix_trie(convs: DataFrame, turns: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """The trie of all conversations ``convs`` (conv_id) over ``turns`` (conv_id, pos, dig, n_bytes): (nodes, ends).

    nodes: a row per different sequence of first turns, the empty one included. The smallest
    member's conv_id and the depth name a node, so the last turn of a node is that of
    (conv_id, pos = depth - 1). parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, n_bytes (of the last turn), saved (over the subtree, (n_convs - 1) * n_bytes), and
    end_id, the name in ends of those that have no further turn (null: none).
    ends: conv_id and end_id, a row per conversation.

    Conversations of equal turns (by 128-bit digests) are one from the start, so copies cost
    a row each and no more. Of the different ones all begin in one class. A round takes the next turns of the
    classes that are still active and splits these turn by turn; a class of one conversation
    is retired, and its remaining turns become a chain of nodes without further comparison. Rounds take
    1, 2, 4, ... turns, so their number is the logarithm of the longest shared beginning.
    Folding back is one grouped sum: every conversation carries what its chain and the nodes it
    names add, summed from its deepest class up.
    Without conversations there are no nodes. A conversation without turns ends at the root.
    """
    spark = convs.sparkSession
    m1, m2 = _marks()
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("len"), F.bit_xor(m1).alias("x1"), F.bit_xor(m2).alias("x2"))
    whole = store(convs.join(whole, "conv_id", "left").na.fill(0, ["len", "x1", "x2"]))
    same = store(whole.groupBy("len", "x1", "x2").agg(F.min("conv_id").alias("sid"), F.count("*").alias("w")))
    ends = whole.join(same, ["len", "x1", "x2"]).select("conv_id", F.col("sid").alias("end_id"))
    seqs = store(turns.withColumnRenamed("conv_id", "sid").join(same.select("sid"), "sid", "left_semi").select("sid", "pos", "dig", "n_bytes"))
    root = same.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("sid").alias("label")).first()
    label = F.lit(root.label).cast(same.schema["sid"].dataType)

    placed = [same.select("sid", "w", "len", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("depth"), label.alias("label"), F.lit(root.n).cast("long").alias("n"), F.lit(root.w).cast("long").alias("n_convs"))]
    depth, active = 0, placed[0].filter("n > 1 AND len > 0").select("sid", "w", "len", "label")
    while not active.isEmpty():
        so_far = Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = active.withColumnRenamed("label", "from").join(seqs.filter(F.col("pos").between(depth, depth + stride - 1)), "sid")
        rows = store(rows.select("sid", "w", "len", "from", "pos", "n_bytes", F.bit_xor(m1).over(so_far).alias("x1"), F.bit_xor(m2).over(so_far).alias("x2")))
        key = ["from", "pos", "x1", "x2"]
        classes = store(rows.groupBy(*key).agg(F.min("sid").alias("label"), F.count("*").alias("n"), F.sum("w").alias("n_convs")))
        placed.append(store(rows.join(classes, key).select("sid", "w", "len", "n_bytes", (F.col("pos") + 1).alias("depth"), "label", "n", "n_convs")))
        depth, stride = depth + stride, 2 * stride
        active = placed[-1].filter((F.col("depth") == depth) & (F.col("n") > 1) & (F.col("len") > depth)).select("sid", "w", "len", "label")

    # The classes of each conversation down to the first that is its own, where its chain begins.
    down = Window.partitionBy("sid").orderBy("depth")
    path = reduce(DataFrame.unionByName, placed).withColumns({"parent": F.lag("label").over(down), "before": F.lag("n").over(down)})
    path = store(path.filter((F.col("n") > 1) | F.col("before").isNull() | (F.col("before") > 1)))
    heads = path.filter("n = 1").select("sid", "w", "len", "depth", "n_bytes", "parent")
    chain = heads.unionByName(heads.join(seqs.withColumnRenamed("n_bytes", "b"), "sid").filter("pos >= depth").select("sid", "w", "len", (F.col("pos") + 1).alias("depth"), F.col("b").alias("n_bytes"), F.col("sid").alias("parent")))
    up = Window.partitionBy("sid").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chain = store(chain.withColumn("saved", (F.col("w") - 1) * F.sum("n_bytes").over(up)))
    single = chain.select(
        F.col("sid").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("w").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), "n_bytes", "saved", F.when(F.col("depth") == F.col("len"), F.col("sid")).alias("end_id"),
    )

    # Fold back.
    tail = chain.join(heads.select("sid", "depth"), ["sid", "depth"]).select("sid", F.col("saved").alias("tail"))
    own = F.when(F.col("label") == F.col("sid"), (F.col("n_convs") - 1) * F.col("n_bytes")).otherwise(0)
    below = path.filter("n > 1").join(tail, "sid", "left").withColumn("part", F.coalesce("tail", F.lit(0)) + F.sum(own).over(up))
    named = F.col("label") == F.col("sid")
    shared = below.groupBy(F.col("label").alias("conv_id"), "depth").agg(
        F.max(F.when(named, F.col("parent"))).alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.count("tail").alias("n_leaves"), F.max("n_bytes").alias("n_bytes"),
        F.sum("part").alias("saved"), F.max(F.when(F.col("len") == F.col("depth"), F.col("sid"))).alias("end_id"),
    )
    shared = store(shared)
    born = shared.select("parent_conv_id", "depth").unionByName(heads.select(F.col("parent").alias("parent_conv_id"), "depth")).filter("depth > 0")
    born = born.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    shared = shared.join(born, ["conv_id", "depth"], "left").na.fill(0, ["n_children"])
    return single.unionByName(shared.select(*single.columns)), ends


def ends_sha256(ends: DataFrame) -> DataFrame:
    """end_id and sha: SHA-256 of its conversations' ids in decimal, ascending and comma-joined.

    Ids only are dealt by end and sorted; a task hashes them as they come and keeps no list, so
    its memory is bounded. SHA-256 of one list is one pass by nature.
    """
    kind = ends.schema["end_id"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = sha = None
        for b in batches:
            done = []
            for end, ids in b.groupby("end_id", sort=False).conv_id:
                if sha is None or end != now:
                    done += [(now, sha.hexdigest())] if sha else []
                    now, sha = end, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, ids.tolist())).encode())
            yield pd.DataFrame(done, columns=["end_id", "sha"])
        if sha:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["end_id", "sha"])

    return ends.select("end_id", "conv_id").repartition("end_id").sortWithinPartitions("end_id", "conv_id").mapInPandas(hashed, f"end_id {kind}, sha string")


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn, null at the root; ``turns`` has conv_id, pos, role and text."""
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations; an empty table gives an empty result."""
    turns = store(ordered_turns(table(spark, sf_dir, "conversations")).select("conv_id", "pos", "dig", "n_bytes"))
    convs, again = rebuilt(turns)
    nodes, ends = prefix_trie(convs, store(again))
    out = nodes.join(ends_sha256(ends), "end_id", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP11_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
                  octet_length(encode(coalesce(text, ''))) AS b FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, t.pos, g, b FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
      UNION ALL SELECT t.conv_id, 1, t.pos, g, b FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT conv_id, coalesce(list(g ORDER BY own, pos) FILTER (g IS NOT NULL), []) AS seq, list(b ORDER BY own, pos) AS bs FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, d, array_to_string(seq[:d], '') AS pre, array_to_string(seq[:d - 1], '') AS up, coalesce(bs[d], 0) AS b, len(seq) = d AS ends FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (SELECT pre, d, min(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS e FROM p GROUP BY pre, d),
k AS (SELECT up AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
f AS (SELECT left(n.pre, 32 * a) AS pre, sum((n_convs - 1) * b) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
      FROM (SELECT *, unnest(range(d + 1)) AS a FROM n) n LEFT JOIN k USING (pre) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.e, '')) AS ends_sha256
FROM n JOIN f USING (pre) LEFT JOIN k USING (pre) LEFT JOIN n u ON u.pre = n.up
"""
