"""Evidence retrieval per document: keyword pool, BM25+, top k, fusion, finalising. One plan over all documents."""

from __future__ import annotations

import math
import random
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.operators.sampling import top_per_group

K1, B, DELTA = 1.5, 0.75, 1.0
TOP_K, TOP_N, LEAST_POOL, BLOCK_CHARS = 20, 12, 3, 700


def score_chunks(chunks: DataFrame, query: dict[str, int], doc: str = "doc_id") -> DataFrame:
    """Adds score (BM25+ within the document's pool), in_pool, total and keyword_hits.

    ``chunks`` has doc, ordinal, text and keyword_hit; ``query`` maps terms to how often they
    count. The pool is the keyword hits where there are three or more, else all chunks; a pool
    in which no term occurs gives way to all chunks. Term counts are taken in the row and
    pool statistics over one window, so text is shuffled once, by document.
    """
    w = Window.partitionBy(doc)
    terms = list(query)
    base = chunks.withColumn("__t", X.tokens(F.col("text")))
    base = base.withColumns({"__dl": F.size("__t")} | {f"__tf{k}": _times(F.col("__t"), t) for k, t in enumerate(terms)}).drop("__t")
    base = base.withColumns({"total": F.count("*").over(w), "keyword_hits": F.count_if("keyword_hit").over(w)})
    narrow = F.col("keyword_hits") >= LEAST_POOL
    known = reduce(lambda a, b: a + b, [F.col(f"__tf{k}") for k in range(len(terms))], F.lit(0)) > 0
    weak = F.count_if(F.col("keyword_hit") & known).over(w) == 0
    base = base.withColumn("in_pool", F.when(narrow & ~weak, F.col("keyword_hit")).otherwise(~(narrow & weak) | (F.count_if(known).over(w) > 0) | F.col("keyword_hit")))
    of_pool = lambda c: F.when(F.col("in_pool"), c)
    base = base.withColumns({"__n": F.count_if("in_pool").over(w), "__avg": F.avg(of_pool(F.col("__dl"))).over(w)} | {f"__df{k}": F.count_if(F.col("in_pool") & (F.col(f"__tf{k}") > 0)).over(w) for k in range(len(terms))})

    def part(k: int, times: int) -> Column:
        tf = F.col(f"__tf{k}")
        idf = F.log((F.col("__n") + 1) / F.col(f"__df{k}"))
        weight = DELTA + tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__dl") / F.col("__avg")))
        return F.when(tf > 0, times * idf * weight).otherwise(F.lit(0.0))

    score = reduce(lambda a, b: a + b, [part(k, n) for k, n in enumerate(query.values())], F.lit(0.0))
    out = base.withColumn("score", of_pool(score))
    return out.select(*chunks.columns, "score", "in_pool", "total", "keyword_hits")


def _times(found: Column, term: str) -> Column:
    return F.size(F.filter(found, lambda x: x == term))


def hunger(pressure: Column, bonus: int) -> Column:
    """Extra depth for a document under pressure: bonus times pressure / 10, 1 at most, halves to even."""
    return F.bround(bonus * F.least(F.lit(1.0), F.coalesce(pressure, F.lit(0.0)) / 10)).cast("int")


#: Fixed values of the walk: the length that a block should have, the weight of a place, first, least and falling heat.
BEST_CHARS, TILT, HEAT, LEAST_HEAT, COOLING = 400, 0.02, 1.0, 0.05, 0.97


def annealed_order(lengths: list[int], steps: int, seed: str) -> list[int]:
    """Places of blocks of these lengths after a seeded walk of swaps; blocks near the best length come forward.

    The energy is the sum of |length / BEST_CHARS - 1| times 1 + TILT * place. A swap is kept if
    it lowers the energy, or by chance while there is heat. Without steps nothing moves.
    """
    off, order, heat, rng = [abs(n - BEST_CHARS) / BEST_CHARS for n in lengths], list(range(len(lengths))), HEAT, random.Random(seed)
    for _ in range(steps if len(order) > 1 else 0):
        i, j = rng.randrange(len(order)), rng.randrange(len(order))
        if i == j:
            continue
        change = TILT * (j - i) * (off[order[i]] - off[order[j]])
        if change < 0 or rng.random() < math.exp(-change / heat):
            order[i], order[j] = order[j], order[i]
        heat = max(LEAST_HEAT, heat * COOLING)
    return order


def annealed(blocks: DataFrame, steps: int, seed: int = 0, doc: str = "doc_id") -> DataFrame:
    """``blocks`` (doc, rank, text) with rank anew after each document's own walk.

    A document's blocks meet once, as a list in order of rank; only their lengths go to Python, many documents
    at a time, and the places that come back choose from the list.
    """
    if steps <= 0:
        return blocks

    def walk(ids: pa.Array, lengths: pa.Array) -> pa.Array:
        return pa.array([annealed_order(n, steps, f"{seed}/{i}") for i, n in zip(ids.to_pylist(), lengths.to_pylist(), strict=True)], pa.list_(pa.int32()))

    by_rank = lambda x, y: F.when(x["rank"] < y["rank"], -1).when(x["rank"] > y["rank"], 1).otherwise(0)
    own = [c for c in blocks.columns if c != doc]
    held = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*own)), by_rank).alias("__b"))
    lengths = F.transform("__b", lambda x: F.length(F.coalesce(x["text"], F.lit(""))))
    places = held.withColumn("__o", F.arrow_udf(walk, "array<int>")(F.coalesce(F.col(doc).cast("string"), F.lit("nan")), lengths))
    at = lambda i: F.get("__b", i)
    moved = F.transform("__o", lambda i, k: F.struct(*[(at(k) if c == "rank" else at(i))[c].alias(c) for c in own]))
    return places.select(doc, F.inline(moved)).select(*blocks.columns)


def retrieve(chunks: DataFrame, query: dict[str, int], top_k: int = TOP_K, top_n: int = TOP_N, doc: str = "doc_id", rerank=None, pressure: DataFrame | None = None, bonus: int = 0, anneal_steps: int = 0, seed: int = 0) -> DataFrame:
    """Evidence blocks of every document: the columns of ``chunks``, score, rank, total, keyword_hits; text finalised.

    The best top_k of the pool by score and ordinal, then the best top_n by ``rerank`` (a
    function of the DataFrame that returns it with score anew), if given. With ``pressure``
    (doc, pressure), a document gets up to ``bonus`` more of both (96 and 24 at most).
    ``anneal_steps`` reorders a document's blocks by annealed() at last.
    """
    scored = score_chunks(chunks, query, doc).filter("in_pool")
    extra = F.lit(0)
    if pressure is not None:
        scored = scored.join(pressure.select(doc, hunger(F.col("pressure"), bonus).alias("__extra")), doc, "left")
        extra = F.coalesce("__extra", F.lit(0))
    by = Window.partitionBy(doc).orderBy(F.col("score").desc(), "ordinal")
    k, n = F.least(F.lit(96), top_k + extra), F.least(F.lit(24), top_n + F.floor(extra / 2))
    best = scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    if rerank is not None:
        best = rerank(best).withColumn("rank", F.row_number().over(by))
    best = annealed(best.filter(F.col("rank") <= n), anneal_steps, seed, doc)
    return best.withColumn("text", X.sanitize(F.col("text"), BLOCK_CHARS)).drop("in_pool", "__extra")


def retrieve_without_scores(chunks: DataFrame, top_n: int = TOP_N, doc: str = "doc_id") -> DataFrame:
    """Keyword hits first, then the others, in order, up to top_n a document."""
    return top_per_group(chunks, [doc], [F.col("keyword_hit").cast("int").desc(), F.col("ordinal")], top_n)


def merge_blocks(lists: list[DataFrame], doc: str, chunk: str, most: int = 12) -> DataFrame:
    """Blocks of the lists in turn, the first of each chunk id, blank ids dropped, up to ``most`` a document; adds place."""
    both = reduce(lambda a, b: a.unionByName(b), [x.withColumn("__l", F.lit(k)) for k, x in enumerate(lists)])
    named = both.filter(F.coalesce(F.col(chunk), F.lit("")) != "")
    first = top_per_group(named, [doc, chunk], [F.col("__l"), F.col("rank")], 1)
    place = F.row_number().over(Window.partitionBy(doc).orderBy("__l", "rank"))
    return first.withColumn("place", place).filter(F.col("place") <= most).drop("__l")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine, ties by id: each partition keeps k rows, the driver's plan merges those."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine(F.col(vector), q), 6).alias("similarity")).orderBy(F.col("similarity").desc(), id_col).limit(k)


def hybrid_search(rows: DataFrame, query: DataFrame, terms: dict[str, int], k: int, where: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", text: str = "text", depth: int = 4) -> DataFrame:
    """The best k of the rows that ``where`` leaves, by cosine and BM25+ of their texts, fused by rank: id, score.

    ``query`` holds the query's vector in its first column and is joined, not collected. Each
    list has ``depth`` times k rows. Without terms, the vectors alone rank.
    """
    pool = rows if where is None else rows.filter(where)
    q = query.limit(1).select(F.col(query.columns[0]).alias("__q"))  # one row
    near = pool.join(F.broadcast(q)).select(id_col, F.round(cosine(F.col(vector), F.col("__q")), 6).alias("__s"))
    lists = [near]
    if terms:
        # One pool: its counts and mean length are one row, joined to all.
        t = pool.select(id_col, X.tokens(F.col(text)).alias("__t"))
        t = t.select(id_col, F.size("__t").alias("__dl"), *[_times(F.col("__t"), x).alias(f"__tf{i}") for i, x in enumerate(terms)])
        of = t.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__av"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
        score = F.lit(0.0)
        for i, times in enumerate(terms.values()):
            tf = F.col(f"__tf{i}")
            weight = DELTA + tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__dl") / F.col("__av")))
            score = score + F.when(tf > 0, times * F.log((F.col("__n") + 1) / F.col(f"__df{i}")) * weight).otherwise(0.0)
        lists.append(t.join(F.broadcast(of)).select(id_col, F.round(score, 9).alias("__s")).filter("__s > 0"))
    # A window over depth * k rows.
    by = Window.orderBy(F.col("__s").desc(), id_col)
    ranked = [x.orderBy(F.col("__s").desc(), id_col).limit(depth * k).withColumn("rank", F.row_number().over(by)) for x in lists]
    return fuse(ranked, id_col, k)


def fuse(ranked: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists with key and rank: the best k, ties by key."""
    both = reduce(lambda a, b: a.unionByName(b), [r.select(key, (1.0 / (constant + F.col("rank"))).alias("s")) for r in ranked])
    return both.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def adaptive(k: Column, threshold: Column, not_found: Column, evidenceless: Column) -> dict[str, Column]:
    """Depth, threshold and switches of the next attempt, by how the last one failed."""
    return {
        "k": F.when(not_found, F.least(k * 2, F.lit(60))).otherwise(k),
        "threshold": F.when(not_found, threshold * 0.8).when(evidenceless, threshold * 0.6).otherwise(threshold),
        "adjacent": not_found,
        "expand": ~not_found & evidenceless,
    }


def hashing_embedding(text: Column, dim: int = 16) -> Column:
    """A deterministic stand-in for an embedding model: counts of token hashes, of unit length.

    What a lambda refers to is evaluated anew for each element, so places and counts are bound as
    arguments of a lambda, once a text.
    """
    at = F.transform(X.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counted = F.transform(F.array(at), lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(a) - F.size(F.array_remove(a, i))).cast("double")))
    norms = F.transform(counted, lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)).alias("norm")))
    return F.transform(norms, lambda x: F.transform(x["c"], lambda v: F.when(x["norm"] > 0, v / x["norm"]).otherwise(v)))[0]
