"""Suffix-array dedup: removal of byte strings that occur earlier, found by difference-cover sorting.

A window is a string of WINDOW bytes. Sorting the suffixes of a whole corpus moves every byte
many times, so text that cannot repeat is put aside first, without loss:

* Each window names an anchor inside it: the K bytes of least hash, the leftmost of equals.
  Equal windows name equal anchors at equal offsets, so they meet in the anchor's group.
  Neighbouring windows of one anchor form a segment, about 35 windows long.
* Anchors that occur once need no more work. Segments that are equal in full have equal
  windows, so all but the first are removed. What is left are the first segments of groups
  with different segments: where copies begin, end or are edited.
* Their suffixes are sorted: each task takes whole groups, sorts the sampled triples of the
  difference cover of 3, recurses on their names, merges the remaining suffixes, and compares
  the first WINDOW bytes of adjacent ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

WINDOW = 100
K = 32
#: Groups of up to this many different segments are sorted by one task; larger ones are halved by more of their bytes first.
GROUP = 2000
#: Segments that a task folds at once before they are shuffled.
FLUSH = 1 << 19
#: Bytes that a task hashes or sorts at once.
BATCH = 1 << 19

_RNG = np.random.default_rng(100)
_CODE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
NULL_ID = 2**63 - 1


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Segments of the texts: doc (place in the list), start, n (windows), anchor (hash of its K bytes), a and b (digest of all bytes)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    u = np.frombuffer(b"".join(texts), np.uint8)
    none = {k: np.zeros(0, np.int64) for k in ("doc", "start", "n", "a", "b")} | {"anchor": np.zeros(0, np.uint64)}
    if len(u) < WINDOW or lens.max() < WINDOW:
        return none
    ends = np.cumsum(lens)
    h = _hashes(u)
    # The least hash of a window, and its leftmost place, by doubling.
    w = WINDOW - K + 1
    best, at, size = h, np.arange(len(h), dtype=np.int32 if len(h) < 2**31 else np.int64), 1
    while size * 2 <= w:
        first = best[:-size] <= best[size:]
        at = np.where(first, at[:-size], at[size:])
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if rest := w - size:
        first = best[:-rest] <= best[rest:]
        at = np.where(first, at[:-rest], at[rest:])
    n = len(u) - WINDOW + 1
    doc_of = np.repeat(np.arange(len(texts)), lens)[:n]
    valid = np.arange(n) + WINDOW <= ends[doc_of]
    cut = np.concatenate(([True], (at[1:] != at[:-1]) | (doc_of[1:] != doc_of[:-1]) | (valid[1:] != valid[:-1])))
    s = np.flatnonzero(cut)
    count = np.diff(np.append(s, n))
    s, count = s[valid[s]], count[valid[s]]
    digest, view = xxhash.xxh3_128_digest, memoryview(u)
    both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(s.tolist(), (s + count + WINDOW - 1).tolist(), strict=True)]), "<i8").reshape(-1, 2)
    doc = doc_of[s]
    return {"doc": doc, "start": s - (ends - lens)[doc], "n": count, "anchor": h[at[s]], "a": both[:, 0], "b": both[:, 1]}


def _hashes(u: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on, by doubling."""
    h, size = _CODE[u], 1
    while size < K:
        h = h[:-size] * np.uint64(pow(int(_BASE), size, 2**64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def anchor_at(b: bytes) -> int:
    """The place of the anchor in a segment: that of the least hash in its first window."""
    return int(_hashes(np.frombuffer(b[:WINDOW], np.uint8)).argmin())


def suffix_array(x: np.ndarray, needed: int | None = None) -> np.ndarray:
    """Places of all suffixes of ``x`` (positive integers) in order, by the difference cover of 3.

    With ``needed``, suffixes that agree in so many first places may stand in any order among themselves.
    """
    n = len(x)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(x[i:])), np.int64)
    top = int(x.max()) + 1
    width = max(3, int(63 // np.log2(top + 1)))  # characters that fit one number
    pad = np.concatenate((x.astype(np.int64), np.zeros(width + 3, np.int64)))
    i = np.arange(n + (n % 3 == 1))  # a sampled suffix of no characters where the cover needs it
    sample = np.concatenate((i[i % 3 == 1], i[i % 3 == 2]))
    # Sampled triples are sorted and named.
    if top < 2_000_000:
        key = (pad[sample] * top + pad[sample + 1]) * top + pad[sample + 2]
        order = np.argsort(key)
        new = np.concatenate(([1], key[order][1:] != key[order][:-1]))
    else:
        order = np.lexsort((pad[sample + 2], pad[sample + 1], pad[sample]))
        t = sample[order]
        new = np.concatenate(([1], (pad[t[1:]] != pad[t[:-1]]) | (pad[t[1:] + 1] != pad[t[:-1] + 1]) | (pad[t[1:] + 2] != pad[t[:-1] + 2])))
    # Equal names are told apart by the order of the string of names.
    if new.sum() < len(sample) and (needed is None or needed > 3):
        names = np.empty(len(sample), np.int64)
        names[order] = np.cumsum(new)
        order = suffix_array(names, None if needed is None else -(-needed // 3) + 1)
    ranked = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[ranked] = np.arange(1, len(sample) + 1)
    ranked = ranked[ranked < n]
    # The other suffixes: by their first character and the rank that follows.
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(pad[rest] * (len(sample) + 1) + rank[rest + 1])]
    # Merge: each of the others looks for its place among the sampled, by its first characters
    # packed in a number, then, where those are equal, by characters and ranks.
    if top < 2_000_000:
        packed = pad[:n].copy()
        for k in range(1, width):
            packed *= top
            packed += pad[k : n + k]
        keys = packed[ranked]
        lo, hi = np.searchsorted(keys, packed[rest], "left"), np.searchsorted(keys, packed[rest], "right")
    else:
        lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), len(ranked), np.int64)
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        a, mid = rest[todo], (lo[todo] + hi[todo]) // 2
        b = ranked[mid]
        one = b % 3 == 1
        a1, b1 = np.where(one, rank[a + 1], pad[a + 1]), np.where(one, rank[b + 1], pad[b + 1])
        less = (pad[b] < pad[a]) | (pad[b] == pad[a]) & ((b1 < a1) | ~one & (b1 == a1) & (rank[b + 2] < rank[a + 2]))
        lo[todo] = np.where(less, mid + 1, lo[todo])
        hi[todo] = np.where(less, hi[todo], mid)
        todo = todo[lo[todo] < hi[todo]]
    if needed is not None:  # among equals, places may have crossed
        by = np.argsort(lo, kind="stable")
        rest, lo = rest[by], lo[by]
    out = np.empty(n, np.int64)
    place = lo + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place], out[~taken] = rest, ranked
    return out


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of windows that also begin earlier, by doc and start, among the segments' windows."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    u = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(lens) - lens
    seg = np.full(len(u), -1, np.int64)
    mine = np.repeat(np.arange(len(texts)), n)
    off = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
    seg[begin[mine] + off] = mine
    sa = suffix_array(u.astype(np.int64) + 1, WINDOW)
    sa = sa[seg[sa] >= 0]
    views = np.lib.stride_tricks.sliding_window_view(u, WINDOW)
    same = np.zeros(len(sa), bool)
    for k in range(1, len(sa), 1 << 16):
        m = min(len(sa), k + (1 << 16))
        same[k:m] = (views[sa[k:m]] == views[sa[k - 1 : m - 1]]).all(1)
    s = seg[sa]
    at = start[s] + sa - begin[s]
    order = np.lexsort((at, doc[s]))
    new = np.concatenate(([True], (doc[s][order][1:] != doc[s][order][:-1]) | (at[order][1:] != at[order][:-1]))) if len(s) else np.zeros(0, bool)
    when = np.empty(len(s), np.int64)
    when[order] = np.cumsum(new)
    head = np.flatnonzero(~same)
    first = np.repeat(np.minimum.reduceat(when, head), np.diff(np.append(head, len(s)))) if len(s) else when
    late = when > first
    return s[late], (sa - begin[s])[late]


def _packed(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 31 | n


def _unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pos >> 31, pos & (1 << 31) - 1


def _differs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any column; the first does."""
    return np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))) if len(columns[0]) else np.zeros(0, bool)


_SEGMENT = "a long, b long, anchor long, id long, key long, pos long"


def scan_segments(rows: DataFrame) -> DataFrame:
    """Segments of ``rows`` (id, key, text): digest (a, b), anchor, id, key, pos (start and n, packed).

    Up to FLUSH segments are folded where they are read: of equal ones, only the first is passed
    on, and the others become runs, with pos inverted and a spread over all values. So a group of
    copies, however large, comes down to a row a flush before anything is shuffled.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n_held = 0
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            texts = [(t or "").encode("utf-8") for t in b.column(2).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH, "right")))
                s = segments(texts[lo:hi])
                doc = s["doc"] + lo
                held.append({"a": s["a"], "b": s["b"], "anchor": s["anchor"].view(np.int64), "id": ids[doc], "key": keys[doc], "start": s["start"], "n": s["n"]})
                n_held += len(doc)
                if n_held >= FLUSH:
                    yield from _folded(held)
                    held, n_held = [], 0
                lo = hi
        if n_held:
            yield from _folded(held)

    return rows.mapInArrow(scanned, _SEGMENT)


def _folded(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order = np.lexsort((c["key"], c["start"], c["id"], c["b"], c["a"]))
    c = {k: v[order] for k, v in c.items()}
    first = np.maximum.accumulate(np.where(_differs(c["a"], c["b"]), np.arange(len(order)), 0))
    late = (c["id"] != c["id"][first]) | (c["start"] != c["start"][first])
    stay = ~late & _differs(*(c[k] for k in ("a", "b", "id", "key", "start")))
    yield from _batches({k: c[k][stay] for k in ("a", "b", "anchor", "id", "key")} | {"pos": _packed(c["start"][stay], c["n"][stay])})
    c = {k: v[late] for k, v in c.items()}
    order = np.lexsort((c["start"], c["key"], c["id"]))
    c = {k: v[order] for k, v in c.items()}
    if len(order):
        end = c["start"] + c["n"]
        head = np.flatnonzero(_differs(c["id"], c["key"]) | np.concatenate(([True], c["start"][1:] != end[:-1])))
        n = np.add.reduceat(c["n"], head)
        spread = ((c["id"][head].view(np.uint64) ^ c["key"][head].view(np.uint64)) * _MIX).view(np.int64)
        yield from _batches({"a": spread, "b": spread, "anchor": spread, "id": c["id"][head], "key": c["key"][head], "pos": ~_packed(c["start"][head], n)})


def _batches(columns: dict[str, np.ndarray], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict(columns)
    for k in range(0, whole.num_rows, most):
        yield whole.slice(k, most)


def fold_segments(found: DataFrame) -> DataFrame:
    """Segments or runs, each once: late (also begins earlier, in full), anchor, id, key, pos.

    Equal digests meet in one sorted partition, where each is held against the first of its
    digest. A partition is read as a stream: no group is ever held.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for b in batches:
            c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "anchor", "id", "key", "pos")}
            run = c["pos"] < 0
            if run.any():
                yield pa.RecordBatch.from_pydict({"late": np.ones(run.sum(), bool)} | {k: c[k][run] for k in ("anchor", "id", "key")} | {"pos": ~c["pos"][run]})
                c = {k: v[~run] for k, v in c.items()}
            n = len(c["a"])
            if not n:
                continue
            if last is not None:  # the row before and the first of its digest go ahead of this batch
                c = {k: np.concatenate(([first[k], last[k]], v)) for k, v in c.items()}
            start = c["pos"] >> 31
            at = np.maximum.accumulate(np.where(_differs(c["a"], c["b"]), np.arange(len(start)), 0))
            late = (c["id"] != c["id"][at]) | (start != start[at])
            fresh = _differs(*(c[k] for k in ("a", "b", "id", "key", "pos")))
            last, first = {k: v[-1] for k, v in c.items()}, {k: v[at[-1]] for k, v in c.items()}
            keep = np.flatnonzero(fresh[-n:]) + len(start) - n
            yield pa.RecordBatch.from_pydict({"late": late[keep]} | {k: c[k][keep] for k in ("anchor", "id", "key", "pos")})

    return found.repartition("a", "b").sortWithinPartitions("a", "b", "id", "pos", "key").mapInArrow(folded, "late boolean, anchor long, id long, key long, pos long")


_TEXT = "g long, lo int, hi int, id long, key long, pos long, bytes binary"


def _bytes_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (anchor, kinds, id, key, pos) with bytes: each document meets the list of its segments in a join."""
    lists = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "kinds", "pos")).alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
                found, end = b.column(3).flatten(), np.cumsum(b.column(3).value_lengths().to_numpy())
                pos = found.field("pos").to_numpy()
                start, n = _unpacked(pos)
                start, stop = start.tolist(), (start + n + WINDOW - 1).tolist()
                out, rows = [], np.zeros(len(pos), bool)
                for i, text in enumerate(b.column(2).to_pylist()):
                    if (ids[i], keys[i]) != before:  # of rows that share id and text one is enough
                        before, t, lo = (ids[i], keys[i]), text.encode("utf-8"), end[i - 1] if i else 0
                        rows[lo : end[i]] = True
                        out += [t[x:y] for x, y in zip(start[lo : end[i]], stop[lo : end[i]], strict=True)]
                doc = np.repeat(np.arange(b.num_rows), np.diff(end, prepend=0))[rows]
                same = np.zeros(len(doc), np.int32)
                cols = {"g": found.field("anchor").to_numpy()[rows], "lo": same, "hi": same + WINDOW - K + 1, "id": ids[doc], "key": keys[doc], "pos": pos[rows], "bytes": pa.array(out, pa.binary()), "kinds": found.field("kinds").to_numpy()[rows]}
                yield pa.RecordBatch.from_pydict(cols)

    return rows.join(lists, ["id", "key"]).select("id", "key", "text", "s").mapInArrow(cut, _TEXT + ", kinds long")


def _halved(texts: DataFrame) -> DataFrame:
    """Each segment's windows in two: those with the anchor in their first half of places (lo to hi, hi excluded), and the rest.

    All windows of a half share WINDOW + 1 - (hi - lo) bytes around the anchor, whose hash is
    the new group: equal windows still meet. With one place left, the group is the window.
    """

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                start, n = r.pos >> 31, r.pos & (1 << 31) - 1
                p = anchor_at(r.bytes)
                mid = (r.lo + r.hi) // 2
                for lo, hi in ((r.lo, mid), (mid, r.hi)):
                    # Window j has its anchor at place p - j.
                    j, end = max(0, p - hi + 1), min(n, p - lo + 1)
                    if j < end:
                        core = r.bytes[p - lo : p - hi + 1 + WINDOW]
                        g = xxhash.xxh3_64_intdigest(core, lo << 8 | hi)
                        out.append((np.uint64(g).astype(np.int64), lo, hi, r.id, r.key, (start + j) << 31 | end - j, r.bytes[j : end + WINDOW - 1]))
            yield pd.DataFrame(out, columns=["g", "lo", "hi", "id", "key", "pos", "bytes"])

    return texts.select("lo", "hi", "id", "key", "pos", "bytes").mapInPandas(halves, _TEXT)


def _sort_groups(texts: DataFrame) -> DataFrame:
    """Runs of windows that begin earlier in their group: each task sorts the suffixes of whole groups, about BATCH bytes at a time."""

    def sort_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            held.append(b)
            size += int(b.bytes.str.len().sum())
            if size >= BATCH:
                all_ = pd.concat(held, ignore_index=True)
                last = all_.g == all_.g.iloc[-1]
                if not last.all():
                    yield from pieces(all_[~last])
                    held = [all_[last]]
                    size = int(held[0].bytes.str.len().sum())
        if held:
            yield from pieces(pd.concat(held, ignore_index=True))

    def pieces(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole groups, about BATCH bytes at a time."""
        if not len(b):
            return
        size = np.cumsum(b.bytes.str.len().to_numpy())
        border = np.flatnonzero(np.append(_differs(b.g.to_numpy())[1:], True)) + 1
        lo = 0
        while lo < len(b):
            fits = border[(border > lo) & (size[border - 1] <= (size[lo - 1] if lo else 0) + BATCH)]
            hi = int(fits[-1]) if len(fits) else int(border[border > lo][0])
            yield late(b.iloc[lo:hi])
            lo = hi

    def late(b: pd.DataFrame) -> pd.DataFrame:
        start, n = _unpacked(b.pos.to_numpy())
        s, off = repeated_windows(list(b.bytes), b.id.to_numpy(), start, n)
        order = np.lexsort((off, s))
        s, off = s[order], off[order]
        head = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (off[1:] != off[:-1] + 1)))) if len(s) else np.zeros(0, int)
        t = s[head]
        return pd.DataFrame({"id": b.id.to_numpy()[t], "key": b.key.to_numpy()[t], "pos": _packed(start[t] + off[head], np.diff(np.append(head, len(s))))})

    return texts.select("g", "id", "key", "pos", "bytes").repartition("g").sortWithinPartitions("g").mapInPandas(sort_groups, "id long, key long, pos long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> dict[str, DataFrame]:
    """Runs of windows that also begin earlier, by the way they were found: id, key (hash of the text), pos (start and n, packed).

    "Earlier" is a smaller id, or the same id and an earlier start. Ids are integers; null
    comes last. A run of n windows from start covers the bytes [start, start + n + WINDOW - 1).
    ``folded`` holds segments that repeat in full, ``sorted`` what the sorted suffixes show, and
    ``single`` windows of groups that stayed above ``group`` down to a single window.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    rows = rows.filter(F.octet_length("text") >= WINDOW)
    found = store(fold_segments(scan_segments(rows)))
    firsts = found.filter("NOT late").drop("late")
    # Groups with different segments go on, with their bytes.
    many = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = store(firsts.join(many, "anchor"))
    texts = store(_bytes_of(rows, wanted))
    whole = {"folded": found.filter("late").select("id", "key", "pos")}
    # Groups above the limit are halved, and halves that are still above it again.
    small, large = [texts.filter(F.col("kinds") <= group).drop("kinds")], texts.filter(F.col("kinds") > group)
    while not large.isEmpty():
        parts = store(_halved(large))
        kinds = parts.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        parts = store(parts.join(kinds, "g"))
        fits = (F.col("kinds") <= group) & (F.col("hi") - F.col("lo") > 1)
        small.append(parts.filter(fits).drop("kinds"))
        single = parts.filter("hi - lo = 1").select("bytes", "id", "key", "pos")
        first = single.groupBy(F.col("bytes").alias("w")).agg(F.min(F.struct("id", "pos")).alias("first"))
        single = single.join(first, F.col("bytes") == F.col("w")).filter(F.struct("id", "pos") > F.col("first")).select("id", "key", "pos")
        whole["single"] = whole["single"].unionByName(single) if "single" in whole else single
        large = parts.filter(~fits & (F.col("hi") - F.col("lo") > 1))
    whole["sorted"] = store(_sort_groups(reduce(DataFrame.unionByName, small)))
    return whole


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Each text without the bytes of windows that also begin earlier.

    One row per row of ``docs``: doc_id, kept (binary, the bytes that stay, joined), n_bytes,
    n_removed, spans (array of struct<start, end>: the maximal runs removed). Windows are
    judged on the input. Null counts as empty; texts under WINDOW bytes stay whole. Rows of
    one id are one document: a window at the same start of another row with that id is not
    earlier, so identical rows fare alike. An empty table gives an empty result.
    """
    spans = reduce(DataFrame.unionByName, repeated_spans(docs, id_col, text_col, group).values())
    runs = spans.groupBy("id", "key").agg(F.collect_list("pos").alias("runs"))
    kind = docs.schema[id_col].dataType.simpleString()
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key")
    met = docs.select(F.col(id_col).alias("doc_id"), *own, F.col(text_col).alias("text")).join(runs, ["id", "key"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, found in zip(b.text, b.runs, strict=True):
                t = (text or "").encode("utf-8")
                r = np.sort(found) if found is not None else np.zeros(0, np.int64)
                lo, n = _unpacked(r)
                hi = np.maximum.accumulate(lo + n + WINDOW - 1) if len(r) else r
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1]))) if len(r) else r
                starts, ends = lo[new].tolist(), (hi[np.append(new[1:], len(r)) - 1].tolist() if len(r) else [])
                kept = [t[a:b] for a, b in zip([0, *ends], [*starts, len(t)], strict=True)]
                out.append((b"".join(kept), len(t), sum(ends) - sum(starts), [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)]))
            yield pd.DataFrame({"doc_id": b.doc_id} | {c: [o[k] for o in out] for k, c in enumerate(("kept", "n_bytes", "n_removed", "spans"))})

    return met.select("doc_id", "text", "runs").mapInPandas(cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, as remove_repeats() has them."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
