"""Prefix trie, odd sketches and vector codes: brute force, edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import odd_sketch, prefix_trie, vector_codes


# Prefix trie

TURNS = "conv_id long, turn long, role string, text string, len long, x1 long, label string, root long, depth long, n long"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[-1] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    return Counter(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == s))).encode()).hexdigest()) for s, m in members.items()
    )


def trie_of(spark, tmp_path, rows):
    data = [(*r, *[None] * 6) for r in rows]
    spark.createDataFrame(data, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return Counter(map(tuple, prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()))


def test_trie_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.choice([0, 1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é" * 3])))
    rows += [(100 + 5 * k, t, "user", "the same") for k in range(8) for t in range(40 if k else 39)]  # copies, and one that is shorter
    rows += [(100 + 5 * k + 1, t, "user", "own") for k in range(8) for t in range(2)]  # none or few turns of their own
    rng.shuffle(rows)
    got = trie_of(spark, tmp_path, rows)
    assert got == brute_trie(rows)
    assert max(d for _, d, *_ in got) == 40


def test_trie_edges(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "assistant", "y"), (7, 3, None, "z" * 100_000), (None, 0, "user", "lost"), (8, None, "user", None), (8, None, None, "t")]
    assert trie_of(spark, tmp_path / "some", rows) == brute_trie(rows)
    alone = [(0, 0, "user", "only"), (0, 1, "user", "two")]
    assert trie_of(spark, tmp_path / "alone", alone) == brute_trie(alone)
    assert not trie_of(spark, tmp_path / "none", [])
    assert not trie_of(spark, tmp_path / "lost", [(None, 0, "user", "lost")])


def test_trie_gives_turns_back(spark, sf):
    """The root-to-end walk over nodes of a conversation reads its turns."""
    turns = prefix_trie.ordered_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    nodes, ends = prefix_trie.prefix_trie(turns.select("conv_id").distinct(), turns)
    told = {(r.conv_id, r.depth): r for r in prefix_trie.with_turns(nodes, turns).collect()}
    want = defaultdict(list)
    for r in turns.orderBy("conv_id", "pos").collect():
        want[r.conv_id].append((r.role, r.text))
    for c, e in ends.collect():
        node, path = told[e, len(want[c])], []
        while node.depth:
            path.append((node.role, node.text))
            node = told[node.parent_conv_id, node.depth - 1]
        assert path[::-1] == want[c]


# Odd sketches


def brute_links(rows, percent=85):
    """By place of the row: set size, and least id over links; None for rows without words."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    comp = [(min(least[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return Counter((d, len(sets[i]), comp[i], d == comp[i]) for i, (d, _) in enumerate(rows))


def links_of(df, percent=85):
    near = odd_sketch.near_duplicates(df, percent)
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in near.collect())


def edited(rng, words, base, n):
    out = list(base)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice(words)
    return " ".join(out)


@pytest.fixture(scope="module")
def families():
    """Groups whose members differ from their base by a few words up to a quarter, so many pairs are around the threshold."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    rows, n = [], 0
    for size, most in ((150, 2), (60, 6), (60, 12), (40, 30), (12, 3)):
        base = rng.choices(words, k=220)
        for _ in range(size):
            n += 1
            rows.append((n, edited(rng, words, base, rng.randint(0, most))))
    rows += [(n + k, rows[k][1].upper()) for k in range(1, 30)] + [(n + 40 + k, " ".join(rng.choices(words, k=k))) for k in range(8)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_links_by_brute_force(spark, families, percent):
    want = brute_links(families, percent)
    assert links_of(spark.createDataFrame(families, "doc_id long, text string").repartition(4), percent) == want
    assert len({c for _, _, c, _ in want}) > 40


def test_minhash_query(spark, sf, plain):
    assert Counter(map(tuple, odd_sketch.op12_minhash(spark, sf).collect())) == brute_links(plain)


def test_minhash_texts_by_shuffle(spark, families, monkeypatch):
    """Beyond the bound of the broadcast the same rows come from a join."""
    monkeypatch.setattr(odd_sketch, "BROADCAST_IDS", 3)
    assert links_of(spark.createDataFrame(families, "doc_id long, text string")) == brute_links(families)


def test_minhash_edges(edge, empty, texts):
    assert links_of(edge) == brute_links([r[:2] for r in texts])
    assert links_of(empty) == Counter()


def test_sketches_of_whole_sets(spark):
    """Copies of one text that are near it and not near each other: sketches of whole sets refute what is below the threshold, and no link.

    Before, with sketches of samples only, almost all of these pairs were held on full sets.
    """
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=150)
    rows = [(n, edited(rng, words, base, 2)) for n in range(60)] + [(60, " ".join(base))]
    one = odd_sketch.marks(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    two = one.select(F.col("doc_id").alias("l"), F.col("n").alias("ln"), F.col("sketch").alias("lsketch"))
    tried = {(r.doc_id, r.l) for r in one.crossJoin(two).filter("doc_id < l").filter(odd_sketch._may_be(85)).collect()}
    hashes = odd_sketch._WordHashes()
    sets = [odd_sketch.shingle_set(t, hashes) for _, t in rows]
    for i, j in itertools.combinations(range(61), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        apart = len(sets[i]) + len(sets[j]) - 2 * common
        assert int(np.bitwise_count(odd_sketch.whole_sketch(sets[i]) ^ odd_sketch.whole_sketch(sets[j])).sum()) <= apart
        if 100 * common >= 85 * (common + apart):
            assert (i, j) in tried
    assert {(k, 60) for k in range(60)} <= tried and len(tried) < 300


def test_sketches_refute_little(families):
    """Pairs at the threshold pass; pairs of half of it do not."""
    hashes = odd_sketch._WordHashes()
    sets = [odd_sketch.shingle_set(t, hashes) for _, t in families if len(t) > 500][:200]
    sketches = odd_sketch.odd_sketches(np.stack([odd_sketch.minima(s) for s in sets]))
    most, passed, refuted = odd_sketch.most_bits(85), 0, 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            jac = common / (len(sets[i]) + len(sets[j]) - common)
            bits = int(np.bitwise_count(sketches[i] ^ sketches[j]).sum())
            if jac >= 0.85:
                assert bits <= most
                passed += 1
            elif jac < 0.4:
                assert bits > most
                refuted += 1
    assert passed > 100 < refuted


# Vector codes


@pytest.mark.parametrize("size", [3, 300, 1 << 20, vector_codes.LIMIT])
@pytest.mark.parametrize("width", [1, 4, 9])
def test_nearest(size, width):
    rng = np.random.default_rng(size + width)
    c = rng.integers(-size, size + 1, (64, width))
    c[10:20] = np.clip(c[10] + rng.integers(-2, 3, (10, width)), -size, size)
    c[33] = c[7]
    x = rng.integers(-size, size + 1, (6000, width))
    x[:400] = c[rng.integers(0, 64, 400)]
    at, far, taken = vector_codes.nearest(x, c)
    full = ((x[:, None] - c) ** 2).sum(2)
    assert (at == full.argmin(1)).all()
    assert (far == full.min(1)).all()
    assert taken < full.size  # screening leaves less than all


def brute_codes(rows):
    """rows (id, vector or None, label), with different ids."""
    keep = [(i, np.floor(256 * np.array(v, np.float64)).astype(int), lab) for i, v, lab in rows if v is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    keep.sort(key=lambda r: r[0])
    x = np.stack([v for _, v, _ in keep]).reshape(len(keep), 16, -1)
    books = x[:64].copy()
    for step in range(3):
        far = ((x[:, None] - books[None]) ** 2).sum(3)
        code = far.argmin(1)
        if step == 2:
            break
        new = books.copy()
        for p in range(16):
            for e in range(len(books)):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    new[e, p] = [int(s) // len(mine) for s in mine.sum(0)]
        books = new
    error = far.min(1).sum(1)
    by = defaultdict(int)
    for (_, _, lab), e in zip(keep, error, strict=True):
        by[lab] += int(e)
    sha = hashlib.sha256(",".join(str(v) for p in range(16) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()
    return Counter((i, bytes(code[k].astype(np.uint8)).hex(), int(error[k]), by[lab], sha) for k, (i, _, lab) in enumerate(keep))


VECTORS = "vec_id long, embedding array<float>, label int, l int, error long, id string, codes string"


def codes_of(spark, path, rows):
    spark.createDataFrame([(*r, *[None] * 4) for r in rows], VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return Counter(map(tuple, vector_codes.op13_vector_codes(spark, str(path)).collect()))


def test_codes_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(0, 0.3, 32)], int(i) % 3 if i % 7 else None) for i in rng.permutation(300)]
    rows += [(1000 + k, [0.25] * 32, 1) for k in range(100)] + [(2000, [5000.0, -5000.0] * 16, 2)]
    bad = [(-1, None, 0), (-2, [None] + [0.0] * 31, 0), (-3, [float("nan")] + [0.0] * 31, 0), (-4, [float("-inf")] + [0.0] * 31, 0)]
    assert codes_of(spark, tmp_path / "all", rows + bad) == brute_codes(rows)
    assert codes_of(spark, tmp_path / "few", rows[:5]) == brute_codes(rows[:5])


def test_codes_edges(spark, tmp_path):
    assert not codes_of(spark, tmp_path / "none", [])
    assert not codes_of(spark, tmp_path / "bad", [(1, None, 0), (2, [], 1), (3, [1.0] * 15, 1)])
    zero = [0.0] * 16
    got = codes_of(spark, tmp_path / "odd", [(None, zero, None), (4, zero, 1), (4, zero, 1), (4, [1.0] * 16, 1), (5, [0.0] * 32, 1), (6, [3e38] * 16, 1)])
    codes = Counter(r[:2] for r in got.elements())
    assert sum(codes.values()) == 5  # id 5 has another length
    # The entry of the null id, equal to that of id 4, is unused until that one has moved to a mean.
    assert codes == {(None, "02" * 16): 1, (4, "02" * 16): 2, (4, "00" * 16): 1, (6, "01" * 16): 1}


def test_decode(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    coded, books = vector_codes.compress(df)
    both = vector_codes.decode(coded, books).join(df, F.col("id") == F.col("vec_id")).limit(50).collect()
    for r in both:
        own = vector_codes.integers(np.array(r.embedding))
        assert int(((own - np.array(r.approx) * 256) ** 2).sum()) == r.error
