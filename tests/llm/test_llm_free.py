"""The operators with numpy kernels, and the pipeline: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import bpe, langid, quality_mil, simhash, suffix_dedup
from docweave.llm.common import crc32_mod
from docweave.llm.queries import QUERIES

# Suffix-array dedup


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(300):
        x = np.array([rng.randint(1, rng.choice([1, 2, 3, 300])) for _ in range(rng.randint(0, 200))], np.int64)
        assert list(suffix_dedup.suffix_array(x)) == sorted(range(len(x)), key=lambda i: tuple(x[i:]))
        some = [tuple(x[i : i + 10]) for i in suffix_dedup.suffix_array(x, 10)]
        assert some == sorted(some)


def brute_removal(rows):
    first, out = {}, Counter()
    order = lambda i: suffix_dedup.NULL_ID if i is None else i
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        for k in range(len(t) - 99):
            at = (order(i), k)
            first[t[k : k + 100]] = min(first.get(t[k : k + 100], at), at)
    for i, t in rows:
        m = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if first[t[k : k + 100]] < (order(i), k):
                m[k : k + 100] = True
        spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        out[i, len(t), int(m.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()] += 1
    return out


def removal(df, **how):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(df, **how).collect())


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    passage, rows = " ".join(rng.choices(words, k=60)), []
    for i in range(90):
        t = " ".join(rng.choices(words, k=rng.randint(0, 150)))
        if i % 3 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 7 == 0 and rows:
            w = rows[rng.randrange(len(rows))][1].split(" ")
            w[rng.randrange(len(w))] = "zz"
            t = " ".join(w)
        if i % 11 == 0:
            t = "Ha " * 150 + t
        if i % 13 == 0:
            t = "ab" * 150
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("how", [{}, {"group": 3}])
def test_repeats(spark, repeats, how):
    assert removal(spark.createDataFrame(repeats, "doc_id long, text string"), **how) == brute_removal([(i, t.encode()) for i, t in repeats])


def test_repeats_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = Counter(map(tuple, QUERIES["op1_suffix_dedup"](spark, "/root/testdata/sf0.001").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == brute_removal([(r.doc_id, (r.text or "").encode()) for r in docs])


def test_repeats_edge(edge, texts):
    assert removal(edge) == brute_removal([(i, (t or "").encode()) for i, t, *_ in texts])


# Language ID


def test_languages(spark):
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(docs, "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.filter("score < 0 OR score > 1").count() == 0
    assert got.count() == docs.count()


def plain_grams(t):
    """Unit vector of square roots of hashed byte 1-, 2- and 3-gram counts of letters, runs of others as one blank."""
    b = []
    for x in t.lower().encode():
        x = x if x >= 128 or 97 <= x <= 122 else 32
        if not (x == 32 and b and b[-1] == 32):
            b.append(x)
    if len(b) > 1 and t.lower().encode()[:1] and b[0] == 32:
        b = b[1:]  # a blank at the start counts as one after a blank
    n = Counter()
    for k, x in enumerate(b):
        n[(x * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        if k + 1 < len(b):
            n[((x * 257 + b[k + 1] + (1 << 17)) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        if k + 2 < len(b):
            n[((((x * 257 + b[k + 1]) * 257 + b[k + 2] + (1 << 27)) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    size = sum(n.values()) ** 0.5
    return {k: v**0.5 / size for k, v in n.items()}


def test_language_decoding_by_plain_loops(spark, documents, plain):
    model = langid.fit_languages(documents.filter(crc32_mod(F.col("doc_id"), 4) != 2))
    trust = [max(1e-3, a - 0.5) for a in model.accuracy]
    trust = [x * len(trust) / sum(trust) for x in trust]
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, "/root/testdata/sf0.001").collect()}
    for i, t in plain:
        if not any(map(str.isalpha, t or "")):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = plain_grams(t)
        f = [sum(v * model.weights[k, b] for k, v in x.items()) + model.weights[-1, b] for b in range(model.code.shape[1])]
        loss = [sum(w * np.log1p(np.exp(-c * m)) for w, c, m in zip(trust, word, f, strict=True)) for word in model.code]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert got[i].lang_pred == model.langs[int(share.argmax())]
        assert got[i].score == pytest.approx(share.max(), abs=1e-4)


def test_pipeline_on_edge_tables(spark, edge, empty, tmp_path):
    """All stages on nulls, empty and long texts, repeated rows, clashing columns, and on an empty table."""
    for name, df in (("edge", edge), ("empty", empty)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out[0].asDict() if out else corpus_pipeline.run(spark, str(tmp_path / name)).columns)
        assert all(r.n_tokens > 0 for r in out)


@pytest.mark.parametrize("k", [1, 2, 4, 5, 6, 12])
def test_codewords_differ(k):
    code = langid.codewords(k)
    assert len(np.unique(code, axis=0)) == k
    if k > 1:
        assert (np.abs(code.sum(0)) < k).all()


def test_languages_edge(edge, texts):
    model = langid.fit_languages(edge)
    got = langid.predict_languages(edge, model).collect()
    assert len(got) == len(texts)
    said = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (3, 4, 5, 8))
    assert {r.lang_pred for r in got} <= {"und", "en", "de"}
    kept = langid.keep_identified(edge, model)
    assert kept.columns == edge.columns
    assert dict(kept.dtypes) == dict(edge.dtypes)


def test_languages_of_copies(spark):
    """A language whose rows are all copies of one text is learned, however often it is repeated."""
    said = {"a": "alpha beta gamma", "b": "zwei drei vier", "c": "uno dos tres", "d": "un deux trois", "e": "jeden dwa trzy"}
    rows = spark.createDataFrame(list(said.items()), "lang string, text string").crossJoin(spark.range(10_000))
    model = langid.fit_languages(rows)
    assert [x[0] for x in model.predict(list(said.values()))] == list(said)
    one = langid.fit_languages(rows.filter("lang = 'a'"))
    assert one.langs == ["a"]


# Byte BPE


def library():
    """The tiktoken library on the same vocabulary and pattern."""
    import base64

    import tiktoken

    path, pattern = bpe.defaults()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("leaf", "piece"), [(64, 32), (3, 4), (8, 16)])
def test_tree_is_the_library(monkeypatch, leaf, piece):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "PIECE", piece)
    c, lib, rng = bpe.TreeBPE(*bpe.defaults()), library(), random.Random(leaf)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", "1", "23", "é", "ß", "漢字", "!", "...", "\t", "hello", "world", "'", " '", "e", "aaaa", "=", "==", "🙂"]
    for _ in range(1000):
        t = "".join(rng.choices(rng.sample(parts, rng.randint(1, len(parts))), k=rng.randint(0, 300)))
        ids = c.encode(t)
        assert list(ids) == lib.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    for one in ("x", "=", "ab", "Abc", "漢", " ", "0"):  # pieces far longer than a leaf
        t = one * 3000
        assert list(c.encode(t)) == lib.encode_ordinary(t)


def test_bpe_query_is_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    lib, expected = library(), Counter()
    for r in docs:
        ids = lib.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, QUERIES["op6_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect())) == expected


def test_bpe_edge(edge, texts):
    lib = library()
    expected = Counter((i, tuple(lib.encode_ordinary(t or ""))) for i, t, *_ in texts)
    coded = bpe.bpe_encode(edge)
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == expected
    back = Counter((r.doc_id, bytes(r.decoded)) for r in bpe.bpe_decode(coded).collect())
    assert back == Counter((i, (t or "").encode()) for i, t, *_ in texts)
    digests = lambda t: (len(lib.encode_ordinary(t)), hashlib.sha256(np.array(lib.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(edge).collect())
    assert got == Counter((i, *digests(t or "")) for i, t, *_ in texts)


# SimHash


def brute_components(rows):
    """Least id that each row reaches over fingerprints at three bits or fewer."""
    f = np.array([fp for _, fp in rows], np.uint64)
    label = list(range(len(f)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= simhash.DISTANCE):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [least[root(k)] for k in range(len(rows))]


def plain_fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(edge, texts, plain):
    assert all(simhash.fingerprint(t) == plain_fingerprint(t) for _, t, *_ in [*texts, *plain])


@pytest.mark.parametrize("bucket", [4096, 16])
def test_links_lose_nothing(spark, bucket):
    rng = np.random.default_rng(1)
    fps = set()
    for base in rng.integers(0, 2**63, 40, dtype=np.uint64):
        x = int(base)
        for _ in range(int(rng.integers(1, 40))):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    rows = [(k, simhash._signed(x)) for k, x in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    root = {r.node: r.root for r in simhash.components(simhash.link_fingerprints(df.select("fp"), bucket)).collect()}
    groups = {}
    for i, fp in rows:
        groups.setdefault(root.get(fp, fp), []).append(i)
    expected = {}
    for (i, _), c in zip(rows, brute_components([(i, fp % 2**64) for i, fp in rows]), strict=True):
        expected.setdefault(c, []).append(i)
    assert sorted(groups.values()) == sorted(expected.values())


def test_near_duplicates(edge, texts, documents, plain):
    for df, rows in ((edge, [t[:2] for t in texts]), (documents, plain)):
        marked = [(i, plain_fingerprint(t)) for i, t in rows]
        expected = Counter((i, fp, c) for (i, fp), c in zip(marked, brute_components(marked), strict=True))
        assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()) == expected
    kept = simhash.keep_representatives(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len(set(brute_components([(i, plain_fingerprint(t)) for i, t, *_ in texts])))


# Quality classifier


def test_quality_held_out(spark):
    got = QUERIES["op8_quality_mil"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count()
    assert got.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.3 AS INT)").count() == 0


def test_quality_derivatives():
    """Each derivative against a difference of losses."""
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(k % 4 + 1, quality_mil.WIDTH)) for k in range(6)]
    labels, weight = np.array([0.0, 1, 0, 1, 1, 0]), np.full(6, 1 / 6)
    m = quality_mil.fit_mil(bags, labels, 3)
    x, start = np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])
    loss = lambda: float(-(weight * (labels * np.log(m.forward(x, start)["y"]) + (1 - labels) * np.log(1 - m.forward(x, start)["y"]))).sum())
    grad = quality_mil.gradient(m, x, start, labels, weight)
    for k, v in m.p.items():
        for at in {tuple(rng.integers(0, n) for n in v.shape) for _ in range(8)}:
            old, h = v[at], 1e-5
            v[at] = old + h
            up = loss()
            v[at] = old - h
            down = loss()
            v[at] = old
            assert grad[k][at] == pytest.approx((up - down) / (2 * h), abs=1e-7, rel=1e-4), (k, at)


def test_quality_scores_by_a_plain_pass(spark, documents, plain):
    """The query's scores, passage by passage with plain loops over the fitted weights."""
    model = quality_mil.train_quality(documents.filter(crc32_mod(F.col("doc_id"), 5) != 0), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_quality_mil"](spark, "/root/testdata/sf0.001").collect()}
    p = model.p
    for i, t in plain[:60]:
        pull, hs = [], []
        for row in quality_mil.passage_features(t):
            v = [(a - b) / c for a, b, c in zip(row.tolist(), model.mean, model.scale, strict=True)]
            h = [np.tanh(sum(v[k] * p["E"][k, j] for k in range(len(v))) + p["e"][j]) for j in range(quality_mil.HIDDEN)]
            gate = [np.tanh(sum(h[j] * p["V"][j, k] for j in range(len(h)))) / (1 + np.exp(-sum(h[j] * p["U"][j, k] for j in range(len(h))))) for k in range(quality_mil.ATTENTION)]
            pull.append(np.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
            hs.append(h)
        z = [sum(a * h[j] for a, h in zip(pull, hs, strict=True)) / sum(pull) for j in range(quality_mil.HIDDEN)]
        y = 1 / (1 + np.exp(-sum(a * c for a, c in zip(z, p["c"], strict=True)) - p["b"][0]))
        assert got[i].score == pytest.approx(y, abs=1e-6)
        assert got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_simhash_query(spark, plain):
    marked = [(i, plain_fingerprint(t)) for i, t in plain]
    expected = Counter((i, f"{fp:016x}", c) for (i, fp), c in zip(marked, brute_components(marked), strict=True))
    assert Counter(map(tuple, QUERIES["op7_simhash"](spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect())) == expected


def test_quality_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 4), quality_mil.WIDTH)).astype(np.float32) for _ in range(60)]
    labels = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    model = quality_mil.fit_mil(bags, labels, 200)
    assert ((model.scores(bags) > 0.5) == (labels > 0.5)).mean() > 0.9


def test_quality_long_texts(monkeypatch):
    """Passages have 96 words at every length, and blocks of them give the score of all at once."""
    rng = random.Random(4)
    text = " ".join(rng.choices(["ab", "Cd.", "12", "é,", "x"], k=96 * 300 + 5))
    x = quality_mil.passage_features(text)
    assert len(x) == 301
    model = quality_mil.fit_mil([x[:5], x[5:9], x[9:20], x[20:30]], np.array([0.0, 1.0, 0.0, 1.0]), 20)
    whole = model.scores([x])[0]
    monkeypatch.setattr(quality_mil, "BLOCK_PASSAGES", 7)
    assert (quality_mil.passage_features(text) == x).all()
    assert model.score_texts([text, "a b", text]) == pytest.approx([whole, model.scores([quality_mil.passage_features("a b")])[0], whole])


def test_training_takes_whole_texts_within_a_bound(spark, monkeypatch):
    """All passages of the documents that are taken; the bound is on the sample, and who is over it alone is passed over."""
    seen = []
    monkeypatch.setattr(quality_mil, "fit_mil", lambda bags, y: seen.append((sorted(map(len, bags)), len(y))))
    docs = spark.createDataFrame([(k, " ".join(["word"] * (96 * n))) for k, n in enumerate([1, 2, 3, 40, 400])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int")
    quality_mil.train_quality(docs, labels)
    quality_mil.train_quality(docs, labels, passages=100)
    assert seen[0] == ([1, 2, 3, 40, 400], 5)
    assert seen[1] == ([1, 2, 3, 40], 4)


def test_quality_edge(spark, edge, texts):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 1, 0), (8, 0, None), (None, 1, 1), (2, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_mil.score_quality(edge, quality_mil.train_quality(edge, labels)).collect()
    assert len(got) == len(texts)
    assert all(0 <= r.score <= 1 for r in got)
    none = quality_mil.train_quality(edge, labels.limit(0))
    assert {r.score for r in quality_mil.score_quality(edge, none).collect()} == {0.5}


# All


def test_empty(spark, empty):
    model = langid.fit_languages(empty)
    assert langid.predict_languages(empty, model).count() == 0
    assert bpe.bpe_digests(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_representatives(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    mil = quality_mil.train_quality(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_mil.score_quality(empty, mil).count() == 0


# Pipeline


def test_pipeline(spark, sf, documents, plain):
    """The stages' rows by brute force: languages by the model itself, then first of equal texts, of near copies, and the mix."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns, name
        out = spark.createDataFrame(out.collect(), documents.schema)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        ids = Counter(r.doc_id for r in out.collect())
        if name == "language ID":
            model = langid.fit_languages(docs.filter(crc32_mod(F.col("doc_id"), 4) != 2))
            said = model.predict([t for _, t in rows])
            assert ids == Counter(i for (i, _), (lang, _, unsure) in zip(rows, said, strict=True) if lang != "und" and not unsure)
        if name == "exact dedup":
            first = {}
            for i, t in sorted(rows):
                first.setdefault(" ".join(t.split()), i)
            assert set(ids) == set(first.values())
        if name == "SimHash near-dedup":
            assert set(ids) == set(brute_components([(i, plain_fingerprint(t)) for i, t in rows]))
        if name == "mixing sources":
            assert set(ids) <= {i for i, _ in rows}
            assert max(ids.values()) <= 3
        docs = out
    final = corpus_pipeline.run(spark, sf)
    lib = library()
    assert Counter((r.doc_id, r.n_tokens) for r in final.collect()) == Counter((r.doc_id, len(lib.encode_ordinary(r.text))) for r in docs.collect())
