"""Quality classifier: gated attention over the passages of a document, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, materialise, word_count

#: A passage has this many words.
PASSAGE_WORDS = 96
#: Passages that are held at a time.
BLOCK_PASSAGES = 1024
#: Labelled documents that the model is fitted on, at most, in the order of a hash of their ids, and the passages of all of them together.
SAMPLE, SAMPLE_PASSAGES = 3000, 200_000
HASHED = 96
HIDDEN, ATTENTION = 24, 12
EPOCHS, RATE, DECAY = 250, 0.02, 1e-4
THRESHOLD = 0.3

#: Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 stop or comma, 5 other mark, 6 not ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord("."), ord(",")]] = 4
_CLASS[128:] = 6
CLASSES = 7
PLAIN = 5
WIDTH = CLASSES + PLAIN + HASHED


def passage_blocks(text: str | None) -> Iterator[np.ndarray]:
    """A row of WIDTH float32 for each passage of the whole text, BLOCK_PASSAGES at a time; one of zeros if it has no words.

    Shares of byte classes; mean word length, share of repeats of the word before, share of
    different words, share of words seen in the passage before, log size; hashed pairs of byte
    classes and bytes that are no letters.
    """
    words = (text or "").encode("utf-8").split()
    if not words:
        yield np.zeros((1, WIDTH), np.float32)
    held: set[bytes] = set()
    before = np.zeros(0, np.int64)
    for at in range(0, len(words), PASSAGE_WORDS * BLOCK_PASSAGES):
        some = words[at : at + PASSAGE_WORDS * BLOCK_PASSAGES]
        first = np.arange(0, len(some), PASSAGE_WORDS)
        n = len(first)
        u = np.frombuffer(b" ".join(some) + (b" " if at + len(some) < len(words) else b""), np.uint8)
        lens = np.fromiter(map(len, some), np.int64, len(some)) + 1
        starts = np.cumsum(lens) - lens
        cls = _CLASS[u]
        passage = np.repeat(np.arange(n), np.diff(np.append(starts[first], len(u))))
        counts = np.bincount(passage * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
        total = counts.sum(1, keepdims=True)
        out = np.zeros((n, WIDTH), np.float64)
        out[:, :CLASSES] = counts / total
        for k, i in enumerate(first):
            w = some[i : i + PASSAGE_WORDS]
            here = set(w)
            again = sum(x == y for x, y in zip(w, w[1:], strict=False))
            out[k, CLASSES : CLASSES + PLAIN] = (total[k, 0] / len(w) / 10, again / len(w), len(here) / len(w), sum(x in held for x in here) / len(here), np.log1p(len(w)) / 6)
            held = here
        code = np.concatenate((before, np.where(cls <= 1, cls, u.astype(np.int64) + 2)))
        pair = (code[:-1] * 259 + code[1:]) * 2654435761 % (1 << 32) * HASHED >> 32
        if len(pair):
            h = np.bincount(passage[len(passage) - len(pair) :] * HASHED + pair, minlength=n * HASHED).reshape(n, HASHED)
            out[:, CLASSES + PLAIN :] = np.sqrt(h / total)
        before = code[-1:]
        yield out.astype(np.float32)


def passage_features(text: str | None) -> np.ndarray:
    """All rows of passage_blocks()."""
    return np.concatenate(list(passage_blocks(text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class MilModel:
    """h = tanh(x E + e); attention a = softmax of w . (tanh(h V) * sigmoid(h U)) over a document's passages;
    score = sigmoid(c . sum(a h) + b)."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None  # the score where there was nothing to learn

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        doc = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        ex = np.exp(s - np.maximum.reduceat(s, start)[doc])
        a = ex / np.add.reduceat(ex, start)[doc]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "doc": doc, "y": _sigmoid(z @ p["c"] + p["b"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        if not bags:
            return np.zeros(0)
        start = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags).astype(np.float64), start)["y"]

    def score_blocks(self, blocks: Iterable[np.ndarray]) -> float:
        """The score of one document whose passages come in blocks: the softmax's sums are carried on."""
        if self.constant is not None:
            return self.constant
        p, top, weight, z = self.p, -np.inf, 0.0, 0.0
        for x in blocks:
            h = np.tanh((x.astype(np.float64) - self.mean) / self.scale @ p["E"] + p["e"])
            s = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            new = max(top, s.max())
            ex, old = np.exp(s - new), np.exp(top - new)
            top, weight, z = new, weight * old + ex.sum(), z * old + ex @ h
        return float(_sigmoid(z / weight @ p["c"] + p["b"])[0])

    def score_texts(self, texts: Iterable[str | None]) -> np.ndarray:
        """Scores of whole texts; at most about 2 * BLOCK_PASSAGES passages are held at a time."""
        out, bags = [], []
        for t in texts:
            blocks = passage_blocks(t)
            one = next(blocks)
            if len(one) == BLOCK_PASSAGES:
                out += [*self.scores(bags), self.score_blocks(chain([one], blocks))]
                bags = []
                continue
            bags.append(one)
            if sum(map(len, bags)) >= BLOCK_PASSAGES:
                out += [*self.scores(bags)]
                bags = []
        return np.array([*out, *self.scores(bags)], np.float64)


def gradient(m: MilModel, x: np.ndarray, start: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the weighted cross-entropy of document labels by each parameter."""
    p, f = m.p, m.forward(x, start)
    dz_ = (f["y"] - labels) * weight
    grad = {"c": f["z"].T @ dz_, "b": dz_.sum(keepdims=True)}
    dz = dz_[:, None] * p["c"]
    along = (dz[f["doc"]] * f["h"]).sum(1)
    ds = f["a"] * (along - np.add.reduceat(f["a"] * along, start)[f["doc"]])
    dtg = ds[:, None] * p["w"]
    grad["w"] = (f["t"] * f["g"]).T @ ds
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (f["a"][:, None] * dz[f["doc"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    grad["E"], grad["e"] = f["x"].T @ dh, dh.sum(0)
    return grad


def fit_mil(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> MilModel:
    """Adam on the cross-entropy of document labels, both classes weighed alike; no label of a passage is known."""
    if len(labels) == 0 or labels.min() == labels.max():
        return MilModel({}, np.zeros(1), np.ones(1), float(labels.mean()) if len(labels) else 0.5)
    x = np.concatenate(bags).astype(np.float64)
    start = np.cumsum([0, *map(len, bags[:-1])])
    rng = np.random.default_rng(8)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"E": init(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "b": np.zeros(1)}
    m = MilModel(p, x.mean(0), x.std(0) + 1e-3)
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean()) / len(labels)
    one, two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        grad = gradient(m, x, start, labels, weight)
        for k in p:
            d = grad[k] + DECAY * p[k]
            one[k] = 0.9 * one[k] + 0.1 * d
            two[k] = 0.999 * two[k] + 0.001 * d * d
            p[k] -= RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return m


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> MilModel:
    """Fit on at most ``sample`` labelled documents, all passages of their whole texts.

    The labels of least id hash are chosen before texts are touched, so at most ``sample`` ids
    are broadcast to the scan of ``docs``; in that order, documents are taken as long as they have
    ``passages`` passages together, and one of more than that is passed over. Ids with null or
    contradictory labels are left out; of rows that repeat an id, the least text counts. The driver
    gets at most ``passages`` rows of WIDTH floats. Without labels every score is 0.5, with one
    class its share. Ids of one hash go by id.
    """
    one = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i IS NOT NULL AND y IS NOT NULL")
    one = one.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("i", "y")
    chosen = one.join(docs.select(F.col(id_col).alias("i")).distinct(), "i", "left_semi").orderBy(F.xxhash64("i", F.lit(8)), "i").limit(sample)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, y, t in zip(b.i, b.y, b.t, strict=True):
                yield pd.DataFrame({"i": [i], "y": [y], "x": [passage_features(t).tobytes()]})

    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")
    texts = materialise(texts.groupBy("i", "y").agg(F.min("t").alias("t")))
    size = texts.select("i", F.greatest(F.lit(1), F.ceil(word_count(F.col("t")) / PASSAGE_WORDS)).alias("n")).filter(F.col("n") <= passages)
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("i", F.lit(8)), "i"))  # over ``sample`` numbers at most
    taken = size.withColumn("n", so_far).filter(F.col("n") <= passages).select("i")
    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.join(F.broadcast(taken), "i").mapInPandas(features, f"i {kind}, y int, x binary").toPandas().sort_values("i")
    return fit_mil([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in got.x], got.y.to_numpy(np.float64))


def score_quality(docs: DataFrame, model: MilModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of every whole text; one row per row of ``docs``.

    Ties need no rule, as scores are of texts alone. Null, empty and blank texts are one passage of zeros and get that passage's score. Equal texts
    have equal scores; an empty table gives an empty result.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "score": model.score_texts(b.text)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scored, f"doc_id {kind}, score double")


def op8_quality_mil(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; fitted on labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs.filter(crc32_mod(F.col("doc_id"), 5) != 0), labels)
    held = (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return score_quality(docs, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
