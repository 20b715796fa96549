"""Language ID by error-correcting output codes over byte n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod

DIM = 1 << 12
#: Texts that the classifiers are fitted on, at most: a language, and in all. The sample is ordered by a hash of the text.
SAMPLE_PER_LANG = 400
SAMPLE = 4000
#: Codes of up to this many languages are exhaustive; longer lists get random codewords.
EXHAUSTIVE = 5
CODE_BITS = 31
#: A decision is ambiguous if the best codeword's share of the softmax over losses is below this.
AMBIGUOUS_BELOW = 0.5
EPOCHS, RATE, DECAY = 300, 4.0, 1e-5
UND = "und"


def _features(text: str) -> np.ndarray:
    """Frequencies of hashed byte 1-, 2- and 3-grams of letters and blanks, of unit length."""
    b = np.frombuffer(text.lower().encode("utf-8"), np.uint8)
    letter = (b >= 128) | ((b >= 97) & (b <= 122))
    b = np.where(letter, b, 32).astype(np.uint32)
    if len(b) > 1:
        b = b[~((b == 32) & (np.concatenate(([0], b[:-1])) == 32))]  # one blank for a run
    out = np.bincount((b * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM).astype(np.float64)
    if len(b) > 1:
        two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(1 << 17)
        out += np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    if len(b) > 2:
        three = (b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(257) + b[2:] + np.uint32(1 << 27)
        out += np.bincount((three * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(out)
    return (out / (np.sqrt((out * out).sum()) or 1.0)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1. Up to EXHAUSTIVE rows: every split of the rows into two, once each.

    Beyond: random columns from a fixed seed, of which none is constant, and rows all differ.
    """
    if k <= EXHAUSTIVE:
        m = max(1, 2 ** (k - 1) - 1)
        cols = np.arange(m)
        return np.array([[1 if r == 0 else (1 if (c >> (r - 1)) & 1 else -1) for c in cols] for r in range(k)], float)
    rng = np.random.default_rng(5)
    while True:
        code = rng.choice([-1.0, 1.0], (k, max(CODE_BITS, 4 * int(np.ceil(np.log2(k))))))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM + 1 x bits, the last row the bias
    accuracy: np.ndarray  # of each bit on the rows it was fitted on

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text.

        A bit's margin f counts against codeword bit c as the hinge-free loss log(1 + exp(-c f)),
        weighted by the bit's reliability; the codeword of least total loss wins. The score is its
        share of exp(-loss) over all codewords.
        """
        out = []
        trust = np.clip(self.accuracy - 0.5, 1e-3, None)
        trust = trust / trust.sum() * len(trust) if len(trust) else trust
        for t in texts:
            if not t or not self.langs or not any(map(str.isalpha, t)):
                out.append((UND, 0.0, True))
                continue
            f = _features(t) @ self.weights[:-1] + self.weights[-1]
            loss = (np.logaddexp(0, -self.code * f) * trust).sum(1)
            p = np.exp(-(loss - loss.min()))
            p = p / p.sum()
            best = int(p.argmax())
            out.append((self.langs[best], float(p[best]), bool(p[best] < AMBIGUOUS_BELOW)))
        return out


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Fit a classifier a bit on at most ``per_lang`` different whole texts of each language, and SAMPLE in all.

    Texts without letters and null languages are left out; languages count alike. Of each language
    the texts of least hash are taken. Executors count the different hashes, cut the hash range to
    a share that holds about 1.5 times the sample, fold copies and turn texts into DIM frequencies,
    so the driver gets rows of fixed size. The list of languages is on the driver.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    keyed = rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("text", F.lit(3)), 2))
    counts = {r.lang: r.n for r in keyed.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((DIM + 1, 1)), np.zeros(1))
    per_lang = max(1, min(per_lang, SAMPLE // len(langs)))
    cut = {k: int(min(1.0, 1.5 * (per_lang + 20) / counts[k]) * 2**62) for k in langs}
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(cut[k]))])
    bounded = keyed.filter(F.col("key") <= F.element_at(share, F.col("lang"))).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b.lang, "key": b.key, "x": [_features(t).tobytes() for t in b.text]})

    sample = bounded.select("lang", "key", "text").mapInPandas(vectors, "lang string, key long, x binary").toPandas()
    sample = sample.sort_values(["lang", "key", "x"]).groupby("lang").head(per_lang)
    langs = sorted(set(sample.lang))
    if not langs:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((DIM + 1, 1)), np.zeros(1))
    x = np.stack([np.frombuffer(v, np.float32) for v in sample.x]).astype(np.float64)
    y = sample.lang.map({k: i for i, k in enumerate(langs)}).to_numpy()
    code = codewords(len(langs))
    target = (code[y] + 1) / 2
    each = 1.0 / np.bincount(y, minlength=len(langs))[y] / len(langs)  # languages count alike
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((DIM + 1, code.shape[1]))
    speed = np.zeros_like(w)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        speed = 0.9 * speed - RATE * (xb.T @ ((p - target) * each[:, None]) + DECAY * w)
        w = w + speed
    right = ((xb @ w > 0) == (target > 0.5)).T.astype(float) @ each
    return LanguageModel(langs, code, w, right)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each whole text; one row per row of ``docs``.

    Null texts and texts without letters give ``und``, score 0, ambiguous. Of languages whose loss
    is equal the first by name counts. An empty table gives an empty result. The model (DIM x bits
    of float64, about 0.25 MB at 7 bits) is the only thing sent to the tasks.
    """
    rows = _judged(docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("row"), F.col(text_col).alias("text")), model)
    return rows.select("row.doc_id", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is one of the model's and not ambiguous.

    Repeated rows stay; null texts and texts without letters go; an empty table gives an empty result.
    """
    rows = _judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), model, docs.columns.index(text_col))
    return rows.filter((F.col("lang_pred") != UND) & ~F.col("ambiguous")).select("row.*")


#: Rows that are judged at a time.
SLICE = 1024


def _judged(rows: DataFrame, model: LanguageModel, place: int | None = None) -> DataFrame:
    """``rows`` (row, text) with predictions, row passing in Arrow as it is; with ``place``, text is that field of row and not sent again."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                said = model.predict((b.column(1) if place is None else b.column(0).field(place)).to_pylist())
                new = [pa.array([s[k] for s in said], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["row", "lang_pred", "score", "ambiguous"])

    schema = T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(judged, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs.filter(crc32_mod(F.col("doc_id"), 4) != 2))
    return predict_languages(docs, model).select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
