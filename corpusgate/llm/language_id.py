"""Operator 10: language identification with blended-spectrum string kernels.

A text is the set of its byte n-grams for n = 1..4 (lower-cased, white space as
one space), hashed into `BINS` bins per n: the presence vector. The blended
kernel of two texts is the mean over n of the cosine of their presence vectors.
`LANDMARKS` training texts are the Nyström landmarks; kernel ridge regression,
one-versus-rest, gives one weight vector per language in the Nyström space, and
the weights are carried back to the landmarks, so a batch is scored by two
matrix products: texts x landmarks (the kernel), then landmarks x languages.

What is fitted sees a bounded sample: at most `PER_LANG` different labelled texts
of each of the `MAX_LANGS` most frequent languages, the first by hash of the text;
copies of a text are one, and ids play no part. Every text is scored whole.
Learning reads only text and lang of rows outside the held-out fold.

Cases: a null text, or one without any letter, gives `und` with score 0; rows
with null lang, or with text that gives `und`, are not learned from; with no
row to learn from everything is `und`, and the filter keeps every text that has
a letter; null and repeated ids change nothing; one language only is then always that
one; ties go to the smaller language value; extra columns pass through.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, fold, low_hash, share, spare, table, with_columns, with_field

SPECTRUM = (1, 2, 3, 4)
BINS = 2048
PER_LANG = 400
MAX_LANGS = 256
LANDMARKS = 192
RIDGE = 1e-2
UND = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_MULT = np.array([0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, set(text))))


def presence(texts: list[str]) -> np.ndarray:
    """(texts, len(SPECTRUM) * BINS) float32: 1 for each hashed n-gram that occurs, scaled so that
    the product of two rows is the mean over n of the cosines."""
    out = np.zeros((len(texts), len(SPECTRUM), BINS), np.float32)
    for row, text in zip(out, texts):
        raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" ", np.uint8)
        code = np.zeros(len(raw), np.uint32)
        for k, n in enumerate(SPECTRUM):
            if len(raw) < n:
                break
            code = code[:len(raw) - n + 1] | (raw[n - 1:].astype(np.uint32) << np.uint32(8 * (n - 1)))
            row[k][((code ^ (code >> np.uint32(15))) * _MULT[n]) >> np.uint32(32 - BINS.bit_length() + 1)] = 1
    norm = np.sqrt(out.sum(axis=2, keepdims=True) * len(SPECTRUM))
    np.divide(out, norm, out=out, where=norm > 0)
    return out.reshape(len(texts), -1)


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # (landmarks, bins)
    weights: np.ndarray    # (landmarks + 1, languages); the last row is the offset

    def score(self, texts: list[str]) -> np.ndarray:
        kernel = presence(texts) @ self.landmarks.T
        return kernel @ self.weights[:-1] + self.weights[-1]


def train_sample(docs: DataFrame) -> DataFrame:
    """(lang, hash, text) of the bounded sample: different labelled texts, about 4 PER_LANG of each language."""
    rows = (docs.filter((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select("lang", "text"))
    # one row per language; different texts, not rows, are counted, so that copies thin nothing out
    langs = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
             .orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select("lang", "texts"))
    # bounded: MAX_LANGS rows. Of each language only the lowest hashes go on, a few PER_LANG at any size
    return (rows.join(F.broadcast(langs), "lang").filter(low_hash(4.0 * PER_LANG / F.col("texts"), "text"))
            .groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text")))


def fit(docs: DataFrame) -> Model | None:
    kind = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("bits", pa.binary())])

    def features(batches: Batches) -> Batches:
        for batch in batches:
            for lang, mark, text in zip(*[batch.column(c).to_pylist() for c in kind.names[:2]], batch.column("text").to_pylist()):
                if has_letter(text):
                    yield pa.RecordBatch.from_pylist([{"lang": lang, "hash": mark, "bits": np.packbits(presence([text])[0] > 0).tobytes()}], kind)

    order = Window.partitionBy("lang").orderBy("hash", "bits")
    # bounded: MAX_LANGS * PER_LANG rows of a kilobyte
    rows = (train_sample(docs).mapInArrow(features, "lang string, hash bigint, bits binary")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PER_LANG)
            .select("lang", "bits").orderBy("lang", "bits").collect())
    if not rows:
        return None
    langs = sorted({r.lang for r in rows})
    raw = np.stack([np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8)) for r in rows]).astype(np.float32)
    cube = raw.reshape(len(rows), len(SPECTRUM), BINS)
    norm = np.sqrt(cube.sum(axis=2, keepdims=True) * len(SPECTRUM))
    x = np.divide(cube, norm, out=np.zeros_like(cube), where=norm > 0).reshape(len(rows), -1)
    y = np.full((len(rows), len(langs)), -1.0)
    y[np.arange(len(rows)), [langs.index(r.lang) for r in rows]] = 1.0
    pick = np.random.default_rng(10).permutation(len(rows))[:LANDMARKS]
    marks = x[pick]
    small, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = small > 1e-6 * small.max()
    whiten = vectors[:, keep] / np.sqrt(small[keep])  # landmark kernel ^ -1/2
    phi = np.hstack([(x @ marks.T) @ whiten, np.ones((len(rows), 1))])
    weight = 1.0 / np.maximum(1, (y > 0).sum(axis=0))[y.argmax(axis=1)]  # languages count alike
    weight *= len(rows) / weight.sum()
    gram = (phi * weight[:, None]).T @ phi
    penalty = RIDGE * np.eye(phi.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(gram + penalty, (phi * weight[:, None]).T @ y)
    return Model(langs, marks, np.vstack([whiten @ beta[:-1], beta[-1:]]).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, out: str = "lang_id") -> DataFrame:
    """`docs` with a struct column `out`: lang (a learned value or `und`) and score.

    The score of the best language is 1 / (1 + exp(-4 m)), m being its margin
    over the second one (over -1 when only one language was learned).
    """
    out = spare(docs, out)
    shared = share(docs.sparkSession, model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Batches) -> Batches:
        model = shared()
        for batch in batches:
            langs, scores = [UND] * len(batch), [0.0] * len(batch)
            texts = batch.column("text").to_pylist()
            rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for a in range(0, len(rows), 256):
                part = rows[a:a + 256]
                got = model.score([texts[i] for i in part])
                best = got.argmax(axis=1)
                top = got[np.arange(len(part)), best]
                rest = np.sort(got, axis=1)[:, -2] if got.shape[1] > 1 else np.full(len(part), -1.0)
                sure = 1 / (1 + np.exp(-4 * (top - rest).astype(np.float64)))
                for i, b, s in zip(part, best.tolist(), sure.tolist()):
                    langs[i], scores[i] = model.langs[b], s
            yield with_columns(batch, **{out: pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))})

    return docs.mapInArrow(run, with_field(docs, out, "struct<lang: string, score: double>"))


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` without the rows whose language cannot be told (`und`); without a model, those without a letter."""
    if model is None:
        def lettered(batches: Batches) -> Batches:
            for batch in batches:
                yield batch.filter(pa.array(map(has_letter, batch.column("text").to_pylist()), pa.bool_()))

        return docs.mapInArrow(lettered, docs.schema)
    out = spare(docs, "lang_id")
    return identify(docs, model, out).filter(F.col(out)["lang"] != UND).drop(out)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
                        F.col("lang_id")["lang"].alias("lang_pred"), F.col("lang_id")["score"].alias("score"))
