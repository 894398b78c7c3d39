"""Operator 6: toxicity by subword-bag embeddings and a linear softmax.

A text is the bag of its words, each distinct word once, and a word is the bag
of its byte n-grams of `GRAMS` lengths (A-Z lowered, the word between two spaces,
so that its beginning and end show; no n-gram crosses a space), hashed into
`BUCKETS` buckets. Every bucket that at least `MIN_DOCS` texts of the sample use has a vector; the text's vector is the average
over all its n-grams and `PRIOR` more with a zero vector, which keep a handful
of words from deciding alone, and a linear softmax gives the probability of
label 1. Vectors and softmax are trained
jointly in numpy (gradient steps on mini-batches), so an unseen misspelling scores through
the n-grams it shares with words that were seen.

Learning sees a bounded sample: at most `SAMPLE` labelled ids of the learning
folds, `TOXIC` of them toxic, the first of each by hash of the id (the scores
are carried back to the share of toxic rows among all labels); their bags, not their
texts, are gathered. A bag is made from the whole text, however long; of more than
`SAMPLE_GRAMS` distinct n-grams it keeps those of lowest hash, which stand for all
by weight (an n-gram counts 255 times at most). Where an id stands on several rows
the text of lowest hash is learned from. Every text is scored whole,
batch by batch, from one number per bucket (vectors times softmax).

Cases: a null or empty text has no n-gram and gets the learned prior; a
document with several labels is toxic if any of them is; with no row to learn
from, or one class only, every score is that class's share (0.5 without rows);
repeated rows each get their row; extra columns pass through.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, drawn, fold, share, spare, staged, table, texts_of, with_columns, with_field

GRAMS = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
SAMPLE = 4500     # labelled texts that are learned from,
TOXIC = 1500      # at most so many of them toxic
SAMPLE_GRAMS = 20_000
MIN_DOCS = 3      # n-grams of fewer sample documents get no vector
DIM = 8
EPOCHS = 8        # passes over a full sample; a smaller one gets more, so that the steps stay as many
PRIOR = 300
RATE = 3.0
BATCH = 32
GAIN = 60.0       # averages over hundreds of n-grams are small
THRESHOLD = 0.3
PIECE = 1 << 20  # bytes hashed at a time
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def normal(text: str) -> bytes:
    """Each distinct word of a text once, in order of first use, between single spaces."""
    return b" " + b" ".join(dict.fromkeys(text.encode("utf-8", "surrogatepass").lower().split())) + b" "


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a byte array and the place where each starts."""
    space = raw == 32
    wide = raw.astype(np.uint64)
    codes, places = [], []
    code, inner = wide, np.zeros(len(raw), bool)  # inner: a space stands inside the n-gram so far
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        m = len(raw) - n + 1
        code = code[:m] | (wide[n - 1:] << np.uint64(8 * (n - 1)))
        inner = inner[:m] | (space[n - 2:n - 2 + m] if n > 2 else False)
        if n in GRAMS:
            at = np.flatnonzero(~inner)
            codes.append((code[at] + np.uint64(n)) * np.uint64(_MULT[GRAMS.index(n)]) >> np.uint64(64 - BITS))
            places.append(at)
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(codes).astype(np.int32), np.concatenate(places)


@dataclass
class Model:
    logit: np.ndarray  # per bucket: what one occurrence adds before averaging
    offset: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1, each text whole; texts are hashed together, in pieces of bytes."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        group, size = [], 0
        for i, text in enumerate(texts):
            raw = normal(text)
            if len(raw) > PIECE:  # piece by piece, each overlapping the next by one n-gram less a byte
                for a in range(0, len(raw), PIECE):
                    self.add([i], [raw[a:a + PIECE + max(GRAMS) - 1]], total, count, PIECE)
                continue
            group.append((i, raw))
            size += len(raw)
            if size > PIECE:
                self.add(*zip(*group), total, count)
                group, size = [], 0
        if group:
            self.add(*zip(*group), total, count)
        z = total / (count + PRIOR) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def add(self, rows, raws, total: np.ndarray, count: np.ndarray, limit: int | None = None) -> None:
        flat = np.frombuffer(b"".join(raws), np.uint8)
        codes, places = grams(flat)
        if limit is not None:
            codes, places = codes[places < limit], places[places < limit]
        ends = np.cumsum([len(r) for r in raws])
        owner = np.searchsorted(ends, places, side="right")
        total[list(rows)] += np.bincount(owner, self.logit[codes], len(raws))
        count[list(rows)] += np.bincount(owner, minlength=len(raws))


def bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct n-grams of a whole text, how often each occurs (255 at most), and how many there are in all;
    of more than SAMPLE_GRAMS those whose hash is lowest."""
    raw = np.frombuffer(normal(text), np.uint8)
    if len(raw) <= PIECE:
        ids, counts = np.unique(grams(raw)[0], return_counts=True)
    else:
        full = np.zeros(BUCKETS, np.int64)
        for a in range(0, len(raw), PIECE):
            codes, places = grams(raw[a:a + PIECE + max(GRAMS) - 1])
            full += np.bincount(codes[places < PIECE], minlength=BUCKETS)
        ids = np.flatnonzero(full)
        counts = full[ids]
    total = int(counts.sum())
    if len(ids) > SAMPLE_GRAMS:  # bucket numbers are hashes already; this spreads them once more
        low = np.argsort((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT[0]), kind="stable")[:SAMPLE_GRAMS]
        ids, counts = ids[np.sort(low)], counts[np.sort(low)]
    return ids, np.minimum(counts, 255), total


def learning(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the learning folds."""
    return (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.max("toxic").cast("int").alias("toxic")).filter(fold(F.col("doc_id"), 4) != 2))


def training_bags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, ids, counts, total) of the bounded sample of labelled ids."""
    def run(batches: Batches) -> Batches:
        kind = pa.schema([("toxic", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())])
        for batch in batches:
            rows = []
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch)):
                ids, counts, total = bag(text)
                rows.append({"toxic": toxic, "ids": ids.astype("<u4").tobytes(), "total": total,
                             "counts": counts.astype(np.uint8).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, kind)

    marks = learning(labels)
    part = lambda toxic, n: drawn(marks.filter((F.col("toxic") > 0) == toxic), n, "doc_id")
    sample = staged(part(True, TOXIC).unionByName(part(False, SAMPLE - TOXIC)), "labelled")
    # bounded: SAMPLE rows of two numbers; one text of each id
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id")
            .agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"), F.first("toxic").alias("toxic")))
    return rows.select("toxic", "text").mapInArrow(run, "toxic int, ids binary, counts binary, total bigint")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    # one partition at a time, so that the driver holds each bag once
    rows = training_bags(docs, labels).orderBy("toxic", "ids").toLocalIterator()
    bags, marks = [], []
    for row in rows:
        bags.append((np.frombuffer(row.ids, "<u4"), np.frombuffer(row.counts, np.uint8), row.total))
        marks.append(row.toxic > 0)
    y = np.array(marks, np.float32)
    if not len(y):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    if y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if y[0] else -20.0)
    seen = np.zeros(BUCKETS, np.int32)
    for ids, *_ in bags:
        seen[ids] += 1
    kept = np.flatnonzero(seen >= MIN_DOCS)
    dense = np.full(BUCKETS, -1, np.int32)
    dense[kept] = np.arange(len(kept))
    for i, (ids, counts, total) in enumerate(bags):
        at = dense[ids] >= 0
        part = total / max(1, counts.sum(dtype=np.int64))  # what the kept n-grams stand for
        bags[i] = dense[ids[at]], counts[at], np.float32(GAIN * part / (PRIOR + total))
    # plain gradient steps: n-grams that few texts share move little, which keeps them from being learned by heart
    rng = np.random.default_rng(6)
    vectors = rng.normal(0, 0.01, (len(kept), DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.array([0, np.log(y.mean() / (1 - y.mean()))], np.float32)
    epochs = max(EPOCHS, min(60, EPOCHS * SAMPLE // len(bags)))
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(bags), BATCH):
            rows = order[a:a + BATCH]
            ids = np.concatenate([bags[i][0] for i in rows])
            weight = np.concatenate([bags[i][1] * bags[i][2] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            part = weight[:, None] * vectors[ids]
            hidden = np.stack([np.bincount(owner, part[:, d], len(rows)) for d in range(DIM)], axis=1)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - np.stack([1 - y[rows], y[rows]], axis=1)) / len(rows)
            back = (error @ out.T).astype(np.float32)
            used, place = np.unique(ids, return_inverse=True)
            grad = weight[:, None] * back[owner]
            vectors[used] -= rate * np.stack([np.bincount(place, grad[:, d], len(used)) for d in range(DIM)], axis=1)
            out -= 0.1 * rate * (hidden.T @ error)
            bias -= 0.1 * rate * error.sum(axis=0)
    logit = np.zeros(BUCKETS, np.float32)
    logit[kept] = GAIN * (vectors @ (out[:, 1] - out[:, 0]))
    # the sample holds more toxic texts than the labels do: back to the odds of all labels of the learning folds
    n, toxic = learning(labels).agg(F.count(F.lit(1)), F.count_if(F.col("toxic") > 0)).first()
    shift = np.log(toxic / (n - toxic)) - np.log(y.mean() / (1 - y.mean()))
    return Model(logit, float(bias[1] - bias[0] + shift))


def score(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """`docs` with a double column `out`: the probability that the text is toxic."""
    out = spare(docs, out)
    shared = share(docs.sparkSession, model)

    def run(batches: Batches) -> Batches:
        model = shared()
        for batch in batches:
            yield with_columns(batch, **{out: pa.array(model.score(texts_of(batch)), pa.float64())})

    return docs.mapInArrow(run, with_field(docs, out, "double"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    p = F.col("toxicity")
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), p.alias("score"),
                                     (p >= THRESHOLD).cast("int").alias("predicted"))
