"""Operator 2: a Brown class-based bigram model, its classes found by exchange clustering.

Tokens: words (A-Z lowered, runs of anything but ASCII white space), then one
end per document. The model is P(w | v) = P(c(w) | c(v)) P(w | c(w)).

Classes. All words of the training texts are counted, summed in each task before
the exchange. The `TABLE` most frequent of those that occur `MIN_COUNT` times (ties by word) are
exchanged among `CLASSES` classes: in every round words move to the class that fits their left and right
neighbours' classes best, given the class counts of the round before. A round
that makes the training texts less likely is undone, and fewer words may move
at once in the next. Every other word that occurs `MIN_COUNT` times then joins the
class that fits its neighbours' classes best; what stands beside it is counted
by word in Spark. Rarer words, seen or not, form one more class, and so does the
end. A round is
one pass over the staged ids: every task counts, per word, the classes beside
it, blocks of words are added up by one shuffle, and the best classes are chosen
block by block. The driver sees one class per table word and the class matrix.

Probabilities. P(c | b) = (N(b, c) + ALPHA P(c)) / (N(b) + ALPHA). Inside a class
P(w | c) = n(w) / n(c); in the class of the rarer words it is
(n(w) + 0.1) / (n + 0.1 (V' + 1)), V' being its distinct training words, so that
unseen words have a share and everything sums to one.

Look-up is in two tiers: the table (of bounded size) is broadcast; words outside
it go through a join on the word to their counts and classes, and come back per
document as sums and as the classes of their places.

Cases: null and empty texts are one end token; repeated rows each get their row
(rows are told apart by a staged row number); with no training row every count
is 0 and the class matrix is uniform; an empty table gives no row.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, fold, share, staged, table, texts_of

TABLE = 1 << 17
MIN_COUNT = 8  # rarer words are not clustered
CLASSES = 32
ROUNDS = 4
ALPHA = 1.0
DELTA = 0.1   # added to counts in the class of other words and in the base model
BLOCK = 4096  # table words whose counts travel together
HELD = 200_000  # words that a task counts before it passes them on


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the texts and how often it occurs."""
    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()

        def out() -> Batches:
            words, n = list(counts), list(counts.values())
            for a in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_pydict({"word": pa.array(words[a:a + (1 << 16)], pa.binary()),
                                                  "n": pa.array(n[a:a + (1 << 16)], pa.int64())})
            counts.clear()

        for batch in batches:
            for text in texts_of(batch):
                counts.update(words_of(text))
                if len(counts) > HELD:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, keep: int) -> list[bytes]:
    """The `keep` most frequent words of those that occur `MIN_COUNT` times, ties by word, most frequent first."""
    often = counts.filter(F.col("n") >= MIN_COUNT)
    left, rows = keep, []
    # one row per distinct count: at most about the root of twice the number of tokens
    for n, words in sorted(map(tuple, often.groupBy("n").count().collect()), reverse=True):
        if words > left:
            rows = often.filter(F.col("n") == n).orderBy("word").limit(left).collect() if left else []
            often = often.filter(F.col("n") > n)
            break
        left -= words
    return [bytes(r.word) for r in sorted(often.collect() + rows, key=lambda r: (-r.n, bytes(r.word)))]


def encode(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(row, doc_id, held_out, ids, others, places): table numbers of the words (one past the table for
    any other word) as uint32, and the distinct other words with the places where they stand."""
    size = len(vocabulary)
    shared = share(docs.sparkSession, vocabulary)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32()))]
    names = ["row", "doc_id", "held_out", "ids", "others", "places"]

    def run(batches: Batches) -> Batches:
        number = {w: i for i, w in enumerate(shared())}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, len(batch), 1024):  # a slice at a time: its words are Python objects
                part = batch.slice(a, 1024)
                ids, others, places, times, rows, upto = [], [], [], [], [], [0]
                for text in texts_of(part):
                    words = words_of(text)
                    seq = np.fromiter(map(number.get, words, repeat(size)), np.uint32, len(words))
                    at = np.flatnonzero(seq == size).astype(np.int32)
                    rest: dict[bytes, int] = {}
                    which = np.array([rest.setdefault(words[i], len(rest)) for i in at.tolist()], np.int64)
                    ids.append(seq.tobytes())
                    others.extend(rest)
                    upto.append(len(others))
                    places.append(at[np.argsort(which, kind="stable")])
                    times.append(np.bincount(which, minlength=len(rest)))
                    rows.append(row)
                    row += 1
                ends = np.concatenate([[0], np.cumsum(np.concatenate(times))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(places), pa.int32()))
                data = [rows, part.column("doc_id"), part.column("held_out"), ids,
                        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(others, pa.binary())),
                        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lists)]
                yield pa.RecordBatch.from_arrays(
                    [d if isinstance(d, pa.Array) else pa.array(d, k) for d, k in zip(data, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, ids binary, others array<binary>, places array<array<int>>")


def sequence(blobs: list[bytes], size: int, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents one after another with an end (size + 1) before, between and after them,
    and the places of those ends."""
    parts = [np.frombuffer(b, kind) for b in blobs]
    ends = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    seq = np.full(ends[-1] + 1, size + 1, kind)
    for p, at in zip(parts, ends):
        seq[at + 1:at + 1 + len(p)] = p
    return seq, ends


def neighbour_counts(coded: DataFrame, classes: np.ndarray, n_classes: int) -> DataFrame:
    """(block, counts) summed over the training texts: for each table word how often each class stands
    left and right of it (int64, zlib), and as block -1 the class bigram matrix."""
    size, wide = len(classes), n_classes + 2
    shared = share(coded.sparkSession, np.concatenate([classes, [n_classes, n_classes + 1]]).astype(np.int64))

    def out(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "block": pa.array(list(found), pa.int32()),
            "counts": pa.array([zlib.compress(a.astype("<i8").tobytes(), 1) for a in found.values()], pa.binary())})

    def count(batches: Batches) -> Batches:
        of = shared()
        left = np.zeros(size * wide, np.int64)
        right = np.zeros(size * wide, np.int64)
        pairs = np.zeros(wide * wide, np.int64)
        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            for a in range(0, len(blobs), 1024):
                seq, _ = sequence(blobs[a:a + 1024], size)
                cls = of[seq]
                pairs += np.bincount(cls[:-1] * wide + cls[1:], minlength=wide * wide)
                at = np.flatnonzero(seq < size)
                base = seq[at].astype(np.int64) * wide
                np.add(left, np.bincount(base + cls[at - 1], minlength=len(left)), out=left)
                np.add(right, np.bincount(base + cls[at + 1], minlength=len(right)), out=right)
        both = np.stack([left.reshape(size, wide), right.reshape(size, wide)], axis=1)
        yield out({-1: pairs} | {b: both[b * BLOCK:(b + 1) * BLOCK] for b in range(-(-size // BLOCK))})

    def add(batches: Batches) -> Batches:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                a = np.frombuffer(zlib.decompress(blob), "<i8")
                found[block] = found[block] + a if block in found else a
        yield out(found)

    schema = "block int, counts binary"
    return coded.filter(~F.col("held_out")).select("ids").mapInArrow(count, schema).repartition("block").mapInArrow(
        add, schema)


def matrix_of(counts: DataFrame, wide: int) -> np.ndarray:
    row = counts.filter("block = -1").first()
    return (np.frombuffer(zlib.decompress(bytes(row.counts)), "<i8").reshape(wide, wide) if row
            else np.zeros((wide, wide), np.int64))


def fit_of(pairs: np.ndarray) -> float:
    """What the class matrix adds to the log-likelihood of the training texts."""
    logs = lambda a: float((a[a > 0] * np.log(a[a > 0])).sum())
    return logs(pairs) - logs(pairs.sum(axis=0)) - logs(pairs.sum(axis=1))


def fits(both: np.ndarray, pairs: np.ndarray, n_classes: int) -> np.ndarray:
    """How well each class fits each word: `both` has, per word, the classes left and right of it."""
    log = np.log(pairs + 0.5)
    total = (np.log(pairs.sum(axis=0) + 0.5) + np.log(pairs.sum(axis=1) + 0.5))[:n_classes]
    n = both[:, 0].sum(axis=1)
    return both[:, 0] @ log[:, :n_classes] + both[:, 1] @ log[:n_classes].T - n[:, None] * total


def best_classes(counts: DataFrame, classes: np.ndarray, n_classes: int, parts: int, turn: int) -> tuple:
    """Each word's best class and its count, chosen block by block; one word in `parts` may move, by hash and turn."""
    wide = n_classes + 2
    pairs = matrix_of(counts, wide)
    shared = share(counts.sparkSession, (pairs, classes))

    def run(batches: Batches) -> Batches:
        pairs, classes = shared()
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                both = np.frombuffer(zlib.decompress(blob), "<i8").reshape(-1, 2, wide).astype(np.float64)
                n = both[:, 0].sum(axis=1)
                fit = fits(both, pairs, n_classes)
                now = classes[block * BLOCK:block * BLOCK + len(n)].copy()
                spread = (np.arange(len(n)) + block * BLOCK) * 2654435761 % (1 << 32) >> 8
                move = (n > 0) & ((spread + turn) % parts == 0)
                now[move] = fit.argmax(axis=1)[move]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()),
                                                  "classes": pa.array([now.astype("<i4").tobytes()], pa.binary()),
                                                  "n": pa.array([n.astype("<i8").tobytes()], pa.binary())})

    rows = counts.filter("block >= 0").mapInArrow(run, "block int, classes binary, n binary").orderBy("block").collect()
    join = lambda name, kind: np.frombuffer(b"".join(bytes(r[name]) for r in rows), kind)
    return join("classes", "<i4").astype(np.int64), join("n", "<i8"), pairs


def cluster(coded: DataFrame, size: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple:
    """Classes and counts of the table words, and the final class bigram matrix."""
    # by frequency rank, so that every class starts with a frequent word
    classes = np.arange(size, dtype=np.int64) % n_classes
    counts = staged(neighbour_counts(coded, classes, n_classes), "class-counts")
    fit, parts = fit_of(matrix_of(counts, n_classes + 2)), 1
    for turn in range(rounds):
        moved, _, _ = best_classes(counts, classes, n_classes, parts, turn)
        after = staged(neighbour_counts(coded, moved, n_classes), "class-counts")
        fit_after = fit_of(matrix_of(after, n_classes + 2))
        if fit_after > fit:
            classes, counts, fit, parts = moved, after, fit_after, max(parts, 2)
        else:
            # words that moved at once spoiled each other's gains: the round is undone, fewer may move in the next
            parts *= 2
    _, n, pairs = best_classes(counts, classes, n_classes, 1, 0)
    return classes, n, pairs


def spots(found: pa.ListArray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What documents hold of other words, one after another: the first fields of all (places, ...) structs, the
    entry each place belongs to, and the places counted from the documents' `starts`."""
    lens = pc.fill_null(found.value_lengths(), 0).to_numpy()
    places, first = found.flatten().flatten()
    times = places.value_lengths().to_numpy()
    at = np.repeat(np.repeat(starts, lens), times) + places.flatten().to_numpy()
    return first, np.repeat(np.arange(len(times)), times), at


def classes_of_others(coded: DataFrame, counts: DataFrame, classes: np.ndarray, pairs: np.ndarray,
                      n_classes: int) -> DataFrame:
    """(word, n, class): the class that fits best of every word outside the table that occurs `MIN_COUNT` times."""
    size, wide = len(classes), n_classes + 2
    shared = share(coded.sparkSession, np.concatenate([classes, [n_classes, n_classes + 1]]).astype(np.int64))

    def beside(batches: Batches) -> Batches:
        of = shared()
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                seq, ends = sequence(part.column("ids").to_pylist(), size)
                cls = of[seq]
                words, entry, at = spots(part.column("found"), ends[:-1] + 1)
                if not len(at):
                    continue
                words = words.dictionary_encode()
                entry = words.indices.to_numpy()[entry].astype(np.int64) * 2 * wide
                keys, n = np.unique(np.concatenate([entry + cls[at - 1], entry + wide + cls[at + 1]]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": words.dictionary.take(pa.array(keys // (2 * wide))),
                                                  "place": pa.array(keys % (2 * wide), pa.int32()),
                                                  "k": pa.array(n, pa.int64())})

    found = (coded.filter(~F.col("held_out")).select("ids", F.arrays_zip("places", "others").alias("found"))
             .mapInArrow(beside, "word binary, place int, k bigint")
             .groupBy("word", "place").agg(F.sum("k").alias("k"))
             .groupBy("word").agg(F.collect_list(F.struct("place", "k")).alias("beside"))  # at most 2 * wide each
             .join(counts.filter(F.col("n") >= MIN_COUNT), "word"))

    def choose(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("beside")
            place, k = (x.to_numpy() for x in lists.flatten().flatten())
            both = np.zeros((len(batch), 2 * wide))
            both[np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy()), place] = k
            best = fits(both.reshape(-1, 2, wide), pairs, n_classes).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(best, pa.int32())],
                                             ["word", "n", "class"])

    return found.select("word", "n", "beside").mapInArrow(choose, "word binary, n bigint, class int")


def follow_counts(typed: DataFrame, n_classes: int) -> np.ndarray:
    """The class bigram matrix of the training texts."""
    wide = n_classes + 2

    def run(batches: Batches) -> Batches:
        pairs = np.zeros(wide * wide, np.int64)
        for batch in batches:
            blobs = batch.column("classes").to_pylist()
            for a in range(0, len(blobs), 1024):
                cls = sequence(blobs[a:a + 1024], n_classes, np.uint16)[0].astype(np.int64)
                pairs += np.bincount(cls[:-1] * wide + cls[1:], minlength=wide * wide)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.flatnonzero(pairs), pa.int32()),
                                          "n": pa.array(pairs[pairs > 0], pa.int64())})

    pairs = np.zeros(wide * wide, np.int64)
    rows = typed.filter(~F.col("held_out")).select("classes").mapInArrow(run, "pair int, n bigint")
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    return pairs.reshape(wide, wide)


def score(docs: DataFrame, held_out, size: int = TABLE, n_classes: int = CLASSES) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held_out` is a Column; the model learns from the rows where it is false.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("held_out", held_out).select("doc_id", "held_out", "text")
    counts = staged(word_counts(docs.filter(~F.col("held_out"))), "word-counts")
    vocabulary = most_frequent(counts, size)
    coded = staged(encode(docs, vocabulary), "word-ids")
    size = len(vocabulary)
    classes, n, pairs = cluster(coded, size, n_classes)
    others = staged(classes_of_others(coded, counts, classes, pairs, n_classes), "other-classes")

    rare = F.col("n") < MIN_COUNT
    types, tokens, rare_types, rare_tokens = counts.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(rare, 1)),
        F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0))).first()
    texts = coded.filter(~F.col("held_out")).count()
    tokens += texts
    types += texts > 0
    class_n = np.bincount(classes, n, n_classes)
    for r in others.groupBy("class").agg(F.sum("n").alias("n")).collect():
        class_n[r["class"]] += r["n"]
    class_log = np.log10(np.maximum(class_n, 1))
    rest_below = math.log10(rare_tokens + DELTA * (rare_types + 1))
    base_below = math.log10(tokens + DELTA * (types + 1))
    end_base = math.log10(texts + DELTA) - base_below

    rest = coded.select("row", F.explode(F.arrays_zip("others", "places")).alias("x")).select(
        "row", F.col("x.others").alias("word"), F.col("x.places").alias("places"),
        F.size("x.places").cast("long").alias("k"))
    seen, has_class = F.coalesce("n", F.lit(0)), F.col("class").isNotNull()
    inside_class = F.log10("n") - F.element_at(F.array(*[F.lit(float(x)) for x in class_log]), F.col("class") + 1)
    sums = (rest.join(counts, "word", "left").join(others.drop("n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("k") * (F.log10(seen + DELTA) - base_below)).alias("base"),
        F.sum(F.col("k") * F.when(has_class, inside_class).otherwise(F.log10(seen + DELTA) - rest_below)).alias("inside"),
        F.sum(F.when(seen > 0, F.col("k")).otherwise(0)).alias("known"),
        F.collect_list(F.when(has_class, F.struct("places", "class"))).alias("found")))
    whole = coded.select("row", "doc_id", "held_out", "ids").join(sums, "row", "left").select(
        "doc_id", "held_out", "ids", "found", (F.coalesce("base", F.lit(0.0)) + end_base).alias("base"),
        F.coalesce("inside", F.lit(0.0)).alias("inside"), (F.coalesce("known", F.lit(0)) + int(texts > 0)).alias("known"))
    model = share(spark, (np.concatenate([classes, [n_classes, n_classes + 1]]).astype(np.uint16),
                          np.concatenate([np.log10(np.maximum(n, 1)) - class_log[classes], [0, 0]]),
                          np.concatenate([np.log10(n + DELTA) - base_below, [0, 0]])))
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "classes": pa.binary(), "n_tokens": pa.int64(),
             "n_known": pa.int64(), "base_score": pa.float64(), "inside": pa.float64()}

    def fill(batches: Batches) -> Batches:
        of, inside, base = model()
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                seq, ends = sequence(part.column("ids").to_pylist(), size)
                cls, first = of[seq], ends[:-1] + 1
                chosen, entry, at = spots(part.column("found"), first)
                cls[at] = chosen.to_numpy()[entry]
                # a document's sums reach to its own end, which adds nothing
                add = lambda name, x: part.column(name).to_numpy() + np.add.reduceat(x, first)
                data = [part.column("doc_id"), part.column("held_out"),
                        [cls[i:j].tobytes() for i, j in zip(first.tolist(), ends[1:].tolist())],
                        np.diff(ends), add("known", (seq < size).astype(np.int64)), add("base", base[seq]),
                        add("inside", inside[seq])]
                yield pa.RecordBatch.from_arrays([d if isinstance(d, pa.Array) else pa.array(d, k)
                                                  for d, k in zip(data, kinds.values())], list(kinds))

    typed = staged(whole.mapInArrow(
        fill, "doc_id bigint, held_out boolean, classes binary, n_tokens bigint, n_known bigint, base_score double, "
              "inside double"), "word-classes")
    follow = follow_counts(typed, n_classes).astype(np.float64)
    share_of = (follow.sum(axis=0) + 1) / (follow.sum() + n_classes + 2)
    transition = np.log10((follow + ALPHA * share_of) / (follow.sum(axis=1, keepdims=True) + ALPHA))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            blobs = batch.column("classes").to_pylist()
            steps = []
            for a in range(0, len(blobs), 1024):
                cls, ends = sequence(blobs[a:a + 1024], n_classes, np.uint16)
                # a document's steps: from the end before it to its own end
                steps.append(np.add.reduceat(transition[cls[:-1], cls[1:]], ends[:-1]))
            total = batch.column("inside").to_numpy() + (np.concatenate(steps) if steps else np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(total)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return typed.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
                                 "score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score")


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold(F.col("doc_id"), 10) == 0)
