"""Operator 5: substring dedup by repeated token k-mers, partitioned by minimizers.

Every run of `k` consecutive words of a document is an edge (a token k-mer), named
by a 128-bit hash of its words. A word goes if an edge that covers it also
starts in a document with a smaller doc_id.

This is the k-mer part of a De Bruijn compaction with another rule for what is one
path: edges are put together where they follow each other in a document and in the
source of their first occurrence, instead of along nodes of in- and out-degree one.
Both give the same covered words; this one needs no join over all repeated nodes.

Only edges that can repeat are shuffled. An edge's anchor is the smallest hash
among its runs of `ANCHOR` words, so equal edges have equal anchors and
neighbouring edges mostly share one (a super-k-mer).

1. Each task ships its distinct anchors, one row number each; an anchor that two
   rows hold is a candidate and goes back to its rows. An anchor that repeats
   inside a task's chunk is known to be a candidate there and is shipped once.
2. Rows join their candidates. Edges under a candidate anchor are dealt by that
   anchor. Inside a chunk an edge's first document is found before anything is
   sent, and only that document's edges travel, so a passage that a third of all
   documents share costs one row per chunk and edge.
3. The reducer finds the first document and place of every edge (its source
   coordinates) and compacts edges that follow each other, in the document and in
   the source alike, into paths. Edges decided inside a chunk are compacted before
   they are sent and dealt by their document.
4. Paths of a document are put in order by a window on it; those that follow each
   other there and in their source are one path again, a long repeated span, which
   its source coordinates vouch for place by place (the words themselves are not
   compared once more). The words under the spans go.

Cases: null and empty texts, and texts of fewer than k words, keep all words;
rows equal in doc_id and text are one document and get equal rows; rows with
the same doc_id do not shorten each other; a null doc_id counts as larger than
any; an empty table gives no row. Texts are cut nowhere: a document of any
length is one row, as it is in the table.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, staged, table, texts_of, worker_cache

WINDOW = 13
ANCHOR = 5
CHUNK_WORDS = 1 << 19
CACHE = 300_000
SPREAD = 8  # buckets per shuffle partition, so that partitions even out
LAST = (1 << 63) - 1  # the id that stands for null: larger than any
_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


class WordHash(dict):
    """Word -> its 8 hash bytes; emptied when it has grown past `CACHE` words."""

    def __missing__(self, word: bytes) -> bytes:
        value = self[word] = xxhash.xxh64_digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def run_hash(x: np.ndarray, at: np.ndarray | None, n: int, by: np.uint64) -> np.ndarray:
    """Polynomial hash of the n word hashes from each place (`at`: those places only)."""
    h = np.zeros(max(0, len(x) - n + 1) if at is None else len(at), np.uint64)
    for j in range(n):
        h = h * by + (x[j:j + len(h)] if at is None else x[at + j])
    return mix(h)


def edges(hashes: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, places, documents, anchors) of all edges of some documents laid end to end."""
    lens = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    ends = np.cumsum(lens)
    at = np.arange(len(flat))
    doc = np.repeat(np.arange(len(lens)), lens)
    ok = at + k <= ends[doc] if len(flat) else np.zeros(0, bool)
    if not ok.any():
        return flat, at[:0], doc[:0], flat[:0]
    gram = min(ANCHOR, k)
    low = run_hash(flat, None, gram, _A)
    width, have = k - gram + 1, 1
    while have < width:  # minima over 1, 2, 4, ... and at last `width` neighbours
        step = min(have, width - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    at = at[ok]
    return flat, at, doc[ok], low[at]


def utf8(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts of a batch, a few at a time in memory."""
    for a in range(0, len(batch), 256):
        for text in texts_of(batch.slice(a, 256)):
            yield text.encode("utf-8", "surrogatepass")


def chunks(texts: Iterable[bytes]):
    """Documents in groups of about CHUNK_WORDS words: (indices, word hashes)."""
    words = worker_cache("debruijn_words", WordHash)
    rows, hashes, size = [], [], 0
    for i, text in enumerate(texts):
        h = words.of(text.split())
        rows.append(i)
        hashes.append(h)
        size += len(h)
        if size >= CHUNK_WORDS:
            yield rows, hashes
            rows, hashes, size = [], [], 0
    if rows:
        yield rows, hashes


def packed(docs: DataFrame) -> DataFrame:
    """(id, mark, z) once for each (doc_id, text): the id with nulls last, a hash of the text, the text in zstd."""
    def run(batches: Batches) -> Batches:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = [squeeze(t) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(z, pa.binary())],
                                             ["id", "mark", "z"])

    return keyed(docs).select("id", "mark", "text").mapInArrow(run, "id bigint, mark bigint, z binary")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(
        "mark", F.xxhash64("text"))


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    for a in range(0, len(batch), 256):
        for z in batch.column("z").slice(a, 256).to_pylist():
            yield expand(z) if z else b""


def lists(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Values sorted by `group` as one list per group, and the place where each group starts."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return first, pa.ListArray.from_arrays(pa.array(np.append(first, len(group)), pa.int32()), pa.array(values))


def slices(bucket: np.ndarray):
    """(bucket, start, stop) of a sorted bucket array."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    return [(int(bucket[a]), a, b) for a, b in zip(cut, np.append(cut[1:], len(bucket)))]


def raw(*columns: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def candidates(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(id, mark, anchors): for each document the low halves of its anchors that another row may hold."""
    shipped = pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("anchor", pa.binary()), ("doc", pa.binary()),
                         ("ids", pa.binary()), ("marks", pa.binary())])

    def ship(batches: Batches) -> Batches:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            for rows, hashes in chunks(utf8(batch)):
                _, _, doc, anchor = edges(hashes, k)
                if not len(anchor):
                    continue
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                doc, anchor = doc[new], anchor[new]
                order = np.lexsort((doc, anchor))
                doc, anchor = doc[order], anchor[order]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                doc, anchor = doc[new], anchor[new]
                start = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                alone = start & np.concatenate([start[1:], [True]])
                own_id, own_mark = ids[rows], marks[rows]
                out = []
                for sure, mask in ((False, start), (True, ~alone)):
                    d, a = doc[mask], anchor[mask]
                    b = (a >> np.uint64(33)).astype(np.int64) * buckets >> 31  # in order of the anchor
                    for bucket, x, y in slices(b):
                        used, place = np.unique(d[x:y], return_inverse=True)
                        blob = raw(a[x:y], place.astype(np.uint32), own_id[used], own_mark[used])
                        out.append(dict(zip(shipped.names, [bucket, sure, *blob])))
                yield pa.RecordBatch.from_pylist(out, shipped)

    def decide(batches: Batches) -> Batches:
        open_, sure_ = [], []
        for batch in batches:
            for row in batch.to_pylist():
                a, d = np.frombuffer(row["anchor"], np.uint64), np.frombuffer(row["doc"], np.uint32)
                entry = (a, np.frombuffer(row["ids"], np.int64)[d], np.frombuffer(row["marks"], np.int64)[d])
                (sure_ if row["sure"] else open_).append(entry)
        parts = [np.concatenate(c) for c in zip(*open_)] if open_ else None
        if parts is not None:
            anchor = parts[0]
            order = np.argsort(anchor, kind="stable")
            anchor = anchor[order]
            start = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            keep = order[~(start & np.concatenate([start[1:], [True]]))]
            sure_.append(tuple(c[keep] for c in parts))
        if sure_:
            anchor, ids, marks = (np.concatenate(c) for c in zip(*sure_))
            sure_.clear()
            block = (mix(ids.view(np.uint64) ^ mix(marks.view(np.uint64))) >> np.uint64(33)).astype(np.int64) * blocks >> 31
            order = np.lexsort((marks, ids, block))
            block, ids, marks = block[order], ids[order], marks[order]
            low = (anchor[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
            out = []
            for number, x, y in slices(block):
                first = x + np.flatnonzero(new[x:y])
                n = np.diff(np.append(first, y)).astype(np.uint32)
                out.append(dict(zip(packed_.names, [number, *raw(ids[first], marks[first], n, low[x:y])])))
            yield pa.RecordBatch.from_pylist(out, packed_)

    def regroup(batches: Batches) -> Batches:
        parts = []
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], np.uint32)
                parts.append((np.repeat(np.frombuffer(row["ids"], np.int64), n),
                              np.repeat(np.frombuffer(row["marks"], np.int64), n), np.frombuffer(row["anchors"], np.int32)))
        if parts:
            ids, marks, low = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            order = np.lexsort((marks, ids))
            ids, marks = ids[order], marks[order]
            first, values = lists(low[order], np.cumsum(
                np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(marks[first]), values],
                                             ["id", "mark", "anchors"])

    # what a task finds travels back in one row per block of documents, not one per document
    packed_ = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary()), ("n", pa.binary()),
                         ("anchors", pa.binary())])
    blocks = buckets
    spread = "bucket int, sure boolean, anchor binary, doc binary, ids binary, marks binary"
    return (keyed(docs).select("id", "mark", "text").mapInArrow(ship, spread).repartition("bucket")
            .mapInArrow(decide, "block int, ids binary, marks binary, n binary, anchors binary").repartition("block")
            .mapInArrow(regroup, "id bigint, mark bigint, anchors array<int>"))


PATH = "id bigint, mark bigint, start int, n int, source_id bigint, source_start int"
_PATH = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
                   ("source_id", pa.int64()), ("source_start", pa.int32())])


def compact(ids, marks, places, source_ids, source_places) -> pa.RecordBatch:
    """Edges that follow each other in their document and in their source, as paths."""
    order = np.lexsort((places, marks, ids))
    c = [x[order] for x in (ids, marks, places, source_ids, source_places)]
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (c[0], c[1], c[3]):
        same &= x[1:] == x[:-1]
    same &= (c[2][1:] == c[2][:-1] + 1) & (c[4][1:] == c[4][:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(order)))
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip((c[0][first], c[1][first], c[2][first], n, c[3][first], c[4][first]), _PATH.types)],
        schema=_PATH)


def first_of(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every edge the smallest id that has it, and its first place there."""
    order = np.lexsort((places, ids, h2, h1))
    a, b = h1[order], h2[order]
    start = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    head = order[np.flatnonzero(start)[np.cumsum(start) - 1]]
    back = np.empty(len(order), np.int64)
    back[order] = head
    return ids[back], places[back]


def paths(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Paths of edges that start in an earlier document too, a document's paths cut at anchors."""
    shipped = pa.schema([("bucket", pa.int32()), ("path", pa.bool_()), ("h1", pa.binary()), ("h2", pa.binary()),
                         ("doc", pa.binary()), ("place", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()),
                         ("source_ids", pa.binary()), ("source_places", pa.binary())])

    def ship(batches: Batches) -> Batches:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            wanted = batch.column("anchors")
            for rows, hashes in chunks(unpacked(batch)):
                flat, at, doc, anchor = edges(hashes, k)
                if not len(at):
                    continue
                begin = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
                # one look-up per chunk: (document, low half of the anchor) as one number
                asked = [np.asarray(wanted[i].values) for i in rows]
                key = np.concatenate([a.view(np.uint32).astype(np.uint64) | np.uint64(j << 32) for j, a in enumerate(asked)])
                mine = (anchor & np.uint64(0xFFFFFFFF)) | (doc.astype(np.uint64) << np.uint64(32))
                change = np.concatenate([[True], mine[1:] != mine[:-1]])
                hit = np.isin(mine[change], key)[np.cumsum(change) - 1]
                at, doc, anchor = at[hit], doc[hit], anchor[hit]
                if not len(at):
                    continue
                h1, h2 = run_hash(flat, at, k, _A), run_hash(flat, at, k, _C)
                place = (at - begin[doc]).astype(np.int64)
                own_id, own_mark = ids[rows], marks[rows]
                first, where = first_of(h1, h2, own_id[doc], place)
                out = []
                gone = first < own_id[doc]  # decided here: an earlier document of this chunk has the edge
                if gone.any():
                    d = doc[gone]
                    path = compact(own_id[d], own_mark[d], place[gone], first[gone], where[gone])
                    c = {n: path.column(n).to_numpy() for n in path.schema.names}
                    b = (mix(c["id"].view(np.uint64) ^ mix(c["mark"].view(np.uint64))) >> np.uint64(33)).astype(np.int64) * buckets >> 31
                    order = np.argsort(b, kind="stable")
                    for bucket, x, y in slices(b[order]):
                        e = order[x:y]
                        out.append(dict(zip(shipped.names, [bucket, True, b"", b"", *raw(
                            c["n"][e], c["start"][e], c["id"][e], c["mark"][e], c["source_id"][e], c["source_start"][e])])))
                rest = np.flatnonzero(~gone)
                b = (anchor[rest] >> np.uint64(33)).astype(np.int64) * buckets >> 31
                order = np.argsort(b, kind="stable")  # within a bucket edges stay in the order of the text
                rest, b = rest[order], b[order]
                for bucket, x, y in slices(b):
                    e = rest[x:y]
                    used, local = np.unique(doc[e], return_inverse=True)
                    out.append(dict(zip(shipped.names, [
                        bucket, False, *raw(h1[e], h2[e], local.astype(np.uint32), place[e].astype(np.uint32),
                                            own_id[used], own_mark[used]), b"", b""])))
                yield pa.RecordBatch.from_pylist(out, shipped)

    def decide(batches: Batches) -> Batches:
        entries = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"]:  # compacted where it was decided: `doc` holds the lengths
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], t), f) for (c, t), f in zip(
                        (("ids", np.int64), ("marks", np.int64), ("place", np.int32), ("doc", np.int32),
                         ("source_ids", np.int64), ("source_places", np.int32)), _PATH.types)], schema=_PATH)
                else:
                    d, place = np.frombuffer(row["doc"], np.uint32), np.frombuffer(row["place"], np.uint32).astype(np.int64)
                    ids, marks = np.frombuffer(row["ids"], np.int64)[d], np.frombuffer(row["marks"], np.int64)[d]
                    entries.append((np.frombuffer(row["h1"], np.uint64), np.frombuffer(row["h2"], np.uint64), ids, marks, place))
        if entries:
            h1, h2, ids, marks, place = (np.concatenate(c) for c in zip(*entries))
            entries.clear()
            first, where = first_of(h1, h2, ids, place)
            gone = first < ids
            yield compact(ids[gone], marks[gone], place[gone], first[gone], where[gone])

    spread = ("bucket int, path boolean, h1 binary, h2 binary, doc binary, place binary, ids binary, marks binary, "
              "source_ids binary, source_places binary")
    joined = packed(docs).join(staged(candidates(docs, k, buckets), "anchors"), ["id", "mark"])
    return joined.mapInArrow(ship, spread).repartition("bucket").mapInArrow(decide, PATH)


def spans(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """Long repeated spans: id, mark, start and stop (words), source_id, source_start.

    `docs` has doc_id and text. Paths that continue each other in the document
    and in the source are joined; a path has n edges and covers n + k - 1 words.
    """
    buckets = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = staged(paths(docs, k, buckets).distinct(), "paths")
    order = Window.partitionBy("id", "mark").orderBy("start")
    follows = ((F.lag(F.col("start") + F.col("n")).over(order) == F.col("start"))
               & (F.lag("source_id").over(order) == F.col("source_id"))
               & (F.lag(F.col("source_start") + F.col("n")).over(order) == F.col("source_start")))
    return (found.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("new").over(order))
            .groupBy("id", "mark", "path")
            .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n") + (k - 1)).alias("stop"),
                 F.min_by("source_id", "start").alias("source_id"),
                 F.min_by("source_start", "start").alias("source_start"))
            .drop("path"))


def dedup(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    cut = staged(spans(docs, k).groupBy("id", "mark").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(unpacked(batch), batch.column("spans").to_pylist()):
                words = text.split()
                gone = 0
                if found:
                    depth = np.zeros(len(words) + 1, np.int32)
                    for span in found:
                        depth[span["start"]] += 1
                        depth[span["stop"]] -= 1
                    keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                    gone = len(words) - len(keep)
                    left = [words[i] for i in keep.tolist()]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(gone)
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    joined = packed(docs).join(cut, ["id", "mark"], "left")
    rows = joined.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept binary")
    return rows.select(F.nullif("id", F.lit(LAST)).alias("doc_id"), "n_words", "n_removed",
                       F.col("kept").cast("string").alias("kept"))


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
