"""Operator 13: how the tokens of two tokenizers lie over one another, by interval coalescing.

A is a byte-level BPE (tokenizers library), B a sentencepiece model. A sees one
space and the text, B the text, before which it puts a space itself. Special
strings in texts are plain text. Every token is a byte range.

Texts are cut before spaces and line ends (tokens.py says why that gives A's own ids).
A and B both end a token there, so no group and no link reaches over a cut: each distinct
piece of about a megabyte of texts is aligned once, and a text's groups and links are those
of its pieces, one after the other. For B cutting does because none of its pieces holds a
space behind another character or a line end beside one; that is checked on the
vocabulary, and texts with several spaces in a row or one in front are aligned whole.

All tokens of both sides are sorted by start (lexsort); with the running maximum
of the ends, a group breaks where a start reaches it, that is where A and B both
end a token. A and B both tile the text without gaps, so two tokens overlap in
exactly one stretch between neighbouring starts: the distinct starts are the links.

Counts of linked id pairs cover the corpus in two tiers. Each task adds up its
own, one shuffle adds up the tasks'. Of all pairs at most `TABLE`, the most
frequent, are broadcast with their counts; links of other pairs, which are rare
by that, go to their counts through a join on the pair.

Cases: a null or empty text, or one whose A or B bytes differ from space + text
(where B's normaliser changes it, or the text holds U+2581), has no tokens:
zeros, no groups; repeated rows and rows with one doc_id each get their own row;
an empty table gives no row; extra columns are not read.
"""
from __future__ import annotations

import hashlib
import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, share, staged, table, worker_cache
from corpusgate.llm.token_counts import TOKENIZER, tokenizer_path
from corpusgate.llm.tokens import ASIDE, LONG, Pieces, byte_of_letter, cuts, laid_out, safe, slices, words_of
from corpusgate.session import scratch_dir

MODEL = "piece_bpe_32k.model"
TABLE = 1 << 20  # pairs whose counts are broadcast: 17 bytes each
CACHE = 400_000  # pieces remembered by one worker
CHUNK = 256      # pieces encoded by one call
BYTES = 1 << 20  # of texts cut at once
BLOCK = 1 << 17  # A's tokens aligned together
SPACE = "▁"
DIGEST = ("rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
          "links binary")


class SideA:
    """Token ids of space + text, special strings as plain text."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)  # its cache is renewed together with B's
        self.pieces.lib.encode_special_tokens = True
        self.pieces.split = re.compile(r"(?!)")
        self.pieces.simple = True
        letter = byte_of_letter()
        lib = self.pieces.lib
        self.added = {i: t.content.encode() for i, t in lib.get_added_tokens_decoder().items()}
        vocab = {i: t for t, i in lib.get_vocab(with_added_tokens=True).items()}
        self.bytes = [self.added[i] if i in self.added else bytes(letter[c] for c in vocab[i]) if i in vocab else b""
                      for i in range(max(vocab) + 1)]
        self.kind = np.uint16 if self.pieces.code == "H" else np.uint32
        self.lossless = lib.normalizer is None

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self.pieces.whole(" " + text), self.kind).astype(np.int64)


class SideB:
    """Token ids of a text; None where their bytes differ from space + text."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.lib.is_byte(i) else n.replace(SPACE, " ").encode()
                      for i, n in enumerate(names)]
        # pieces may only begin with a space (or be nothing else), and no line end may stand beside another character
        self.cuts = all(not (SPACE in n[1:] and n.strip(SPACE)) and not ("\n" in n and len(n) > 1) for n in names)
        self.space = self.lib.piece_to_id(SPACE)
        self.cuts &= names[self.space] == SPACE and len(names) < 1 << 16
        self.starts = np.array([n.startswith(SPACE) for n in names])
        self.cache: dict[str, bytes | None] = {}  # ids as little-endian uint16; None: bytes differ

    def checked(self, ids: list[int], wanted: bytes) -> np.ndarray | None:
        return np.array(ids, np.int64) if b"".join([self.bytes[i] for i in ids]) == wanted else None

    def whole(self, text: str) -> np.ndarray | None:
        return self.checked(self.lib.encode(text), b" " + text.encode("utf-8", "surrogatepass"))

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces, many to a call: a space between pieces is where the next one's first id begins."""
        for a in range(0, len(pieces), CHUNK):
            part = pieces[a:a + CHUNK]
            if not self.learn_joined(part):
                for piece in part:
                    if not self.learn_joined([piece]):
                        self.cache[piece] = None

    def learn_joined(self, part: list[str]) -> bool:
        text = " ".join(part)
        ids = np.array(self.lib.encode(text), "<u2")
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) != len(part) or b"".join(map(self.bytes.__getitem__, ids.tolist())) != b" " + text.encode("utf-8", "surrogatepass"):
            return False
        raw, ends = ids.tobytes(), [*(cuts * 2).tolist(), 2 * len(ids)]
        # before a line end the space that joins is a token of its own and no part of the piece
        self.cache.update((p, raw[x + 2 * (p[:1] == "\n"):y]) for p, x, y in zip(part, ends, ends[1:]))
        return True


class Aligner:
    """Both tokenizers with the byte lengths and the decimal texts of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.wide = len(self.size_b)
        self.key = np.uint32 if len(self.size_a) * self.wide < 1 << 32 else np.int64  # of a linked pair of ids
        self.old: tuple[dict, dict] = {}, {}  # the older generation of both caches
        # what is printed after an id: a comma, or the mark that ends its side
        self.names = ([f"{i}{m}" for i in range(len(self.size_a)) for m in ",|"]
                      + [f"{i}{m}" for i in range(self.wide) for m in ",;"])

    def learned(self, pieces: list[str]) -> list[tuple[bytes, bytes | None]]:
        """A's and B's ids of distinct pieces. Both sides remember the same pieces."""
        if len(self.a.pieces.cache) > CACHE // 2:
            self.old, self.a.pieces.cache, self.b.cache = (self.a.pieces.cache, self.b.cache), {}, {}
        one, two = self.a.pieces.cache, self.b.cache
        new = [p for p, v in zip(pieces, map(one.get, pieces)) if v is None]
        again = [p for p, v in zip(new, map(self.old[0].get, new)) if v is not None]
        for young, old in zip((one, two), self.old):
            young.update(zip(again, map(old.__getitem__, again)))
        need = list(set(new).difference(again))
        self.a.pieces.learn(need)
        self.b.learn([p for p in need if p])
        two[""] = np.array([self.b.space], "<u2").tobytes()
        found = list(zip(map(one.__getitem__, pieces), map(two.__getitem__, pieces)))
        for p in need:
            if len(p) > LONG:
                del one[p], two[p]
        return found

    def runs(self, texts: pa.Array) -> tuple[list[tuple[bytes, bytes | None]], np.ndarray, np.ndarray]:
        """Units (distinct pieces, and texts that must stay whole) with A's and B's ids, the units of all texts one
        after the other, and where each text's begin (and the end)."""
        odd = np.zeros(len(texts), bool)
        whole = self.b.cuts and self.a.lossless
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, r"\A[ \n]|" + ASIDE)).to_pylist() if whole else range(len(texts)):
            t = texts[i].as_py()
            odd[i] = not (whole and t[:1] != " " and "  " not in t and safe(" " + t))
        cut = cuts(texts.filter(pa.array(~odd)))
        units = self.learned(words_of(cut.pieces))
        differ = np.array([b is None for _, b in units], bool)
        lengths = np.diff(cut.starts)
        places = cut.places
        if differ.any():  # B may take such a piece otherwise beside others: these texts stay whole too
            more = np.logical_or.reduceat(differ[places], cut.starts[:-1])
            odd[~odd] = more
            places, lengths = places[np.repeat(~more, lengths)], lengths[~more]
        sizes = np.ones(len(texts), np.int64)
        sizes[~odd] = lengths
        at = np.zeros(sizes.sum(), np.int64)
        at[np.repeat(~odd, sizes)] = places
        at[np.repeat(odd, sizes)] = np.arange(len(units), len(units) + odd.sum())
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            a, b = self.a.whole(text), self.b.whole(text)
            if not self.a.lossless and b"".join([self.a.bytes[x] for x in a.tolist()]) != b" " + text.encode("utf-8", "surrogatepass"):
                b = None
            units.append((a.astype(self.a.kind).tobytes(), None if b is None else b.astype("<u2").tobytes()))
        return units, at, np.concatenate([[0], np.cumsum(sizes)])

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A's and B's ids of each text; None where there are none."""
        units, at, starts = self.runs(pa.array(texts, pa.large_string()))
        good, out = self.units(units).good, []
        for text, x, y in zip(texts, starts.tolist(), starts[1:].tolist()):
            own = at[x:y].tolist()
            a, b = (np.frombuffer(b"".join([units[i][side] or b"" for i in own]), kind).astype(np.int64)
                    for side, kind in ((0, self.a.kind), (1, "<u2")))
            out.append((a, b) if text and good[own].all() else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray, unit_of_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Over units (pieces or whole texts) one after the other: link keys, the unit of each link, the unit of each
        group, and the places in `names` of all tokens, group by group and A before B."""
        ends = np.concatenate([np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])])
        starts = ends - np.concatenate([self.size_a[a], self.size_b[b]])
        order = np.lexsort((starts,))  # stable: of equal starts A's comes first
        start, side_b = starts[order], order >= len(a)
        fresh = np.concatenate([[True], start[1:] >= np.maximum.accumulate(ends[order])[:-1]])
        group = np.cumsum(fresh) - 1
        last = np.concatenate([start[1:] != start[:-1], [True]])
        at_a, at_b = np.cumsum(~side_b)[last] - 1, np.cumsum(side_b)[last] - 1
        keys = a[at_a] * self.wide + b[at_b]
        first = np.flatnonzero(fresh)  # A's token comes first in a group: both begin there
        printed = np.argsort(group * 2 + side_b, kind="stable")
        place, token = (group * 2 + side_b)[printed], order[printed]
        closes = np.concatenate([place[1:] != place[:-1], [True]])
        ids = np.concatenate([a * 2, b * 2 + 2 * len(self.size_a)])[token] + closes
        return keys, unit_of_a[at_a], unit_of_a[order[first]], ids

    def units(self, pairs: list[tuple[bytes, bytes | None]]) -> "Units":
        """Each pair (A's and B's ids, as the sides keep them) aligned; not good where there is none for B or the bytes differ."""
        a, b = np.frombuffer(b"".join([p[0] for p in pairs]), self.a.kind), np.frombuffer(b"".join([p[1] or b"" for p in pairs]), "<u2")
        a, b = a.astype(np.int64), b.astype(np.int64)
        n_a = np.array([len(p[0]) for p in pairs], np.int64) // np.dtype(self.a.kind).itemsize
        n_b = np.array([len(p[1] or b"") for p in pairs], np.int64) // 2
        over_a, over_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        size_a, size_b = (np.diff(np.concatenate([[0], np.cumsum(size[ids])])[over]) for size, ids, over in
                          ((self.size_a, a, over_a), (self.size_b, b, over_b)))
        good = (size_a == size_b) & (size_b > 0)
        if not good.all():
            a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
            over_a, over_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        n_groups, n_links = np.zeros((2, len(pairs)), np.int64)
        keys, texts = [np.zeros(0, self.key)], []
        blocks = [0, *(np.flatnonzero(np.diff(over_a[:-1] // BLOCK)) + 1).tolist(), len(pairs)]
        for x, y in zip(blocks, blocks[1:]):
            part = slice(over_a[x], over_a[y])
            if part.stop > part.start:
                found, of_link, of_group, ids = self.align(
                    a[part], b[over_b[x]:over_b[y]], np.repeat(np.arange(y - x), n_a[x:y]))
                keys.append(found.astype(self.key))
                n_links[x:y], n_groups[x:y] = (np.bincount(of, minlength=y - x) for of in (of_link, of_group))
                words = list(map(self.names.__getitem__, ids.tolist()))
                ends = (over_a[x:y + 1] + over_b[x:y + 1] - over_a[x] - over_b[x]).tolist()
                texts += ["".join(words[u:v]) for u, v in zip(ends, ends[1:])]
            else:
                texts += [""] * (y - x)
        return Units(good, np.stack([n_a, n_b, n_groups, n_links]), np.concatenate(keys), texts)

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[bytes]]:
        """For each text n_a, n_b, n_groups, n_links; the digest of its groups; the keys of its links."""
        units, at, starts = self.runs(texts)
        found = self.units(units)
        kept = np.logical_and.reduceat(found.good[at], starts[:-1]) & (pc.binary_length(texts).to_numpy() > 0)
        counts = np.add.reduceat(found.counts[:, at], starts[:-1], axis=1) * kept
        raw, ends = laid_out(found.keys, found.counts[3], at, starts)
        digests, links, text_of, kept = [], [], found.texts.__getitem__, kept.tolist()
        for k, x, y, u, v in zip(kept, starts.tolist(), starts[1:].tolist(), ends, ends[1:]):
            groups = "".join(map(text_of, at[x:y].tolist()))[:-1] if k else ""
            digests.append(hashlib.sha256(groups.encode()).hexdigest() if k else "")
            links.append(raw[u:v] if k else b"")
        return counts, digests, links


class Units(NamedTuple):
    """Aligned pieces and whole texts."""

    good: np.ndarray    # whether A's and B's bytes are the same
    counts: np.ndarray  # n_a, n_b, n_groups, n_links of each
    keys: np.ndarray    # of all links, unit by unit
    texts: list[str]    # the groups of each, a mark behind the last


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of `docs` (DIGEST): counts, the digest of the groups and the keys of all links; staged."""
    key = f"aligner_{uuid.uuid4().hex}"
    kind = pa.schema([*[(c, pa.int64()) for c in ("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links")],
                      ("groups_sha256", pa.string()), ("links", pa.binary())])

    def run(batches: Batches) -> Batches:
        tool = worker_cache(key, lambda: Aligner(path_a, path_b))
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text").cast(pa.large_string()).fill_null(""), BYTES):
                part, at = batch.slice(at, len(texts)), at + len(texts)
                counts, digests, links = tool.digests(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("doc_id"), *map(pa.array, counts),
                     pa.array(digests, pa.string()), pa.array(links, pa.binary())], schema=kind)
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = f"{scratch_dir(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    # small row groups: their buffers stand beside two tokenizers' caches on an executor
    rows.mapInArrow(run, DIGEST).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(DIGEST).parquet(path)


def pair_counts(found: DataFrame, wide: int, key: type) -> DataFrame:
    """(key, n, best): how many links of the corpus hold each pair of ids, and whether no pair of its B id has more."""
    def run(batches: Batches) -> Batches:
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def added():
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, place, np.concatenate([counts, n]))
            return both, total

        size = 0
        for batch in batches:
            for raw in batch.column("links").to_pylist():
                waiting.append(np.frombuffer(raw, key).astype(np.int64))
                size += len(waiting[-1])
                if size > 1 << 21:
                    keys, counts = added()
                    waiting, size = [], 0
        if waiting:
            keys, counts = added()
        for a in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_pydict({"key": keys[a:a + (1 << 16)], "n": counts[a:a + (1 << 16)]})

    each = staged(found.select("links").mapInArrow(run, "key bigint, n bigint").groupBy("key")
                  .agg(F.sum("n").alias("n")), "pair-counts")
    # bounded: one row per id of B
    top = each.groupBy((F.col("key") % wide).alias("b")).agg(F.max("n").alias("top"))
    return staged(each.join(F.broadcast(top), F.col("key") % wide == F.col("b")).select("key", "n", (F.col("n") == F.col("top")).alias("best")),
                  "pairs")


def frequent(pairs: DataFrame, most: int) -> tuple[int, DataFrame]:
    """A count that at most `most` pairs reach, as a power of two, and those pairs."""
    sizes = dict(pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect())  # at most 63 rows
    bits, total = 64, 0
    while bits > 1 and total + sizes.get(bits - 1, 0) <= most:
        bits -= 1
        total += sizes.get(bits, 0)
    least = 1 << (bits - 1) if bits < 64 else (1 << 63) - 1
    return least, pairs.filter(F.col("n") >= least)


def scored(found: DataFrame, pairs: DataFrame, key: type, most: int = TABLE) -> DataFrame:
    """`found` with n_best and count_sum in place of the links."""
    least, top = frequent(pairs, most)
    rows = top.orderBy("key").toArrow()  # bounded: `most` rows of 17 bytes
    shared = share(found.sparkSession, tuple(rows.column(c).to_numpy() for c in ("key", "n", "best")))

    def run(batches: Batches) -> Batches:
        keys, counts, best = shared()
        for batch in batches:
            n_best, total, rest = [], [], []
            for raw in batch.column("links").to_pylist():
                links = np.frombuffer(raw, key).astype(np.int64)
                at = np.searchsorted(keys, links)
                hit = np.zeros(len(links), bool) if not len(keys) else keys[np.minimum(at, len(keys) - 1)] == links
                n_best.append(int(best[at[hit]].sum()))
                total.append(int(counts[at[hit]].sum()))
                rest.append(links[~hit].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()),
                 pa.array(rest, pa.list_(pa.int64()))], ["rid", "n_best", "count_sum", "rest"])

    first = found.select("rid", "links").mapInArrow(run, "rid bigint, n_best bigint, count_sum bigint, rest array<bigint>")
    keep = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if pairs.filter(F.col("n") < least).isEmpty():  # every pair is in the table
        return found.select(*keep).join(first.drop("rest"), "rid").drop("rid")
    first = staged(first, "scored")
    more = (first.select("rid", F.explode("rest").alias("key")).join(pairs, "key")
            .groupBy("rid").agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more_sum")))
    return (found.select(*keep).join(first.drop("rest"), "rid").join(more, "rid", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
            .drop("rid", "more_best", "more_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, most: int = TABLE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = aligned(docs, path_a, path_b)
    tool = Aligner(path_a, path_b)
    pairs = pair_counts(found, tool.wide, tool.key)
    return scored(found, pairs, tool.key, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                             "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_path(MODEL))
