"""Operator 12: word n-gram Jaccard self-join by universe partition and the pigeonhole.

A document's set is its distinct shingles of `SHINGLE` words (A-Z lowered, runs of
anything but ASCII white space), each named by its XXH64. Documents with equal sets
are folded into one class first; only classes are joined.

Sizes fall into bands [lo, floor(lo / similarity)], so a set links only within its
own band, the one below and the one above. Two sets that link in a band differ in at
most H shingles. Hashing cuts the universe of shingles into segments; each set shows
its subset of every segment by one signature, or, in segments that are allotted two
differences, also the subset's one-deletion neighbours. A segment shown exactly is
worth 1, one with neighbours 2; their worth adds up to H + 1, so linked sets share a
signature. How many segments get neighbours is chosen per band by cost: signatures
shown against pairs that would meet by chance in empty or nearly empty segments
(sizes are estimated from at most `SAMPLE` documents; this moves cost, not results).

Sets that share a signature are candidates. Of groups of two the pair is taken; of
larger ones first each member's pair with one of them, and only groups that the
links found so far leave in several components are looked through in whole, in tiles
of at most 2 x `TILE` members, for pairs across components. Candidates whose
parity sketches differ in more bits than the sets may in shingles are dropped, which
is exact; the others are verified on the shingles of the whole texts.

Cases: a text with fewer words than a shingle is one shingle; null texts and texts
without words have an empty set and are their own component; repeated rows each get
their row; null doc_ids get their class's smallest id that is not null (an empty set
without id: null); an empty table gives no row; extra columns are not read.
"""
from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, low_hash, share, staged, table, texts_of
from corpusgate.llm.graph import components

SHINGLE = 3
PERCENT = 90   # least similarity
SAMPLE = 4000  # documents whose sizes are looked at to allot neighbours
TILE = 2000    # members of a group that are compared with as many others in one task
SKETCH = 512   # bits of a parity sketch
LARGEST = 1 << 40
HOME, FULL = 2, 1  # what a signature is: of the set's own band (else of the next), of a whole subset (else of a neighbour)
SETS = "doc_id bigint, n bigint, node bigint, sketch binary, shown array<struct<sig: bigint, kind: tinyint>>"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output's."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 values of a whole text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(size, len(words))
    starts = np.concatenate([[0], ends[:len(words) - k] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(starts, ends[k - 1:].tolist())], np.uint64))


def name_of(tokens: np.ndarray) -> int:
    """One number for a set, as a signed integer."""
    return int.from_bytes(xxhash.xxh64_digest(tokens.tobytes(), 12), "big", signed=True)


def sketch_of(tokens: np.ndarray) -> bytes:
    """Which of SKETCH hash cells hold an odd number of shingles."""
    cells = (mix(tokens + np.uint64(77)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=SKETCH) & 1).tobytes()


def apart(total: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """In how many shingles two sets of `total` shingles together may differ (below 0: never)."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache
def lows(percent: int) -> list[int]:
    """The smallest size of each band."""
    out = [1]
    while out[-1] < LARGEST:
        out.append(out[-1] * 100 // percent + 1)
    return out


def band_of(size: int, percent: int = PERCENT) -> int:
    return bisect_right(lows(percent), size) - 1


@lru_cache
def differences(band: int, percent: int) -> int:
    """H: the most shingles in which two sets of a band, or one of it and one of the band below, may differ."""
    top = 2 * (lows(percent)[band + 1] - 1)
    return max(apart(t, percent) for t in range(max(2, top - 60), top + 1))


@lru_cache
def allotment(band: int, percent: int, sets: int) -> tuple[int, int]:
    """(segments, those of them shown with neighbours) of a band that holds about `sets` sets, at least cost."""
    need, size = differences(band, percent) + 1, lows(percent)[band]

    def cost(two: int) -> float:
        one = max(0, need - 2 * two)
        m = one + two
        empty = (1 - 1 / m) ** size
        single = size / m * (1 - 1 / m) ** (size - 1)
        rows = m + two * size / m
        return sets * rows + sets * sets / 2 * (one * empty ** 2 + two * (empty ** 2 + 2 * empty * single))

    two = min(range((need + 1) // 2 + 1), key=cost)
    return max(0, need - 2 * two) + two, two


def signatures(tokens: np.ndarray, band: int, percent: int, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set shows in a band: signatures and whether each is of a whole subset."""
    m, two = allotment(band, percent, sets)
    salt = mix(np.array([band * 1_000_003 + m * 1009 + two], np.uint64))[0]
    segment = ((mix(tokens ^ salt) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], mix(tokens + salt)[order]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    edge = np.searchsorted(segment, np.arange(m + 1))
    mark = np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt
    total = upto[edge[1:]] - upto[edge[:-1]]
    few = int(edge[two])  # the first `two` segments are shown with neighbours
    place = segment[:few].astype(np.int64)
    near = total[place] - value[:few] + mark[place]
    return mix(np.concatenate([total + mark, near])), np.arange(m + few) < m


def shown(tokens: np.ndarray, percent: int, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a set and their kinds: in its own band, and in the next if its sets can be similar enough."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int8))]
    if percent >= 100:  # only equal sets link
        return out[0]
    size, band = len(tokens), band_of(len(tokens), percent)
    for b, home in ((band, HOME), (band + 1, 0)):
        # where no difference is allowed only equal sets link, and those are one class
        if differences(b, percent) > 0 and size * 100 >= percent * (lows(percent)[b] if not home else 0):
            sigs, whole = signatures(tokens, b, percent, sizes.get(b, 1))
            out.append((sigs, home + FULL * whole.astype(np.int8)))
    return np.concatenate([s for s, _ in out]), np.concatenate([k for _, k in out]).astype(np.int8)


def band_sizes(docs: DataFrame, percent: int) -> dict[int, int]:
    """About how many sets each band holds, from the words of a bounded sample of rows."""
    if percent >= 100:
        return {}
    rows = docs.count()
    part = min(1.0, SAMPLE / max(1, rows))
    words = F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))
    found = docs.filter(F.col("text").isNotNull() & low_hash(part, "doc_id")).limit(2 * SAMPLE).select(words.alias("n")).collect()
    out: dict[int, int] = {}
    for r in found:
        band = band_of(max(1, r.n - SHINGLE + 1), percent)
        out[band] = out.get(band, 0) + 1
    return {b: 1 << (int(n / part)).bit_length() for b, n in out.items()}


def sets_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per row of `docs`: doc_id, n, and of sets that are not empty node, sketch and signatures (SETS)."""
    shared = share(docs.sparkSession, band_sizes(docs, percent))
    pair = pa.struct([("sig", pa.int64()), ("kind", pa.int8())])

    def run(batches: Batches) -> Batches:
        sizes = shared()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = [shingles(t, size) for t in texts_of(part)]
                seen = [shown(r, percent, sizes) if len(r) else (np.zeros(0, np.uint64), np.zeros(0, np.int8)) for r in rows]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(s) for s, _ in seen])]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(np.concatenate([s for s, _ in seen]).view(np.int64)),
                                                pa.array(np.concatenate([k for _, k in seen]))], fields=list(pair)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()),
                     pa.array([name_of(r) if len(r) else None for r in rows], pa.int64()),
                     pa.array([sketch_of(r) if len(r) else None for r in rows], pa.binary()), lists],
                    ["doc_id", "n", "node", "sketch", "shown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def groups_of(rows: DataFrame) -> DataFrame:
    """Signatures that sets share in a way that can make a pair: one of the two in its own band, one whole."""
    home, full = F.col("kind").bitwiseAND(F.lit(HOME)) > 0, F.col("kind").bitwiseAND(F.lit(FULL)) > 0
    return rows.groupBy("sig").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(home).alias("homes"), F.count_if(full).alias("fulls"),
        F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.when(home & full, F.col("node"))).alias("pivot"),
        F.expr("bit_xor(xxhash64(node, kind))").alias("x"), F.expr("bit_xor(xxhash64(kind, node))").alias("y"),
    ).filter("size > 1 and homes > 0 and fulls > 0")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out that they link."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
                    for c in ("a_sketch", "b_sketch"))
            n, m = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
            far = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            near = np.maximum(far, np.abs(n - m)) <= apart(n + m, percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(
        run, "a bigint, b bigint")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link, by the shingles of one whole text of each class; staged."""
    pairs = staged(pairs, "candidates")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # the id that stands for a class may stand on several rows, or be null: the set's name decides
    ids = nodes.join(classes, "node").select(F.col("first").alias("id")).distinct()

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            rows = [shingles(t, size) for t in texts_of(batch)]
            rows = [r for r in rows if len(r)]
            yield pa.RecordBatch.from_pydict({"node": pa.array([name_of(r) for r in rows], pa.int64()),
                                              "tokens": pa.array([r.tobytes() for r in rows], pa.binary())})

    texts = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("id")), "left_semi").select("text")
    found = texts.mapInArrow(cut, "node bigint, tokens binary").join(nodes, "node", "left_semi")
    sets = staged(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "shingles")

    def check(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, t: sets.select(F.col("node").alias(c), F.col("tokens").alias(t))
    full = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return staged(full.mapInArrow(check, "a bigint, b bigint"), "links")


def across(members: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of members of one group (sig) in different components whose sketches do not rule a link out.

    Large groups are cut into blocks, and every two blocks meet in a tile. `nearest`: of each member only its
    closest pair per tile, to join components cheaply before all pairs left over are looked at."""
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    block = F.pmod(F.xxhash64("node", "sig"), F.col("blocks")).cast("int")
    rows = (members.withColumn("blocks", blocks).withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node",
                    "label", "kind", "n", "sketch"))

    def pairs_of(t: dict[str, np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a, b = [], []
        if (t["label"] == t["label"][0]).all():
            return a, b
        two = t["i"][0] != t["j"][0]
        for at in range(0, len(t["node"]), 128):
            x = slice(at, at + 128)
            far = np.bitwise_count(t["sketch"][x, None, :] ^ t["sketch"][None, :, :]).sum(axis=2, dtype=np.int64)
            far = np.maximum(far, np.abs(t["n"][x, None] - t["n"][None, :]))
            near = far <= apart(t["n"][x, None] + t["n"][None, :], percent)
            near &= t["label"][x, None] != t["label"][None, :]
            near &= (t["kind"][x, None] | t["kind"][None, :]) == HOME | FULL
            if two:
                near &= t["block"][x, None] != t["block"][None, :]
            if nearest:
                best = np.where(near, far, 1 << 60).argmin(axis=1)
                only = np.zeros_like(near)
                only[np.arange(len(best)), best] = True
                near &= only
            u, v = np.nonzero(near)
            a.append(t["node"][x][u])
            b.append(t["node"][v])
        return a, b

    def run(batches: Batches) -> Batches:
        waiting: list[pa.RecordBatch] = []

        def tiles(whole: pa.Table, all_of_it: bool):
            """Pairs of the complete tiles, and what is left of the last one."""
            key = np.stack([whole.column(c).to_numpy() for c in ("sig", "i", "j")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            done = len(cuts) - 1 if all_of_it else len(cuts) - 2
            cols = {c: whole.column(c).to_numpy() for c in ("i", "j", "block", "node", "label", "kind", "n")}
            cols["sketch"] = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            a, b = [], []
            for s, e in zip(cuts[:done].tolist(), cuts[1:done + 1].tolist()):
                x, y = pairs_of({c: v[s:e] for c, v in cols.items()})
                a, b = a + x, b + y
            a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
            return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)}), whole.slice(int(cuts[done]))

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) > 50_000:
                found, rest = tiles(pa.Table.from_batches(waiting), False)
                yield found
                waiting = rest.to_batches()
        if sum(map(len, waiting)):
            yield tiles(pa.Table.from_batches(waiting), True)[0]

    # i and j are in the key, so the tiles of one group spread over tasks
    return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    found = staged(sets_of(docs, size, percent), "sets")
    classes = staged(found.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
        F.first("shown").alias("shown")), "classes")
    rows = classes.select("node", F.explode("shown").alias("s")).select("node", "s.sig", "s.kind")
    groups = staged(groups_of(rows), "groups")
    # many signatures are shared by the same sets in the same way: one of them stands for all
    large = staged(groups.filter("size > 2").groupBy("size", "homes", "fulls", "low", "high", "x", "y")
                   .agg(F.min("sig").alias("sig"), F.first("pivot").alias("pivot")).select("sig", "size", "pivot"), "large")
    members = staged(rows.join(large, "sig"), "members")
    known = classes.select("node", "first", "n", "sketch")
    pairs = (groups.filter("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
             .unionByName(members.filter("pivot is not null").select(F.col("pivot").alias("a"), F.col("node").alias("b"))))
    links = verified(sketched(ordered(pairs), known, percent), known, docs, size, percent)
    roots = components(links)
    for nearest in (True, False):
        part = members.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root", "pivot")
        split = part.groupBy("sig").agg(F.min("label").alias("u"), F.max("label").alias("v")).filter("u <> v").select("sig")
        part = staged(part.join(split, "sig", "left_semi").join(known.select("node", "n", "sketch"), "node"), "across")
        more = verified(across(part, percent, nearest), known, docs, size, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    member = known.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(least, "root").select("node", "component_id")
    return found.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
