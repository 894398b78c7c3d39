"""Operator 11: the prefix trie of conversations, measured along its Euler tour.

A node is a distinct sequence of first d turns; the smallest conversation that
starts with it and the depth d name it exactly, since a conversation has one
prefix of each length. Prefixes are recognised by a polynomial fingerprint of
4 x 31 bits over the MD5 digests of their turns, so no text is shuffled, and a
piece of a conversation can be hashed without knowing what comes before it.

Everything that needs an order is one pass over a range-partitioned, sorted
table (`passed`): a task treats the run that began in an earlier partition as
if it began here, and what it lacks is carried in afterwards from one summary
row per partition. So neither a hot conversation, nor a turn that a third of all
conversations share, nor a node with millions of children meets in one task.

The tour has an arc into and an arc out of each node. Children follow each other
by conv_id, so most arcs of a range of conv_ids follow each other inside one
task. List ranking (`suffix_sums`): every task joins the arcs that follow each
other in its range into runs; the run heads form a shorter list that is ranked
the same way, then by pairing at random where ranges no longer shorten it, until
few enough are left for one task. Subtree leaves and savings are the differences
of the sums at a node's two arcs.

Cases: rows with a null conv_id belong to no conversation and are left out; null
role or text is the empty text; turns are ordered by turn (null first), then by
the MD5 of (role, text), and repeated rows are turns of their own; a conversation
may be turnless and is then a member of the root only; an empty table gives no
node; extra columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, staged, table

PRIME = (1 << 31) - 1
BASES = (48271, 69621, 16807, 39373)  # one per lane of a fingerprint
FEW = 10_000                          # arcs that one task ranks alone
PART_ROWS = 200_000                   # rows of a partition that a task holds as arrays
CHUNK = 1 << 20                       # bytes of a list of ids handed over at once
LANES = [f"f{i}" for i in range(4)]


def parts(df: DataFrame, n: int) -> int:
    """Partitions for n rows: all cores at work, but no task with more than about PART_ROWS."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // PART_ROWS), min(shuffle, -(-n // FEW)))


def passed(df: DataFrame, n: int, keys: list, run: Callable, ddl: str, name: str) -> DataFrame:
    """`run(table) -> record batch` over each partition of `df` (about n rows) ranged and sorted by `keys`; staged.

    `df` is a few narrow steps or a join away from a staged table and gives the same rows whenever it is
    read, so drawing the range bounds reads it once more instead of writing it."""
    def each(batches: Batches) -> Batches:
        whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if len(b)]) else None
        if whole is not None:
            yield run(whole)

    pieces = parts(df, n)
    cut = (df.repartitionByRange(pieces, *keys) if pieces > 1 else df.repartition(1)).sortWithinPartitions(*keys)
    return staged(cut.withColumn("part", F.spark_partition_id()).mapInArrow(each, ddl), name)


def by_part(df: DataFrame, *aggs: Column) -> list:
    """One summary row per partition, in order: bounded by the number of partitions."""
    return df.groupBy("part").agg(*aggs).orderBy("part").collect()


def with_parts(df: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    """`df` and what each partition is told; `rows` has one row per partition, so it is broadcast."""
    told = df.sparkSession.createDataFrame(rows, f"part int, {ddl}")
    return df.join(F.broadcast(told), "part", "left").drop("part")


def numbers(whole: pa.Table, name: str, null: int = 0) -> np.ndarray:
    """An integer column as int64, null replaced."""
    return whole.column(name).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def run_starts(*cols: np.ndarray) -> np.ndarray:
    """For each row of sorted columns, the place of the first row that equals it."""
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def turns(conversations: DataFrame, n: int) -> DataFrame:
    """(conv, i, digest, chars): the own turns of every conversation, numbered from 1."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(part("role")).cast("string"), F.lit(":"), part("role"), part("text"))
                      .cast("binary"))).alias("digest"),
        F.length(part("text")).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))

    def count(whole: pa.Table) -> pa.RecordBatch:
        conv = numbers(whole, "conv")
        at = np.arange(len(conv)) - run_starts(conv) + 1
        return pa.RecordBatch.from_pydict({"conv": conv, "at": at, "digest": whole.column("digest").combine_chunks(),
                                           "chars": whole.column("chars").combine_chunks(),
                                           "part": whole.column("part").combine_chunks()})

    # the row number only spreads equal turns over the ranges
    found = passed(rows, n, ["conv", F.col("turn").asc_nulls_first(), "digest", "row"], count,
                   "conv bigint, at bigint, digest binary, chars bigint, part int", "turns")
    carried, last, before = [], None, 0
    for p in by_part(found, F.min("conv").alias("first"), F.max(F.struct("conv", "at")).alias("end")):
        carry = before if last == p.first else 0
        carried.append((p.part, p.first, carry))
        before = p.end.at + (carry if p.end.conv == p.first else 0)
        last = p.end.conv
    return with_parts(found, carried, "first bigint, carry bigint").select(
        "conv", (F.col("at") + F.when(F.col("conv") == F.col("first"), F.col("carry")).otherwise(0)).alias("i"),
        "digest", "chars")


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt(conversations: DataFrame, n: int) -> DataFrame:
    """(conv, kind, i, digest, chars): kind 0 stands for the conversation itself (the root), 1 for the
    first turns taken over from conversation conv - conv % 100, 2 for its own turns after as many."""
    own = turns(conversations, n)
    convs = own.groupBy("conv").agg(F.lit(0).alias("kind"))
    root = convs.select("conv", "kind", F.lit(0).cast("long").alias("i"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(0).cast("long").alias("chars"))
    # at most 5 turns of one conversation in a hundred, for at most 199 conversations each
    head = (own.filter((F.col("conv") % 100 == 0) & (F.col("i") <= 5))
            .groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "digest", "chars"))).alias("head"))
            .withColumnRenamed("conv", "base"))
    taken = (convs.select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), shared_turns(F.col("conv")).alias("h"))
             .filter("h > 0").join(head, "base")
             .select("conv", F.lit(1).alias("kind"), F.explode(F.slice("head", 1, F.col("h").cast("int"))).alias("t"))
             .select("conv", "kind", "t.i", "t.digest", "t.chars"))
    kept = own.filter(F.col("i") > shared_turns(F.col("conv"))).select("conv", F.lit(2).alias("kind"), "i", "digest", "chars")
    return root.unionByName(taken).unionByName(kept)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo PRIME."""
    out = np.ones(n + 1, np.int64)
    done, step = 1, base
    while done <= n:  # doubling: the next `done` powers are the known ones times base^done
        more = min(done, n + 1 - done)
        out[done:done + more] = out[:more] * step % PRIME
        done, step = done + more, step * step % PRIME
    return out


def prefixes(rows: DataFrame, n: int) -> DataFrame:
    """(conv, depth, f0..f3, g0..g3, chars, ends): the fingerprint f of every prefix of `rows` (`rebuilt`),
    that of its parent g, and whether the conversation ends there."""
    def run(whole: pa.Table) -> pa.RecordBatch:
        conv, chars = numbers(whole, "conv"), numbers(whole, "chars")
        start = run_starts(conv)
        depth = np.arange(len(conv)) - start
        digest = whole.column("digest").combine_chunks().fill_null(bytes(16))
        words = np.frombuffer(b"".join(digest.to_pylist()), ">u4").reshape(-1, 4)
        turn = numbers(whole, "kind") > 0
        out = {"conv": conv, "depth": depth}
        for lane, base in enumerate(BASES):
            each = (words[:, lane].astype(np.int64) % (PRIME - 1) + 1) * powers(base, int(depth.max()))[depth] % PRIME
            total = np.cumsum(np.where(turn, each, 0))
            upto = (total - np.concatenate([[0], total])[start]) % PRIME
            out[f"f{lane}"] = upto
            out[f"g{lane}"] = np.where(depth > 0, np.concatenate([[0], upto[:-1]]), 0)
        out |= {"chars": chars, "ends": np.concatenate([conv[1:] != conv[:-1], [True]]),
                "part": whole.column("part").combine_chunks()}
        return pa.RecordBatch.from_pydict(out)

    lanes = ", ".join(f"{a}{i} bigint" for i in range(4) for a in "fg")
    found = passed(rows, n, ["conv", "kind", "i"], run,
                   f"conv bigint, depth bigint, {lanes}, chars bigint, ends boolean, part int", "prefixes")
    told, last, depth, prints = [], None, 0, [0] * 4
    seen = by_part(found, F.min("conv").alias("first"), F.max(F.struct("conv", "depth", *LANES)).alias("end"))
    for k, p in enumerate(seen):
        if last != p.first:
            depth, prints = 0, [0] * 4
        goes_on = k + 1 < len(seen) and seen[k + 1].first == p.end.conv
        told.append((p.part, p.first, p.end.conv if goes_on else None, depth, *prints,
                     *[pow(b, depth, PRIME) for b in BASES]))
        if p.end.conv == p.first:  # still the run that came in
            prints = [(f + e * pow(b, depth, PRIME)) % PRIME for f, e, b in zip(prints, [p.end[x] for x in LANES], BASES)]
            depth += p.end.depth + 1
        else:
            prints, depth = [p.end[x] for x in LANES], p.end.depth + 1
        last = p.end.conv
    df = with_parts(found, told, "first bigint, goes_on bigint, shift bigint, c0 bigint, c1 bigint, c2 bigint, c3 bigint, "
                                 "p0 bigint, p1 bigint, p2 bigint, p3 bigint")
    into = (F.col("conv") == F.col("first")) & (F.col("shift") > 0)
    fixed = lambda a, i: F.when(into, (F.col(f"c{i}") + F.col(f"{a}{i}") * F.col(f"p{i}")) % PRIME).otherwise(F.col(f"{a}{i}"))
    # goes_on: the run's last row here is no end; earlier conversations of the partition have other ids
    return df.select("conv", (F.col("depth") + F.when(into, F.col("shift")).otherwise(0)).alias("depth"),
                     *[fixed(a, i).alias(f"{a}{i}") for a in "fg" for i in range(4)], "chars",
                     (F.col("ends") & ~F.coalesce(F.col("conv") == F.col("goes_on"), F.lit(False))).alias("ends"))


def member_lists(members: DataFrame, n: int) -> DataFrame:
    """(depth, f0..f3, ends_sha256): the digest of the comma-joined ascending `conv`s of each key.

    A list that lies inside one sorted partition is digested there. Of lists that cross a border, pieces
    of at most CHUNK bytes are put in order and digested one after the other, never held together."""
    key = ["depth", *LANES]

    def run(whole: pa.Table) -> pa.RecordBatch:
        cols, conv = [numbers(whole, c) for c in key], numbers(whole, "conv")
        starts = np.unique(run_starts(*cols))
        stops = np.append(starts[1:], len(conv))
        at, digests, pieces = [], [], []
        for a, b in zip(starts.tolist(), stops.tolist()):
            if a > 0 and b < len(conv):
                at.append(a)
                digests.append(hashlib.sha256(",".join(map(str, conv[a:b].tolist())).encode()).hexdigest())
                pieces.append(None)
                continue
            for c in range(a, b, CHUNK // 20):  # a decimal id and its comma have 21 bytes at most
                at.append(c)
                digests.append(None)
                pieces.append(",".join(map(str, conv[c:min(b, c + CHUNK // 20)].tolist())).encode())
        return pa.RecordBatch.from_pydict({**{k: c[at] for k, c in zip(key, cols)}, "conv": conv[at],
                                           "ends_sha256": pa.array(digests, pa.string()),
                                           "piece": pa.array(pieces, pa.binary())})

    def join(batches: Batches) -> Batches:
        now, state = None, None
        for batch in batches:
            rows = {k: [] for k in [*key, "ends_sha256"]}
            for *k, piece in zip(*[batch.column(c).to_pylist() for c in [*key, "piece"]]):
                if k != now:
                    if now is not None:
                        for c, v in zip(rows, [*now, state.hexdigest()]):
                            rows[c].append(v)
                    now, state = k, hashlib.sha256(piece)
                else:
                    state.update(b"," + piece)
            yield pa.RecordBatch.from_pydict(rows, schema)
        if now is not None:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(schema.names, [*now, state.hexdigest()])}, schema)

    schema = pa.schema([*[(k, pa.int64()) for k in key], ("ends_sha256", pa.string())])
    lanes = ", ".join(f"{k} bigint" for k in key)
    found = passed(members, n, [*key, "conv"], run, f"{lanes}, conv bigint, ends_sha256 string, piece binary", "lists")
    cut = found.filter("piece is not null").repartition(*key).sortWithinPartitions(*key, "conv")
    return (found.filter("piece is null").select(*key, "ends_sha256")
            .unionByName(cut.select(*key, "piece").mapInArrow(join, f"{lanes}, ends_sha256 string")))


def linked(nodes: DataFrame, n: int) -> DataFrame:
    """`nodes` and, for each, parent_conv and next_conv (its next sibling by conv; null: none)."""
    up = ["depth", *[f"g{i}" for i in range(4)]]
    stats = (nodes.filter("depth > 0").groupBy(*up)
             .agg(F.count(F.lit(1)).alias("n_children"), F.min("conv").alias("first_child"))
             .select((F.col("depth") - 1).alias("depth"), *[F.col(f"g{i}").alias(f"f{i}") for i in range(4)],
                     "n_children", "first_child"))
    full = staged(nodes.join(stats, ["depth", *LANES], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    carry = ["conv", "depth", "n_convs", "chars", "n_children", "first_child", *LANES]
    # each node once as itself (kind 0) and once below its parent (kind 1), side by side in one order
    itself = full.select(*[F.col(f"f{i}").alias(f"k{i}") for i in range(4)], F.col("depth").alias("level"), F.lit(0).alias("kind"), *carry)
    below = full.filter("depth > 0").select(*[F.col(f"g{i}").alias(f"k{i}") for i in range(4)],
                                            (F.col("depth") - 1).alias("level"), F.lit(1).alias("kind"), *carry)
    key = ["k0", "k1", "k2", "k3", "level"]

    def run(whole: pa.Table) -> pa.RecordBatch:
        cols, kind, conv = [numbers(whole, c) for c in key], numbers(whole, "kind"), numbers(whole, "conv")
        start = run_starts(*cols)
        known = kind[start] == 0  # the parent leads its children; where it does not, it is in an earlier partition
        same = np.append(start[1:] == start[:-1], False)
        after = np.append(conv[1:], 0)
        out = {c: whole.column(c).combine_chunks() for c in [*key, "kind", *carry, "part"]}
        out["parent_conv"] = pa.array(conv[start], mask=~known | (kind == 0))
        out["next_conv"] = pa.array(after, mask=~same | (kind == 0))
        out["edge"] = np.arange(len(kind)) == len(kind) - 1
        out["lead"] = np.arange(len(kind)) == 0
        return pa.RecordBatch.from_pydict(out)

    types = (", ".join(f"{c} bigint" for c in key) + ", kind int, " + ", ".join(f"{c} bigint" for c in carry)
             + ", part int, parent_conv bigint, next_conv bigint, edge boolean, lead boolean")
    found = passed(itself.unionByName(below), 2 * n, [*key, "kind", "conv"], run, types, "links")
    # of each partition its first and last row: bounded by the number of partitions
    ends: dict[int, dict] = {}
    for r in found.filter("edge or lead").select("part", "edge", "lead", "kind", "conv", "parent_conv", *key).collect():
        for side in ("edge", "lead"):
            if r[side]:
                ends.setdefault(r.part, {})[side] = r
    told, parent, before = [], None, None
    order = sorted(ends)
    for k, part in enumerate(order):
        lead, edge = ends[part]["lead"], ends[part]["edge"]
        same = lambda a, b: a is not None and all(a[k] == b[k] for k in key)
        carried = parent if lead.kind == 1 and same(before, lead) else None
        follows = ends[order[k + 1]]["lead"] if k + 1 < len(order) else None
        told.append((part, carried, follows.conv if follows is not None and follows.kind == 1 and same(edge, follows) else None))
        parent = edge.conv if edge.kind == 0 else edge.parent_conv if edge.parent_conv is not None else carried
        before = edge
    df = with_parts(found.filter("kind = 1 or depth = 0"), told, "carried bigint, follows bigint")
    child = F.col("kind") == 1
    return df.select(*carry, F.when(child, F.coalesce("parent_conv", "carried")).alias("parent_conv"),
                     F.when(child, F.when(F.col("edge"), F.col("follows")).otherwise(F.col("next_conv"))).alias("next_conv"))


def arcs(nodes: DataFrame) -> DataFrame:
    """(conv, pos, s_conv, s_pos, leaves, saved): the arcs into (pos 2 d) and out of (2 d + 1) each node and their successors."""
    down = F.col("depth") * 2
    null = F.lit(None).cast("long")
    into = F.struct(down.alias("pos"),
                    F.when(F.col("n_children") > 0, F.col("first_child")).otherwise(F.col("conv")).alias("s_conv"),
                    F.when(F.col("n_children") > 0, down + 2).otherwise(down + 1).alias("s_pos"),
                    (F.col("n_children") == 0).cast("long").alias("leaves"),
                    ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    out = F.struct((down + 1).alias("pos"), F.coalesce("next_conv", "parent_conv").alias("s_conv"),
                   F.when(F.col("next_conv").isNotNull(), down).when(F.col("depth") > 0, down - 1).otherwise(null).alias("s_pos"),
                   F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return nodes.select("conv", F.explode(F.array(into, out)).alias("a")).select("conv", "a.*")


ARC = "conv bigint, pos bigint, s_conv bigint, s_pos bigint, leaves bigint, saved bigint"


def joined_runs(whole: pa.Table) -> pa.RecordBatch:
    """Arcs that follow each other in this partition as runs: each arc gets the sums from itself to the end of
    its run and the run's successor elsewhere; `head` marks the first arc of a run."""
    conv, pos = numbers(whole, "conv"), numbers(whole, "pos")
    none = whole.column("s_conv").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    s_conv, s_pos = numbers(whole, "s_conv"), numbers(whole, "s_pos")
    n, ids = len(conv), np.unique(conv)
    wide = int(max(pos.max(), s_pos.max())) + 1
    own = np.searchsorted(ids, conv) * wide + pos
    place = np.minimum(np.searchsorted(ids, s_conv), len(ids) - 1)
    goal = np.where((ids[place] == s_conv) & ~none, place * wide + s_pos, -1)
    at = np.minimum(np.searchsorted(own, goal), n - 1)
    after = np.where(own[at] == goal, at, n)  # n: the run ends here
    head = np.ones(n + 1, bool)
    head[after] = False
    sums = [np.append(numbers(whole, c), 0) for c in ("leaves", "saved")]
    tail = np.arange(n + 1)
    step = np.append(after, n)
    while (step < n).any():  # doubling: after k rounds a pointer has jumped 2^k arcs
        sums = [s + s[step] for s in sums]
        tail = np.where(step < n, tail[step], tail)
        step = step[step]
    last = tail[:n]
    return pa.RecordBatch.from_pydict({
        "conv": conv, "pos": pos, "s_conv": pa.array(s_conv[last], mask=none[last]),
        "s_pos": pa.array(s_pos[last], mask=none[last]), "leaves": sums[0][:n], "saved": sums[1][:n], "head": head[:n]})


def paired(df: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """A shorter list and what was taken out of it: an arc whose coin shows 0 goes into its predecessor whose coin shows 1."""
    coin = lambda c, p: F.xxhash64(F.lit(salt), F.col(c), F.col(p)).bitwiseAND(F.lit(1))
    next_ = df.filter(coin("conv", "pos") == 0).select(*[F.col(c).alias(f"n_{c}") for c in df.columns])
    on = (coin("s_conv", "s_pos") == 0) & (F.col("s_conv") == F.col("n_conv")) & (F.col("s_pos") == F.col("n_pos"))
    ones = staged(df.filter(coin("conv", "pos") == 1).join(next_, on, "left"), "pairs")
    hit = F.col("n_conv").isNotNull()
    longer = ones.select("conv", "pos", *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("s_conv", "s_pos")],
                         *[(F.col(c) + F.coalesce(f"n_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
    gone = ones.filter(hit).select(*[F.col(f"n_{c}").alias(c) for c in df.columns])
    alone = df.filter(coin("conv", "pos") == 0).join(gone.select("conv", "pos"), ["conv", "pos"], "left_anti")
    return staged(longer.unionByName(alone.select(longer.columns)), "shorter"), gone


def filled(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """Sums to the end of the list: an arc's own and those of its successor."""
    s = ranks.select(F.col("conv").alias("s_conv"), F.col("pos").alias("s_pos"), F.col("leaves").alias("r_leaves"),
                     F.col("saved").alias("r_saved"))
    return df.join(s, ["s_conv", "s_pos"], "left").select(
        "conv", "pos", *[(F.col(c) + F.coalesce(f"r_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])


def suffix_sums(df: DataFrame, n: int, level: int = 0) -> DataFrame:
    """(conv, pos, leaves, saved): for every arc of a list (about n arcs) the sums over it and all arcs after it."""
    runs = passed(df.select("conv", "pos", "s_conv", "s_pos", "leaves", "saved"), n, ["conv", "pos"], joined_runs,
                  ARC + ", head boolean", "runs")
    n, shorter = runs.agg(F.count(F.lit(1)), F.count_if("head")).first()
    heads = runs.filter("head").drop("head")
    if shorter <= 1:
        return runs.select("conv", "pos", "leaves", "saved")
    if shorter <= 0.7 * n:
        return filled(runs, suffix_sums(heads, shorter, level + 1))
    rest, gone = paired(heads, level)
    ranks = staged(suffix_sums(rest, shorter, level + 1), "ranks")
    return filled(runs, ranks.unionByName(filled(gone, ranks)))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    n = conversations.count()
    rows = prefixes(rebuilt(conversations, n), 2 * n)
    key = ["depth", *LANES]
    nodes = rows.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"),
                                   F.max("chars").alias("chars"), *[F.max(f"g{i}").alias(f"g{i}") for i in range(4)])
    tree = linked(nodes, n)
    sign = F.when(F.col("pos") % 2 == 0, 1).otherwise(-1)
    sums = (suffix_sums(arcs(tree), 2 * n).groupBy("conv", F.shiftright("pos", 1).alias("depth"))
            .agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens")))
    lists = member_lists(rows.filter("ends").select(*key, "conv"), n)
    nothing = hashlib.sha256(b"").hexdigest()
    return (tree.join(sums, ["conv", "depth"]).join(lists, key, "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
                    "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
