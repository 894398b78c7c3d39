"""Operator 11 against a brute force over whole prefixes."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusgate.llm import trie
from tests.llm.tables import SMALL, small

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """Every prefix of every rebuilt conversation, compared as it is."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def answer(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n, hot):
    """Conversations that share beginnings, one of them long, some turnless after rebuilding, with odd values."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 800), n):
        for t in range(rng.choice([1, 1, 2, 4, 8])):
            rows.append((c, rng.choice([t, t, None]) if c % 7 == 0 else t, rng.choice(["user", None]),
                         rng.choice(["a", "b", "", None, "é🙂"]) if t else "hello"))
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(hot)] + [(501, t, "user", f"turn {t % 3}") for t in range(hot)]
    rows += [(None, 1, "user", "nobody's"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    return rows


@pytest.mark.parametrize("seed,cut", [(1, 1), (3, 9)])
def test_trie_of_odd_conversations_over_many_ranges(spark, monkeypatch, seed, cut):
    monkeypatch.setattr(trie, "parts", lambda df, n: max(1, min(cut, n // 4)))
    monkeypatch.setattr(trie, "CHUNK", 100)
    rows = made(seed, 60, 100)
    found = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'kept' as conv", "1 as part").repartition(5)
    assert answer(trie.trie(found)) == expected(rows)


def test_one_hot_beginning_and_one_hot_copy(spark, monkeypatch):
    monkeypatch.setattr(trie, "parts", lambda df, n: max(1, min(9, n // 4)))
    monkeypatch.setattr(trie, "CHUNK", 100)
    rows = [(c, t, "user", "all the same" if t == 0 or c % 3 else f"own {c}") for c in range(150) for t in range(3)]
    assert answer(trie.trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_nothing(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


@pytest.mark.parametrize("order", ["ascending", "shuffled"])
def test_lists_are_ranked_in_any_order(spark, monkeypatch, order):
    """Shuffled ids share no range with their successors, so only random pairing shortens the list."""
    monkeypatch.setattr(trie, "parts", lambda df, n: max(1, min(16, n // 4)))
    ids = np.arange(600)
    if order == "shuffled":
        np.random.default_rng(4).shuffle(ids)
    rows = [(int(ids[i]), 0, int(ids[i + 1]) if i < 599 else None, 0 if i < 599 else None, i % 2, i) for i in range(600)]
    got = {r.conv: (r.leaves, r.saved) for r in trie.suffix_sums(spark.createDataFrame(rows, trie.ARC), 600).collect()}
    assert got == {int(ids[i]): (sum(j % 2 for j in range(i, 600)), sum(range(i, 600))) for i in range(600)}


def test_the_query_gives_every_node(spark):
    rows = [tuple(r) for r in small(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert answer(trie.op11_prefix_trie(spark, SMALL)) == expected(rows)
