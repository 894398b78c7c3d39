"""Operators 4 and 5 against brute force."""
import hashlib

import numpy as np
import pytest
import xxhash

from corpusgate.llm import debruijn, graph, simhash
from tests.llm.tables import EMPTY, SMALL, lower, odd, odd_rows, prose, small, words


def print_of(text, k=3):
    ws = words(lower(text))
    shingles = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    bits = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(shingles))


def classes(prints, radius=2):
    """fingerprint -> class number, every pair compared."""
    todo, out = sorted(set(prints)), {}
    for p in todo:
        if p not in out:
            out[p], stack = p, [p]
            while stack:
                q = stack.pop()
                for r in todo:
                    if r not in out and (q ^ r).bit_count() <= radius:
                        out[r] = p
                        stack.append(r)
    return out


def expected_classes(rows):
    prints = [print_of(t) for _, t in rows]
    of = classes(prints)
    first = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            first[of[p]] = min(first.get(of[p], doc_id), doc_id)
    return sorted(((doc_id, f"{p:016x}", first.get(of[p])) for (doc_id, _), p in zip(rows, prints)), key=str)


def test_simhash_of_odd_rows(spark):
    found = simhash.near_duplicates(odd(spark))
    got = sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in found.collect()), key=str)
    assert got == expected_classes([r[:2] for r in odd_rows()])


def test_simhash_query(spark):
    got = sorted((tuple(r) for r in simhash.op4_simhash(spark, SMALL).collect()), key=str)
    assert got == expected_classes([(r.doc_id, r.text) for r in small(spark).collect()])


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_what_is_near(spark, radius):
    rng = np.random.default_rng(radius)
    prints = {0}
    for centre in [0, -1, *(int(x) for x in rng.integers(-2**63, 2**63 - 1, 20))]:
        prints.add(centre)
        for _ in range(12):  # chains and balls of one to four flipped bits
            p = centre % (1 << 64)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                p ^= 1 << int(b)
            prints.add(p - (1 << 64) if p >> 63 else p)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    of = classes([p % (1 << 64) for p in prints], radius)
    groups = lambda f: sorted(sorted(p for p in prints if f(p) == c) for c in {f(p) for p in prints})
    assert groups(lambda p: roots.get(p, p)) == groups(lambda p: of[p % (1 << 64)])


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (7, 6), (6, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_leaves_one_row_of_each_class_whatever_its_id(spark):
    prints = lambda rows: {print_of(r.text) for r in rows}
    docs = odd(spark)
    kept = simhash.keep_one(docs)
    rows = kept.collect()
    of = classes([print_of(t) for _, t, *_ in odd_rows()])
    assert sorted(of[p] for p in prints(rows)) == sorted(set(of.values())) and len(rows) == len(set(of.values()))
    assert kept.columns == docs.columns
    heads = {c for _, _, c in expected_classes([r[:2] for r in odd_rows()]) if c is not None}
    assert {r.doc_id for r in rows if r.doc_id is not None} == heads
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).collect() == []
    one, two = prose(1, 50), prose(2, 50, "oak elm ash fir yew box")
    rows = [(None, one)] * 50 + [(3, two), (3, prose(3, 50, "a b c d e")), (4, two), (4, one)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, two), (3, prose(3, 50, "a b c d e")), (4, one)])


def removed(rows, k=13):
    """(doc_id, n_words, n_removed, sha256) of every row, all windows compared."""
    last = 1 << 62
    first = {}
    texts = [(last if i is None else i, words(t)) for i, t in rows]
    for i, ws in texts:
        for j in range(len(ws) - k + 1):
            w = tuple(ws[j:j + k])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in texts:
        gone = set()
        for j in range(len(ws) - k + 1):
            if first[tuple(ws[j:j + k])] < i:
                gone.update(range(j, j + k))
        kept = " ".join(w for n, w in enumerate(ws) if n not in gone)
        out.append((None if i == last else i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def answers(found):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found.collect()),
                  key=str)


@pytest.mark.parametrize("k", [13, 3, 1])
def test_spans_of_odd_rows(spark, k):
    assert answers(debruijn.dedup(odd(spark), k)) == removed([r[:2] for r in odd_rows()], k)


def test_passages_across_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "CHUNK_WORDS", 50)
    shared = [prose(s, 30, "oak elm ash fir yew box") for s in range(6)]
    rows = [(i, " ".join([prose(100 + i, i % 7, "a b c"), shared[i % 6], prose(200 + i, 20), shared[(i * 5) % 6][:60]]))
            for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert answers(debruijn.dedup(docs)) == removed(rows)


def test_spans_name_their_source(spark):
    text = prose(3, 50)
    docs = spark.createDataFrame([(4, "zero one " + text), (9, "up " + text + " down")], "doc_id long, text string")
    [span] = debruijn.spans(docs).collect()
    assert (span.id, span.start, span.stop, span.source_id, span.source_start) == (9, 1, 51, 4, 2)
    assert debruijn.dedup(spark.createDataFrame([], EMPTY)).collect() == []


def test_dedup_query(spark):
    got = sorted((tuple(r) for r in debruijn.op5_debruijn_dedup(spark, SMALL).collect()), key=str)
    assert got == removed([(r.doc_id, r.text) for r in small(spark).collect()])
