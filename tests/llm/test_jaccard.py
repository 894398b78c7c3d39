"""Operator 12 against a comparison of all pairs of shingle sets."""
import random

import numpy as np
import pytest

from corpusgate.llm import jaccard
from tests.llm.tables import EMPTY, SMALL, lower, odd, odd_rows, prose, small, words


def set_of(text, k=3):
    ws = words(lower(text))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def expected(rows, percent=90):
    """(doc_id, n_shingles, component_id) of every row, every pair compared."""
    sets = [frozenset(set_of(t)) for _, t in rows]
    todo, of = sorted(set(sets) - {frozenset()}, key=len), {}
    for s in todo:
        if s not in of:
            of[s], stack = s, [s]
            while stack:
                q = stack.pop()
                for r in todo:
                    if r not in of and 100 * len(q & r) >= percent * len(q | r):
                        of[r] = s
                        stack.append(r)
    first = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            first[of[s]] = min(first.get(of[s], i), i)
    return sorted(((i, len(s), first.get(of[s]) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    assert answer(jaccard.join(odd(spark))) == expected([r[:2] for r in odd_rows()])
    assert jaccard.join(spark.createDataFrame([], EMPTY)).collect() == []


def edited(seed, n, longest=60, edits=4):
    """Texts of all sizes and, of each, versions with words changed, dropped or put in: pairs just above and below the bound."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = prose(rng.random(), rng.randrange(1, longest), "oak elm ash fir yew box bay").split()
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                i = rng.randrange(len(w) + 1)
                w[i:i + rng.randrange(2)] = rng.sample("pine larch teak lime".split(), rng.randrange(2))
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,percent,tile", [(2, 90, 5), (3, 70, 7), (4, 100, 5)])
def test_edited_texts_at_any_bound(spark, monkeypatch, seed, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = edited(seed, 220)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert answer(jaccard.join(docs, percent=percent)) == expected(rows, percent)


def test_neighbours_are_shown_where_cost_says_so(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "band_sizes", lambda docs, percent: {b: 1 << 30 for b in range(60)})
    assert any(jaccard.allotment(b, 90, 1 << 30)[1] for b in range(12, 20))
    rows = edited(5, 250, 45, 3)
    assert answer(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_a_hot_group_in_which_many_do_not_link(spark, monkeypatch):
    """Versions of one text that change step by step: linked to their neighbours only, all of one group."""
    monkeypatch.setattr(jaccard, "TILE", 30)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        rng, w = random.Random(i), list(base)
        for j in rng.sample(range(40, 120), i % 12):
            w[j] = f"x{i}{j}"
        rows.append((i, " ".join(w)))
    assert answer(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_always_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for sets in (1, 1 << 24):
        for n in [1, 2, 3, 9, 10, 11, 19, 20, 40, 100, 333]:
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            for add in range(0, n // 2 + 1, max(1, n // 12)):
                for drop in range(0, n, max(1, n // 12)):
                    y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
                    both = n - drop
                    if not 100 * both >= percent * (n + len(y) - both) or (drop == add == 0):
                        continue
                    seen = []
                    for z in (x, y):
                        s, k = jaccard.shown(z, percent, dict.fromkeys(range(200), sets))
                        seen.append(dict(zip(s.tolist(), k.tolist())))
                    shared = [seen[0][s] | seen[1][s] for s in seen[0].keys() & seen[1].keys()]
                    assert jaccard.HOME | jaccard.FULL in shared, (percent, n, add, drop)


def test_the_query_holds_every_document(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    assert answer(jaccard.op12_ngram_jaccard(spark, SMALL)) == expected(rows)
