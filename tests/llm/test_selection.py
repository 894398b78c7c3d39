"""Operators 7, 8 and 9, and the pipeline."""
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgate.llm import ann, decontaminate, mixing, simhash
from corpusgate.llm.common import staged
from corpusgate.llm.language_id import has_letter
from tests.llm.tables import CLASH, EMPTY, SMALL, lower, odd, odd_rows, small, words

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1)
                                  for i, v in rows], VECTORS)


def nearest(rows, query, q, k=10):
    near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v))), i) for i, v in rows if i != query)
    return near[:k]


def test_search_finds_most_of_the_true_neighbours(spark):
    rng = np.random.default_rng(7)
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)))]
    df = vectors(spark, rows)
    got = ann.search(df, df.filter("vec_id % 100 = 0"), centroids=8).collect()
    hits = 0
    for query, v in rows[::100]:
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and query not in [r.vec_id for r in mine]
        assert all(math.isclose(r.score, math.dist(v, rows[r.vec_id][1]), rel_tol=1e-12) for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in nearest(rows, query, v)})
    assert hits / 150 >= 0.9


def test_query_on_given_vectors_has_recall(spark):
    got = ann.op7_multi_index(spark, SMALL).collect()
    rows = [(r.vec_id, r.embedding) for r in small(spark, "embeddings").collect()]
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    true = {i: {j for _, j in nearest(rows, i, v)} for i, v in rows if i % 100 == 0}
    assert by.keys() == true.keys()
    assert sum(len(by[i] & true[i]) for i in true) / sum(map(len, true.values())) >= 0.9


def test_odd_vectors_copies_and_ties(spark):
    good = [(i, [1.0, float(i % 3), 0.0, 2.0]) for i in range(40)]
    bad = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 2.0]), (103, [1.0, float("nan"), 0.0, 2.0]),
           (104, [1.0, float("inf"), 0.0, 2.0]), (105, [1.0, 2.0]), (106, []), (None, [1.0, 1.0, 0.0, 2.0])]
    df = vectors(spark, good + bad)
    got = ann.search(df, df.filter("vec_id in (0, 7, 101, 102, 105)"), centroids=4)
    for query in (0, 7):
        mine = [(r.score, r.vec_id) for r in got.filter(f"query_id = {query}").orderBy("rank").collect()]
        assert mine == nearest(good, query, dict(good)[query])
    assert {r.query_id for r in got.collect()} == {0, 7}


def test_repeated_rows_push_no_neighbour_out(spark):
    """Equal rows are one query and one candidate; rows of one id with different vectors are one each."""
    rng = np.random.default_rng(3)
    single = lambda v: np.float32(v).astype(float).tolist()
    rows = [(i, single(rng.normal(size=6))) for i in range(80)]
    rows += [(7, single(np.array(rows[7][1]) + 1e-3 * j)) for j in range(1, 20)]  # nearer to 7 than any other id
    rows += [(99, rows[9][1])] * 30 + [(98, rows[9][1])]  # copies of one id at one vector
    base = vectors(spark, rows + rows[:40])
    asked = [rows[7], rows[7], rows[81], rows[9], rows[9], rows[9]]
    other = [(5, [1.0, 0.0])] * 9  # the most frequent length of the queries is not the candidates'
    got = ann.search(base, vectors(spark, asked + other), centroids=2).collect()
    distinct = {(i, tuple(v)) for i, v in rows}
    expected = []
    for query, v in (rows[7], rows[81], rows[9]):
        near = sorted((math.dist(v, w), i) for i, w in distinct if i != query)[:10]
        expected += [(query, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(expected)


def test_few_or_no_candidates(spark):
    two = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert [tuple(r) for r in ann.search(two, two).orderBy("query_id").collect()] == [
        (1, 1, 2, math.sqrt(2)), (2, 1, 1, math.sqrt(2))]
    assert ann.search(two.limit(0), two).collect() == []
    assert ann.search(two, two.limit(0)).collect() == []


def test_the_walk_visits_every_cell_by_rising_distance():
    rng = np.random.default_rng(1)
    books = ann.Codebooks(rng.normal(size=(60, 6)), 5)
    q = rng.normal(size=6)
    order = list(books.walk(q))
    d = [((b - part) ** 2).sum(axis=1) for b, part in zip(books.books, (q[:3], q[3:]))]
    total = [d[0][c // books.width] + d[1][c % books.width] for c in order]
    assert sorted(order) == list(range(25)) and total == sorted(total)


def poured(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing what lies above a source's stop, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        target |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def check_mix(rows, texts):
    """rows: doc_id, source, size, source_size, target, taken; against the texts and the poured targets."""
    sizes, taken, largest = {}, {}, {}
    for (doc_id, text, source), r in zip(texts, rows):
        n = len(words(text))
        assert r["size"] == n and (r["taken"] % n == 0 if n else r["taken"] == 0) and r["taken"] <= 3 * n
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + r["taken"]
        largest[source] = max(largest.get(source, 0), n)
    expected = poured(sizes)
    for (_, _, source), r in zip(texts, rows):
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], expected[source], rel_tol=1e-9, abs_tol=1e-9)
    return sizes, expected, taken, largest


def test_mix_of_given_documents_meets_its_targets(spark):
    docs = small(spark).select("doc_id", "text", "source")
    rows = mixing.mix(docs).orderBy("doc_id").collect()
    flat = [dict(r["mix"].asDict(), doc_id=r.doc_id) for r in rows]
    sizes, target, taken, largest = check_mix(flat, [(r.doc_id, r.text, r.source) for r in rows])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = {r.doc_id: r.taken for r in mixing.op8_pareto_mix(spark, SMALL).collect()}
    assert again == {f["doc_id"]: f["taken"] for f in flat}  # reruns agree


def test_mix_of_odd_rows(spark):
    docs = odd(spark)
    got = mixing.mix(docs)
    [out] = [c for c in got.columns if c not in docs.columns]
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and set(CLASH) < set(got.columns)
    check_mix([r[out].asDict() for r in rows], [(r.doc_id, r.text, r.source) for r in rows])
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[out].copies for r in rows)
    assert mixing.mix(spark.createDataFrame([], EMPTY)).collect() == []


def test_mix_with_one_huge_source_and_empty_ones(spark):
    rows = ([(i, "w " * (1 + i % 50), "hot") for i in range(2000)] + [(5000 + i, "w " * 3, f"s{i:02}") for i in range(12)]
            + [(6000, "", "void"), (6001, None, None)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r["mix"].asDict() for r in mixing.mix(docs).collect()}
    sizes, target, taken, largest = check_mix([got[r[0]] for r in rows], rows)
    assert target["void"] == 0 and target[None] == 0 and target["s00"] == 9
    assert all(abs(taken[s] - target[s]) <= max(1, largest[s]) / 2 for s in sizes)


@pytest.mark.parametrize("same", [True, False])
def test_rows_with_one_id_or_none_meet_their_targets(spark, same):
    """100 rows of 10 words without an id and 50 of one id, equal texts or not, are drawn each for itself."""
    rows = [(None, " ".join(["w" if same else f"w{i}"] * 10), "a") for i in range(100)]
    rows += [(7, " ".join(["v" if same else f"v{i}"] * 10), "a") for i in range(50)] + [(1000 + i, "x " * 10, "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1.0, 3.0), (3.0, 1.0)):
        found = mixing.mix(docs, weights=weights).select("source", "mix.*").groupBy("source").agg(
            F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
        assert sorted(r.n for r in found) == [150, 200] and all(abs(r.taken - r.target) <= 5 for r in found)


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (4 if i % 2 else 256), "a") for i in range(4000)] + [(9000 + i, "w " * 100_000, "b") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1.0, 1.0)).filter("source = 'a'").select("mix.size", "mix.copies").collect()
    rate = {n: np.mean([r.copies for r in got if r["size"] == n]) for n in (4, 256)}
    assert rate[256] > rate[4]


def windows_hit(docs, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = {}
    for i, t in items:
        w = cut(t)
        for j in range(len(w) - min(n, len(w)) + 1 if w else 0):
            wins.setdefault(tuple(w[j:j + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in wins:
                    hit.update(range(j, j + k))
                    found |= wins[tuple(w[j:j + k])]
        out.append((i, len(w), len(hit), sorted(found), sorted(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_leaks_in_odd_rows(spark, block_bytes):
    items = [(1, odd_rows()[5][1]), (2, "Two, WORDS!"), (10, "b c d e f g h i j k l m"), (3, None), (4, " .,; "), (None, "word"),
             (1, "word"), (5, "naïve Übergröße 東京"), (6, "inside endoftext")]
    docs = odd(spark)
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    [out] = [c for c in got.columns if c not in docs.columns]
    found = sorted(((r.doc_id, r[out].n_words, r[out].n_hit, r[out]["items"],
                     [x for s in r[out].spans for x in range(s.start, s.stop)]) for r in got.collect()), key=str)
    assert found == sorted(windows_hit([r[:2] for r in odd_rows()], items), key=str)


def test_one_block_is_alive_at_a_time(spark, monkeypatch):
    """Driver: the block at work and the one read ahead; a worker: the last set it was given."""
    import gc
    import weakref

    alive, most = weakref.WeakSet(), []
    make = decontaminate.WindowSet.__init__

    def counted(self, *a):
        gc.collect()
        make(self, *a)
        alive.add(self)
        most.append(len(alive))

    monkeypatch.setattr(decontaminate.WindowSet, "__init__", counted)
    items = spark.createDataFrame([(i, f"item {i} secret") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "item 0 secret and item 5 secret"), (2, "item 3 secret"), (3, "clean")],
                                 "doc_id long, text string")
    got = decontaminate.scan(docs, items, block_bytes=1)
    assert {r.doc_id: (r.leak.n_hit, r.leak["items"]) for r in got.collect()} == {
        1: (6, ["0", "5"]), 2: (3, ["3"]), 3: (0, [])}
    assert len(most) == 6 and max(most) <= 2

    def held(batches):
        import sys

        import pyarrow

        for batch in batches:
            store = getattr(sys.modules.get("_llm_worker_store"), "leak_windows", {})
            yield pyarrow.RecordBatch.from_pydict({"n": pyarrow.array([len(store)] * len(batch), pyarrow.int32())})

    assert spark.range(64).repartition(16).mapInArrow(held, "n int").agg({"n": "max"}).first()[0] <= 1


def test_leaks_are_removed_as_spans_or_documents(spark):
    docs = spark.createDataFrame([(1, "Keep, this. SECRET answer here; and this"), (2, "All clean,  here")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "secret answer")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.remove_documents(docs, bench).collect()] == [(2, "All clean,  here")]
    assert [tuple(r) for r in decontaminate.remove_spans(docs, bench).orderBy("doc_id").collect()] == [
        (1, "keep this here and this"), (2, "All clean,  here")]
    none = bench.limit(0)
    assert decontaminate.remove_documents(docs, none).count() == 2
    assert decontaminate.scan(docs.limit(0), bench).collect() == []


def test_leak_query(spark):
    items = [(r.item_id, r.text) for r in small(spark, "benchmark").collect()]
    expected = [(i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0)
                for i, n, h, f, _ in windows_hit([(r.doc_id, r.text) for r in small(spark).collect()], items)]
    assert sorted(tuple(r) for r in decontaminate.op9_decontaminate(spark, SMALL).collect()) == sorted(expected)


def test_pipeline_stages_on_given_documents(spark):
    docs = small(spark)
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language_id", "near_duplicates", "decontamination", "mixing", "token_files"]
    at = staged(named["language_id"](spark, docs, SMALL), "t")
    assert sorted(r.doc_id for r in at.collect()) == sorted(r.doc_id for r in docs.collect() if has_letter(r.text))
    before, at = at, staged(named["near_duplicates"](spark, at, SMALL), "t")
    heads = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in at.collect()) == sorted(heads)
    before, at = at, staged(named["decontamination"](spark, at, SMALL), "t")
    items = [(r.item_id, r.text) for r in small(spark, "benchmark").collect()]
    clean = {i for i, _, h, _, _ in windows_hit([(r.doc_id, r.text) for r in before.collect()], items) if not h}
    assert {r.doc_id for r in at.collect()} == clean
    before, at = at, staged(named["mixing"](spark, at, SMALL), "t")
    copies = {r.doc_id: r["mix"].copies for r in mixing.mix(before).collect()}
    assert {r.doc_id: r["count"] for r in at.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert at.columns == columns
    last = named["token_files"](spark, at, SMALL)
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert sorted(tuple(r) for r in last.collect()) == whole and len(whole) == at.count()


def test_pipeline_stages_on_odd_and_empty_tables(spark):
    for docs in (odd(spark), spark.createDataFrame([], EMPTY)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = staged(stage(spark, docs, SMALL), "t")
            assert after.columns == docs.columns, name
            if name != "mixing":
                left = {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
                assert {(r.doc_id, zlib.crc32((r.text or "").encode())) for r in after.collect()} <= left
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
        assert docs.filter(F.col("text").isNull()).count() == 0
