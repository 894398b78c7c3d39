"""Operators 2, 6 and 10: language model, toxicity, language identification."""
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgate.llm import brown, language_id, toxicity
from tests.llm.tables import CLASH, EMPTY, SMALL, lower, odd, odd_rows, small, words


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def base_scores(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base score) of every row."""
    texts = [(i, crc(i) % 10 == 0, words(lower(t)) + [None]) for i, t in rows]
    c = Counter(w for _, held, ws in texts if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for i, held, ws in texts]


def same(got, expected):
    got = sorted((tuple(r)[:6] for r in got), key=str)
    expected = sorted(expected, key=str)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(math.isclose(g[5], e[5], rel_tol=1e-9) for g, e in zip(got, expected))


def test_language_model_of_odd_rows(spark):
    got = brown.score(odd(spark), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0,
                      size=20, n_classes=4).collect()
    same(got, base_scores([r[:2] for r in odd_rows()]))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_are_the_plain_sum_over_classes(spark, monkeypatch):
    """Class after class and word within class, token by token, from the classes that the model chose."""
    kept = {}
    for name in ("most_frequent", "cluster", "classes_of_others"):
        def noted(*a, real=getattr(brown, name), name=name):
            kept[name] = real(*a)
            return kept[name]
        monkeypatch.setattr(brown, name, noted)
    rows = [(r.doc_id, r.text) for r in small(spark).limit(60).collect()] + [(900 + i, t) for i, (_, t, *_) in enumerate(odd_rows())]
    held = lambda i: crc(i) % 10 == 0
    got = brown.score(spark.createDataFrame(rows, "doc_id long, text string"),
                      F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, size=40, n_classes=5).collect()
    texts = {i: words(lower(t)) for i, t in rows}
    count = Counter(w for i, ws in texts.items() if not held(i) for w in ws)
    of = {w.decode(): int(c) for w, c in zip(kept["most_frequent"], kept["cluster"][0])}
    of |= {bytes(r.word).decode(): r["class"] for r in kept["classes_of_others"].collect()}
    assert {w for w, n in count.items() if n >= brown.MIN_COUNT} <= set(of) and len(kept["most_frequent"]) == 40
    rest, end = 5, 6
    path = {i: [end] + [of.get(w, rest) for w in ws] + [end] for i, ws in texts.items()}
    follow = np.zeros((7, 7))
    for i, p in path.items():
        for a, b in zip(p, p[1:]):
            follow[a, b] += not held(i)
    mass = Counter()
    for w, n in count.items():
        mass[of.get(w, rest)] += n
    rare = [n for n in count.values() if n < brown.MIN_COUNT]
    d = brown.DELTA
    for r in got:
        total = 0.0
        for a, b in zip(path[r.doc_id], path[r.doc_id][1:]):
            share = (follow[:, b].sum() + 1) / (follow.sum() + 7)
            total += math.log10((follow[a, b] + brown.ALPHA * share) / (follow[a].sum() + brown.ALPHA))
        for w in texts[r.doc_id]:
            total += math.log10(count[w] / mass[of[w]]) if w in of else math.log10((count[w] + d) / (sum(rare) + d * (len(rare) + 1)))
        assert math.isclose(r.score, total, rel_tol=1e-9), r.doc_id


def test_language_model_without_rows_or_training_rows(spark):
    assert brown.score(spark.createDataFrame([], EMPTY), F.lit(False)).collect() == []
    [row] = brown.score(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score)


def test_classes_follow_what_stands_beside_the_words(spark):
    # two grammars of their own: words of one never stand beside words of the other
    rng = random.Random(2)
    kinds = [[f"{g}{k}{i}" for i in range(6)] for g in "ab" for k in "xy"]
    texts = [" ".join(rng.choice(kinds[2 * (n % 2) + j % 2]) for j in range(40)) for n in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = sorted({w.encode() for t in texts for w in t.split()})
    coded = brown.encode(docs.withColumn("held_out", F.lit(False)), vocabulary)
    found, n, pairs = brown.cluster(coded, len(vocabulary), n_classes=4, rounds=8)
    assert n.sum() == 400 * 40 and pairs[:4, :4].sum() == 400 * 39
    start = brown.matrix_of(brown.neighbour_counts(coded, np.arange(24) % 4, 4), 6)
    one = brown.matrix_of(brown.neighbour_counts(coded, np.arange(24) * 0, 4), 6)
    ideal = brown.matrix_of(brown.neighbour_counts(coded, np.arange(24) // 6, 4), 6)
    reached = (brown.fit_of(pairs) - brown.fit_of(one)) / (brown.fit_of(ideal) - brown.fit_of(one))
    assert brown.fit_of(pairs) > brown.fit_of(start) and 0.4 < reached <= 1


def test_texts_share_probability_one(spark):
    """All texts of at most two words, one unseen word among them, stay within 1; with three words they come nearer."""
    train = ["a b", "b a", "c", "a", ""] * 8
    known = ["a", "b", "c", "never"]
    asked = [" ".join(t) for n in range(4) for t in itertools.product(known, repeat=n)]
    rows = [(i, t) for i, t in enumerate(train)] + [(1000 + i, t) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in brown.score(docs, F.col("doc_id") >= 1000, size=2, n_classes=2).collect() if r.doc_id >= 1000]
    upto = [sum(10 ** r.score for r in got if r.n_tokens <= n) for n in (2, 3, 4)]
    assert 0.5 < upto[0] < upto[1] < upto[2] < 1 and upto[2] > 0.9


def test_the_model_beats_the_base_on_held_out_texts(spark):
    got = brown.op2_brown_lm(spark, SMALL).collect()
    same(got, base_scores([(r.doc_id, r.text) for r in small(spark).collect()]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def labelled(spark, n=400, seed=4):
    """Texts of a made-up language; label 1 holds one of a few stems with changing endings."""
    rng = random.Random(seed)
    syllables = "ba de fi go lu ma ne po ri su ta vo".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(8, 40))]
        toxic = int(i % 3 == 0)
        for _ in range(2 * toxic):
            ws.insert(rng.randrange(len(ws)), rng.choice(["grukk", "zwarp", "hixxq"]) + word())
        rows.append((i, " ".join(ws), toxic))
    return rows


def test_misspelt_words_are_recognised_in_held_out_texts(spark):
    rows = labelled(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if crc(r[0]) % 4 == 2]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in held)
    assert right / len(held) > 0.95
    assert model.score(["Grukke ba de fi go lu ma"])[0] > 2 * model.score(["deba fima goli lu ma sute"])[0]


def test_toxicity_of_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(3, 1, "x"), (None, 1, "x"), (5, None, "x")],
                                   "doc_id long, toxic int, text string")
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    assert len(got.columns) == len(docs.columns) + 1
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["_toxicity"] <= 1 and r.size == r.leak for r in rows)


def test_toxicity_without_or_with_one_kind_of_labels(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["_toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    good = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert max(r["_toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, good)).collect()) < 0.01
    assert toxicity.score(spark.createDataFrame([], EMPTY), toxicity.fit(docs, none)).collect() == []


def test_a_long_text_scores_as_its_pieces_do_together(monkeypatch):
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32), 0.1)
    text = " ".join(f"w{i}" for i in range(3000))
    whole = model.score([text])
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert math.isclose(model.score(["other", text])[1], whole[0], rel_tol=1e-6)


def test_long_toxic_texts_are_learned_from(spark):
    """Toxic texts of 1,500 distinct words, more n-grams than a bag keeps."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    rows = []
    for i in range(160):
        ws = [word() for _ in range(1500 if i % 3 == 0 else 20)]
        for _ in range(len(ws) // 5 if i % 3 == 0 else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(["grukk", "zwarp", "hixxq"]) + word())
        rows.append((i, " ".join(ws), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    bags = toxicity.training_bags(docs, labels).collect()
    assert sum(r.toxic for r in bags) == sum(t for i, _, t in rows if crc(i) % 4 != 2)
    assert all(len(r.ids) // 4 <= toxicity.SAMPLE_GRAMS < r.total for r in bags if r.toxic)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in rows if crc(i) % 4 == 2)


def test_a_bag_is_the_plain_count_and_a_part_of_it_stands_for_all(monkeypatch):
    text = " ".join(f"word{i} and{i % 7}" for i in range(400))
    raw = toxicity.normal(text)
    cut = [raw[i:i + n] for n in toxicity.GRAMS for i in range(len(raw) - n + 1) if b" " not in raw[i + 1:i + n - 1]]
    plain = Counter(int(toxicity.grams(np.frombuffer(g, np.uint8))[0][-1]) for g in cut)  # the whole gram is the last one cut
    ids, counts, total = toxicity.bag(text)
    assert total == len(cut) and dict(zip(ids.tolist(), counts.tolist())) == {i: min(255, n) for i, n in plain.items()}
    monkeypatch.setattr(toxicity, "PIECE", 100)
    again = toxicity.bag(text)
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == counts.tolist() and again[2] == total
    monkeypatch.setattr(toxicity, "SAMPLE_GRAMS", 500)
    some = toxicity.bag(text)
    assert len(some[0]) == 500 and set(some[0].tolist()) < set(ids.tolist()) and some[2] == total


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    monkeypatch.setattr(toxicity, "TOXIC", 10)
    rows = labelled(spark, 300)
    docs = spark.createDataFrame([(r[0], f"{r[1]} v{j}") for r in rows for j in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] * 2, "doc_id long, toxic int")
    assert toxicity.training_bags(docs, labels).groupBy("toxic").count().orderBy("toxic").collect() == [(0, 30), (1, 10)]


def test_toxicity_query_is_the_plain_score_of_the_learned_model(spark):
    """Every n-gram cut and looked up by itself; the model is learned from the other folds alone."""
    docs, labels = small(spark).select("doc_id", "text"), small(spark, "labels")
    model = toxicity.fit(docs, labels)
    outside = lambda df: df.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    again = toxicity.fit(outside(docs), outside(labels))
    assert (model.logit == again.logit).all() and model.offset == again.offset
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, SMALL).collect()}
    for r in docs.collect()[::7]:
        raw = toxicity.normal(r.text or "")
        cut = [raw[i:i + n] for n in toxicity.GRAMS for i in range(len(raw) - n + 1) if b" " not in raw[i + 1:i + n - 1]]
        z = sum(float(model.logit[toxicity.grams(np.frombuffer(g, np.uint8))[0][-1]]) if len(g) in toxicity.GRAMS else 0
                for g in cut) / (len(cut) + toxicity.PRIOR) + model.offset
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-z)), rel_tol=1e-4), r.doc_id


def test_grams_match_a_plain_count():
    raw = toxicity.normal("Aa bcd  aa EFGHIJ")
    assert raw == b" aa bcd efghij "
    plain = [raw[i:i + n] for n in toxicity.GRAMS for i in range(len(raw) - n + 1) if b" " not in raw[i + 1:i + n - 1]]
    codes, places = toxicity.grams(np.frombuffer(raw, np.uint8))
    assert len(codes) == len(plain)
    seen = {}
    for code, at in zip(codes.tolist(), places.tolist()):
        seen.setdefault(code, []).append(at)
    assert len(seen) == len(set(plain))


def test_toxicity_query_returns_every_document(spark):
    got = toxicity.op6_toxicity(spark, SMALL).collect()
    assert len(got) == small(spark).count()
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id) % 4 == 2) for r in got)


def test_language_query_on_held_out_texts(spark):
    got = {r.doc_id: r for r in language_id.op10_language_id(spark, SMALL).collect()}
    docs = small(spark).collect()
    held = [r for r in docs if crc(r.doc_id) % 4 == 2]
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(got[r.doc_id].held_out for r in held)


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    model = language_id.fit(docs)
    assert model.langs == ["en", "xx"]
    got = language_id.identify(docs, model)
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and set(CLASH) < set(got.columns)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["_lang_id"].lang in model.langs) == letters and (r["_lang_id"].lang == "und") == (not letters)
        assert 0 <= r["_lang_id"].score <= 1 and (letters or r["_lang_id"].score == 0)
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in odd_rows())


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, "12", "en")], "doc_id long, text string, lang string")
    assert language_id.fit(docs) is None
    assert {r.lang_id.lang for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(spark.createDataFrame([], EMPTY), None).collect() == []


def test_null_and_repeated_ids_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANG", 60)
    rng = random.Random(3)
    kinds = {"aa": "ba be bi bo bu", "bb": "ka ke ki ko ku", "cc": "la le li lo lu"}
    text = lambda lang: " ".join("".join(rng.choice(kinds[lang].split()) for _ in range(3)) for _ in range(12))
    named = [(i, text(lang), lang) for i, lang in enumerate(list(kinds) * 80)]
    nobody = [(None, text(lang), lang) for lang in kinds for _ in range(100)]
    copies = [(1, named[1][1], named[1][2])] * 500 + [(None, named[2][1], named[2][2])] * 500
    docs = spark.createDataFrame(named + nobody + copies, "doc_id long, text string, lang string")
    sample = language_id.train_sample(docs).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("d")).collect()
    assert len(sample) == 3 and all(60 <= r.n == r.d <= 240 for r in sample)
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(got) == 240 + 300 + 1000 and sum(r.lang_id.lang == r.lang for r in got) > 0.98 * len(got)
    none = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(
        spark.createDataFrame([(5, "12 ...", None), (6, None, None)], "doc_id long, text string, lang string"))
    assert language_id.keep_identified(none, language_id.fit(none)).count() == docs.count()


def test_language_model_is_the_plain_ridge_solution(spark, monkeypatch):
    """Presence sets, kernel and normal equations written out; the landmarks are the rows that the model kept."""
    monkeypatch.setattr(language_id, "LANDMARKS", 12)
    docs = small(spark).filter("lang is not null").limit(120)
    model = language_id.fit(docs)
    bins = language_id.BINS

    def vector(text):
        raw = b" " + b" ".join(text.lower().encode().split()) + b" "
        sets = [set() for _ in language_id.SPECTRUM]
        for k, n in enumerate(language_id.SPECTRUM):
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(raw[i:i + n], "little")
                sets[k].add(((code ^ code >> 15) * int(language_id._MULT[n]) & 0xFFFFFFFF) >> 32 - bins.bit_length() + 1)
        return sets

    kernel = lambda x, y: sum(len(a & b) / math.sqrt(len(a) * len(b)) for a, b in zip(x, y) if a and b) / len(x)
    marks = []
    for row in model.landmarks:
        cube = row.reshape(len(language_id.SPECTRUM), bins)
        marks.append([set(np.flatnonzero(c).tolist()) for c in cube])
    learned = {r.text: r.lang for r in docs.collect() if crc(r.doc_id) % 4 != 2 and language_id.has_letter(r.text)}
    texts, langs = list(learned), list(learned.values())
    k = np.array([[kernel(vector(t), m) for m in marks] for t in texts])
    mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    y = np.array([[1.0 if g == lang else -1.0 for g in model.langs] for lang in langs])
    d = np.array([1 / langs.count(lang) for lang in langs])
    d *= len(texts) / d.sum()
    x = np.hstack([k, np.ones((len(texts), 1))])
    penalty = np.zeros((len(marks) + 1, len(marks) + 1))
    penalty[:-1, :-1], penalty[-1, -1] = language_id.RIDGE * mm, 1e-9
    w = np.linalg.solve(x.T @ (d[:, None] * x) + penalty, x.T @ (d[:, None] * y))
    assert np.allclose(model.score(texts), x @ w, atol=2e-3)


@pytest.mark.parametrize("a,b", [("sea and tide", "tide and sea"), ("abc", "xyz"), ("Same", "same")])
def test_kernel_is_the_mean_of_cosines(a, b):
    def grams(text, n):
        raw = b" " + b" ".join(text.lower().encode().split()) + b" "
        return {raw[i:i + n] for i in range(len(raw) - n + 1)}

    x, y = language_id.presence([a, b])
    plain = np.mean([len(grams(a, n) & grams(b, n)) / math.sqrt(len(grams(a, n)) * len(grams(b, n)))
                     for n in language_id.SPECTRUM])
    assert math.isclose(x @ y, plain, abs_tol=0.02)  # a hash may join two n-grams


def test_words_are_counted_exactly_and_all_frequent_ones_get_a_class(spark):
    """Order tells among words outside the table, long ones too, that occur MIN_COUNT times; not among rarer ones."""
    long = "w" * 3000
    filler = [" ".join(f"u{40 * i + j}" for j in range(40)) for i in range(60)]  # once each, over many partitions
    texts = ["a1 b1"] * 30 + ["a2 b2"] * 20 + [f"{long} b1", "a1 q"] * 10 + ["r b1", "a1 s"] * 7 + filler
    asked = [f"{long} q", f"q {long}", "r s", "s r"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    got = {r.doc_id: r.score for r in brown.score(docs, F.col("doc_id") >= 1000, size=4, n_classes=2).collect()}
    assert got[1000] > got[1001] + 0.5
    assert math.isclose(got[1002], got[1003], rel_tol=1e-9)
    counts = brown.word_counts(docs)
    assert {bytes(r.word).decode(): r.n for r in counts.collect()} == Counter(w for _, t in rows for w in words(t))
    assert brown.most_frequent(counts, 6) == [b"a1", b"b1", b"a2", b"b2", b"q", long.encode()]
    assert brown.most_frequent(counts, 5) == [b"a1", b"b1", b"a2", b"b2", b"q"]
