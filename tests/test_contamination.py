"""Contamination against brute-force containment."""
import pytest

from corpusgate.operators.contamination import contamination, ngram_overlap


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 20])
def test_contamination_matches_brute_force(spark, block_bytes):
    docs = [(1, "a bb c d e"), (2, "xx zz yy"), (3, "the cat sat on the mat today"),
            (4, "cat sat on the"), (5, "c d"), (6, "nothing here at all"), (7, "bb  c d e"), (8, None), (9, ""), (10, "né🙂 a")]
    items = [(10, "b c d"), (11, "c d"), (12, "zz"), (13, "cat sat on the mat"), (14, "c e"),
             (15, "at sat on"), (16, "bb c d e"), (17, "sat on the mat today tomorrow"), (18, "c d"), (19, "a"), (20, "é🙂"),
             (21, " c")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    its = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(its, rows, block_bytes=block_bytes)
    got = sorted((r.item_id, r.doc_id) for r in found.collect())
    assert got == sorted((i, d) for i, t in items for d, x in docs if t in (x or ""))
    if block_bytes > 40:  # one walk over the texts, no pairing of rows with items
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
    assert contamination(its.limit(0), rows).collect() == [] and contamination(its, rows.limit(0)).collect() == []


def test_items_without_words_are_contained_in_nothing(spark):
    rows = spark.createDataFrame([(1, "any text"), (2, ""), (3, None)], "doc_id long, text string")
    its = spark.createDataFrame([(1, ""), (2, "  \n"), (3, None)], "item_id long, text string")
    assert contamination(its, rows).collect() == []


def test_ngram_overlap_counts_distinct_shared_ngrams(spark):
    items = [(1, "The tide runs OUT at noon and the tide runs out"), (2, "too short"), (3, None), (4, "a b c d")]
    docs = [(1, "say: the tide runs out at\nnoon today"), (2, "a b c d a b c d"), (3, "d c b a"), (4, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    its = spark.createDataFrame(items, "item_id long, text string")

    def grams(text, n):
        w = (text or "").lower().split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    for n in (3, 4):
        got = {(r.item_id, r.doc_id): (r.shared, r.total) for r in ngram_overlap(its, rows, n).collect()}
        assert got == {(i, d): (len(grams(t, n) & grams(x, n)), len(grams(t, n)))
                       for i, t in items for d, x in docs if grams(t, n) & grams(x, n)}
