"""Operator 13 against both libraries and a comparison of all byte ranges."""
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusgate.llm import alignment
from corpusgate.llm.token_counts import tokenizer_path
from tests.llm.tables import EMPTY, SMALL, odd, odd_rows, small

A, B = tokenizer_path(alignment.TOKENIZER), tokenizer_path(alignment.MODEL)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_of_letter()

    def ranges(text):
        raw = b" " + text.encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return [], []
        out = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            out.append([(i, e - len(p), e) for i, p, e in zip(ids, parts, ends)])
        return out

    return ranges


def expected(rows, ranges):
    found, count = [], Counter()
    for doc_id, text in rows:
        a, b = ranges(text or "")
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        borders = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for high in borders:
            inside = [",".join(str(x[0]) for x in side if low <= x[1] and x[2] <= high) for side in (a, b)]
            groups.append("|".join(inside))
            low = high
        found.append((doc_id, len(a), len(b), groups, links))
        count.update(links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((d, a, b, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, ls in found), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("gap", ["", " ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", " ", "▁", "\x00", "　"])
def test_ids_are_the_libraries_own(libraries, gap):
    tool = alignment.Aligner(A, B)
    texts = [gap, f"{gap}a", f"a{gap}", f"one{gap}two", f"one,{gap}Two's{gap}{gap}3{gap}", f"x <|endoftext|>{gap}y", f"<s>{gap}é東🙂</s>",
             f"ﬁ{gap}ＡＢ é"]
    for text, got in zip(texts, tool.tokens(texts)):
        a, b = libraries(text)
        assert got is None if not a else (got[0].tolist(), got[1].tolist()) == ([x[0] for x in a], [y[0] for y in b]), repr(text)


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_odd_rows_with_any_table_size(spark, libraries, most):
    rows = [(i, (t or "")[:1500]) for i, t, *_ in odd_rows()] + [(90, "a▁b"), (91, "  two"), (92, " one"), (93, "end ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_a", "'kept' as links").repartition(3)
    assert answer(alignment.align(docs, A, B, most)) == expected(rows, libraries)


def test_odd_columns_and_nothing(spark):
    found = alignment.align(odd(spark), A, B).collect()
    assert len(found) == len(odd_rows())
    assert all((r.n_a, r.n_links, r.groups_sha256) == (0, 0, "") for r in found if r.doc_id in (0, 1))
    assert alignment.align(spark.createDataFrame([], EMPTY), A, B).collect() == []


def test_the_query_aligns_every_document(spark, libraries):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    short = [r for r in rows if len(r[1] or "") < 2500]
    got = {r.doc_id: r for r in alignment.op13_token_alignment(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for want in expected(short, libraries):
        r = got[want[0]]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*want[1:5], want[7])


def test_pieces_of_texts_that_stay_whole_are_met_again(libraries):
    tool = alignment.Aligner(A, B)
    for texts in (["two  zzyzx"], ["a zzyzx"]):
        for text, got in zip(texts, tool.tokens(texts)):
            a, b = libraries(text)
            assert (got[0].tolist(), got[1].tolist()) == ([x[0] for x in a], [y[0] for y in b])


def test_each_distinct_piece_is_aligned_once(libraries):
    tool, seen = alignment.Aligner(A, B), []
    tool.align = lambda a, b, unit: seen.append(len(np.unique(unit))) or alignment.Aligner.align(tool, a, b, unit)
    counts, digests, links = tool.digests(pa.array(["the sea the sea", "a sea\nthe sea"] * 50, pa.large_string()))
    assert seen == [4]  # the, sea, a, and the with a line end
    assert len(set(digests)) == 2 and len({raw for raw in links}) == 2 and counts[:, 0].tolist() == counts[:, 98].tolist()


@pytest.mark.parametrize("cache, block", [(1 << 20, 1 << 17), (20, 1), (3, 5)])
def test_digests_through_small_caches_and_blocks(libraries, monkeypatch, cache, block):
    monkeypatch.setattr(alignment, "CACHE", cache)
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = np.random.default_rng(3)
    parts = ["sea", "Sea,", "é", "ﬁ", "東京", "\n", " ", " ", " ", "  ", "\t", "▁", "<|endoftext|>", "x" * 60, "12."]
    texts = ["", *["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(120)]]
    tool = alignment.Aligner(A, B)
    for at in range(0, len(texts), 30):
        counts, digests, links = tool.digests(pa.array(texts[at:at + 30], pa.large_string()))
        for i in range(len(digests)):
            [row] = expected([(0, texts[at + i])], libraries)
            assert (*counts[:, i].tolist(), digests[i]) == (*row[1:5], row[7]), repr(texts[at + i])
            assert len(links[i]) == 4 * row[4]
