"""Operators 1 and 3 against the tokenizers library."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusgate.llm import token_counts, tokens, wavelet
from corpusgate.llm.tokens import Pieces
from tests.llm.tables import CLASH, EMPTY, SMALL, odd, odd_rows, small

PATH = token_counts.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(PATH)
    return lambda text: lib.encode(text or "", add_special_tokens=False).ids


SPACES = ["", " ", "  ", "   ", "\n", "\n\n", "\n\n\n", " \n", "\n ", "\t", " \t ", " ", "   ", "\r\n", "\x1c", " \x1c "]


@pytest.mark.parametrize("gap", SPACES)
def test_pieces_are_the_library_s_ids(library, gap):
    pieces = Pieces(PATH)
    texts = [gap, f"{gap}a", f"a{gap}", f"one{gap}two", f"one,{gap}Two's{gap}{gap}3", f"x <|endoftext|>{gap}y{gap}", f"{gap}.{gap}é"]
    for text, values in zip(texts, pieces.encode(texts)):
        assert np.frombuffer(b"".join(values), np.uint16).tolist() == library(text), repr(text)


def test_random_texts_agree_through_a_tiny_cache(library):
    rng = np.random.default_rng(1)
    parts = ["sea", "Sea", "'s", "12", "é", "東京", "\n", " ", "  ", "\t", ".", ",,", "<|endoftext|>", "a" * 60, " "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(400)]
    ids, counts = Pieces(PATH, limit=50), Pieces(PATH, lengths_only=True, limit=50)
    for a in range(0, len(texts), 7):
        for text, raw, n in zip(texts[a:], ids.encode(texts[a:a + 7]), counts.encode(texts[a:a + 7], {"sea": 1})):
            assert np.frombuffer(b"".join(raw), np.uint16).tolist() == library(text), repr(text)
            assert sum(n) == len(library(text)), repr(text)


def test_counts_of_odd_rows(spark, library):
    docs = odd(spark)
    got = token_counts.count(docs, PATH, keep=8)
    [out] = [c for c in got.columns if c not in docs.columns]
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r[out].n_tokens == len(library(r.text)) and r[out].n_bytes == len((r.text or "").encode())
        assert r.leak == r.size and (r.doc_id is None or r.leak == "kept") and set(CLASH) <= set(got.columns)


def test_counts_of_nothing(spark):
    assert token_counts.count(spark.createDataFrame([], EMPTY), PATH).collect() == []


def test_summaries_merge_to_the_frequent(spark):
    docs = small(spark).select("doc_id", "text").repartition(9)
    found = token_counts.frequent(docs, keep=40, fan=3)
    assert len(found) <= 40 and {"the", "of"} <= set(found[:6])


def test_the_query_counts_every_document(spark, library):
    got = {r.doc_id: r for r in token_counts.op1_token_counts(spark, SMALL).collect()}
    docs = small(spark).collect()
    assert len(got) == len(docs)
    for r in docs:
        n = len(library(r.text))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 1024)


def matrix(ids, bits):
    return wavelet.Matrix(len(ids), *wavelet.build(np.array(ids, np.uint32), bits))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 511, 512, 513, 5000])
def test_matrix_answers_access_count_and_occurrence(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n)
    m = matrix(ids, 6)
    assert m.decode().tolist() == ids.tolist()
    for i in rng.integers(0, max(1, n), 20) if n else []:
        assert m.access(int(i)) == ids[i]
    for value in (0, 3, 39, 50, 64):
        at = np.flatnonzero(ids == value)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(value) == len(at) and m.count(value, a, b) == ((at >= a) & (at < b)).sum()
        assert [m.locate(value, k) for k in range(min(5, len(at)))] == at[:5].tolist()
        with pytest.raises(IndexError):
            m.locate(value, len(at))


def placed(rows, library):
    """What reading must give: documents by id (null first) and text, ends appended."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library(text) + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard", [1, 100, 1 << 20])
def test_files_round_trip(spark, library, tmp_path, shard):
    rows = [r[:2] for r in odd_rows()]
    wavelet.write(odd(spark).repartition(3), str(tmp_path / "w"), PATH, shard=shard)
    got = sorted((tuple(r) for r in wavelet.read(spark, str(tmp_path / "w")).collect()), key=lambda r: r[1])
    assert got == placed(rows, library)


def test_files_of_nothing(spark, tmp_path):
    wavelet.write(spark.createDataFrame([], EMPTY), str(tmp_path / "w"), PATH)
    assert wavelet.read(spark, str(tmp_path / "w")).collect() == []


def test_the_query_reads_every_document(spark, library):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    got = sorted((tuple(r) for r in wavelet.op3_wavelet_files(spark, SMALL).collect()), key=lambda r: r[1])
    assert got == placed(rows, library)


ODD_PIECES = ["sea", "Sea,", "Ġ", "aĠĠb", "'s", "''s", "don't", "᠎", "a᠎", "​", "<|endoftext|", "a﻿b", "東京", "12,5", "é"]


@pytest.mark.parametrize("leads", [True, False])
def test_pieces_learned_together_are_the_library_s(library, leads):
    pieces = Pieces(PATH)
    assert pieces.leads is not None
    pieces.leads = pieces.leads if leads else None
    alone = []
    pieces.piece = lambda p: alone.append(p) or Pieces.piece(pieces, p)
    pieces.learn(set(ODD_PIECES))
    assert alone == []
    for p in ODD_PIECES:
        assert np.frombuffer(pieces.cache[p], np.uint16).tolist() == library(" " + p), repr(p)


def test_frequent_pieces_outlive_a_full_cache(library):
    pieces, learned = Pieces(PATH, limit=100), []
    pieces.learn = lambda new: learned.extend(new) or Pieces.learn(pieces, new)
    for a in range(20):
        text = " sea " + " ".join(f"w{i}" for i in range(a * 30, a * 30 + 30))
        [values] = pieces.encode([text])
        assert np.frombuffer(b"".join(values), np.uint16).tolist() == library(text)
        assert len(pieces.cache) + len(pieces.old) <= 100 + 2 * 31
    assert learned.count("sea") == 1 and len(learned) == 1 + 20 * 30


WORDS = ["sea", "Sea.", "sea,,", "l'été.", "Ærø!", "a.b", "×", "ǅx", "東京.", "it's", "''", "$$$", "x" * 60 + ".", "y" * 10 + "." * 9, "12."]


@pytest.mark.parametrize("lengths_only", [True, False])
def test_words_learned_by_the_model_are_the_library_s(library, lengths_only):
    pieces, joined = Pieces(PATH, lengths_only), []
    pieces.learn_joined = lambda part, *a: joined.extend(part) or Pieces.learn_joined(pieces, part, *a)
    pieces.learn({*WORDS, *("\n" + w for w in WORDS), "", "\n"})
    assert not {"sea", "Sea.", "sea,,", "Ærø!", "\nSea."} & set(joined)
    for p, value in pieces.cache.items():
        ids = library(p if p[:1] == "\n" else " " + p)
        assert (value if lengths_only else np.frombuffer(value, np.uint16).tolist()) == (len(ids) if lengths_only else ids), repr(p)


@pytest.mark.parametrize("size", [1, 300, 1 << 22])
def test_a_column_gives_the_library_s_ids(library, monkeypatch, size):
    monkeypatch.setattr(tokens, "BYTES", size)
    rng = np.random.default_rng(2)
    parts = [*WORDS, "\n", " ", " ", " ", "  ", "\n\n\n", "\t", "\u00a0", "<|endoftext|>"]
    texts = [None, "", " ", "\n", *["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(300)], None]
    pieces = Pieces(PATH, limit=50)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *texts], kind).slice(1)
        assert [np.frombuffer(raw, np.uint16).tolist() for raw in pieces.column(column)] == list(map(library, texts))
    assert list(pieces.column(pa.array([], pa.string()))) == []


def test_a_column_looks_each_distinct_piece_up_once():
    pieces, asked = Pieces(PATH), []
    pieces.values = lambda new: asked.extend(new) or Pieces.values(pieces, new)
    list(pieces.column(pa.array(["the sea the sea", "a sea\nthe sea"] * 50)))
    assert sorted(asked) == ["\nthe", "sea", "the"]
