"""Byte-level BPE encoding of whole texts through a cache of pre-token pieces.

The tokenizer first cuts a text into pre-tokens and encodes each alone. Here a
text is cut before every space and every line end; each piece (its leading
space or line end included) is encoded once by the library and remembered. The
library cuts at all those places too, except inside a run of three or more white
space characters or of two or more at the end of a text: texts with such a run
go to the library whole. Special strings are split off first, as the library
does by default. So the ids are the library's own.

New pieces go to the library many to a call. In a byte-level vocabulary only tokens
at the beginning of a piece begin with a space, so they show where each piece's ids
are; other vocabularies get a line end between the pieces.

Where the library cuts texts as GPT-2 does, a run of Latin letters is one pre-token and
the punctuation behind it another. Pieces of just these go straight to the library's model.

`column` cuts a whole Arrow column at once: each distinct piece of about a megabyte of
texts is looked up once, and the ids are laid out by numpy.

The cache has two generations: a full young one becomes the old one, whose pieces
come back when they are met again. So frequent pieces stay, whatever else is met.
"""
from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 48        # longer pieces are encoded but not remembered
CACHE = 1_000_000  # pieces remembered by one worker, in both generations: about 170 bytes each
CHUNK = 256      # pieces encoded by one call
BYTES = 1 << 20  # of texts cut at once
_RUN = re.compile(r"\s\s\s|\s\s\Z")
_SPACE = re.compile(r"\s")
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
# Latin letters, and ASCII punctuation that begins no contraction
_WORD = re.compile(r"(\n?)([A-Za-zªµºÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]{0,8})")
_TAILS = 100_000  # punctuation remembered by one worker
_LEAD = "Ġ"      # how byte-level vocabularies write a space
_PAIRS = ("  ", "\n\n", " \n", "\n ")


ASIDE = "[ \n][ \n]|[" + "".join(f"\\x{{{ord(c):x}}}" for c in _OTHER_SPACES) + "]"  # in every text that is not safe


def safe(text: str) -> bool:
    """Whether every space and line end of the text is a place where the library cuts."""
    return not any(p in text for p in (*_PAIRS, *_OTHER_SPACES)) or not _RUN.search(text)


def byte_of_letter() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: printable bytes for themselves,
    the others, in order, for the code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """Token ids (little-endian unsigned 16- or 32-bit bytes) or token counts of texts."""

    def __init__(self, path: str, lengths_only: bool = False, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        added = self.lib.get_added_tokens_decoder()
        self.simple = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        self.special = {t.content: i for i, t in added.items()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.aside = "|".join([ASIDE, *map(re.escape, self.special)])
        line = self.lib.encode("\n", add_special_tokens=False).ids
        # a line end that stands alone must be one token to serve as a border between pieces
        self.border = line[0] if len(line) == 1 else None
        self.leads = self.lead_tokens()
        self.code = "H" if self.lib.get_vocab_size() < 1 << 16 else "I"
        self.width = 2 if self.code == "H" else 4
        self.lengths_only, self.limit = lengths_only, limit
        cutter = self.lib.pre_tokenizer
        self.direct = (self.leads is not None and self.border is not None and self.lib.normalizer is None
                       and isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space)
        self.letters = {b: c for c, b in byte_of_letter().items()}
        self.cache: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.tails: dict[str, object] = {}

    def lead_tokens(self) -> np.ndarray | None:
        """For each id 1 if its token has a space as its first byte alone, 2 if elsewhere, else 0.
        None if the vocabulary does not write a space as byte-level ones do."""
        special = set(self.special.values())
        tokens = {t: i for t, i in self.lib.get_vocab().items() if i not in special}
        if self.lib.encode(" ", add_special_tokens=False).ids != [tokens.get(_LEAD)] or any(" " in t for t in self.special):
            return None
        leads = np.zeros(1 + max([*tokens.values(), *special]), np.uint8)
        for t, i in tokens.items():
            if _LEAD in t:
                leads[i] = 2 if _LEAD in t[1:] else 1
        return leads

    def value(self, ids) -> object:
        return len(ids) if self.lengths_only else array(self.code, ids).tobytes()

    def whole(self, text: str) -> object:
        return self.value(self.lib.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> object:
        return self.whole(piece if piece[:1] == "\n" else " " + piece)

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the values of pieces; most are encoded many to a call, a line end between them."""
        pieces = self.learn_words(pieces) if self.direct else list(pieces)
        alone = pieces if self.border is None else []
        for a in range(0, 0 if alone else len(pieces), CHUNK):
            part, led = pieces[a:a + CHUNK], []
            if " ".join(part).split() != part:  # some are empty or hold white space
                led = [p for p in part if p[:1] == "\n" and len(p) > 1 and not _SPACE.search(p, 1)]
                good = [p for p in part if p and not _SPACE.search(p)]
                alone += set(part).difference(led, good)
                part = good
            for group, mark, skip in ((part, "\n ", 1), (led, "", 0)):
                if group and not self.learn_joined(group, mark, skip):
                    alone += group
        for p in alone:
            self.cache[p] = self.piece(p)

    def learn_words(self, pieces: Iterable[str]) -> list[str]:
        """Remember the values of letters with punctuation behind them; the pieces of other forms."""
        rest = []
        tokenize, known, line = self.lib.model.tokenize, self.cache, self.value([self.border])
        for p in pieces:
            found = _WORD.fullmatch(p)
            if not found:
                rest.append(p)
                continue
            led, word, tail = found.groups()
            value = known.get(word) if tail and not led else None
            if value is None:
                raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                value = self.value([t.id for t in tokenize(raw if led else _LEAD + raw)])
            if led:
                value = line + value
            known[p] = value + self.tail(tail) if tail else value
        return rest

    def tail(self, tail: str) -> object:
        value = self.tails.get(tail)
        if value is None:
            if len(self.tails) >= _TAILS:
                self.tails.clear()
            value = self.tails[tail] = self.whole(tail)
        return value

    def learn_joined(self, part: list[str], mark: str, skip: int) -> bool:
        """skip: 1 if the line end is only a border, 0 if it is the piece's own first token.
        False if the borders do not show (a special string or the like): then nothing is learned."""
        spaced = skip and self.leads is not None
        text = " " + " ".join(part) if spaced else "".join(mark + p for p in part) + "\nx"
        ids = self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.frombuffer(array(self.code, ids), f"u{self.width}")
        if spaced:
            leads = self.leads[ids]
            if 2 in leads:
                return False
            cuts, skip = np.append(np.flatnonzero(leads), len(ids)), 0
        else:
            cuts = np.flatnonzero(ids == self.border)
        if len(cuts) != len(part) + 1:
            return False
        if self.lengths_only:
            self.cache.update(zip(part, (np.diff(cuts) - skip).tolist()))
        else:
            raw, ends = ids.tobytes(), (cuts * self.width).tolist()
            less = skip * self.width
            self.cache.update((p, raw[x + less:y]) for p, x, y in zip(part, ends, ends[1:]))
        return True

    def encode(self, texts: list[str], known: dict[str, object] | None = None) -> list[list]:
        """For each text the values of its pieces, in order. `known` (the first tier) is asked before the cache."""
        self.turn()
        out: list[list | None] = []
        words: list[str] = []
        for text in texts:
            if not text:
                out.append([])
            elif not self.simple:
                out.append([self.whole(text)])
            elif self.split.search(text):
                out.append(self.segments(text, known))
            elif not safe(text):
                out.append([self.whole(text)])
            else:
                parts = text.replace("\n", " \n").split(" ")
                out.append([self.whole(parts[0])] if parts[0] else [])
                out[-1].append(_Count(len(parts) - 1))
                words += parts[1:]
        cache = self.cache
        got = list(map(known.get if known else cache.get, words))
        missing = [i for i, g in enumerate(got) if g is None] if None in got else []
        need = {words[i] for i in missing}
        if known and need:
            need = need.difference(cache)
        self.meet(need)
        for i in missing:
            got[i] = cache[words[i]]
        at = 0
        for i, text in enumerate(texts):
            row = out[i]
            if row and isinstance(row[-1], _Count):
                n = row.pop()
                row += got[at:at + n]
                at += n
        self.forget(need)
        return out

    def turn(self) -> None:
        if len(self.cache) > self.limit // 2:
            self.old, self.cache = self.cache, {}

    def meet(self, new: set[str]) -> None:
        """Have all of `new`, which the young cache lacks, in it."""
        if new:
            again = new & self.old.keys()
            self.cache.update((p, self.old[p]) for p in again)
            self.learn(new - again)

    def forget(self, pieces: Iterable[str]) -> None:
        for p in [p for p in pieces if len(p) > LONG]:
            del self.cache[p]

    def values(self, pieces: list[str]) -> list:
        """The values of distinct pieces."""
        self.turn()
        got = list(map(self.cache.get, pieces))
        missing = [i for i, g in enumerate(got) if g is None]
        new = [pieces[i] for i in missing]
        if self.old:
            again = {p: v for p, v in zip(new, map(self.old.get, new)) if v is not None}
            self.cache.update(again)
            new = [p for p in new if p not in again]
        self.learn(new)
        for i in missing:
            got[i] = self.cache[pieces[i]]
        self.forget(new)
        return got

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column, as bytes; null is the empty text."""
        for part in slices(texts.cast(pa.large_string()).fill_null(""), BYTES):
            yield from self.part(part)
        pa.default_memory_pool().release_unused()  # two workers stand beside an executor's heap

    def part(self, texts: pa.Array) -> list[bytes]:
        odd = {}
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, self.aside)).to_pylist() if self.simple else range(len(texts)):
            text = texts[i].as_py()
            if not self.simple or self.split.search(text) or not safe(text):
                odd[i] = b"".join(self.encode([text])[0])
        if odd:
            kept = np.ones(len(texts), bool)
            kept[list(odd)] = False
            texts, n = texts.filter(pa.array(kept)), len(texts)
        cut = cuts(texts)
        first = np.zeros(len(cut.places), bool)
        first[cut.starts[:-1]] = True
        # the first piece of a text has no space in front
        begins, begin = np.unique(cut.places[first], return_inverse=True)
        used = np.zeros(len(cut.pieces), bool)
        used[cut.places[~first]] = True
        later = np.flatnonzero(used)
        values = [self.whole(t) if t else b"" for t in words_of(cut.pieces.take(pa.array(begins)))]
        values += self.values(words_of(cut.pieces.take(pa.array(later))))
        at = np.zeros(len(cut.pieces), np.int64)
        at[later] = np.arange(len(begins), len(values))
        at = at[cut.places]
        at[first] = begin
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        raw, ends = laid_out(np.frombuffer(b"".join(values), f"u{self.width}"), sizes, at, cut.starts)
        found = [raw[a:b] for a, b in zip(ends, ends[1:])]
        if not odd:
            return found
        rest = iter(found)
        return [odd[i] if i in odd else next(rest) for i in range(n)]

    def segments(self, text: str, known: dict[str, object] | None) -> list:
        """A text with special strings: what stands between them is encoded as texts of its own."""
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.encode([text[at:m.start()]], known)[0]
            out.append(self.value([self.special[m.group()]]))
            at = m.end()
        return out + self.encode([text[at:]], known)[0]


class Cut(NamedTuple):
    """Texts cut before every space and line end."""

    pieces: pa.Array    # distinct, without the space they begin with
    places: np.ndarray  # of each piece of the texts in `pieces`
    starts: np.ndarray  # of each text in `places`, and the end; each text has a piece


def cuts(texts: pa.Array) -> Cut:
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    coded = parts.flatten().dictionary_encode()
    starts = parts.offsets.to_numpy().astype(np.int64)
    return Cut(coded.dictionary, coded.indices.to_numpy(), starts - starts[0])


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of texts, each of about `size` bytes or of one text."""
    sizes = pc.binary_length(texts).to_numpy()
    bins = (np.cumsum(sizes) - sizes) // size
    borders = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(texts)]
    for a, b in zip(borders, borders[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def words_of(pieces: pa.Array) -> list[str]:
    """Pieces, none of which holds a space, as a list."""
    if not len(pieces) or pieces.nbytes >= 1 << 30:
        return pieces.to_pylist()
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.cast(pa.string()))
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


def laid_out(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[bytes, list[int]]:
    """`flat` holds values of `sizes` items. The values of `at` one after the other, and the byte where each
    run of `starts` begins (and the end)."""
    lengths = sizes[at]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    narrow = np.int32 if max(upto[-1], len(flat)) < 1 << 31 else np.int64
    where = np.repeat(((np.cumsum(sizes) - sizes)[at] - upto[:-1]).astype(narrow), lengths)
    where += np.arange(upto[-1], dtype=narrow)
    return flat[where].tobytes(), (upto[starts] * flat.itemsize).tolist()


class _Count(int):
    """How many pieces of a text are still to be filled in."""
