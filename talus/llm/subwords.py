"""Subword ids of whole texts, with a word cache in each Python worker.

The tokenizer's rules never look across white space: its normaliser composes
characters, folds white space and lower-cases, and its pre-tokenizer drops
white space. So a text's ids are those of its pieces between ASCII white space,
in order, and each distinct piece is encoded once for as long as it stays
cached. As the normaliser lower-cases, A-Z are so before the look-up, but not in
texts where that could change an id: with combining marks (a small letter may
compose with one where a capital does not) or the strings of special tokens.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached pieces in one worker; the cache starts anew when it is full.
CACHE_PIECES = 200_000
#: Cached ids for each of these pieces, at most: long pieces fill the cache sooner.
PIECE_IDS = 16
#: Pieces encoded as one string, with a mark after each.
JOINED = 100
_MARK = "\x01"
_SPECIAL = "<|"
_WORD_END = "</w>"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Punctuation that may follow a word's letters.
_TAIL = b'.,;:!?$%&*#"()-'


def _letters(text: str) -> bool:
    """Whether the text is letters and stays so in lower case and composed form (else a mark could join what follows)."""
    return text.isalpha() and (text.isascii() or unicodedata.is_normalized("NFC", text) and text.lower().isalpha())


def _ascii_lower(text: bytes) -> bytes:
    """A-Z in lower case unless that could change ids. The lead bytes of U+0300 to U+036F stand for combining marks."""
    return text if b"\xcc" in text or b"\xcd" in text or _SPECIAL.encode() in text else text.lower()


class _Codes(dict):
    """Codes of pieces in order of first sight; what is new since the last encoding is in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class WordEncoder:
    """Encodes lists of texts to one flat array of ids and the texts' offsets in it."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self._cache_pieces = cache_pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        mark = self._ids(_MARK)
        self._mark = mark[0] if len(mark) == 1 else None
        vocabulary = self._tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self._ends = ends if ends.any() else None
        rules = self._tokenizer.normalizer
        self._bare = Tokenizer.from_file(path)  # for lower-case ASCII letters, which the normaliser leaves alone
        if rules is None or rules.normalize_str(_ALPHABET) == _ALPHABET:
            self._bare.normalizer = None
        self._reset()

    def forget(self) -> None:
        """Drop the cached pieces, so that a worker's later tasks have their memory."""
        self._reset()

    def _ids(self, piece: str) -> list[int]:
        return self._tokenizer.encode(piece, add_special_tokens=False).ids

    def _batch(self, texts: list[str], bare: bool = False) -> list:
        return (self._bare if bare else self._tokenizer).encode_batch_fast(texts, add_special_tokens=False) if texts else []

    def _reset(self) -> None:
        self._code = _Codes()
        self._starts = np.zeros(1024, np.int64)
        self._lens = np.zeros(1024, np.int64)
        self._flat = np.zeros(8192, np.int32)
        self._n, self._used = 0, 0

    def _add(self, at: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Ids of the pieces with these codes, one after another."""
        used = self._used + len(ids)
        if used > len(self._flat):
            self._flat = np.resize(self._flat, max(2 * len(self._flat), used))
        self._lens[at] = lens
        self._starts[at] = self._used + np.cumsum(lens) - lens
        self._flat[self._used : used] = ids
        self._used = used

    def _learn(self) -> None:
        """Encode the new pieces, many in one call.

        Letters with punctuation after them are looked up apart, as the pre-tokenizer
        parts them. A word of letters alone ends in the only id with the word end's
        suffix, which parts such words again; in lower-case ASCII it needs no normaliser.
        Other pieces get a mark after each.
        """
        new, code = self._code.new, self._code
        first, tail = self._n, _TAIL.decode()
        bare, plain, rest, joint, pieces = [], [], [], [], []
        while len(pieces) < len(new):  # grows by heads and tails
            at, some = len(pieces), [p.decode(errors="replace") for p in new[len(pieces) :]]
            pieces += some
            whole = pa.array(some, pa.string())
            heads = pc.ascii_rtrim(whole, characters=tail)
            cut, ascii_head = (np.asarray(x) for x in (pc.not_equal(heads, whole), pc.string_is_ascii(heads)))
            low = np.asarray(pc.ascii_is_lower(heads))
            letters = np.asarray(pc.ascii_is_alpha(heads))
            other = np.flatnonzero(~ascii_head)
            letters[other] = [_letters(some[i].rstrip(tail)) for i in other.tolist()]
            letters &= self._ends is not None
            rest += (at + np.flatnonzero(~letters)).tolist()
            bare += (at + np.flatnonzero(letters & ~cut & low & ascii_head)).tolist()
            plain += (at + np.flatnonzero(letters & ~cut & ~(low & ascii_head))).tolist()
            parted = np.flatnonzero(letters & cut)
            sizes = pc.binary_length(heads).to_numpy()[parted].tolist()
            for i, size in zip((at + parted).tolist(), sizes, strict=True):
                piece = new[i]
                joint += (first + i, code[piece[:size]], code[piece[size:]])
        new.clear()
        self._n += len(pieces)
        if self._n > len(self._lens):
            self._starts, self._lens = (np.resize(x, max(2 * len(x), self._n)) for x in (self._starts, self._lens))
        for kind in (bare, plain):
            groups = [kind[i : i + JOINED] for i in range(0, len(kind), JOINED)]
            for at in range(0, len(groups), 20):
                some = groups[at : at + 20]
                for group, got in zip(some, self._batch([" ".join([pieces[i] for i in g]) for g in some], kind is bare), strict=True):
                    ids = np.array(got.ids, np.int32)
                    ends = np.flatnonzero(self._ends[ids])
                    if len(ends) == len(group):  # no word has fewer, so each has one
                        self._add(first + np.array(group), ids, np.diff(ends, prepend=-1))
                    else:
                        rest += group
        groups = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        for at in range(0, len(groups), 20):
            some = groups[at : at + 20]
            joined = [f" {_MARK} ".join([*(pieces[i] for i in g), ""]) for g in some]
            marked = [self._mark is not None and _SPECIAL not in j and j.count(_MARK) == len(g) for g, j in zip(some, joined, strict=True)]
            got = iter(self._batch([j for j, m in zip(joined, marked, strict=True) if m]))
            for group, is_marked in zip(some, marked, strict=True):
                where = first + np.array(group)
                if is_marked:
                    ids = np.array(next(got).ids, np.int32)
                    ends = np.flatnonzero(ids == self._mark)
                    if len(ends) == len(group):
                        self._add(where, ids[ids != self._mark], np.diff(ends, prepend=-1) - 1)
                        continue
                for i, p in zip(where.tolist(), group, strict=True):  # a mark's id or a special token's string inside a piece
                    ids = np.array(self._ids(pieces[p]), np.int32)
                    self._add(np.array([i]), ids, np.array([len(ids)], np.int64))
        if joint:
            whole, parts = np.array(joint).reshape(-1, 3)[:, 0], np.array(joint).reshape(-1, 3)[:, 1:]
            self._add(whole, self._expanded(parts.ravel()), self._lens[parts].sum(1))

    def _expanded(self, codes: np.ndarray) -> np.ndarray:
        """The ids of the pieces with these codes, one after another."""
        lens = self._lens[codes]
        ends = np.cumsum(lens)
        return self._flat[np.repeat(self._starts[codes] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes: in UTF-8) one after another (int32), and n + 1 offsets. Null is as empty."""
        pieces: list[bytes] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                pieces += _ascii_lower(t.encode() if isinstance(t, str) else t).split()
            counts[i + 1] = len(pieces)
        return self._gathered(pieces, counts)

    def encode_words(self, words: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of texts without ASCII white space: each is one cached piece."""
        return self._gathered([w.encode() if isinstance(w, str) else w for w in words], np.arange(len(words) + 1))

    def _gathered(self, pieces: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and offsets at these numbers of pieces."""
        if len(self._code) > self._cache_pieces or self._used > PIECE_IDS * self._cache_pieces:
            self._reset()
        try:
            codes = np.fromiter(map(self._code.__getitem__, pieces), np.int64, len(pieces))
            if self._code.new:
                self._learn()
        except BaseException:  # a worker serves further tasks: no code may stay without its ids
            self._reset()
            raise
        ends = np.cumsum(self._lens[codes])
        ids = self._expanded(codes)
        if len(self._code) > 2 * self._cache_pieces:
            self._reset()
        return ids, np.concatenate([[0], ends])[counts]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if (path, cache_pieces) not in _encoders:
        _encoders[path, cache_pieces] = WordEncoder(path, cache_pieces)
    return _encoders[path, cache_pieces]


def text_chunks(column: pa.Array, size: int = 500_000):
    """(a, b, texts a to b as bytes) of a text column, about so many bytes at a time, one text at least: no copy of a whole batch."""
    raw = column.cast(pa.binary())
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy().astype(np.int64) + 1)])
    a = 0
    while a < len(raw):
        b = max(a + 1, int(np.searchsorted(before, before[a] + size, "right")) - 1)
        yield a, b, raw.slice(a, b - a).to_pylist()
        a = b


def in_chunks(texts: list[str | None], chars: int = 2_000_000):
    """Ranges of texts of about so many characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield at, i
            at, size = i, 0
        size += len(t or "") + 1
    if at < len(texts):
        yield at, len(texts)
