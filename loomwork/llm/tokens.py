"""Exact token counts of a public byte-level BPE vocabulary, counted word by word.

A token of such a vocabulary begins with the one blank before a word or lies within the word, so a
text may be cut before each blank that a non-blank follows, and its count is the sum over the
pieces. Pieces recur: a batch of texts is split and dictionary-encoded in Arrow, the tokenizer sees
each different piece once, and a bounded table keeps what it said. Texts in which a blank is
followed by more white space go through the tokenizer whole. The result equals encoding each text
as a whole; a test holds them against each other.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary's published definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = r" (?:\s|[\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
_KEPT = 500_000
_SLICE = 8 << 20
_SHORT = 5


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT_VOCABULARY):
    """A tokenizer from a file of ranks; once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts and, if ``dims`` (up to 8), a hashed projection of the words of a text."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, dims: int = 0):
        self.encode = encoding(path).encode_ordinary
        self.dims = dims
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.sizes = np.zeros(1 << 16, np.int64)
        self.places = np.zeros((1 << 16, self.dims), np.float32)

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """Table rows of pieces, each of which has a blank before it."""
        if len(self.row) > _KEPT:
            self._reset()
        got = list(map(self.row.get, pieces))
        for i, r in enumerate(got):
            if r is None:
                piece = pieces[i]
                r = got[i] = self.row[piece] = len(self.row)
                if r == len(self.sizes):
                    self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
                    self.places = np.concatenate([self.places, np.zeros_like(self.places)])
                self.sizes[r] = len(self.encode(" " + piece))
                self.places[r] = self._place(piece)
        return np.array(got, np.int64)

    def _place(self, piece: str) -> np.ndarray:
        """Short words are in every text and say little; they have no place."""
        out = np.zeros(self.dims, np.float32)
        for word in piece.split() if self.dims else ():
            if len(word) >= _SHORT:
                out += np.frombuffer(xxhash.xxh3_128_digest(word.lower()), np.int16)[: self.dims] / np.float32(32768)
        return out

    def measure(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, direction of the hashed word vector, each coordinate in -1 .. 1) of each text;
        null texts have no tokens."""
        n = np.zeros(len(texts), np.int64)
        v = np.zeros((len(texts), self.dims))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):  # slices of about _SLICE bytes, one text at least
            limit = (ends[at - 1] if at else 0) + _SLICE
            to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
            n[at:to], v[at:to] = self._slice(texts.slice(at, to - at))
            at = to
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return n, np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        codes = pc.dictionary_encode(lists.flatten())
        rows = self._rows(codes.dictionary.to_pylist())[codes.indices.to_numpy()]
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        n = np.add.reduceat(self.sizes[rows], starts)
        v = np.add.reduceat(self.places[rows], starts, axis=0) if self.dims else np.zeros((len(texts), 0))
        first = rows[starts]
        n -= self.sizes[first]
        names = lists.flatten().take(pa.array(starts)).to_pylist()
        for i, name in enumerate(names):  # a text's first piece has no blank before it
            if odd[i]:
                n[i] = len(self.encode(texts[i].as_py()))
            elif name:
                n[i] += len(self.encode(name))
        return n, v

    def count(self, texts: pa.Array) -> np.ndarray:
        return self.measure(texts)[0]
