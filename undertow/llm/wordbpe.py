"""A word-level BPE tokenizer read from a public tokenizer file, for the operators that encode or count.

Texts are cut at special strings, normalised, and split into pre-tokens. Each short pre-token is merged in a
contiguous rank array: its parts and the ranks of adjacent pairs are two plain lists, the smallest rank is found by
scanning, one boundary is deleted and the two neighbouring ranks are looked up anew. Pre-tokens above SHORT parts
use a heap of candidate merges instead, which gives the same merges without the quadratic scan.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import unicodedata
from functools import cache

import numpy as np

NO_RANK = 1 << 60
SHORT = 256
#: Characters for which normalising is lower-casing, and which FAST_WORDS splits as the library does.
_LETTERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_OTHER_LETTERS = re.compile("[^\x00-ſ‐-‧€]")
_WORDS = re.compile(
    "[{0}]+|'(?:s|t|re|ve|m|ll|d)|[{1}]|[^{2}{0}{1}]+".format(*(re.escape(x) for x in (_LETTERS, _NUMBERS, _SPACES)))
)


class Memo(dict):
    """Values of ``f``, for a bounded number of recent keys: full, it keeps one older generation."""

    def __init__(self, f, limit: int) -> None:
        super().__init__()
        self.f, self.limit, self.old = f, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    def __init__(self, path: str, memo: int = 150_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: not a BPE vocabulary with word ends")
        self.library = Tokenizer.from_file(path)
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + end] for c in chars]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank[vocab[left], vocab[right]] = len(self.made)
            self.made.append(vocab[left + right])
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that match more or less than their text aren't supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=lambda t: (-len(t), t))
        self._cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self._mark = os.path.commonprefix(longest_first)  # texts without it have no special string
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[str] = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.packed = Memo(lambda w: struct.pack(f"<{len(p := self.parts(w))}I", *p), memo)

    def pieces(self, text: str) -> list[str]:
        """``text`` cut at special strings; these are the odd elements."""
        return self._cut.split(text) if self._cut and self._mark in text else [text]

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if _OTHER_LETTERS.search(piece) is None:
            return _WORDS.findall(piece.lower())
        back = _char_bytes()
        normal = self.library.normalizer.normalize_str(piece)
        return [bytes(back[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]]
        parts.append(self.last[raw[-1]])
        if len(parts) > SHORT:
            return self._long(parts)
        rank, made = self.rank, self.made
        ranks = [rank.get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        packed = self.packed.__getitem__
        out = []
        for k, piece in enumerate(self.pieces(text)):
            if k % 2:
                out.append(struct.pack("<I", self.special[piece]))
            else:
                out.extend(map(packed, self.words(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, special ones included; this vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@cache
def _char_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(_byte_chars())}


@cache
def load(path: str) -> WordBpe:
    """One tokenizer per worker process and file."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
