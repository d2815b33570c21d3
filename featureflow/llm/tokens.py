"""Token ids of whole texts by the tokenizers library, with a word cache.

A byte-level BPE with the usual pre-tokenizer never joins anything across a
space that stands before a non-space, nor across a newline between two
non-spaces.  Texts are therefore cut there; the ids of each piece are cached,
and a piece that is not cached goes to the library: to its model, if it is one
word of Latin letters with or without marks after it, else to ``encode``.  The
ids equal those of one ``encode`` call on the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from string import punctuation

import numpy as np

#: Cached pieces; beyond this longer ones are dropped (memory stays bounded).
CACHE_PIECES = 600_000
SHORT = 8
#: Characters of a text that are cut into pieces at once.
CHUNK = 1 << 22
#: Words of letters below this character are cut into pre-tokens here.
LATIN_END = "ɐ"

_BOUNDARY = re.compile(r"(?= \S)")


def byte_symbols() -> dict[int, str]:
    """Characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the other bytes from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Pieces(dict):
    """Ids by piece, learned when first asked for.  ``x`` stands for " x",
    "\\nx" for itself, and "\\rx" for "x" (the beginning of a text)."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model_tokens = tokenizer.model.tokenize
        self.symbols = byte_symbols()
        self.space = self.symbols[ord(" ")]
        self.newline = self.whole("\n")
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        lead = piece[0]
        word = piece[1:] if lead == "\n" else piece
        letters = word.rstrip(punctuation)
        if not letters.isalpha() or not (letters.isascii() or max(letters) < LATIN_END):
            ids = self.whole(piece if lead == "\n" else piece[1:] if lead == "\r" else " " + piece)
        elif len(letters) < len(word):
            # A letter and a mark are never in one pre-token; marks are one.
            tail = word[len(letters):]
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            ids = self[piece[:len(piece) - len(tail)]] + self.tails[tail]
        else:
            symbols = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.symbols)
            if lead != "\n":
                symbols = self.space + symbols
            ids = array("I", [t.id for t in self.model_tokens(symbols)]).tobytes()
            if lead == "\n":
                ids = self.newline + ids
        self[piece] = ids
        return ids

    def shrink(self) -> None:
        """Short pieces are the frequent ones: they stay, if they are few."""
        short = {p: ids for p, ids in self.items() if len(p) <= SHORT}
        self.clear()
        self.tails.clear()
        if 2 * len(short) < CACHE_PIECES:
            self.update(short)


class Encoder:
    """``encode(texts)`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, chunk: int = CHUNK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_pieces, self.chunk = cache_pieces, chunk
        self.pieces = _Pieces(self.tokenizer)
        whole, newline = self.pieces.whole, self.pieces.newline
        if len(newline) != 4 or whole(" a!\nb\n c") != b"".join(map(whole, (" a", "!", "\n", "b", "\n", " c"))):
            raise ValueError(f"{path} is not a byte-level vocabulary with a newline token")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t) if t else b"" for t in texts]

    def encode_one(self, text: str) -> bytes:
        if len(text) <= self.chunk:
            return self._part(text, True)
        # A very long text in parts, each after the first beginning with " x".
        out, at = [], 0
        while at < len(text):
            cut = _BOUNDARY.search(text, at + self.chunk)
            end = cut.start() if cut else len(text)
            out.append(self._part(text[at:end], at == 0))
            at = end
        return b"".join(out)

    def _part(self, text: str, begins: bool) -> bytes:
        """Ids of a text, or of a part of one that begins with " x"."""
        if len(self.pieces) > self.cache_pieces:
            self.pieces.shrink()
        get = self.pieces.__getitem__
        body = text if begins else text[1:]
        flat = body.replace("\n", " ")
        # Regular: every white space is one space or newline between others.
        if flat[0] == " " or flat[-1] == " " or "  " in flat or not flat.isprintable():
            first, *rest = _BOUNDARY.split(body)
            return get("\r" + first if begins else first) + b"".join([get(p[1:]) for p in rest])
        if not begins:
            return b"".join(map(get, body.replace("\n", " \n").split(" ")))
        pieces = ("\n" + body).replace("\n", " \n").split(" ")
        del pieces[0]
        return b"".join(map(get, pieces))[4:]  # without the newline put before the text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
