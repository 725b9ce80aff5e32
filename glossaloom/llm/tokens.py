"""Token ids of whole texts with a public tokenizer file, fast enough for a corpus.

Two ways give the same ids. For tokenizers that turn white space into spaces, lower-case, keep letters apart from
punctuation and run byte-level BPE on each such word, a text is cut at its spaces and each piece is encoded by the
tokenizers library once and then kept, since the ids of a text are those of its pieces, in order. A probe text decides
whether a tokenizer is of that kind; for any other, whole texts are encoded.
"""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

#: Pieces kept in a Python worker, and the longest piece kept, in characters.
KEPT_PIECES, LONGEST_KEPT = 700_000, 40
#: Below this character (Latin letters with their precomposed accents) Python and the tokenizer lower-case alike.
_SIMPLE_BELOW = "İ"
_PROBE = "The Écoles,  don't re-use it's ß_x 12,3 (a).b, Straße.\nÑandú's  co-op, end.  A.B, «q» é <|x|> \t  z"

_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes bytes that aren't printable as the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


class _Known(dict):
    """Ids by piece; what is missing is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__({"": b""})
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < KEPT_PIECES and len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.letters = _byte_letters()
        self.known = _Known(self._piece)
        self.by_word = True
        try:
            self.tail = {c: self._whole([c])[0] for c in ",."}
            self.by_word = self.encode([_PROBE, "", _PROBE]) == self._whole([_PROBE, "", _PROBE])
        except Exception:  # a model of another kind
            self.by_word = False

    def _ids(self, ids: list[int]) -> bytes:
        ids = array(self.code, ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without spaces. A last comma or full stop after letters is a token of its own; a word of simple lower-case letters goes to the model alone."""
        last = self.tail.get(piece[-1])
        if last is not None and len(piece) > 1 and piece[-2].isalpha() and piece[-2] < _SIMPLE_BELOW:
            return self.known[piece[:-1]] + last
        if piece.isascii():
            if piece.isalpha():
                word = piece.lower()
                return self._ids([t.id for t in self.tokenizer.model.tokenize(word)]) if word == piece else self.known[word]
        elif piece.isalpha() and max(piece) < _SIMPLE_BELOW:
            word = piece.lower()
            return self._ids([t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]) if word == piece else self.known[word]
        return self._whole([piece])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids (self.dtype) of each text; a null text is empty."""
        if not self.by_word:
            return self._whole([t or "" for t in texts])
        get, found = self.known.__getitem__, []
        for t in texts:
            if not t:
                found.append(b"")
                continue
            if t.isascii() and "<|" not in t:  # special tokens are matched as they are written
                t = t.lower()
            found.append(b"".join(map(get, t.replace("\n", " ").split(" "))))
        return found
