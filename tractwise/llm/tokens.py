"""Token ids of whole texts with a published vocabulary file, for use inside Spark tasks."""

from __future__ import annotations

import re
import sys
import types
from array import array

import numpy as np

# The white space of Unicode, and the pattern that the byte-level vocabulary splits texts by.
WHITE = " \t\n\r\x0b\x0c\x85\xa0  -     　"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO = 600_000  # entries of each memo of a worker
LONGEST = 64  # characters of a remembered string


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """A bounded memo: beyond the bound, values are computed again."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < MEMO and len(key) <= LONGEST:
            self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned integers of the smallest width (2 or 4 bytes) for the vocabulary.

    Byte-level files without a normaliser are split by their published pattern first, and every
    piece goes to the library's merge model once per worker: a piece's ids depend on nothing
    outside it, and no piece runs over the border between a character and a following space. All
    other files, and texts that hold one of the vocabulary's added tokens, go through the
    library's own pre-tokeniser whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 65536 else 4
        self._code = "H" if self.width == 2 else "I"
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = repr(self.tokenizer.pre_tokenizer)
        self._split = (self.tokenizer.normalizer is None and kind.startswith("ByteLevel(")
                       and "add_prefix_space=False" in kind and "use_regex=True" in kind)
        if self._split:
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(shown)]
            table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
            self._table = {b: c for b, c in table.items() if chr(b) != c}
            self._space = table[32]
            self._words = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
            self._pieces = regex.compile(SPLIT).findall
            self._piece = _Memo(self._merge)
            self._word = _Memo(self._join)
            # what follows a space; None where the space may belong to a longer run of white space
            self._spaced = _Memo(lambda rest: self._join(" " + rest) if rest and rest == rest.strip() else None)

    def _pack(self, ids) -> bytes:
        packed = array(self._code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _merge(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():
            shown = self._space + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self._table)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _join(self, word: str) -> bytes:
        if word[:1] == " " and word[1:].isalpha():
            return self._merge(word)
        return b"".join(map(self._piece.__getitem__, self._pieces(word)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._split or any(a in text for a in self._added):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        try:
            if first and first == first.strip():
                return self._word[first] + b"".join(map(self._spaced.__getitem__, rest))
        except TypeError:  # some spaces stand together or beside other white space
            pass
        return b"".join(map(self._word.__getitem__, self._words.findall(text)))

    def pack(self, token: int) -> bytes:
        return self._pack([token])


def worker_encoder(path: str) -> Encoder:
    """One encoder, with its memos, per Python worker: workers serve many tasks."""
    kept = sys.modules.setdefault("_worker_encoders", types.ModuleType("_worker_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def wide(ids: bytes, width: int) -> np.ndarray:
    """Unsigned 32-bit ids."""
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")
