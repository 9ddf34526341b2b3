"""Token ids of whole texts, by a public tokenizer that lower-cases and drops white space.

Such a tokenizer never lets a token reach across white space, so a text's ids are those of its pieces in order. Pieces
repeat, so their ids are kept in the worker between batches and tasks; the library encodes each new piece once.
"""

from __future__ import annotations

import array
import re
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

SPACE = " \t\n\x0b\x0c\r"
_SPLIT = re.compile(f"[{SPACE}]+")
#: Latin-1, one byte a character: lower case, runs of letters, and runs of all else but white space.
_LOWER = bytes(ord(low) if len(low := chr(i).lower()) == 1 and ord(low) < 256 else i for i in range(256))
_LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_PIECES = re.compile(rb"[" + _LETTERS + rb"]+|[^" + _LETTERS + rb"\x09-\x0d\x20\xa0]+")
#: Contractions, white space that's rare, and special tokens: such texts are cut at white space only.
_OTHER = re.compile(rb"['\x1c-\x1f\x85]|<\|")


def slices(text: str, size: int = 1 << 20):
    """``text`` in parts of about ``size`` characters, cut only where white space begins."""
    at, space = 0, re.compile(f"[{SPACE}]")
    while len(text) - at > size:
        cut = space.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class _Pieces(dict):
    """The ids of pieces met so far. When there are more than ``most``, the later half, rarer pieces, is forgotten."""

    def __init__(self, tokenizer: Tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.letters, self.alphabet = tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, piece) -> bytes:
        if len(self) >= self.most:
            for p in list(self)[self.most // 2 :]:
                del self[p]
        text = piece.decode("latin-1") if isinstance(piece, bytes) else piece
        if isinstance(piece, bytes) and text.isalpha():  # one run of lower-case letters is one word for the model
            word = text if text.isascii() else self.alphabet.pre_tokenize_str(text)[0][0]
            ids = [t.id for t in self.letters(word)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[piece] = found = array.array("I", ids).tobytes()
        return found


class Encoder:
    """``most``: pieces that a worker keeps, about 200 bytes each."""

    def __init__(self, name: str, most: int = 1_000_000):
        self.kept = _Pieces(Tokenizer.from_file(public_tokenizers.path(name)), most)

    @staticmethod
    def pieces(text: str) -> list:
        try:
            if not _OTHER.search(plain := text.encode("latin-1")):
                return _PIECES.findall(plain.translate(_LOWER))
        except UnicodeEncodeError:
            pass
        return [w for w in _SPLIT.split(text) if w]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = [b"".join(map(self.kept.__getitem__, self.pieces(part))) for part in slices(text)]
        return out[0] if len(out) == 1 else b"".join(out)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One for each worker process and tokenizer."""
    return Encoder(name)
