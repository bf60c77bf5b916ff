"""Token ids of texts by the tokenizers library, with a cache of what stands between blanks.

A cut before a blank or a single line break between other characters is a place where the pre-tokenizers
used here always cut too, and so is one between a letter and a mark of punctuation that ends a piece.
The ids of the pieces, one after another, are then those of the text. Texts to which this doesn't
apply (wider white space, control strings) are encoded whole.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

#: Entries of the younger of the cache's two generations, and characters up to which a piece is kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 40
_WIDE = re.compile(r"\s |\s\n")
_MARKS = ".,;:!?"
#: Beyond these letters, what a letter is, its lower case and its composed form may depend on the library or on context.
_OTHER = re.compile("[^\\x00-\u012f\u0131-\u024f]")
#: How the byte-level models write bytes as characters: printable ones as they are, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids by piece. A piece that isn't there is looked up in the older generation, or else encoded."""

    def __init__(self, tokenizer: Tokenizer, glue: bool, older: dict[str, bytes]):
        self.tokenizer, self.glue, self.older = tokenizer, glue, older
        self.model, self.marks = tokenizer.model.tokenize, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids

    def _encode(self, piece: str) -> bytes:
        if not _OTHER.search(piece):
            if piece.isalpha():
                return self._word(" " + piece if self.glue else piece.lower())
            if piece[:1] == "\n" and piece[1:].isalpha():
                return self._mark("\n") + self._word(piece[1:])
            stem = piece.rstrip(_MARKS)
            if stem and len(stem) < len(piece) and stem[-1].isalpha():
                return self[stem] + self._mark(piece[len(stem) :])
        return self.whole(piece if not self.glue or piece[:1] == "\n" else " " + piece)

    def _word(self, letters: str) -> bytes:
        """Letters are one word for the pre-tokenizers, so they go straight to the model."""
        return array("I", [t.id for t in self.model(letters.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 1000:
                self.marks.clear()
            self.marks[marks] = self.whole(marks)
        return self.marks[marks]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """encode_all(texts): ids as little-endian unsigned 32-bit integers.

    glue: pieces keep the blank before them (byte-level BPE); else white space has no ids, nor has case.
    """

    def __init__(self, path: str, glue: bool):
        self.tokenizer, self.glue = Tokenizer.from_file(path), glue
        self.cache = _Pieces(self.tokenizer, glue, {})

    def whole(self, text: str) -> bytes:
        return self.cache.whole(text)

    def encode(self, text: str) -> bytes:
        if "<|" in text or self.glue and _WIDE.search(text):
            return self.whole(text)
        if self.glue:  # what follows a line break has the break in its piece, all but the first follow a blank
            first, *pieces = text.replace("\n", " \n").split(" ")
            head = self.whole(first) if first else b""
        else:
            if not _OTHER.search(text):
                text = text.lower()
            head, pieces = b"", text.replace("\n", " ").split(" ")
        return head + b"".join(map(self.cache.__getitem__, pieces))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out = list(map(self.encode, texts))
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = _Pieces(self.tokenizer, self.glue, dict(self.cache))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, glue: bool) -> Encoder:
    """One encoder for each worker process and file."""
    if (path, glue) not in _encoders:
        _encoders[path, glue] = Encoder(path, glue)
    return _encoders[path, glue]
