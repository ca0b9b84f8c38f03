"""Token ids of whole texts from public vocabulary files, inside tasks.

:class:`ByteLevel` reads a byte-level BPE file of the tokenizers library and
encodes with tiktoken's merge loop: the same ids (tests) at a quarter of the
time.  :class:`Piece` reads a sentencepiece BPE model with byte fallback.  Both
are small objects of a fixed size that go to the tasks with the closure; the
encoder itself is made once per worker.

A long text is encoded in slices of about ``SLICE`` characters, cut before a
single space between two word characters.  No token of either kind reaches over
such a place, so the ids are those of the whole text, and memory follows the
longest run without one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .bpe_trie import Vocabulary

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How a sentencepiece vocabulary writes a space and a byte.
SPACE_MARK, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")

SLICE = 1 << 18
_CUT = re.compile(r"(?<=\w) (?=\w)")
_encoders: dict = {}  # of this worker


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices; all but the first begin with a space."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class ByteLevel:
    """A byte-level BPE vocabulary whose ids rise with the merges."""

    def __init__(self, path: str):
        v = Vocabulary(path)
        made = [token for _, token in sorted(v.merge.values())]
        if made != sorted(made) or len(v.id_of) != len(made) + 256:
            raise ValueError(f"{path}: ids do not rise with the merges")
        self.digest, self.id_of, self.special = v.digest, v.id_of, v.special

    def encode(self, text: str, special: bool = True) -> list[int]:
        """Ids of the text; ``special``: strings of special tokens become
        those tokens, else they are plain text."""
        import tiktoken

        if self.digest not in _encoders:
            _encoders[self.digest] = tiktoken.Encoding(
                "file", pat_str=PATTERN, mergeable_ranks=self.id_of, special_tokens=self.special)
        encoder = _encoders[self.digest]
        one = (lambda s: encoder.encode(s, allowed_special="all")) if special else encoder.encode_ordinary
        if len(text) <= SLICE:
            return one(text)
        return [i for part in slices(text) for i in one(part)]

    def token_bytes(self) -> list[bytes]:
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        out = [b""] * size
        for b, i in self.id_of.items():
            out[i] = b
        for s, i in self.special.items():
            out[i] = s.encode()
        return out


class Piece:
    """A sentencepiece model that puts a space before a text and has no piece
    with a space after another character."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = f.read()
        marks = [p.lstrip(SPACE_MARK) for p in map(self._load().id_to_piece, range(self._load().get_piece_size()))]
        if any(SPACE_MARK in p for p in marks):
            raise ValueError(f"{path}: a piece has a space inside")

    def _load(self):
        import sentencepiece

        key = hash(self.model)
        if key not in _encoders:
            _encoders[key] = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return _encoders[key]

    def encode(self, text: str) -> list[int]:
        encoder = self._load()
        if len(text) <= SLICE:
            return encoder.encode(text, num_threads=1)
        # every slice gets the space that it is cut before
        parts = (part[1:] if k else part for k, part in enumerate(slices(text)))
        return [i for part in parts for i in encoder.encode(part, num_threads=1)]

    def token_bytes(self) -> list[bytes]:
        encoder = self._load()
        out = []
        for i in range(encoder.get_piece_size()):
            piece = encoder.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece)
            out.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode())
        return out
