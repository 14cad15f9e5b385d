"""Token ids of whole texts, from a tokenizer file, inside Arrow tasks."""

from __future__ import annotations

import os
from collections.abc import Callable

from .base import process_state

#: Distinct chunks, and pieces of them, kept per process; the memory is emptied when it is full, so results never depend on it.
CHUNK_MEMORY = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers; one per process and file.

    White space separates tokens and is dropped by the tokenizer, so a text is the row of its chunks
    between white space, and chunks repeat.  A new chunk is cut by the tokenizer's own pattern, and its
    pieces go to the library's model.  A text with a control character, a letter from U+0250 on, a dotted
    capital I or ``<|`` goes through the library as a whole: there normalising changes lengths, or special
    token strings may occur, which keep the meaning the library gives them.
    """
    kept = process_state()
    if path not in kept:
        kept[path] = _encoder(path)
    return kept[path]


def _encoder(path: str) -> Callable[[str], bytes]:
    import re
    from array import array

    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    # fixed values: the cut pattern of the tokenizer file
    pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
    # bytes that have no printable character of their own stand at 256 and after, in order
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    plain = re.compile("[\t-\r -~\xa1-\u012f\u0131-\u024f]*").fullmatch

    def coded(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    class Pieces(dict):
        def __missing__(self, piece: str) -> bytes:
            if len(self) >= CHUNK_MEMORY:
                self.clear()
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(shifted)
            found = self[piece] = coded([t.id for t in model.tokenize(spelled)])
            return found

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            if len(self) >= CHUNK_MEMORY:
                self.clear()
            if chunk.isalpha():
                found = of_piece(chunk)
            elif chunk[-1] in ".," and chunk[:-1].isalpha():
                found = of_piece(chunk[:-1]) + of_piece(chunk[-1])
            else:
                found = b"".join(map(of_piece, pieces(chunk)))
            self[chunk] = found
            return found

    of_piece, of_chunk = Pieces().__getitem__, Chunks().__getitem__

    def encode(text: str) -> bytes:
        if plain(text) and "<|" not in text:
            return b"".join(map(of_chunk, text.lower().split()))
        return coded(tokenizer.encode(text, add_special_tokens=False).ids)

    return encode
