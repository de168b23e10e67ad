"""Token ids of whole texts by the word-level tokenizer, through a bounded cache of white-space-free chunks."""
from __future__ import annotations

import functools
import re

import numpy as np
from tokenizers import Tokenizer

ID = np.dtype("<u4")
#: Chunks kept per worker; the cache is emptied beyond that, which changes no result.
CACHE_CHUNKS = 900_000
CACHE_CHARS = 40
#: The white space of the tokenizer's normaliser; str.split() also takes these four for white space.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Beyond this, composing marks or context may come between lower-casing and normalisation.
_BEYOND = re.compile("[ƀ-\U0010ffff]")
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([.,;:!?]+)")


#: The printable stand-ins of byte-level vocabularies: visible Latin-1 characters for themselves, the others from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_IN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}


class ChunkIds(dict):
    """Ids (bytes of little-endian uint32) of a chunk without white space, by the library on first sight.

    Sound because the tokenizer drops white space and none of its steps looks across it; letters and the marks
    after them are separate units of its split pattern, and lower-case Latin letters pass its normaliser as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        if chunk.isalpha() and not _BEYOND.search(chunk) and chunk == chunk.lower():
            unit = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_STAND_IN)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(unit)], dtype=ID).tobytes()
        elif both := _WORD_AND_MARKS.fullmatch(chunk):
            ids = self[both[1]] + self[both[2]]
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype=ID).tobytes()
        if len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        """The ids of a whole text; empty for an empty one. Special strings inside are the library's special tokens."""
        if "<|" not in text and (text.isascii() or not _BEYOND.search(text)):
            text = text.lower()
        chunks = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, filter(None, chunks)))


@functools.lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)
