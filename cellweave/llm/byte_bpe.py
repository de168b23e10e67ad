"""Byte-level BPE through tiktoken with a local rank file."""
from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: A text longer than this is encoded in parts that end at safe boundaries.
PART_CHARS = 1 << 16
#: Between a character that is no white space and one blank before another: no match of the split pattern crosses it.
SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: lines of base64 bytes and rank; no special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of about ``size`` characters; a run without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc: tiktoken.Encoding) -> list[int]:
    """Token ids of a whole text, the same as in one call of the library."""
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    """The raw bytes of ids; they need not be whole UTF-8 characters."""
    return enc.decode_bytes(ids)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, through ids and back.

    Null and empty texts have no tokens. Rows are independent of each other, repeats give repeats, other columns
    are ignored. The rank file must be readable at ``path`` on every worker.
    """
    def work(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for value in batch["text"]:
                ids = encode(value.as_py() or "", enc)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(repr(ids)[1:-1].replace(",", "").encode()).hexdigest())
                text_hash.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_batches(texts_of(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
