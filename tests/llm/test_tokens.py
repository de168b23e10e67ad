import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cellweave.llm import best_fit, byte_bpe, packed_ids, queries, token_counts
from cellweave.llm.token_ids import ChunkIds

from .conftest import awkward_texts

WORDS = P.path("word_bpe_49k.json")
MORE = ["<|ENDOFTEXT|>.", "İSTANBUL ΣΑΣ. ΣΑΣ", "it's. can't!? _a._ x².", "x" * 500, "  " * 40, "<0x0A>", "a\x00b", "▁▁a ▁", " x", "\n\n \n x\t y  ", "naïve ÀÉ. Ünß!", "e\u0301 \u0301", "don't  DON'T", "9" * 50]


def test_byte_bpe_equals_the_library(awkward):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = awkward.collect()
    got = sorted((tuple(r) for r in byte_bpe.encode_decode(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=repr)
    want = []
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("size", [1, 7, 100])
def test_cutting_at_safe_boundaries_changes_no_id(size):
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in [t[:3000] for t in awkward_texts() if t] + MORE:
        assert "".join(byte_bpe.parts(text, size)) == text
        assert [i for p in byte_bpe.parts(text, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_counts_equal_the_library(awkward):
    library = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = sorted((tuple(r) for r in token_counts.count_tokens(awkward, P.path("piece_bpe_32k.model")).collect()), key=repr)
    n = {r.text: len(library.encode(r.text or "")) for r in awkward.collect()}
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), n[r.text], n[r.text] > 4096) for r in awkward.collect()), key=repr)


def test_counts_do_not_depend_on_chunks_or_forgetting(monkeypatch):
    library, counter = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), token_counts.Transducer(P.path("piece_bpe_32k.model"))
    texts = [t[:4000] for t in awkward_texts() if t] + MORE
    want = [len(library.encode(t)) for t in texts]
    assert [counter.count(t) for t in texts] == want
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 5)
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 50)
    assert [counter.count(t) for t in texts] == want


def test_chunk_ids_equal_the_library():
    library, ids = Tokenizer.from_file(WORDS), ChunkIds(WORDS)
    for text in [t[:5000] for t in awkward_texts() if t] + MORE:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def documents(rows):
    library = Tokenizer.from_file(WORDS)
    return [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in rows]


def test_packing_is_lossless_gapless_and_tight(awkward):
    got = best_fit.pack(awkward, WORDS).collect()
    pieces = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr)
    want = [(i, n, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes()))
            for i, ids in documents(awkward.collect()) for n, at in enumerate(range(0, len(ids), 4096))]
    assert pieces == sorted(want, key=repr)
    sequences = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096 and len(sequences) <= -(-sum(len(x) for _, x in documents(awkward.collect())) // 4096) + 1


@pytest.mark.parametrize("counts", [{1: 10_000}, {4096: 3, 1: 1}, {2049: 7, 2047: 5, 1024: 9, 3: 100}, {1365: 10, 1366: 10, 1367: 1}, {}])
def test_sweep_places_each_rank_once(counts):
    plan = best_fit.sweep(counts)
    ranks, room = {}, {}
    for length, rank, n, first, offset in zip(*(plan[c].tolist() for c in ("length", "rank_from", "count", "sequence_from", "offset")), strict=True):
        for k in range(n):
            ranks.setdefault(length, []).append(rank + k)
            room.setdefault(first + k, []).append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == counts and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    for held in room.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(room) <= -(-sum(k * v for k, v in counts.items()) // 4096) * 1.25 + 1


def test_sweep_runs_do_not_grow_with_the_documents():
    rng = np.random.default_rng(5)
    lengths, n = np.unique(np.minimum(4096, rng.lognormal(6, 1, 50_000).astype(int) + 1), return_counts=True)
    small, large = (len(best_fit.sweep(dict(zip(lengths.tolist(), (n * k).tolist(), strict=True)))["length"]) for k in (10, 10_000))
    assert large < 1.5 * small


def test_packed_matrices_round_trip(spark, awkward, tmp_path):
    packed_ids.write_packed(packed_ids.pack_matrices(awkward, WORDS, block_tokens=9000), str(tmp_path / "packed"))
    rows, found = spark.read.parquet(str(tmp_path / "packed")).collect(), []
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 4096 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens:].any()
        for a, b, doc_id, start in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.doc_ids, r.starts, strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            found.append((doc_id, start, ids[a:b].tolist()))
    want = [(i, at, ids[at:at + 4096]) for i, ids in documents(awkward.collect()) for at in range(0, len(ids), 4096)]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_op5_rows_come_from_stored_matrices(spark, monkeypatch):
    written, write = [], packed_ids.write_packed
    monkeypatch.setattr(packed_ids, "write_packed", lambda packed, path: (written.append(path), write(packed, path)))
    rows = {r.sequence_id: r for r in queries.QUERIES["op5_packed_ids"](spark, "/root/testdata/sf0.001").collect()}
    (path,), seen = written, 0
    for m in spark.read.parquet(path).collect():
        r, seen = rows[m.sequence_id], seen + 1
        assert (r.ids_crc32, r.positions_crc32, r.cu_seqlens) == (zlib.crc32(m.input_ids), zlib.crc32(m.position_ids), m.cu_seqlens)
    assert seen == len(rows) > 0


def test_segment_tree_takes_the_smallest_room():
    rng, capacity = np.random.default_rng(1), 97
    lengths = rng.integers(1, capacity + 1, 500).tolist()
    room, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [k for k, left in enumerate(room) if left >= lengths[i]]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= lengths[i]
        else:
            room.append(capacity - lengths[i])
    got = packed_ids.best_fit_decreasing(lengths, capacity)
    assert sorted(i for s in got for i in s) == list(range(len(lengths))) and len(got) == len(room)
    assert all(sum(lengths[i] for i in s) <= capacity for s in got)


def test_empty_tables(nothing):
    assert byte_bpe.encode_decode(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert token_counts.count_tokens(nothing, P.path("piece_bpe_32k.model")).count() == 0
    assert best_fit.pack(nothing, WORDS).count() == 0 and packed_ids.pack_matrices(nothing, WORDS).count() == 0
