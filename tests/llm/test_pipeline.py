"""The stages on the smallest table against plain Python, each on what its predecessor kept."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cellweave.llm import quality, secret_scan
from cellweave.llm.common import written

from .test_ngram_join import components, shingles

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], PATH)))
    return [df.collect() for df in out], [df.columns for df in out]


def test_columns_stay_until_the_last_stage(steps):
    assert all(c == steps[1][0] for c in steps[1][:-1])


def test_rejected_documents_go(spark, steps):
    (before, after, *_), _ = steps
    docs, labels = (spark.read.parquet(f"{PATH}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in after} == good and sorted(after) == sorted(r for r in before if r.doc_id in good)


def test_one_of_each_text_stays(steps):
    before, after = steps[0][1:3]
    largest = {}
    for r in before:
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", -1))
    assert sorted(after) == sorted(r for r in before if largest[r.text or ""] == r.doc_id)


def test_one_of_each_component_stays(steps):
    before, after = steps[0][2:4]
    first = components({r.doc_id: shingles(r.text) for r in before})
    assert sorted(after) == sorted(r for r in before if first[r.doc_id] == r.doc_id)


def test_secrets_are_masked(steps):
    before, after = ({r.doc_id: r for r in rows} for rows in steps[0][3:5])
    assert before.keys() == after.keys()
    for i, r in before.items():
        text = secret_scan.masked(r.text or "")
        assert (after[i].text or "") == text and (after[i].lang, after[i].source) == (r.lang, r.source)
        assert after[i].n_chars == (r.n_chars if text == r.text else len(text)) and not secret_scan.base_spans(text)


def test_all_tokens_are_packed(steps):
    before, packed = steps[0][4:6]
    library, want, total = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in before:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        total += len(ids)
        want += [(r.doc_id, n, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    fill = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-total // 4096) + 2


def test_the_query_runs_the_stages(spark, steps):
    assert sorted(entry.queries()["pipeline"](spark, PATH).collect()) == sorted(steps[0][-1])


def test_empty_and_awkward_tables(spark, awkward, nothing):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (awkward.select(plain), nothing.select(plain)):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, PATH))
    assert docs.count() == 0
