"""The queries' digest columns against loops over the libraries."""

import base64
import hashlib
import struct
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tracewright.llm import catalog


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    docs.dropDuplicates(["doc_id"]).write.parquet(str(place / "documents.parquet"))
    return str(place)


@pytest.fixture(scope="module")
def texts(corpus):
    return {r[0]: r[1] or "" for r in corpus}


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_packing(spark, folder, texts):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    rows = catalog.op1_packing(spark, folder).collect()
    for r in rows:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert (len(own), r.doc_tokens, r.ids_crc32) == (r.length, len(want[r.doc_id]), zlib.crc32(packed(own)))
    assert sum(r.length for r in rows) == sum(map(len, want.values()))


def test_bpe(spark, folder, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = catalog.op4_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_line_dedup(spark, folder, texts):
    for r in catalog.op2_line_dedup(spark, folder).collect():
        assert r.chars_before == len(texts[r.doc_id]) and r.chars_removed == r.chars_before - len(r.text or "")


def test_quality_and_near_duplicates_return_every_document(spark, folder, texts):
    quality = catalog.op8_quality(spark, folder).collect()
    assert {r.doc_id for r in quality} == set(texts) and all(not r.kept for r in quality if r.base_failed)
    near = catalog.op10_near_duplicates(spark, folder).collect()
    assert {r.doc_id for r in near} == set(texts) and all(r.kept == (r.component_id == r.doc_id) for r in near)


def test_licenses(spark, folder, texts):
    for r in catalog.op5_licenses(spark, folder).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.n_base == 0) == (r.first_word is None) == (r.base_labels == "")
