"""Byte-pair ids against the public encoder, match by match and on whole tables."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from airlens.llm import byte_pairs, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.shared_coder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def public(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_every_document(spark, sf_dir, public):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = public.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), *(hashlib.sha256(b).hexdigest() for b in (",".join(map(str, ids)).encode(), (r.text or "").encode())))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_byte_pairs"](spark, sf_dir).collect()}
    assert got == want


def test_odd_texts(coder, public):
    rng = random.Random(1)
    spans = [(32, 127), (160, 0x600), (0x3000, 0xD000), (0x10000, 0x40000), (9, 14), (32, 33), (0x55, 0x60)]
    texts = ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["x" * 70_000, "ab" * 9000, " " * 5000, "'s't" * 900, "e" * 1023 + "é", "a" * 1024, "a" * 1025, "՘a㈻0", "<|endoftext|>"]
    texts += [a + chr(c) for c in range(0x2080, 0x20B0) for a in "a1! "]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == public.encode_ordinary(text), repr(text[:40])
        assert coder.decode(ids.tolist()) == text.encode()


def test_matrix_and_heap_agree(coder):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdeint \xc3\xa9") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    pieces = [p for p in pieces if p not in coder.ranks]
    assert coder.merge(pieces) == [coder._merge_long(p) for p in pieces]


def test_memory_changes_nothing(coder, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 3)
    monkeypatch.setattr(byte_pairs, "AT_ONCE", 10)
    small = byte_pairs.BytePairCoder(PATH, public_tokenizers.PATTERN)
    texts = ["one two three four five", None, "", "five four unzerbrechlich three", "two日本 unzerbrechlich"] * 3
    assert [i.tolist() for i in small.encode(texts)] == [i.tolist() for i in coder.encode(texts)]


def test_rows(spark, awkward, nothing, public):
    args = (PATH, public_tokenizers.PATTERN)
    found = byte_pairs.encode(awkward, *args)
    want = sorted((repr(r.doc_id), public.encode_ordinary(r.text or "")) for r in awkward.collect())
    assert sorted((repr(r.doc_id), r.ids) for r in found.collect()) == want
    back = sorted((repr(r.doc_id), bytes(r.decoded)) for r in byte_pairs.decode(found, *args).collect())
    assert back == sorted((repr(r.doc_id), (r.text or "").encode()) for r in awkward.collect())
    assert byte_pairs.round_trip(awkward, *args).count() == awkward.count()
    assert byte_pairs.round_trip(nothing, *args).count() == 0
