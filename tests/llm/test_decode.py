"""Decoding ids: what was encoded comes back, odd ids have a defined text."""

import numpy as np
import public_tokenizers

from corpusmith.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_round_trip(spark):
    texts = ["plain words", "", None, "Émile\n 日本  x\x00y", "a" * 5000, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r.text for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_odd_ids(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    half = np.array([ranks[b"\xc3"], ranks[b"a"]], "<u4").tobytes()  # the first byte of two
    rows = [(None, None, "x"), (1, bytearray(half), "y"), (1, bytearray(b""), "z")]
    encoded = spark.createDataFrame(rows, "doc_id long, ids binary, text string")
    got = byte_bpe.decode(encoded, RANKS)
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, ""), (1, "�a"), (None, "")]
    assert byte_bpe.decode(encoded.where("false"), RANKS).collect() == []
