"""Nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmith.llm import (
    byte_bpe,
    exact_dedup,
    licences,
    mixing,
    pii,
    quality_model,
    repetition,
    simhash,
    token_store,
    unigram_count,
)
from corpusmith.llm.queries import mixture
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "long words " * 20_000 + "x" * 50_000 + "7" * 40_000 + " a.b" * 5_000
TEXTS = [None, "", " \t\n", "same text", "same  text", LONG, LONG, "Émile@x", "a@b.c_d@e.f +1 (523) 555-1055"]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row_no int, row string, "
    "fp string, id string, digest string, p1 string, n string, h string, kind string"
)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null ids, texts of every kind, columns named like internal ones."""
    rows = [(i, t, "en", "src1", 1, *["x"] * 0) for i, t in enumerate(TEXTS)]
    rows += [(3, "same text", "en", None, None), (None, "no id", None, "src2", 3), (None, None, None, None, None)]
    full = [(*r, 7, "r", "f", "i", "d", "p", "n", "h", "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def reports(docs, tmp_path_factory):
    levels, weights = mixture(docs)
    store = str(tmp_path_factory.mktemp("store") / "s")
    token_store.write_store(docs, store, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=500)
    return {
        "mix": mixing.mix_report(docs, levels, weights=weights),
        "bpe": byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True),
        "store": token_store.read_documents(token_store.open_store(docs.sparkSession, store)),
        "dedup": exact_dedup.dedup_report(docs),
        "unigram": unigram_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")),
        "pii": pii.report(docs),
        "licences": licences.scan(docs),
        "simhash": simhash.near_duplicates(docs),
        "rules": repetition.quality_report(docs),
    }


def test_every_operator_returns_every_row(odd, tmp_path_factory):
    for name, report in reports(odd, tmp_path_factory).items():
        rows = report.collect()
        assert len(rows) == odd.count(), name
        if name == "dedup":
            sizes = {r.doc_id: r.group_size for r in rows if r.doc_id is not None}
            assert sizes[1] == 4 and sizes[3] == 3 and sizes[5] == 2
            # one row of each group stays, also where ids repeat
            assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
        if name == "pii":
            spans = {r.doc_id: r.base for r in rows}
            assert spans[8] == brute.base_spans(TEXTS[8]) and spans[5] == brute.base_spans(LONG)
        if name == "simhash":
            found = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
            assert found[0] == found[1] == found[2] == 0 and found[6] == 5
        if name == "rules":
            assert not any(r.kept for r in rows if r.n_words < 50)


def test_empty_tables(none, tmp_path_factory):
    for name, report in reports(none, tmp_path_factory).items():
        assert report.count() == 0, name


def test_stages_keep_all_columns(spark, odd, none):
    for docs in (odd, none):
        for name, apply in corpus_pipeline.STAGES[:-1]:
            out = apply(spark, docs, "")
            assert out.columns == odd.columns and out.count() <= 4 * docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_classifier_without_labels_and_with_odd_ones(spark, odd):
    none = spark.createDataFrame([], "doc_id long, label int")
    weights = quality_model.train(odd, none)
    scores = quality_model.score_documents(odd, weights).collect()
    assert {r.score for r in scores} == {0.5} and len(scores) == odd.count()
    labels = spark.createDataFrame([(3, None), (3, 1), (3, 0), (99, 1), (None, 1)], "doc_id long, label int")
    assert quality_model.train(odd, labels).any()


def test_hot_digests_are_found_and_light_ones_agree(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute.exact_groups(rows)
    for counters in (15, 1023):
        got = exact_dedup.dedup_report(docs, counters).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    keys = docs.select(exact_dedup.text_digest(F.col("text")).alias("digest"))
    assert exact_dedup.frequent_digests(keys, 15).count() == 1


def test_sliced_shards_and_chains(spark):
    """Components hang together across shards and slices; chains are followed."""
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for _ in range(300):  # drift away bit by bit
        v = values[int(rng.integers(len(values)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 7))):
            v ^= 1 << int(b)
        values.append(v)
    prints = dict(enumerate(values))
    rows = [(0, i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    frame = spark.createDataFrame(rows, "row_no int, id long, fp long")
    want = brute.components(prints)
    for shard_rows in (3, 20_000):
        members = simhash.components(frame, shard_rows=shard_rows)
        got = frame.join(members, "fp").select("id", F.col("first.id").alias("c")).collect()
        assert {r.id: r.c for r in got} == want


def test_shares_add_up_and_shortages_go_to_siblings(spark):
    rows = []
    for source, n in (("a", 10), ("b", 100), ("c", 400)):
        rows += [(len(rows) + i, "w " * 10, "x" if source != "c" else "y", source) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    report = mixing.mix_report(docs, levels, budget=4000, max_epochs=2)
    taken = {r.leaf: r.t for r in report.groupBy("leaf").agg(F.sum("tokens_taken").alias("t")).collect()}
    # x and y get 2000 each; a holds 200 in two passes, b takes over the rest of x
    assert taken == {'["x","a"]': 200, '["x","b"]': 1800, '["y","c"]': 2000}
    short = mixing.mix_report(docs, levels, budget=9000, max_epochs=2)
    total = short.agg(F.sum("tokens_taken")).head()[0]
    assert total == 9000  # x can't take its half, y does


def test_store_look_up(spark, tmp_path):
    docs = spark.createDataFrame([(i * 7, f"text {i}") for i in range(300)], "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=100)
    store = token_store.open_store(spark, path)
    found = {r.doc_id: r for r in token_store.look_up(store, [7, 8, 2093, 5000]).collect()}
    assert sorted(found) == [7, 2093]
    whole = {r.doc_id: r for r in token_store.read_documents(store).collect()}
    assert all(found[d].start == whole[d].start and len(found[d].ids) == whole[d].n_tokens for d in found)


with open(RANKS, "rb") as lines:
    _RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
_BPE = byte_bpe.ByteBpe(_RANKS, leaf=3)
_TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeghinorst é日\n'1.", max_size=120))
def test_tree_reduction_agrees_with_tiktoken(text):
    _, cache = byte_bpe._encoder(RANKS, public_tokenizers.PATTERN)
    want = _TIKTOKEN.encode_ordinary(text)
    assert np.frombuffer(cache.encode(text), "<u4").tolist() == want
    assert _BPE.decode(want) == text.encode()
    piece = text.encode()
    if piece:
        assert _BPE.tree(piece) == _BPE.merge(piece) == _BPE._merge_long(piece)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c|", "\n", "dd#", " "]), max_size=90))
def test_quality_counts(parts):
    text = " ".join(parts)
    assert repetition.measure(text, repetition.Limits())[:6] == brute.base_counts(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), unique=True, max_size=60))
def test_perfect_hash(keys):
    numbers = np.array(keys, np.uint64)
    index = token_store.PerfectHash.build(numbers)
    assert sorted(index.slots(numbers).tolist()) == list(range(len(keys)))
    again = token_store.PerfectHash.from_bytes(len(index.sizes), index.to_bytes())
    assert (again.slots(numbers) == index.slots(numbers)).all()
