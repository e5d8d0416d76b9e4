"""The registered queries on a whole small table, against brute force."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer, models

import corpus_pipeline
from corpusmith.llm import queries as llm
from corpusmith.llm import unigram_count
from tests.llm import brute
from tests.test_queries import rows_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{FOLDER}/documents.parquet").select(["doc_id", "text"]).to_pydict()
    return dict(zip(rows["doc_id"], rows["text"]))


def collected(spark, name):
    rows = llm.QUERIES[name](spark, FOLDER).collect()
    return {r["doc_id"]: r for r in rows}, rows


@pytest.fixture(scope="module")
def multi():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got, want = llm.QUERIES[name](spark, FOLDER).toPandas(), con.execute(llm.ORACLES[name]).df()
    assert rows_of(got) == rows_of(want)
    assert sorted(got.columns) == sorted(want.columns)


def test_op2(spark, docs, multi):
    got, rows = collected(spark, "op2_byte_bpe")
    assert len(rows) == len(docs)
    for d, text in docs.items():
        ids = multi.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op3(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got, rows = collected(spark, "op3_token_store")
    assert len(rows) == len(docs)
    start = 0
    for d in sorted(docs):
        ids = [*tokenizer.encode(docs[d] or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_op4_is_right_on_rows_it_never_saw(spark, docs):
    got, rows = collected(spark, "op4_quality_classifier")
    labels = pq.read_table(f"{FOLDER}/labels.parquet").to_pydict()
    quality = dict(zip(labels["doc_id"], labels["quality"]))
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in quality]
    right = sum(r.predicted == quality[r.doc_id] for r in unseen)
    assert right >= 0.9 * len(unseen)


def test_op5(spark, docs):
    got, rows = collected(spark, "op5_exact_dedup")
    want = brute.exact_groups(docs.items())
    assert {d: (r.keep_id, r.group_size, r.text_sha256) for d, r in got.items()} == want
    assert all(r.kept == (r.keep_id == r.doc_id) for r in rows) and len(rows) == len(docs)


def test_op6(spark, docs):
    """The tokenizers library's unigram model over the same pieces."""
    pieces, has_bytes = unigram_count.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    lowest = min(s for _, s in pieces)
    byte_pieces = [(f"<0x{b:02X}>", lowest - 9.0) for b in range(256)]
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *byte_pieces], 0, has_bytes))
    got, rows = collected(spark, "op6_unigram_counts")
    assert len(rows) == len(docs)
    for d, text in docs.items():
        marked = unigram_count.SPACE + text.replace(" ", unigram_count.SPACE)
        assert got[d].n_tokens == len(model.encode(marked).ids)


def test_op7(spark, docs):
    got, rows = collected(spark, "op7_pii")
    assert len(rows) == len(docs)
    for d, text in docs.items():
        want = brute.base_spans(text)
        assert got[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert got[d][f"n_{kind}"] == sum(x.startswith(kind) for x in want)
        spans = got[d].spans.split(",") if got[d].spans else []
        assert set(want) <= set(spans)


def test_op9(spark, docs):
    got, rows = collected(spark, "op9_simhash")
    prints = {d: brute.simhash(t) for d, t in docs.items()}
    want = brute.components(prints)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {
        d: (f"{prints[d]:016x}", want[d]) for d in docs
    }
    assert len(rows) == len(docs)


def test_op10(spark, docs):
    got, rows = collected(spark, "op10_quality_rules")
    assert len(rows) == len(docs)
    for d, text in docs.items():
        r = got[d]
        assert brute.base_counts(text) == (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
        )
        assert not (r.kept and r.base_failed)


def test_op10_keeps_what_is_labelled_good(spark, docs):
    got, _ = collected(spark, "op10_quality_rules")
    labels = pq.read_table(f"{FOLDER}/labels.parquet").to_pydict()
    good = [
        got[d]
        for d, q in zip(labels["doc_id"], labels["quality"])
        if q == 1 and not got[d].base_failed
    ]
    assert good and all(r.kept for r in good)


def test_pipeline(spark, docs, multi):
    folder = spark.conf.get("spark.checkpoint.dir")
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    schema, kept = table.columns, {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before = table
        path = f"{folder}/pipeline-test-{name.replace(' ', '-')}"
        apply(spark, table, FOLDER).write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
        assert table.columns == schema
        ids = [r.doc_id for r in table.collect()]
        kept[name] = {r.doc_id: r.text for r in before.collect()}, ids
    texts, ids = kept["quality rules"]
    assert {d for d in texts if brute.base_counts(texts[d])[-1]}.isdisjoint(ids)
    texts, ids = kept["exact dedup"]
    groups = brute.exact_groups(texts.items())
    assert sorted(ids) == sorted({g[0] for g in groups.values()})
    texts, ids = kept["SimHash near-dedup"]
    comps = brute.components({d: brute.simhash(t) for d, t in texts.items()})
    assert sorted(ids) == sorted(set(comps.values()))
    texts, ids = kept["mixing sources"]
    assert set(ids) <= set(texts) and ids
    out = corpus_pipeline.STAGES[-1][1](spark, table, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(ids)
    for r in out:
        want = multi.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want


def test_pipeline_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    names = {n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{i}" for i in range(1, 14)}
