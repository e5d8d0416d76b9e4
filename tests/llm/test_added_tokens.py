"""Texts that hold the text of an added token, against the tokenizers library."""

import public_tokenizers
from tokenizers import Tokenizer

from corpusmith.llm import token_store


def test_added_tokens_are_what_the_library_makes_of_them():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), token_store._encoder(path, 4)
    end = "<|endoftext|>"
    texts = [
        f"a {end} b", end, f"{end}{end}", f"a  {end}  b", f"a\n {end}\n b", f" {end} ", f"a {end}b c  d {end}",
        "a <|endoftext| > b", "a  b c\n d ",
    ]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert memoryview(encode(text)).cast("I").tolist() == want, text
    assert memoryview(encode(texts[0])).cast("I").tolist() == [64, 220, 50256, 275]


def test_store_gives_the_added_token_back(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "s"), path)
    rows = sorted(token_store.read_documents(token_store.open_store(spark, str(tmp_path / "s"))).collect())
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(1, 0, 5), (2, 5, 2)]
