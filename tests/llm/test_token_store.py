"""The encoder of the token store against the tokenizers library."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmith.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
words = st.text(alphabet="abcdeghinorstéßñ日ªΩ", min_size=1, max_size=12)
marks = st.sampled_from(["", ",", ".", "!", "?", ":", ";", ",,", ".\n", "'s", "'re", "-", "7", "3.5", "\x00", "…"])
texts = st.lists(st.tuples(words, marks, st.sampled_from([" ", "  ", "\n", " \n", "\t", ""])), max_size=30).map(
    lambda parts: "".join(a + b + c for a, b, c in parts)
)


def ids(packed, width):
    return np.frombuffer(packed, f"<u{width}").tolist()


@settings(max_examples=300, deadline=None)
@given(texts, st.sampled_from([2, 4]))
def test_chunks_are_encoded_as_in_the_text(text, width):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    for _ in range(2):  # the second time from the cache
        assert ids(token_store._encoder(PATH, width)(text), width) == want


@pytest.mark.parametrize("entries", [1, 5, 50])
def test_a_full_cache_changes_nothing(entries):
    def encode_others(chunk):
        return LIBRARY.encode(chunk, add_special_tokens=False).ids

    cache = token_store.PackedCache(LIBRARY.model.tokenize, encode_others, 2, entries)
    for i in range(60):
        text = f"one two, three; {'word' * (i % 4)}. four{i % 3}, a,, b two three, x" + " tail" * (i % 5)
        assert ids(cache.encode(text), 2) == LIBRARY.encode(text, add_special_tokens=False).ids
