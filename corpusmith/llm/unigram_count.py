"""Token counts of a unigram tokenizer, without making the tokens.

Aho-Corasick finds every vocabulary piece in a text; a Viterbi pass over the
positions carries the best score and the number of pieces on the best path, and
nothing else. Ties are broken as the tokenizers library does: pieces are offered
in order of their start, and a later one wins only with a higher score, so of
equal paths the one with the longest last piece counts. A character that no
piece starts with scores ``min(scores) - 10`` and becomes one token per byte of
its UTF-8 form if the vocabulary has byte pieces, else one token per run of such
characters.

A position is a safe cut if no piece has both characters around it. Before each
space that is so for vocabularies whose pieces hold spaces at their start only;
then a text is the sum of its chunks, and counts of chunks are cached. Other
vocabularies take the same pass over whole texts.

Null and empty texts have no tokens. Texts are processed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from corpusmith.llm.byte_bpe import local_file
from corpusmith.llm.common import per_document

SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
_CACHED = 1_000_000


class UnigramCounter:
    """Counts for a vocabulary ``(piece, score)``.

    ``bytes_for_unknown``: does it have the pieces <0x00> to <0xFF>?
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]], bytes_for_unknown: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - _UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        # where spaces stand only at the start, what comes before a space can be cut off
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece, _ in vocabulary)
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of ``text``: spaces become U+2581 and one is put before it."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.count_pieces(marked)
        total = 0
        for chunk in _CHUNKS.findall(marked):
            count = self.cache.get(chunk)
            if count is None:
                count = self.count_pieces(chunk)
                if len(self.cache) >= _CACHED:
                    self.cache.clear()
                if len(chunk) <= 64:
                    self.cache[chunk] = count
            total += count
        return total

    def count_pieces(self, text: str) -> int:
        """The Viterbi pass over text as it is."""
        score, count = [0.0], [0]
        ends_unknown = -1  # where the last unknown character on a best path ends
        best, pieces, last_length = None, 0, 0
        end = 1
        matches = self.automaton.iter(text) if len(self.automaton) else ()
        for last, (length, piece_score) in _closed(matches, len(text)):
            while end <= last:  # nothing more ends here
                if last_length != 1:
                    at = score[-1] + self.unknown
                    if best is None or at > best:
                        best = at
                        if self.bytes_for_unknown:
                            pieces = count[-1] + len(text[end - 1].encode())
                        else:
                            pieces = count[-1] + (ends_unknown != end - 1)
                        ends_unknown = end
                score.append(best)
                count.append(pieces)
                end += 1
                best, last_length = None, 0
            # of pieces with one end the automaton gives the longest first
            if length:
                at = score[end - length] + piece_score
                if best is None or at > best:
                    best, pieces = at, count[end - length] + 1
                last_length = length
        return count[-1]


def _closed(matches: Iterable, n: int) -> Iterator:
    """``matches`` and a last one behind the end, of length 0."""
    yield from matches
    yield n, (0, 0.0)


_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]*(?<=.)", re.DOTALL)


def read_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The scored pieces of a sentencepiece model file, control and byte pieces
    left out, and whether it has byte pieces."""
    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if i not in special]
    return pieces, any(model.is_byte(i) for i in ids)


@lru_cache(maxsize=2)
def _counter(path: str) -> UnigramCounter:
    """One per Python worker, kept from task to task."""
    return UnigramCounter(*read_pieces(local_file(path)))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens)`` by the vocabulary of a sentencepiece model file."""

    def make():
        counter = _counter(path)
        return lambda texts: [pa.array([counter.count(x.as_py()) for x in texts], pa.int64())]

    return per_document(docs, make, "n_tokens long")
