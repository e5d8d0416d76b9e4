"""Token dictionaries: typo correction and pivot rewriting.

A dictionary is a table ``(token, value)``, unique in ``token``. Looking a text
up means one value, or null, per token of the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions.arrow import bounded_runs
from corpusmith.functions.columns import let
from corpusmith.functions.tokens import Tokens, found_in, one_array
from corpusmith.operators.augment import variants
from corpusmith.sources.staging import stage

# A dictionary is sent to the executors up to this many bytes (measured).
BROADCAST_BYTES = 64 * 1024 * 1024
# A larger one is looked up by blocks of so much text, some to a shuffle partition.
BLOCK_BYTES = 4 << 20
PART_BYTES = 32 << 20
# A task sends the keys it has gathered when there are so many.
MOST_ASKED = 1 << 18


class Answers(NamedTuple):
    """What a dictionary has of some keys: no null values, and a token may come again."""

    tokens: pa.Array
    values: pa.Array


# What is looked up for some texts (null ones too), each once; it may be more than is used.
Keys = Callable[[pa.Array], pa.Array]
# From rows and the answers to their keys: a column of texts for each of some names.
Made = Callable[[pa.Table, Answers], list[pa.Array]]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a table: is its content at most ``limit`` bytes?"""
    row_bytes = F.lit(16 * (len(df.columns) + 1)).cast("bigint")
    for field in df.schema:
        row_bytes += F.coalesce(_content_bytes(field), F.lit(0))
    return (df.agg(F.sum(row_bytes)).head()[0] or 0) <= limit


def _content_bytes(field: T.StructField) -> Column:
    """The length of a value as JSON; for texts and lists of them without making it."""
    if field.dataType == T.StringType():
        return F.octet_length(field.name) + (len(field.name) + 7)
    if field.dataType == T.ArrayType(T.StringType()):
        return F.octet_length(F.array_join(field.name, "")) + 3 * F.size(field.name) + (len(field.name) + 6)
    return F.octet_length(F.to_json(F.struct(field.name)))


class TokenLookup:
    """A dictionary made ready for use; prepare it once and apply it often.

    A dictionary of checked size goes to the executors and rows stay where they
    are. A larger one is joined by shuffle. The result is the same: of several
    values of a token the smallest counts, and rows may share a ``row_key``. ``unique``
    says that each token has one value.
    """

    def __init__(self, dictionary: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, unique: bool = False):
        if not unique:
            # one value per token, the smallest, however the dictionary is used
            dictionary = dictionary.groupBy("token").agg(F.min("value").alias("value"))
        # measured, then sent or joined: computed once
        self.dictionary = stage(dictionary.select("token", "value"), "dictionary")
        small = fits_broadcast(self.dictionary, broadcast_bytes)
        self.sent = Sent.of(self.dictionary) if small else None

    def make(self, df: DataFrame, keys: Keys, made: Made, names: Sequence[str], block_bytes: int | None = None) -> DataFrame:
        """Add columns of ``names``: the texts that ``made`` makes of the rows and the
        dictionary's values of the ``keys`` of their texts."""
        if self.sent is None:
            return make_in_blocks(df, self.dictionary, keys, made, names, block_bytes or BLOCK_BYTES)
        sent = self.sent
        return make_texts(df, lambda rows: made(rows, sent.of_keys(keys(texts_of(rows)))), names)


class Sent(NamedTuple):
    """A dictionary that was sent to the executors."""

    name: str
    entries: Broadcast

    @classmethod
    def of(cls, dictionary: DataFrame) -> Sent:
        entries = dictionary.toArrow()
        columns = [entries.column(c).combine_chunks() for c in ("token", "value")]
        return cls(uuid.uuid4().hex, dictionary.sparkSession.sparkContext.broadcast(columns))

    def ready(self) -> tuple[dict[str, int], pa.Array]:
        """Its index and values, made ready once per Python worker, not once per batch."""
        if self.name not in _in_use:
            while len(_in_use) >= _MOST_IN_USE:
                _in_use.pop(next(iter(_in_use)))
            keys, values = self.entries.value
            _in_use[self.name] = {key: i for i, key in enumerate(keys.to_pylist())}, values
        return _in_use[self.name]

    def of_keys(self, keys: pa.Array) -> Answers:
        places, values = self.ready()
        held = [key for key in keys.to_pylist() if key in places]
        found = values.take(pa.array([places[key] for key in held], pa.int64()))
        return _known(pa.array(held, pa.string()), found)


_in_use: dict[str, tuple[dict[str, int], pa.Array]] = {}
# dictionaries that a worker keeps ready; one task uses a few at most
_MOST_IN_USE = 4


def _known(tokens: pa.Array, values: pa.Array) -> Answers:
    known = values.is_valid()
    return Answers(tokens.filter(known).cast(pa.string()), values.filter(known))


def texts_of(rows: pa.Table) -> pa.Array:
    return one_array(rows.column("text"), pa.string())


def _with_texts(rows: pa.Table, texts: list[pa.Array], names: Sequence[str]) -> pa.Table:
    return pa.Table.from_arrays([*rows.columns, *texts], [*rows.column_names, *names])


def _made_schema(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([*df.schema, *[T.StructField(n, T.StringType()) for n in names]])


def make_texts(df: DataFrame, made: Callable[[pa.Table], list[pa.Array]], names: Sequence[str]) -> DataFrame:
    """Add columns of ``names``: the texts that ``made`` makes of the rows, some megabytes
    of text at a time; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for start, stop in bounded_runs(sizes, BLOCK_BYTES):
                rows = pa.Table.from_batches([batch.slice(start, stop - start)])
                yield from _with_texts(rows, made(rows), names).combine_chunks().to_batches()

    return df.mapInArrow(run, _made_schema(df, names))


def _dealt(df: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``df`` with ``_block``, in tasks of some blocks, each of some megabytes of text."""
    size = df.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    blocks = max(4 * parts, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("row_key", "text"), F.lit(blocks)).cast("int")
    return df.withColumn("_block", block).repartition(parts, "_block")


def make_in_blocks(
    df: DataFrame, dictionary: DataFrame, keys: Keys, made: Made, names: Sequence[str], block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add columns of ``names``: the texts that ``made`` makes of the rows and the values of
    their texts' ``keys`` in ``dictionary (token, value)``, unique in ``token`` and too large
    to broadcast.

    Rows are dealt into blocks of some megabytes of text by a hash of what they hold.
    Each task asks for its blocks' keys, so that a frequent one travels at most once per
    block, the dictionary is shuffled once as it is, and the answers meet the rows of
    their block, which are shuffled by their block and need no number.
    """
    # only the text that keys come from travels, and once, as both sides read all its columns
    dealt = _dealt(df, block_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _asked_by_task(batches, keys)

    asked = dealt.mapInArrow(ask, "token string, _blocks array<int>")
    # never broadcast: Spark would judge the dictionary by its compressed files
    answers = asked.join(dictionary.select("token", "value").hint("merge"), "token")
    answers = answers.select(F.explode("_blocks").alias("_from"), "token", "value")
    columns = df.columns

    def answer(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.select(columns)
        answers = _known(one_array(found.column("token")), one_array(found.column("value")))
        return _with_texts(rows, made(rows, answers), names)

    return dealt.groupBy("_block").cogroup(answers.groupBy("_from")).applyInArrow(answer, _made_schema(df, names))


def _asked_by_task(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[pa.RecordBatch]:
    """``(token, _blocks)``: the keys of a task's texts and the blocks that have them. A key
    comes once, or again if more than ``MOST_ASKED`` others came between."""
    asked: list[pa.Table] = []

    def sent() -> list[pa.RecordBatch]:
        grouped = pa.concat_tables(asked).group_by("token", use_threads=False).aggregate([("_blocks", "distinct")])
        asked.clear()
        return grouped.rename_columns({"_blocks_distinct": "_blocks"}).select(["token", "_blocks"]).to_batches(1 << 16)

    for batch in batches:
        of_block = batch.column("_block").to_numpy()
        order = np.argsort(of_block, kind="stable")
        starts = np.flatnonzero(np.diff(of_block[order], prepend=-1))
        for start, stop in pairwise([*starts.tolist(), len(order)]):
            tokens = keys(batch.column("text").take(pa.array(order[start:stop])))
            blocks = pa.array(np.full(len(tokens), of_block[order[start]], np.int32))
            asked.append(pa.table({"token": tokens, "_blocks": blocks}))
            if sum(map(len, asked)) >= MOST_ASKED:
                yield from sent()
    if asked:
        yield from sent()


def look_up_in_blocks(df: DataFrame, keys: Column, dictionary: DataFrame, output: str) -> DataFrame:
    """Add ``output``: for each entry of the array ``keys`` its value in ``dictionary
    (token, value)``, unique in ``token`` and too large to broadcast.

    Rows are dealt into blocks of some megabytes of text by a hash of what they hold.
    Each block asks once for each of its keys, so that a frequent one travels at most once
    per block, the dictionary is shuffled once as it is, and the answers meet the rows of
    their block, which are shuffled by their block and need no number.
    """
    # keys are made behind the exchange: only the text that they come from travels, and
    # once, as both sides read all its columns
    dealt = _dealt(df, BLOCK_BYTES)
    asked = dealt.withColumn("_keys", keys).mapInArrow(_asked, "_block int, token string")
    # a key travels once per task, with the blocks that ask for it
    blocks_of = asked.groupBy("token").agg(F.collect_set("_block").alias("_blocks"))
    # never broadcast: Spark would judge the dictionary by its compressed files
    answers = blocks_of.join(dictionary.select("token", "value").hint("merge"), "token")
    kind = T.ArrayType(dictionary.schema["value"].dataType)
    schema = T.StructType([*df.schema, T.StructField(output, kind)])
    names = df.columns

    def answer(rows: pa.Table, found: pa.Table) -> pa.Table:
        asked_for = rows.column("_keys").combine_chunks()
        tokens, values = (found.column(c).combine_chunks() for c in ("token", "value"))
        at = pc.index_in(asked_for.flatten(), value_set=tokens)
        return rows.select(names).append_column(output, _in_lists(asked_for, values.take(at)))

    rows = dealt.sortWithinPartitions("_block").withColumn("_keys", keys)
    answers = answers.select(F.explode("_blocks").alias("_from"), "token", "value")
    return rows.groupBy("_block").cogroup(answers.groupBy("_from")).applyInArrow(answer, schema)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(_block, token)``: the keys that each block has in a batch, each once."""
    for batch in batches:
        keys = batch.column("_keys")
        blocks = batch.column("_block").take(pc.list_parent_indices(keys))
        names = ["_block", "token"]
        table = pa.Table.from_arrays([blocks, keys.flatten()], names)
        yield from table.group_by(names).aggregate([]).select(names).to_batches()


def _in_lists(rows: pa.Array, found: pa.Array) -> pa.Array:
    """``found``, one per entry of the lists of ``rows``, in lists of the same lengths."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0)
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, found, mask=rows.is_null())


def correction_lookup(corrections: DataFrame, **options) -> TokenLookup:
    """From ``(token, correction)``; the smallest correction of a token counts."""
    one_each = _dealt_by(corrections, "token").groupBy("token").agg(F.min("correction").alias("value"))
    return TokenLookup(one_each, unique=True, **options)


def _dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together before they are grouped. Spark sorts for the smallest string of
    a group, and would do so before the shuffle too, where few rows have the same key."""
    return df.repartition(*keys)


def correct_tokens(df: DataFrame, corrections: DataFrame | TokenLookup) -> DataFrame:
    """Replace tokens found in ``corrections (token, correction)``. 1 row.

    The whitespace between tokens stays as it is.
    """
    if isinstance(corrections, DataFrame):
        corrections = correction_lookup(corrections)
    found = corrections.make(df, _piece_keys, _corrected, ["_corrected"])
    return variants(found, {"corrected": F.col("_corrected")}).drop("_corrected")


def token_keys(texts: pa.Array) -> pa.Array:
    return Tokens(texts).words


_EMPTY = pa.array([""], pa.string())


def _piece_keys(texts: pa.Array) -> pa.Array:
    """The tokens, and an empty one where a text begins with whitespace or is empty."""
    tokens = Tokens(texts)
    return pa.concat_arrays([tokens.words, _EMPTY]) if tokens.led_by_space.any() else tokens.words


def _corrected(rows: pa.Table, found: Answers) -> list[pa.Array]:
    tokens = Tokens(texts_of(rows))
    at = found_in(tokens.words, found.tokens)
    words = pa.concat_arrays([tokens.words, found.values])
    codes = np.where(at < 0, np.arange(len(at)), at + len(at))[tokens.codes]
    fixed = tokens.replaced(words, codes)
    empty = found_in(_EMPTY, found.tokens)[0]
    if empty >= 0:
        before = pc.if_else(pa.array(tokens.led_by_space), found.values[int(empty)], "")
        fixed = pc.binary_join_element_wise(before, fixed, "")
    return [fixed]


class PivotLookup(TokenLookup):
    """Round trips through pivot languages: one result, or null, per language.

    ``forward`` and ``back`` are ``(lang, src, dst)``; the two steps meet here,
    dictionary by dictionary, and not once per text.
    """

    def __init__(
        self,
        forward: DataFrame,
        back: DataFrame,
        languages: Sequence[str] = ("en", "zh-CN", "de"),
        **options,
    ):
        self.languages = tuple(languages)
        wanted = forward.where(F.col("lang").isin(*self.languages))
        there = _dealt_by(wanted, "lang", "src").groupBy("lang", "src").agg(F.min("dst").alias("pivot"))
        known = back.where(F.col("lang").isin(*self.languages)).withColumnRenamed("src", "pivot")
        home = _dealt_by(known, "lang", "pivot").groupBy("lang", "pivot").agg(F.min("dst").alias("result"))
        round_trip = _dealt_by(there.join(home, ["lang", "pivot"]), "src")
        results = [
            F.min(F.when(F.col("lang") == x, F.col("result"))) for x in self.languages
        ]
        dictionary = round_trip.groupBy(F.col("src").alias("token")).agg(
            F.array(*results).alias("value")
        )
        super().__init__(dictionary, unique=True, **options)


class PhraseLookup(PivotLookup):
    """Round trips of phrases: ``src`` is one token or several, joined by single spaces,
    and at most ``max_tokens`` of them."""

    def __init__(self, forward: DataFrame, back: DataFrame, *args, max_tokens: int = 3, **options):
        short = forward.where(F.size(F.split("src", " ")) <= max_tokens)
        super().__init__(short, back, *args, **options)
        self.max_tokens = max_tokens


def phrases_at(tokens: Column, max_tokens: int) -> Column:
    """For each token the phrases of 1 to ``max_tokens`` tokens that begin with it, one
    token's after another's; null where the text ends before."""

    def phrase(toks: Column, place: Column) -> Column:
        start, size = F.floor(place / max_tokens).cast("int"), (place % max_tokens + 1).cast("int")
        return F.when(start + size <= F.size(toks), F.array_join(F.slice(toks, start + 1, size), " "))

    def all_of(toks: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(toks) * max_tokens - 1)
        found = F.transform(places, lambda place: phrase(toks, place))
        return F.when(F.size(toks) > 0, found).otherwise(F.array().cast("array<string>"))

    return F.when(tokens.isNotNull(), let(tokens, all_of))


def _longest_first(longest: list[int]) -> list[int] | None:
    """From left to right the places of the longest phrases of a text; null if no phrase
    begins at some place. ``longest`` is the length of the longest one at each place, 0
    where there is none."""
    out, at, size = [], 0, len(longest)
    while at < size:
        if not longest[at]:
            return None
        out.append(at)
        at += longest[at]
    return out


def phrase_rewrite(
    df: DataFrame,
    phrases: PhraseLookup,
    languages: Sequence[str] | None = None,
    on_error: str = "keep",
) -> DataFrame:
    """As ``pivot_rewrite``, phrase by phrase: at each place the longest phrase of the
    table counts, and the next one begins behind it. A text with a place where no
    phrase begins is an error."""
    if on_error not in ("keep", "drop"):
        raise ValueError(f"on_error must be 'keep' or 'drop', not {on_error!r}")
    most = phrases.max_tokens
    chosen = phrases.languages if languages is None else languages
    at = [phrases.languages.index(x) for x in chosen]

    def keys(texts: pa.Array) -> pa.Array:
        tokens = Tokens(texts)
        return pa.concat_arrays([tokens.words, *[tokens.of_size(n)[1].unique() for n in range(2, most + 1)]])

    def made(rows: pa.Table, found: Answers) -> list[pa.Array]:
        tokens = Tokens(texts_of(rows))
        # of each number of tokens the phrase that begins at a place, -1 without one
        begun = np.full((most, len(tokens.codes)), -1, np.int64)
        for n in range(1, most + 1):
            where, joined = tokens.of_size(n)
            begun[n - 1, where] = found_in(joined, found.tokens)
        return [_rewritten(tokens, begun, pc.list_element(found.values, i)) for i in at]

    # a text has more phrases than tokens
    names = [f"_pivot_{x}" for x in chosen]
    rewritten = phrases.make(df, keys, made, names, BLOCK_BYTES // (most * (most + 1) // 2))
    return _pivots(rewritten, chosen, on_error)


def _rewritten(tokens: Tokens, begun: np.ndarray, results: pa.Array) -> pa.Array:
    """The texts phrase by phrase, null where a place has none; ``results`` has those of the
    phrases numbered in ``begun``, which may be null."""
    longest, result = np.zeros(begun.shape[1], np.int64), np.full(begun.shape[1], -1, np.int64)
    valid = np.append(results.is_valid().to_numpy(zero_copy_only=False), False)
    for n, numbers in enumerate(begun, 1):
        here = valid[numbers]
        longest[here], result[here] = n, numbers[here]
    lengths, starts = longest.tolist(), tokens.starts.tolist()
    walks = [_longest_first(lengths[start:end]) for start, end in pairwise(starts)]
    places = [start + place for start, walk in zip(starts, walks) for place in walk or ()]
    made = tokens.joined(results, result[places], np.cumsum([0, *[len(w or ()) for w in walks]]))
    failed = pa.array([w is None for w in walks], pa.bool_())
    return pc.if_else(failed, pa.scalar(None, pa.string()), made)


def _pivots(rewritten: DataFrame, languages: Sequence[str], on_error: str) -> DataFrame:
    """A row for each language, of the texts in ``_pivot_`` and its name."""
    names = [f"_pivot_{x}" for x in languages]
    texts = {f"pivot_{x}": F.col(f"`{name}`") for x, name in zip(languages, names)}
    if on_error == "keep":
        texts = {kind: F.coalesce(t, "text") for kind, t in texts.items()}
    out = variants(rewritten, texts).drop(*names)
    return out if on_error == "keep" else out.where(F.col("text").isNotNull())


def pivot_rewrite(
    df: DataFrame,
    pivots: PivotLookup,
    languages: Sequence[str] | None = None,
    on_error: str = "keep",
) -> DataFrame:
    """Rewrite texts through pivot languages, one row per language.

    ``languages`` is a choice of those in ``pivots``, by default all. A text
    with a token that has no round trip is an error: ``keep`` returns the
    original text for it, ``drop`` returns no row.
    """
    if on_error not in ("keep", "drop"):
        raise ValueError(f"on_error must be 'keep' or 'drop', not {on_error!r}")
    chosen = pivots.languages if languages is None else languages
    at = [pivots.languages.index(x) for x in chosen]

    def made(rows: pa.Table, found: Answers) -> list[pa.Array]:
        tokens = Tokens(texts_of(rows))
        places = found_in(tokens.words, found.tokens)
        values = found.values.take(pa.array(places, mask=places < 0))
        # null where a word has no result, and then for the whole text
        words = [pc.list_element(values, i) for i in at]
        return [tokens.joined(w, tokens.codes, tokens.starts) for w in words]

    rewritten = pivots.make(df, token_keys, made, [f"_pivot_{x}" for x in chosen])
    return _pivots(rewritten, chosen, on_error)
