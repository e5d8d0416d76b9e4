"""SimHash near-duplicates, found with BK-trees.

A text is lower-cased (A to Z only) and cut into shingles of ``shingle`` words,
repeats included; a shorter text is one shingle. Each shingle is hashed with
XXH64 (UTF-8, seed 42). A bit of the 64-bit fingerprint is 1 when it is set in
more than half of the hashes; a text without words has fingerprint zero.
Fingerprints that differ in at most ``radius`` bits are linked, and documents
whose fingerprints are connected by links form a component.

One tree over all fingerprints would be visited almost whole by every search,
as distances of unlike texts lie close together, and it would grow with the
corpus, so it can't be broadcast. Therefore the trees are sharded: of ``blocks``
blocks of bits, two fingerprints within the radius share ``blocks - radius`` at
least, so a shard holds the fingerprints that agree on one choice of
``blocks - radius`` blocks, and searching each shard for itself misses no link.
A shard of more than ``shard_rows`` fingerprints is cut into slices, and each
pair of slices is searched in a task of its own, so memory stays bounded.

A task emits a link from each member to one other of its local component, not
all pairs. Components of the whole are found by contraction: every fingerprint
moves to its neighbour with the smallest hash until no link is left.

Null texts count as empty and so equal each other; copies and repeated rows
share a fingerprint; an empty table gives an empty result. Ids may be null:
they count only where a component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import Batches, keep_rows, per_document, stage_rows
from corpusmith.sources.staging import stage

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SHARD_ROWS = 20_000
# shingle hashes turned into bits at a time
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    # bytes.lower and bytes.split know ASCII only, which is what is asked for
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        octets = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class BKTree:
    """A tree of fingerprints; a child's key is its distance from the parent.

    ``add`` searches, unites the new fingerprint with all within the radius, and
    inserts it. Subtrees known to be in its component already are passed over,
    so many near copies of one text don't cost a comparison per pair.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # of the components' union-find
        self.uniform: list[bool] = []  # is the subtree in one component?

    def component(self, node: int) -> int:
        parent = self.parent
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    def add(self, value: int) -> None:
        new = len(self.values)
        self.parent.append(new)
        if new:
            self._unite(value, new)
            self._insert(value, new)
        self.values.append(value)
        self.children.append({})
        self.uniform.append(True)

    def _unite(self, value: int, new: int) -> None:
        values, children, radius, stack = self.values, self.children, self.radius, [0]
        while stack:
            node = stack.pop()
            if self.uniform[node] and self.component(node) == self.component(new):
                continue
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                self.parent[self.component(new)] = self.component(node)
            near = [
                (abs(key - distance), child)
                for key, child in children[node].items()
                if distance - radius <= key <= distance + radius
            ]
            # the likeliest subtree is popped first
            stack.extend(child for _, child in sorted(near, reverse=True))

    def _insert(self, value: int, new: int) -> None:
        node, mine = 0, self.component(new)
        while True:
            if self.component(node) != mine:
                self.uniform[node] = False
            key = (self.values[node] ^ value).bit_count()
            child = self.children[node].get(key)
            if child is None:
                self.children[node][key] = new
                return
            node = child


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what the links within ``radius`` connect."""
    tree = BKTree(radius)
    for value in values:
        tree.add(value)
    roots = [tree.component(i) for i in range(len(values))]
    return [(v, values[r]) for v, r in zip(values, roots) if v != values[r]]


def _shard_masks(blocks: int, radius: int) -> list[int]:
    """Signed masks of each choice of ``blocks - radius`` blocks of bits."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


_SHARD = ["choice", "part", "a", "b"]


def _sharded(prints: DataFrame, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """``(choice, part, a, b, fp)``: each shard, or pair of slices of a large one."""
    parts = [
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
        for i, m in enumerate(_shard_masks(blocks, radius))
    ]
    rows = prints.select("fp", F.inline(F.array(*parts)))
    slices = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int").alias("slices")
    large = (
        rows.groupBy("choice", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > shard_rows)
        .select("choice", "part", slices)
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    other = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
    sliced = rows.join(large, ["choice", "part"], "left").select(
        "choice", "part", "fp", F.coalesce(mine, F.lit(0)).alias("mine"), F.explode(other).alias("other")
    )
    return sliced.select(
        "choice",
        "part",
        F.least("mine", "other").alias("a"),
        F.greatest("mine", "other").alias("b"),
        "fp",
    )


def _shard_runs(batches: Batches) -> Iterator[list[int]]:
    """The members of each shard; rows come in shard order."""
    held: list[np.ndarray] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in _SHARD], axis=1)
        values = batch.column("fp").to_numpy().view(np.uint64)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if held and len(key):
            if (held_key != key[0]).any():
                yield np.concatenate(held).tolist()
                held = []
        bounds = np.r_[0, cuts, len(key)].tolist()
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            if held:
                yield np.concatenate([*held, values[a:b]]).tolist()
                held = []
            elif b - a > 1:
                yield values[a:b].tolist()
        if len(key):
            held.append(values[bounds[-2] :])
            held_key = key[-1]
    if held:
        yield np.concatenate(held).tolist()


def links(
    prints: DataFrame,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(v, u)``: links that connect what is connected among distinct ``fp``."""

    def search(batches: Batches) -> Batches:
        for members in _shard_runs(batches):
            found = tree_links(members, radius) if len(members) > 1 else []
            if found:
                v, u = zip(*found)
                yield pa.RecordBatch.from_arrays([_signed(v), _signed(u)], ["v", "u"])

    shards = _sharded(prints, radius, blocks, shard_rows)
    ordered = shards.repartition(*_SHARD).sortWithinPartitions(*_SHARD)
    return ordered.mapInArrow(search, "v long, u long").distinct()


def _by_hash(column: str) -> Column:
    return F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("x"))


def connected(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for each vertex that is not its component's root itself.

    In every round each vertex moves to the smallest hash among itself and its
    neighbours; edges between moved vertices go on. A round removes a constant
    share of the vertices, whatever the shape, and only ever asks for minima, so
    no task gathers the neighbours of one vertex.
    """
    edges = stage(edges.select("v", "u"), "links")
    moves = []
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        nearest = both.groupBy("v").agg(F.min(_by_hash("u")).alias("n"))
        move = stage(nearest.select("v", F.least(_by_hash("v"), "n")["x"].alias("to")), "moves")
        moves.append(move.where("v != to"))
        first = move.select("v", F.col("to").alias("new_v"))
        second = move.select(F.col("v").alias("u"), F.col("to").alias("new_u"))
        moved = (
            edges.join(first, "v")
            .select("new_v", "u")
            .join(second, "u")
            .where("new_v != new_u")
            .select(F.least("new_v", "new_u").alias("v"), F.greatest("new_v", "new_u").alias("u"))
        )
        edges = stage(moved.distinct(), "links")
    if not moves:
        return edges.select("v", F.col("u").alias("root"))
    roots = moves.pop().withColumnRenamed("to", "root")
    while moves:
        later = roots.select(F.col("v").alias("to"), "root")
        earlier = moves.pop().join(later, "to", "left")
        here = earlier.select("v", F.coalesce("root", "to").alias("root"))
        # a vertex that moved may also have been moved to: both lead to one root
        roots = here.unionByName(roots).groupBy("v").agg(F.min("root").alias("root"))
    return roots


def components(prints: DataFrame, **options) -> DataFrame:
    """``(fp, root, first)`` for each distinct ``fp`` of the stored table
    ``prints (row_no, id, fp)``; ``first`` is the smallest (id, row_no) of the
    component."""
    # nulls are smallest in a struct, so ids get a flag before them
    row = F.struct(F.col("id").isNull().alias("none"), "id", "row_no")
    distinct = stage(prints.groupBy("fp").agg(F.min(row).alias("first")), "fingerprints")
    roots = connected(links(distinct.select("fp"), **options)).withColumnRenamed("v", "fp")
    rooted = stage(
        distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "rooted",
    )
    firsts = stage(rooted.groupBy("root").agg(F.min("first").alias("first")), "components")
    return stage(rooted.drop("first").join(firsts, "root"), "members")


def _fingerprints(texts: pa.Array, shingle: int) -> pa.Array:
    return _signed([fingerprint(x.as_py() or "", shingle) for x in texts])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per document."""

    def make():
        return lambda texts: [_fingerprints(texts, shingle)]

    # a component needs its smallest id only, so rows need no numbers here
    prints = stage(
        per_document(docs, make, "fp long").select(
            F.lit(0).alias("row_no"), F.col("doc_id").alias("id"), "fp"
        ),
        "simhash",
    )
    members = components(prints, **options)
    return prints.join(members, "fp").select(
        F.col("id").alias("doc_id"), "fp", F.col("first.id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns."""

    def of(texts: pa.Array) -> pa.Array:
        return _fingerprints(texts, shingle)

    fp = F.arrow_udf(of, "bigint")(docs["text"])
    rows = stage_rows(docs, "simhash-rows", id=docs["doc_id"], fp=fp)
    members = components(rows.select("row_no", "id", "fp"), **options)
    stays = members.where("fp = root").select(F.col("first.row_no").alias("row_no"))
    return keep_rows(rows, stays)
