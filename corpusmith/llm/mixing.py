"""Mixing sources to target weights.

Documents form a tree, such as domain, language, source. A token budget is
handed down from the root: each node divides what it got among its children by
their weights. A child never gets more than its documents hold in ``max_epochs``
passes; what it can't take goes to its siblings by weight. Only what all of them
can't take goes to their parent's siblings, as the parent's own limit is the sum
of theirs. Shares are whole tokens and add up exactly.

A leaf reads its documents in epochs. Each epoch has an order of its own, by a
hash of seed, epoch, leaf and id. Whole passes take every document; the last one
takes the documents at whose start the leaf's share is not used up yet.
``tokens_taken`` counts the tokens inside the share; texts stay whole.

The order of the last pass is found by buckets of the hash: token counts per leaf
and bucket show in which bucket the share ends, that bucket is cut again, and
only the documents of one small bucket per leaf are put in order. So a leaf may
hold any part of all rows.

Null texts count as empty. Documents without tokens are taken once per whole
pass. A null at some level is a child of its own. Children without a row in
``weights`` have weight 1, those of weight 0 get nothing. Rows with equal ids are
documents of their own, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmith.llm.common import stage_rows
from corpusmith.sources.staging import stage

SEED = 2024
_CUTS = 2


def count_words(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D."""
    runs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return runs.cast("long")


def _path(levels: list[Column]) -> Column:
    """A node's place in the tree as text; tells null from any value."""
    return F.to_json(F.array(*[x.cast("string") for x in levels]), {"ignoreNullFields": "false"})


def divide(children: DataFrame, parent: str) -> DataFrame:
    """Add ``share``: the parents' ``budget`` divided among their children.

    ``children`` is ``(parent, node, weight, capacity, budget)`` with whole
    weights. In order of capacity per weight, a child is full if an equal rate
    for it and all after it would fill it; the others share the rest by weight.
    """
    group = W.partitionBy(parent)
    weighted = F.col("weight") > 0
    rate = F.when(weighted, F.col("capacity") / F.col("weight"))
    in_order = group.orderBy(rate.asc_nulls_last(), "node")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    onward = in_order.rowsBetween(W.currentRow, W.unboundedFollowing)
    upto = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    limit = F.when(weighted, F.col("capacity")).otherwise(0)
    ranked = children.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(onward).alias("weights"),
    )
    # products of tokens and weights may pass 64 bits
    full = F.expr(
        "weight > 0 AND CAST(capacity AS DECIMAL(38,0)) * weights <= CAST(left AS DECIMAL(38,0)) * weight"
    )
    marked = ranked.withColumn("full", full)
    taken = F.when(F.col("full"), F.col("capacity")).otherwise(0)
    open_weight = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    shared = marked.select(
        "*",
        (F.col("budget") - F.sum(taken).over(group)).alias("rest"),
        F.sum(open_weight).over(group).alias("open"),
        F.sum(open_weight).over(upto).alias("upto"),
    )
    # differences of rounded cumulative shares, so that shares add up exactly
    part = F.expr(
        "CAST(rest AS DECIMAL(38,0)) * upto DIV open"
        " - CAST(rest AS DECIMAL(38,0)) * (upto - weight) DIV open"
    )
    share = F.when(F.col("full"), F.col("capacity")).when(weighted, part).otherwise(0)
    return shared.withColumn("share", F.least(share, "capacity").cast("long"))


def leaf_shares(
    leaves: DataFrame, depth: int, budget: Column, max_epochs: int, weights: DataFrame | None
) -> DataFrame:
    """``(leaf, tokens, share)`` from ``leaves (p1 … p<depth>, tokens)``.

    ``weights`` is ``(path array<string>, weight long)``, one row per node.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * F.lit(max_epochs))
    total = F.coalesce(F.sum("capacity"), F.lit(0))
    given = nodes.agg(F.lit("").alias("p0"), F.least(budget.cast("long"), total).alias("budget"))
    nodes = nodes.withColumn("p0", F.lit(""))
    for d in range(1, depth + 1):
        parent, node = f"p{d - 1}", f"p{d}"
        children = nodes.groupBy(parent, F.col(node).alias("node")).agg(
            F.sum("capacity").alias("capacity")
        )
        if weights is None:
            children = children.withColumn("weight", F.lit(1).cast("long"))
        else:
            keyed = weights.select(
                F.to_json("path", {"ignoreNullFields": "false"}).alias("node"),
                F.col("weight").cast("long"),
            )
            children = children.join(keyed, "node", "left").withColumn(
                "weight", F.coalesce("weight", F.lit(1))
            )
        shared = divide(children.join(given, parent), parent)
        given = shared.select(F.col("node").alias(node), F.col("share").alias("budget"))
    leaf = f"p{depth}"
    return nodes.select(F.col(leaf).alias("leaf"), "tokens").join(
        given.select(F.col(leaf).alias("leaf"), F.col("budget").alias("share")), "leaf"
    )


def _last_pass(slim: DataFrame) -> DataFrame:
    """``(row_no, n, passes, taken)``; ``slim`` is ``(row_no, id, leaf, n, passes,
    rest, h)``, with ``rest`` tokens to take in the last pass."""
    digits = [F.substring("h", 2 * d + 1, 2) for d in range(_CUTS)]
    edges, at = None, slim.where("rest > 0 AND n > 0")
    for d, digit in enumerate(digits):
        sums = at.groupBy("leaf", "rest", digit.alias("digit")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("leaf").orderBy("digit"))
        edge = sums.select("leaf", "digit", "rest", "n", upto.alias("upto")).where(
            "upto >= rest AND upto - n < rest"
        )
        found = edge.select(
            "leaf",
            F.col("digit").alias(f"edge{d}"),
            (F.col("rest") - F.col("upto") + F.col("n")).alias(f"rest{d}"),
        )
        edges = stage(found if edges is None else edges.join(found, "leaf"), "mix-edges")
        if d + 1 < _CUTS:
            inside = F.lit(True)
            for e in range(d + 1):
                inside = inside & (digits[e] == F.col(f"edge{e}"))
            at = (
                slim.where("n > 0")
                .drop("rest")
                .join(edges, "leaf")
                .where(inside)
                .withColumnRenamed(f"rest{d}", "rest")
            )
    joined = slim.join(edges, "leaf", "left")
    prefix = F.substring("h", 1, 2 * _CUTS)
    edge = F.concat(*[F.col(f"edge{d}") for d in range(_CUTS)])
    on_edge = F.coalesce((prefix == edge) & (F.col("n") > 0), F.lit(False))
    below = F.coalesce(prefix < edge, F.lit(False))
    order = W.partitionBy("leaf").orderBy("h", "id", "row_no")
    before = F.coalesce(
        F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    inside = F.greatest(F.lit(0), F.least("n", F.col(f"rest{_CUTS - 1}") - before))
    whole = joined.where(~on_edge).select(
        "row_no", "n", "passes", F.when(below, F.col("n")).otherwise(0).cast("long").alias("taken")
    )
    cut = joined.where(on_edge).select("row_no", "n", "passes", inside.cast("long").alias("taken"))
    return whole.unionByName(cut)


def _decide(
    rows: DataFrame,
    levels: int,
    budget: int | None,
    weights: DataFrame | None,
    max_epochs: int,
    seed: int,
) -> DataFrame:
    """``(row_no, copies, tokens_taken)`` for ``rows (row_no, id, n, p1 …)``."""
    paths = [f"p{d}" for d in range(1, levels + 1)]
    leaves = stage(rows.groupBy(*paths).agg(F.sum("n").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    goal = total if budget is None else F.lit(budget)
    shares = leaf_shares(leaves, levels, goal, max_epochs, weights)
    passes = F.expr("CASE WHEN tokens > 0 THEN share DIV tokens ELSE 0 END")
    plan = stage(
        shares.select("leaf", passes.alias("passes"), "share", "tokens").select(
            "leaf", "passes", (F.col("share") - F.col("passes") * F.col("tokens")).alias("rest")
        ),
        "mix-shares",
    )
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("passes"), "leaf", F.col("id").cast("string")))
    slim = stage(
        rows.select("row_no", "id", "n", F.col(paths[-1]).alias("leaf"))
        .join(plan, "leaf")
        .withColumn("h", h),
        "mix-rows",
    )
    return _last_pass(slim).select(
        "row_no",
        (F.col("passes") + (F.col("taken") > 0).cast("long")).alias("copies"),
        (F.col("passes") * F.col("n") + F.col("taken")).alias("tokens_taken"),
    )


def _keys(docs: DataFrame, levels: Mapping[str, Column], tokens: Column | None) -> dict[str, Column]:
    columns = list(levels.values())
    paths = {f"p{d}": _path(columns[:d]) for d in range(1, len(columns) + 1)}
    return {"id": docs["doc_id"], "n": count_words(docs["text"]) if tokens is None else tokens, **paths}


def mix_report(
    docs: DataFrame,
    levels: Mapping[str, Column],
    budget: int | None = None,
    weights: DataFrame | None = None,
    max_epochs: int = 4,
    seed: int = SEED,
    tokens: Column | None = None,
) -> DataFrame:
    """``(doc_id, leaf, tokens, copies, tokens_taken)``: one row per document.

    ``levels`` are the tree's levels from the top; ``budget`` is in tokens, by
    default as many as there are; ``tokens`` counts those of a row, by default
    its words.
    """
    keys = _keys(docs, levels, tokens)
    named = [value.alias(name) for name, value in keys.items()]
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row_no"), *named), "mix-keys")
    decided = _decide(rows, len(levels), budget, weights, max_epochs, seed)
    return rows.join(decided, "row_no").select(
        F.col("id").alias("doc_id"),
        F.col(f"p{len(levels)}").alias("leaf"),
        F.col("n").alias("tokens"),
        "copies",
        "tokens_taken",
    )


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    budget: int | None = None,
    weights: DataFrame | None = None,
    max_epochs: int = 4,
    seed: int = SEED,
    tokens: Column | None = None,
) -> DataFrame:
    """The rows of ``docs`` in the mixture, once for each pass that takes them."""
    rows = stage_rows(docs, "mix-texts", **_keys(docs, levels, tokens))
    slim = rows.drop("row")
    decided = _decide(slim, len(levels), budget, weights, max_epochs, seed)
    chosen = decided.where("copies > 0").select("row_no", "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return (
        rows.select("row_no", "row")
        .join(chosen, "row_no")
        .select("row", times.alias("copy"))
        .select("row.*")
    )
