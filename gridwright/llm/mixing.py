"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source); a domain is a source's name up to its first digit. A
budget of tokens goes from the root to domains, to their languages and to their sources, at
each node in proportion to its children's weights. A child can't take more than its subtree
holds, `epochs` times over: what it can't take goes to its siblings, by their weights again,
and only what no sibling can take stays with the parents, whose own siblings have taken it.

A leaf's budget is whole epochs and a rest. An epoch has all its documents; the rest is the
longest prefix that fits, of the documents in the order of a hash of seed, epoch and doc_id.
Prefix sums are found in two steps: 4096 ranges of the hash by their sums, and then the
documents of the one range in which the rest ends. So no task orders a whole leaf: the window
over a leaf has a row for each range, 4096 at most, and that over documents one range's.

Tokens are words. Weights are given by node, as {("src",): 2.0, ("src", "en"): 3.0,
("src", "en", "src1"): 0.5}, and 1 where they aren't.

Defined cases. Null languages and sources are leaves named "". Null text has no tokens; such
rows are in every whole epoch, and in a prefix that reaches their place. A long text counts whole:
a prefix that it doesn't fit into ends before it. Repeated rows are rows of their own, beside each
other in the order. A weight of 0 excludes a node. Equal hashes go by doc_id and row. Other columns
are carried by `mixed_documents`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridwright.llm.common import cut, packed, read, unpacked, words_of
from gridwright.llm.simhash import with_uid

LEVELS = ["domain", "lang", "source"]
SHARE = 0.9
EPOCHS = 4
SEED = 17
BLOCK_BITS = 12


def _leaf_columns(text: str) -> dict:
    """domain, lang, source, tokens of a document."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"domain": F.regexp_extract(source, r"^[^0-9]*", 0), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source, "tokens": F.size(words_of(F.col(text))).cast("long")}


def leaves_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """uid, doc_id, domain, lang, source, tokens of every row of `docs`, which needs `uid`."""
    return docs.select("uid", F.col(doc_id).cast("long").alias("doc_id"), *[c.alias(n) for n, c in _leaf_columns(text).items()])


def _weighted(nodes: DataFrame, path: list[str], weights: dict[tuple[str, ...], float]) -> DataFrame:
    """`nodes` with their weights. Weights are settings, so their table is as small as these."""
    given = [(*k, float(v)) for k, v in weights.items() if len(k) == len(path)]
    if not given:
        return nodes.withColumn("weight", F.lit(1.0))
    table = nodes.sparkSession.createDataFrame(given, ", ".join([*(f"{c} string" for c in path), "weight double"]))
    return nodes.join(F.broadcast(table), path, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`nodes` (parent, name, capacity, weight, given) with `budget`: what each takes of what its parent has been given.

    In the order of capacity / weight, a child is full as long as an equal level of the rest,
    by weight, is above its capacity; the others share what is left.
    """
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0).alias("root"))
    ordered = by.orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), name)
    before = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = nodes.withColumn("level", F.try_divide(F.col("given") - before, rest))
    full = F.col("weight") * F.col("level") >= F.col("capacity")
    # the first that isn't full has the highest level of those that aren't
    share = F.max(F.when(~full, F.col("level"))).over(by)
    return level.withColumn("budget", F.when(F.col("weight") <= 0, 0.0).when(full, F.col("capacity")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * share))).drop("level")


def budgets(rows: DataFrame, total: int | None = None, share: float = SHARE, epochs: int = EPOCHS, weights: dict[tuple[str, ...], float] | None = None) -> DataFrame:
    """domain, lang, source, held (tokens), budget (whole tokens) of each leaf; the budget is `total`, or `share` of all tokens."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("held"))
    nodes = leaves.withColumn("capacity", F.col("held").cast("double") * epochs)
    whole = F.lit(float(total)) if total is not None else F.floor(F.sum("held").over(W.partitionBy(F.lit(0).alias("root"))) * share).cast("double")
    given = nodes.withColumn("given", whole)
    for depth in range(len(LEVELS)):
        path = LEVELS[: depth + 1]
        children = given.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first("given").alias("given"))
        taken = filled(_weighted(children, path, weights or {}), path[:-1], path[-1]).select(*path, F.col("budget").alias("__given"))
        given = given.join(taken, path).drop("given").withColumnRenamed("__given", "given")
    # a rounding error must not take a token from a leaf that is full
    return given.select(*LEVELS, "held", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def _hashed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """`rows` with their leaf's plan, and the hash and its range that place them in the order of the epoch that the rest is taken from."""
    placed = rows.join(plan, LEVELS).withColumn("hash", F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id")))
    return placed.withColumn("block", F.shiftrightunsigned("hash", 64 - BLOCK_BITS))


def plans(rows: DataFrame, total: int | None, share: float, epochs: int, seed: int, weights: dict[tuple[str, ...], float] | None) -> DataFrame:
    """domain, lang, source, whole (epochs), rest (tokens), and where the rest ends: edge (range of the hash, null beyond all) and before (tokens of the ranges before it).

    A row for each leaf, written, so that documents are never shuffled to meet it unless leaves are very many.
    """
    leaf = cut(budgets(rows, total, share, epochs, weights), "leaf-budgets")
    whole = F.when(F.col("held") > 0, F.floor(F.col("budget") / F.col("held"))).otherwise(epochs).cast("long")
    planned = leaf.withColumn("whole", F.least(whole, F.lit(epochs).cast("long"))).withColumn("rest", F.when(F.col("held") > 0, F.col("budget") - F.col("whole") * F.col("held")).otherwise(0)).drop("held", "budget")
    sums = _hashed(rows, planned, seed).groupBy(*LEVELS, "rest", "block").agg(F.sum("tokens").alias("n"))
    # a row for each range of a leaf: 4096 at most, whatever the documents
    up_to = W.partitionBy(*LEVELS).orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = sums.withColumn("end", F.sum("n").over(up_to)).where(F.col("end") > F.col("rest"))
    edge = ends.groupBy(*LEVELS).agg(F.min("block").alias("edge"), F.min_by(F.col("end") - F.col("n"), "block").alias("before"))
    return cut(planned.join(edge, LEVELS, "left"), "leaf-plans")


def with_copies(rows: DataFrame, plan: DataFrame, epochs: int, seed: int) -> DataFrame:
    """`rows` (uid, doc_id, LEVELS, tokens, and any others) with copies: how many epochs take the row, 1 at least.

    Only rows of the range in which a leaf's rest ends are ordered; all others stay where they are.
    """
    known = _hashed(rows, plan, seed)
    cut_off = F.coalesce(F.col("block") == F.col("edge"), F.lit(False))
    sure = known.where(~cut_off).withColumn("extra", (F.col("edge").isNull() | (F.col("block") < F.col("edge"))).cast("int"))
    order = W.partitionBy(*LEVELS, "block").orderBy(F.shiftrightunsigned("hash", 1), "hash", "doc_id", "uid").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = known.where(cut_off).withColumn("extra", (F.col("before") + F.sum("tokens").over(order) <= F.col("rest")).cast("int"))
    taken = sure.unionByName(ordered)
    copies = F.least(F.col("whole") + F.col("extra"), F.lit(epochs).cast("long")).cast("int")
    return taken.select(*rows.columns, copies.alias("copies")).where("copies > 0")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", total: int | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[tuple[str, ...], float] | None = None) -> DataFrame:
    """uid, doc_id, domain, lang, source, tokens, copies (how many epochs take the row, 1 at least). `docs` needs `uid`."""
    rows = cut(leaves_of(docs, text, doc_id), "leaf-rows")
    return with_copies(rows, plans(rows, total, share, epochs, seed, weights), epochs, seed)


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", total: int | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[tuple[str, ...], float] | None = None) -> DataFrame:
    """The selected rows of `docs`, all columns as they are, once for each epoch that takes them. `docs` has a lang and a source."""
    top = [F.col(c).alias(c) for c in ("lang", "source")]
    numbered = cut(packed(docs, F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), *top, keep=[text]), "mix-input")
    rows = numbered.select("uid", "doc_id", "c0", F.struct("rest").alias("payload"), *[c.alias(n) for n, c in _leaf_columns("c0").items()])
    known = cut(rows.select("uid", "doc_id", *LEVELS, "tokens"), "leaf-rows")
    plan = plans(known, total, share, epochs, seed, weights)
    chosen = with_copies(rows, plan, epochs, seed).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return unpacked(chosen.select("c0", "payload.rest"), docs.columns, [text])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = cut(with_uid(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), "mix-input")
    return mix(numbered).drop("uid")
