"""What changed between full snapshots: Merkle trees over hash ranges of the keys.

Every snapshot's rows go into hash ranges of their key. A range's digest is the triple
(count, sum, xor) over its rows' 64-bit digests, so it is order-free and combines upwards
by the same aggregates. The tree of every snapshot is written as one narrow table by
level. Neighbouring snapshots are compared from the root down: of each level only the
children of nodes that differ are read on, and only rows in differing leaf ranges are
compared one by one.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import write_shared

FANOUT_BITS = 4
LEAF_KEYS = 16  # keys a leaf holds on average


def tree_depth(keys: int, leaf_keys: int = LEAF_KEYS) -> int:
    """Levels below the root at which a leaf of a tree over so many keys holds about ``leaf_keys``; at most 12."""
    return min(12, max(1, ceil(log(max(1, keys / leaf_keys), 2**FANOUT_BITS))))


def _combined(*by) -> list[Column]:
    return [F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"), F.bit_xor("__xor").alias("__xor")]


def merkle_tree(base: DataFrame, depth: int) -> DataFrame:
    """(__level, __snap, __node, __n, __sum, __xor) of all nodes; ``base`` has __snap, __range (of the leaves) and __digest."""
    one = base.select("__snap", F.col("__range").alias("__node"), F.lit(1).cast("bigint").alias("__n"), F.col("__digest").cast("decimal(38,0)").alias("__sum"), F.col("__digest").alias("__xor"))
    leaves = write_shared(one.groupBy("__snap", "__node").agg(*_combined()).withColumn("__sum", F.col("__sum").cast("decimal(38,0)")), "leaves")
    up = F.explode(F.sequence(F.lit(1), F.lit(depth - 1))) if depth > 1 else F.explode(F.array().cast("array<int>"))
    inner = leaves.withColumn("__level", up).withColumn("__node", F.expr(f"shiftright(__node, {FANOUT_BITS} * ({depth} - __level))"))
    inner = inner.groupBy("__level", "__snap", "__node").agg(*_combined()).withColumn("__sum", F.col("__sum").cast("decimal(38,0)"))
    return write_shared(inner.unionByName(leaves.withColumn("__level", F.lit(depth))), "tree", ["__level"])


def _sides(rows: DataFrame, last: int) -> DataFrame:
    """Rows of snapshot number __snap as the new side (1) of the pair before it and the old side (0) of the pair after it."""
    pair = F.explode(F.array(F.struct((F.col("__snap") - 1).alias("p"), F.lit(1).alias("s")), F.struct(F.col("__snap").alias("p"), F.lit(0).alias("s"))))
    return rows.withColumn("__x", pair).withColumn("__pair", F.col("__x.p")).withColumn("__side", F.col("__x.s")).drop("__x").where(F.col("__pair").between(0, last))


def descend(tree: DataFrame, depth: int, pairs: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each level from the top, the nodes compared (children of differing ones) and those that differ, as (__pair, __node)."""
    steps: list[tuple[DataFrame, DataFrame]] = []
    for level in range(1, depth + 1):
        nodes = _sides(tree.where(F.col("__level") == level), pairs - 1)
        if steps:
            above = steps[-1][1].select("__pair", F.col("__node").alias("__above"))
            nodes = nodes.withColumn("__above", F.shiftright("__node", FANOUT_BITS)).join(above, ["__pair", "__above"], "left_semi")
        both = nodes.groupBy("__pair", "__node").agg(F.count(F.lit(1)).alias("__sides"), *[f(c).alias(f"{c}{k}") for c in ("__n", "__sum", "__xor") for k, f in ((0, F.min), (1, F.max))])
        differs = (F.col("__sides") < 2) | (F.col("__n0") != F.col("__n1")) | (F.col("__sum0") != F.col("__sum1")) | (F.col("__xor0") != F.col("__xor1"))
        steps.append((both.select("__pair", "__node"), both.where(differs).select("__pair", "__node")))
    return steps


def merkle_diff(rows: DataFrame, snapshot: str, key: str, digest: Column, snapshots: list, depth: int | None = None, keys: int | None = None) -> DataFrame:
    """Rows of consecutive snapshots that are added, removed or differ in digest.

    rows: one row per (snapshot, key). snapshots: the snapshot values in order (their
    number is that of the deliveries, not of the rows). keys: how many keys a snapshot
    holds at most, counted if not given; unless ``depth`` is given, the depth of the trees
    follows from it, so that a leaf holds about LEAF_KEYS keys at any size. What differs
    between two snapshots opens its leaves only; a side of a join is broadcast only where
    its known size allows.

    Result: one row per (old_snapshot, new_snapshot, key) with change ``added``,
    ``removed`` or ``differs``. Fewer than two snapshots give no rows. A null key is a
    key of its own; a null digest equals only a null digest. Values of ``snapshot``
    that are not listed are ignored.
    """
    if depth is None and keys is None:
        keys = max((r[0] for r in rows.groupBy(snapshot).count().select("count").collect()), default=0)  # one row per delivery
    depth = depth or tree_depth(keys)
    listed = F.array(*[F.lit(s) for s in snapshots]).cast(f"array<{dict(rows.dtypes)[snapshot]}>")
    base = rows.select(
        (F.array_position(listed, F.col(snapshot)) - 1).cast("int").alias("__snap"),
        F.col(key).alias("__key"),
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(17)), 64 - FANOUT_BITS * depth).alias("__range"),
        F.xxhash64(F.col(key), digest).alias("__digest"),
    ).where("__snap >= 0")
    tree = merkle_tree(base, depth)
    open_leaves = write_shared(descend(tree, depth, len(snapshots) - 1)[-1][1].withColumnRenamed("__node", "__range"), "open")
    kept = _sides(base, len(snapshots) - 2).join(open_leaves, ["__pair", "__range"], "left_semi")
    out = kept.groupBy("__pair", "__key").agg(F.min("__side").alias("lo"), F.max("__side").alias("hi"), F.min("__digest").alias("d0"), F.max("__digest").alias("d1"))
    change = F.when(F.col("lo") == 1, "added").when(F.col("hi") == 0, "removed").when(F.col("d0") != F.col("d1"), "differs")
    at = lambda i: F.get(listed, i.cast("int"))
    return out.select(at(F.col("__pair")).alias("old_snapshot"), at(F.col("__pair") + 1).alias("new_snapshot"), F.col("__key").alias("key"), change.alias("change")).where("change IS NOT NULL")
