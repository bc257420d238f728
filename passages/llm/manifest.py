"""A Merkle manifest of a table: trees of runs of eight, kept as logs in completion order.

Builders take aligned blocks of a tree's nodes and append each node once it is complete: a
node follows its last child at once. Such a log is a postorder, and the sizes of complete
subtrees say in closed form where any node lies. A proof needs a node's neighbours in its
run, level by level; it reads them at their positions, without links between nodes.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from passages.llm.shared import saved

ARITY = 8
# A builder's block spans so many levels.
LEVELS = 4
BLOCK = ARITY**LEVELS
# Characters of a digest.
WIDTH = 64

_SEGMENTS = "tree string, block long, n long, size long, nodes binary, digest string"
_PATHS = "tree string, place long, lefts array<binary>, rights array<binary>"
_KEYS = ["tree", "block"]


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields in a row: ``-`` for null, else the bytes' number, ``:``, the value."""
    texts = [field.cast("string") for field in fields]
    sized = [F.concat(F.octet_length(text).cast("string"), F.lit(":"), text) for text in texts]
    return F.sha2(F.concat(*[F.coalesce(one, F.lit("-")) for one in sized]), 256)


def _digest(parts: bytes) -> bytes:
    return sha256(parts).hexdigest().encode()


def height(count: int) -> int:
    """Levels above ``count`` nodes until one is left."""
    levels = 0
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


def position(level: int, index: int, count: int) -> int:
    """Place in the log of node ``index`` of a level above ``count`` leaves.

    Before a leaf lie the leaves before it and every complete subtree among them; a node
    follows its last leaf by as many places as it is levels above it.
    """
    place = leaf = min((index + 1) * ARITY**level, count) - 1
    while leaf:
        leaf //= ARITY
        place += leaf
    return place + level


def append_log(leaves: list[bytes], levels: int) -> bytes:
    """The digests of all nodes up to ``levels`` above the leaves, in order of completion."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def add(level: int, node: bytes) -> None:
        log.append(node)
        waiting[level].append(node)

    def close(level: int) -> None:
        node = _digest(b"".join(waiting[level]))
        waiting[level].clear()
        add(level + 1, node)

    for leaf in leaves:
        add(0, leaf)
        level = 0
        while level < levels and len(waiting[level]) == ARITY:
            close(level)
            level += 1
    for level in range(levels):
        if waiting[level]:
            close(level)
    return b"".join(log)


def neighbours(log: bytes, count: int, levels: int) -> list[list[tuple[bytes, bytes]]]:
    """For every leaf, and every level below ``levels``, the digests before and after it in its run."""
    runs = []
    for level in range(levels):
        nodes = -(-count // ARITY**level)
        places = (position(level, index, count) for index in range(nodes))
        digests = [log[WIDTH * place : WIDTH * (place + 1)] for place in places]
        whole = [b"".join(digests[i : i + ARITY]) for i in range(0, nodes, ARITY)]
        runs.append(
            [
                (run[: WIDTH * (i % ARITY)], run[WIDTH * (i % ARITY + 1) :])
                for i, run in ((i, whole[i // ARITY]) for i in range(nodes))
            ]
        )
    return [[runs[level][leaf // ARITY**level] for level in range(levels)] for leaf in range(count)]


def _levels_in_block(n: int) -> int:
    return LEVELS if n > BLOCK else height(n)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 in each tree by ``order``, and the tree's size ``n``.

    Ranges of the sorted rows go to tasks; the sizes of a tree's ranges give where each
    starts. Rows repeated in full are dealt on by the task that read them.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    placed = saved(
        rows.withColumn("task", F.spark_partition_id())
        .repartitionByRange(ranges, *keys, "task")
        .sortWithinPartitions(*keys)
        .drop("task")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
    )
    parts = placed.groupBy("tree", "part").agg(
        F.count(F.lit(1)).alias("own"), F.min("at").alias("first")
    )
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begins = saved(
        parts.select(
            "tree",
            "part",
            (F.coalesce(F.sum("own").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("own").over(W.partitionBy("tree")).alias("n"),
        )
    )
    return (
        placed.join(begins, ["tree", "part"])
        .withColumn("rank", F.col("at") + F.col("shift"))
        .drop("at", "part", "shift")
    )


def _segments(nodes: DataFrame) -> DataFrame:
    """A builder's log of every block of ``nodes(tree, rank, n, digest)``, with its root."""

    def build(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        n = block["n"][0].as_py()
        leaves = [digest.encode() for digest in block["digest"].to_pylist()]
        log = append_log(leaves, _levels_in_block(n))
        row = {
            "tree": key[0].as_py(),
            "block": key[1].as_py(),
            "n": n,
            "size": len(leaves),
            "nodes": log,
            "digest": log[-WIDTH:].decode(),
        }
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema(
        [
            ("tree", pa.string()),
            ("block", pa.int64()),
            ("n", pa.int64()),
            ("size", pa.int64()),
            ("nodes", pa.binary()),
            ("digest", pa.string()),
        ]
    )
    blocks = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK))
    return blocks.groupBy(*_KEYS).applyInArrow(build, _SEGMENTS)


@dataclass
class Forest:
    """Logs of all trees: ``layers[k]`` has the blocks of the nodes ``4 k`` levels up.

    A layer's rows are ``tree, block, n, size, nodes, digest``: of the layer's ``n`` nodes of
    the tree a block holds ``size``, ``nodes`` is its log, and ``digest`` its root, which is a
    leaf of the next layer, or the tree's root where ``n`` is at most ``BLOCK``.
    """

    layers: list[DataFrame]

    def roots(self) -> DataFrame:
        """``tree, digest`` of every tree."""
        found = [layer.where(F.col("n") <= BLOCK).select("tree", "digest") for layer in self.layers]
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        return whole

    def with_paths(self, ends: DataFrame) -> DataFrame:
        """The blocks of the lowest layer with ``lefts, rights``, the neighbours of a block's
        root on each level above it. ``ends(tree, lefts, rights)`` go on from the roots."""
        above = None
        for layer in reversed(self.layers):
            top = layer.where(F.col("n") <= BLOCK).join(ends, "tree")
            if above is not None:
                inner = layer.where(F.col("n") > BLOCK)
                top = top.unionByName(inner.join(above, _KEYS))
            if layer is self.layers[0]:
                return top
            above = saved(paths(top).withColumnRenamed("place", "block"))
        raise AssertionError("a forest has a layer")


def build_forest(nodes: DataFrame) -> Forest:
    """Logs of the trees over ``nodes(tree, rank, n, digest)``, layer by layer.

    A block has at most ``BLOCK`` nodes, however large its tree, and a layer has a
    ``BLOCK``-th of the nodes of the one below, so three layers hold 68 billion nodes.
    """
    layers = []
    while True:
        layers.append(saved(_segments(nodes)))
        inner = layers[-1].where(F.col("n") > BLOCK)
        if inner.isEmpty():
            return Forest(layers)
        size = F.ceil(F.col("n") / BLOCK)
        nodes = inner.select("tree", F.col("block").alias("rank"), size.alias("n"), "digest")


def paths(blocks: DataFrame) -> DataFrame:
    """``tree, place, lefts, rights`` of every leaf of ``blocks``, read from their logs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = neighbours(row["nodes"], row["size"], _levels_in_block(row["n"]))
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "tree": row["tree"],
                            "place": BLOCK * row["block"] + leaf,
                            "lefts": [left for left, _ in own] + row["lefts"],
                            "rights": [right for _, right in own] + row["rights"],
                        }
                        for leaf, own in enumerate(found)
                    ],
                    schema,
                )

    both = pa.list_(pa.binary())
    schema = pa.schema(
        [("tree", pa.string()), ("place", pa.int64()), ("lefts", both), ("rights", both)]
    )
    return blocks.mapInArrow(read, _PATHS)


def _no_path(name: str) -> Column:
    return F.array().cast("array<binary>").alias(name)


@dataclass
class Manifest:
    """``leaves(id, tree, rank, n, leaf, claim)``, the logs of their trees, and one over the
    trees' ``roots(rank, name, digest)``."""

    leaves: DataFrame
    trees: Forest
    roots: DataFrame
    top: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """``id, leaf, subroot, root, proof, folded, verified`` of every leaf.

        ``proof`` is the digest of all neighbours from the leaf to the root, ``folded`` the
        root that follows from the claimed leaf (from the leaf itself where none is claimed)
        and the logs' neighbours, ``verified`` whether it is the root.
        """
        session = self.leaves.sparkSession
        none = session.range(1).select(F.lit("").alias("tree"), _no_path("lefts"), _no_path("rights"))
        names = self.roots.select("rank", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
        ends = paths(self.top.with_paths(none)).select(F.col("place").alias("rank"), "lefts", "rights")
        ends = saved(ends.join(names, "rank").drop("rank"))
        blocks = self.trees.with_paths(ends.drop("subroot")).join(ends.select("tree", "subroot"), "tree")
        root = self.root

        def prove(leaves: pa.Table, logs: pa.Table) -> pa.Table:
            # The log is read at the leaves' places, which need no order.
            log = logs.to_pylist()[0]
            near = neighbours(log["nodes"], log["size"], _levels_in_block(log["n"]))
            above = list(zip(log["lefts"], log["rights"], strict=True))
            upper = b"".join(left + right for left, right in above)
            rows = []
            columns = (leaves[name].to_pylist() for name in ("rank", "leaf", "claim"))
            for rank, leaf, claim in zip(*columns, strict=True):
                own = near[rank % BLOCK]
                proof = _digest(b"".join(left + right for left, right in own) + upper)
                node = (claim or leaf).encode()
                for left, right in [*own, *above]:
                    node = _digest(left + node + right)
                folded = node.decode()
                rows.append((leaf, log["subroot"], root, proof.decode(), folded, folded == root))
            arrays = [pa.array(column) for column in zip(*rows, strict=True)]
            names = ["leaf", "subroot", "root", "proof", "folded", "verified"]
            return pa.table([leaves["id"], *arrays], ["id", *names])

        text = ("leaf", "subroot", "root", "proof", "folded")
        schema = StructType(
            [self.leaves.schema["id"], *[StructField(name, StringType()) for name in text]]
        ).add("verified", "boolean")
        leaves = self.leaves.withColumn("block", F.floor(F.col("rank") / BLOCK))
        return (
            leaves.groupBy(*_KEYS).cogroup(blocks.groupBy(*_KEYS)).applyInArrow(prove, schema)
        )


def manifest(
    leaves: DataFrame,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    leaf_col: str = "leaf",
    claim_col: str | None = None,
) -> Manifest:
    """The manifest of ``leaves``: a tree per value of ``tree_col``, and one over their roots.

    A tree's leaves ascend by id (null first, then by digest), trees by their name as UTF-8
    bytes (null first). On each level every eight consecutive nodes, the last ones fewer,
    become the digest of their digests, until one node is left. ``claim_col`` may hold the
    digest a leaf is claimed to have, which the proofs then use in place of its own.

    Rows repeated in full are leaves of their own. An empty table has no root and no proofs.
    Other columns are left out.
    """
    claim = F.col(claim_col) if claim_col else F.lit(None)
    # A name of its own for null, which sorts first and joins like any other.
    name = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    rows = leaves.select(
        F.col(id_col).alias("id"),
        name.alias("tree"),
        F.col(leaf_col).alias("leaf"),
        claim.cast("string").alias("claim"),
    )
    rows = _numbered(rows, ["id", "leaf"])
    trees = build_forest(rows.withColumnRenamed("leaf", "digest").select("tree", "rank", "n", "digest"))
    roots = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    roots = saved(_numbered(roots, ["name"]))
    top = build_forest(roots.select("tree", "rank", "n", "digest"))
    root = top.roots().first()  # one row at most
    return Manifest(rows, trees, roots, top, root["digest"] if root else None)
