"""Difference of two large tables by their keys: only where fingerprints differ are rows compared."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.operators.compare import frame_diff, round_numbers, same_schema
from passages.sources.checkpoints import materialised

# Bits of a key's hash that each level of the tree goes by, and the most levels.
BITS, LEVELS = 12, 4
# Rows below differing nodes from which another level is asked for.
MOST_ROWS = 1 << 20
# Nodes that are broadcast; more are joined as they are.
BROADCAST_NODES = 1 << 20

_SUMS = ("copies", "one", "other")


def _hash(columns: list[str], seed: int) -> Column:
    # Nulls leave a hash as it is, so which columns are null is hashed as well.
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *values, *[v.isNull() for v in values])


def _node(level: int, bits: int) -> Column:
    return F.shiftrightunsigned("__key", 64 - bits * level).alias("__node")


def differing_nodes(signed: DataFrame, level: int, bits: int) -> DataFrame:
    """``__node, rows`` of the nodes of a level whose fingerprints differ.

    A node's fingerprint adds up the signed copies of its rows and two hashes of each, so
    that it depends neither on their order nor on how they are spread over tasks.
    """
    sums = [F.sum(F.col("__sign")).alias("copies")]
    for name in ("one", "other"):
        sums.append(F.sum(F.col("__sign") * F.col(f"__{name}").cast("decimal(20)")).alias(name))
    nodes = signed.groupBy(_node(level, bits)).agg(F.count(F.lit(1)).alias("rows"), *sums)
    differ = " or ".join(f"{name} <> 0" for name in _SUMS)
    return nodes.where(differ).select("__node", "rows")


def keyed_diff(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    digits: int | None = None,
    bits: int = BITS,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """As ``frame_diff``: rows that occur more often on one side, with ``side`` and ``copies``.

    Rows are leaves of a tree by the hash of their ``keys``, of ``2 ** bits`` branches a
    level. A level's fingerprints are sums, one row per node and task in the shuffle; below
    nodes that differ the next level is asked for, until they hold at most ``most_rows``
    rows or ``LEVELS`` are reached. Only rows below differing nodes are shuffled and
    compared as rows, so what is moved follows the difference, not the tables. Two
    different sets of rows are told apart by 128 bits. A null key is a key; rows may repeat.
    """
    if not same_schema(left, right):
        raise ValueError(f"schemas differ: {left.dtypes} and {right.dtypes}")
    if not keys:
        raise ValueError("no keys")
    if not 1 <= bits <= 64 // LEVELS:
        raise ValueError(f"bits must be between 1 and {64 // LEVELS}")
    if digits is not None:
        left, right = round_numbers(left, digits), round_numbers(right, digits)
    columns = left.columns
    marks = {"__key": _hash(keys, 0), "__one": _hash(columns, 1), "__other": _hash(columns, 2)}
    left, right = left.withColumns(marks), right.withColumns(marks)
    level, nodes = 0, None

    def below(rows: DataFrame) -> DataFrame:
        return rows if nodes is None else rows.join(nodes, _node(level, bits) == F.col("__node"), "left_semi")

    while level < LEVELS:
        signed = below(left).withColumn("__sign", F.lit(1)).unionAll(below(right).withColumn("__sign", F.lit(-1)))
        found = materialised(differing_nodes(signed, level + 1, bits))
        level += 1
        size = found.agg(F.count(F.lit(1)).alias("nodes"), F.sum("rows").alias("rows")).first()
        nodes = found.select("__node")
        if size["nodes"] <= BROADCAST_NODES:
            nodes = F.broadcast(nodes)
        if (size["rows"] or 0) <= most_rows:
            break
    return frame_diff(below(left).select(*columns), below(right).select(*columns))
