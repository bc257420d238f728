"""Connected components of a graph given by its links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.shared import saved


def _stars(links: DataFrame, node: str, to: str) -> DataFrame:
    least = links.groupBy(node).agg(F.least(F.min(to), F.col(node)).alias("least"))
    return links.join(least, node)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links(a, b)``; the root is the least of a component.

    Large and small stars in turn: each node hands its larger neighbours, then its smaller
    ones, to the least node it knows, until nothing changes. A star with very many nodes
    is summed up per task before its least node is sought, and adaptive execution splits
    the join that hands it back. Each step is written, so none depends on an executor.
    """
    one_way = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).alias("l")
    state = saved(links.where("a != b").select(one_way).select("l.*").distinct())
    before = None
    while True:
        size = state.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if size == before or not size[0]:
            break
        before = size
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = saved(large.where("u != v").distinct())
        small = _stars(large, "u", "v")
        state = saved(
            small.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(small.select("u", F.col("least").alias("v")))
            .where("u != v")
            .distinct()
        )
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
