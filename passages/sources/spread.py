"""Enough input partitions for work that costs far more than the scan."""

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of a scan out to ``partitions`` tasks if it has fewer.

    A few small files, or files of a single row group, otherwise leave one task
    with the whole of a model's or a tokenizer's work. A scan that already has
    as many partitions is returned as it is, without a shuffle. An input that shuffles
    is dealt out in any case: to ask for its partitions would run it.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    adaptive = df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan"
    return df.repartition(wanted) if adaptive or df.rdd.getNumPartitions() < wanted else df
