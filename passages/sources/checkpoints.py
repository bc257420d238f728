"""Intermediate results kept in the folder that all executors share."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder that the session names in ``spark.checkpoint.dir``.

    Without one, a local session gets one next to its warehouse. On a cluster that would
    be a folder of one machine, unless the warehouse is in a shared store: an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        own_machine = folder.startswith(("file:", "/"))
        if own_machine and not context.master.startswith(("local[", "local-cluster")) and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder)


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept where the loss of an executor leaves them."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as Parquet, for rows that are read more than once and not always in full."""
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").save(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
