"""Search results: one row ``query_id, id, distance`` per question and vector found."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def hit_schema(questions: DataFrame, vectors: DataFrame) -> StructType:
    return StructType(
        [
            StructField("query_id", questions.schema["query_id"].dataType),
            StructField("id", vectors.schema["id"].dataType),
            StructField("distance", DoubleType()),
        ]
    )


def rank_schema(hits: StructType) -> StructType:
    return StructType([*hits.fields, StructField("rank", IntegerType())])


# Tasks' hits of a question meet in so many places first.
MERGES = 64


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits per question, numbered from 1, by distance and then id.

    Each task first cuts its own to k, and the hits of one question from very many tasks
    are cut again in ``MERGES`` places before they meet in one.
    """
    order = ("distance", "id")
    place = F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("__place")
    part = Window.partitionBy("query_id", "__place").orderBy(*order)
    cut = hits.select("*", place).withColumn("rank", F.row_number().over(part))
    cut = cut.where(F.col("rank") <= k).drop("rank", "__place")
    whole = Window.partitionBy("query_id").orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
