"""A training corpus from documents: five stages, each of which works on what the last one kept."""

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import passages
from passages.llm import toxicity
from passages.llm.exact import without_duplicates
from passages.llm.jaccard import shingle_components
from passages.llm.leaks import without_leaks
from passages.llm.mixing import with_copies
from passages.llm.shared import saved

# Workers need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(passages)

# Toxicity and mixing are no SQL; the stages are tested against plain versions of them.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below a half. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id."""
    return without_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more connect, the least id; rows without id stay."""
    first = shingle_components(docs).where(F.col("id") == F.col("component_id"))
    kept = docs.join(first.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, numbered by ``copy``.

    Documents that the mix leaves out are gone; none stands more than three times.
    """
    taken = with_copies(docs).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of the documents in ``sf_dir``; each stage's rows are written once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
