"""One query per operator, over the whole of its table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.chat import conversations
from passages.llm.divergence import divergence
from passages.llm.exact import ascii_lower, exact_duplicates
from passages.llm.extraction import extract
from passages.llm.jaccard import shingle_components
from passages.llm.leaks import leaks
from passages.llm.licences import licences
from passages.llm.manifest import leaf_digest, manifest
from passages.llm.mixing import mixed
from passages.llm.packing import packed
from passages.llm.substrings import without_repeats
from passages.llm import toxicity
from passages.llm.suffixes import without_repeats as without_repeated_bytes


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(_table(spark, folder, "documents"), length=35)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op2_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(_table(spark, folder, "conversations")).withColumnsRenamed(
        {"conv": "conv_id"}
    )


def op3_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(_table(spark, folder, "documents"), keep="largest")
    return found.withColumnsRenamed({"id": "doc_id", "digest": "text_sha256"})


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    found = toxicity.scores(docs, model)
    return found.select(
        F.col("id").alias("doc_id"),
        toxicity.held_out(F.col("id")).alias("held_out"),
        "score",
        "predicted",
    )


def op5_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op6_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeated_bytes(_table(spark, folder, "documents"), length=200)
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixed(_table(spark, folder, "documents")).drop("hash")
    return found.withColumnRenamed("id", "doc_id")


def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences(_table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "line", "n_lines", "licence", F.round("dice", 6).alias("dice"), "n_bigrams"
    )


def op10_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = extract(_table(spark, folder, "pages"))
    return found.select(
        F.col("id").alias("page_id"),
        "url",
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
    )


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = packed(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnsRenamed(
        {"id": "doc_id", "crc": "ids_crc32", "sequence": "sequence_id"}
    )


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    known = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        "doc_id",
        "lang",
        leaf_digest(*known, F.col("text")).alias("leaf"),
        F.when(altered, leaf_digest(*known, ascii_lower(F.col("text")))).alias("claim"),
    )
    found = manifest(leaves, claim_col="claim").proofs()
    return found.withColumnsRenamed(
        {"id": "doc_id", "proof": "proof_sha256", "folded": "folded_root"}
    )


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(_table(spark, folder, "documents"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_conversations": op2_conversations,
    "op3_exact_duplicates": op3_exact_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_leaks": op5_leaks,
    "op6_suffixes": op6_suffixes,
    "op7_mixing": op7_mixing,
    "op8_jaccard": op8_jaccard,
    "op9_licences": op9_licences,
    "op10_extraction": op10_extraction,
    "op11_packing": op11_packing,
    "op12_manifest": op12_manifest,
    "op13_divergence": op13_divergence,
}
