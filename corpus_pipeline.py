"""A corpus pipeline over the documents table: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return docs'
columns.  run() writes each stage's rows as Parquet in the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegrammar.llm import decontaminate, language, mixing, similar, tokens
from treegrammar.llm.common import cut, held, read

LEAST_SHARE = 0.3  # of a document's letters that its language must hold
LIKE_WORDS, LIKE_SHARE = 5, 0.8  # words of a shingle, and the share of two texts' shingles in common that makes them copies


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no letters, or no learned language with a fair share of them); a null lang takes the prediction."""
    model = language.learn(docs, ~held(F.col("doc_id"), 3, 1))
    return language.keep_languages(docs, model, LEAST_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share 0.8 of their five-word shingles: the one with the least id (null ids last); repeated rows are one document.

    A row is known by its id and two hashes of its text.  Texts that share the first hash only are told apart by the second and stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))  # not null
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), doc.alias("doc"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("again"), text).alias("h2"), text.alias("text"))
    keys = cut(spark, keyed.select("id", "doc", "h", "h2").distinct(), "rows")
    groups = similar.similar_texts(keyed.select(F.col("h").alias("row"), "text"), LIKE_WORDS, LIKE_SHARE)
    clash = keys.groupBy("h").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).where("low <> high").select(F.col("h").alias("two"))
    named = keys.join(groups, F.col("h") == F.col("node"), "left").join(clash, F.col("h") == F.col("two"), "left")
    component = [F.coalesce("root", "h").alias("component"), F.when(F.col("two").isNotNull(), F.col("h2")).alias("own")]
    first = named.groupBy(*component).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "h2", "doc")).alias("first"))
    keep = first.select("first.doc", "first.h", "first.h2")
    return keyed.drop("text").join(keep, ["doc", "h", "h2"]).dropDuplicates(["doc", "h", "h2"]).select("row.*")


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: once for each pass over their source, cut to the words taken."""
    mixed = mixing.mixed_texts(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the ranked token files."""
    return tokens.token_output(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: SQL can express neither Viterbi labels, XXH64 fingerprints nor BPE; tests/llm/test_pipeline.py holds run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(spark, stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
