"""From raw documents to packed training sequences, stage by stage.

Each stage reads what the one before kept, as written to Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beliefmill.llm import language_id, order_minhash, run_index, vector_packing
from beliefmill.llm.queries import tokenizer
from beliefmill.session import pin

#: Rows of whole texts that Spark hands to a Python worker at once, at most. Spark's default of
#: 10,000 is held several times over, by the worker and in the JVM's direct memory.
ARROW_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep batches of texts small from here on; a smaller bound of the session stands."""
    given = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, str(min(given, ARROW_ROWS) if given > 0 else ARROW_ROWS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language codes well; those without a letter or language go."""
    bound_batches(spark)
    return language_id.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id."""
    bound_batches(spark)
    return order_minhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long strings that also occur elsewhere."""
    bound_batches(spark)
    return run_index.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in training sequences."""
    bound_batches(spark)
    return vector_packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("repeats", without_repeats), ("packing", packed)]

#: SQL can express neither the language model nor the sketches and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
