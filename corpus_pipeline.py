"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and other columns are left out. Rows with null
texts or ids pass the filters, repeated rows share their fate, texts are read
whole, and an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.common import shared_dir
from driftgrid.llm.near_duplicates import keep_one_of_each
from driftgrid.llm.packing import pack
from driftgrid.llm.pseudonyms import pseudonymize
from driftgrid.llm.queries import PII_KEY, mixed, tokenizer_path, toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity_scores(spark, docs.select(*COLUMNS), sf_dir).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one_of_each(docs.select(*COLUMNS))


def hide_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; n_chars follows the text."""
    return pseudonymize(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights draw them."""
    return mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", hide_private_values),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: The stages use a trained model and tokenizers; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    What a stage returns is written to the shared folder and read again; then
    what the stage before it has written is removed.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                fs, place = FileSystem.from_uri(before)
                fs.delete_dir(place)
            before = path
    return docs
