"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes the result of each stage below the shared checkpoint folder and reads it
again as the input of the next, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace.llm.common import Scratch, read
from daytrace.llm.langid import identify, learn_dictionaries
from daytrace.llm.lines import dedup_lines
from daytrace.llm.minhash import link_texts
from daytrace.llm.mixing import mixed_documents
from daytrace.llm.packing import pack
from daytrace.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of bytes that the best language must save against the next one.
MARGIN = 0.002


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the prediction becomes their ``lang``."""
    found = identify(docs, learn_dictionaries(docs), keep=tuple(COLUMNS), text="text", margin=MARGIN)
    return found.where(~F.col("rejected")).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars"
    )


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of nothing else go."""
    out = dedup_lines(docs, Scratch(spark, "line_dedup"))
    left = (F.col("removed") == 0) | F.col("text").rlike(r"\S")
    return out.where(left).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.  Rows without id are
    told apart by their text; of rows that repeat an id and its text one stays."""
    own = F.coalesce(F.col("doc_id"), -1 - F.shiftrightunsigned(F.xxhash64("text"), 1))
    keyed = docs.withColumn("_id", own)
    groups = link_texts(keyed, Scratch(spark, "near_dedup"), row_key="_id").where("kept").select("doc_id").distinct()
    kept = keyed.join(groups.withColumnRenamed("doc_id", "_kept"), F.col("_id") == F.col("_kept"), "left_semi")
    return kept.dropDuplicates(["_id", "text"]).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixed_documents(docs, Scratch(spark, "mixing")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 1024 tokens."""
    return pack(docs, TOKENIZER, Scratch(spark, "packing"), keep=("doc_id",))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language ID and packing have no SQL form; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
