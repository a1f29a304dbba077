"""From raw documents to packed sequences: five stages over the operators of rankloom.llm."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm import mixing, near_copies, packing, personal_data, toxicity
from rankloom.llm.common import WORD, row_key
from rankloom.session import shared_folder


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, learnt from the labels of the folder; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels, f"NOT {toxicity.HELD_OUT}")
    return scored.filter("predicted = 0").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies; of rows equal in id and text one stays.

    Texts without a word, null ones among them, are copies of nothing: all their rows stay.
    """
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    worded = docs.filter(has_words)
    kept = near_copies.near_copies(worded).filter("kept").select("key").distinct()
    found = worded.withColumn("key", row_key("doc_id", "text")).join(kept, "key")
    first = F.row_number().over(Window.partitionBy("key").orderBy("source", "lang"))
    return found.withColumn("first", first).filter("first = 1").select(*docs.columns).union(docs.filter(~has_words))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    found = personal_data.find_personal_data(docs, redact=True)
    changed = {"text": F.col("redacted"), "n_chars": F.coalesce(F.length("redacted").cast("long"), F.col("n_chars"))}
    return found.withColumns(changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more cut to the words of a partial take.

    Documents of which nothing is taken, those without a word among them, go. Rows of equal id, source and text are
    interchangeable and are matched by number.
    """
    same = Window.partitionBy("key")
    taken = mixing.mix(docs, extra=row_key("doc_id", "source", "text")).withColumn("number", F.row_number().over(same.orderBy("taken")))
    taken = taken.filter("taken > 0").select("key", "number", "taken", "size")
    numbered = docs.withColumn("key", row_key("doc_id", "source", "text")).withColumn("number", F.row_number().over(same.orderBy("n_chars", "lang")))
    found = numbered.join(taken, ["key", "number"])
    whole, part = F.expr("CAST(taken div size AS INT)"), F.expr("CAST(taken % size AS INT)")
    takes = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    found = found.withColumn("words", F.explode(takes))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("words")), " ")
    text = F.when(F.col("words") > 0, cut).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids; executors still hold what earlier stages left, so fewer words are remembered."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=250_000)


STAGES = [
    ("toxicity", keep_civil),
    ("near_copies", keep_one_of_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

ORACLE_SQL = None  # learnt scores and a tokenizer; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
