"""A corpus pipeline: toxicity, language ID, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns of docs.
An empty table stays empty through every stage; rows with null or empty texts pass the toxicity filter, and language
ID rejects them, as they have no letter. Repeated rows count as documents until near-dedup leaves one of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import langmix, lshforest, mixing, packing, toxicity
from lectern.llm.names import renamed
from lectern.session import checkpointed, ship, table

#: SQL can't express the classifiers.
ORACLE_SQL = None
#: A document whose main language holds a smaller share than this has no language.
LEAST_SHARE = 0.5


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by the classifier learned from the labelled ones."""
    docs, back = renamed(docs, "doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns))
    return back(scored.where("predicted = 0").select(*docs.columns))


def with_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, one of whose languages holds half of the text or more.

    Where no document has a language to learn from, all documents stay.
    """
    ship(spark)
    docs, back = renamed(docs, "doc_id", "text", "lang")
    model = langmix.learn(docs, F.lit(True))
    if not model.languages:
        return back(docs)
    found = langmix.identify(docs, model, keep=tuple(docs.columns))
    main = F.get("lang_set", F.lit(0))["share"]
    return back(found.where((F.col("lang_pred") != "und") & (main >= LEAST_SHARE)).select(*docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more."""
    ship(spark)
    return lshforest.deduplicate(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that training takes a document, in training order, sources weighing 1, 2, 3 in turn."""
    ship(spark)
    return mixing.mixed_rows(docs, mixing.in_turn, mixing.word_count(F.col("text")))


def training_order(docs: DataFrame) -> list[Column]:
    """The order in which the rows were written: by file and row where they are read from Parquet files, else as they come."""
    try:
        at = docs.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        assert at.columns == ["file", "row"]
    except AnalysisException:  # no files, or none with row numbers
        return [F.monotonically_increasing_id()]
    return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's length bucket, batch and place in the batch; batches follow the training order of the rows."""
    ship(spark)
    return packing.pack(docs, mixing.word_count(F.col("text")), order=training_order(docs))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("language ID", with_a_language),
    ("near-dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
