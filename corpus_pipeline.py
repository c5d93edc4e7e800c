"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark leaks go, personal data is
replaced, and the sources are mixed to their target weights.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and works on every row it is given. All
but the last return those columns. Null texts pass every filter; rows with a null id are judged like others; an empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import join_one, scratch, small, table, text_key, written
from ionloom.llm.decontaminate import leaking_texts
from ionloom.llm.jaccard import classed_rows
from ionloom.llm.mix import mix_sources
from ionloom.llm.pii import redact
from ionloom.llm.toxicity import learnt, without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learnt from the labels predicts to be toxic go."""
    return without_toxic(docs, learnt(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, directly or over others, one stays.

    It is the one with the smallest id, a null id being the largest; of several texts with that id the one whose key is
    smallest, and of repeated rows one, the smallest by its other columns. Texts without words all stay. An id that also
    stands on other texts says nothing of those: rows are judged by id and text.
    """
    classes = classed_rows(docs).filter("label is not null").select("doc_id", "tid", "label")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid")
    first = classes.groupBy("label").agg(F.min(order).alias("first"))
    counted = written(classes.groupBy("doc_id", "tid", "label").agg(F.count("*").alias("n")), "counted")
    judged = join_one(counted, first, "label")
    stays = F.expr("doc_id <=> first.doc_id and tid = first.tid")
    keys = written(judged.select("doc_id", "tid", "n", stays.alias("stays")).filter("not stays or n > 1"), "judged")
    marked = docs.withColumn("tid", text_key()).alias("d")
    same = F.expr("d.tid = k.tid and d.doc_id <=> k.doc_id")
    left = marked.join(small(keys).alias("k"), same, "left_anti").drop("tid")
    again = marked.join(small(keys.filter("stays")).alias("k"), same, "left_semi")
    once = again.groupBy("doc_id", "tid").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.select(*docs.columns).union(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a benchmark item go, all rows with that text and no other; null texts stay."""
    marked = docs.withColumn("tid", text_key())
    found = leaking_texts(marked.filter("text is not null").select("tid", "text"), table(spark, sf_dir, "benchmark"))
    return marked.join(small(found.select("tid").distinct()), "tid", "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes the name of its kind in square brackets; n_chars follows."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words: doc_id, source, size, source_size, target, taken."""
    return mix_sources(docs).filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("personal data", replace_personal_data),
    ("source mixing", mix),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables pass when its result stands
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
