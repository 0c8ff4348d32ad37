"""Corpus preparation in five stages: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last return the
columns of documents; other columns of their input are not passed on, whatever their names. An empty table gives an empty
result in every stage. Null, empty and very long texts, ties and repeated rows have the results that each stage states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.llm import jaccard, mixing, packing, personal_data, quality
from pathweave.llm.cluster import join_hot, materialize, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling on the quality labels; documents that it rejects go.

    Null and empty texts weigh as an average text and stay; rows with equal ids and texts stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs.select(*COLUMNS), labels)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id.

    Rows that share an id count as one document, of which the row with the least hash of its text stays. Rows without an id,
    and texts without words, link with nothing and stay (of the latter one row an id).
    """
    classes = jaccard.near_duplicate_classes(docs, shingle=5, percent=80)
    kept = classes.where("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    first = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("nth = 1")
    return first.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and ``n_chars`` counts what is left. Null texts stay null; every row stays."""
    found = personal_data.find_spans(docs, keep=COLUMNS)
    text = F.when(F.col("row.text").isNotNull(), personal_data.masked(F.col("row.text")))
    return found.select("row.*", text.alias("masked")).withColumn("text", F.col("masked")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: each row stands as often as the mix takes it, which may be never.

    Null and empty texts have no words and are taken like any document. Of rows with equal id, source and size the mix says
    how many stand once more; these are the first by a number that counts them, so no such group is sorted in one task.
    """
    keys = ["id", "no_id", "src", "no_src", "words"]

    def keyed(doc_id, source, words):
        return [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("no_src"), words.cast("long").alias("words")]

    mix = mixing.drawn_mix(docs)
    mix = mix.select(*keyed(F.col("doc_id"), F.col("source"), F.col("size")), "m", "whole", "more")
    rows = docs.select(*COLUMNS, *keyed(F.col("doc_id"), F.col("source"), mixing.word_count(F.col("text"))), F.spark_partition_id().alias("part"))
    # Three readers follow, one of which mostly finds nothing: the texts are shuffled once and stored.
    placed = materialize(join_hot(rows, mix, keys, "m", docs.count()))
    alone = placed.where("m = 1").withColumn("copies", F.col("whole") + F.col("more"))
    # Equal rows are numbered inside each partition of the input and shifted by the counts of the partitions before.
    equal = placed.where("m > 1")
    counts = equal.groupBy(*keys, "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy(*keys).orderBy("part")) - F.col("count")).drop("count")
    numbered = equal.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.xxhash64("text")))).join(before, [*keys, "part"])
    equal = numbered.withColumn("copies", F.col("whole") + (F.col("nth") + F.col("before") <= F.col("more")).cast("long"))
    taken = alone.select(*COLUMNS, "copies").unionByName(equal.select(*COLUMNS, "copies")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of the permitted lengths; texts without words have a row without a bin."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages learn from data and iterate, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
