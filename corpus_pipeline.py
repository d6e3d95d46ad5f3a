"""A training corpus from `documents`: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.

Every row is a document, whatever its id: repeated and missing ids are told apart by a key of each row where it matters.  Null texts count as empty: the
language stage rejects them, as it does all texts without letters.  An empty table gives an empty result, a table without labels keeps what it has; extra columns
pass through all stages but the last.  Of near duplicates the row of least id stays, of equal ids the first one.  Texts of any length are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import op02_kneser_ney_lang, op07_best_fit_packing, op08_nbsvm_quality, op10_circulant_minhash
from terracell.llm.common import documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; they learn from the labelled languages of all documents' sample."""
    return op02_kneser_ney_lang.accepted(docs, op02_kneser_ney_lang.fit(docs, learn="true"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to a sample of the labelled ones, finds likelier good than bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op08_nbsvm_quality.accepted(docs, op08_nbsvm_quality.fit(docs, labels, learn="true"))


#: The stage's limit on the similarity of word shingles; op10_circulant_minhash's own query has 85. The bands miss about 5 pairs in 100,000 at 0.80.
PERCENT = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of its least id, the first such row; of rows without an id only if the group has no other.

    Rows are grouped and dropped by a key of their own, so ids may repeat or be missing. The keyed rows are written, as the key must stay the same."""
    key = "_row"
    while key in docs.columns:  # an input column of that name passes through
        key += "_"
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    groups = op10_circulant_minhash.groups(keyed, id_col=key, percent=PERCENT).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    groups = written(groups, "row_groups")
    alike = groups.where("_row != _group")
    alike = written(alike.union(alike.select(F.col("_group").alias("_row"), "_group").distinct()), "alike")  # rows of groups of two or more
    placed = written(alike.join(keyed.select(F.col(key).alias("_row"), "doc_id"), "_row").select("_row", "_group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("place")), "placed_rows")
    first = placed.groupBy("_group").agg(F.min("place").alias("first")).select("_group", F.col("first._row").alias("_first"))
    dropped = written(placed.join(first, "_group").where("_row != _first").select(F.col("_row").alias("_dropped")), "dropped")
    return keyed.join(dropped, keyed[key] == dropped._dropped, "left_anti").drop(key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in the training sequences."""
    return op07_best_fit_packing.pack(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
