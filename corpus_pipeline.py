"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them back for the next.

Defined results: rows with null texts have no words and go in the first stage; a null doc_id
never is a copy of anything. Further columns of the input stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import jaccard, linededup, mixing, packing, quality
from pixelloom.llm.common import read_table, small, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    judged = quality.quality(docs, keep=docs.columns).select("row", "kept")
    # Not deterministic for the optimizer, so that the filter stays above the counts; pushed
    # below them, it would hold each of their expressions many times over.
    return judged.withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that the operator drops; ``n_chars`` follows."""
    out = linededup.dedup_lines(docs, keep=docs.columns)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the least doc_id.

    Rows that repeat a doc_id are rows of their own: each stays where its text is of another group.
    In a group, of several rows with the least doc_id the one with the least set signature stays, and of
    equal sets the one with the least text, then the least other columns. Texts without words link
    with nothing; one a doc_id stays.
    """
    classes = staged(jaccard.row_classes(docs).where("doc_id is not null"), "classes")
    first = classes.where("doc_id = component_id").groupBy("doc_id", "class").agg(F.min("node").alias("node"))
    rows = classes.groupBy("doc_id").agg(F.count("*").alias("rows"))
    stay = staged(first.join(rows, "doc_id"), "stay")
    alone = docs.join(stay.where("rows = 1"), "doc_id", "left_semi").select(docs.columns)
    # Only where a doc_id repeats does a row need its signature to be told from the others.
    several = small(stay.where("rows > 1").select("doc_id", "node"))
    again = jaccard.with_signature(docs.join(several, "doc_id", "left_semi").select(docs.columns))
    again = again.withColumn("doc_id", F.col("row.doc_id").cast("long")).join(several, ["doc_id", "node"], "left_semi")
    order = F.struct("row.text", *(F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind))
    again = again.groupBy("doc_id", "node").agg(F.min_by("row", order).alias("row")).select("row.*")
    return alone.unionByName(again).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are there as often as the mix takes them, to the nearest whole number of times."""
    out = mixing.mix(docs, keep=docs.columns)
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest(F.col("size"), F.lit(1))))).otherwise(0).cast("int")
    return out.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their sequence and place there."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Components, apportionment and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs
