"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it again as the next one's docs. Columns of docs stay, whatever their names, up to the last stage;
an empty table gives an empty result in every stage; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontam, near_dups, packing, quality, substring
from touchline.llm.common import fresh, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go. Labels of held-out rows teach nothing, as in the query.

    Null and empty texts are scored as texts without words. Rows that repeat share their fate. Without labels of both
    kinds nothing goes. A column ``score`` of docs stays as it is."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    score = fresh("quality_score", docs.columns)
    return quality.scored(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*named(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: five-word shingles, similarity of 0.8 or more.

    Null and empty texts and rows without a doc_id stay. doc_id identifies a document: rows that repeat it share its fate."""
    gone = near_dups.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(fresh("gone_id", docs.columns))).distinct()
    return docs.join(gone, F.col("doc_id") == gone[gone.columns[0]], "left_anti").select(*named(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in repeated spans go, except in the first document that holds them; emptied documents go too.

    Null and empty texts stay as they are. Repeated rows are cut alike. n_chars follows the text."""
    own = docs.withColumnsRenamed({c: fresh(f"own_{c}", docs.columns) for c in ("n_removed", "removed_words") if c in docs.columns})
    cut = substring.remove_repeats(own)
    left = cut.where((F.col("n_removed") == 0) | (F.trim("text") != "")).select(*[F.col(f"`{c}`").alias(o) for c, o in zip(own.columns, docs.columns, strict=True)])
    return left.select(*sized(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; a document that is nothing else goes whole.

    Null and empty texts stay as they are. Repeated rows are cut alike. n_chars follows the text."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*sized(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces with their ids, sequence and place. Null and empty texts are the end id alone; repeated rows are
    packed each by itself; other columns of docs are left out."""
    return packing.pack_documents(docs, with_ids=True)


def named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def sized(docs: DataFrame) -> list:
    """The columns of docs, n_chars after the text as it now is."""
    return [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifier, the sketches and the tokenizer are beyond it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
