"""Corpus pipeline: documents through five training-data operators, one written table after another.

Every stage but the last returns the columns of ``documents``:

1. quality rules: rejected documents go;
2. line dedup: cross-site boilerplate lines go, ``n_chars`` follows the text;
3. n-gram Jaccard join: the document with the smallest id of each group stays;
4. benchmark decontamination: contaminated documents go;
5. best-fit packing: the pieces of what is left, with their place in the training sequences.

Nulls, empty texts, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplecraft.llm import decontaminate, jaccard, linespread, packing, quality
from samplecraft.llm.queries import table, tokenizer_path
from samplecraft.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linespread.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]

#: Shingle links, token ids and layouts have no SQL form; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
