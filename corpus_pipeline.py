"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination and mixing, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of documents, whatever others there are.

In every stage a null text is kept or dropped as its docstring says, rows that repeat share a verdict (near-dedup keeps one of them), equal keys with other texts are documents of their own,
and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._store import Workspace
from plumbline.llm.decontam import drop_leaking
from plumbline.llm.langid import keep_identified
from plumbline.llm.linededup import dedup_lines
from plumbline.llm.mixing import mix_sources
from plumbline.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in no language that the table teaches, go; those in several stay."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has, within one edit, go; so do documents that lose all they had. Null and empty texts stay."""
    return dedup_lines(docs, Workspace(spark, "stage-lines"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id; documents without a word are one group."""
    return drop_near_duplicates(docs, Workspace(spark, "stage-near"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; those without a token stay."""
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words, with all their columns and how many words it takes, repeats counted.

    A column that is called as one of the mix's own (size, source_size, target, taken) comes out with _given after its name. Documents without a word are never taken.
    """
    own = ("size", "source_size", "target", "taken")
    carry = tuple(c for c in docs.columns if c != "doc_id")
    named = {c: c if c not in own else f"{c}_given" + "_" * sum(x.startswith(f"{c}_given") for x in carry) for c in carry}
    rows = docs.select("doc_id", *[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    mixed = mix_sources(rows, Workspace(spark, "stage-mix"), carry=tuple(named.values()))
    return mixed.filter(F.col("taken") > 0)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near), ("decontamination", benchmark), ("mixing", mix)]

#: The stages learn, hash and fit; SQL can't express them. tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
