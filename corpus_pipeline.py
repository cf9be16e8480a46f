"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes every stage's result as
Parquet under the shared checkpoint folder and gives the reread table to the
next, so a lost executor repeats no earlier stage.

``ORACLE_SQL`` is None: MinHash pruning, latent retrieval and the keyed network
have no SQL form.  ``tests/llm/test_pipeline.py`` holds the stages against
brute-force versions.

Edge cases: every stage passes an empty table on; null and empty texts are
rejected by the first stage; repeated rows are near duplicates of each other;
columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm.common import written
from arbiter.llm.decontaminate import clean_documents
from arbiter.llm.jaccard_join import one_of_each_group
from arbiter.llm.mixing import mix
from arbiter.llm.pii import pseudonymize
from arbiter.llm.quality_rules import clean_lines


def _with_text(found: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of the packed rows with a new text, and its length where ``n_chars`` tells it."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that lose too many words, or fail the base rule, go."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]  # both are made anew, and the text goes to Python once
    return _with_text(clean_lines(docs, payload=F.struct(*others)).where("kept"), docs.columns, "cleaned")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of their format."""
    return _with_text(pseudonymize(docs), docs.columns, "text")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated or left out so that sources have their target weights."""
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
