"""JSON sources and sinks: question sets, slice files, description caches, fixtures, reports.

Every reader takes an explicit schema (no inference pass over the data) and
ignores fields it does not know; every writer targets a folder under the
cluster's shared checkpoint directory unless the caller names one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.session import ensure_checkpoint_dir

QUESTION_SCHEMA = "question_id long, db_id string, question string, SQL string, difficulty string, evidence string"
SLICE_SCHEMA = "_meta struct<slice:string, purpose:string, seed:long>, question_ids array<long>"
FIELDS_SCHEMA = "db_id string, generated_by string, fields map<string, struct<short:string, long:string>>"
REPORT_SCHEMA = (
    "prompt_version string, prompt_fingerprint string, model string, slice_name string, k long, total long, "
    "n_correct_1 long, n_correct_k long"
)
VERIFIED_SCHEMA = (
    "db_id string, questions array<struct<id:string, question:string, gold_sql:string, gold_tables:array<string>, "
    "difficulty:string, gold_result:struct<columns:array<string>, rows:array<array<string>>>>>"
)
FIXTURE_SCHEMA = "cases array<struct<id:string, sql:string, expected_verdict:string, expected_rule:string>>"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/arbiter-{name}-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str) -> str:
    """S13 sink: JSON lines, overwrite (a rerun after a lost task rewrites the same output)."""
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """S13 scan: explicit schema, unknown fields ignored."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def load_questions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A question file (a JSON array per file when ``multi_line``) -> questions; evidence defaults to ''."""
    q = read_json(spark, path, QUESTION_SCHEMA, multi_line)
    return q.withColumn("evidence", F.coalesce(F.col("evidence"), F.lit("")))


def slice_filter(spark: SparkSession, slice_path: str, questions: DataFrame) -> DataFrame:
    """S3: keep only questions whose id is listed in the frozen slice file."""
    ids = read_json(spark, slice_path, SLICE_SCHEMA).select(F.explode("question_ids").alias("question_id"))
    return questions.join(ids, "question_id", "left_semi")


def load_field_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """S9 scan: (db_id, column_key, short, long) from per-db description caches; no file -> no rows."""
    d = read_json(spark, path, FIELDS_SCHEMA)
    return d.select("db_id", F.explode("fields").alias("column_key", "desc")).select(
        "db_id", F.lower("column_key").alias("column_key"), "desc.short", "desc.long")


def save_field_descriptions(desc: DataFrame, path: str, generated_by: str) -> str:
    """S9 sink: one JSON object per db, keys sorted; a db's map is bounded by its schema size."""
    per_db = desc.groupBy("db_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "column_key", F.struct(F.col("short").alias("short"), F.col("long").alias("long")))))).alias("fields")
    ).withColumn("generated_by", F.lit(generated_by))
    return write_json(per_db.select("db_id", "generated_by", "fields"), path)


def load_fixture_cases(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON file of a folder, cases exploded, tagged with the source file, stable order key."""
    raw = spark.read.schema(FIXTURE_SCHEMA).json(path).select("cases", F.col("_metadata.file_name").alias("source_file"))
    return raw.select("source_file", F.posexplode("cases").alias("pos", "case")).select(
        "source_file", "pos", "case.id", "case.sql", "case.expected_verdict", "case.expected_rule")


def load_verified_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nested question file -> (cases, gold results long table with row positions)."""
    v = read_json(spark, path, VERIFIED_SCHEMA).select("db_id", F.explode("questions").alias("q"))
    cases = v.select("db_id", F.col("q.id").alias("question_id"), "q.question", "q.gold_sql", "q.gold_tables",
                     "q.difficulty", F.col("q.gold_result.columns").alias("gold_columns"))
    rows = v.select(F.col("q.id").alias("question_id"), F.posexplode("q.gold_result.rows").alias("row_pos", "cells")).withColumn(
        "row_pos", F.col("row_pos") + 1)
    return cases, rows


def save_gold_rows(question_id: str, result: DataFrame, path: str, pos_col: str = "row_pos") -> str:
    """S14 sink: a gold result as JSON lines, one per row, with its position, column names and types; a result of any size."""
    values = [f for f in result.schema.fields if f.name != pos_col]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values)
    result.select(
        F.lit(question_id).alias("question_id"), F.col(pos_col).alias("row_pos"), F.array(*[F.lit(f.name) for f in values]).alias("columns"),
        F.lit(ddl).alias("types"), F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in values]), {"ignoreNullFields": "false"}).alias("row"),
    ).write.mode("append").json(path)
    return path


GOLD_ROWS_SCHEMA = "question_id string, row_pos long, columns array<string>, types string, row string"


def load_gold_rows(spark: SparkSession, path: str, question_id: str, types: str) -> DataFrame:
    """S14 scan: (row_pos, typed columns) of one question; rows stored with other columns or types are not the question's and give nothing."""
    rows = spark.read.schema(GOLD_ROWS_SCHEMA).json(path).where((F.col("question_id") == question_id) & (F.col("types") == types))
    return rows.select("row_pos", F.from_json("row", types).alias("r")).select("row_pos", "r.*")
